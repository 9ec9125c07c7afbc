"""lodestone: catalog search, vector retrieval, evidence fusion, event analytics and customer models as Spark plans."""
