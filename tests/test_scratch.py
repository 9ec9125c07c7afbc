"""Where written tables go."""

import pytest

from lodestone.plans import scratch


class Session:
    """A session of which only the settings and the application are asked."""

    def __init__(self, **settings):
        self.conf, self.sparkContext = self, self
        self.settings, self.applicationId = {k.replace("_", "."): v for k, v in settings.items()}, f"app-{id(self)}"

    def get(self, key, default=None):
        return self.settings.get(key, default)


def test_folder():
    assert scratch.folder(Session(spark_checkpoint_dir="s3a://there", spark_master="yarn")) == "s3a://there"
    local = Session(spark_master="local[4]")
    assert scratch.folder(local) == scratch.folder(local) != scratch.folder(Session(spark_master="local[4]"))
    for master in ("yarn", "local-cluster[2,1,1024]", "spark://host:7077"):
        with pytest.raises(ValueError):
            scratch.folder(Session(spark_master=master))


def test_temporary(spark):
    with scratch.temporary(spark):
        inner = scratch.cut(spark.range(3))
        with scratch.temporary(spark, keep=True):
            kept = scratch.cut(inner)
    assert kept.count() == 3
    with pytest.raises(Exception, match="does not exist|PATH_NOT_FOUND|FILE_NOT_EXIST"):
        inner.count()
