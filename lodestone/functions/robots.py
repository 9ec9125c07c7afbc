"""Robots rules: which paths an agent may fetch."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def disallowed(text: str, agent: str = "*") -> list[str]:
    """Paths disallowed to an agent, or to all where the file doesn't name it. Agents on consecutive lines share a group."""
    rules: dict[str, list[str]] = {}
    group: list[str] = []
    open_group = False
    for line in text.splitlines():
        key, _, value = (x.strip() for x in line.split("#")[0].partition(":"))
        if key.lower() == "user-agent":
            group = [*group, value.lower()] if open_group else [value.lower()]
            open_group = True
            rules.setdefault(value.lower(), [])
        elif key:
            open_group = False
            if key.lower() == "disallow" and value:
                for name in group:
                    rules[name].append(value)
    return rules.get(agent.lower(), rules.get("*", []))


def allowed(path: Column, rules: list[str]) -> Column:
    """Whether no rule covers a path: rules are prefixes with * for anything and a final $ for the end."""
    if not rules:
        return F.lit(True)
    return ~path.rlike("^(?:" + "|".join(".*".join(re.escape(p) for p in r.removesuffix("$").split("*")) + ("$" if r.endswith("$") else "") for r in rules) + ")")
