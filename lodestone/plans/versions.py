"""Kept folders that change as a whole: their tables lie in subfolders of their own, and a numbered pointer file names those in use."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession

from lodestone.plans.scratch import files


class Conflict(RuntimeError):
    """Another writer published first."""


def new_folder(path: str) -> str:
    """A subfolder that nothing has used; until a version names it, no reader sees it."""
    return f"{path}/data/{uuid.uuid4().hex}"


def current(spark: SparkSession, path: str) -> tuple[int, dict]:
    """(number, facts) of the version in use; (0, {}) where none is."""
    fs, folder = files(spark, f"{path}/versions")
    if not fs.exists(folder):
        return 0, {}
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    number = max((int(n.removesuffix(".json")) for n in names if n.endswith(".json")), default=0)
    return (number, _read(spark, path, number)) if number else (0, {})


def _read(spark: SparkSession, path: str, number: int) -> dict:
    return json.loads(spark.read.text(f"{path}/versions/{number:012d}.json", wholetext=True).first()[0])


def publish(spark: SparkSession, path: str, after: int, facts: dict) -> int:
    """Puts facts in use as the version after number `after`, by renaming a finished file; returns its number. Raises Conflict where
    that version exists already: what this writer wrote stays unseen, and it has to start again from the version in use."""
    number = after + 1
    fs, target = files(spark, f"{path}/versions/{number:012d}.json")
    _, draft = files(spark, f"{path}/versions/draft-{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    out.write(json.dumps(facts).encode())
    out.close()
    if fs.exists(target) or not fs.rename(draft, target):
        fs.delete(draft, False)
        raise Conflict(f"{path}: version {number} is there already")
    return number


def sweep(spark: SparkSession, path: str, used: set[str]) -> int:
    """Deletes data folders other than those in use, such as what failed writers left. Only while nobody writes or reads an older
    version. Returns how many went."""
    fs, folder = files(spark, f"{path}/data")
    gone = [s.getPath() for s in fs.listStatus(folder) if s.getPath().getName() not in {u.rpartition("/")[2] for u in used}] if fs.exists(folder) else []
    for p in gone:
        fs.delete(p, True)
    return len(gone)
