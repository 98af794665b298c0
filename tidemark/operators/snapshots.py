"""Snapshots of a memory on shared storage: written whole, then made current by one small commit row.

A reader sees the snapshot of the last commit or none, never half of one; a batch that fails leaves what was current. Of
two writers the later number wins, and both snapshots stay until :func:`retained` names them for removal.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.store import Memory

#: Number of the tables' layout; a snapshot of another one isn't read.
VERSION = 1
COMMITS = "number long, version int, name string, at timestamp"


def commits(spark: SparkSession, root: str) -> DataFrame:
    """Commits of a store (number, version, name, at); none if there is no store yet."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/commits")
    there = where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(where)
    return spark.read.schema(COMMITS).parquet(f"{root}/commits") if there else spark.createDataFrame([], COMMITS)


def latest(spark: SparkSession, root: str, before: int | None = None) -> dict | None:
    """The commit with the largest number, perhaps of those up to ``before``."""
    found = commits(spark, root)
    found = found if before is None else found.where(F.col("number") <= before)
    row = found.orderBy(F.desc("number"), F.desc("name")).first()
    return row.asDict() if row else None


def commit(memory: Memory, root: str, name: str, at: datetime) -> int:
    """Writes all tables under ``name``, then the commit; returns its number."""
    spark = memory.units.sparkSession
    for table, rows in zip(Memory._fields, memory, strict=True):
        rows.write.mode("errorifexists").parquet(f"{root}/snapshots/{name}/{table}")
    last = latest(spark, root)
    number = 1 if last is None else last["number"] + 1
    spark.createDataFrame([(number, VERSION, name, at)], COMMITS).coalesce(1).write.mode("append").parquet(f"{root}/commits")
    return number


def read(spark: SparkSession, root: str, number: int | None = None) -> Memory | None:
    """The memory as of the last commit, or of the last one up to ``number``; None where there is none."""
    found = latest(spark, root, number)
    if found is None:
        return None
    if found["version"] != VERSION:
        raise ValueError(f"snapshot {found['name']} has layout {found['version']}, not {VERSION}")
    return Memory(*(spark.read.parquet(f"{root}/snapshots/{found['name']}/{table}") for table in Memory._fields))


def restored(spark: SparkSession, root: str, number: int, name: str, at: datetime) -> int:
    """Makes an older snapshot current again, as a new commit of a copy; returns its number."""
    memory = read(spark, root, number)
    if memory is None:
        raise KeyError(number)
    return commit(memory, root, name, at)


def beyond(spark: SparkSession, root: str, newest: int = 10) -> list[str]:
    """Names of snapshots older than the newest ones, at most one row a snapshot; the caller removes them."""
    rows = commits(spark, root).orderBy(F.desc("number"), F.desc("name")).select("name").collect()
    return sorted({r["name"] for r in rows[newest:]} - {r["name"] for r in rows[:newest]})


def backup_due(spark: SparkSession, root: str, now: datetime, hours: float = 24) -> bool:
    """Whether the last commit is older than so many hours, or there is none."""
    last = latest(spark, root)
    return last is None or now - last["at"] >= timedelta(hours=hours)
