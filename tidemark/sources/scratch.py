"""Intermediate tables in the folder that the cluster shares: a plan's lineage ends there, and a lost executor costs its tasks only."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own_roots: dict[str, str] = {}
_open: list[list[DataFrame]] = []


def shared_root(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; where none is set, a temporary folder if the session runs on one machine.

    On a cluster without that setting this raises: executors would each write to a disk of their own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_roots:
        _own_roots[app] = tempfile.mkdtemp(prefix="tidemark-")
    return _own_roots[app]


def staged(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again."""
    path = f"{shared_root(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.staged_path = path
    if _open:
        _open[-1].append(out)
    return out


@contextmanager
def passing(*keep: DataFrame) -> Iterator[list[DataFrame]]:
    """Deletes at its end, or where it fails, all tables staged within, but those put into the list that it gives."""
    kept: list[DataFrame] = list(keep)
    _open.append([])
    try:
        yield kept
    finally:
        made = _open.pop()
        discard(*[t for t in made if all(t is not k for k in kept)])


def discard(*tables: DataFrame) -> None:
    """Deletes tables that :func:`staged` returned and that no plan yet to run reads; other DataFrames are left alone."""
    for df in tables:
        if path := getattr(df, "staged_path", None):
            spark = df.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)
