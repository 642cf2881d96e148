"""Where intermediate tables go.

Jobs that must read an intermediate result twice (range numbering, write and
read back) store it in the shared folder the session names in
``spark.checkpoint.dir``, so that a lost executor costs a re-read and never a
different answer.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache
from urllib.parse import quote

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@lru_cache(maxsize=None)
def _local_dir(application_id: str) -> str:
    return tempfile.mkdtemp(prefix="termweave-")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session; a temporary one only on a single machine."""
    context = spark.sparkContext
    one_machine = context.master.startswith("local") and not context.master.startswith("local-cluster")
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if one_machine:
        return _local_dir(context.applicationId)
    raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other run uses."""
    return f"{_run_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _run_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/termweave/{spark.sparkContext.applicationId}"


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path on it."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path if ":" in path.split("/", 1)[0] else f"file://{quote(path)}")


def clear(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application, when no result of it is read any more."""
    path = _run_dir(spark)
    store, place = file_system(path)
    if store.get_file_info(place).type != fs.FileType.NotFound:
        store.delete_dir(place)


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Queries run inside delete their shuffle files at their end, as nothing but the stored result is read later.

    While a query runs its shuffles stay, so a lost executor costs what it always does.
    """
    before = spark.conf.get(FREE_SHUFFLES, None)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(FREE_SHUFFLES)
        else:
            spark.conf.set(FREE_SHUFFLES, before)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and go on from the stored copy."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
