"""Tables that are replaced as a whole, without a moment in which there is none.

A table is a folder: ``data/<version>`` holds the Parquet files of each version and
``current/<number>-<version>`` is an empty file that makes a version the table's.
A version is published by writing its data under a new name and then creating that
one file, which file systems and object stores do at once or not at all. Readers take
the highest number. So a reader, or a crash anywhere between the steps, finds the
old table or the new one, and never a part.
"""

from __future__ import annotations

import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from termweave.storage import file_system


def _pointers(root: str) -> list[str]:
    store, place = file_system(root)
    listed = store.get_file_info(fs.FileSelector(f"{place}/current", allow_not_found=True))
    return sorted(f.base_name for f in listed if f.type == fs.FileType.File and "-" in f.base_name)


def current_version(root: str) -> str | None:
    """The name of the published version, if there is one."""
    pointers = _pointers(root)
    return pointers[-1].split("-", 1)[1] if pointers else None


def stage(df: DataFrame, root: str) -> str:
    """Write a version that is not published yet; its name."""
    version = uuid.uuid4().hex
    df.write.parquet(f"{root.rstrip('/')}/data/{version}")
    return version


def publish(root: str, version: str) -> None:
    """Make a staged version the table."""
    store, place = file_system(root)
    pointers = _pointers(root)
    number = int(pointers[-1].split("-", 1)[0]) + 1 if pointers else 1
    store.create_dir(f"{place}/current", recursive=True)
    with store.open_output_stream(f"{place}/current/{number:012d}-{version}"):
        pass


def replace(df: DataFrame, root: str) -> str:
    """Replace the table by the rows of ``df``, which may read the table itself."""
    version = stage(df, root)
    publish(root, version)
    return version


def read(spark: SparkSession, root: str, schema: T.StructType | None = None) -> DataFrame:
    """The published rows. A reader that has begun keeps to its version."""
    version = current_version(root)
    if version is None:
        if schema is None:
            raise FileNotFoundError(f"no table was published in {root}")
        return spark.createDataFrame([], schema)
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(f"{root.rstrip('/')}/data/{version}")


def clear_old(root: str, keep: int = 2) -> int:
    """Delete all but the last ``keep`` published versions, and data that was never published; how many.

    Not to be run while a version is staged or an old one is still read.
    """
    store, place = file_system(root)
    kept = {p.split("-", 1)[1] for p in _pointers(root)[-max(1, keep) :]}
    old = [p for p in _pointers(root) if p.split("-", 1)[1] not in kept]
    for pointer in old:
        store.delete_file(f"{place}/current/{pointer}")
    listed = store.get_file_info(fs.FileSelector(f"{place}/data", allow_not_found=True))
    gone = [f.path for f in listed if f.type == fs.FileType.Directory and f.base_name not in kept]
    for path in gone:
        store.delete_dir(path)
    return len(gone)
