"""What the text operators share."""

from __future__ import annotations

import tempfile
import zipfile
from functools import lru_cache
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but these six bytes.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\f\r"


@lru_cache(maxsize=None)
def _archive() -> str:
    """The package as an archive that Python workers can import."""
    package = Path(__file__).resolve().parent.parent
    path = str(Path(tempfile.mkdtemp(prefix="termweave-code-")) / "termweave.zip")
    with zipfile.ZipFile(path, "w") as archive:
        for file in sorted(package.rglob("*.py")):
            archive.write(file, str(file.relative_to(package.parent)))
    return path


_SENT: set[str] = set()


def send_code(spark: SparkSession) -> None:
    """Let the executors' Python workers import this package; Spark copies it from the driver."""
    context = spark.sparkContext
    if context.applicationId not in _SENT:
        context.addPyFile(_archive())
        _SENT.add(context.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    send_code(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(docs: DataFrame) -> Column:
    """The text, empty where it is null."""
    return F.coalesce(docs["text"], F.lit(""))


def digest_of(docs: DataFrame) -> Column:
    """128 bits of the text, with the id what tells rows apart; a null text counts as empty."""
    return F.unhex(F.md5(text_of(docs).cast("binary")))


def words(text: Column) -> Column:
    return F.filter(F.split(text, SPACES), lambda w: w != "")


def crc_of_id(doc_id: Column) -> Column:
    """crc32 of the id as text; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")))


def joined_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """An equi-join in which nulls are equal; the keys of the right side are dropped."""
    other = right.withColumnsRenamed({k: f"__{k}" for k in keys})
    on = [left[k].eqNullSafe(other[f"__{k}"]) for k in keys]
    return left.join(other, on, how).drop(*(f"__{k}" for k in keys))
