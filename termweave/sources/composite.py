"""Columns holding several keys in one text, such as ``S000001|2024FA``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEPARATOR = "|"


def text_columns(df: DataFrame) -> list[str]:
    """The columns that can hold a composite key: those of type string."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def _quoted(separator: str) -> str:
    return "".join(f"[{c}]" if c not in "^\\" else "\\" + c for c in separator)


def part_count(text: Column, separator: str = SEPARATOR) -> Column:
    """Number of parts: separators plus one."""
    without = F.replace(text, F.lit(separator), F.lit(""))
    return ((F.length(text) - F.length(without)) / len(separator) + 1).cast("int")


def parts(text: Column, separator: str = SEPARATOR) -> Column:
    """All parts as an array, empty ones included; null stays null."""
    return F.split(text, _quoted(separator))


def composite_columns(df: DataFrame, separator: str = SEPARATOR, columns: Sequence[str] | None = None) -> DataFrame:
    """One row telling for each text column whether any value is composite."""
    columns = columns or text_columns(df)
    return df.agg(
        *[F.coalesce(F.bool_or(F.contains(F.col(c), F.lit(separator))), F.lit(False)).alias(c) for c in columns]
    )


def widths(df: DataFrame, separator: str = SEPARATOR, columns: Sequence[str] | None = None) -> DataFrame:
    """One row with the largest part count of each text column, one if it has no values."""
    columns = columns or text_columns(df)
    return df.agg(*[F.coalesce(F.max(part_count(F.col(c), separator)), F.lit(1)).alias(c) for c in columns])


def split_composite(
    df: DataFrame,
    separator: str = SEPARATOR,
    width: dict[str, int] | None = None,
    as_arrays: Sequence[str] = (),
) -> DataFrame:
    """Add ``<col>_1`` to ``<col>_n`` for every composite column; originals stay.

    Without ``width`` one aggregate over all text columns finds the number of
    parts, over the whole table, so every extract gets the same columns. Streams
    must pass it. Rows with fewer parts get null. Columns named in ``as_arrays``
    get one array column ``<col>_parts`` with all parts instead, however many.
    """
    if width is None:
        found = widths(df, separator).first()
        width = {c: n for c, n in (found.asDict() if found else {}).items() if n > 1}
    added = []
    for c, n in width.items():
        if c in as_arrays:
            added.append(parts(F.col(c), separator).alias(f"{c}_parts"))
        else:
            split = parts(F.col(c), separator)
            added += [F.try_element_at(split, F.lit(i)).alias(f"{c}_{i}") for i in range(1, n + 1)]
    return df.select("*", *added)


def explode_composite(df: DataFrame, column: str, separator: str = SEPARATOR) -> DataFrame:
    """One row per part, numbered from 1, for any number of parts."""
    others = [c for c in df.columns if c != column]
    unfolded = df.select(*others, F.posexplode(parts(F.col(column), separator)).alias("_at", "part"))
    return unfolded.select(*others, (F.col("_at") + 1).alias("part_no"), "part")
