"""Assembling tables from extracts delivered as ``terms/<term>/<table>.csv|json``.

Top-level files (``<table>.csv|json`` beside ``terms``) belong to the same
tables. A large table may come as several files, ``<table>.part-<n>.csv|json``.
File suffixes count in any letter case; ``metadata.json`` is not a table.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termweave import schemas

# Texts read as null in delivered CSV files, and the layout of paths.
NULL_TEXTS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
TERM_FILE = r"/terms/([^/]+)/[^/]+$"
FILE_NAME = r"([^/]+?)(?:\.part-[0-9]+)?\.[^./]+$"
SUFFIX = r"\.([^./]+)$"
SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?"
NOT_TABLES = ("metadata.json",)
#: Column that holds the text of a CSV row with too many or too few cells.
BROKEN = "_broken_row"
FORMATS = ("csv", "json")


def _any_case(text: str) -> str:
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in text)


def file_pattern(table: str, fmt: str) -> str:
    """Glob of a table's files in one format, whole or in parts, suffix in any letter case."""
    return f"{table}{{,.part-[0-9]*}}.{_any_case(fmt)}"


def table_of(path: Column) -> Column:
    """Table name: the file name without its last suffix and without the number of a part."""
    return F.regexp_extract(path, FILE_NAME, 1)


def term_folder_of(path: Column) -> Column:
    """Term folder a file lies in, null at top level."""
    return F.nullif(F.regexp_extract(path, TERM_FILE, 1), F.lit(""))


def format_of(path: Column) -> Column:
    """Reader to use: json for that suffix, csv for everything else."""
    return F.when(F.lower(F.regexp_extract(path, SUFFIX, 1)) == "json", F.lit("json")).otherwise(F.lit("csv"))


def _bare(path: str) -> str:
    """A path without scheme and host; relative ones are refused, as they differ between file systems."""
    bare = re.sub(SCHEME, "", path).rstrip("/")
    if not bare.startswith("/"):
        raise ValueError(f"name the folder by an absolute path or URI, not {path}")
    return re.sub("/+", "/", bare)


def term_below(path: Column, depth: int) -> Column:
    """Term folder of a file in ``terms`` below a folder this deep, empty for one directly in it, else null."""
    steps = F.split(F.regexp_replace(path, SCHEME, ""), "/")
    below = F.size(steps) - 1 - depth
    in_terms = (below == 3) & (F.try_element_at(steps, F.lit(depth + 2)) == "terms")
    return F.when(below == 1, F.lit("")).when(in_terms, F.try_element_at(steps, F.lit(depth + 3)))


def depth_of(root: str) -> int:
    """How many folders deep a folder lies."""
    return _bare(root).count("/")


def list_extracts(spark: SparkSession, root: str, with_version: bool = False) -> DataFrame:
    """Every extract below ``root``: path, table, format and term folder, on request when it was modified and its size.

    Lists files without opening them. A missing folder is an error.
    """
    depth = depth_of(root)
    version = [F.col("modificationTime").alias("modified"), F.col("length").alias("size")] if with_version else []
    found = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.{" + ",".join(_any_case(f) for f in FORMATS) + "}")
        .load(root)
        .select("path", *version)
    )
    path, term = F.col("path"), F.col("_term")
    placed = found.withColumn("_term", term_below(path, depth)).filter(term.isNotNull())
    return placed.filter((term != "") | ~F.substring_index(path, "/", -1).isin(*NOT_TABLES)).select(
        path,
        table_of(path).alias("table_name"),
        format_of(path).alias("format"),
        F.nullif(term, F.lit("")).alias("term_folder"),
        *(["modified", "size"] if with_version else []),
    )


def nulls_from_text(df: DataFrame, tokens: Sequence[str] = NULL_TEXTS, keep: Sequence[str] = ()) -> DataFrame:
    """Text columns, but those in ``keep``, with the usual spellings of a missing value as null."""
    return df.select(
        *[
            F.when(~F.col(f"`{f.name}`").isin(*tokens), F.col(f"`{f.name}`")).alias(f.name)
            if isinstance(f.dataType, T.StringType) and f.name not in keep
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def typed_from_text(df: DataFrame, schema: T.StructType, on_bad: str = "error") -> DataFrame:
    """Text columns as the types of ``schema``. A text that is no value of its type is an error.

    ``on_bad``: ``error``; ``null`` to read such texts as null; or the name of an
    array column that gets ``column=text`` for each of them.
    """
    made, bad = [], []
    for f in schema.fields:
        text = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StringType):
            made.append(text)
            continue
        value = text.try_cast(f.dataType)
        wrong = text.isNotNull() & value.isNull()
        if on_bad == "error":
            message = F.concat(F.lit(f"{f.name} is no {f.dataType.simpleString()}: "), text)
            value = F.when(wrong, F.raise_error(message).cast(f.dataType)).otherwise(value)
        made.append(value.alias(f.name))
        bad.append(F.when(wrong, F.concat(F.lit(f"{f.name}="), text)))
    others = [F.col(f"`{c}`") for c in df.columns if c not in schema.names]
    if on_bad not in ("error", "null"):
        others.append(F.array_compact(F.array(*bad, F.lit(None).cast("string"))).alias(on_bad))
    return df.select(*made, *others)


def text_schema(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])


def file_path() -> Column:
    """The file a row is read from, by its name as it stands; Spark tells it with escapes."""
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


def _source() -> list[Column]:
    """Term folder and file of a row that is being read."""
    path = file_path()
    return [term_folder_of(path).alias("source_term"), path.alias("source_file")]


def csv_options(multiline: bool = False) -> dict:
    """How delivered CSV is read; all cells of a row are parsed, so that missing and surplus ones are seen."""
    return {
        "header": True, "escape": '"', "multiLine": multiline, "dateFormat": "yyyy-MM-dd",
        "columnPruning": False, "columnNameOfCorruptRecord": BROKEN,
    }


def with_broken(layout: T.StructType) -> T.StructType:
    """The columns of a CSV file and one for rows that do not have as many cells."""
    return T.StructType([*layout.fields, T.StructField(BROKEN, T.StringType())])


def _intact(rows: DataFrame) -> Column:
    """Whether a row has all its cells and no more.

    A cell is looked at as well, since the reader refuses to look for broken rows alone.
    """
    cell = F.col(f"`{next(c for c in rows.columns if c != BROKEN)}`").cast("string")
    return F.col(BROKEN).isNull() & (F.length(F.coalesce(cell, F.lit(""))) >= 0)


def refuse_broken(rows: DataFrame) -> DataFrame:
    """Rows of a wrong number of cells are an error, whichever columns are used later."""
    message = F.concat(F.lit("a row has too many or too few cells: "), F.col(BROKEN))
    whole = F.when(_intact(rows), F.lit(True)).otherwise(F.raise_error(message).cast("boolean"))
    return rows.filter(whole).drop(BROKEN)


def _csv_rows(spark, path, schema, check_header, multiline, with_source, options) -> DataFrame:
    """All rows as they parse, with ``BROKEN``; typed as inferred without a schema, else as text."""
    reader = spark.read.options(**csv_options(multiline), **options)
    if schema is None:
        layout = reader.option("inferSchema", True).csv(path).schema
    else:
        layout = text_schema(schema)
        reader = reader.option("enforceSchema", not check_header)
    if not layout.fields:
        raise ValueError(f"no header in {path}")
    rows = reader.schema(with_broken(layout)).csv(path)
    return rows.select("*", *_source()) if with_source else rows


def read_csv(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType | None = None,
    check_header: bool = True,
    multiline: bool = False,
    with_source: bool = False,
    on_bad: str = "error",
    **options,
) -> DataFrame:
    """CSV with a header; empty cells and missing-value texts are null.

    With a schema, a file whose header differs is an error rather than columns
    read in the wrong order, and so is a text that is no value of its column's
    type (see :func:`typed_from_text`). Without one, types are inferred.
    ``multiline`` allows line breaks in quoted cells; such files are not split.

    A row with more or fewer cells than the header is an error. With ``on_bad``
    ``null`` missing cells are null and surplus ones left out; with the name of a
    column, that column gets ``row=<text>`` too, so no cell is lost. To keep such rows
    apart, see :func:`split_malformed`.
    """
    rows = _csv_rows(spark, path, schema, check_header, multiline, with_source, options)
    if on_bad == "error":
        rows = refuse_broken(rows)
    names = [c for c in rows.columns if c != BROKEN]
    broken = [F.col(BROKEN)] if on_bad not in ("error", "null") else []
    rows = nulls_from_text(rows.select(*names)) if not broken else nulls_from_text(rows, keep=(BROKEN,))
    if schema is not None:
        rows = typed_from_text(rows, schema, on_bad)
    elif broken:
        rows = rows.withColumn(on_bad, F.array().cast("array<string>"))
    if broken:
        text = F.when(F.col(BROKEN).isNotNull(), F.array(F.concat(F.lit("row="), F.col(BROKEN))))
        rows = rows.withColumn(on_bad, F.concat(on_bad, F.coalesce(text, F.array().cast("array<string>")))).drop(BROKEN)
    return rows


def _cell_count(text: Column) -> Column:
    """Cells of a CSV row: separators outside quotes, and one."""
    bare = F.regexp_replace(text, '"[^"]*"', "")
    return F.length(bare) - F.length(F.replace(bare, F.lit(","), F.lit(""))) + 1


def malformed(spark: SparkSession, path: str | list[str], schema: T.StructType, multiline: bool = False, **options) -> DataFrame:
    """The CSV rows that have more or fewer cells than the header.

    source_file, record (the row's number in its file, from 1, without header and
    blank lines), n_cells, and text, the row as it stands.

    Rows are numbered where they are read. Of each block of a file only its number of
    rows and its first number are gathered, and a block begins after the rows of the
    file's earlier blocks; so files are split and read in parallel as usual.
    """
    rows = _csv_rows(spark, path, schema, True, multiline, False, options)
    placed = rows.select(
        file_path().alias("source_file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_at"),
        F.col(BROKEN).alias("text"),
        _intact(rows).alias("_intact"),
    )
    block = ["source_file", "_start"]
    sizes = placed.groupBy(*block).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("source_file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    begins = sizes.select(*block, (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"))
    found = placed.filter(~F.col("_intact")).join(begins, block)
    return found.select(
        "source_file", (F.col("_at") + F.col("_shift") + 1).alias("record"), _cell_count(F.col("text")).alias("n_cells"), "text"
    )


def split_malformed(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType,
    multiline: bool = False,
    with_source: bool = False,
    on_bad: str = "error",
    **options,
) -> tuple[DataFrame, DataFrame]:
    """The well-formed rows, typed, and the malformed ones with their place (see :func:`malformed`)."""
    rows = _csv_rows(spark, path, schema, True, multiline, with_source, options)
    good = rows.filter(_intact(rows)).drop(BROKEN)
    return typed_from_text(nulls_from_text(good), schema, on_bad), malformed(spark, path, schema, multiline, **options)


def read_json(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType | None = None,
    lines: bool = False,
    with_source: bool = False,
    **options,
) -> DataFrame:
    """JSON: an array of objects or one object per file, or one object per line."""
    reader = spark.read.options(multiLine=not lines, **options)
    if schema is not None:
        reader = reader.schema(schema)
    rows = reader.json(path)
    return rows.select("*", *_source()) if with_source else rows


def flatten(df: DataFrame, separator: str = "_") -> DataFrame:
    """Nested objects as plain columns ``outer_inner``; arrays stay as they are."""

    def leaves(kind: T.DataType, column: Column, name: str) -> list[Column]:
        if not isinstance(kind, T.StructType):
            return [column.alias(name)]
        return [
            leaf
            for field in kind.fields
            for leaf in leaves(field.dataType, column.getField(field.name), f"{name}{separator}{field.name}")
        ]

    columns = []
    for field in df.schema.fields:
        columns += leaves(field.dataType, F.col(f"`{field.name}`"), field.name)
    return df.select(*columns)


def _locate(spark: SparkSession, root: str) -> dict[str, list[tuple[str, str, str]]]:
    """Per table, the term folders and formats it comes in, with the folder's path.

    One listing; the result is as long as tables times terms.
    """
    base = root.rstrip("/")
    found = list_extracts(spark, root).select("table_name", "term_folder", "format").distinct()
    located: dict[str, list[tuple[str, str, str]]] = {}
    for table, term, fmt in sorted((r[0], r[1] or "", r[2]) for r in found.collect()):
        located.setdefault(table, []).append((term, fmt, f"{base}/terms/{term}" if term else base))
    return located


def _folders(spark: SparkSession, root: str, table: str) -> list[tuple[str, str, str]]:
    folders = _locate(spark, root).get(table)
    if not folders:
        raise FileNotFoundError(f"no extract of {table} below {root}")
    return folders


def read_extracts(
    spark: SparkSession,
    root: str,
    table: str,
    schema: T.StructType | None = None,
    with_source: bool = False,
    multiline: bool = False,
) -> DataFrame:
    """One table from all term folders and the top level, in a single scan per format.

    The schema of a known table is used when none is given; for others it is
    inferred. ``with_source`` adds the term folder and the file of each row.
    """
    return _read_folders(spark, table, _folders(spark, root, table), schema, with_source, multiline)


def _read_folders(spark, table, folders, schema=None, with_source=False, multiline=False) -> DataFrame:
    if schema is None and schemas.known(table):
        schema = schemas.schema(table)
    parts = []
    for fmt in sorted({fmt for _, fmt, _ in folders}):
        paths = [path for _, f, path in folders if f == fmt]
        found = {"pathGlobFilter": file_pattern(table, fmt), "with_source": with_source}
        if fmt == "csv":
            parts.append(read_csv(spark, paths, schema, multiline=multiline, **found))
        else:
            parts.append(flatten(read_json(spark, paths, schema, **found)))
    return union_extracts(*parts)


def read_table(
    spark: SparkSession, root: str, table: str, fmt: str = "parquet", schema: T.StructType | None = None
) -> DataFrame:
    """A table written one folder per term; the term is a partition column, so filters on it skip folders.

    Cells of CSV files may hold line breaks, as the sink writes them.
    """
    path = f"{root.rstrip('/')}/{table}"
    if fmt == "csv":
        return read_csv(spark, path, schema, check_header=False, multiline=True)
    if fmt == "json":
        return read_json(spark, path, schema, lines=True)
    return (spark.read.schema(schema) if schema is not None else spark.read).parquet(path)


def read_parts(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table whose deliveries differ in columns, matched by name."""
    return spark.read.option("mergeSchema", True).parquet(path)


def csv_headers(spark: SparkSession, root: str, table: str) -> DataFrame:
    """source_file, source_term and header (the first line) of every CSV file of a table, in one scan."""
    depth = depth_of(root)
    lines = (
        spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", file_pattern(table, "csv")).text(root)
    ).select(
        file_path().alias("source_file"),
        F.when(F.col("_metadata.file_block_start") == 0, F.monotonically_increasing_id()).alias("_at"),
        "value",
    )
    # Rows without a place, those of later blocks, are never the least.
    first = lines.groupBy("source_file").agg(F.min_by("value", "_at").alias("header"))
    term = term_below(F.col("source_file"), depth)
    return first.select("source_file", term.alias("source_term"), "header").filter("source_term IS NOT NULL")


def _cells_of(header: str) -> list[str]:
    return next(csv.reader([header.removeprefix("\ufeff")]), [])


def _by_header(spark: SparkSession, root: str, table: str) -> list[tuple[list[str], list[str]]]:
    """Per different header of a table's CSV files, its columns and the files that have it."""
    grouped = csv_headers(spark, root, table).groupBy("header").agg(F.collect_list("source_file").alias("files"))
    return [(_cells_of(r["header"]), sorted(r["files"])) for r in grouped.orderBy("header").collect()]


# What the texts of a column can be, as bits, so that kinds of many rows merge by bit_or.
_KINDS = {"int": 1, "bigint": 2, "double": 4, "boolean": 8, "date": 16, "timestamp": 32, "string": 64}


def _kind_of(text: Column) -> Column:
    """The bit of the narrowest type a text is a value of; 0 for null."""
    number = text.rlike(r"^[+-]?[0-9]+$")
    real = text.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$")
    day = text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & text.try_cast("date").isNotNull()
    moment = text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}") & text.try_cast("timestamp").isNotNull()
    found = (
        F.when(text.isNull(), 0)
        .when(number & text.try_cast("int").isNotNull(), _KINDS["int"])
        .when(number & text.try_cast("bigint").isNotNull(), _KINDS["bigint"])
        .when(real, _KINDS["double"])
        .when(F.lower(text).isin("true", "false"), _KINDS["boolean"])
        .when(day, _KINDS["date"])
        .when(moment, _KINDS["timestamp"])
    )
    return found.otherwise(_KINDS["string"])


def _type_of(bits: Column) -> Column:
    """The narrowest type for all kinds in a set of bits; text where there is none, or no value at all."""
    only = lambda *kinds: (bits.bitwiseAND(F.lit(127 - sum(_KINDS[k] for k in kinds))) == 0) & (bits > 0)
    return (
        F.when(only("int"), F.lit("int"))
        .when(only("int", "bigint"), F.lit("bigint"))
        .when(only("int", "bigint", "double"), F.lit("double"))
        .when(only("boolean"), F.lit("boolean"))
        .when(only("date"), F.lit("date"))
        .when(only("date", "timestamp"), F.lit("timestamp"))
        .otherwise(F.lit("string"))
    )


def folder_types(spark: SparkSession, root: str, table: str, multiline: bool = False) -> DataFrame:
    """part (term folder, empty at top level), column_name and type of every column a table has in each folder.

    One aggregation over one scan: files of equal header are read together, every
    cell says which type it is the narrowest value of, and the bits of those types
    are merged before the shuffle. JSON files are read as variants, whose types merge
    alike. The driver works per header, however many folders there are.
    """
    parts, place = [], lambda: F.coalesce(term_below(file_path(), depth_of(root)), F.lit("")).alias("part")
    for header, files in _by_header(spark, root, table):
        layout = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(header))])
        reader = spark.read.options(**csv_options(multiline)).schema(with_broken(layout))
        cells = nulls_from_text(reader.csv(files).select("*", place()), keep=("part", BROKEN))
        bits = cells.groupBy("part").agg(*[F.bit_or(_kind_of(F.col(f.name))).alias(f.name) for f in layout.fields])
        named = [F.struct(F.lit(name).alias("column_name"), F.col(f"c{i}").alias("bits")) for i, name in enumerate(header)]
        parts.append(bits.select("part", F.inline(F.array(*named))))
    json_folders = [path for _, fmt, path in _folders(spark, root, table) if fmt == "json"]
    whole = None
    if parts:
        merged = union_extracts(*parts).groupBy("part", "column_name").agg(F.bit_or("bits").alias("bits"))
        whole = merged.select("part", "column_name", _type_of(F.col("bits")).alias("type"))
    if json_folders:
        found = {"singleVariantColumn": "v", "multiLine": True, "pathGlobFilter": file_pattern(table, "json")}
        elements = F.coalesce(F.try_variant_get("v", "$", "array<variant>"), F.array("v"))  # of an array, or the one object
        objects = spark.read.options(**found).json(json_folders).select(place(), F.explode(elements).alias("v"))
        keys = objects.lateralJoin(spark.tvf.variant_explode(F.col("v").outer())).select("part", "key", "value")
        kinds = keys.groupBy("part", F.col("key").alias("column_name")).agg(F.lower(F.schema_of_variant_agg("value")).alias("type"))
        kind = F.when(F.col("type").startswith("decimal"), F.lit("double")).when(F.col("type") == "void", F.lit("string"))
        kinds = kinds.withColumn("type", kind.otherwise(F.col("type")))
        whole = kinds if whole is None else whole.unionByName(kinds)
    return whole


def read_drifted(spark: SparkSession, root: str, table: str, schema: T.StructType | None = None) -> DataFrame:
    """One table whose files differ in column order or columns, matched by name.

    Files with the same header are read together, so there are as many scans as
    different headers. Columns a file lacks are null there.
    """
    folders = _folders(spark, root, table)
    if schema is None and schemas.known(table):
        schema = schemas.schema(table)
    typed = {f.name: f.dataType for f in schema.fields} if schema else {}
    parts = []
    for header, files in _by_header(spark, root, table):
        layout = T.StructType([T.StructField(c, typed.get(c, T.StringType())) for c in header])
        parts.append(read_csv(spark, files, layout))
    json_folders = [path for _, fmt, path in folders if fmt == "json"]
    if json_folders:
        parts.append(flatten(read_json(spark, json_folders, schema, pathGlobFilter=file_pattern(table, "json"))))
    whole = union_extracts(*parts)
    known = [c for c in typed if c in whole.columns]
    return whole.select(*known, *[c for c in whole.columns if c not in typed])


def assemble(
    spark: SparkSession,
    root: str,
    tables: Sequence[str] | None = None,
    with_source: bool = False,
    multiline: bool = False,
    table_schemas: dict[str, T.StructType] | None = None,
) -> dict[str, DataFrame]:
    """All tables found below ``root``, or the named ones, as DataFrames by name."""
    located = _locate(spark, root)
    missing = sorted(set(tables or ()) - set(located))
    if missing:
        raise FileNotFoundError(f"no extract of {', '.join(missing)} below {root}")
    given = table_schemas or {}
    return {t: _read_folders(spark, t, located[t], given.get(t), with_source, multiline) for t in tables or located}


def register(tables: dict[str, DataFrame]) -> None:
    """Make tables known to SQL under their names."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def unregister(spark: SparkSession, *names: str) -> None:
    for name in names:
        spark.catalog.dropTempView(name)


def union_extracts(*extracts: DataFrame) -> DataFrame:
    """All rows of several extracts, columns matched by name, missing ones null."""
    whole = extracts[0]
    for one in extracts[1:]:
        whole = whole.unionByName(one, allowMissingColumns=True)
    return whole
