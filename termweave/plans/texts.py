"""Queries over texts and documents: composite keys, slugs, JSON, SQL texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from termweave.functions import derive
from termweave.functions.sqltext import tables_read
from termweave.functions.terms import term_of_date
from termweave.operators import identity, quality
from termweave.plans import campus, sql
from termweave.plans.registry import query
from termweave.sources import composite
from termweave.sources.extracts import flatten, format_of, table_of, term_folder_of


@query(
    """
    SELECT bool_or(contains(text, '|')) AS text, bool_or(contains(lang, '|')) AS lang,
           bool_or(contains(source, '|')) AS source
    FROM documents""",
    "P8", "P9", "A6",
)
def composite_flags(spark, sf_dir):
    """Which text columns hold composite values."""
    return composite.composite_columns(campus.table(spark, sf_dir, "documents"))


@query(
    """
    SELECT max(length(text) - length(replace(text, '|', '')) + 1)::INTEGER AS text,
           max(length(lang) - length(replace(lang, '|', '')) + 1)::INTEGER AS lang,
           max(length(source) - length(replace(source, '|', '')) + 1)::INTEGER AS source
    FROM documents""",
    "A5", "F21",
)
def composite_widths(spark, sf_dir):
    """The largest number of parts in each text column."""
    return composite.widths(campus.table(spark, sf_dir, "documents"))


@query(
    f"""
    WITH k AS (SELECT o_orderkey, {sql.student('o_custkey')} || '|' || {sql.term('o_orderdate')} ||
                      CASE WHEN o_orderstatus = 'P' THEN '|' || o_orderpriority ELSE '' END AS key FROM orders),
    s AS (SELECT *, string_split(key, '|') AS p FROM k)
    SELECT o_orderkey, key, p[1] AS key_1, p[2] AS key_2, p[3] AS key_3 FROM s""",
    "F22", "F21", "A5",
)
def composite_split(spark, sf_dir):
    """Composite keys of two or three parts as columns; the key stays."""
    key = F.concat_ws(
        "|",
        campus.student_id(F.col("o_custkey")),
        term_of_date(F.col("o_orderdate")),
        F.when(F.col("o_orderstatus") == "P", F.col("o_orderpriority")),
    )
    return composite.split_composite(campus.table(spark, sf_dir, "orders").select("o_orderkey", key.alias("key")))


@query(
    """
    SELECT unnest(range(1, len(p) + 1))::INTEGER AS part_no, count(*) AS filled
    FROM (SELECT string_split(text, chr(10)) AS p FROM documents) GROUP BY part_no""",
    "F22", "A5",
)
def composite_split_text(spark, sf_dir):
    """Documents split into their lines, in one array column however many they are, and how often each place is filled."""
    docs = campus.table(spark, sf_dir, "documents").select("text")
    split = composite.split_composite(docs, "\n", as_arrays=["text"])
    unfolded = split.select(F.posexplode("text_parts").alias("_at", "part"))
    return unfolded.groupBy((F.col("_at") + 1).alias("part_no")).agg(F.count("part").alias("filled"))


@query(
    """
    SELECT doc_id, unnest(range(1, len(p) + 1))::INTEGER AS part_no, unnest(p) AS part
    FROM (SELECT doc_id, string_split(text, '|') AS p FROM documents)""",
    "F22",
)
def composite_parts(spark, sf_dir):
    """All parts of every document, however many."""
    return composite.explode_composite(campus.table(spark, sf_dir, "documents").select("doc_id", "text"), "text")


@query(
    """
    WITH b AS (SELECT p_partkey, p_name AS full_name, lower(regexp_replace(p_name, '[^A-Za-z0-9]', '', 'g')) AS base
               FROM part),
    n AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY p_partkey) AS k FROM b)
    SELECT p_partkey, full_name, base, base || CASE WHEN k > 1 THEN k::VARCHAR ELSE '' END AS username,
           base || CASE WHEN k > 1 THEN k::VARCHAR ELSE '' END || '@example.edu' AS email
    FROM n""",
    "W7", "F19", "F20",
)
def slug_dedupe(spark, sf_dir):
    """User names from full names, made unique by a number."""
    named = campus.table(spark, sf_dir, "part").select(
        "p_partkey", F.col("p_name").alias("full_name"), derive.slug(F.col("p_name")).alias("base")
    )
    unique = identity.dedupe_suffix(named, "base", ["p_partkey"], "username")
    return unique.withColumn("email", derive.email(F.col("username"), "example.edu"))


@query(
    """
    SELECT lower(regexp_replace(p_name, '[^A-Za-z0-9]', '', 'g')) AS base, count(*) AS occurrences
    FROM part GROUP BY 1""",
    "A9", "F19",
)
def name_occurrences(spark, sf_dir):
    """How many people share each base name."""
    return identity.occurrences(campus.table(spark, sf_dir, "part"), derive.slug(F.col("p_name")))


@query(
    """
    SELECT event_id, regexp_replace(text, '\\s+', ' ', 'g') AS normal, trim(text, ',;') AS bare
    FROM (SELECT event_id, ',;' || event_type || E' \\n\\t' || props || ';' AS text FROM events)""",
    "F24", "F25",
)
def text_cleanup(spark, sf_dir):
    """White space as single blanks, and punctuation stripped from the ends."""
    text = F.concat(F.lit(",;"), F.col("event_type"), F.lit(" \n\t"), F.col("props"), F.lit(";"))
    return campus.table(spark, sf_dir, "events").select(
        "event_id", derive.collapse_space(text).alias("normal"), derive.strip_chars(text, ",;").alias("bare")
    )


# Logged statements and the tables each of them reads.
TEMPLATES = {
    "click": ("SELECT * FROM clicks c JOIN app.users u ON c.u = u.id -- join ghosts\n", ["clicks", "users"]),
    "view": ("select a from views v, users where a > (select max(x) from limits)", ["views", "users", "limits"]),
    "purchase": (
        'WITH recent AS (SELECT * FROM "Purchases") SELECT * FROM recent JOIN log.purchases p USING (id)',
        ["Purchases", "purchases"],
    ),
    "signup": ("SELECT extract(year FROM day) /* from */ FROM (SELECT * FROM signups, `days`) s", ["signups", "days"]),
    "error": ("select g from generate_series(1, 3) g", []),
}
TABLES_READ = " ".join(f"WHEN '{kind}' THEN {tables}::VARCHAR[]" for kind, (_, tables) in TEMPLATES.items())
LOGGED = f"""
    named AS (SELECT event_id, list_append(CASE event_type {TABLES_READ} END, 'u' || user_id) AS tables
              FROM events WHERE event_type IN ({", ".join(f"'{k}'" for k in TEMPLATES)})
              UNION ALL SELECT event_id, NULL FROM events
              WHERE event_type NOT IN ({", ".join(f"'{k}'" for k in TEMPLATES)}) OR event_type IS NULL)"""


def _logged(spark, sf_dir):
    text = F.lit(None).cast("string")
    for kind, (template, _) in TEMPLATES.items():
        text = F.when(F.col("event_type") == kind, F.lit(template)).otherwise(text)
    events = campus.table(spark, sf_dir, "events")
    return events.select(
        "event_id", F.concat(text, F.lit(" UNION ALL SELECT * FROM log.u"), F.col("user_id").cast("string")).alias("sql_text")
    )


@query(
    f"""
    WITH {LOGGED}
    SELECT event_id, array_to_string(list_sort(tables), ',') AS tables, len(tables)::INTEGER AS fanout FROM named""",
    "F23", "F24", "F25", "A7", "O6", "Q4",
)
def sql_fanout(spark, sf_dir):
    """The tables each logged SQL text reads, and how many."""
    tables = tables_read(F.col("sql_text"))
    return _logged(spark, sf_dir).select(
        "event_id", F.array_join(F.array_sort(tables), ",").alias("tables"), F.size(tables).alias("fanout")
    )


@query(
    f"""
    WITH {LOGGED}
    SELECT table_name, count(*) AS queries FROM (SELECT unnest(tables) AS table_name FROM named) GROUP BY table_name""",
    "A7", "F23",
)
def table_usage(spark, sf_dir):
    """How many logged queries read each table."""
    used = _logged(spark, sf_dir).select(F.explode(tables_read(F.col("sql_text"))).alias("table_name"))
    return used.groupBy("table_name").agg(F.count(F.lit(1)).alias("queries"))


@query(
    """
    SELECT event_id, (props::JSON ->> '$.k')::INTEGER AS k,
           json_object('event_id', event_id, 'event_type', event_type, 'k', (props::JSON ->> '$.k')::INTEGER,
                       'error', CASE WHEN event_type = 'error' THEN 'failed' END)::VARCHAR AS receipt
    FROM events""",
    "F26",
)
def receipt_json(spark, sf_dir):
    """JSON texts read, and written with explicit nulls."""
    k = F.from_json("props", "k INT").getField("k")
    error = F.when(F.col("event_type") == "error", F.lit("failed"))
    receipt = derive.json_object(F.col("event_id"), F.col("event_type"), k.alias("k"), error.alias("error"))
    return campus.table(spark, sf_dir, "events").select("event_id", k.alias("k"), receipt.alias("receipt"))


@query(
    """
    SELECT event_id, (props::JSON ->> '$.k')::INTEGER AS detail_props_k, event_type AS detail_kind FROM events""",
    "S2",
)
def flatten_nested(spark, sf_dir):
    """Nested objects as plain columns."""
    props = F.from_json("props", "k INT")
    detail = F.struct(props.alias("props"), F.col("event_type").alias("kind"))
    return flatten(campus.table(spark, sf_dir, "events").select("event_id", detail.alias("detail")))


@query(
    """
    SELECT event_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-4' || substr(h, 14, 3) || '-' ||
           ['8', '9', 'a', 'b'][(('0x' || substr(h, 17, 1))::INTEGER % 4) + 1] || substr(h, 18, 3) || '-' ||
           substr(h, 21, 12) AS id
    FROM (SELECT event_id, md5(event_id || ':' || user_id) AS h FROM events)""",
    "F30",
)
def stable_uuid(spark, sf_dir):
    """Ids that are the same on every run."""
    return campus.table(spark, sf_dir, "events").select(
        "event_id", derive.stable_uuid(F.col("event_id"), F.col("user_id")).alias("id")
    )


@query(
    """
    WITH d AS (SELECT ts::DATE AS day, count(*) AS part_documents,
                      count(*) FILTER (event_type = 'purchase') AS bought,
                      count(*) FILTER (event_type = 'error') AS failed FROM events GROUP BY 1),
    k AS (SELECT day, 'k' AS key, part_documents AS documents, part_documents FROM d
          UNION ALL SELECT day, 'value', bought, part_documents FROM d
          UNION ALL SELECT day, 'error', failed, part_documents FROM d)
    SELECT day, key, documents, part_documents, documents::DOUBLE / part_documents::DOUBLE AS share
    FROM k WHERE documents > 0""",
    "X2", "F26",
)
def key_drift_by_day(spark, sf_dir):
    """Which keys the JSON documents of each day have."""
    document = F.to_json(
        F.struct(
            F.from_json("props", "k INT").getField("k").alias("k"),
            F.when(F.col("event_type") == "purchase", F.col("value")).alias("value"),
            F.when(F.col("event_type") == "error", F.lit("failed")).alias("error"),
        )
    )
    rows = campus.table(spark, sf_dir, "events").select(F.to_date("ts").alias("day"), document.alias("document"))
    return quality.json_key_drift(rows, "document", "day")


@query(
    f"""
    WITH p AS (SELECT o_orderkey, 'file:/in/terms/' || {sql.term('o_orderdate')} || '/sis.v2' ||
                      CASE o_orderstatus WHEN 'F' THEN '.JSON' WHEN 'O' THEN '.csv' ELSE '.CSV' END AS path FROM orders
               UNION ALL SELECT c_custkey, 'file:/in/crosswalk.csv' FROM customer)
    SELECT path, regexp_replace(regexp_replace(path, '.*/', ''), '\\.[^.]*$', '') AS table_name,
           CASE WHEN lower(path) LIKE '%.json' THEN 'json' ELSE 'csv' END AS format,
           CASE WHEN path LIKE '%/terms/%' THEN split_part(path, '/', 4) END AS term_folder, count(*) AS cnt
    FROM p GROUP BY path""",
    "S5",
)
def extract_paths(spark, sf_dir):
    """Table, format and term folder of a file from its path."""
    suffix = F.when(F.col("o_orderstatus") == "F", ".JSON").when(F.col("o_orderstatus") == "O", ".csv").otherwise(".CSV")
    term_file = F.concat(F.lit("file:/in/terms/"), term_of_date(F.col("o_orderdate")), F.lit("/sis.v2"), suffix)
    paths = campus.table(spark, sf_dir, "orders").select(term_file.alias("path"))
    top_level = campus.table(spark, sf_dir, "customer").select(F.lit("file:/in/crosswalk.csv").alias("path"))
    counted = paths.unionByName(top_level).groupBy("path").agg(F.count(F.lit(1)).alias("cnt"))
    path = F.col("path")
    return counted.select(
        "path",
        table_of(path).alias("table_name"),
        format_of(path).alias("format"),
        term_folder_of(path).alias("term_folder"),
        "cnt",
    )
