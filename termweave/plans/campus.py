"""Campus-shaped tables over the star-schema test data.

Customers are people, orders their enrolments (term of the order date), order
lines their activity, aid and course sections (term of the ship date). Facts
stay keyed by the numeric customer until they are small; the text keys of the
systems are made from it at the end.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from termweave.functions.derive import pad_key, prefixed_key
from termweave.functions.terms import term_code, term_ord_of_date
from termweave.operators.partials import partials
from termweave.sources.sinks import write_extracts
from termweave.storage import fresh_path


_schemas: dict[str, StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the read-only test tables; the schema in its footer is looked up once per path."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    if path not in _schemas:
        _schemas[path] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[path]).parquet(path)


def student_id(number: Column) -> Column:
    return pad_key("S", number, 6)


def moodle_key(number: Column) -> Column:
    return prefixed_key("mdl_", student_id(number))


def workday_id(number: Column) -> Column:
    return pad_key("WD", number, 8)


def crosswalk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's key in the three systems."""
    person = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        student_id(person).alias("student_id"),
        moodle_key(person).alias("moodle_user_key"),
        workday_id(person).alias("workday_person_id"),
    )


def enrolments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as enrolment rows; the priority digit stands for the term average."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey"),
        F.col("o_custkey").alias("person"),
        term_ord_of_date(F.col("o_orderdate")).alias("term_ord"),
        F.when(F.col("o_orderstatus") == "P", F.lit("not_enrolled"))
        .otherwise(F.lit("enrolled"))
        .alias("enrollment_status"),
        (5 - F.substring("o_orderpriority", 1, 1).cast("int")).cast("double").alias("term_gpa"),
    )


def enrolment_partials(spark: SparkSession, sf_dir: str, values: Sequence[str] = ()) -> DataFrame:
    """Enrolments per person and term as sums and counts."""
    return partials(enrolments(spark, sf_dir), ["person", "term_ord"], values)


def numbered_crosswalk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The crosswalk by the numbers its text keys are made of, for joins before the keys are needed."""
    number = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(number.alias("system_key"), number.alias("person"))


def line_partials(spark: SparkSession, sf_dir: str, measures: dict[str, Column]) -> DataFrame:
    """Order lines per person and term of shipping, as sums and counts of the measures.

    Lines are shuffled once to meet their order, where adaptive execution splits an
    order with very many of them, and shrink to sums in the same tasks.
    """
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"),
        term_ord_of_date(F.col("l_shipdate")).alias("term_ord"),
        *[c.alias(name) for name, c in measures.items()],
    )
    owners = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("person"))
    return partials(lines.join(owners, "o_orderkey"), ["person", "term_ord"], list(measures))


def with_keys(df: DataFrame, *keys: Column) -> DataFrame:
    """Replace the numeric person by text keys."""
    return df.select(*keys, *[c for c in df.columns if c != "person"])


def coded(df: DataFrame) -> DataFrame:
    """Replace the term position by its code, once rows are few."""
    return df.select(term_code(F.col("term_ord")).alias("term_code"), *[c for c in df.columns if c != "term_ord"])


def logins() -> Column:
    return F.col("l_quantity").cast("bigint")


def loans() -> Column:
    return F.floor("l_extendedprice")


def stored_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with their person, joined and stored once for the caller, one folder per term."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = lines.select(
        F.col("o_custkey").alias("person"),
        term_code(term_ord_of_date(F.col("l_shipdate"))).alias("term_code"),
        logins().alias("login_count"),
        loans().alias("loans"),
    )
    path = write_extracts(rows, fresh_path(spark, "campus"), "lines")
    return spark.read.schema("person BIGINT, login_count BIGINT, loans BIGINT, term_code STRING").parquet(path)


def stored_workload_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The four tables the example workload reads, row by row, for SQL."""
    lines, person = stored_lines(spark, sf_dir), F.col("person")
    return {
        "identity_crosswalk": crosswalk(spark, sf_dir),
        "sis_enrollments": coded(
            with_keys(enrolments(spark, sf_dir).drop("o_orderkey"), student_id(person).alias("student_id"))
        ),
        "lms_activity": lines.select(moodle_key(person).alias("moodle_user_key"), "term_code", "login_count"),
        "financial_aid": lines.select(workday_id(person).alias("workday_person_id"), "term_code", "loans"),
    }
