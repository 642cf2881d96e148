"""Running totals of people kept up to date as terms are appended, late terms included.

The state is a folder with the rows that each load made or changed, ``load=<number>``:
a person's sums of a term and the totals up to it. The row of the latest load counts. A
load reads the last balances of its own people and writes the rows from their
earliest new term on; nobody else's are computed or written. Running a load again
replaces its rows, as it starts from the loads before it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

from termweave.operators.ordering import latest_per_key
from termweave.storage import file_system


def _totals(rows: DataFrame, person: str, term: str, values: Sequence[str], before: DataFrame) -> DataFrame:
    """One row per person and term with its sums and the totals up to it, from a balance ``_b_<v>`` on."""
    sums = rows.groupBy(person, term).agg(*[F.sum(v).alias(v) for v in values]).join(before, person, "left")
    upto = W.partitionBy(person).orderBy(term).rowsBetween(W.unboundedPreceding, W.currentRow)
    nothing = F.lit(0)
    totals = [(F.coalesce(F.sum(v).over(upto), nothing) + F.coalesce(F.col(f"_b_{v}"), nothing)).alias(f"total_{v}") for v in values]
    return sums.select(person, term, *values, *totals)


def changed_totals(state: DataFrame, new: DataFrame, person: str, term: str, values: Sequence[str]) -> DataFrame:
    """The rows of the state that the rows ``new``, of any terms, add or change.

    For a person with new rows from term t on, the last total before t is the balance,
    and the sums of t and later, old and new together, are added up from it. A term
    that comes in order finds nothing later and costs its own rows; a late one costs
    the later terms of its own people.
    """
    since = new.groupBy(person).agg(F.min(term).alias("_since"))
    theirs = state.join(since, person)
    earlier = theirs.filter(F.col(term) < F.col("_since"))
    last = F.max(F.struct(F.col(term), *[F.col(f"total_{v}") for v in values])).alias("_last")
    balance = earlier.groupBy(person).agg(last).select(person, *[F.col(f"_last.total_{v}").alias(f"_b_{v}") for v in values])
    columns = [person, term, *values]
    later = theirs.filter(F.col(term) >= F.col("_since")).select(*columns)
    return _totals(later.unionByName(new.select(*columns)), person, term, values, balance)


def _schema(new: DataFrame, person: str, term: str, values: Sequence[str]) -> T.StructType:
    kinds = {f.name: f.dataType for f in new.schema.fields}
    sums = [T.StructField(f"{prefix}{v}", T.LongType()) for prefix in ("", "total_") for v in values]
    return T.StructType([T.StructField(person, kinds[person]), T.StructField(term, kinds[term]), *sums, T.StructField("load", T.LongType())])


def current_totals(spark: SparkSession, path: str, schema: T.StructType, person: str, term: str, before: int | None = None) -> DataFrame:
    """The state after all loads, or after those below ``before``: the latest row of each person and term."""
    from pyarrow import fs

    store, place = file_system(path)
    if store.get_file_info(place).type == fs.FileType.NotFound:
        rows = spark.createDataFrame([], schema)
    else:
        rows = spark.read.schema(schema).parquet(path)
    if before is not None:
        rows = rows.filter(F.col("load") < before)
    return latest_per_key(rows, [person, term], ["load"]).drop("load")


def add_load(new: DataFrame, path: str, load: int, person: str, term: str, values: Sequence[str]) -> DataFrame:
    """Add the rows of a load (whole numbers in ``values``) to the state at ``path``; the state as it then is."""
    spark, schema = new.sparkSession, _schema(new, person, term, values)
    whole = new.select(person, term, *[F.col(v).cast("bigint").alias(v) for v in values])
    state = current_totals(spark, path, schema, person, term, before=load)
    changed_totals(state, whole, person, term, values).write.mode("overwrite").parquet(f"{path.rstrip('/')}/load={load}")
    return current_totals(spark, path, schema, person, term, before=load + 1)
