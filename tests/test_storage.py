"""Stored intermediate tables and the shuffles behind them."""

import pytest
from pyspark.sql import functions as F

from termweave.storage import FREE_SHUFFLES, fresh_path, shuffles_freed


def counts(spark):
    return spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.count("*").alias("n"))


def test_a_stored_result_outlives_its_shuffles(spark):
    path = fresh_path(spark, "freed")
    df = counts(spark)
    with shuffles_freed(spark):
        df.write.parquet(path)
    assert sorted(spark.read.parquet(path).collect()) == sorted(df.collect())


@pytest.mark.parametrize("named", [None, "true", "false"])
def test_the_setting_is_put_back_after_errors_too(spark, named):
    before = spark.conf.get(FREE_SHUFFLES, None)
    try:
        spark.conf.unset(FREE_SHUFFLES)
        if named:
            spark.conf.set(FREE_SHUFFLES, named)
        held = spark.conf.get(FREE_SHUFFLES, None)
        with pytest.raises(RuntimeError), shuffles_freed(spark):
            assert spark.conf.get(FREE_SHUFFLES) == "true"
            raise RuntimeError
        assert spark.conf.get(FREE_SHUFFLES, None) == held
    finally:
        if before is None:
            spark.conf.unset(FREE_SHUFFLES)
        else:
            spark.conf.set(FREE_SHUFFLES, before)
