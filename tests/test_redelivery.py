"""Files delivered again, batches that end early, and tables that are replaced."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import types as T

from termweave.sources import sinks, versions
from termweave.streaming import redelivery

SCHEMA = T.StructType().add("a", T.IntegerType()).add("b", T.StringType())


@pytest.fixture
def place(tmp_path):
    root = tmp_path / "out"
    (root / "terms" / "2024 SP").mkdir(parents=True)
    (root / "t.csv").write_text("a,b\n1,x\n2,y\n")
    (root / "terms" / "2024 SP" / "t.json").write_text('[{"a": 3, "b": "z"}]')
    return root, str(tmp_path / "load")


def load(spark, place, **more):
    root, target = place
    return redelivery.load_versions(spark, str(root), "t", target, SCHEMA, **more)


def rewrite(path, text, seconds):
    path.write_text(text)
    os.utime(path, (seconds, seconds))


def test_a_file_delivered_again_replaces_its_rows(spark, place, values):
    root, target = place
    assert values(load(spark, place), "a", "b", "source_term") == [(1, "x", ""), (2, "y", ""), (3, "z", "2024 SP")]
    rewrite(root / "t.csv", "a,b\n1,corrected\n", 2_000_000_000)
    (root / "terms" / "2024 SP" / "t.part-1.CSV").write_text("a,b\n4,new\n")
    assert values(load(spark, place), "a", "b") == [(1, "corrected"), (3, "z"), (4, "new")]
    before = sorted(p.name for p in (root.parent / "load" / "rows").iterdir())
    assert values(load(spark, place), "a", "b") == [(1, "corrected"), (3, "z"), (4, "new")]
    assert sorted(p.name for p in (root.parent / "load" / "rows").iterdir()) == before
    # An older version that is put back is a version too, and so is a file without rows.
    rewrite(root / "t.csv", "a,b\n1,x\n2,y\n", 1_500_000_000)
    rewrite(root / "terms" / "2024 SP" / "t.json", "[]", 2_100_000_000)
    assert values(load(spark, place), "a", "b") == [(1, "x"), (2, "y"), (4, "new")]


def test_a_batch_run_again_changes_nothing(spark, place, values):
    root, target = place
    load(spark, place)
    rewrite(root / "t.csv", "a,b\n9,q\n", 2_000_000_000)
    wanted = values(load(spark, place))
    arrivals = spark.createDataFrame(spark.read.parquet(f"{target}/files").filter("batch = 1").drop("batch").collect(), redelivery.NOTES)
    redelivery.store_batch(spark, arrivals, 1, target, SCHEMA, False)
    assert values(redelivery.current(spark, target, SCHEMA)) == wanted


def test_rows_count_once_their_list_is_there(spark, place, values):
    """A run that ends between rows and list leaves the table as it was; the next run ends the batch."""
    root, target = place
    before = values(load(spark, place))
    rewrite(root / "t.csv", "a,b\n9,q\n", 2_000_000_000)
    listed, real = {}, redelivery.DataFrame
    stopped = redelivery.store_batch

    def half(session, arrivals, batch, *rest):
        stopped(session, arrivals, batch, *rest)
        import shutil

        shutil.rmtree(f"{target}/files/batch={batch}")
        listed["seen"] = values(redelivery.current(spark, target, SCHEMA))
        raise RuntimeError("the run ends here")

    redelivery.store_batch = half
    try:
        with pytest.raises(Exception, match="ends here"):
            load(spark, place)
    finally:
        redelivery.store_batch = stopped
    assert real is redelivery.DataFrame and listed["seen"] == before
    assert values(load(spark, place), "a", "b") == [(3, "z"), (9, "q")]


def test_batches_of_few_files_and_compaction(spark, place, values):
    root, target = place
    load(spark, place, files_per_batch=1)
    for i in range(3):
        rewrite(root / "t.csv", f"a,b\n{i},v\n", 2_000_000_000 + i)
        load(spark, place)
    assert redelivery.compact(spark, target, SCHEMA) == 2
    assert values(redelivery.current(spark, target, SCHEMA), "a", "b") == [(2, "v"), (3, "z")]
    assert redelivery.compact(spark, target, SCHEMA) == 2  # their lists stay, their rows are gone
    assert values(load(spark, place), "a", "b") == [(2, "v"), (3, "z")]


def test_a_load_before_any_delivery(spark, tmp_path):
    (tmp_path / "in").mkdir()
    assert load(spark, (tmp_path / "in", str(tmp_path / "load"))).collect() == []


def test_a_table_is_there_at_every_step(spark, rows, tmp_path, values):
    root = str(tmp_path / "table")
    with pytest.raises(FileNotFoundError):
        versions.read(spark, root)
    assert versions.read(spark, root, SCHEMA).collect() == []
    first = versions.replace(rows("a int", (1,), (2,)), root)
    begun = versions.read(spark, root)
    staged = versions.stage(versions.read(spark, root).filter("a > 1"), root)
    assert versions.current_version(root) == first and values(versions.read(spark, root)) == [(1,), (2,)]
    versions.publish(root, staged)
    assert values(versions.read(spark, root)) == [(2,)] and values(begun) == [(1,), (2,)]
    with pytest.raises(Exception):
        versions.replace(rows("a int", (1,)).selectExpr("raise_error('no') AS a"), root)
    assert values(versions.read(spark, root)) == [(2,)]
    third = versions.replace(rows("a int, b string", (5, "other columns")), root)
    assert versions.clear_old(root, keep=1) >= 2
    assert versions.current_version(root) == third and values(versions.read(spark, root)) == [(5, "other columns")]


def test_recreating_switches_the_folder(spark, rows, values, monkeypatch):
    sinks.recreate(rows("a int", (1,), (2,)), "t_switched")
    try:
        begun = spark.read.parquet(sinks._location(spark, "t_switched"))
        said = []
        real = type(spark).sql
        monkeypatch.setattr(type(spark), "sql", lambda self, text, *a, **k: (said.append(text), real(self, text, *a, **k))[1])
        sinks.recreate(spark.table("t_switched").filter("a > 1"), "t_switched")
        assert not [t for t in said if t.startswith(("DROP", "CREATE"))]
        assert values(spark.table("t_switched")) == [(2,)] and values(begun) == [(1,), (2,)]
        sinks.append_aligned(rows("a int", (3,)), "t_switched")
        assert values(spark.table("t_switched")) == [(2,), (3,)]
        sinks.recreate(rows("b string", ("x",)), "t_switched")
        assert values(spark.table("t_switched")) == [("x",)]
    finally:
        spark.sql("DROP TABLE IF EXISTS t_switched")
