"""Every registered query against its SQL, at the smallest scale."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import __spark_entry__ as entry  # noqa: E402
from tools import compare  # noqa: E402

SF_DIR = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF_DIR.exists(), reason="no test data")


@pytest.fixture(scope="module")
def db():
    return compare.database(str(SF_DIR))


@pytest.mark.parametrize("name", sorted(entry.load_all()))
def test_query_equals_its_sql(spark, db, name):
    result, _ = compare.compare(spark, db, str(SF_DIR), name, entry.queries()[name], entry.oracle_sql()[name])
    assert result.startswith("ok"), result


def test_entry(spark):
    flagship = entry.entry(spark)
    assert flagship.columns == ["student_id", "n", "avg_logins"] and flagship.count() > 0


def test_every_inventory_row_is_registered_or_tested():
    covered = {c for q in entry.load_all().values() for c in q.covers}
    counts = {"S": 10, "K": 10, "P": 11, "J": 9, "A": 10, "W": 8, "O": 6, "F": 33, "T": 1, "Q": 9, "X": 4}
    inventory = {f"{letter}{i}" for letter, n in counts.items() for i in range(1, n + 1)}
    assert inventory == covered
