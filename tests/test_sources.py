from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termweave import schemas
from termweave.operators import quality
from termweave.sources import composite, extracts, sinks
from termweave.streaming.incremental import load_incremental

AID = "workday_person_id,term_code,fafsa_received,pell_amount,institutional_grant,loans,balance_due\n"


@pytest.fixture
def root(tmp_path):
    """A delivery of three terms with a crosswalk, holds and run metadata."""
    top = tmp_path / "out"
    for term, people in (("2023FA", 2), ("2024SP", 3), ("2024FA", 1)):
        folder = top / "terms" / term
        folder.mkdir(parents=True)
        lines = [f"WD{i:08d},{term},true,{i},0,{100 * i},-{i}\n" for i in range(1, people + 1)]
        (folder / "financial_aid.csv").write_text(AID + "".join(lines))
        hold = {"hold_id": f"h-{term}", "term_code": term, "student_id": None, "hold_type": "housing",
                "active": True, "placed_date": "2023-08-25", "cleared_date": None}
        (folder / "advising_holds.json").write_text(json.dumps([hold, hold], indent=2))
        (folder / "notes.txt").write_text("not a table")
    (top / "identity_crosswalk.csv").write_text("student_id,moodle_user_key,workday_person_id\nS000001,mdl_s000001,WD00000001\n")
    (top / "students_master.json").write_text(json.dumps({"student_id": "S000001", "full_name": "Alex Kim", "birth_date": "2001-02-03"}))
    (top / "metadata.json").write_text(json.dumps({"seed": 1, "systems": {"lms": "M", "registration": "W"}, "terms": ["2023FA"]}))
    (top / "terms" / "2023FA" / "deeper").mkdir()
    (top / "terms" / "2023FA" / "deeper" / "financial_aid.csv").write_text(AID + "WD9,2023FA,true,0,0,0,0\n")
    return top


def test_listing(spark, root, values):
    (root / "terms" / "2024FA" / "metadata.json").write_text("[]")
    (root / "terms" / "2024FA" / "EXTRA.Csv").write_text("a\n1\n")
    listed = values(extracts.list_extracts(spark, str(root)), "table_name", "format", "term_folder")
    assert ("metadata", "json", None) not in listed and ("metadata", "json", "2024FA") in listed
    assert ("EXTRA", "csv", "2024FA") in listed and ("students_master", "json", None) in listed
    assert sum(t == "financial_aid" for t, _, _ in listed) == 3 and not any(t == "notes" for t, _, _ in listed)


def test_a_delivery_may_lie_in_a_folder_named_terms(spark, tmp_path, values):
    top = tmp_path / "terms" / "out"
    (top / "terms" / "2023FA").mkdir(parents=True)
    (top / "identity_crosswalk.csv").write_text("student_id,moodle_user_key,workday_person_id\nS1,m1,w1\n")
    (top / "terms" / "2023FA" / "financial_aid.csv").write_text(AID + "WD1,2023FA,true,0,0,0,0\n")
    for root in (str(top), f"file://{top}/", f"file:{top}"):
        assert values(extracts.list_extracts(spark, root), "table_name", "term_folder") == [
            ("financial_aid", "2023FA"), ("identity_crosswalk", None),
        ]
        assert {n: d.count() for n, d in extracts.assemble(spark, root).items()} == {"financial_aid": 1, "identity_crosswalk": 1}
    with pytest.raises(ValueError, match="absolute"):
        extracts.list_extracts(spark, "out")


def test_missing_folder_is_an_error(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        extracts.list_extracts(spark, str(tmp_path / "nowhere")).count()


def test_assembling_all_terms(spark, root, values):
    tables = extracts.assemble(spark, str(root))
    assert {n: d.count() for n, d in tables.items()} == {
        "advising_holds": 6, "financial_aid": 6, "identity_crosswalk": 1, "students_master": 1,
    }
    for name, df in tables.items():
        assert [(f.name, f.dataType) for f in df.schema.fields] == [(f.name, f.dataType) for f in schemas.schema(name).fields]
    aid = extracts.read_extracts(spark, str(root), "financial_aid", with_source=True)
    assert aid.filter(F.col("source_term") != F.col("term_code")).count() == 0
    master = tables["students_master"].first()
    assert master.birth_date == dt.date(2001, 2, 3) and master.email is None


def test_one_table_at_top_level_in_terms_and_in_two_formats(spark, root):
    head = ",".join(schemas.schema("advising_holds").names)
    (root / "advising_holds.csv").write_text(head + "\nh9,2023FA,S1,housing,false,2023-08-01,2023-08-02\n")
    (root / "terms" / "2024SP" / "advising_holds.CSV").write_text(head + "\nh8,2024SP,,housing,true,2023-08-01,\n")
    holds = extracts.read_extracts(spark, str(root), "advising_holds", with_source=True)
    assert holds.count() == 8
    assert {r.hold_id: r.source_term for r in holds.filter("hold_id IN ('h9', 'h8')").collect()} == {"h9": None, "h8": "2024SP"}


def test_reading_has_no_filter_per_row(spark, root):
    import contextlib
    import io

    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        extracts.read_extracts(spark, str(root), "financial_aid").select("loans").explain()
    # The first cell and the text of broken rows are read to tell whether a row is whole.
    assert "file_path" not in text.getvalue()
    assert "ReadSchema: struct<workday_person_id:string,loans:string,_broken_row:string>" in text.getvalue()


def test_unknown_table_is_inferred(spark, root):
    (root / "terms" / "2023FA" / "visits.CSV").write_text("person,day,minutes\nS1,2023-09-01,5\nS2,,\n")
    (root / "terms" / "2024SP" / "visits.csv").write_text("person,day,minutes\nS3,2024-02-01,7\n")
    df = extracts.read_extracts(spark, str(root), "visits")
    assert df.count() == 3 and dict(df.dtypes) == {"person": "string", "day": "date", "minutes": "int"}
    with pytest.raises(FileNotFoundError):
        extracts.read_extracts(spark, str(root), "nothing")


def test_csv_details(spark, tmp_path):
    file = tmp_path / "sis.csv"
    file.write_text('student_id,major,credits,gpa\nS1,"Health: Science, Society, and Policy",4,3.1\nS2,,,\nS3,"say ""hi""",NA,nan\nS4,None,1,0.5\n')
    schema = T.StructType.fromDDL("student_id STRING, major STRING, credits INT, gpa DOUBLE")
    got = {r.student_id: tuple(r)[1:] for r in extracts.read_csv(spark, str(file), schema).collect()}
    assert got["S1"] == ("Health: Science, Society, and Policy", 4, 3.1)
    assert got["S2"] == (None, None, None) and got["S4"] == (None, 1, 0.5)
    assert got["S3"][:2] == ('say "hi"', None)


def test_reordered_header_is_an_error_unless_aligned(spark, root, values):
    other = root / "terms" / "2024SU"
    other.mkdir()
    (other / "financial_aid.csv").write_text("term_code,workday_person_id,loans,note\n2024SU,WD00000007,5,extra\n")
    with pytest.raises(Exception):
        extracts.read_extracts(spark, str(root), "financial_aid").collect()
    aligned = extracts.read_drifted(spark, str(root), "financial_aid")
    assert aligned.columns == [*schemas.schema("financial_aid").names, "note"]
    row = aligned.filter("term_code = '2024SU'").first()
    assert (row.workday_person_id, row.loans, row.pell_amount, row.note) == ("WD00000007", 5, None, "extra")
    assert aligned.count() == 7
    drift = quality.schema_drift(extracts.folder_types(spark, str(root), "financial_aid"))
    found = {(r.part, r.column_name): r.status for r in drift.collect()}
    assert found["2024SU", "pell_amount"] == "missing" and found["2023FA", "note"] == "missing"
    assert found["2024SU", "note"] == "same" and found["2023FA", "loans"] == "same"


def test_schema_drift_reports_types(rows):
    drift = quality.schema_drift(rows("part string, column_name string, type string", ("a", "x", "int"), ("b", "x", "string")))
    assert {(r.part, r.status) for r in drift.collect()} == {("a", "type_varies"), ("b", "type_varies")}


def test_flatten(spark, rows, root):
    meta = extracts.read_json(spark, str(root / "metadata.json"), schemas.schema("metadata"))
    flat = extracts.flatten(meta)
    assert "systems_lms" in flat.columns and flat.first().terms == ["2023FA"] and flat.first().systems_registration == "W"
    deep = extracts.flatten(rows("a struct<b: struct<c: int>, d: int>", (((1,), 2),)), ".")
    assert deep.columns == ["a.b.c", "a.d"] and tuple(deep.first()) == (1, 2)


def test_views(spark, root):
    tables = extracts.assemble(spark, str(root), ["identity_crosswalk"])
    extracts.register(tables)
    assert spark.table("identity_crosswalk").count() == 1
    extracts.unregister(spark, *tables)
    assert not spark.catalog.tableExists("identity_crosswalk")


@pytest.fixture
def keys(rows):
    return rows("id int, key string, note string, n int", (1, "S001|CS101", "x", 1), (2, "S001", None, 2), (3, None, "y", 3), (4, "a||b", "z", 4), (5, "t|", "", 5))


def test_split_composite(spark, keys, values):
    assert composite.text_columns(keys) == ["key", "note"]
    assert tuple(composite.composite_columns(keys).first()) == (True, False)
    assert tuple(composite.widths(keys).first()) == (3, 1)
    got = composite.split_composite(keys)
    assert got.columns == ["id", "key", "note", "n", "key_1", "key_2", "key_3"]
    assert values(got, "id", "key_1", "key_2", "key_3") == [
        (1, "S001", "CS101", None), (2, "S001", None, None), (3, None, None, None), (4, "a", "", "b"), (5, "t", "", None),
    ]
    assert composite.split_composite(keys, width={"key": 2}).columns[-2:] == ["key_1", "key_2"]


def test_wide_composites_keep_every_part(spark, keys, values):
    assert composite.split_composite(keys, as_arrays=["key"]).columns[-1] == "key_parts"
    long = keys.limit(1).withColumn("key", F.array_join(F.sequence(F.lit(1), F.lit(51)), "|"))
    assert composite.split_composite(long).columns[-51:] == [f"key_{i}" for i in range(1, 52)]
    parts = values(composite.explode_composite(keys.select("id", "key"), "key"))
    assert parts == [(1, 1, "S001"), (1, 2, "CS101"), (2, 1, "S001"), (4, 1, "a"), (4, 2, ""), (4, 3, "b"), (5, 1, "t"), (5, 2, "")]


def test_split_with_other_separators(rows, values):
    df = rows("k string", ("a^b",), ("a",))
    assert values(composite.split_composite(df, "^"), "k_1", "k_2") == [("a", None), ("a", "b")]
    assert values(composite.split_composite(rows("k string", ("a::b:c",)), "::"), "k_1", "k_2") == [("a", "b:c")]


def test_split_without_rows(spark):
    assert composite.split_composite(spark.createDataFrame([], "k string")).columns == ["k"]


def test_term_folders_replace_one_term(spark, rows, tmp_path, values):
    first = rows("term_code string, v int", ("2023FA", 1), ("2023FA", 2), ("2024SP", 3))
    for fmt in ("csv", "json", "parquet"):
        path = sinks.write_extracts(first, str(tmp_path / fmt), "t", fmt)
        sinks.write_extracts(rows("term_code string, v int", ("2024SP", 9)), str(tmp_path / fmt), "t", fmt)
        schema = T.StructType.fromDDL("v INT, term_code STRING")
        back = extracts.read_table(spark, str(tmp_path / fmt), "t", fmt, schema)
        assert values(back, "term_code", "v") == [("2023FA", 1), ("2023FA", 2), ("2024SP", 9)], fmt
        assert sorted(p.name for p in (tmp_path / fmt / "t").glob("term_code=*")) == ["term_code=2023FA", "term_code=2024SP"]
        assert path.endswith("/t")


def test_json_sink_writes_nulls(spark, rows, tmp_path):
    sinks.write_table(rows("a int, b string", (1, None)), str(tmp_path / "j"), "json")
    text = "".join(p.read_text() for p in (tmp_path / "j").glob("part-*"))
    assert text == '{"a":1,"b":null}\n'


def test_csv_sink_writes_empty_cells(spark, rows, tmp_path):
    one = rows("a int, b string, c string", (1, None, 'x,"y"')).coalesce(1)
    sinks.write_table(one, str(tmp_path / "c"), "csv")
    text = "".join(p.read_text() for p in (tmp_path / "c").glob("part-*"))
    assert text == 'a,b,c\n1,,"x,""y"""\n'


def test_append_and_recreate(spark, rows, values):
    sinks.recreate(rows("a int, b string", (0, "old")), "t_append")
    sinks.recreate(rows("a int, b string", (1, "x")), "t_append")
    sinks.append_aligned(rows("b string, a bigint", ("y", 2)), "t_append")
    sinks.append_aligned(rows("a int, c double", (3, 0.5)), "t_append")
    assert values(spark.table("t_append"), "a", "b", "c") == [(1, "x", None), (2, "y", None), (3, None, 0.5)]
    with pytest.raises(ValueError):
        sinks.append_aligned(rows("a int, z int", (1, 1)), "t_append", evolve=False)
    spark.sql("DROP TABLE t_append")


def test_ensure_table_creates_an_empty_one_once(spark, rows):
    schema = schemas.schema("financial_aid")
    sinks.ensure_table(spark, "t_aid", schema)
    sinks.ensure_table(spark, "t_aid", schema)
    assert spark.table("t_aid").count() == 0 and spark.table("t_aid").columns == schema.names
    spark.sql("DROP TABLE t_aid")


def test_loading_twice_with_clear_leaves_one_copy(spark, root):
    for _ in range(2):
        sinks.load_tables(extracts.assemble(spark, str(root)), clear=True)
    assert spark.table("financial_aid").count() == 6 and spark.table("advising_holds").count() == 6
    with pytest.raises(ValueError, match="source_file"):
        sinks.load_tables(extracts.assemble(spark, str(root), ["financial_aid"]))
    for t in ("advising_holds", "financial_aid", "identity_crosswalk", "students_master"):
        spark.sql(f"DROP TABLE {t}")


def test_appending_twice_leaves_one_copy(spark, root):
    for _ in range(2):
        sinks.load_tables(extracts.assemble(spark, str(root), ["financial_aid"], with_source=True))
    assert spark.table("financial_aid").count() == 6
    late = root / "terms" / "2025SP"
    late.mkdir()
    (late / "financial_aid.csv").write_text(AID + "WD00000001,2025SP,false,,0,0,NA\n")
    sinks.load_tables(extracts.assemble(spark, str(root), ["financial_aid"], with_source=True))
    assert spark.table("financial_aid").count() == 7
    spark.sql("DROP TABLE financial_aid")


def test_recreating_from_itself_and_failing(spark, rows, values):
    sinks.recreate(rows("a int", (1,), (2,)), "t_again")
    sinks.recreate(spark.table("t_again").filter("a > 1"), "t_again")
    assert values(spark.table("t_again")) == [(2,)]
    bad = rows("a int", (1,)).select(F.raise_error(F.lit("broken")).cast("int").alias("a"))
    with pytest.raises(Exception, match="broken"):
        sinks.recreate(bad, "t_again")
    assert values(spark.table("t_again")) == [(2,)]
    assert [t.name for t in spark.catalog.listTables() if t.name.startswith("t_again")] == ["t_again"]
    spark.sql("DROP TABLE t_again")


def test_line_breaks_in_cells(spark, rows, tmp_path, values):
    two = rows("term_code string, a int, b string", ("2024SP", 1, 'x\ny, "z"'), ("2024SP", 2, "plain"))
    sinks.write_extracts(two, str(tmp_path), "t", "csv")
    schema = T.StructType.fromDDL("a INT, b STRING, term_code STRING")
    assert values(extracts.read_table(spark, str(tmp_path), "t", "csv", schema), "a", "b") == [(1, 'x\ny, "z"'), (2, "plain")]


def test_bad_numbers_are_errors_or_kept_aside(spark, tmp_path, values):
    (tmp_path / "n.csv").write_text("a,b,c\n1,x,2024-01-05\n12x,y,NA\nNA,z,soon\n")
    schema = T.StructType.fromDDL("a INT, b STRING, c DATE")
    with pytest.raises(Exception, match="a is no int: 12x|c is no date: soon"):
        extracts.read_csv(spark, str(tmp_path / "n.csv"), schema).collect()
    assert values(extracts.read_csv(spark, str(tmp_path / "n.csv"), schema, on_bad="null"), "a", "b") == [(None, "y"), (None, "z"), (1, "x")]
    aside = extracts.read_csv(spark, str(tmp_path / "n.csv"), schema, on_bad="rejected")
    assert values(aside, "b", "rejected") == [("x", []), ("y", ["a=12x"]), ("z", ["c=soon"])]


def test_projections_and_metadata(spark, rows, tmp_path):
    people = rows("student_id string, name string, k string", ("S1", "A", "m1"))
    sinks.write_projections(people, str(tmp_path), {"master": ["student_id", "name"], "cross": ["student_id", "k"]})
    assert spark.read.parquet(str(tmp_path / "cross")).columns == ["student_id", "k"]
    sinks.write_run_metadata(spark, str(tmp_path / "meta"), seed=1, terms=["2023FA"], lms_missing_rate=0.1)
    meta = sinks.read_run_metadata(spark, str(tmp_path / "meta")).first()
    assert (meta.seed, meta.terms, meta.lms_missing_rate) == (1, ["2023FA"], 0.1)


def test_incremental_load_is_exactly_once(spark, root, tmp_path, values):
    args = (spark, str(root), "financial_aid", str(tmp_path / "target"), str(tmp_path / "checkpoint"))
    assert load_incremental(*args).count() == 6
    assert load_incremental(*args).count() == 6
    late = root / "terms" / "2025SP"
    late.mkdir()
    (late / "financial_aid.CSV").write_text(AID + "WD00000001,2025SP,false,,0,0,NA\n")
    after = load_incremental(*args)
    assert after.count() == 7
    new = after.filter("source_term = '2025SP'").first()
    assert (new.term_code, new.fafsa_received, new.pell_amount) == ("2025SP", False, None)


def test_incremental_json_and_split(spark, root, tmp_path):
    holds = load_incremental(
        spark, str(root), "advising_holds", str(tmp_path / "t"), str(tmp_path / "c"), fmt="json",
        split_width={"hold_id": 2},
    )
    assert holds.count() == 6 and {"hold_id_1", "hold_id_2", "source_term"} <= set(holds.columns)


def test_incremental_load_reads_both_formats_and_levels(spark, root, tmp_path, values):
    (root / "terms" / "2023FA" / "identity_crosswalk.json").write_text(
        '[{"student_id": "S9", "moodle_user_key": "m9", "workday_person_id": "w9"}]'
    )
    batch = extracts.read_extracts(spark, str(root), "identity_crosswalk")
    loaded = load_incremental(spark, str(root), "identity_crosswalk", str(tmp_path / "t"), str(tmp_path / "c"))
    columns = ["student_id", "moodle_user_key", "workday_person_id"]
    assert values(loaded, *columns) == values(batch, *columns)
    assert {r.source_term or "" for r in loaded.collect()} == {"", "2023FA"}


# Rows of a wrong number of cells

TWO = T.StructType().add("a", T.IntegerType()).add("b", T.StringType())
BROKEN_ROWS = {3: "2,y,EXTRA", 5: "3", 6: '4,"q,1""",,5', 9: ",,,"}


def broken_file(folder, name="t.csv", n=12):
    """A file of ``n`` records, some broken, and a blank line that is no record."""
    lines = [BROKEN_ROWS.get(i, f'{i},"x,{i}"') for i in range(1, n + 1)]
    (folder / name).write_text("a,b\n" + "\n".join(lines[:4]) + "\n\n" + "\n".join(lines[4:]) + "\n")


def test_broken_rows_are_an_error_whatever_is_asked(spark, tmp_path):
    broken_file(tmp_path)
    for ask in (lambda d: d.collect(), lambda d: d.count(), lambda d: d.select("b").collect(), lambda d: d.agg(F.max("a")).collect()):
        with pytest.raises(Exception, match="too many or too few"):
            ask(extracts.read_csv(spark, str(tmp_path / "t.csv"), TWO))
        with pytest.raises(Exception, match="too many or too few"):
            ask(extracts.read_csv(spark, str(tmp_path / "t.csv")))


def test_broken_rows_keep_all_their_cells(spark, tmp_path):
    broken_file(tmp_path)
    kept = extracts.read_csv(spark, str(tmp_path / "t.csv"), TWO, on_bad="bad").collect()
    assert [r.bad for r in kept if r.bad] == [[f"row={text}"] for text in BROKEN_ROWS.values()]
    assert len(kept) == 12 and sum(r.bad == [] for r in kept) == 8
    guessed = extracts.read_csv(spark, str(tmp_path / "t.csv"), on_bad="bad").collect()
    assert [r.bad for r in guessed if r.bad] == [[f"row={text}"] for text in BROKEN_ROWS.values()]
    assert [(r.a, r.b) for r in extracts.read_csv(spark, str(tmp_path / "t.csv"), TWO, on_bad="null").collect()][2] == (2, "y")


@pytest.mark.parametrize("block", ["20", "64", "1g"])
def test_malformed_rows_have_their_place(spark, tmp_path, values, block):
    for name, n in (("t.csv", 12), ("u.csv", 400), ("v.csv", 2), ("w.csv", 0)):
        broken_file(tmp_path, name, n)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    try:
        good, bad = extracts.split_malformed(spark, str(tmp_path), TWO)
        found = values(bad.select(F.substring_index("source_file", "/", -1), "record", "n_cells", "text"))
        assert values(good)[:3] == [(1, "x,1")] * 3 and good.count() == 8 + 396 + 2 and bad.count() == 8
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    cells = {3: 3, 5: 1, 6: 4, 9: 4}
    assert found == sorted(((f, i, cells[i], t) for f in ("t.csv", "u.csv") for i, t in BROKEN_ROWS.items()), key=lambda t: tuple((True, str(v)) for v in t))


def test_malformed_rows_with_line_breaks(spark, tmp_path, values):
    (tmp_path / "t.csv").write_text('a,b\n1,"two\nlines"\n2,"more\nlines",x\n3,z\n4\n')
    good, bad = extracts.split_malformed(spark, str(tmp_path / "t.csv"), TWO, multiline=True)
    assert values(good) == [(1, "two\nlines"), (3, "z")]
    assert values(bad, "record", "n_cells", "text") == [(2, 3, '2,"more\nlines",x'), (4, 1, "4")]


def test_a_stream_refuses_broken_rows(spark, tmp_path):
    (tmp_path / "in").mkdir()
    broken_file(tmp_path / "in")
    with pytest.raises(Exception, match="too many or too few"):
        load_incremental(spark, str(tmp_path / "in"), "t", str(tmp_path / "out"), str(tmp_path / "seen"), fmt="csv", schema=TWO)


# Deliveries in parts, headers and types of folders


@pytest.mark.parametrize("fmt", ["csv", "json"])
def test_deliveries_come_in_parts(spark, rows, tmp_path, values, fmt):
    data = rows("term_code string, v int, note string", *[("2023FA", i % 7, 'say "x", ]') for i in range(50)], ("2024SP", 9, None), (None, 1, "no term"))
    data = data.withColumn("term_code", F.coalesce("term_code", F.lit("none")))
    sinks.write_delivery(data, str(tmp_path), "visits", fmt, rows_per_file=10)
    files = sorted(str(p.relative_to(tmp_path)) for p in tmp_path.rglob("visits*"))
    parts = [f for f in files if "2023FA" in f]
    assert 1 < len(parts) <= 5 and all(".part-0000" in f for f in parts)
    assert f"terms/2024SP/visits.{fmt}" in files and f"terms/none/visits.{fmt}" in files
    back = extracts.read_extracts(spark, str(tmp_path), "visits", data.schema)
    assert values(back) == values(data)
    listed = extracts.list_extracts(spark, str(tmp_path))
    assert {r.table_name for r in listed.collect()} == {"visits"} and listed.count() == len(files)
    if fmt == "json":
        assert all(isinstance(json.loads((tmp_path / f).read_text()), list) for f in files)
    sinks.write_delivery(data.drop("term_code"), str(tmp_path / "top"), "visits", fmt, by=None, rows_per_file=20)
    assert values(extracts.read_extracts(spark, str(tmp_path / "top"), "visits", data.drop("term_code").schema)) == values(data.drop("term_code"))


def test_folder_types_merge_like_values(spark, tmp_path, values):
    cells = {
        "one": ("int", ["1", "-2", "", "NA"]), "two": ("bigint", ["1", "5000000000"]), "three": ("double", ["1", "2.5", "1e3"]),
        "four": ("date", ["2024-01-31", ""]), "five": ("timestamp", ["2024-01-31", "2024-01-31 10:00:00"]), "six": ("boolean", ["true", "FALSE"]),
        "seven": ("string", ["1", "x"]), "eight": ("string", ["", ""]), "nine": ("string", ["2024-02-31", "true"]),
    }
    deep = 4
    for term, names in (("2023 FA", list(cells)), ("2024SP", list(reversed(cells)))):
        folder = tmp_path / "terms" / term
        folder.mkdir(parents=True)
        for part in range(2):
            lines = [",".join((cells[c][1] * deep)[i] for c in names) for i in range(part, deep, 2)]
            (folder / f"t.part-{part}.csv").write_text(",".join(names) + "\n" + "\n".join(lines) + "\n")
    (tmp_path / "t.json").write_text('[{"one": 1, "odd": {"k": "x"}}, {"one": 2.5, "gone": null}]')
    found = values(extracts.folder_types(spark, str(tmp_path), "t"))
    wanted = [(term, c, kind) for term in ("2023 FA", "2024SP") for c, (kind, _) in cells.items()]
    wanted += [("", "one", "double"), ("", "odd", "object<k: string>"), ("", "gone", "string")]
    assert found == sorted(wanted)
    drift = {(r.part, r.column_name): (r.type, r.status) for r in quality.schema_drift(extracts.folder_types(spark, str(tmp_path), "t")).collect()}
    assert drift["", "two"] == (None, "missing") and drift["2024SP", "one"] == ("int", "type_varies") and drift["2024SP", "six"][1] == "same"


def test_headers_are_read_in_one_scan(spark, tmp_path, values):
    (tmp_path / "terms" / "a").mkdir(parents=True)
    (tmp_path / "t.csv").write_text("x,y\n1,2\n" * 1 + "3,4\n" * 500)
    (tmp_path / "terms" / "a" / "t.CSV").write_text('"y, or z",x\n5,6\n')
    (tmp_path / "terms" / "a" / "other.csv").write_text("q\n1\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100")
    try:
        assert values(extracts.csv_headers(spark, str(tmp_path), "t"), "source_term", "header") == [("", "x,y"), ("a", '"y, or z",x')]
        whole = extracts.read_drifted(spark, str(tmp_path), "t")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert whole.count() == 502 and tuple(whole.filter("x = '6'").select("x", "y", "`y, or z`").first()) == ("6", None, "5")
