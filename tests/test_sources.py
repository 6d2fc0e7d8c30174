"""Scans, cells, column types and sinks."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from planlens.operators import inclusion, indicators, reshape
from planlens.session import materialise, new_shared_path
from planlens.sources import tables
from planlens.sources.derived import DerivedTables


def test_cells_and_types_of_a_csv_sheet(spark, tmp_path):
    sheet = tmp_path / "sheet.csv"
    sheet.write_text('id,answer,note\n1, NA ,"a, ""b"""\n2,NS,\nx, yes ,c\n')
    frame = tables.read_sheet_csv(spark, str(sheet), ["id", "answer", "note"], "ncc")
    assert dict(frame.dtypes) == {"id": "double", "answer": "string", "note": "string"}
    assert [tuple(r) for r in frame.collect()] == [(1.0, None, 'a, "b"'), (2.0, None, None), (None, "yes", "c")]


def test_sheet_headers_and_line_breaks(spark, tmp_path):
    sheet = tmp_path / "sheet.csv"
    sheet.write_text('id,answer\n1,"a\nb"\n')
    frame = tables.read_sheet_csv(spark, str(sheet), ["id", "answer"], "nc", multi_line=True)
    assert [tuple(r) for r in frame.collect()] == [(1.0, "a\nb")]
    with pytest.raises(Exception, match="(?i)header"):
        tables.read_sheet_csv(spark, str(sheet), ["answer", "id"], "cn", multi_line=True).collect()


def test_column_types(spark):
    frame = spark.createDataFrame([("1", "x", "true", "2020-01-02")], "a string, b string, c string, d string")
    typed = tables.with_column_types(frame, "i-lD")
    assert dict(typed.dtypes) == {"a": "bigint", "c": "boolean", "d": "date"}
    assert set(dict(tables.with_column_types(frame, "c").dtypes).values()) == {"string"}
    with pytest.raises(ValueError):
        tables.with_column_types(frame, "cc")


def test_column_ranges(spark):
    frame = spark.createDataFrame([("1", "2", "x")], "a string, b string, c string")
    assert tables.column_range(frame, "a", "b") == ["a", "b"]
    assert tuple(tables.numbers_in_range(frame, "b", "c").first()) == ("1", 2.0, None)
    assert tuple(tables.numbers_from_text(frame).first()) == (1.0, 2.0, None)


def test_literals(spark):
    rows = [(1, "it's\t\\x", None), (2, "b", 0.5)]
    frame = tables.literal_table(spark, ["n", "s", "v"], rows)
    assert [(r["n"], r["s"], None if r["v"] is None else float(r["v"])) for r in frame.collect()] == rows
    assert [r[0] for r in tables.id_range(spark, 1, 3).orderBy("plan_id").collect()] == [1, 2, 3]


def test_sinks(spark):
    frame = spark.createDataFrame([(1, "stat", "a"), (2, "detail", 'q"u,o')], "id int, type string, text string")
    path = new_shared_path(spark, "test")
    tables.write_table(frame, path, ["type"])
    assert spark.read.parquet(path).where(F.col("type") == "stat").count() == 1
    csv = new_shared_path(spark, "test")
    tables.write_csv(frame, csv)
    back = tables.read_sheet_csv(spark, csv, ["id", "type", "text"], "icc")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, frame.collect()))


def test_materialise_keeps_rows(spark):
    assert materialise(spark.range(5)).count() == 5


def test_every_order_is_a_search_row(spark):
    bed = DerivedTables(spark, "/root/testdata/sf0.001")
    search, orders = bed.search(), bed.table("orders")
    assert search.count() == orders.count()
    assert search.select("mpa_id").distinct().count() < search.count()
    assert {r["search"] for r in search.select("search").distinct().collect()} == {"F", "F-AI", "NI", "NS"}


def test_a_review_stored_by_plan_needs_no_shuffle_by_plan(spark):
    """One file a bucket; indicators and levels over it exchange nothing by plan, and equal those of the review stored plainly, which needs one."""
    review = DerivedTables(spark, "/root/testdata/sf0.001").review()
    stored, plain = tables.store_by_key(review, "plan_id"), materialise(review)
    files = stored.select(F.input_file_name()).distinct().count()
    assert files <= int(spark.conf.get("spark.sql.shuffle.partitions"))
    for build in (indicators.all_stat, indicators.indicators, inclusion.inclusion_levels):
        plan = build(stored)._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(plan_id" not in plan and "Bucketed: true" in plan
        assert "hashpartitioning(plan_id" in build(plain)._jdf.queryExecution().executedPlan().toString()
        assert Counter(map(tuple, build(stored).collect())) == Counter(map(tuple, build(review).collect()))
    assert Counter(map(tuple, stored.collect())) == Counter(map(tuple, review.collect()))


def test_cells_of_sheets_are_not_shuffled(spark):
    """The plans of a sheet lie together: only they, and no answers or cells, pass an exchange by key."""
    long = reshape.sheet_long(DerivedTables(spark, "/root/testdata/sf0.001").sheets(), "sheet_id")
    assert long.count() == 150 * 2 * 81
    plan = long._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    moved = [line for line in plan.split("\n") if "Exchange hashpartitioning" in line]
    assert moved and all("REPARTITION_BY_NUM" in line for line in moved)
