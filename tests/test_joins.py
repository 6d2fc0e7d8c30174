"""Joins against brute force, with hot and missing keys."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from planlens.operators import joins


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def counted(frame):
    return Counter(tuple(r) for r in frame.collect())


@pytest.fixture(scope="module")
def sides(spark):
    draw = random.Random(7)
    left = [(draw.choice([None, 1, 1, 1, 2, 3, 9]), i) for i in range(400)]
    right = [(k, f"r{k}") for k in (None, 1, 2, 4)]
    return left, right, table(spark, left, "k int, a int"), table(spark, right, "k int, b string")


def test_left_join(sides):
    left, right, left_df, right_df = sides
    match = dict(right)
    want = Counter((k, a, match.get(k)) for k, a in left)
    assert counted(joins.left_join(left_df, right_df, "k").select("k", "a", "b")) == want


def test_left_join_with_several_matches(sides):
    left, right, left_df, right_df = sides
    doubled = right_df.unionByName(right_df)
    got = counted(joins.left_join(left_df, doubled, "k").select("k", "a", "b"))
    match = dict(right)
    assert got == Counter({(k, a, match.get(k)): 2 if k in match else 1 for k, a in left})


def test_semi_and_anti_join(sides):
    left, right, left_df, right_df = sides
    ids = {k for k, _ in right}
    assert counted(joins.semi_join(left_df, right_df, "k")) == Counter(r for r in left if r[0] in ids)
    assert counted(joins.anti_join(left_df, right_df, "k")) == Counter(r for r in left if r[0] not in ids)


def test_missing_keys_without_missing_ids(sides):
    left, _, left_df, right_df = sides
    known = right_df.where("k IS NOT NULL")
    assert counted(joins.anti_join(left_df, known, "k")) == Counter(r for r in left if r[0] not in (1, 2, 4))
    assert counted(joins.semi_join(left_df, known, "k")) == Counter(r for r in left if r[0] in (1, 2))


@pytest.mark.parametrize("with_null", [True, False])
def test_lookup_join(sides, with_null):
    left, right, many, unique = sides
    if not with_null:
        right, unique = [r for r in right if r[0] is not None], unique.where("k IS NOT NULL")
    found = joins.lookup_join(unique, many, "k").select("k", "b", "a")
    want = Counter((k, b, a) for k, b in right for key, a in left if key == k)
    want.update((k, b, None) for k, b in right if not any(key == k for key, _ in left))
    assert counted(found) == want


def test_lookup_join_without_the_missing_key(sides):
    left, right, many, unique = sides
    found = joins.lookup_join(unique, many.where("k IS NOT NULL"), "k").select("k", "b", "a")
    want = Counter((k, b, a) for k, b in right for key, a in left if key == k and k is not None)
    want.update([(None, "rNone", None), (4, "r4", None)])
    assert counted(found) == want


def test_mark_member(sides):
    left, right, left_df, right_df = sides
    ids = {k for k, _ in right}
    marked = joins.mark_member(left_df, right_df, "k", "known").select("k", "a", "known")
    assert counted(marked) == Counter((k, a, k in ids) for k, a in left)


def test_full_join(spark):
    left = table(spark, [(1, "a"), (None, "n"), (2, "b")], "k int, x string")
    right = table(spark, [(1, "A"), (None, "N"), (3, "C")], "k int, y string")
    got = counted(joins.full_join(left, right, "k").select("k", "x", "y"))
    assert got == Counter([(1, "a", "A"), (None, "n", "N"), (2, "b", None), (3, None, "C")])


def test_hot_side_is_split(spark):
    """Half of the rows on one key, a quarter without: the final plans of all joins split it, the results are whole."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.shuffle.partitions": "16",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    many = spark.range(400_000).selectExpr(
        "CASE WHEN id % 2 = 0 THEN 7 WHEN id % 4 = 1 THEN NULL ELSE id % 1000 END AS k", "id AS a"
    )
    few = spark.range(2000).selectExpr("nullif(id, 3) AS k", "id AS b")
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        results = {
            "left": (joins.left_join(many, few, "k"), 400_000),
            "semi": (joins.semi_join(many, few, "k"), 400_000 - many.where("k = 3").count()),
            "inner": (joins.inner_join(few, many, "k"), 400_000 - many.where("k = 3").count()),
        }
        for name, (frame, rows) in results.items():
            n = len(frame.collect())
            plan = frame._jdf.queryExecution().executedPlan().toString()
            assert "skew=true" in plan, name
            assert n == rows
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_members_are_not_sorted(spark):
    """Half of the rows on one key: the join with different ids holds the ids, not the rows, in memory."""
    many = spark.range(20_000).selectExpr("nullif(id % 2 * id, 0) AS k", "id AS a")
    few = spark.range(3000).selectExpr("nullif(id, 3) AS k")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        frames = [joins.semi_join(many, few, "k"), joins.anti_join(many, few, "k"), joins.mark_member(many, few, "k", "m").where("m")]
        assert [f.count() for f in frames] == [11_499, 8501, 11_499]
        for frame in frames:
            plan = frame._jdf.queryExecution().executedPlan().toString()
            assert "Sort" not in plan and "ShuffledHashJoin" in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_lookup_join_spreads_hot_keys(spark):
    """Half of the rows on one key, a quarter without: no task joins twice the mean, whichever side is unique; one plan reads each side."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.shuffle.partitions": "16",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    many = spark.range(400_000).selectExpr(
        "CASE WHEN id % 2 = 0 THEN 7 WHEN id % 4 = 1 THEN NULL ELSE id % 1000 END AS k", "id AS a"
    )
    few = spark.range(2000).selectExpr("nullif(id, 3) AS k", "id AS b")
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        found = joins.lookup_join(few, many, "k")
        tasks = found.groupBy(F.spark_partition_id()).agg(F.count("a").alias("n")).collect()
        lone = joins.anti_join(few, many.select("k"), "k").count()
        known = 400_000 - many.where("k = 3").count()
        assert found.count() == known + lone and sum(r["n"] for r in tasks) == known
        assert len(tasks) == 16 and max(r["n"] for r in tasks) < 2 * known / 16
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_lookup_join_with_equal_rows_and_many_columns(spark):
    """Repeated right rows, columns with awkward names, a key without rows on either side."""
    left = table(spark, [(1, "x"), (2, "y"), (None, "z")], "k int, `l.c` string")
    right = table(spark, [(1, 5.0, "p"), (1, 5.0, "p"), (1, None, None), (9, 1.0, "q")], "k int, `r.c` double, e string")
    got = counted(joins.lookup_join(left, right, "k"))
    want = [(1, "x", 5.0, "p"), (1, "x", 5.0, "p"), (1, "x", None, None), (2, "y", None, None), (None, "z", None, None)]
    assert got == Counter(want)
