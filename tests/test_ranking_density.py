"""Global ranks, quantiles and densities against direct computations."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from planlens.operators.density import bandwidths, kernel_density, quantiles
from planlens.operators.ranking import in_ranges, numbered


def test_numbered(spark):
    """Missing keys, ties, repeated rows and descending keys: every position once, in the right order."""
    draw = random.Random(3)
    rows = [(draw.choice([None, 0, 0, 1]), draw.randint(0, 2), i // 2, f"n{draw.random():.2f}") for i in range(600)]
    frame = spark.createDataFrame(rows, "a int, b int, id long, name string")
    got = sorted(numbered(frame, ["a", F.col("b").desc(), "id"], "pos").collect(), key=lambda r: r["pos"])
    assert [r["pos"] for r in got] == list(range(1, 601))
    assert Counter(tuple(r)[:4] for r in got) == Counter(rows)
    keys = [(r["a"] is None, r["a"] or 0, -r["b"], r["id"]) for r in got]
    assert keys == sorted(keys)


def test_numbered_without_rows(spark):
    assert numbered(spark.createDataFrame([], "a int, `b.c` string"), ["a"], "pos").collect() == []


def test_numbered_deals_out_labels_that_begin_alike(spark):
    """A million labels with 30 equal first characters, a third of the rows with one value: no range is twice the median."""
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spark.range(1_000_000).selectExpr(
            "CASE WHEN id % 3 = 0 THEN 1.0D ELSE pmod(xxhash64(id), 1000) / 7D END AS mean",
            "concat(repeat('a', 30), lpad(id, 7, '0')) AS label",
        )
        for order in (["label"], ["mean", "label"], ["mean"]):
            sizes = sorted(r["n"] for r in in_ranges(rows, order).groupBy("_range").agg(F.count("*").alias("n")).collect())
            assert len(sizes) == 8 and sizes[-1] <= 2 * sizes[4]
        top = numbered(rows, ["mean", "label"], "pos").where("pos % 100000 = 0").orderBy("pos").collect()
        want = rows.toPandas().sort_values(["mean", "label"]).iloc[99_999::100_000]
        assert [(r["mean"], r["label"]) for r in top] == list(want.itertuples(index=False, name=None))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


@pytest.fixture(scope="module")
def latitudes(spark):
    draw = np.random.default_rng(5)
    groups = {
        "wide": draw.uniform(-89, 89, 701),
        "narrow": draw.normal(12, 1e-4, 302),
        "ties": np.repeat([-40.0, 10.0, 10.25], [500, 3, 90]),
        "two": np.array([1.0, 2.0]),
    }
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs]
    return groups, spark.createDataFrame(rows, "g string, y double")


def test_quantiles_are_exact(latitudes):
    groups, frame = latitudes
    probabilities = (0.0, 0.25, 0.5, 0.75, 1.0)
    rows = {r["g"]: r for r in quantiles(frame, "g", "y", -89.0, 89.0, probabilities).collect()}
    for name, values in groups.items():
        assert rows[name]["n"] == len(values)
        assert rows[name]["quantiles"] == pytest.approx(np.quantile(values, probabilities), abs=1e-11)


def test_bandwidth_rule(latitudes):
    groups, frame = latitudes
    rows = {r["g"]: r["bw"] for r in bandwidths(frame, "g", "y", -89.0, 89.0).collect()}
    for name, values in groups.items():
        sd, (q1, q3) = values.std(ddof=1), np.quantile(values, (0.25, 0.75))
        scale = min(sd, (q3 - q1) / 1.34) or sd
        assert rows[name] == pytest.approx(0.9 * scale * len(values) ** -0.2, rel=1e-9)


def test_density_is_close_to_the_direct_sum(latitudes):
    groups, frame = latitudes
    density = kernel_density(frame.where("g = 'wide' OR g = 'ties'"), "g", "y", -89.0, 89.0).collect()
    widths = {r["g"]: r["bw"] for r in bandwidths(frame, "g", "y", -89.0, 89.0).collect()}
    for name in ("wide", "ties"):
        curve = sorted((r["point"], r["y"], r["density"]) for r in density if r["g"] == name)
        assert [p for p, _, _ in curve] == list(range(512))
        h, values = widths[name], groups[name]
        direct = [np.exp(-(((y - values) / h) ** 2) / 2).sum() / (len(values) * h * math.sqrt(2 * math.pi)) for _, y, _ in curve]
        assert np.allclose([d for _, _, d in curve], direct, atol=0.01 * max(direct))
    total = sum(d for _, _, d in curve) * 178 / 511
    assert total == pytest.approx(1.0, abs=0.01)


def test_single_values_have_no_density(spark):
    frame = spark.createDataFrame([("one", 3.0), ("out", 95.0)], "g string, y double")
    assert kernel_density(frame, "g", "y", -89.0, 89.0).count() == 0
