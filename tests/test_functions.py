"""NULL policies, text edits and ordered categories on small literals."""

import math

import pytest
from pyspark.sql import functions as F

from planlens.functions import levels, nulls, text
from planlens.operators.condensed import strict_sum_where
from planlens.operators.geometry import size_class

X = None


@pytest.fixture(autouse=True, scope="module")
def column(spark):
    """Columns need a running session, so the column under test is made here."""
    global X
    X = F.col("x")


def test_flag_keeps_unknown(values):
    assert values("double", [1.0, 0.0, None], nulls.flag(X == 1)) == [1, 0, None]


def test_membership_is_two_valued(values):
    data = ["1", "0", None]
    assert values("string", data, nulls.in_set(X, ["1"], with_null=True)) == [True, False, True]
    assert values("string", data, nulls.in_set(X, ["1"])) == [True, False, False]
    assert values("string", data, nulls.not_in_set(X, ["1"])) == [False, True, True]
    assert values("string", data, nulls.not_in_set(X, ["1"], with_null=True)) == [False, True, False]


def test_row_any_and_all_are_kleene(spark):
    data = [(1.0, None), (0.0, None), (0.0, 0.0), (1.0, 1.0), (0.5, 0.0)]
    frame = spark.createDataFrame(data, "a double, b double")
    rows = frame.select(
        nulls.flag(nulls.any_nonzero(["a", "b"])),
        nulls.flag(nulls.all_nonzero(["a", "b"])),
        nulls.flag(nulls.any_equal(["a", "b"], 1)),
        nulls.row_total(["a", "b"]),
    ).collect()
    assert [tuple(r) for r in rows] == [
        (1, None, 1, None),
        (None, 0, None, None),
        (0, 0, 0, 0.0),
        (1, 1, 1, 2.0),
        (1, 0, 0, 0.5),
    ]


@pytest.mark.parametrize(
    ("data", "strict", "lenient"), [([1.0, None], None, 1.0), ([None, None], None, 0.0), ([1.0, 2.0], 3.0, 3.0)]
)
def test_sums(spark, data, strict, lenient):
    frame = spark.createDataFrame([(v,) for v in data], "x double")
    row = frame.agg(nulls.strict_sum(X), nulls.lenient_sum(X)).first()
    assert tuple(row) == (strict, lenient)


def test_strict_sum_of_a_part(spark):
    frame = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", None)], "k string, x double")
    parts = [strict_sum_where(X, F.col("k") == k) for k in "abc"]
    assert tuple(frame.agg(*parts).first()) == (3.0, None, None)


def test_distinct_counts(spark):
    frame = spark.createDataFrame([(1,), (None,), (2,)], "x int")
    assert tuple(frame.agg(nulls.n_distinct(X, na_rm=False), nulls.n_distinct(X)).first()) == (3, 2)


def test_numbers_rounding_and_ratios(values):
    assert values("string", ["1", "0.5", "Planned", None], nulls.to_number(X)) == [1.0, 0.5, None, None]
    assert values("double", [2.5, 3.5], F.bround(X, 0)) == [2.0, 4.0]
    assert values("double", [1.0], F.bround(F.lit(0.125), 2)) == [0.12]
    assert values("double", [0.0, 4.0], nulls.ratio(F.lit(1), X)) == [None, 0.25]
    assert values("int", [86], nulls.percent(X, F.lit(172))) == [50.0]
    assert values("double", [None, 2.0, 5.0], nulls.cap(X, 3.0)) == [None, 2.0, 3.0]


def test_conditional_update_leaves_unknown(values):
    assert values("string", ["F-AI", "F", None], nulls.replace_where(X, X == "F-AI", "F")) == ["F", "F", None]


def test_first_match_treats_unknown_as_false(values):
    match = nulls.first_match([(X > 1, "big"), (X.isNull(), "none")], default="small")
    assert values("int", [2, 1, None], match) == ["big", "small", "none"]


def test_first_occurrence_only(values):
    data = ["Marine Reserve and Marine Reserve", "a.c abc", None]
    assert values("string", data, text.replace_first(X, "Marine Reserve", "MR")) == [
        "MR and Marine Reserve",
        "a.c abc",
        None,
    ]
    assert values("string", ["abc a.c a.c"], text.replace_first(X, "a.c", "$1")) == ["abc $1 a.c"]


def test_text_edits(values):
    assert values("string", ["ENGLISH and french", "", None], text.sentence_case(X)) == ["English and french", "", None]
    assert values("string", ["\ta \n"], text.trim_space(X)) == ["a"]
    assert values("string", ["a - b-c"], text.remove_all(X, "-")) == ["a  bc"]
    assert values("string", ["A (x) B  (y z)"], text.drop_parenthetical(X)) == ["A B"]


def test_split_drops_surplus_and_fills_missing(values):
    parts = text.split_parts(X, "_", ["p", "q", "r"])
    assert values("string", ["a_b", "a_b_c_d"], *parts) == [("a", "b", None), ("a", "b", "c")]


def test_clean_names():
    names = ["Plan ID", "Document Type", "timeListed", "Area #", "% done", "Plan-ID", "2nd"]
    assert text.clean_names(names) == [
        "plan_id",
        "document_type",
        "time_listed",
        "area_number",
        "percent_done",
        "plan_id_2",
        "x2nd",
    ]


def test_levels(values):
    order = ["low", "high"]
    assert values("string", ["high", "other", None], levels.only_levels(X, order), levels.level_rank(X, order)) == [
        ("high", 2),
        (None, None),
        (None, None),
    ]
    labels = {"b": "Bee", "a": "Ay"}
    assert values("string", ["a", "b", "c", None], levels.recode(X, labels), levels.recode_rank(X, labels)) == [
        ("Ay", 2),
        ("Bee", 1),
        ("c", 3),
        (None, None),
    ]


def test_size_class_limits(values):
    data = [9.99, 10.0, 99.9, 100.0, 100000.0, 100000.1, None]
    assert values("double", data, size_class(X)) == [
        "Very Small",
        "Small",
        "Small",
        "Large",
        "Large",
        "Very Large",
        None,
    ]


def test_sample_deviation_of_one_value(spark):
    assert spark.range(1).agg(F.stddev_samp("id")).first()[0] is None
    assert not math.isnan(spark.range(2).agg(F.stddev_samp("id")).first()[0])
