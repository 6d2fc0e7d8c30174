"""Importance resampling of documents toward a target distribution of hashed n-gram features.

Separator newlines cut texts into lines, and many lines occur in many texts, so
the words and buckets of each distinct line are made once and its counts
multiplied by its occurrences.  Runs of words that cross line ends depend on
the document and are added separately.  A document's weight is the sum of the
gains of its features: the weights of its lines, found by digest, and of its
crossing runs.

The highest noisy scores are a sample without replacement by weight.  Everything
is DataFrame operations; the driver gets one number for each bucket and one row
of totals.
"""

from __future__ import annotations

from functools import reduce
from math import floor, log

from pyspark.sql import Column, DataFrame, functions as F

from planlens.llm.common import store, whole_text
from planlens.operators.ranking import numbered

#: A word of a text whose A-Z are lower-cased already.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BUCKETS = 10_000
SEED = 2024
#: Documents with fewer words are never drawn; of the others so many in a hundred are.
LEAST_WORDS, PERCENT = 20, 10
_KEY = ["_doc", "_t1", "_t2"]


def _lines(rows: DataFrame, *keep: str | Column) -> DataFrame:
    """One row for each line of ``_text`` with its number; an empty text is one empty line.  ``\\n`` is no part of a word."""
    return rows.select(*keep, F.posexplode(F.split("_text", "\n", -1)).alias("_at", "_line"))


def _digest(line: Column) -> list[Column]:
    """128 bits that stand for a line."""
    return [F.xxhash64(line).alias("_h1"), F.xxhash64(F.lit(SEED), line).alias("_h2")]


def _words(line: Column) -> Column:
    return F.regexp_extract_all(line, F.lit(WORD), F.lit(0))


def _bucket(feature: Column) -> Column:
    return (F.crc32(feature.cast("binary")) % BUCKETS).cast("int")


def _windows(items: str, k: int) -> Column:
    """All runs of ``k`` consecutive items of an array column."""
    starts = F.when(F.size(items) >= k, F.sequence(F.lit(1), F.size(items) - (k - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.slice(items, i, F.lit(k)))


def _runs(words: str, n: int) -> Column:
    """Buckets of all runs of 1 to ``n`` consecutive words of an array column."""
    longer = [F.transform(_windows(words, k), lambda run: _bucket(F.array_join(run, " "))) for k in range(2, n + 1)]
    return F.concat(F.transform(words, _bucket), *longer)


def crossing(rows: DataFrame, n: int, *keep: str) -> DataFrame:
    """``_buckets`` of the runs of 2 to ``n`` words that begin in one line of ``_text`` and end in a later one.

    Such a run uses at most the first and the last n - 1 words of a line; what
    lies between them is one gap that no run may hold.
    """
    reach = n - 1

    def ends(line: Column, number: Column) -> Column:
        whole = F.transform(_words(line), lambda w: F.struct(w.alias("w"), number.alias("line")))
        gap = F.array(F.struct(F.lit(None).cast("string").alias("w"), number.alias("line")))
        cut = lambda x: F.concat(F.slice(x, 1, reach), gap, F.slice(x, -reach, reach))
        return F.get(F.transform(F.array(whole), lambda x: F.when(F.size(x) > 2 * reach, cut(x)).otherwise(x)), F.lit(0))

    seams = rows.select(*keep, F.flatten(F.transform(F.split("_text", "\n", -1), ends)).alias("_s"))
    found = []
    for k in range(2, n + 1):
        ends_later = lambda run, k=k: F.get(run, F.lit(0))["line"] != F.get(run, F.lit(k - 1))["line"]
        runs = F.filter(_windows("_s", k), lambda run: ends_later(run) & ~F.exists(run, lambda x: x["w"].isNull()))
        found.append(F.transform(runs, lambda run: _bucket(F.array_join(run["w"], " "))))
    return seams.select(*keep, F.concat(*found).alias("_buckets"))


def _texts(table: DataFrame, *keep: Column) -> DataFrame:
    return table.select(*keep, F.translate(whole_text(F.col("text")), UPPER, LOWER).alias("_text"))


def distinct_lines(texts: DataFrame, n: int) -> DataFrame:
    """(_h1, _h2, _times, _words, _buckets) of each distinct line of ``_text``: its occurrences, words and features."""
    counted = _lines(texts).groupBy("_line").agg(F.count(F.lit(1)).alias("_times"))
    split = counted.select(*_digest(F.col("_line")), "_times", _words(F.col("_line")).alias("_w"))
    return split.select("_h1", "_h2", "_times", F.size("_w").alias("_words"), _runs("_w", n).alias("_buckets"))


def _bucket_totals(*counted: DataFrame) -> dict[int, int]:
    """Occurrences of features by bucket; each table has _buckets and _times."""
    rows = reduce(DataFrame.unionByName, [t.select("_times", F.explode("_buckets").alias("_b")) for t in counted])
    return {r._b: r.n for r in rows.groupBy("_b").agg(F.sum("_times").alias("n")).collect()}  # BUCKETS rows at most


def gains(source: dict[int, int], target: dict[int, int]) -> list[int]:
    """floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))) of each bucket, in doubles."""
    s_all, t_all = float(sum(source.values()) + BUCKETS), float(sum(target.values()) + BUCKETS)
    ratio = lambda b: (target.get(b, 0) + 1.0) * s_all / ((source.get(b, 0) + 1.0) * t_all)
    return [floor(1000 * log(ratio(b))) for b in range(BUCKETS)]


def weigh(docs: DataFrame, target: DataFrame, n: int = 1) -> DataFrame:
    """doc_id, n_words, n_features, weight for every row of ``docs``, against the texts of ``target``.

    A missing text is empty; a text without words has weight 0; very long texts
    are cut at their line ends as any other.  Rows that repeat a doc_id are told
    apart by their text, and equal rows each come back.  Other columns are
    ignored.  Without documents the result is empty, without target texts all
    of its counts are 0.
    """
    text = whole_text(F.col("text"))
    key = [F.col("doc_id").alias("_doc"), F.xxhash64(text).alias("_t1"), F.xxhash64(F.lit(SEED), text).alias("_t2")]
    texts, wanted = _texts(docs, *key), _texts(target)
    lines = store(distinct_lines(texts, n), "lines")
    once = F.lit(1).cast("long").alias("_times")
    crossed = store(crossing(texts, n, *_KEY), "crossing") if n > 1 else None
    source = _bucket_totals(lines, *([crossed.select("_buckets", once)] if n > 1 else []))
    aims = [distinct_lines(wanted, n)] + ([crossing(wanted, n).select("_buckets", once)] if n > 1 else [])
    by_bucket = F.split(F.lit(",".join(map(str, gains(source, _bucket_totals(*aims))))), ",").cast("array<bigint>")

    def total(buckets: str) -> Column:
        return F.aggregate(buckets, F.lit(0).cast("long"), lambda sum_, b: sum_ + F.get(by_bucket, b))

    of_line = lines.select("_h1", "_h2", "_words", F.size("_buckets").alias("_n"), total("_buckets").alias("_weight"))
    places = _lines(texts, *_KEY).select(*_KEY, "_at", *_digest(F.col("_line")))
    parts = places.join(of_line, ["_h1", "_h2"]).select(*_KEY, "_at", "_words", "_n", "_weight")
    if n > 1:
        extra = crossed.select(*_KEY, F.lit(-1).alias("_at"), F.lit(0).alias("_words"), F.size("_buckets").alias("_n"), total("_buckets").alias("_weight"))
        parts = parts.unionByName(extra)
    sums = parts.groupBy(*_KEY).agg(
        F.count_if(F.col("_at") == 0).alias("_rows"), *[F.sum(c).alias(c) for c in ("_words", "_n", "_weight")]
    )
    each = lambda c: F.expr(f"{c} div _rows").cast("long")  # noqa: E731  equal rows have equal sums
    one_each = sums.select("*", F.explode(F.sequence(F.lit(1), F.col("_rows").cast("int"))))
    return one_each.select(
        F.col("_doc").alias("doc_id"), each("_words").alias("n_words"), each("_n").alias("n_features"), each("_weight").alias("weight")
    )


def _noise(doc_id: Column) -> Column:
    """A Gumbel number, in thousandths, from a digest of the id; a missing id counts as the empty text."""
    digest = F.sha2(F.concat(F.lit(f"{SEED}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, n: int = 1, percent: int = PERCENT, least: int = LEAST_WORDS) -> DataFrame:
    """``weigh`` with score and rank: ``percent`` in a hundred documents of ``least`` words or more have a rank, from 1.

    The highest scores are drawn, of equal scores the smaller ids, missing ids
    last.  Positions come from ranges of the whole order, not from one sorted task.
    """
    scored = store(weigh(docs, target, n).withColumn("score", F.col("weight") + _noise(F.col("doc_id"))), "scored")
    able = scored.where(F.col("n_words") >= least)
    drawn = able.count() * percent // 100
    placed = numbered(able, [F.col("score").desc(), F.col("doc_id").asc_nulls_last()], "_place")
    rank = F.when(F.col("_place") <= drawn, F.col("_place")).alias("rank")
    below = scored.where(F.col("n_words") < least).select("*", F.lit(None).cast("long").alias("rank"))
    return placed.select(*scored.columns, rank).unionByName(below)
