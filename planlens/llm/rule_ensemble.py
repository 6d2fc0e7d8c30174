"""Quality classifier: a sparse ensemble of rules over statistics of the text.

Short boosted trees are grown on labelled rows; every path to a node is a
conjunctive rule.  A lasso logistic regression gives most rules weight zero, and
what remains is compiled into one Spark column expression, so scoring runs
inside the scan of the texts.

Fitting happens on the driver on at most SAMPLE labelled ids of twelve
numbers each, drawn by a digest of the id, and on at most twice as many rows
where ids repeat; scoring covers all rows.  A text is one array of words in its
task, which a text of some million words still is.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from planlens.llm import text_stats as stats
from planlens.llm.common import remainder, rows_where, whole_text

#: Labelled rows that the fit uses at most.
SAMPLE = 20_000
TREES, DEPTH, CUTS, RATE = 40, 3, 32, 0.3
LASSO, ITERATIONS = 0.002, 600
MIN_LEAF = 5


def statistics(docs: DataFrame, *keep: str) -> tuple[DataFrame, list[str]]:
    """Columns ``keep`` and the statistics of each text, with the statistics' names; a missing text is empty."""
    rows = docs.select(*keep, whole_text(F.col("text")).alias("_text"))
    rows = rows.withColumns({"_w": stats.words(F.col("_text")), "_l": stats.lines_with_a_word(F.col("_text"))})
    n, chars = F.greatest(F.size("_w"), F.lit(1)), F.greatest(F.length("_text"), F.lit(1))
    per_char = lambda pattern: F.regexp_count("_text", F.lit(pattern)) / chars
    made = {
        "s_words": F.log1p(F.size("_w")),
        "s_word_chars": stats.word_chars(F.col("_w")) / n,
        "s_longest": F.log1p(F.coalesce(F.array_max(F.transform("_w", F.length)), F.lit(0)).cast("double")),
        "s_distinct": F.size(F.array_distinct("_w")) / n,
        "s_adjacent": F.size(F.filter("_w", lambda x, i: F.get(F.col("_w"), i - 1) == x)) / n,
        "s_repeated": stats.n_repeat_words(F.col("_w")) / n,
        "s_symbols": stats.n_symbols(F.col("_text")) / chars,
        "s_lines": F.size("_l") / n,
        "s_dup_lines": stats.n_dup_lines(F.col("_l")) / F.greatest(F.size("_l"), F.lit(1)),
        "s_digits": per_char("[0-9]"),
        "s_capitals": per_char("[A-Z]"),
        "s_stops": per_char("[.,;:!?]"),
    }
    names = list(made)
    return rows.select(*keep, *[v.cast("double").alias(k) for k, v in made.items()]), names


@dataclass(frozen=True)
class Rule:
    """A conjunction: (statistic, upper bound or not, threshold) each; below includes the threshold."""

    terms: tuple[tuple[int, bool, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), dtype=bool)
        for f, below, cut in self.terms:
            out &= (x[:, f] <= cut) if below else (x[:, f] > cut)
        return out

    def column(self, names: list[str]) -> Column:
        out = F.lit(True)
        for f, below, cut in self.terms:
            out = out & ((F.col(names[f]) <= cut) if below else (F.col(names[f]) > cut))
        return out


@dataclass(frozen=True)
class Ensemble:
    names: list[str]
    rules: list[Rule]
    weights: list[float]
    intercept: float

    def score(self) -> Column:
        """Probability of label 1 as one expression over the statistics."""
        total = F.lit(self.intercept)
        for rule, weight in zip(self.rules, self.weights, strict=True):
            total = total + F.when(rule.column(self.names), F.lit(weight)).otherwise(F.lit(0.0))
        return 1.0 / (1.0 + F.exp(-total))

    def score_rows(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for rule, weight in zip(self.rules, self.weights, strict=True):
            total += weight * rule.holds(x)
        return 1 / (1 + np.exp(-total))


def _grow(x: np.ndarray, slope: np.ndarray, curve: np.ndarray, cuts: list[np.ndarray]) -> list[tuple[tuple, np.ndarray, float]]:
    """Paths of one tree: (terms, rows, step) of all nodes below the root; step is None but at leaves."""
    found, waiting = [], [((), np.arange(len(x)))]
    while waiting:
        terms, rows = waiting.pop()
        best = None
        if len(terms) < DEPTH and len(rows) >= 2 * MIN_LEAF:
            g, h = slope[rows].sum(), curve[rows].sum()
            for f, edges in enumerate(cuts):
                if not len(edges):
                    continue
                place = np.searchsorted(edges, x[rows, f], side="left")  # edge >= value: below the cut
                size = np.cumsum(np.bincount(place, minlength=len(edges) + 1))[:-1]
                gl = np.cumsum(np.bincount(place, slope[rows], len(edges) + 1))[:-1]
                hl = np.cumsum(np.bincount(place, curve[rows], len(edges) + 1))[:-1]
                gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
                gain[(size < MIN_LEAF) | (len(rows) - size < MIN_LEAF)] = -np.inf
                k = int(np.argmax(gain))
                if gain[k] > 1e-6 and (best is None or gain[k] > best[0]):
                    best = gain[k], f, float(edges[k])
        step = None if best else float(-slope[rows].sum() / (curve[rows].sum() + 1))
        if terms:
            found.append((terms, rows, step))
        if best:
            _, f, cut = best
            low = x[rows, f] <= cut
            waiting += [((*terms, (f, True, cut)), rows[low]), ((*terms, (f, False, cut)), rows[~low])]
    return found


def _simplest(terms: tuple) -> tuple:
    """The tightest bound of each statistic and side."""
    tight: dict[tuple[int, bool], float] = {}
    for f, below, cut in terms:
        old = tight.get((f, below), cut)
        tight[f, below] = min(old, cut) if below else max(old, cut)
    return tuple(sorted((f, below, cut) for (f, below), cut in tight.items()))


def fit(x: np.ndarray, y: np.ndarray, names: list[str], lasso: float = LASSO) -> Ensemble:
    """Rules from boosted trees, weights by proximal gradient steps; one class alone gives a constant."""
    base = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    if not 0 < y.sum() < len(y):
        return Ensemble(names, [], [], base)
    cuts = []
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        middles = (values[1:] + values[:-1]) / 2
        cuts.append(np.unique(np.quantile(middles, np.linspace(0, 1, CUTS), method="nearest")) if len(middles) else middles)
    margin, rules = np.full(len(y), base), {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        paths = _grow(x, p - y, p * (1 - p), cuts)
        if not paths:
            break
        for terms, rows, step in paths:
            rules[_simplest(terms)] = None
            if step is not None:
                margin[rows] += RATE * step
    kept = [Rule(t) for t in rules]
    a = np.stack([r.holds(x) for r in kept], axis=1).astype(float)
    weights, bias = _lasso(a, y, base, lasso)
    chosen = np.flatnonzero(np.abs(weights) > 1e-6)
    return Ensemble(names, [kept[i] for i in chosen], [float(weights[i]) for i in chosen], bias)


def _lasso(a: np.ndarray, y: np.ndarray, bias: float, lasso: float) -> tuple[np.ndarray, float]:
    """Accelerated proximal gradient for mean log loss plus ``lasso`` times the sum of absolute weights."""
    n, k = a.shape
    full = np.concatenate([a, np.ones((n, 1))], axis=1)
    w = np.zeros(k + 1)
    w[-1] = bias
    v, t = w.copy(), 1.0
    rate = 4 * n / max(np.linalg.norm(full, 2) ** 2, 1e-9)
    for _ in range(ITERATIONS):
        gradient = full.T @ (1 / (1 + np.exp(-(full @ v))) - y) / n
        new = v - rate * gradient
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - rate * lasso, 0)
        t, before = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        v = new + (before - 1) / t * (new - w)
        w = new
    return w[:-1], float(w[-1])


def fit_labelled(docs: DataFrame, labels: DataFrame, modulus: int, held_out: int, sample: int = SAMPLE) -> Ensemble:
    """Fit on ``docs`` with a label (doc_id, quality) whose crc32(doc_id) modulo ``modulus`` is not ``held_out``.

    Of the labels, those with the smallest digests of the id are drawn, at most
    ``sample``, and only these documents' statistics are computed.  Missing
    labels and ids teach nothing; of several labels for an id the largest counts.
    """
    digest = F.pmod(F.xxhash64("_id"), F.lit(1 << 30))
    known = labels.select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("_y")).where(
        "_id is not null and _y is not null"
    )
    known = known.where(remainder(F.col("_id"), modulus) != held_out).groupBy("_id").agg(F.max("_y").alias("_y"))
    share = min(1.0, 1.1 * sample / max(1, known.count()))
    drawn = known.where(digest < int(share * (1 << 30))).orderBy(digest, "_id").limit(sample)
    taught = docs.join(F.broadcast(drawn), docs.doc_id == drawn._id)  # ``sample`` rows at most
    rows, names = statistics(taught.select("_id", "_y", "text"), "_id", "_y")
    order = ["_id", *names]
    chosen = rows.orderBy(*order).limit(2 * sample).toPandas()  # more only where ids repeat
    return fit(chosen[names].to_numpy(dtype=float), chosen["_y"].to_numpy(dtype=float), names)


def classify(docs: DataFrame, labels: DataFrame, modulus: int, held_out: int) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs`` (doc_id, text; other columns are ignored).

    Labels count only where crc32(doc_id) modulo ``modulus`` is not
    ``held_out``.  Empty and missing texts are scored by statistics of zero;
    repeated rows are scored alike; an empty table gives an empty one; without
    usable labels all scores are the same.
    """
    model = fit_labelled(docs.select("doc_id", "text"), labels, modulus, held_out)
    rows, _ = statistics(docs, "doc_id")
    scored = rows.select(
        "doc_id", (remainder(F.col("doc_id"), modulus) == held_out).alias("held_out"), model.score().alias("score")
    )
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def good_documents(docs: DataFrame, labels: DataFrame, modulus: int, held_out: int) -> DataFrame:
    """The rows of ``docs``, all columns, with a score of at least one half.

    Missing texts are scored as empty ones, repeated rows alike; without any
    label to learn from all rows have the score one half and stay.
    """
    model = fit_labelled(docs.select("doc_id", "text"), labels, modulus, held_out)
    rows, _ = statistics(docs.select(F.struct("*").alias("_row"), "text"), "_row")
    return rows_where(rows, model.score() >= 0.5, docs.columns)
