"""Robust outliers: what must be rejected, and from which share of outliers on."""

import math
from collections import defaultdict

import numpy as np
import pytest

from planlens.llm import robust_outliers


def unlike(rng, n):
    """n words that hardly occur twice, four to six letters each."""
    return ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(4, 7))) for _ in range(n)]


def lines(words, size=12):
    return "\n".join(" ".join(words[i : i + size]) for i in range(0, len(words), size))


def test_each_statistic_alone_rejects(spark):
    """Texts that pass the base rules and are far out in one statistic only."""
    rng = np.random.default_rng(7)
    far = {
        "x0": lines([w * 4 for w in unlike(rng, 240)]),
        "x1": lines([w + "#" for w in unlike(rng, 240)]),
        "x2": "\n".join(f"{lines(unlike(rng, 12))}\nok go" for _ in range(25)),
        "x3": lines((part := unlike(rng, 58)) + unlike(rng, 70) + part + unlike(rng, 70)),
    }
    clean = [lines(unlike(rng, 240)) for _ in range(150)]
    rows = [(i, t, "en", "s") for i, t in enumerate([*clean, *far.values()])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    found = {r.doc_id: r for r in robust_outliers.verdicts(docs).collect()}
    assert not any(r.base_failed for r in found.values())
    assert {x: found[150 + i].kept for i, x in enumerate(far)} == dict.fromkeys(far, False)
    assert sum(found[i].kept for i in range(150)) >= 149


NAMES = "doc_id long, lang string, source string, base_failed boolean, x0 double, x1 double, x2 double, x3 double"


def frame_of(spark, *parts):
    """Rows of statistics; each part is (values, source), numbered on."""
    rows = [(source, x) for values, source in parts for x in values]
    return spark.createDataFrame([(i, "en", s, False, *map(float, x)) for i, (s, x) in enumerate(rows)], NAMES)


def test_a_third_of_copies_is_rejected(spark):
    """A third of a group is one text, far out: in all statistics, or in one with the others as usual."""
    rng = np.random.default_rng(8)
    clean = np.abs(rng.normal([1.6, 0.05, 0.05, 0.1], [0.05, 0.03, 0.03, 0.05], (1200, 4)))
    for place in ([4.0, 0.9, 0.9, 0.7], [1.6, 0.6, 0.05, 0.1], [1.6, 0.05, 0.95, 0.1]):
        frame = frame_of(spark, (clean, "s"), ([place] * 600, "s"))
        kept = {r.doc_id: r.kept for r in robust_outliers.judged(frame, robust_outliers.estimates(frame)).collect()}
        assert not any(kept[i] for i in range(1200, 1800))
        assert sum(kept[i] for i in range(1200)) >= 1190


def inside(q):
    return 1 - math.exp(-q / 2) * (1 + q / 2)


class PlainEstimate:
    """Centre and scatter of one group's rows (an array of four columns), by the same bins and steps."""

    floors = np.square(robust_outliers.FLOORS)

    def __init__(self, x):
        self.x, self.n = x, len(x)
        self.half = min(self.n, (self.n + 5) // 2)
        share, low, high = self.half / self.n, 0.0, 100.0
        for _ in range(90):
            q = (low + high) / 2
            low, high = (q, high) if inside(q) < share else (low, q)
        self.factor = 1 if share >= 1 else share / (inside(q) - math.exp(-q / 2) * q * q / 8)

    @staticmethod
    def lower_median(values):
        return np.sort(values)[(len(values) - 1) // 2]

    def starts(self):
        cells = (np.floor(self.x * robust_outliers.GRID) + 0.5) / robust_outliers.GRID
        m = np.array([self.lower_median(c) for c in cells.T])
        s = np.array([1.4826 * self.lower_median(abs(c - k)) for c, k in zip(cells.T, m, strict=True)])
        z = (self.x - m) / np.sqrt(s * s + self.floors)
        far = np.linalg.norm(z, axis=1, keepdims=True)
        out = [np.diag(s * s)]
        for u in (np.tanh(z), np.divide(z, far, out=np.zeros_like(z), where=far > 0)):
            u = u / np.maximum(np.linalg.norm(u, axis=0), 1e-300)
            c = u.T @ u * np.outer(s, s)
            np.fill_diagonal(c, s * s)
            out.append(c)
        return [(m, c) for c in out]

    def lower(self, c):
        c, low = c + np.diag(self.floors), np.zeros((4, 4))
        for i in range(4):
            for j in range(i + 1):
                rest = c[i, j] - low[i, :j] @ low[j, :j]
                low[i, j] = math.sqrt(max(rest, self.floors[i] / 4)) if i == j else rest / low[j, j]
        return low

    def distance(self, m, c, x):
        return np.square(np.linalg.solve(self.lower(c), (x - m).T)).sum(axis=0)

    def log_determinant(self, c):
        return 2 * np.log(np.diag(self.lower(c))).sum()

    def step(self, m, c):
        bins = np.floor(np.log1p(self.distance(m, c, self.x)) * robust_outliers.BINS)
        weight, left = np.zeros(self.n), self.half
        for b in np.unique(bins):
            here = bins == b
            weight[here] = min(1, max(0, left / here.sum()))
            left -= here.sum()
        m = weight @ self.x / weight.sum()
        return m, self.factor * ((self.x.T * weight) @ self.x / weight.sum() - np.outer(m, m))


def plain_estimates(groups):
    """The estimate of each group; all groups go on until each one's determinant stays."""
    each, best = {g: PlainEstimate(x) for g, x in groups.items()}, {}
    for g, e in each.items():
        tried = e.starts()
        for _ in range(robust_outliers.STEPS):
            tried = [e.step(*t) for t in tried]
        best[g] = min(tried, key=lambda t: e.log_determinant(t[1]))
    for _ in range(robust_outliers.MORE):
        after = {g: e.step(*best[g]) for g, e in each.items()}
        moved = max(abs(e.log_determinant(after[g][1]) - e.log_determinant(best[g][1])) for g, e in each.items())
        best = after
        if moved <= robust_outliers.SETTLED:
            break
    return each, best


def plain_distances(rows):
    """Squared distance of each row (lang, source, base_failed, x0 to x3) under its group's and all rows' mixture."""
    x = np.array([[r[f] for f in robust_outliers.FEATURES] for r in rows])
    groups = defaultdict(list)
    for i, r in enumerate(rows):
        if not r.base_failed:
            groups[r.lang, r.source].append(i)
            groups["all"].append(i)
    each, best = plain_estimates({g: x[i] for g, i in groups.items()})
    out, (m_all, c_all) = [], best["all"]
    for i, r in enumerate(rows):
        w = len(groups.get((r.lang, r.source), [])) / (len(groups.get((r.lang, r.source), [])) + robust_outliers.PRIOR)
        m, c = best.get((r.lang, r.source), best["all"])
        mix = w * c + (1 - w) * c_all + w * (1 - w) * np.outer(m - m_all, m - m_all)
        out.append(each["all"].distance(w * m + (1 - w) * m_all, mix, x[i : i + 1])[0])
    return out


def test_against_the_plain_estimate(spark, documents, awkward):
    for docs in (documents, awkward.unionByName(documents.limit(40), allowMissingColumns=True)):
        rows = robust_outliers.base_statistics(docs, "doc_id").collect()
        expected = sorted(zip([str(r.doc_id) for r in rows], [r.base_failed for r in rows], plain_distances(rows), strict=True))
        found = sorted((str(r.doc_id), r.base_failed, r.d2, r.kept) for r in robust_outliers.verdicts(docs).collect())
        for a, b in zip(found, expected, strict=True):
            assert a[:2] == b[:2] and a[2] == pytest.approx(b[2], rel=1e-6, abs=1e-9)
            assert a[3] == (not b[1] and b[2] <= robust_outliers.CUT)


def test_no_switch_by_size(spark):
    """Small sources of their own kind: the distance of one place moves smoothly with a source's number of rows."""
    rng = np.random.default_rng(9)
    sizes = (1, 2, 4, 30, 58, 59, 60, 61, 120, 399, 400, 401, 402)
    clean = np.abs(rng.normal([1.6, 0.05, 0.05, 0.1], [0.05, 0.03, 0.03, 0.05], (8000, 4)))
    frame = frame_of(spark, (clean, "s"), *[([[1.9, 0.3, 0.2, 0.2]] * n, str(n)) for n in sizes])
    judged = robust_outliers.judged(frame, robust_outliers.estimates(frame)).groupBy("source").agg({"d2": "max"})
    far = dict(map(tuple, judged.collect()))
    d2 = [far[str(n)] for n in sizes]
    assert all(b <= a * 1.0001 for a, b in zip(d2, d2[1:]))
    for at in (5, 6, 7, 10, 11, 12):
        assert d2[at] == pytest.approx(d2[at - 1], rel=0.05)


def test_several_starts_find_a_tilted_cluster(spark):
    """Two statistics that rise together, and a third of rows off that line: all of these are rejected."""
    rng = np.random.default_rng(10)
    t = rng.normal(0, 0.25, 800)
    clean = np.stack([1.6 + t, 0.5 + t, *rng.normal(0.2, 0.02, (2, 800))], axis=1) + rng.normal(0, 0.01, (800, 4))
    bad = rng.normal([2.1, 0.0, 0.2, 0.2], 0.01, (400, 4))
    frame = frame_of(spark, (clean, "s"), (bad, "s"))
    kept = {r.doc_id: r.kept for r in robust_outliers.judged(frame, robust_outliers.estimates(frame)).collect()}
    assert not any(kept[i] for i in range(800, 1200)) and sum(kept[i] for i in range(800)) >= 790


def test_awkward_tables_of_kept_documents(awkward, empty):
    kept = robust_outliers.kept_documents(awkward).collect()
    judged = [r for r in robust_outliers.verdicts(awkward).collect() if r.kept]
    assert sorted(str(r.doc_id) for r in kept) == sorted(str(r.doc_id) for r in judged)
    assert robust_outliers.kept_documents(empty).count() == 0 and robust_outliers.kept_documents(empty).columns == empty.columns
