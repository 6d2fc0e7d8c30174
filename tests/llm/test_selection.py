"""Toxicity, importance resampling and hard negatives, against plain versions and SQL."""

import hashlib
import math
import re
import zlib
from collections import Counter

import brute
import numpy as np
import pytest
from compare import connect, differences
from pyspark.sql import functions as F

from planlens.llm import hyperplane_tree as tree
from planlens.llm import importance_resampling as resampling
from planlens.llm import mil_toxicity as toxicity
from planlens.llm import queries

SMALL = "/root/testdata/sf0.001"

# Toxicity


def test_noisy_or_by_the_definition(spark):
    """Scores and places of sentences from the model's weights, sentence by sentence."""
    model = toxicity.Model(["bad", "awf*", "awful", "mild"], [3.0, 1.0, 2.5, -1.0], -1.0, 0.01)
    texts = ["Nothing here. At all!", "So bad. Quite awful, bad\nmild!\n\nAWFULLY mild", "", None, "bad " * 40_000, "...!?\n", "übel bad.", "bäd"]
    rows = spark.createDataFrame([(i, t, 1.0) for i, t in enumerate(texts)], "doc_id long, text string, score double")
    for r in toxicity.score(rows, model, "doc_id").collect():
        harmless, located, n = 1 - model.leak, [], 0
        for m in re.finditer(r"[^.!?\n]+", texts[r.doc_id] or ""):
            n += bool(m[0].strip())
            words = set(re.findall(r"\w+", m[0].lower()))
            features = {f for w in words for f in [w, *(w[:k] + "*" for k in range(3, 9) if k < len(w))]} & set(model.features)
            if features:
                p = 1 / (1 + math.exp(1.0 - sum(model.weights[model.features.index(f)] for f in features)))
                harmless *= 1 - p
                located += [(m.start(), m.end(), pytest.approx(p))] if p >= 0.5 else []
        assert r.score == pytest.approx(1 - harmless) and r.n_sentences == n
        assert [tuple(x) for x in r.offending] == located


def test_the_fit_finds_the_sentences_that_explain_the_labels():
    """Features 0 and 1 make a document toxic, 2 occurs everywhere, 3 only beside them: their weights tell them apart."""
    draw = np.random.default_rng(1)
    bags, y = [], []
    for _ in range(1500):
        toxic = draw.random() < 0.3
        bag = [[2] for _ in range(draw.integers(0, 6))]
        if toxic:
            bag += [[int(draw.integers(0, 2)), 2]]
        bags.append(bag)
        y.append(toxic)
    model = toxicity.fit(bags, np.array(y, dtype=float), ["a", "b", "c"])
    assert model.sentence([0, 2]) > 0.9 and model.sentence([1]) > 0.9 and model.sentence([2]) < 0.05
    assert model.document(np.array([model.sentence([2])] * 5)) < 0.3


@pytest.mark.parametrize("y", [[0, 0], [1, 1], []])
def test_one_class_teaches_a_constant(y):
    model = toxicity.fit([[[0]]] * len(y), np.array(y, dtype=float), ["a"])
    assert model.features == [] and 0 < model.leak < 1


def test_toxicity_of_held_out_documents(spark):
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    found = queries.op11_mil_toxicity(spark, folder).join(labels.select("doc_id", "toxic"), "doc_id")
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang")
    rows = found.join(docs, "doc_id").where("held_out").collect()
    hit = [r.predicted for r in rows if r.toxic]
    assert np.mean(hit) > 0.85 and np.mean([r.predicted for r in rows if not r.toxic]) < 0.02
    for r in rows:
        assert r.predicted == (r.score >= 0.3) and r.held_out == (brute.remainder(r.doc_id, 4) == 2)
        if r.n_offending:
            sentence = r.text[r.worst_start : r.worst_end]
            assert sentence and not set(sentence) & set(".!?\n")


def test_labels_of_held_out_rows_do_not_matter(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    other = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, two = (sorted(map(tuple, toxicity.classify(docs, x, 4, 2).select("doc_id", "score").collect())) for x in (labels, other))
    assert one == two


def test_toxicity_awkward(spark, awkward, empty):
    labels = spark.createDataFrame([(1, 1), (1, 0), (3, 0), (None, 1), (5, None), (6, 0), (99, 1)], "doc_id long, toxic int")
    for known in (labels, labels.limit(0)):
        rows = toxicity.classify(awkward, known, 4, 2).collect()
        assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in awkward.collect())
        assert all(0 <= r.score <= 1 for r in rows)
        assert toxicity.classify(empty, known, 4, 2).count() == 0


# Importance resampling


def plain_words(text):
    return re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", brute.ascii_lower(text or ""))


def plain_features(text, n):
    w = plain_words(text)
    return [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10_000 for k in range(1, n + 1) for i in range(len(w) - k + 1)]


def plain_resample(docs, target, n, percent=10, least=20):
    s, t = (Counter(b for x in texts for b in plain_features(x, n)) for texts in ([d for _, d in docs], target))
    all_s, all_t = sum(s.values()) + 10_000, sum(t.values()) + 10_000
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * all_s / ((s[b] + 1.0) * all_t)))
    rows = []
    for doc_id, text in docs:
        found = plain_features(text, n)
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, found))
        rows.append([doc_id, len(plain_words(text)), len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))])
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    drawn = len(able) * percent // 100
    return Counter((*r, i + 1 if i < drawn else None) for i, r in enumerate(able)) + Counter((*r, None) for r in rows if r[1] < least)


@pytest.mark.parametrize("n", [1, 2, 3])
def test_resampling(spark, documents, n):
    """Lines of every length: runs inside a line, across one line end and across several."""
    target = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    extra = ["a\nb\nc\nd e\n\nf", "\n\n", "one two three four five\nsix seven eight nine ten eleven\ntwelve", "a\r\nb - c\n" * 50]
    docs = documents.select("doc_id", "text").unionByName(
        spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(extra)], "doc_id long, text string")
    )
    got = Counter(map(tuple, resampling.resample(docs, target, n).collect()))
    assert got == plain_resample([tuple(r) for r in docs.collect()], [r.text for r in target.collect()], n)


def test_resampling_awkward(spark, awkward, empty):
    """Repeated rows, repeated and missing ids and texts; ties in score by repeated rows share the ranks."""
    docs = awkward.select("doc_id", "text").collect()
    target = ["the cat sat", None, ""]
    aims = spark.createDataFrame([(t,) for t in target], "text string")
    for n in (1, 2):
        got = Counter(map(tuple, resampling.resample(awkward, aims, n, percent=60).collect()))
        assert got == plain_resample([tuple(r) for r in docs], target, n, percent=60)
    assert resampling.resample(empty, aims).count() == 0
    assert resampling.resample(awkward, aims.limit(0)).count() == len(docs)


@pytest.mark.parametrize("name", ["op12_importance_resampling", "op13_hyperplane_tree"])
def test_queries_in_sql(spark, name):
    got = queries.QUERIES[name](spark, SMALL).toArrow()
    assert differences(got, connect(SMALL).sql(queries.ORACLE_SQL[name]).to_arrow_table()) == []


# Hard negatives


def plain_negatives(rows, most=5, every=100):
    ok = {
        (r[0], r[1], tuple(math.floor(256 * x) for x in r[2]))
        for r in rows
        if None not in r[:3] and all(x is not None and math.isfinite(x) and abs(x) < 1e6 for x in r[2])
    }
    score = lambda a, b: sum(x * y for x, y in zip(a, b))  # noqa: E731  missing components count 0
    out = Counter()
    for a_id, a_label, a in (r for r in ok if r[0] % every == 0):
        others = sorted((-score(a, v), i, label) for i, label, v in ok if i != a_id)
        for p, p_id, _ in [x for x in others if x[2] == a_label][:most]:
            fit = [x for x in others if x[2] != a_label and 80 * -p <= 100 * -x[0] <= 100 * -p]
            out.update((a_id, p_id, k, x[1], -p, -x[0]) for k, x in enumerate(fit[:most], 1))
    return out


def clustered(n, size=6, labels=4, copies=40):
    """Clusters of several labels, groups of equal vectors, equal scores."""
    draw = np.random.default_rng(4)
    centre = draw.normal(size=(12, size))
    x = centre[draw.integers(0, 12, n)] + 0.05 * draw.normal(size=(n, size))
    x[:copies] = x[0]
    x = np.round(x * 8) / 8
    return [(int(i), int(k), row.tolist()) for i, k, row in zip(draw.permutation(n), draw.integers(0, labels, n), x, strict=True)]


def test_hard_negatives(spark, monkeypatch):
    """Several levels, small blocks and parts: every row as by comparing all pairs."""
    for name, value in (("ARITY", 4), ("LEAF", 20), ("BLOCK", 16), ("PART", 3), ("BOUNDS", 4)):
        monkeypatch.setattr(tree, name, value)
    monkeypatch.setattr(tree.grow, "__defaults__", (4, 20))
    rows = clustered(900)
    frame = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    got = Counter(map(tuple, tree.hard_negatives(tree.vectors(frame), every=20).collect()))
    want = plain_negatives(rows, every=20)
    assert got == want and sum(want.values()) > 300


def test_hard_negatives_awkward(spark):
    rows = clustered(120, copies=10)
    rows += rows[:7]  # repeated rows
    rows += [(0, 3, [1.0] * 6), (0, 0, rows[3][2]), (100, 1, [2.0, 1.0])]  # ids once more, a shorter vector
    rows += [(None, 1, [1.0] * 6), (700, None, [1.0] * 6), (800, 1, None), (900, 1, [1.0, None]), (1000, 2, [float("nan")] * 6)]
    rows += [(1100, 2, [float("-inf"), 0.0]), (1200, 2, []), (1300, 1, [-1.0] * 6), (1400, 1, [1e30] * 6)]
    schema = "vec_id long, label int, embedding array<float>, ids string, leaf int, qid double, score int"
    frame = spark.createDataFrame([(*r, "x", 1, 0.5, 2) for r in rows], schema)
    got = Counter(map(tuple, tree.hard_negatives(tree.vectors(frame), every=10).collect()))
    assert got == plain_negatives(rows, every=10) and got
    assert tree.hard_negatives(tree.vectors(frame.limit(0))).count() == 0
    assert tree.hard_negatives(tree.vectors(frame.where("vec_id = 1"))).count() == 0


def test_bounds_hold_and_leave_leaves_out(spark):
    """No score lies outside its leaf's bounds, and a narrow window of a clustered table meets few leaves."""
    rows = clustered(3000, copies=1)
    found = tree.points(tree.vectors(spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")))
    placed, grown = tree.index(found)
    assert grown.leaves >= 12
    placed = placed.toArrow()
    x, leaf = tree._matrix(placed.column("v")), placed.column("leaf").to_numpy()
    low, high = grown.bounds(x[:200])
    s = tree.inner(x[:200], x)
    assert (s >= low[:, leaf]).all() and (s <= high[:, leaf]).all()
    best = s.max(1, keepdims=True)
    assert ((high >= 0.95 * best) & (low <= best)).mean() < 0.5
    empty_leaves = np.setdiff1d(np.arange(grown.leaves), leaf)
    assert (low[:, empty_leaves] > high[:, empty_leaves]).all()


def test_scores_beyond_doubles():
    a = np.array([[1 << 28, 3], [-(1 << 28), 1]])
    assert tree.inner(a, a)[0, 0] == (1 << 56) + 9 and tree.inner(a, a)[0, 1] == -(1 << 56) + 3
