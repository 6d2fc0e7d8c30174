"""Context-tree scores, token rollups and paragraph sketches, against plain versions."""

import math
from collections import Counter

import brute
import numpy as np
import pytest
from compare import connect, differences
from pyspark.sql import functions as F

from planlens.llm import context_tree, paragraph_sketch, queries
from planlens.llm.token_rollup import TokenRollup

SMALL = "/root/testdata/sf0.001"


class PlainTree:
    """Nodes (context, decisions so far) in a dict; probabilities by the definition, from the root down."""

    def __init__(self, texts, depth):
        self.depth, self.nodes = depth, {}
        for t in texts:
            data = b"\n" * depth + t + b"\n"
            for i in range(depth, len(data)):
                for k in range(8):
                    node, bit = (1 << k) | (data[i] >> (8 - k)), data[i] >> (7 - k) & 1
                    for d in range(depth + 1):
                        self.nodes.setdefault((data[i - d : i], node), [0, 0])[bit] += 1
        self.deeper = {}
        for context, node in self.nodes:
            if context:
                self.deeper.setdefault((context[1:], node), []).append((context, node))
        self.weighted = {}
        for key in sorted(self.nodes, key=lambda k: -len(k[0])):
            own = self.own(key)
            if len(key[0]) < depth:
                below = sum(self.weighted[k] for k in self.deeper.get(key, []))
                own = np.logaddexp(own, below) - math.log(2)
            self.weighted[key] = own

    def own(self, key):
        a, b = self.nodes[key]
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)

    def bit(self, context, node, bit, d=0):
        key = (context[len(context) - d :], node)
        if key not in self.nodes:
            return 0.5
        a, b = self.nodes[key]
        own = ((b if bit else a) + 0.5) / (a + b + 1)
        if d == self.depth:
            return own
        stay = math.exp(self.own(key) - math.log(2) - self.weighted[key])
        return stay * own + (1 - stay) * self.bit(context, node, bit, d + 1)

    def byte(self, context, x):
        return math.prod(self.bit(context, (1 << k) | (x >> (8 - k)), x >> (7 - k) & 1) for k in range(8))

    def score(self, text):
        data = b"\n" * self.depth + text + b"\n"
        return sum(math.log10(self.byte(data[i - self.depth : i], data[i])) for i in range(self.depth, len(data)))


def check_scores(rows, got):
    split = [brute.words(brute.ascii_lower(r.text or "")) for r in rows]
    learn = [brute.remainder(r.doc_id, 7) != 2 for r in rows]
    count = Counter(x for w, use in zip(split, learn) if use for x in [*w, None])
    n, v = sum(count.values()), len(count)
    tree = PlainTree([" ".join(w).encode() for w, use in zip(split, learn) if use], context_tree.DEPTH)
    expected = sorted(
        (str(r.doc_id), not use, len(w) + 1, sum(count[x] > 0 for x in [*w, None]), n,
         round(sum(math.log10((count[x] + 1) / (n + v + 1)) for x in [*w, None]), 6), round(tree.score(" ".join(w).encode()), 5))
        for r, w, use in zip(rows, split, learn, strict=True)
    )
    found = sorted((str(r[0]), *r[1:5], round(r.base_score, 6), round(r.score, 5)) for r in got)
    for a, b in zip(found, expected, strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], abs=2e-5)
    size = {(str(r.doc_id), len(w) + 1): len(" ".join(w).encode()) + 1 for r, w in zip(rows, split, strict=True)}
    for r in got:
        assert r.bits_per_byte == pytest.approx(-r.score / math.log10(2) / size[str(r.doc_id), r.n_tokens])
    return tree


def test_scores(spark, documents):
    few = documents.where("n_chars < 900").limit(60)
    tree = check_scores(few.collect(), context_tree.score(few).collect())
    for context in (b"\n" * context_tree.DEPTH, b"d the", b"zzzzz"):
        assert sum(tree.byte(context, x) for x in range(256)) == pytest.approx(1)


def test_scores_awkward(awkward, empty):
    rows = awkward.where("n_chars is null or n_chars < 1000")
    check_scores(rows.collect(), context_tree.score(rows).collect())
    assert context_tree.score(awkward).count() == awkward.count()
    assert context_tree.score(empty).count() == 0


def test_held_out_texts_cost_less_than_by_single_tokens(spark):
    held = context_tree.score(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).where("held_out")
    tree, base = held.agg(F.sum("score"), F.sum("base_score")).first()
    assert tree > base


def test_rollup_query(spark):
    got = queries.op5_token_rollup(spark, SMALL).toArrow()
    assert differences(got, connect(SMALL).sql(queries.ORACLE_SQL["op5_token_rollup"]).to_arrow_table()) == []


def test_rollup_batches(spark, tmp_path):
    schema = "op string, doc_id long, source string, lang string, version string, n_tokens long, n_docs string"
    batches = [
        ("one", [("insert", 1, "a", "en", "v1", 10, "x"), ("insert", 2, "a", "en", "v1", 5, None), ("insert", 3, None, None, None, None, None), ("insert", None, "b", "de", "v1", 7, None), ("other", 9, "a", "en", "v1", 1, None)]),
        ("two", [("revise", 1, "a", "en", "v2", 12, None), ("delete", 2, None, None, None, None, None), ("delete", 2, None, None, None, None, None), ("delete", 77, None, None, None, None, None)]),
        ("three", [("delete", None, None, None, None, None, None), ("insert", 4, "a", "en", "v2", 3, None), ("insert", 4, "a", "en", "v2", 3, None)]),
        ("four", []),
    ]
    rollup = TokenRollup(spark, str(tmp_path))
    assert rollup.totals() is None
    for name, rows in batches:
        changes = spark.createDataFrame(rows, schema)
        if name == "two":  # an attempt that died before its commit
            changes.limit(1).select("doc_id", "source", "lang", "version", F.lit(9).cast("long").alias("n_docs"), "n_tokens").write.parquet(f"{tmp_path}/ledger/batch=two")
        assert rollup.apply(name, changes) and not rollup.apply(name, changes)
    total = {(r.source, r.lang, r.version): (r.n_docs, r.n_tokens) for r in rollup.totals().collect()}
    assert total == {("a", "en", "v2"): (3, 18), (None, None, None): (1, 0)}
    assert {(r.doc_id, r.n_docs, r.n_tokens) for r in rollup.current().collect()} == {(1, 1, 12), (4, 2, 6), (3, 1, 0)}
    with pytest.raises(ValueError, match="plain name"):
        rollup.apply("../x", spark.createDataFrame([], schema))


def pieces(text):
    out = []
    for line in text.splitlines(keepends=True) if "\r" not in text else text.split("\n"):
        out.append(line)
    parts = []
    lines = text.split("\n")
    for i, line in enumerate(lines):
        cut = [line[k : k + paragraph_sketch.PIECE] for k in range(0, len(line), paragraph_sketch.PIECE)]
        if i < len(lines) - 1:
            cut = [*cut[:-1], cut[-1] + "\n"] if cut else ["\n"]
        parts += cut
    return parts


def alike(a, b):
    one, other = Counter(pieces(a)), Counter(pieces(b))
    n = sum(one.values()) + sum(other.values())
    return 1.0 if not n else 1 - sum(((one - other) + (other - one)).values()) / n


def check_pairs(rows, got):
    rows = sorted(rows, key=lambda r: (r.doc_id is not None, r.doc_id or 0, (r.text or "").encode()))
    texts = [r.text or "" for r in rows]
    expected = []
    for i, r in enumerate(rows):
        text, after = texts[i], texts[(i + 1) % len(texts)]
        k = len(text) // 4
        edited = text[: len(text) - k] + after[:k]
        expected.append((str(r.doc_id), len(text), brute.sha(edited), round(alike(text, edited), 9), round(alike(text, after), 9)))
    found = [(str(r.doc_id), r.n_chars, brute.sha(r.edited), round(r.near_edited, 9), round(r.near_next, 9)) for r in got]
    assert sorted(found) == sorted(expected)


def test_sketches(documents, awkward, empty):
    for table in (documents, awkward, documents.limit(1)):
        got = paragraph_sketch.edited_pairs(table).collect()
        check_pairs(table.collect(), got)
    assert paragraph_sketch.edited_pairs(empty).count() == 0


def test_next_across_many_groups(spark, monkeypatch):
    monkeypatch.setattr(paragraph_sketch, "GROUP", 3)
    ids = [None, -50, -4, 0, 1, 2, 3, 3, 10, 11, 12, 1000, 1001, 5000]
    frame = spark.createDataFrame([(x, f"text {i}") for i, x in enumerate(ids)], "doc_id long, text string")
    got = {r.text: r.next_text for r in paragraph_sketch.with_next(frame).collect()}
    assert got == {f"text {i}": f"text {(i + 1) % len(ids)}" for i in range(len(ids))}


def test_peeling_retries_and_repeats(spark):
    """Differences of all sizes, with repeated digests, equal the multiset difference; a small sketch alone gives up."""
    rng = np.random.default_rng(2)
    rows = []
    for n in (0, 1, 5, 20, 100, 700):
        common = rng.integers(0, 1 << 40, n).tolist()
        one = [*common, *rng.integers(0, 1 << 40, n).tolist(), *common[:3]]
        other = [*common, *rng.integers(0, 1 << 40, n // 2).tolist(), *common[:1] * 4]
        rows.append((n, one, other))
    frame = spark.createDataFrame(rows, "n int, one array<long>, other array<long>")
    small = paragraph_sketch.small_sketch
    frame = frame.withColumns({"a": small(F.col("one")), "b": small(F.col("other"))})
    found = paragraph_sketch.differing(F.col("one"), F.col("other"), F.col("a"), F.col("b"))
    alone = paragraph_sketch.peel(paragraph_sketch.subtract(F.col("a"), F.col("b")), F.lit(paragraph_sketch.SMALL))
    for r in frame.select("n", "one", "other", found.alias("d"), alone.alias("alone")).collect():
        one, other = Counter(r.one), Counter(r.other)
        net = {k: one[k] - other[k] for k in one | other if one[k] != other[k]}
        assert {x.d: x.n for x in r.d} == net
        assert (r.alone is None) == (r.n >= 20)
