"""Near-duplicates and mixing, against plain versions."""

import brute
import numpy as np
import pytest
from compare import connect
from pyspark.sql import functions as F

from planlens.llm import queries, simhash, source_mix

SMALL = "/root/testdata/sf0.001"


def expected_classes(rows):
    prints = np.array([brute.simhash(r.text) for r in rows], dtype=np.uint64)
    return prints, brute.classes(len(rows), lambda i: np.bitwise_count(prints ^ prints[i]) <= 4)


def test_simhash_query(spark):
    for folder in (SMALL, "/root/testdata/sf0.01"):
        rows = spark.read.parquet(f"{folder}/documents.parquet").orderBy("doc_id").collect()
        prints, found = expected_classes(rows)
        got = {r.doc_id: r for r in queries.op7_simhash(spark, folder).collect()}
        for r, p, c in zip(rows, prints, found, strict=True):
            assert (got[r.doc_id].fingerprint, got[r.doc_id].component_id) == (f"{int(p):016x}", rows[c].doc_id)


def test_simhash_awkward(awkward, empty):
    rows = awkward.collect()
    prints, found = expected_classes(rows)
    expected = sorted(
        (str(r.doc_id), int(p), str(min((x.doc_id for x, k in zip(rows, found) if k == c and x.doc_id is not None), default=None)))
        for r, p, c in zip(rows, prints, found, strict=True)
    )
    got = simhash.near_duplicates(awkward).collect()
    assert sorted((str(r.doc_id), r.fp % 2**64, str(r.component_id)) for r in got) == expected
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.one_of_each(awkward)
    assert kept.columns == awkward.columns and kept.count() == len(set(found))
    assert simhash.one_of_each(empty).count() == 0


@pytest.mark.parametrize("distance", [1, 4])
def test_links_lose_nothing(spark, distance):
    """Chains, a dense ball of near copies and far ones: the classes are those of all pairs."""
    rng = np.random.default_rng(distance)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    flips = lambda n, k: np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (n, k), dtype=np.uint64), axis=1)
    chain = [base[0]]
    for f in flips(80, distance):
        chain.append(chain[-1] ^ f)
    points = np.unique(np.concatenate([base, np.array(chain), base[1] ^ flips(400, 3), base[2] ^ flips(300, 6)]))
    found = brute.classes(len(points), lambda i: np.bitwise_count(points ^ points[i]) <= distance)
    frame = spark.createDataFrame([(int(p.astype(np.int64)),) for p in points], "fp long")
    roots = {r.node: r.root for r in simhash.components(simhash.links(frame, distance)).collect()}
    label = [roots.get(int(p.astype(np.int64)), int(p.astype(np.int64))) for p in points]
    assert len(set(zip(label, found))) == len(set(label)) == len(set(found))


def test_mix_targets(spark):
    sizes = [("a", 100), ("b", 5), ("ä", 1000), ("c", 0), (None, 40)]
    frame = spark.createDataFrame(sizes, "source string, size long")
    got = {r.source: r for r in source_mix.source_targets(frame).collect()}
    names = ["a", "b", "c", "ä", None]
    assert [got[n].idx for n in names] == list(range(5))
    weight, size = [3, 1, 2, 3, 1], [100, 5, 0, 1000, 40]
    target, stopped = [0.0] * 5, set()
    while True:
        rest = 1.5 * sum(size) - sum(2 * size[i] for i in stopped)
        open_weight = sum(w for i, w in enumerate(weight) if i not in stopped)
        target = [2.0 * size[i] if i in stopped else rest * weight[i] / open_weight for i in range(5)]
        over = {i for i in range(5) if target[i] > 2 * size[i]}
        if not over:
            break
        stopped |= over
    assert np.allclose([got[n].target for n in names], target)


@pytest.mark.parametrize("n", [1, 2, 3, 10, 100, 4097])
def test_schedule_hits_each_time_once(spark, n):
    quota = [n // 3, n - n // 3 - n // 10, n // 10]
    first = np.concatenate([[0], np.cumsum(quota)[:-1]])
    rows = [(i, int(f), q) for i, (f, q) in enumerate(zip(first, quota, strict=True))]
    got = source_mix.schedule(spark.createDataFrame(rows, "idx int, first long, slots long"), n).collect()
    assert sorted(r.slot for r in got) == list(range(n))
    for i, q in enumerate(quota):
        mine = sorted((r.slot, r.rank) for r in got if r.idx == i)
        assert [r for _, r in mine] == list(range(q))
        assert all(abs((k + 1) - q * (slot + 1) / n) < 4 for k, (slot, _) in enumerate(mine))


def test_mix_query(spark):
    connection = connect(SMALL)
    expected = {r[0]: r for r in connection.sql("select doc_id, source from documents").fetchall()}
    rows = queries.op10_source_mix(spark, SMALL).collect()
    assert sorted(r.doc_id for r in rows) == sorted(expected)
    by_source = {}
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size
        by_source.setdefault(expected[r.doc_id][1], []).append(r)
    for group in by_source.values():
        assert sum(r.size for r in group) == group[0].source_size
        assert abs(sum(r.taken for r in group) - group[0].target) <= 0.5 and group[0].target <= 2 * group[0].source_size
    again = {r.doc_id: r.taken for r in queries.op10_source_mix(spark, SMALL).collect()}
    assert again == {r.doc_id: r.taken for r in rows}


def test_mix_awkward(awkward, empty):
    rows = source_mix.mix(awkward).collect()
    assert len(rows) == awkward.count() and all(0 <= r.taken <= 2 * r.size for r in rows)
    assert sum(r.taken for r in rows) == pytest.approx(1.5 * sum(r.size for r in rows), abs=3)
    assert source_mix.mix(empty).count() == 0 and source_mix.mixed_documents(empty).count() == 0
    out = source_mix.mixed_documents(awkward)
    assert out.columns == awkward.columns and out.where(F.col("text").isNull()).count() == 0
