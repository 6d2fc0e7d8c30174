"""Hard negatives through a multiway hyperplane tree with sibling ranges.

A node holds up to ARITY split points; a vector belongs to the child of the
nearest one.  For each split point and each sibling subtree the node stores the
range of distances between the point and the subtree's vectors.  A query knows
its own distances to the split points, and by the triangle inequality each
range bounds its distance to a whole subtree; intersected over all split points
and levels, and joined with the subtree's range of norms, that bounds the inner
product.  A subtree is left out where these bounds miss every window of scores
that the query asks for.  Leaves that remain are scanned exactly, so results do
not depend on the tree.

The split points come from at most SAMPLE rows, chosen by a digest; every row is
put into its leaf and every range is taken over all rows.  Tasks hold a
block of a leaf and a part of the queries that visit it, whatever the leaf's size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from planlens.llm.common import store

#: Components are counted in steps of 1 / SCALE, downwards.
SCALE = 256
#: Rows that split points are chosen from at most, children of a node, rows of a leaf where the sample allows it.
SAMPLE, ARITY, LEAF = 8192, 16, 1024
#: Rows and queries that a task compares at a time, and queries whose bounds it holds.
BLOCK, PART, BOUNDS = 4096, 1024, 256
#: Sums of squares of this size or more could not be held in a score of 64 bits.
LONGEST = 2.0**60
MOST = 5
#: Queries are the rows whose id this divides.
EVERY = 100


def vectors(table: DataFrame) -> DataFrame:
    """vec_id, label, v (array of long) of the distinct rows of ``table`` (vec_id, label, embedding) that take part.

    Rows without id, label or vector, or with a missing or non-finite component,
    take no part, nor do vectors too long for 64-bit scores.  Shorter vectors
    are filled up with zeros.  Rows equal in all three count once; rows that
    repeat an id with another label or vector are rows of their own.
    """
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    known = table.where("vec_id is not null and label is not null and embedding is not null").where(~bad)
    steps = known.select(
        F.col("vec_id").cast("long"), F.col("label").cast("int"), F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE).cast("double")).alias("d")
    )
    short = F.aggregate("d", F.lit(0.0), lambda total, x: total + x * x) < LONGEST
    kept = steps.where(short).select("vec_id", "label", F.col("d").cast("array<bigint>").alias("v")).distinct()
    kept = store(kept, "vectors")
    size = kept.agg(F.coalesce(F.max(F.size("v")), F.lit(0))).first()[0]
    return kept.withColumn("v", F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(size) - F.size("v"))))


def points(rows: DataFrame, most: int = MOST) -> DataFrame:
    """label, v, ids: different labelled vectors with their smallest ids, as many as one list of results can use.

    Rows equal in label and vector have equal scores and places by id, so of
    thousands of copies only ``most`` and the query itself can be in a list.
    """
    first = F.row_number().over(Window.partitionBy("label", "v").orderBy("vec_id"))
    few = rows.withColumn("_k", first).where(F.col("_k") <= most + 1)
    return few.groupBy("label", "v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0), dtype=np.int64)


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows."""
    if not a.shape[1]:
        return np.zeros((len(a), len(b)), dtype=np.int64)
    big = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if big < 2**53:
        return (a.astype(float) @ b.T.astype(float)).astype(np.int64)
    return a @ b.T


def distances(x: np.ndarray, to: np.ndarray) -> np.ndarray:
    square = (x.astype(float) ** 2).sum(1)[:, None] + (to.astype(float) ** 2).sum(1) - 2 * (x.astype(float) @ to.astype(float).T)
    return np.sqrt(np.maximum(square, 0))


@dataclass
class Node:
    split: np.ndarray
    #: Of each child: the next node, or -1 - leaf.
    child: list[int]
    #: Least and largest distance from split point i to the rows under child j, and of their norms in the last row.
    low: np.ndarray = field(default=None)
    high: np.ndarray = field(default=None)


@dataclass
class Tree:
    nodes: list[Node]
    leaves: int

    def leaf(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), dtype=np.int64)
        for _, rows, near, node, _ in self.walk(x):
            child = np.array(node.child)[near]
            out[rows[child < 0]] = -1 - child[child < 0]
        return out

    def walk(self, x: np.ndarray) -> Iterator[tuple]:
        """(node number, rows in it, their child, node, distances to its split points) of all nodes that rows reach."""
        waiting = [(0, np.arange(len(x)))] if self.nodes else []
        while waiting:
            k, rows = waiting.pop()
            node = self.nodes[k]
            d = distances(x[rows], node.split)
            near = d.argmin(1)
            yield k, rows, near, node, d
            for j, below in enumerate(node.child):
                if below >= 0 and (near == j).any():
                    waiting.append((below, rows[near == j]))

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest score that each query can have with rows of each leaf; the least is above the largest for an empty one."""
        low, high = np.full((len(q), self.leaves), -np.inf), np.full((len(q), self.leaves), np.inf)
        own = (q.astype(float) ** 2).sum(1)[:, None]
        waiting = [(0, np.zeros((len(q), 1)), np.full((len(q), 1), np.inf))] if self.nodes else []
        while waiting:
            k, near, far = waiting.pop()
            node = self.nodes[k]
            d = distances(q, node.split)[:, :, None]
            lo, hi, norm_lo, norm_hi = node.low[:-1], node.high[:-1], node.low[-1], node.high[-1]
            near = np.maximum(near, np.maximum(d - hi, lo - d).max(1))
            far = np.minimum(far, (d + hi).min(1))
            slack = 1e-9 * (own + np.where(np.isfinite(norm_hi), norm_hi, 0)) + 1e-6  # of floating point; scores are whole numbers
            with np.errstate(invalid="ignore"):
                top = np.where(norm_hi < 0, -np.inf, (own + norm_hi - near**2) / 2 + slack)
                bottom = np.where(norm_hi < 0, np.inf, (own + norm_lo - far**2) / 2 - slack)
            for j, below in enumerate(node.child):
                if below < 0:
                    low[:, -1 - below], high[:, -1 - below] = bottom[:, j], top[:, j]
                elif norm_hi[j] >= 0:
                    waiting.append((below, near[:, j : j + 1], far[:, j : j + 1]))
                else:
                    for leaf in self._leaves_below(below):
                        low[:, leaf], high[:, leaf] = np.inf, -np.inf
        return low, high

    def _leaves_below(self, k: int) -> list[int]:
        return [x for c in self.nodes[k].child for x in ([-1 - c] if c < 0 else self._leaves_below(c))]


def grow(sample: np.ndarray, rows: int, arity: int = ARITY, leaf: int = LEAF) -> Tree:
    """A tree whose leaves hold about ``leaf`` of ``rows`` rows, as far as the sample goes; no ranges yet.

    Split points are picked one after another, each the farthest from those before.
    """
    tree, share = Tree([], 0), rows / max(1, len(sample))

    def build(part: np.ndarray) -> int:
        chosen, away = [0], distances(part, part[:1])[:, 0]
        while len(chosen) < min(arity, len(part)) and away.max() > 0:
            chosen.append(int(away.argmax()))
            away = np.minimum(away, distances(part, part[chosen[-1:]])[:, 0])
        node = Node(part[chosen], [])
        tree.nodes.append(node)
        k, near = len(tree.nodes) - 1, distances(part, part[chosen]).argmin(1)
        for j in range(len(chosen)):
            below = part[near == j]
            if len(chosen) > 1 and len(below) >= 2 * arity and len(below) * share > leaf:
                node.child.append(build(below))
            else:
                tree.leaves += 1
                node.child.append(-tree.leaves)
        return k

    if len(sample):
        build(sample)
    return tree


def index(found: DataFrame) -> tuple[DataFrame, Tree]:
    """All points (label, v, ids) with their ``leaf``, and the tree with ranges over all of them."""
    found = store(found, "points")
    digest = F.xxhash64("label", "v")
    drawn = found.orderBy(digest, "label", "v").limit(SAMPLE).select("v").toArrow()
    tree = grow(_matrix(drawn.column("v")), found.count())

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = tree.leaf(_matrix(batch.column("v")))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], names=[*batch.schema.names, "leaf"])

    placed = store(found.mapInArrow(place, "label int, v array<bigint>, ids array<bigint>, leaf bigint"), "placed")
    _set_ranges(tree, placed)
    return placed, tree


def _set_ranges(tree: Tree, placed: DataFrame) -> None:
    """Ranges of every node over all rows; the driver gets ARITY + 1 numbers for each split point."""

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("v"))
            norm = (x.astype(float) ** 2).sum(1)[:, None]
            for k, rows, near, _, d in tree.walk(x):
                d = np.concatenate([d, norm[rows]], axis=1)
                for j in np.unique(near):
                    own = d[near == j]
                    n = own.shape[1]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, k)), pa.array(np.full(n, j)), pa.array(np.arange(n)), pa.array(own.min(0)), pa.array(own.max(0))],
                        names=["node", "child", "point", "low", "high"],
                    )

    parts = placed.mapInArrow(ranges, "node bigint, child bigint, point bigint, low double, high double")
    totals = parts.groupBy("node", "child", "point").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    for node in tree.nodes:
        shape = len(node.split) + 1, len(node.split)
        node.low, node.high = np.full(shape, np.inf), np.full(shape, -np.inf)
    for r in totals.toLocalIterator():
        tree.nodes[r.node].low[r.point, r.child], tree.nodes[r.node].high[r.point, r.child] = r.low, r.high


def _visits(queries: DataFrame, tree: Tree, nearest: bool) -> DataFrame:
    """Queries with a ``leaf`` each: the nearest one, or all others whose bounds meet one of the query's windows."""
    schema = queries.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BOUNDS):
                part = batch.slice(at, BOUNDS)
                q = _matrix(part.column("v"))
                home = tree.leaf(q)
                if nearest:
                    who, leaf = np.arange(len(q)), home
                else:
                    low, high = tree.bounds(q)
                    windows = zip(part.column("lows").to_pylist(), part.column("highs").to_pylist(), strict=True)
                    meets = np.array(
                        [np.any([(high[i] >= a) & (low[i] <= b) for a, b in zip(*w, strict=True) if a <= b], axis=0) & np.ones(tree.leaves, bool) for i, w in enumerate(windows)]
                    )
                    meets[np.arange(len(q)), home] = False
                    who, leaf = np.nonzero(meets)
                taken = part.take(pa.array(who))
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(leaf.astype(np.int64))], names=[*part.schema.names, "leaf"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.fields)
    return queries.mapInArrow(run, f"{fields}, leaf bigint")


def _scan(visits: DataFrame, placed: DataFrame, same: bool, most: int) -> DataFrame:
    """(qid, slot, score, vec_id): the ``most`` best rows of each leaf block for each window of each visit."""
    visits = store(visits, "visits")
    sizes = placed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"))
    asked = visits.groupBy(F.col("leaf").alias("_l")).agg(F.count(F.lit(1)).alias("m"))
    cut = lambda n, by: F.ceil(F.col(n) / F.lit(by)).cast("int")
    shapes = sizes.join(asked, F.col("leaf") == F.col("_l")).select("_l", cut("n", BLOCK).alias("blocks"), cut("m", PART).alias("parts"))
    shapes = F.broadcast(store(shapes, "shapes"))  # one row a leaf, SAMPLE at most
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    rows = placed.join(shapes, F.col("leaf") == F.col("_l")).select(
        "leaf", "label", "v", "ids", F.pmod(F.xxhash64("label", "v"), F.col("blocks")).cast("int").alias("block"), spread("parts").alias("part")
    )
    asks = visits.join(shapes, F.col("leaf") == F.col("_l")).select(
        *visits.columns, F.pmod(F.xxhash64("qid"), F.col("parts")).cast("int").alias("part"), spread("blocks").alias("block")
    )

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"qid": [], "slot": [], "score": [], "vec_id": []}
        if left.num_rows and right.num_rows:
            ids = right.column("ids").combine_chunks()
            row = np.repeat(np.arange(len(ids)), ids.value_lengths().to_numpy(zero_copy_only=False))
            ids, label = ids.flatten().to_numpy(), right.column("label").to_numpy()[row]
            scores = inner(_matrix(left.column("v")), _matrix(right.column("v")))
            asks = zip(*(left.column(c).to_pylist() for c in ("qid", "vec_id", "label", "lows", "highs")), strict=True)
            for i, (qid, own, of, lows, highs) in enumerate(asks):
                s = scores[i][row]
                allowed = ((label == of) if same else (label != of)) & (ids != own)
                for slot, (a, b) in enumerate(zip(lows, highs, strict=True)):
                    fit = np.flatnonzero(allowed & (s >= a) & (s <= b))
                    if len(fit) > most:
                        fit = fit[s[fit] >= np.partition(s[fit], -most)[-most]]
                    best = fit[np.lexsort((ids[fit], -s[fit]))[:most]]
                    for name, values in (("qid", [qid] * len(best)), ("slot", [slot] * len(best)), ("score", s[best].tolist()), ("vec_id", ids[best].tolist())):
                        out[name] += values
        return pa.table([pa.array(out["qid"], pa.int64()), pa.array(out["slot"], pa.int32()), pa.array(out["score"], pa.int64()), pa.array(out["vec_id"], pa.int64())], names=list(out))

    by = ["leaf", "block", "part"]
    return asks.groupBy(*by).cogroup(rows.groupBy(*by)).applyInArrow(compare, "qid bigint, slot int, score bigint, vec_id bigint")


def _best(found: DataFrame, most: int) -> DataFrame:
    """The ``most`` best of each query and slot, numbered by ``place`` from 1."""
    order = Window.partitionBy("qid", "slot").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def search(queries: DataFrame, placed: DataFrame, tree: Tree, same: bool, most: int = MOST) -> DataFrame:
    """(qid, slot, score, vec_id, place): the ``most`` best rows in each window of ``queries``.

    ``queries`` has qid, vec_id, label, v and the windows' ``lows`` and ``highs``,
    inclusive; rows of the same or of other labels count, never those with the
    query's id.  The nearest leaf is scanned first: a window in which it
    has enough rows starts at the last of these afterwards.
    """
    first = store(_best(_scan(_visits(queries, tree, True), placed, same, most), most), "nearest")
    last = first.where(F.col("place") == most).groupBy(F.col("qid").alias("_q")).agg(
        F.map_from_entries(F.collect_list(F.struct("slot", "score"))).alias("_last")
    )
    risen = F.transform("lows", lambda x, i: F.greatest(x, F.coalesce(F.try_element_at("_last", i), x)))
    narrow = queries.join(last, F.col("qid") == F.col("_q"), "left").withColumn("lows", risen).drop("_q", "_last")
    rest = _scan(_visits(store(narrow, "narrow"), tree, False), placed, same, most)
    return _best(first.drop("place").unionByName(rest), most)


def hard_negatives(rows: DataFrame, most: int = MOST, every: int = EVERY) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of ``rows`` (``vectors``).

    Anchors are the rows whose id ``every`` divides; positives are an anchor's
    ``most`` best other rows of its label; negatives of a positive are the
    ``most`` best rows of other labels with 80 to 100 hundredths of its score.
    Equal scores come in the order of the ids.  A positive below zero has no
    negatives.  An empty table gives an empty one.
    """
    placed, tree = index(points(rows, most))
    anchors = rows.where(F.col("vec_id") % every == 0).withColumn("qid", F.monotonically_increasing_id())
    anchors = store(anchors, "anchors")
    least, greatest = -(1 << 62), 1 << 62
    whole = anchors.withColumns({"lows": F.array(F.lit(least)), "highs": F.array(F.lit(greatest))})
    positives = store(search(whole, placed, tree, True, most), "positives")
    lists = positives.groupBy(F.col("qid").alias("_q")).agg(F.sort_array(F.collect_list(F.struct("place", "score"))).alias("_p"))
    windows = {
        # 80 p <= 100 n for whole numbers: n >= (4 p + 4) div 5; below zero that is above p
        "lows": F.expr(f"transform(_p, x -> if(x.score < 0, {greatest}, (4 * x.score + 4) div 5))"),
        "highs": F.transform("_p", lambda x: x["score"]),
    }
    asked = anchors.join(lists, F.col("qid") == F.col("_q")).withColumns(windows).select(*anchors.columns, "lows", "highs")
    negatives = search(store(asked, "asked"), placed, tree, False, most)
    named = positives.select("qid", (F.col("place") - 1).cast("int").alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return negatives.join(named, ["qid", "slot"]).join(anchors.select("qid", F.col("vec_id").alias("anchor_id")), "qid").select(
        "anchor_id",
        "positive_id",
        F.col("place").cast("int").alias("rank"),
        F.col("vec_id").alias("negative_id"),
        "positive_score",
        F.col("score").alias("negative_score"),
    )
