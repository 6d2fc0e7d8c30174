"""Scoring by context-tree weighting over bytes.

A byte is eight binary decisions; each decision has a node in the tree of the
bytes before it, for every depth from none to DEPTH.  A node estimates by
Krichevsky and Trofimov from its zeros and ones, and mixes that with what its
deeper nodes say, by how well either fitted the learned texts.  A text is its
lower-cased words with one space between and a line end after the last, so the
probabilities of all token sequences add up to one.

Texts are read twice.  The first reading counts, per stored partition of texts,
each sequence of DEPTH bytes and the next one, and each word.  The counts are
added up, the tree is weighted per pair of latest bytes (a subtree holds
its distinct sequences alone), and each partition gets back what its own sequences cost.  The
second reading looks these up, so no machine holds the whole model and nothing
is broadcast.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.dataset
from pyspark.sql import DataFrame, Window, functions as F

from planlens.llm.common import remainder, shared_files, store, store_path, text_steps, whole_text

#: Bytes of context; with the next byte they make a key, so 6 at most.
DEPTH = 5
END = b"\n"
LOG2 = float(np.log(2.0))


def tokens(text: bytes) -> list[bytes]:
    """Words with A-Z lowered; splitting bytes cuts at \\x20 and \\x09-\\x0D only."""
    return text.lower().split()


def sequences(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all positions of the normalised texts, and where each text starts.

    A key has the latest byte of context first and the next byte last; before a
    text come line ends.
    """
    data = np.frombuffer(b"".join([END * DEPTH + t + END for t in texts]), dtype=np.uint8)
    size = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    starts = np.cumsum(size) - size
    if not len(texts):
        return np.zeros(0, np.int64), starts
    n = len(data) - DEPTH
    key = data[DEPTH:].astype(np.int64)
    for back in range(1, DEPTH + 1):
        key |= data[DEPTH - back : DEPTH - back + n].astype(np.int64) << (8 * (DEPTH + 1 - back))
    inside = np.ones(n, dtype=bool)
    for k in range(DEPTH):  # the line ends before a text are context only
        inside[starts[1:] + DEPTH * np.arange(len(texts) - 1) + k] = False
    return key[inside], starts


class Places:
    """Where each of some sorted keys lies: one look into a table by digest, a binary search where two share a slot."""

    def __init__(self, key: np.ndarray):
        self.key, self.bits = key, max(10, int(8 * len(key)).bit_length())
        self.slots = np.zeros(1 << self.bits, dtype=np.int32)
        self.slots[self._slot(key)] = np.arange(len(key), dtype=np.int32)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).view(np.int64)

    def of(self, key: np.ndarray) -> np.ndarray:
        place = self.slots[self._slot(key)]
        other = np.flatnonzero(self.key[place] != key)
        place[other] = np.searchsorted(self.key, key[other])
        return place


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, place = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(place, np.concatenate([n for _, n in parts]), len(keys))


def counted(rows: DataFrame) -> DataFrame:
    """(kind, part, key, word, n) of stored ``rows`` (part, learn, text): how often texts to learn from have each; 0 for what only others have."""

    def flush(part: int, grams: list, words: Counter, others: set) -> Iterator[pa.RecordBatch]:
        key, n = _merged(grams)
        blank = pa.nulls(len(key), pa.binary())
        yield pa.RecordBatch.from_arrays(
            [pa.array(["gram"] * len(key)), pa.array(np.full(len(key), part, np.int64)), pa.array(key), blank, pa.array(n.astype(np.int64))],
            names=["kind", "part", "key", "word", "n"],
        )
        found = [*words.items(), *((w, 0) for w in others - words.keys())]
        for i in range(0, len(found), 50_000):
            word, n = zip(*found[i : i + 50_000], strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(["word"] * len(word)), pa.array([part] * len(word), pa.int64()), pa.nulls(len(word), pa.int64()), pa.array(word, pa.binary()), pa.array(n, pa.int64())],
                names=["kind", "part", "key", "word", "n"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, grams, words, others = None, [], Counter(), set()
        for batch in batches:
            for step, texts in text_steps(batch):
                parts, learn = step.column("part").to_numpy(), step.column("learn").to_numpy(zero_copy_only=False)
                for part in np.unique(parts):
                    if part != current and grams:
                        yield from flush(current, grams, words, others)
                        grams, words, others = [], Counter(), set()
                    current = part
                    for taught in (True, False):
                        chosen = np.flatnonzero((parts == part) & (learn == taught))
                        if not len(chosen):
                            continue
                        split = [tokens(texts[i]) for i in chosen]
                        key, n = np.unique(sequences([b" ".join(w) for w in split])[0], return_counts=True)
                        grams.append((key, n * taught))
                        if taught:
                            for w in split:
                                words.update(w)
                            words[END] += len(split)
                        else:
                            others.update([END], *split)
                if sum(len(k) for k, _ in grams) > 4_000_000:
                    grams = [_merged(grams)]
        if grams:
            yield from flush(current, grams, words, others)

    return rows.select("part", "learn", "text").mapInArrow(run, "kind string, part bigint, key bigint, word binary, n bigint")


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after eight steps up."""
    shift = sum(np.log(x + i) for i in range(8))
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


def log_estimate(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log probability of that many zeros and ones by Krichevsky and Trofimov."""
    return _log_gamma(zeros + 0.5) + _log_gamma(ones + 0.5) - np.log(np.pi) - _log_gamma(zeros + ones + 1.0)


class Level:
    """The nodes of one depth: every (context, decisions so far) that occurs."""

    def __init__(self, node: np.ndarray, bit: np.ndarray, n: np.ndarray):
        self.node, self.first, self.of = np.unique(node, return_index=True, return_inverse=True)
        ones = np.bincount(self.of, n * bit, len(self.node))
        self.set(np.bincount(self.of, n, len(self.node)) - ones, ones)

    def set(self, zeros: np.ndarray, ones: np.ndarray) -> None:
        self.zeros, self.ones = zeros, ones
        self.own = self.weighted = log_estimate(zeros, ones)

    def weigh(self, below: np.ndarray) -> None:
        """Mix with ``below``, the sum over the deeper nodes; without it a node is a leaf."""
        self.weighted = np.logaddexp(self.own, below) - LOG2

    def stay(self) -> np.ndarray:
        """Share of the mixture that the node's own estimate has."""
        return np.exp(self.own - LOG2 - self.weighted)

    def predicts(self, bit: np.ndarray | int) -> np.ndarray:
        return (np.where(bit, self.ones, self.zeros) + 0.5) / (self.zeros + self.ones + 1.0)


def subtree(key: np.ndarray, n: np.ndarray) -> tuple[list[Level], np.ndarray, np.ndarray]:
    """Levels DEPTH to 2 of sequences with the same two latest bytes, node within the byte, and bit of all decisions."""
    x = key & 255
    step = np.arange(8)[:, None]
    node = ((1 << step) | (x >> (8 - step))).ravel()
    bit = ((x >> (7 - step)) & 1).ravel()
    times, levels = np.tile(n, 8), []
    for depth in range(DEPTH, 1, -1):
        context = np.tile(key >> (8 * (DEPTH + 1 - depth)), 8)
        level = Level(context << 8 | node, bit, times)
        if levels:
            deeper = levels[-1]
            level.weigh(np.bincount(level.of[deeper.first], deeper.weighted, len(level.node)))
        levels.append(level)
    return levels, node, bit


def _subtree_tops(table: pa.Table) -> pa.Table:
    key, n = table.column("key").to_numpy(), table.column("n").to_numpy()
    top = subtree(key, n.astype(float))[0][-1]
    return pa.table({"node": top.node, "zeros": top.zeros, "ones": top.ones, "weighted": top.weighted})


def _upper(table: pa.Table) -> pa.Table:
    """For nodes of depth 2: what the depths 0 and 1 give to either bit, and the share left for the subtree."""
    node, zeros, ones, weighted = (table.column(c).to_numpy() for c in ("node", "zeros", "ones", "weighted"))
    levels, below = [], weighted
    at = node
    for depth in (1, 0):
        up = (at >> 16 << 8 if depth else np.zeros_like(at)) | (at & 255)
        names, of = np.unique(up, return_inverse=True)
        level = Level.__new__(Level)
        level.node, level.of = names, of
        level.set(np.bincount(of, zeros, len(names)), np.bincount(of, ones, len(names)))
        level.weigh(np.bincount(of, below, len(names)))
        levels.append(level)
        at, zeros, ones, below = names, level.zeros, level.ones, level.weighted
    one, zero = levels
    root = zero.of[one.of]
    stay0, stay1 = zero.stay()[root], one.stay()[one.of]
    given = [stay0 * zero.predicts(bit)[root] + (1 - stay0) * stay1 * one.predicts(bit)[one.of] for bit in (0, 1)]
    return pa.table({"pair": node >> 8, "node": node & 255, "given0": given[0], "given1": given[1], "left": (1 - stay0) * (1 - stay1)})


def _costs(table: pa.Table, upper: pa.Table) -> pa.Table:
    key, n = table.column("key").to_numpy(), table.column("n").to_numpy()
    levels, node, bit = subtree(key, n.astype(float))
    p = None
    for level in levels:
        own = level.predicts(0)[level.of], level.predicts(1)[level.of]
        own = np.where(bit, own[1], own[0])
        stay = level.stay()[level.of] if p is not None else 1.0
        p = own if p is None else stay * own + (1 - stay) * p
    given, left = np.zeros((2, 256)), np.zeros(256)
    at = upper.column("node").to_numpy()
    given[0, at], given[1, at], left[at] = (upper.column(c).to_numpy() for c in ("given0", "given1", "left"))
    p = given[bit, node] + left[node] * p
    return pa.table({"key": key, "cost": np.log10(p).reshape(8, -1).sum(axis=0)})


def costs(grams: DataFrame) -> DataFrame:
    """(key, cost) for each key of ``grams`` (key, n): log10 probability of its last byte after the others."""
    pair = F.shiftright("key", 8 * (DEPTH - 1))
    total = store(grams.groupBy("key").agg(F.sum("n").alias("n")).withColumn("pair", pair), "sequences")
    tops = total.groupBy("pair").applyInArrow(_subtree_tops, "node bigint, zeros double, ones double, weighted double")
    # the nodes of depth 2: at most 2^16 contexts of 255 decisions, whatever the corpus
    upper = tops.groupBy().applyInArrow(
        _upper, "pair bigint, node bigint, given0 double, given1 double, left double"
    )
    return total.groupBy("pair").cogroup(upper.groupBy("pair")).applyInArrow(_costs, "key bigint, cost double")


def _read_part(folder: str, part: int, columns: list[str]) -> pa.Table:
    files, path = shared_files(f"{folder}/part={part}")
    return pa.dataset.dataset(path, filesystem=files, format="parquet").to_table(columns=columns)


def score(docs: DataFrame, modulus: int = 7, held_out: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte for every row of ``docs`` (doc_id, text).

    Learns from rows whose crc32(doc_id) modulo ``modulus`` is not ``held_out``
    (a missing id counts as the empty text).  base_score is that of single
    tokens with one added to each count; score is the tree's log10 probability;
    bits_per_byte is its code length over the coded bytes: words joined by one
    space, and the end.
    Missing and empty texts are the end token alone; repeated rows are learned
    and scored each; other columns are ignored; an empty table, or one to learn
    nothing from, gives defined numbers too.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col("doc_id"),
        (remainder(F.col("doc_id"), modulus) != held_out).alias("learn"),
        whole_text(F.col("text")).alias("text"),
        F.spark_partition_id().cast("long").alias("part"),
    )
    rows = store(rows, "texts")  # fixes which texts are one part
    found = store(counted(rows), "counts", "kind")
    grams = found.where("kind = 'gram'")
    cost_path, word_path = store_path(spark, "costs"), store_path(spark, "words")
    by_part = grams.select("part", "key").join(costs(grams.select("key", "n")), "key")
    by_part.repartition("part").sortWithinPartitions("part", "key").write.partitionBy("part").parquet(cost_path)
    same = Window.partitionBy("word")
    known = found.where("kind = 'word'").select("part", "word", "n")
    known = known.withColumns({"c": F.sum("n").over(same), "once": F.row_number().over(same.orderBy("part")) == 1})
    known.repartition("part").write.partitionBy("part").parquet(word_path)
    written = spark.read.schema("word binary, n bigint, c bigint, once boolean, part bigint").parquet(word_path)
    n, v = written.agg(
        F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum((F.col("once") & (F.col("c") > 0)).cast("long")), F.lit(0))
    ).first()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, places, cost, words = None, None, None, {}
        for batch in batches:
            for step, texts in text_steps(batch):
                parts = step.column("part").to_numpy()
                edges = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(parts)]
                out = []
                for a, b in zip(edges, edges[1:], strict=False):
                    if parts[a] != held:
                        held = parts[a]
                        table = _read_part(cost_path, held, ["key", "cost"])
                        key, cost = table.column("key").to_numpy(), table.column("cost").to_numpy()
                        order = np.argsort(key, kind="stable")
                        places, cost = Places(key[order]), cost[order]
                        table = _read_part(word_path, held, ["word", "c"])
                        words = dict(zip(table.column("word").to_pylist(), table.column("c").to_pylist(), strict=True))
                    split = [tokens(t) for t in texts[a:b]]
                    codes, starts = sequences([b" ".join(w) for w in split])
                    scores = np.add.reduceat(cost[places.of(codes)], starts)
                    rates = scores / (-np.log10(2.0) * np.diff(starts, append=len(codes)))
                    for w, s, rate in zip(split, scores.tolist(), rates.tolist(), strict=True):
                        c = np.fromiter(map(words.__getitem__, [*w, END]), dtype=np.int64, count=len(w) + 1)
                        base = float(np.log10((c + 1) / (n + v + 1)).sum())
                        out.append((len(c), int((c > 0).sum()), base, s, rate))
                size, known_size, base, s, rate = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        step.column("doc_id"),
                        pa.compute.invert(step.column("learn")),
                        pa.array(size, pa.int64()),
                        pa.array(known_size, pa.int64()),
                        pa.array([n] * len(size), pa.int64()),
                        pa.array(base, pa.float64()),
                        pa.array(s, pa.float64()),
                        pa.array(rate, pa.float64()),
                    ],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"],
                )

    kind = rows.schema["doc_id"].dataType.simpleString()
    found = "n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, bits_per_byte double"
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, {found}")
