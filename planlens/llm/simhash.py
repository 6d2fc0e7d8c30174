"""SimHash near-duplicates by pigeonhole blocks.

A 64-bit fingerprint is cut into ``blocks`` parts.  Two fingerprints that
differ in at most ``distance`` bits agree in at least ``blocks - distance``
parts, so they share one of the keys made of that many parts.  Equal keys are
brought together, candidates verified by their Hamming distance, and only a
spanning set of links leaves a group: a search from one fingerprint takes away
all it reaches before the next one starts, so a group of near copies costs
about its size and emits no pairs.  Exact copies share a fingerprint and are
one node from the start.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from planlens.llm.common import keyed, repeated, store, text_steps, whole_text

WORDS_PER_SHINGLE = 4
SEED = 42
DISTANCE = 4
BLOCKS = 7
#: Shingles whose hashes are held at a time.
HASHES = 1 << 17


def fingerprint(text: bytes, words: int = WORDS_PER_SHINGLE) -> int:
    """Majority bits of the shingles' hashes; zero without a word."""
    tokens = text.lower().split()  # of bytes: lowers A-Z alone, splits at \x20 and \x09-\x0D
    if not tokens:
        return 0
    n = max(1, len(tokens) - words + 1)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, HASHES):
        part = tokens[at : min(at + HASHES, n) + words - 1]
        shingles = zip(*(part[k:] for k in range(words)), strict=False) if len(tokens) >= words else [tokens]
        digests = [xxhash.xxh64_intdigest(b" ".join(s), SEED) for s in shingles]
        bits = np.unpackbits(np.array(digests, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(sum(1 << i for i in np.flatnonzero(2 * ones > n).tolist()))


def fingerprints(docs: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """Columns ``keep`` and ``fp``, the fingerprint as a signed long."""
    rows = docs.select(whole_text(F.col(text)).alias("_text"), F.struct(*keep).alias("_kept"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_steps(batch, "_text"):
                prints = np.array([fingerprint(t) for t in texts], dtype=np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [part.column("_kept"), pa.array(prints.view(np.int64))], names=["_kept", "fp"]
                )

    kept = rows.schema["_kept"].dataType.simpleString()
    return rows.mapInArrow(run, f"_kept {kept}, fp bigint").select("_kept.*", "fp")


def block_keys(fps: np.ndarray, blocks: int, distance: int) -> np.ndarray:
    """For each fingerprint the keys of all choices of ``blocks - distance`` parts; the choice is hashed in."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    keys = []
    for number, chosen in enumerate(combinations(range(blocks), blocks - distance)):
        mask = sum(((1 << (edges[b + 1] - edges[b])) - 1) << edges[b] for b in chosen)
        mixed = (fps & np.uint64(mask)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(number)
        keys.append(mixed)  # one to one for each choice: an odd factor; choices that meet only add candidates
    return np.stack(keys, axis=1)


def spanning_links(fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """(member, smallest member) for all that reach another fingerprint of the group by links."""
    left, members, heads = np.sort(fps), [], []
    while len(left) > 1:
        head, queue, left = left[0], [left[:1]], left[1:]
        while queue and len(left):
            for f in queue.pop():
                near = np.bitwise_count(left ^ f) <= distance
                if near.any():
                    queue.append(left[near])
                    members.append(left[near])
                    heads.append(np.full(int(near.sum()), head))
                    left = left[~near]
    if not members:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return np.concatenate(members), np.concatenate(heads)


def links(fps: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS) -> DataFrame:
    """Links (u, v) between distinct fingerprints that span all groups of linked ones; ``fps`` has one column fp."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 20_000):
                column = batch.column(0).slice(at, 20_000).to_numpy(zero_copy_only=False)
                keys = block_keys(column.view(np.uint64), blocks, distance)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(column, keys.shape[1]))],
                    names=["key", "fp"],
                )

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by key; the last group of a batch waits for the next batch."""
        rest_key, rest_fp = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def found(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            edge = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [len(key)]])
            size = np.diff(edge)
            lone = np.repeat(size, size) == 2
            a, b = fp[lone][0::2], fp[lone][1::2]
            near = np.bitwise_count((a ^ b).view(np.uint64)) <= distance
            us, vs = [a[near]], [b[near]]
            for g in np.flatnonzero(size > 2):
                u, v = spanning_links(np.unique(fp[edge[g] : edge[g + 1]].view(np.uint64)), distance)
                us.append(u.view(np.int64))
                vs.append(v.view(np.int64))
            u, v = np.concatenate(us), np.concatenate(vs)
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], names=["u", "v"])

        for batch in batches:
            key = np.concatenate([rest_key, batch.column(0).to_numpy(zero_copy_only=False)])
            fp = np.concatenate([rest_fp, batch.column(1).to_numpy(zero_copy_only=False)])
            last = np.searchsorted(key, key[-1])
            yield found(key[:last], fp[:last])
            rest_key, rest_fp = key[last:], fp[last:]
        yield found(rest_key, rest_fp)

    keyed = fps.mapInArrow(spread, "key bigint, fp bigint")
    grouped = keyed.repartition("key").sortWithinPartitions("key", "fp")
    return grouped.mapInArrow(verify, "u bigint, v bigint").where("u <> v").distinct()


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, root) for all nodes of ``edges`` (u, v); root is the smallest node reachable.

    Alternates large-star and small-star steps until nothing changes; each
    round is a stored table, so neither lineage nor the driver grows.
    """

    def state(df: DataFrame) -> tuple:
        row = df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return tuple(row)

    def star(df: DataFrame, larger_only: bool) -> DataFrame:
        turned = df.select(F.col("v").alias("u"), F.col("u").alias("v"))
        around = df.unionByName(turned) if larger_only else df.select(
            F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
        )
        low = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        joined = around.join(low, "u")
        if larger_only:
            out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
                low.select("u", F.col("m").alias("v"))
            )
        return out.where("u <> v").distinct()

    current = store(edges, "links")
    before = state(current)
    for _ in range(rounds):
        if not before[0]:
            break
        current = store(star(star(current, True), False), "stars")
        now = state(current)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    stars = current.select(F.greatest("u", "v").alias("node"), F.least("u", "v").alias("root"))
    roots = stars.select(F.col("root").alias("node"), "root").distinct()
    return stars.unionByName(roots)


def with_components(prints: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS) -> DataFrame:
    """Adds ``root`` (a fingerprint that names the group) and ``component_id`` to rows with doc_id and fp.

    component_id is the smallest doc_id reachable over links, the row's own
    included; rows without words share fingerprint zero and link like others;
    missing ids are ignored for the smallest, so a group of missing ids alone
    has none.  Copies are never expanded into pairs.
    """
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("low"))
    found = components(links(nodes.select("fp"), distance, blocks))
    rooted = nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "low", F.coalesce("root", "fp").alias("root")
    )
    rooted = store(rooted, "rooted")
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    return prints.join(rooted.join(lowest, "root").select("fp", "root", "component_id"), "fp")


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS) -> DataFrame:
    """doc_id, fp, root, component_id for every row of ``docs`` (doc_id, text; other columns are ignored).

    Fewer words than a shingle: the whole sequence is the shingle; missing and
    empty texts have fingerprint zero.  Repeated rows each come back; an empty
    table gives an empty one.
    """
    return with_components(store(fingerprints(docs, "doc_id"), "prints"), distance, blocks)


def one_of_each(docs: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS) -> DataFrame:
    """The rows of ``docs``, all columns, without near-duplicates: the smallest doc_id of each group stays.

    Of rows that repeat that id one stays, and of a group with missing ids only
    likewise one.
    """
    rows = keyed(docs).select("_h1", "_h2", F.col("_row.doc_id").alias("doc_id"), F.col("_row.text").alias("text"))
    prints = store(fingerprints(rows, "_h1", "_h2", "doc_id"), "prints")
    groups = with_components(prints, distance, blocks)
    least = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_h1", "_h2")).alias("k")
    kept = groups.groupBy("root").agg(least).select("k._h1", "k._h2", F.lit(1).alias("_n"))
    return repeated(docs, kept)
