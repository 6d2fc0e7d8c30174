"""Token ids in length-delimited binary record files with a separate offset index.

A record is the payload's length (8 bytes), a masked checksum of these bytes
(4), the payload and a masked checksum of the payload (4).  The payload is the
document id (8, signed), one byte that is 1 if there is an id, one byte with
the bytes per token id (2 or 4) and the ids.  All numbers are little-endian.
Checksums are CRC-32, rotated and shifted as record files commonly do, so that
the checksum of data holding checksums stays useful.

A shard is one file of consecutive documents.  The index, a Parquet table, has
file, offset and length of every record, so that any order can be read without
scanning.  A file's name carries its attempt and only the index names files:
what a lost or repeated task left behind is never read.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from planlens.llm.common import shared_files, text_steps, whole_text

HEAD = struct.Struct("<QI")
PAYLOAD = struct.Struct("<qBB")
TAIL = struct.Struct("<I")
INDEX = "doc_id bigint, shard int, file string, offset bigint, length bigint, before bigint, n_tokens bigint"
#: Constants of the usual masking of record checksums; fixed values.
MASK_SHIFT, MASK_DELTA = 15, 0xA282EAD8
#: The splitting pattern of byte-level BPE, with Unicode's white space spelled out; fixed values.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
PIECES = f"'s|'t|'re|'ve|'m|'ll|'d| ?\\p{{L}}+| ?\\p{{N}}+| ?[^{SPACE}\\p{{L}}\\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
#: Pieces in one generation that a Python worker remembers.
REMEMBERED = 300_000
BUFFER = 8 << 20


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> MASK_SHIFT) | (crc << (32 - MASK_SHIFT))) + MASK_DELTA) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: np.ndarray) -> bytes:
    """One record."""
    wide = bool(len(ids)) and int(ids.max()) > 0xFFFF
    payload = PAYLOAD.pack(doc_id or 0, doc_id is not None, 4 if wide else 2) + ids.astype("<u4" if wide else "<u2").tobytes()
    length = struct.pack("<Q", len(payload))
    return length + TAIL.pack(masked(length)) + payload + TAIL.pack(masked(payload))


def unframe(read: Callable[[int], bytes]) -> tuple[int | None, np.ndarray] | None:
    """The next record, or None at the end; ValueError where a checksum or length is wrong."""
    head = read(HEAD.size)
    if not head:
        return None
    if len(head) < HEAD.size:
        raise ValueError("record cut off in its head")
    size, check = HEAD.unpack(head)
    if masked(head[:8]) != check:
        raise ValueError("length of a record is damaged")
    body = read(size + TAIL.size)
    if len(body) < size + TAIL.size:
        raise ValueError("record cut off in its payload")
    payload = body[:size]
    if masked(payload) != TAIL.unpack(body[size:])[0]:
        raise ValueError("payload of a record is damaged")
    doc_id, has_id, width = PAYLOAD.unpack_from(payload)
    return doc_id if has_id else None, np.frombuffer(payload, f"<u{width}", offset=PAYLOAD.size).astype("<u4")


def byte_letters() -> dict[int, str]:
    """The letter by which byte-level BPE writes each byte: printable Latin ones as they are, the others from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    others = sorted(set(range(256)) - set(plain))
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class Pieces(dict):
    """Ids of whole texts by the tokenizers library, which sees each distinct piece of text once.

    Maps a piece to its ids.  Where no white space stands beside a space or a
    line end, a text is cut before every space and around every line end: a
    token never crosses such a place, so a piece alone is encoded as it is
    within the text.  A piece of several parts by the tokenizer's own pattern
    is looked up part by part; a single part goes to the library's model.
    Other texts are cut by the pattern at once, and those with special tokens
    or with characters beyond the Latin ones go to the library whole.  Two
    generations of pieces are remembered.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__()
        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        specials = [regex.escape(t.content) for t in self.library.get_added_tokens_decoder().values()]
        self.whole = re.compile("|".join(["[^\\x00-\u024f]", *specials]))
        self.pattern = regex.compile(PIECES)
        self.beside = [x for c in "\t\n\v\f\r \x85\xa0" for x in (" " + c, c + " ")]
        self.beside += [x for c in "\t\v\f\r\x85\xa0" for x in ("\n" + c, c + "\n")] + ["\n\n"]
        self.letters = byte_letters()
        self.older: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            parts = [piece] if piece.removeprefix(" ").isalpha() else self.pattern.findall(piece)
            if len(parts) != 1:
                ids = b"".join([self[p] for p in parts])
            else:
                found = self.model.tokenize(piece.encode().decode("latin-1").translate(self.letters))
                ids = np.array([t.id for t in found], dtype="<u4").tobytes()
        self[piece] = ids
        return ids

    def _pieces(self, text: str) -> list[str] | None:
        if (not text.isascii() or "<|" in text) and self.whole.search(text):
            return None
        if "\0" in text or text[:1] == " " or text[-1:] == " " or any(x in text for x in self.beside):
            return self.pattern.findall(text)
        return text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")

    def ids(self, text: str) -> np.ndarray:
        pieces = self._pieces(text)
        if pieces is None:
            return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4")
        if len(self) > REMEMBERED:
            self.older = dict(self)
            self.clear()
        return np.frombuffer(b"".join(map(self.__getitem__, pieces)), dtype="<u4")

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [self.ids(t) for t in texts]


@lru_cache(maxsize=2)
def load(path: str) -> Pieces:
    return Pieces(path)


def write_records(docs: DataFrame, folder: str, tokenizer: str, end_id: int, text: str = "text") -> DataFrame:
    """Write all of ``docs`` in ascending doc_id (missing first; ties by a digest of the text, then the text) and return the index.

    ``folder`` must be shared by all machines.  Every document's ids end with
    ``end_id``; a missing or empty text is that id alone.  Repeated rows are
    repeated records; an empty table has an empty index.  Rows that share an id,
    or have none, are cut into tasks by the digest.  Only the ids, offsets
    and sizes pass through Spark again, a task holds one record at a time.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text(F.col(text)).alias("_text"))
    order = ["doc_id", F.xxhash64("_text"), "_text"]
    rows = rows.repartitionByRange(*order[:2]).sortWithinPartitions(*order)
    names = ["doc_id", "shard", "file", "offset", "length", "before", "n_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, end = load(tokenizer), np.array([end_id], dtype="<u4")
        shard = TaskContext.get().partitionId()
        store, base = shared_files(folder)
        store.create_dir(base, recursive=True)
        file = f"part-{shard:06d}-{uuid.uuid4().hex}.records"
        offset = before = 0
        with store.open_output_stream(f"{base}/{file}", buffer_size=BUFFER) as out:
            for batch in batches:
                for part, texts in text_steps(batch, "_text"):
                    table = []
                    for doc_id, ids in zip(
                        part.column("doc_id").to_pylist(), coder.encode([t.decode() for t in texts]), strict=True
                    ):
                        record = frame(doc_id, np.concatenate([ids, end]))
                        out.write(record)
                        table.append((doc_id, shard, file, offset, len(record), before, len(ids) + 1))
                        offset += len(record)
                        before += len(ids) + 1
                    kinds = [pa.int64(), pa.int32(), pa.string()] + [pa.int64()] * 4
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, k) for c, k in zip(zip(*table, strict=True), kinds, strict=True)], names=names
                    )

    rows.mapInArrow(run, INDEX).write.parquet(f"{folder}/index")
    return read_index(spark, folder)


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(f"{folder}/index")


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """Every record of all files in the index, read front to back: doc_id, shard, position, ids."""
    return _read_files(index, folder, False)


def record_sums(index: DataFrame, folder: str) -> DataFrame:
    """As ``read_records``, but with n_tokens and ids_crc32 (of the ids as unsigned 32-bit numbers) in place of ids."""
    return _read_files(index, folder, True)


def _read_files(index: DataFrame, folder: str, sums: bool) -> DataFrame:
    files = index.groupBy("shard", "file").agg(F.count("*").alias("records"))
    tasks = max(1, index.select("shard").distinct().count())
    spread = files.repartitionByRange(tasks, "shard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = shared_files(folder)
        for row in (r for batch in batches for r in batch.to_pylist()):
            position = 0
            with store.open_input_stream(f"{base}/{row['file']}", buffer_size=BUFFER) as source:
                part, held = [], 0
                while (record := unframe(source.read)) is not None:
                    part.append((position, *record))
                    position, held = position + 1, held + len(record[1])
                    if held > BUFFER // 4:
                        yield _batch(part, row["shard"], sums)
                        part, held = [], 0
                if part:
                    yield _batch(part, row["shard"], sums)
            if position != row["records"]:
                raise ValueError(f"{row['file']} has {position} records, the index {row['records']}")

    more = "n_tokens bigint, ids_crc32 bigint" if sums else "ids array<bigint>"
    return spread.mapInArrow(run, f"doc_id bigint, shard int, position bigint, {more}")


def _batch(part: list[tuple[int, int | None, np.ndarray]], shard: int, sums: bool) -> pa.RecordBatch:
    position, doc_id, ids = zip(*part, strict=True)
    columns = {"doc_id": pa.array(doc_id, pa.int64()), "shard": pa.array([shard] * len(part), pa.int32()), "position": pa.array(position, pa.int64())}
    if sums:
        columns |= {"n_tokens": pa.array([len(x) for x in ids], pa.int64()), "ids_crc32": pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64())}
    else:
        columns["ids"] = pa.array([x.astype(np.int64) for x in ids], pa.list_(pa.int64()))
    return pa.RecordBatch.from_pydict(columns)


def read_shuffled(index: DataFrame, folder: str, seed: int, tasks: int) -> DataFrame:
    """doc_id and ids in an order drawn from ``seed``, fetched record by record through the index."""
    draw = F.xxhash64(F.lit(seed), "file", "offset")
    order = index.withColumn("_draw", draw).repartitionByRange(tasks, "_draw").sortWithinPartitions("_draw")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = shared_files(folder)
        for batch in batches:
            part, held = [], 0
            for row in batch.to_pylist():
                with store.open_input_file(f"{base}/{row['file']}") as source:
                    source.seek(row["offset"])
                    part.append((0, *unframe(source.read)))
                held += len(part[-1][2])
                if held > BUFFER // 4:
                    yield _batch(part, row["shard"], False).select(["doc_id", "ids"])
                    part, held = [], 0
            if part:
                yield _batch(part, row["shard"], False).select(["doc_id", "ids"])

    return order.select("file", "offset", "shard").mapInArrow(run, "doc_id bigint, ids array<bigint>")


def starts(index: DataFrame) -> DataFrame:
    """(shard, start): ids in all shards before; one row a shard, counted from the index."""
    shards = index.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return shards.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))


def read_with_starts(index: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every record, from the files; start counts the ids of all records before.

    The order within a shard is the order of its file, so only counts per shard
    are added up across shards.  The records meet them in the shuffle that the
    window needs: the optimizer takes the records for as few as the files they
    are read from, and would broadcast them.
    """
    records = record_sums(index, folder).hint("merge").join(starts(index), "shard")
    within = Window.partitionBy("shard").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("start") + F.coalesce(F.sum("n_tokens").over(within), F.lit(0))
    return records.select("doc_id", start.alias("start"), "n_tokens", "ids_crc32")
