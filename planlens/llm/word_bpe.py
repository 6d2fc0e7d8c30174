"""BPE encoding and decoding by merge rounds over one flat array of symbols.

The symbols of many distinct words lie in one numpy array.  A round looks up
all neighbouring pairs by binary search in the sorted keys of the known pairs,
takes the lowest rank of each word and merges all its places from the left;
words without a known pair leave the array.  That equals merging one place at a
time, since every merge makes a symbol of its own, so a new pair always ranks
after the one just merged.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from planlens.llm.common import text_steps, whole_text

#: White space as Unicode defines it; fixed values.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Beyond these characters case, composition and classes are left to the tokenizer file's own steps.
UNUSUAL = regex.compile("[^\\x00-\\u024f]")
#: Words that one Python worker remembers before it starts anew.
REMEMBERED = 300_000


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    table = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [table[b] for b in range(256)]


class WordBpe:
    """Encoder and decoder for a tokenizer file with word ends (lower case, white space dropped)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, vocab = spec["model"], spec["model"]["vocab"]
        end = model["end_of_word_suffix"] or ""
        self.specials = {x["content"]: x["id"] for x in spec["added_tokens"]}
        names = vocab | self.specials
        self.tokens = np.empty(max(names.values()) + 1, dtype=object)
        for token, i in names.items():
            self.tokens[i] = token
        self.width = np.int64(len(self.tokens))
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left, right, made = (
            np.array(x, dtype=np.int64)
            for x in zip(*((vocab[a], vocab[b], vocab[a + b]) for a, b in pairs), strict=True)
        )
        keys = left * self.width + right
        order = np.argsort(keys)
        self.keys, self.rank, self.made = keys[order], order.astype(np.int64), made[order]
        signs = byte_characters()
        self.first = np.array([vocab[c] for c in signs], dtype=np.int64)
        self.last = np.array([vocab[c + end] for c in signs], dtype=np.int64)
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pattern = regex.compile(pattern.replace("\\s", SPACE))
        self.special_pattern = regex.compile("(" + "|".join(map(regex.escape, self.specials)) + ")")
        self.path, self.library = path, None
        self.forget()

    def forget(self) -> None:
        self.index = {token: i for i, token in enumerate(self.specials)}
        self.flat = np.array(list(self.specials.values()), dtype=np.int32)
        self.starts = np.arange(len(self.specials) + 1, dtype=np.int64)

    def _words(self, text: str) -> list[str]:
        if not UNUSUAL.search(text):
            return self.pattern.findall((text if text.isascii() else unicodedata.normalize("NFC", text)).lower())
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
        plain = self.library.normalizer.normalize_str(text)
        return [plain[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(plain)]

    def words(self, text: str) -> list[str]:
        """The words of a text; strings of special tokens are words of their own."""
        if "<|" not in text:
            return self._words(text)
        parts = self.special_pattern.split(text)
        return [w for i, part in enumerate(parts) for w in ([part] if i % 2 else self._words(part))]

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and where each word's ids start (with the end)."""
        raw = [w.encode() for w in words]
        size = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        data = np.frombuffer(b"".join(raw), dtype=np.uint8)
        symbol, word = self.first[data], np.repeat(np.arange(len(raw)), size)
        ends = np.cumsum(size)[size > 0] - 1
        symbol[ends] = self.last[data[ends]]
        done = []
        while len(symbol):
            key = symbol[:-1] * self.width + symbol[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            found = np.flatnonzero((word[:-1] == word[1:]) & (self.keys[at] == key))
            open_words = word[found]
            heads = np.flatnonzero(np.diff(open_words, prepend=-1))
            going = np.isin(word, open_words[heads])
            done.append((word[~going], symbol[~going]))
            if not len(found):
                break
            rank = self.rank[at[found]]
            lowest = np.repeat(np.minimum.reduceat(rank, heads), np.diff(heads, append=len(found)))
            place = found[rank == lowest]
            run = np.flatnonzero(np.diff(place, prepend=-2) != 1)
            within = np.arange(len(place)) - np.repeat(run, np.diff(run, append=len(place)))
            place = place[within % 2 == 0]
            symbol[place] = self.made[at[place]]
            going[place + 1] = False
            symbol, word = symbol[going], word[going]
        word, symbol = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (list(zip(*done)) or [[], []]))
        order = np.argsort(word, kind="stable")
        starts = np.concatenate([[0], np.cumsum(np.bincount(word, minlength=len(words)))])
        return symbol[order].astype(np.int32), starts

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's ids start (with the end)."""
        by_text = [self.words(t) for t in texts]
        words = [w for ws in by_text for w in ws]
        new = list(set(words) - self.index.keys())
        if new:
            if len(self.index) + len(new) > REMEMBERED:
                self.forget()
                new = list(set(words) - self.index.keys())
            ids, starts = self.merge(new)
            self.index.update(zip(new, range(len(self.index), len(self.index) + len(new)), strict=True))
            self.starts = np.concatenate([self.starts, self.starts[-1] + starts[1:]])
            self.flat = np.concatenate([self.flat, ids])
        which = np.fromiter(map(self.index.__getitem__, words), dtype=np.int64, count=len(words))
        start, size = self.starts[which], np.diff(self.starts)[which]
        stop = np.cumsum(size)
        take = np.arange(stop[-1] if len(stop) else 0) + np.repeat(start - (stop - size), size)
        last_word = np.cumsum([len(ws) for ws in by_text], dtype=np.int64)
        return self.flat[take], np.concatenate([[0], stop])[np.concatenate([[0], last_word])]

    def decode(self, ids: np.ndarray, starts: Iterable[int]) -> list[str]:
        """The text of each row of ids: its tokens joined by one space, as without a decoder in the file."""
        tokens, edges = self.tokens[ids].tolist(), list(starts)
        return [" ".join(tokens[a:b]) for a, b in zip(edges, edges[1:], strict=False)]


@lru_cache(maxsize=2)
def load(path: str) -> WordBpe:
    return WordBpe(path)


def encode_decode(docs: DataFrame, path: str, *keep: str, text: str = "text") -> DataFrame:
    """Columns ``keep``, ``ids`` (array of int) and ``decoded`` for every row.

    ``path`` names the tokenizer file on every machine.  A missing or empty
    text has no ids and decodes to the empty text; very long texts are encoded
    whole; equal rows stay separate; other columns, whatever their names, are
    dropped; an empty table gives an empty one.
    """
    rows = docs.select(whole_text(F.col(text)).alias("_text"), F.struct(*keep).alias("_kept"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            for part, texts in text_steps(batch, "_text"):
                ids, starts = bpe.encode([t.decode() for t in texts])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("_kept"),
                        pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(ids, pa.int32())),
                        pa.array(bpe.decode(ids, starts), pa.string()),
                    ],
                    names=["_kept", "ids", "decoded"],
                )

    kept = rows.schema["_kept"].dataType.simpleString()
    out = rows.mapInArrow(run, f"_kept {kept}, ids array<int>, decoded string")
    return out.select("_kept.*", "ids", "decoded")
