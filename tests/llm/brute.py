"""Plain single-machine versions of the operators' results, for small tables."""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import xxhash

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def words(text: str | None) -> list[str]:
    return SPLIT.findall(text or "")


def ascii_lower(text: str) -> str:
    return text.encode().lower().decode()


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def remainder(doc_id: int | None, modulus: int) -> int:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % modulus


def base_counts(text: str | None) -> dict:
    w, text = words(text), text or ""
    windows: dict[tuple, list[int]] = {}
    for i in range(len(w) - 2):
        windows.setdefault(tuple(w[i : i + 3]), []).append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(3)}
    lines = [x for x in text.split("\n") if SPLIT.search(x)]
    out = {
        "n_words": len(w),
        "word_chars": sum(map(len, w)),
        "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered),
    }
    return out | {"base_failed": len(w) < 50 or 100 * len(covered) > 50 * len(w)}


def simhash(text: str | None) -> int:
    w = words(ascii_lower(text or ""))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(n: int, linked) -> list[int]:
    """The smallest index reachable from each of n, over pairs (i, j) with ``linked``."""
    root = list(range(n))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(n):
        for j in np.flatnonzero(linked(i)):
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]
