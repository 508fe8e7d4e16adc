"""Vectorised word and shingle hashing over whole texts.

Words are maximal runs of bytes other than ASCII white space (0x20, 0x09-0x0D), after
lower-casing A-Z only.  Everything works on UTF-8 bytes: no byte of a multi-byte
character lies in the ASCII range, so splitting bytes equals splitting code points.
"""

from __future__ import annotations

import numpy as np

#: Bytes hashed at a time; longer texts go through in pieces cut at white space.
PIECE = 1 << 20
_R = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_tables: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer of SplitMix64, in place where possible."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _powers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if "bytes" not in _tables:
        _tables["bytes"] = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
    if "up" not in _tables or len(_tables["up"]) <= n:
        for name, base in (("up", _R), ("down", pow(_R, -1, 1 << 64))):
            steps = np.full(n + 1, base & _MASK, dtype=np.uint64)
            steps[0] = 1
            _tables[name] = np.cumprod(steps, dtype=np.uint64)
    return _tables["bytes"], _tables["up"], _tables["down"]


def _hash_piece(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and start offsets of the words of raw (already lower-cased)."""
    buf = np.frombuffer(raw, dtype=np.uint8)
    n = len(buf)
    gap = np.ones(n + 2, dtype=bool)
    np.less_equal(buf - np.uint8(9), 4, out=gap[1:-1])
    gap[1:-1] |= buf == 32
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    start, end = edge[::2], edge[1::2]
    table, up, down = _powers(n)
    total = np.empty(n + 1, dtype=np.uint64)
    total[0] = 0
    np.cumsum(table[buf] * up[:n], dtype=np.uint64, out=total[1:])
    h = (total[end] - total[start]) * down[start]
    h += (end - start).astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
    return mix(h), start


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit word hashes of all texts in order, and for each text its number of words."""
    hashes, counts = [], np.zeros(len(texts), dtype=np.int64)
    first = 0
    while first < len(texts):
        last, size = first, 0
        while last < len(texts) and (last == first or size + len(texts[last]) < PIECE):
            size += len(texts[last]) + 1
            last += 1
        if last == first + 1 and size > 2 * PIECE:
            for part in _cut(texts[first]):
                h, _ = _hash_piece(part)
                hashes.append(h)
                counts[first] += len(h)
        else:
            h, start = _hash_piece(b"\n".join(texts[first:last]).lower())
            ends = np.cumsum([len(t) + 1 for t in texts[first:last]])
            counts[first:last] = np.diff(np.searchsorted(start, ends, side="left"), prepend=0)
            hashes.append(h)
        first = last
    return (np.concatenate(hashes) if hashes else np.empty(0, np.uint64)), counts


def _cut(text: bytes):
    """Pieces of about PIECE bytes of one long text, none of which ends inside a word."""
    at = 0
    while at < len(text):
        stop = min(at + PIECE, len(text))
        while stop < len(text) and text[stop] not in b" \t\n\x0b\x0c\r":
            stop += 1
        yield text[at:stop].lower()
        at = stop


def shingle_sets(texts: list[bytes], width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted within it, and each text's number of them.

    A text with fewer than width words, but not none, has its whole sequence as one shingle.
    """
    words, counts = word_hashes(texts)
    doc = np.repeat(np.arange(len(texts)), counts)
    short = (counts > 0) & (counts < width)
    n = len(words)
    m = max(0, n - width + 1)
    shingles = np.zeros(m, dtype=np.uint64)
    for k in range(width):
        shingles *= np.uint64(_R)
        shingles += words[k : k + m]
    keep = doc[:m] == doc[width - 1 : width - 1 + m]
    h, d = mix(shingles[keep]), doc[:m][keep]
    if short.any():
        begin = np.cumsum(counts) - counts
        ids = np.flatnonzero(short)
        own = np.zeros(len(ids), dtype=np.uint64)
        for k in range(width - 1):
            has = counts[ids] > k
            own[has] = own[has] * np.uint64(_R) + words[begin[ids[has]] + k]
        h = np.concatenate([h, mix(own + counts[ids].astype(np.uint64))])
        d = np.concatenate([d, ids])
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    if len(h):
        new = np.ones(len(h), dtype=bool)
        new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
        h, d = h[new], d[new]
    return h, np.bincount(d, minlength=len(texts)).astype(np.int64)
