"""Vectorised 64-bit hashes of words and word shingles over whole batches of texts (NumPy, inside tasks)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Texts are hashed in blocks of about this many UTF-8 bytes; one longer text is a block of its own.
BLOCK_BYTES = 1 << 21

_MULT = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: ASCII letters are lowered, digits and every byte of a non-ASCII character are kept, the rest parts words.
WORD_TABLE = bytes(ord(chr(b).lower()) if chr(b).isalnum() and b < 128 else b if b >= 128 else 32 for b in range(256))
_powers: tuple[np.ndarray, np.ndarray] = (np.zeros(0, np.uint64), np.zeros(0, np.uint64))


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over the 64 output bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        tables = []
        for base in (_MULT, _INVERSE):
            t = np.full(n, base, np.uint64)
            t[0] = 1
            tables.append(np.multiply.accumulate(t))
        if n > 4 * BLOCK_BYTES:  # do not keep a table that one huge text asked for
            return tables[0], tables[1]
        _powers = (tables[0], tables[1])
    return _powers


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For one buffer whose words are parted by spaces: each word's hash, first byte and end."""
    arr = np.frombuffer(data, np.uint8)
    inside = np.zeros(len(arr) + 2, np.int8)
    np.not_equal(arr, 32, out=inside[1:-1].view(bool))
    edge = np.diff(inside)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.zeros(0, np.uint64), starts, ends
    up, down = _power_tables(len(arr) + 1)
    sums = np.zeros(len(arr) + 1, np.uint64)
    np.cumsum(_BYTE[arr] * up[: len(arr)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts]), starts, ends


def blocks(texts: list[str | None]) -> Iterator[tuple[int, int, list[bytes]]]:
    """Index ranges of ``texts`` with about BLOCK_BYTES of UTF-8 each, and the encoded texts (null: empty)."""
    first, held, size = 0, [], 0
    for i, t in enumerate(texts):
        b = (t or "").encode("utf-8", "surrogatepass")
        if held and size + len(b) > BLOCK_BYTES:
            yield first, i, held
            first, held, size = i, [], 0
        held.append(b)
        size += len(b) + 1
    if held:
        yield first, len(texts), held


def hashed(encoded: list[bytes], table: bytes = WORD_TABLE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of a block of texts, each word's first byte and end in its own text, and where each text's
    words begin (len + 1 offsets)."""
    at = np.zeros(len(encoded) + 1, np.int64)
    np.cumsum([len(b) + 1 for b in encoded], out=at[1:])
    h, starts, ends = word_hashes(b" ".join(encoded).translate(table))
    offsets = np.searchsorted(starts, at)
    doc = np.repeat(np.arange(len(encoded)), np.diff(offsets))
    return h, starts - at[doc], ends - at[doc], offsets


def shingles(h: np.ndarray, offsets: np.ndarray, k: int, words: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words inside each text, and their offsets.

    A text of 1 to k - 1 words has one shingle, its whole word sequence; a text without words has none.  With
    ``words`` below ``k``: runs of so many words, hashed as a text of so many words is, and none of shorter texts.
    """
    n = np.diff(offsets)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1)) if words is None else np.maximum(n - words + 1, 0)
    out = np.zeros(len(n) + 1, np.int64)
    np.cumsum(count, out=out[1:])
    if not out[-1]:
        return np.zeros(0, np.uint64), out
    first = np.arange(out[-1]) - np.repeat(out[:-1], count) + np.repeat(offsets[:-1], count)
    last = np.repeat(offsets[1:], count) if words is None else first + words
    total = np.zeros(out[-1], np.uint64)
    short = words is not None or bool((n < k).any())
    for j in range(k):
        step = h[np.minimum(first + j, len(h) - 1)]
        if short:
            step = np.where(first + j < last, step, np.uint64(0x5851F42D4C957F2D))
        total = total * np.uint64(0xD6E8FEB86659FD93) + step
    return mix(total), out


def rolled(h: np.ndarray, first: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of ``k`` words that begin at the words ``first``, from sums that all runs share."""
    up, down = _power_tables(len(h) + 1)
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up[: len(h)], out=sums[1:])
    return mix((sums[first + k] - sums[first]) * down[first])
