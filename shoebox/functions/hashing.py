"""Perceptual hashes and Hamming distances as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DIGITS = 16


def dhash(gray: Column, width: int = 9, height: int = 8) -> Column:
    """Difference hash of a row-wise gray grid: a bit for each pair of neighbours, 1 where the left one is brighter.

    Lower-case hex digits; a last digit of less than four bits is padded with zeros.
    """
    bits = height * (width - 1)

    def bit(gray: Column, i: Column) -> Column:
        at = F.floor(i / (width - 1)).cast("int") * width + (i % (width - 1)).cast("int")
        return F.when(i < bits, (F.element_at(gray, at + 1) > F.element_at(gray, at + 2)).cast("int")).otherwise(0)

    digit = lambda g, k: sum((bit(g, k * 4 + j) * (8 >> j) for j in range(1, 4)), bit(g, k * 4) * 8)
    hexed = lambda g: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(-(-bits // 4) - 1)), lambda k: F.lower(F.hex(digit(g, k)))), "")
    # as an element the grid is found once a row, however dear it is, and not once a bit
    return F.element_at(F.transform(F.array(gray), hexed), 1)


def half(hash_: Column, second: bool = False) -> Column:
    """One 32-bit half of a 16-digit hash: a long never overflows."""
    return F.conv(F.substring(hash_, 9 if second else 1, 8), 16, 10).cast("long")


def hamming(a: Column, b: Column) -> Column:
    """Bits in which two hex hashes differ; four times the longer length where their lengths differ."""
    def chunk(h: Column, i: Column) -> Column:
        return F.conv(F.substr(h, i * 8 + 1, F.lit(8)), 16, 10).cast("long")

    parts = F.sequence(F.lit(0), F.greatest(F.ceil(F.length(a) / 8).cast("int") - 1, F.lit(0)))
    rest = F.aggregate(parts, F.lit(0), lambda n, i: n + F.bit_count(F.coalesce(chunk(a, i), F.lit(0)).bitwiseXOR(F.coalesce(chunk(b, i), F.lit(0)))))
    fast = F.bit_count(half(a).bitwiseXOR(half(b))) + F.bit_count(half(a, True).bitwiseXOR(half(b, True)))
    return F.when(F.length(a) != F.length(b), F.greatest(F.length(a), F.length(b)) * 4).when(F.length(a) == DIGITS, fast).otherwise(rest)


def bands(hash_: Column, n: int) -> Column:
    """The hash cut into ``n`` runs of digits; two hashes less than ``n`` bits apart share one of them."""
    edges = [i * DIGITS // n for i in range(n + 1)]
    return F.array(*[F.substring(hash_, a + 1, b - a) for a, b in zip(edges[:-1], edges[1:], strict=True)])


# FNV-1a of 32 bits, the step of the number sequence, and 32 ones.
FNV_OFFSET, FNV_PRIME, STEP, ONES = 0x811C9DC5, 0x01000193, 0x6D2B79F5, 0xFFFFFFFF


def fnv1a(data: Column) -> Column:
    """FNV-1a of binary data as a long of 32 bits: a fold over its bytes."""
    byte = lambda i: F.conv(F.hex(F.substr(data, i, F.lit(1))), 16, 10).cast("long")
    places = F.when(F.length(data) > 0, F.sequence(F.lit(1), F.length(data))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(places, F.lit(FNV_OFFSET).cast("long"), lambda h, i: (h.bitwiseXOR(byte(i)) * F.lit(FNV_PRIME)).bitwiseAND(F.lit(ONES)))


def _times(a: Column, b: Column) -> Column:
    """The low 32 bits of a product of 32-bit numbers, by halves that a long holds."""
    high = (a * F.shiftright(b, 16)).bitwiseAND(F.lit(0xFFFF))
    return (a * b.bitwiseAND(F.lit(0xFFFF)) + F.shiftleft(high, 16)).bitwiseAND(F.lit(ONES))


def uniform(seed: Column, nth: Column | int) -> Column:
    """The ``nth`` number (from 1) of the fixed sequence in [0, 1) that a 32-bit ``seed`` begins: each is found without those before it."""
    nth = F.lit(nth) if isinstance(nth, int) else nth
    a = (seed + nth.cast("long") * F.lit(STEP)).bitwiseAND(F.lit(ONES))
    t = _times(a.bitwiseXOR(F.shiftright(a, 15)), a.bitwiseOR(F.lit(1)))
    u = (t + _times(t.bitwiseXOR(F.shiftright(t, 7)), t.bitwiseOR(F.lit(61)))).bitwiseAND(F.lit(ONES)).bitwiseXOR(t)
    return u.bitwiseXOR(F.shiftright(u, 14)) / F.lit(4294967296.0)
