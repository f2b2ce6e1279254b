"""Hash-based integers, uniforms and normals that depend only on row id and seed."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F


def md5_mod(text: Column, modulus: int) -> Column:
    """The 128-bit MD5 of a text, read as an integer, modulo ``modulus``.

    The digest is folded in 32-bit words so that every step stays in a long.
    """
    if not 0 < modulus < 2**31:
        raise ValueError("modulus must be in 1..2^31-1")
    digest = F.md5(text.cast("binary"))
    remainder = F.lit(0).cast("long")
    shift = 2**32 % modulus
    for start in (1, 9, 17, 25):
        word = F.conv(F.substring(digest, start, 8), 16, 10).cast("long")
        remainder = F.pmod(remainder * F.lit(shift).cast("long") + word, F.lit(modulus).cast("long"))
    return remainder


def uniform(row_id: Column, seed: int, label: str) -> Column:
    """A uniform in [0, 1) from the first 52 bits of an MD5."""
    digest = F.md5(F.concat_ws("|", row_id.cast("string"), F.lit(str(seed)), F.lit(label)).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def normal(row_id: Column, seed: int, label: str, mean: float, deviation: float) -> Column:
    """A normal draw by the Box-Muller transform of two hash uniforms."""
    first = F.lit(1.0) - uniform(row_id, seed, label + ":r")
    second = uniform(row_id, seed, label + ":t")
    unit = F.sqrt(F.lit(-2.0) * F.log(first)) * F.cos(F.lit(2.0 * math.pi) * second)
    return F.lit(float(mean)) + F.lit(float(deviation)) * unit


def integer_draw(row_id: Column, seed: int, label: str, low: int, high: int) -> Column:
    """A uniform integer in [low, high]."""
    width = high - low + 1
    return (F.floor(uniform(row_id, seed, label) * F.lit(width)) + F.lit(low)).cast("int")


def choice(row_id: Column, seed: int, label: str, options: list[tuple[object, float]]) -> Column:
    """One of the options, picked with the given probabilities."""
    draw = uniform(row_id, seed, label)
    bound = 0.0
    picked: Column | None = None
    for value, weight in options[:-1]:
        bound += weight
        condition = draw < F.lit(bound)
        picked = F.when(condition, F.lit(value)) if picked is None else picked.when(condition, F.lit(value))
    last = F.lit(options[-1][0])
    return last if picked is None else picked.otherwise(last)


def row_fingerprint(*columns: Column) -> Column:
    """A 60-bit number from the MD5 of the given values, nulls marked."""
    parts = [F.coalesce(c.cast("string"), F.lit("\u0000")) for c in columns]
    digest = F.md5(F.concat_ws("\u0001", *parts).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")
