"""Random numbers as columns: hashes of a row's number, so any row makes its own and other engines can repeat them.

A linear congruence and exclusive-or shifts are applied in turn to whole numbers below 2**33.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

A, C, M = 1_103_515_245, 12_345, 2_147_483_648
SHIFTS = (15, 13)


def scrambled(x: Column) -> Column:
    """A whole number below 2**31."""
    step = lambda v: F.pmod(v.cast("long") * A + C, F.lit(M))
    y = step(x)
    for s in SHIFTS:
        y = step(y.bitwiseXOR(F.shiftright(y, s)))
    return y


def uniform(x: Column) -> Column:
    """Between 0 and 1, both excluded."""
    return (scrambled(x) + 0.5) / float(M)


def normal(x: Column) -> Column:
    """Standard normal, from the two uniform numbers of 2x and 2x + 1."""
    return F.sqrt(-2 * F.log(uniform(2 * x))) * F.cos(2 * math.pi * uniform(2 * x + 1))


def sql_scrambled(x: str) -> str:
    step = lambda v: f"((({v})::BIGINT * {A} + {C}) % {M})"
    y = step(x)
    for s in SHIFTS:
        y = step(f"xor({y}, {y} >> {s})")
    return y


def sql_uniform(x: str) -> str:
    return f"(({sql_scrambled(x)} + CAST(0.5 AS DOUBLE)) / CAST({M} AS DOUBLE))"


def sql_normal(x: str) -> str:
    return f"(sqrt(-2 * ln({sql_uniform(f'2 * ({x})')})) * cos(2 * pi() * {sql_uniform(f'2 * ({x}) + 1')}))"
