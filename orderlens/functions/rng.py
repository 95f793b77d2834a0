"""Counter-based random numbers as Column expressions: draw n of a seed is a function of both, so no state is carried between rows.

64-bit arithmetic wraps through decimals of 38 digits, so it works in ANSI mode as well.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Fixed values of splitmix64.
GOLDEN = 0x9E3779B97F4A7C15
MIX_1 = 0xBF58476D1CE4E5B9
MIX_2 = 0x94D049BB133111EB
MASK = (1 << 64) - 1


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x evaluated once, however often f uses it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def big(n: int) -> Column:
    return F.lit(str(n)).cast("decimal(20,0)")


def unsigned(z: Column) -> Column:
    wide = z.cast("decimal(20,0)")
    return F.when(z < 0, wide + big(1 << 64)).otherwise(wide)


def wrapped(u: Column) -> Column:
    """An unsigned number modulo 2^64, as a signed integer."""
    return let(F.pmod(u, big(1 << 64)), lambda v: F.when(v >= big(1 << 63), v - big(1 << 64)).otherwise(v).cast("long"))


def wrap_add(a: Column, b: Column) -> Column:
    return let(a, lambda x: let(b, lambda y: wrapped(unsigned(x) + unsigned(y))))


def wrap_multiply(a: Column, constant: int) -> Column:
    """a times a constant modulo 2^64; the constant's halves keep products within 38 digits."""
    half = big(1 << 32)
    product = lambda u: u * big(constant & 0xFFFFFFFF) + F.pmod(u * big(constant >> 32), half) * half
    return let(a, lambda z: let(unsigned(z), lambda u: wrapped(product(u))))


def xor_shift(bits: int) -> Callable[[Column], Column]:
    return lambda x: x.bitwiseXOR(F.shiftrightunsigned(x, bits))


def mix64(z: Column) -> Column:
    """The splitmix64 finaliser."""
    for shift, factor in ((30, MIX_1), (27, MIX_2), (31, None)):
        z = let(z, xor_shift(shift))
        z = wrap_multiply(z, factor) if factor else z
    return z


def draw(seed: Column, n: Column) -> Column:
    """The n-th (from 1) 64-bit draw of a seed; seed 0 counts as 1."""
    start = F.when(seed == 0, F.lit(1)).otherwise(seed).cast("long")
    return mix64(wrap_add(start, wrap_multiply(n.cast("long"), GOLDEN)))


def stable_sequence(entity: Column, sequence: Column, child: Column) -> Column:
    """An id of its own for each (entity, sequence, child), the same on every run and partition."""
    return mix64(wrap_add(mix64(wrap_add(mix64(entity.cast("long")), sequence.cast("long"))), child.cast("long")))


def uniform01(z: Column) -> Column:
    """The top 53 bits over 2^53, at least 1e-12."""
    return F.greatest(F.lit(1e-12), F.shiftrightunsigned(z, 11).cast("double") / F.lit(float(1 << 53)))


def uniform_int(z: Column, low: Column, high: Column) -> Column:
    """low plus the unsigned draw modulo the width; low if the range is empty."""
    width = (high - low + 1).cast("decimal(20,0)")
    return F.when(high <= low, low.cast("long")).otherwise(low.cast("long") + F.pmod(let(z, unsigned), width).cast("long"))


def normal01(first: Column, second: Column) -> Column:
    """Box-Muller of two uniforms."""
    return F.sqrt(-2 * F.log(first)) * F.cos(2 * F.pi() * second)


@F.pandas_udf(DoubleType())
def libm_log(x: pd.Series) -> pd.Series:
    """The natural logarithm of the C library, as other engines take it: the JVM's may differ in the last bit, which shows where a product of it is rounded to a whole number."""
    return x.map(math.log, na_action="ignore")


def exponential_wait_ns(uniform: Column, rate: Column) -> Column:
    """Nanoseconds to the next event, at least 1; none (the largest integer) at a rate of 0 or less."""
    wait = F.greatest(F.lit(1), F.round(-libm_log(uniform) / rate * 1e9).cast("long"))
    return F.when(rate <= 0, F.lit(2**63 - 1)).otherwise(wait)


class Stream:
    """The same draws one after another, for kernels."""

    def __init__(self, seed: int):
        self.state = seed & MASK or 1

    def next(self) -> int:
        self.state = (self.state + GOLDEN) & MASK
        z = self.state
        z = ((z ^ z >> 30) * MIX_1) & MASK
        z = ((z ^ z >> 27) * MIX_2) & MASK
        return z ^ z >> 31

    def uniform(self) -> float:
        return max(1e-12, (self.next() >> 11) / float(1 << 53))

    def integer(self, low: int, high: int) -> int:
        return low if high <= low else low + self.next() % (high - low + 1)

    def normal(self) -> float:
        first, second = self.uniform(), self.uniform()
        return float(np.sqrt(-2 * np.log(first)) * np.cos(2 * np.pi * second))

    def wait_ns(self, rate: float) -> int:
        return 2**63 - 1 if rate <= 0 else max(1, int(np.floor(-np.log(self.uniform()) / rate * 1e9 + 0.5)))
