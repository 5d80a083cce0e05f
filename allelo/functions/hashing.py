"""A seeded integer hash that plain SQL computes alike.

Every key is added, multiplied, squared and multiplied again modulo three
different primes.  All intermediate values stay below 2**62, so any engine with
64-bit integers gives the same number.  ``mixed`` builds the column expression,
``mixed_sql`` its SQL twin, ``mixed_array`` that of numpy arrays; text keys enter through 28 bits of their MD5.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

P1, P2, P3 = 2147483647, 2147483629, 2147483399  # primes below 2**31
SPACE = P3  # hashes are 0 .. SPACE - 1


def text_key(c: Column) -> Column:
    """28 bits of a text's MD5 as a number."""
    return F.conv(F.substring(F.md5(c), 1, 7), 16, 10).cast("bigint")


def text_key_sql(c: str) -> str:
    return f"cast('0x' || substr(md5({c}), 1, 7) as bigint)"


def mixed(seed: int | Column, *keys: Column) -> Column:
    """The hash of non-negative integer keys under a seed."""
    x = seed if isinstance(seed, Column) else F.lit(seed)
    x = x.cast("bigint")
    for key in keys:
        x = ((x + key.cast("bigint") % SPACE) * 48271 + 7) % F.lit(P1).cast("bigint")
        x = x * x % F.lit(P2).cast("bigint")
        x = (x * 40692 + 17) % F.lit(P3).cast("bigint")
    return x


def mixed_sql(seed: int | str, *keys: str) -> str:
    """The same hash as SQL text."""
    x = f"cast({seed} as bigint)"
    for key in keys:
        x = f"((({x} + cast({key} as bigint) % {SPACE}) * 48271 + 7) % {P1})"
        x = f"(({x} * {x} % {P2} * 40692 + 17) % {P3})"
    return x


def mixed_array(seed: int, *keys: int | np.ndarray) -> np.ndarray:
    """The same hash of 64-bit integers and arrays of them."""
    x = np.int64(seed)
    for key in keys:
        x = ((x + np.asarray(key, dtype=np.int64) % SPACE) * 48271 + 7) % P1
        x = (x * x % P2 * 40692 + 17) % P3
    return x


def below(fraction: float) -> int:
    """Hashes under this bound make up the given fraction."""
    return int(fraction * SPACE)
