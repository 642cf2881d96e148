"""Repeatable pseudo-random choices taken from a row's key.

A choice depends on a salt and the key only, so it is the same on every retry,
on any cluster and in any engine that has MD5.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_fraction(salt: str, *keys: Column) -> Column:
    """A number in [0, 1) from the key: the first 32 bits of an MD5 over ``salt:key``."""
    text = F.concat_ws(":", F.lit(salt), *[F.coalesce(k.cast("string"), F.lit("")) for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def weighted_choice(fraction: Column, values: Sequence[str], weights: Sequence[int]) -> Column:
    """The value in whose share of the total weight the fraction falls.

    A short catalogue becomes one conditional expression: no join, no shuffle.
    """
    total = sum(weights)
    chain, reached = None, 0
    for value, weight in zip(values, weights):
        reached += weight
        inside = fraction * F.lit(float(total)) < F.lit(float(reached))
        chain = (F if chain is None else chain).when(inside, F.lit(value))
    return chain


def uniform_choice(fraction: Column, values: Sequence[str]) -> Column:
    """One of the values, all equally likely."""
    index = F.floor(fraction * len(values)).cast("int") + 1
    return F.element_at(F.array(*[F.lit(v) for v in values]), index)
