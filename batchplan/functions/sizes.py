"""Arithmetic on batch sizes: candidate grids, rounding floors, growth steps and the two folds over a list of sizes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def candidate_grid(batch_size: int, max_range: float) -> list[int]:
    """Sizes that a later batch may take: batch_size times evenly spaced multipliers from 1, about one for each 5 %, rounded half to even."""
    end = max(max_range, 1.0)
    steps = max(1, int((end - 1.0) * 20))
    return sorted({int(x) for x in np.rint(batch_size * np.linspace(1.0, end, steps))})


def size_cap(batch_size: int, max_range: float) -> int:
    return int(max(max_range, 1.0) * batch_size)


def friendly_floor(n: int) -> int:
    """The largest power of two, or three times one, that is at most n."""
    if n < 1:
        raise ValueError("a batch size must be positive")
    two = 1 << (n.bit_length() - 1)
    return max(two, 3 << ((n // 3).bit_length() - 1)) if n >= 3 else two


def even_floor(n: int) -> int:
    """The largest even number at most n; 1 stays 1."""
    if n < 1:
        raise ValueError("a batch size must be positive")
    return n if n == 1 else n - n % 2


def friendly_floor_column(n: Column) -> Column:
    two = F.pow(F.lit(2.0), F.floor(F.log2(n))).cast("bigint")
    three = F.when(n >= 3, (F.lit(3) * F.pow(F.lit(2.0), F.floor(F.log2(n / 3)))).cast("bigint"))
    return F.greatest(two, three)


def even_floor_column(n: Column) -> Column:
    return F.when(n == 1, n).otherwise(n - n % 2)


def growth_step(batch_size: int, cap: int, max_diff: float) -> int:
    """By how much a batch may exceed the one before it. It can be 0 for a small batch size and a wide range, which stops growth."""
    return int(batch_size * max(1.0 / max(1, cap - batch_size), max_diff))


def smooth(sizes: list[int], batch_size: int, cap: int, max_diff: float) -> list[int]:
    """Sizes whose growth from one to the next is bounded; what a batch may not take is carried to later ones, shrinking is free."""
    step, carry, last, out = growth_step(batch_size, cap, max_diff), 0, None, []

    def take(wanted: int) -> int:
        nonlocal carry, last
        last = min(wanted, cap) if last is None else min(wanted, last + step, cap)
        carry = wanted - last
        out.append(last)
        return last

    for size in sizes:
        take(size + carry)
    while carry > 0:
        take(carry)
    return out


def round_sizes(sizes: list[int], floor) -> list[int]:
    """Every size but the last is floored; what is left is regrouped behind them under the largest size.

    The first regrouped batch is floored as it is; a later one takes the remainder too if both fit under the largest, so the
    tail may be unrounded.
    """
    if not sizes:
        return []
    cap = max(sizes)
    out = [floor(size) for size in sizes[:-1]]
    left = sum(sizes) - sum(out)
    closing = False
    while left > 0:
        size = floor(min(left, cap))
        if closing and left <= cap:
            size = left
        out.append(size)
        left -= size
        closing = True
    return out
