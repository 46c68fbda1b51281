"""Scalar functions: on plain integers, and on columns where a query needs them."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def log2(n: int) -> int:
    """Floor of the binary logarithm; 0 for 0 and 1."""
    return max(n, 1).bit_length() - 1


def is_power_of_2(n: int) -> bool:
    """True for 0 and for powers of two; false for negative numbers."""
    return n >= 0 and n & (n - 1) == 0


def half(n: int) -> int:
    """Half, rounded up."""
    return (n + 1) // 2


def recursive_balance(eps: float, k: int) -> float:
    """Slack of one bisection so that log2(k) of them keep a k-way imbalance of ``eps``."""
    levels = math.ceil(math.log2(k)) if k > 1 else 1
    return ((1.0 + eps) / (1 << levels)) ** (1.0 / levels) - 0.5


def part_cap(total: int, k: int, eps: float) -> int:
    return math.floor(total / k * (1 + eps))


def vertex_cap(total: int, k: int, eps: float) -> int:
    return math.floor(total / k * eps)


def mixed(v: Column, seed: int = 0) -> Column:
    """A pseudo-random order of ids from arithmetic that any SQL dialect shares."""
    return (v * F.lit(1103515245) + F.lit(12345 + seed)) % F.lit(2147483648)


def permutation(n: int, seed: int = 0) -> list[int]:
    """0..n-1 in the order of ``mixed``."""
    return sorted(range(n), key=lambda v: ((v * 1103515245 + 12345 + seed) % 2147483648, v))


def numbers(line: str) -> list[int]:
    """The unsigned integers of a text line; what follows a % is a comment."""
    return [int(x) for x in re.findall(r"\d+", line.split("%", 1)[0])]
