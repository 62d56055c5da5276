"""Sets over a known vocabulary as 64-bit words: sizes of intersections are bit counts, computed in generated code.

Set arithmetic on string arrays costs microseconds a pair; a pair of bit words costs nanoseconds. The
vocabulary's size is checked: beyond ``MAX_SKILLS`` the caller stays with arrays.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_SKILLS = 4096


def vocabulary(rows: DataFrame, skill: str, most: int = MAX_SKILLS) -> list[str] | None:
    """The distinct skills in order, or None if there are over ``most``."""
    found = rows.select(skill).filter(F.col(skill).isNotNull()).distinct().limit(most + 1).collect()
    return sorted(r[0] for r in found) if len(found) <= most else None


def words(names: list[str]) -> int:
    return max(1, -(-len(names) // 64))


def encode(rows: DataFrame, key: str, skill: str, names: list[str], prefix: str, where: Column | None = None) -> DataFrame:
    """(key, prefix0, prefix1, ...): each key's set; combined before the shuffle, repeated rows don't matter."""
    index = F.try_element_at(F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), F.lit(i))]), F.col(skill)) if names else F.lit(None).cast("int")
    numbered = rows.select(key, F.when(where if where is not None else F.lit(True), index).alias("_i"))
    bit = lambda j: F.when(F.floor(F.col("_i") / 64) == j, F.expr("shiftleft(1L, _i % 64)"))
    return numbered.groupBy(key).agg(*[F.coalesce(F.bit_or(bit(j)), F.lit(0).cast("long")).alias(f"{prefix}{j}") for j in range(words(names))])


def size(prefix: str, k: int) -> Column:
    return reduce(Column.__add__, [F.bit_count(F.col(f"{prefix}{j}")) for j in range(k)])


def common(a: str, b: str, k: int) -> Column:
    """Members that both sets have."""
    return reduce(Column.__add__, [F.bit_count(F.col(f"{a}{j}").bitwiseAND(F.col(f"{b}{j}"))) for j in range(k)])


def minus(frame: DataFrame, a: str, b: str, k: int) -> DataFrame:
    """Set ``a`` without the members of ``b``."""
    return frame.withColumns({f"{a}{j}": F.col(f"{a}{j}").bitwiseAND(F.bitwise_not(F.col(f"{b}{j}"))) for j in range(k)})
