"""A left lookup that no hot key can overload."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with at least this share of all rows is looked up in a broadcast table, which so has at most 1 / HOT rows.
HOT = 1 / 1000


def hot_limit(total: int) -> int:
    return max(1000, int(total * HOT))


def unused(*frames: DataFrame) -> str:
    """A prefix that no column of ``frames`` begins with, for columns of our own."""
    names = [c.lower() for df in frames for c in df.columns]
    prefix = "_x"
    while any(c.startswith(prefix) for c in names):
        prefix += "x"
    return prefix + "_"


def lookup(rows: DataFrame, groups: DataFrame, key: str, n: str, total: int, spread: str) -> DataFrame:
    """``rows`` left-joined to ``groups`` on ``key``, which is unique in ``groups``.

    ``groups[n]`` is the number of rows with the key and ``total`` that of all rows:
    keys with at least ``hot_limit(total)`` rows, 1000 keys at most, come from a
    broadcast table. Their rows go through the other join under keys of their own
    (hashed from ``spread``), where they meet nothing and load no task. Null keys
    find nothing. All columns of ``rows`` come out, then those of ``groups`` but for
    ``key`` and ``n``; names of the two must differ.
    """
    x = unused(rows, groups)
    values = [c for c in groups.columns if c not in (key, n)]
    is_hot = F.col(f"`{n}`") >= F.lit(hot_limit(total))
    hot = groups.where(is_hot).select(F.col(key).alias(f"{x}hot"), *[F.col(c).alias(f"{x}hot_{c}") for c in values])
    cold = groups.where(~is_hot).select(F.col(key).alias(f"{x}cold"), F.lit(0).cast("long").alias(f"{x}zero"), *[F.col(c).alias(f"{x}cold_{c}") for c in values])
    kept = [F.col(f"`{c}`") for c in rows.columns]
    rows = rows.join(F.broadcast(hot), F.col(f"`{key}`") == F.col(f"{x}hot"), "left")
    own = F.when(F.col(f"{x}hot").isNotNull() | F.col(f"`{key}`").isNull(), 1 + F.pmod(F.xxhash64(f"`{spread}`"), F.lit(1 << 40))).otherwise(F.lit(0).cast("long"))
    rows = rows.withColumn(f"{x}own", own).join(cold, (F.col(f"`{key}`") == F.col(f"{x}cold")) & (F.col(f"{x}own") == F.col(f"{x}zero")), "left")
    return rows.select(*kept, *[F.coalesce(f"{x}hot_{c}", f"{x}cold_{c}").alias(c) for c in values])
