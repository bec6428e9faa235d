"""Joins with a table that is unique on its key, where the other side may hold one key in a third of its rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST_HOT = 10_000  # rows of a key that are worth a broadcast
MOST_HOT = 10_000  # keys that can be hot at once: what bounds the broadcast


def join_unique(left: DataFrame, right: DataFrame, key: str, rows: int, inner: bool = False, least: int = LEAST_HOT, counts: DataFrame | None = None, nulls: bool = True) -> DataFrame:
    """``left`` with the columns of ``right``, which has one row a key; both are read more than once.

    A key with more than ``max(least, rows / MOST_HOT)`` of the left side's ``rows`` is hot: there
    are at most MOST_HOT of them, so their rows of ``right`` are broadcast and theirs of ``left``
    stay where they are. All other keys meet in a shuffle, in which none is large. Null keys are
    neither: they match nothing, and stay where they are too. ``counts`` (key, __n) saves a pass
    over ``left`` where it is known already, and so does ``nulls`` false where there are none.
    """
    most = max(least, rows // MOST_HOT)
    counts = left.groupBy(key).agg(F.count(F.lit(1)).alias("__n")) if counts is None else counts
    hot = counts.filter((F.col("__n") > most) & F.col(key).isNotNull()).select(key)
    how = "inner" if inner else "left"
    if hot.isEmpty():
        out = left.filter(F.col(key).isNotNull()).join(right, key, how)
    else:
        keys = F.broadcast(hot)
        cold = left.filter(F.col(key).isNotNull()).join(keys, key, "left_anti").join(right, key, how)
        few = left.join(keys, key, "left_semi").join(F.broadcast(right.join(keys, key, "left_semi")), key, how)
        out = cold.unionByName(few)
    if inner or not nulls:
        return out
    columns = [F.lit(None).cast(f.dataType).alias(f.name) for f in right.schema if f.name != key]
    return out.unionByName(left.filter(F.col(key).isNull()).select("*", *columns))
