"""Joins on keys of which a few may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FREQUENT = 10_000


def joined_by_frequency(left: DataFrame, right: DataFrame, on: list[str], n: str, total: int) -> DataFrame:
    """``left`` with the columns of ``right`` (one row a key, ``n`` of them in ``left``, of ``total`` rows) or nulls.

    Keys with a ``FREQUENT``-th of the rows or more, ``FREQUENT`` of them at most, are named in the plan by
    their hashes and broadcast, so no task gets all rows of one. Both sides are parted alike, so a key whose
    hash is that of another is only joined in the other part.
    """
    place = F.xxhash64(*on)
    hashes = [r[0] for r in right.filter(F.col(n) * FREQUENT >= total).select(place).collect()]
    if not hashes:
        return left.join(right, on, "left")
    is_frequent = place.isin(hashes)
    others = left.filter(~is_frequent).join(right.filter(~is_frequent), on, "left")
    return others.unionByName(left.filter(is_frequent).join(F.broadcast(right.filter(is_frequent)), on, "left"))
