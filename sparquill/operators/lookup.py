"""Reading a few keys of large tables that are sorted by them.

A broadcast join tells the scan nothing of its keys. So a small set of keys is gathered, its size
checked, and becomes a filter of literals, which prunes row groups and pages by their statistics.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that may be gathered.
GATHERED = 10_000
#: Ranges of a filter; more keys than that share ranges of neighbours.
RANGES = 128


def gathered(rows: DataFrame, bound: int = GATHERED) -> tuple[DataFrame, list] | None:
    """The rows, computed once, as a local frame and as a list; ``None`` if there are more than ``bound``."""
    found = rows.limit(bound + 1).collect()
    return (rows.sparkSession.createDataFrame(found, rows.schema), found) if len(found) <= bound else None


def in_ranges(column: str, ranges: list[tuple]) -> Column:
    """Whether the column lies in one of the closed ranges, or in a gap that was closed to have ``RANGES`` of them at most."""
    ranges = sorted(ranges)
    share = -(-len(ranges) // RANGES) or 1
    merged = [(ranges[i][0], max(high for _, high in ranges[i : i + share])) for i in range(0, len(ranges), share)]
    c = F.col(column)
    tests = [c == low if low == high else c.between(low, high) for low, high in merged]
    if not tests:
        return F.lit(False)
    while len(tests) > 1:  # a balanced tree, as deep as its logarithm
        tests = [reduce(Column.__or__, tests[i : i + 2]) for i in range(0, len(tests), 2)]
    return tests[0]


def one_of(column: str, values: set) -> Column:
    """Whether the column has one of the values, in a form that scans can prune by."""
    values = sorted(v for v in values if v is not None)
    if not values:
        return F.lit(False)
    return F.col(column).isin(values) & in_ranges(column, [(v, v) for v in values])
