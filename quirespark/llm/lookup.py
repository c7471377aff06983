"""Joins back to a table of one row for each key, some of whose keys may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def joined_back(rows: DataFrame, lookup: DataFrame, on: list[str], weight: str, total: int, how: str = "inner", most: int = 4096) -> DataFrame:
    """The join (inner or left) of rows with lookup, which has one row for each key; its column weight says how many of the
    total rows have that key.

    Keys with more than one in `most` of all rows number fewer than `most`: their lookup rows are broadcast and the rows
    that have them stay where they are. All others meet by a shuffle, in which no key has a larger share.
    """
    limit = total // most + 1
    hot = lookup.where(F.col(weight) >= limit)
    rest = rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(lookup.where(F.col(weight) < limit).drop(weight), on, how)
    return rows.join(F.broadcast(hot.drop(weight)), on).unionByName(rest)
