"""Joins with a table of one row a key, where one key may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is heavy if it holds more than one of so many rows, so there are fewer heavy keys than this.
HEAVY = 1000


def join_split(rows: DataFrame, keys: DataFrame, key: str, weight: str) -> DataFrame:
    """``rows`` inner-joined with ``keys`` by ``key``. ``weight`` is the number of rows a key has (or
    more); keys with over 1/``HEAVY`` of the weight are fewer than ``HEAVY`` and are broadcast, so
    their rows stay where they are; all others meet in a shuffle. Both tables are read twice: give
    written ones. Keys that are null join nothing; without keys the result is empty."""
    total = keys.agg(F.sum(weight)).first()[0] or 0
    heavy = F.col(weight) * HEAVY > total
    few, rest = keys.where(heavy), keys.where(~heavy)
    light = rows.join(F.broadcast(few.select(key)), key, "left_anti")
    return rows.join(F.broadcast(few), key).unionByName(light.join(rest, key))
