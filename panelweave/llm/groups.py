"""Values of groups joined to the rows of the groups, where one group may hold a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key that more than one in so many rows have is one of fewer than so many keys.
FREQUENT = 10_000


def attach(rows: DataFrame, groups: DataFrame, key: str, total: int) -> DataFrame:
    """``rows`` with the columns of ``groups``, a row for each value of ``key`` (null is a value), whose ``n`` counts its rows.

    ``total`` is the number of rows. Groups of more than one in ``FREQUENT`` rows, of which there are fewer than
    ``FREQUENT``, are broadcast, and their rows stay where they are; the others meet their rows in a shuffle, in
    which no key has more than that share. Rows whose key has no group get nulls. ``groups`` is read three times.
    """
    wide = F.col("n") * FREQUENT > total
    renamed = groups.withColumnRenamed(key, "_group")
    frequent, rest = F.broadcast(renamed.where(wide)), renamed.where(~wide)
    same = F.col(key).eqNullSafe(F.col("_group"))
    here = rows.join(frequent, same)
    there = rows.join(frequent.select("_group"), same, "left_anti").join(rest, same, "left")
    return here.unionByName(there).drop("_group")
