"""The tables that the operators write, and the joins that hot keys need."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import free_name, release, scratch, shared_dir, written
from ..sources.tables import read_table

__all__ = ["free_name", "join_counted", "release", "scratch", "shared_dir", "table", "written"]

#: A key with more than one in so many of all rows is hot; there are at most so many hot keys.
HOT_SHARE = 1000


def join_counted(rows: DataFrame, by_key: DataFrame, key: str, n: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``by_key``, which has one row a ``key`` and the number ``n`` of the rows that have it.

    The keys of more than one in HOT_SHARE of all rows, at most HOT_SHARE by their definition, are broadcast, so that no
    task gets all rows of a hot key; the others are shuffled. Both tables should be written ones, as they are read more than once.
    """
    total = by_key.agg(F.sum(n)).first()[0] or 0
    is_hot = F.col(n) * HOT_SHARE > total
    hot, cold = by_key.where(is_hot), by_key.where(~is_hot)
    keys = F.broadcast(hot.select(key))
    rest = rows.join(keys, key, "left_anti").join(cold.hint("merge"), key, how)
    return rest.unionByName(rows.join(F.broadcast(hot), key))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, sf_dir, name)
