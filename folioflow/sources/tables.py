"""Parquet tables of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Session setting: the number of tasks that a table of texts is dealt out over; unset, it is read in the splits that its files have.
READ_TASKS = "folioflow.read.tasks"


TEXT_TABLES = ("documents", "pages")


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table ``name`` of ``folder``.

    A file of a single row group is read by one task. Where the session sets ``folioflow.read.tasks``, the tables of texts are dealt out over that
    many tasks by a shuffle, whatever their size; without the setting nothing is shuffled.
    """
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    tasks = int(spark.conf.get(READ_TASKS, None) or 0) if name in TEXT_TABLES else 0
    return df.repartition(tasks) if tasks else df
