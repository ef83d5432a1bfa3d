"""Row numbers inside groups that may be very large."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(df: DataFrame, by: str, order: list[str], piece: Column, out: str) -> DataFrame:
    """Add ``out``: the row number (from 1) within ``by``, ordered by ``order``.

    ``piece`` cuts every group into parts that follow the order (its value never falls along
    it).  Rows are numbered inside (group, part) and moved up by the sizes of the parts before,
    so a group holding a large share of all rows is sorted by many tasks instead of one.
    """
    cut = df.withColumn("_piece", piece)
    before = Window.partitionBy(by).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    sizes = cut.groupBy(by, "_piece").agg(F.count("*").alias("_n")).select(
        by, "_piece", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(by, "_piece").orderBy(*order))
    return cut.withColumn("_r", inside).join(sizes, [by, "_piece"]).withColumn(
        out, F.col("_r") + F.col("_before")).drop("_r", "_piece", "_before")
