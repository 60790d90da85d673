"""Numbers for rows in order, without a task that holds a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Values of the ordering column that are put in order together.
BLOCK = 1 << 14


def numbered(rows: DataFrame, key: str, order: str, *ties: str, block: int = BLOCK) -> DataFrame:
    """rows with number, from 1 in each key by order (whole numbers, null first) and then by ties.

    Rows are put in order in blocks of `order`, and numbered behind what earlier blocks of their key have: a key's
    blocks are counted in one task, its rows are not, as long as they don't share one value of order.
    """
    blocks = rows.withColumn("_block", F.floor(F.col(order) / block))
    counts = blocks.groupBy(F.col(key).alias("_key"), F.col("_block").alias("_of")).agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy("_key").orderBy(F.col("_of").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("_key", "_of", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy(key, "_block").orderBy(F.col(order).asc_nulls_first(), *ties))
    met = blocks.withColumn("_within", within).join(before, F.col(key).eqNullSafe(F.col("_key")) & F.col("_block").eqNullSafe(F.col("_of")))
    return met.withColumn("number", F.col("_before") + F.col("_within")).drop("_block", "_within", "_key", "_of", "_before")
