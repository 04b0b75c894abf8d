"""Running sums cut into blocks, so that no task sorts a whole sequence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Places of a sequence that one task puts in order.
BLOCK = 1 << 16


def running_sum(df: DataFrame, keys: list[str], order: str, value: Column, name: str, block: int = BLOCK) -> DataFrame:
    """Rows with the sum of `value` over the rows of their sequence (keys) before them in `order`, an integer column; 0 for the first.

    Three steps: sums by block of `order`, added up before they are shuffled; a scan over these sums, one row a block; and sums within each block, which begins with a head row that holds what stands before it. A
    block has at most `block` places, so a sequence of any length is many small groups, and one exchange of the rows suffices. Null keys are a sequence of their own, rows without place come first, null values count 0.
    Rows that share a place are added in no fixed order.
    """
    rows = df.withColumns({"_block": F.floor(F.col(order) / block), "_value": value.cast("bigint")})
    sums = rows.groupBy(*keys, "_block").agg(F.sum("_value").alias("_value"))
    before = Window.partitionBy(*keys).orderBy(F.asc_nulls_first("_block")).rowsBetween(Window.unboundedPreceding, -1)
    heads = sums.select(*keys, "_block", F.sum("_value").over(before).alias("_value"), F.lit(True).alias("_head"))
    within = Window.partitionBy(*keys, "_block").orderBy(F.desc("_head"), F.asc_nulls_first(order)).rowsBetween(Window.unboundedPreceding, -1)
    both = rows.withColumn("_head", F.lit(False)).unionByName(heads, allowMissingColumns=True)
    return both.withColumn(name, F.coalesce(F.sum("_value").over(within), F.lit(0))).filter("NOT _head").drop("_block", "_value", "_head")
