"""Numbers in an order, without one ordered partition."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.tables import staged


def numbered(rows: DataFrame, name: str, *order) -> DataFrame:
    """The rows with their place in the order from 0: places within range partitions, plus the counts of the partitions before."""
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    placed = staged(placed, "order-rows").withColumn("__part", F.shiftright("__at", 33))
    # one row for each partition
    counts = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = counts.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    within = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(F.broadcast(before), "__part").withColumn(name, F.col("__before") + within).drop("__part", "__at", "__before")
