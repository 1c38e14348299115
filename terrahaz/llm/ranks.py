"""Places of rows within their group, however large one group is."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ranked(df: DataFrame, folder: str, group: str, order: list[str]) -> DataFrame:
    """``df`` with ``idx`` (place in its group by ``order``, from 0) and ``n`` (rows of the group), both long.

    Rows are dealt to ranges of (group, order) and written to ``folder`` in that
    order, so a hot group lies over many tasks; only one row per task and group
    is summed up to find where a task's rows begin. Nulls come first. Rows equal in
    all of ``order`` follow one another as they happen to be written, once for good.
    ``df`` is read twice (ranges are sampled), so it should be a written table.
    """
    spark = df.sparkSession
    (df.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
     .withColumn("at", F.monotonically_increasing_id()).write.parquet(folder))
    rows = spark.read.parquet(folder).withColumn("part", F.shiftright("at", 33))
    earlier = Window.partitionBy(group).orderBy("part")
    parts = (rows.groupBy(group, "part").agg(F.min("at").alias("first"), F.count("*").alias("size"))
             .select(group, "part",
                     (F.sum("size").over(earlier) - F.col("size") - F.col("first")).alias("shift"),
                     F.sum("size").over(Window.partitionBy(group)).alias("n")))
    return rows.join(parts, [group, "part"]).withColumn("idx", F.col("at") + F.col("shift")).drop("part", "at", "shift")
