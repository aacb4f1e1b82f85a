"""Places of rows in the order of their group, without bringing a group together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import quoted, stored

#: Rows of a partition, in the numbers that Spark gives to rows.
PART_BITS = 33


def numbered(df: DataFrame, groups: list[str], order: list[Column]) -> DataFrame:
    """df with row (ascending over all rows by groups and order), before (the row before in the group, or null), at (place in the group, from 0) and n (rows of the group).

    Rows are range partitioned by group and order, so a large group lies in many partitions. What the partitions have of a group is
    summed up in one row each; from these come the offsets. Null groups are one group. Rows that are equal in groups and order follow each other in any
    order. The result is in no order, but each of its tasks has the rows of whole ranges.
    """
    keys = [F.col(quoted(g)) for g in groups]
    sort = [*(k.asc_nulls_first() for k in keys), *order]
    rows = stored(df.repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn("row", F.monotonically_increasing_id()))
    part = F.shiftright("row", PART_BITS)
    runs = rows.groupBy(part.alias("__part"), *keys).agg(F.min("row").alias("__first"), F.max("row").alias("__last"), F.count(F.lit(1)).alias("__count"))
    of_group = Window.partitionBy(*keys)  # a row for each partition that the group lies in
    in_order = of_group.orderBy("__part")
    runs = runs.select(
        "__part",
        *(k.alias(f"__g{i}") for i, k in enumerate(keys)),
        "__first",
        F.lag("__last").over(in_order).alias("__before"),
        (F.sum("__count").over(in_order) - F.col("__count")).alias("__offset"),
        F.sum("__count").over(of_group).alias("n"),
    )
    same = part == F.col("__part")
    for i, k in enumerate(keys):
        same = same & k.eqNullSafe(F.col(f"__g{i}"))
    inside = F.col("row") - F.col("__first")
    return rows.join(runs, same).select(
        *(F.col(quoted(c)) for c in rows.columns),
        F.when(inside == 0, F.col("__before")).otherwise(F.col("row") - 1).alias("before"),
        (F.col("__offset") + inside).alias("at"),
        "n",
    )
