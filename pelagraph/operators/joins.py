"""Joins and running sums that no hot key and no single task holds up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pelagraph.storage import cut

#: Hot keys that a join broadcasts, at most.
HUBS = 200_000


def beside_hubs(rows: DataFrame, side: DataFrame, key: str, many: str, total: int) -> DataFrame:
    """rows joined with side, which has one row a key, without dealing a hot key's rows to one task.

    many: side's column with the key's number of rows; total: their sum. Keys of more than total / HUBS rows, of which there
    cannot be more than HUBS, are broadcast; the others' rows are shuffled. side is read twice, so it should be kept.
    """
    bound = max(64, -(-total // HUBS))
    names = [x for x in side.columns if x != key]
    hubs = F.broadcast(side.where(F.col(many) > bound).select(key, *(F.col(x).alias(f"hub_{x}") for x in names)))
    near = rows.join(hubs, key, "left")
    lone = F.col(f"hub_{many}").isNull()
    hot = near.where(~lone).select(*rows.columns, *(F.col(f"hub_{x}").alias(x) for x in names))
    return hot.unionByName(near.where(lone).select(*rows.columns).join(side.where(F.col(many) <= bound), key))


def running_sum(rows: DataFrame, order: list[Column], value: Column, name: str) -> DataFrame:
    """rows with the sum of value up to and with each row, in a total order.

    Rows are dealt by ranges of the order; only the ranges' sums, one row a partition, meet in one task.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(rows.withColumn("_v", value).repartitionByRange(n, *order).withColumn("_p", F.spark_partition_id()), "ranges")
    sums = dealt.groupBy("_p").agg(F.sum("_v").alias("_n"))
    before = sums.withColumn("_before", F.sum("_n").over(W.orderBy("_p")) - F.col("_n")).drop("_n")
    here = F.sum("_v").over(W.partitionBy("_p").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return dealt.join(F.broadcast(before), "_p").withColumn(name, here + F.col("_before")).drop("_p", "_v", "_before")
