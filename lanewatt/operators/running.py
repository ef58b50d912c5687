"""Running sums and ranks over a whole table, without a window that holds it all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written


def running_sum(rows: DataFrame, order: list[Column | str], amount: str, name: str) -> DataFrame:
    """``rows`` with the sum of ``amount`` over all rows up to each, itself included, in the given order, as ``name``.

    The rows are dealt out by ranges of the order, each range sums up by itself, and a table of one total a range tells
    what lies before it. The rows are written between the two steps, so that both see the same ranges.
    """
    dealt = rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    own = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = written(dealt.withColumn("_own", F.sum(amount).over(own)), "running")
    totals = local.groupBy("_part").agg(F.sum(amount).alias("_total"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    offsets = totals.select("_part", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_before"))
    return local.join(offsets, "_part").withColumn(name, F.col("_before") + F.col("_own")).drop("_part", "_own", "_before")


def running_share(rows: DataFrame, keys: list[str], order: list[Column | str], amount: str) -> DataFrame:
    """``rows`` with ``upto`` and ``total``: the running sum within the keys, and the sum of all their rows."""
    x = running_sum(rows, [*keys, *order], amount, "upto")
    spans = x.groupBy(*keys).agg(F.min(F.col("upto") - F.col(amount)).alias("_start"), F.max("upto").alias("_end"))
    x = x.join(spans, keys) if keys else x.crossJoin(spans)  # one row without keys
    return x.withColumn("upto", F.col("upto") - F.col("_start")).withColumn("total", F.col("_end") - F.col("_start")).drop("_start", "_end")
