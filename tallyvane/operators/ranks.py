"""Running numbers and sums of ordered rows, for keys of which one may hold most rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyvane.session import cut


def _running(rows: DataFrame, by: list[str], order: list[str | Column], amount: Column, within: Column, name: str) -> DataFrame:
    """Rows dealt out by ranges of (by, order), with `within` over each key's part of a range, plus the key's amount in
    earlier ranges. Only a key that goes on from one range to the next has such an offset: at most one for each range."""
    dealt = cut(rows.repartitionByRange(*by, *order).withColumn("__range", F.spark_partition_id()))
    key = [f"__k{k}" for k in range(len(by))]
    sums = dealt.groupBy(F.col("__range").alias("__r"), *(F.col(c).alias(k) for c, k in zip(by, key))).agg(amount.alias("__n"))
    earlier = Window.partitionBy(*key).orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("__start", F.sum("__n").over(earlier)).where("__start is not null").drop("__n")
    same = F.col("__range") == F.col("__r")
    for c, k in zip(by, key):
        same &= F.col(c).eqNullSafe(F.col(k))
    joined = dealt.withColumn("__here", within).join(F.broadcast(starts), same, "left")
    return joined.withColumn(name, F.col("__here") + F.coalesce("__start", F.lit(0).cast("long"))).select(*rows.columns, name)


def running_number(rows: DataFrame, by: list[str], order: list[str | Column], name: str = "place") -> DataFrame:
    """Add `name`: the place of each row among those of its key `by`, from 1, in the order given.

    Rows are dealt out by ranges of (by, order), so a key with many rows lies in several neighbouring ranges; its number is
    the place within the range and the rows of the key in earlier ranges. Keys may be null, a key of their own; rows that
    are equal in `by` and `order` share a range and are numbered in any order.
    """
    place = F.row_number().over(Window.partitionBy("__range", *by).orderBy(*order))
    return _running(rows, by, order, F.count("*"), place, name)


def running_total(rows: DataFrame, by: list[str], order: str, value: str, name: str) -> DataFrame:
    """Add `name`: the sum of value over the rows of the same key `by` that come before, 0 for the first; rows of a key
    differ in order. Dealt out as in running_number."""
    before = Window.partitionBy("__range", *by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return _running(rows, by, [order], F.sum(value), F.coalesce(F.sum(value).over(before), F.lit(0)), name)
