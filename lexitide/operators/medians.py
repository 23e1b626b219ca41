"""Exact medians without gathering values: two aggregates that are summed where the rows lie.

A mergeable sketch bounds the median to a narrow range of values; the second pass counts what lies below
that range as one number and inside it value by value. The two middle ranks are then found by running
sums over the counted values, some ten-thousandth of the rows or fewer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Accuracy of the sketch, whose ranks are off by at most a share of 1 / ACCURACY, and half the width of the range, ten times that.
ACCURACY, MARGIN = 100_000, 1e-4


def medians(rows: DataFrame, values: dict[str, Column], by: list[str] | None = None) -> DataFrame:
    """(by, a column of each name): the exact medians of the values, nulls left out; null where there are none. One row without by."""
    by = by or []
    long = rows.select(*by, F.inline(F.array(*(F.struct(F.lit(n).alias("__name"), c.cast("double").alias("__v")) for n, c in values.items()))))
    long = long.where("__v IS NOT NULL")
    keys = [*by, "__name"]
    ends = F.percentile_approx("__v", [0.5 - MARGIN, 0.5 + MARGIN], ACCURACY)
    bounds = long.groupBy(*keys).agg(ends.alias("__e"), F.count("*").alias("__n")).select(*keys, F.col("__e")[0].alias("__low"), F.col("__e")[1].alias("__high"), "__n")
    near = long.join(F.broadcast(bounds), keys).where("__v <= __high")  # a row for each group and name
    counted = near.groupBy(*keys, F.when(F.col("__v") >= F.col("__low"), F.col("__v")).alias("__v")).agg(F.count("*").alias("__c"), F.first("__n").alias("__n"))
    upto = F.sum("__c").over(Window.partitionBy(*keys).orderBy(F.asc_nulls_first("__v")).rowsBetween(Window.unboundedPreceding, 0))
    placed = counted.withColumn("__to", upto).withColumn("__from", upto - F.col("__c"))
    at = lambda rank: F.max(F.when((F.col("__from") <= rank) & (rank < F.col("__to")), F.col("__v")))
    n = F.col("__n")
    middle = placed.groupBy(*keys).agg(at(F.floor((n - 1) / 2)).alias("__a"), at(F.floor(n / 2)).alias("__b"))
    sure = F.when(F.col("__a").isNull() | F.col("__b").isNull(), F.raise_error("the median lies outside its bounds").cast("double")).otherwise((F.col("__a") + F.col("__b")) / 2)
    got = middle.select(*keys, sure.alias("__m"))
    return got.groupBy(*by).agg(*(F.max(F.when(F.col("__name") == x, F.col("__m"))).alias(x) for x in values))
