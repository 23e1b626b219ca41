"""Averages of trajectories over repeated runs, and checks that the runs belong together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def average(runs: DataFrame, x: str, weight: str = "nposts", min_posts: float | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, x, score, std_dev, weight) over runs(run_uid, x, score, weight): mean and sample deviation; the weight of the least run_uid."""
    got = runs.groupBy(*by, x).agg(F.avg("score").alias("score"), F.stddev_samp("score").alias("std_dev"), F.min_by(weight, "run_uid").alias(weight))
    return got.where(F.col(weight) >= min_posts) if min_posts is not None else got


def average_columns(runs: DataFrame, x: str) -> DataFrame:
    """Means of all numeric columns by x."""
    cols = [f.name for f in runs.schema.fields if f.name not in (x, "run_uid") and f.dataType.typeName() in ("double", "float", "long", "integer", "short", "byte")]
    return runs.groupBy(x).agg(*(F.avg(c).alias(c) for c in cols))


def is_experience_run(params: DataFrame) -> DataFrame:
    """(run_uid, is_exp): a run is experience-gated if it has a threshold."""
    return params.groupBy("run_uid").agg(F.bool_or(F.col("key") == "threshold_in_days").alias("is_exp"))


def inconsistent(params: DataFrame, ignored=("uid", "run_uid", "run_number"), rounded=("k",)) -> DataFrame:
    """(run_uid, key, value, expected): parameters that differ from those of the least run_uid; rounded ones to one decimal."""
    value = F.when(F.col("key").isin(*rounded), F.bround(F.col("value").try_cast("double"), 1).cast("string")).otherwise(F.col("value"))
    rows = params.where(~F.col("key").isin(*ignored)).withColumn("value", value)
    first = params.agg(F.min("run_uid").alias("__first"))
    base = rows.crossJoin(F.broadcast(first)).where("run_uid = __first").select("key", F.col("value").alias("expected"))
    other = params.select("run_uid").distinct().crossJoin(F.broadcast(base.select("key").distinct())).unionByName(rows.select("run_uid", "key")).distinct()
    both = other.join(rows, ["run_uid", "key"], "left").join(base, "key", "left")
    return both.where(~F.col("value").eqNullSafe(F.col("expected"))).select("run_uid", "key", "value", "expected")


def element_average(rows: DataFrame, column: str, by: list[str]) -> DataFrame:
    """Element-wise means of equally long arrays, as (by, pos, mean)."""
    return rows.select(*by, F.posexplode(column).alias("pos", "x")).groupBy(*by, "pos").agg(F.avg("x").alias("mean"))
