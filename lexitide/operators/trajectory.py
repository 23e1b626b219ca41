"""Trajectories: mean scores by stage of the authors' lives. Each post goes to one stage, or is split over two."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexitide.functions.dates import whole_bin
from lexitide.operators.medians import medians

WEEK = 7 * 86400


def by_phase(posts: DataFrame, phases: int) -> DataFrame:
    """Rows (stage, weight) for num_phases equal parts of each author's posts; posts across a border go to both sides."""
    p = F.col("total_user_posts") / F.lit(float(phases))
    n = F.col("post_number").cast("double")
    first = F.least(p - n % p, F.lit(1.0))
    stage = (n / p).cast("int") + 1
    halves = F.array(F.struct(stage.alias("stage"), first.alias("weight")), F.struct((stage + 1).alias("stage"), (1 - first).alias("weight")))
    return posts.where("score <> 0").select("*", F.inline(halves)).where("weight > 0")


def by_bin(posts: DataFrame, stage: Column) -> DataFrame:
    """Rows (stage, weight); posts with score 0, which have no bigrams, weigh nothing."""
    return posts.withColumn("stage", stage).where(F.col("stage").isNotNull()).withColumn("weight", F.when(F.col("score") == 0, 0.0).otherwise(1.0))


def posts_stage(size: int) -> Column:
    return whole_bin(F.col("post_number"), size)


def time_stage(weeks: float) -> Column:
    return whole_bin(F.col("user_seconds"), weeks * WEEK)


def experience_stage(size: float) -> Column:
    return whole_bin(F.col("experience"), size)


def ntokens_stage(size: int) -> Column:
    return whole_bin(F.col("ntokens"), size)


def weighted(dealt: DataFrame, x: str, scale: float = 1.0, least: int | None = None, ntokens: str | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, x, score, nposts, avg_ntokens): weighted means by stage, for each group of the key columns (runs, for one) in the same job.

    With least, stages 1 to the number of bins that hold at least so many posts (one fewer if all do), gaps
    included. One aggregate of the posts carries sizes and sums; the rest happens on a row a stage.
    """
    total = F.sum("weight")
    aggs = [F.sum(F.col("score") * F.col("weight")).alias("s"), total.alias("w")]
    aggs.append((F.sum(F.col(ntokens) * F.col("weight")) if ntokens else F.lit(None).cast("double")).alias("t"))
    got = dealt.groupBy(*by, "stage").agg(*aggs, F.count("*").alias("n"))
    if least is not None:
        full = F.count_if(F.col("n") >= least)
        rows = F.collect_list(F.struct("stage", "s", "w", "t"))
        last = F.when(full == F.count("*"), full - 1).otherwise(full).cast("int")
        one = got.groupBy(*by).agg(last.alias("last"), F.map_from_entries(F.transform(rows, lambda r: F.struct(r["stage"], r))).alias("rows")).where("last >= 1")
        stages = one.select(*by, F.explode(F.sequence(F.lit(1), "last")).alias("stage"), "rows").withColumn("r", F.try_element_at("rows", "stage"))
        got = stages.select(*by, "stage", "r.s", "r.w", "r.t")
    return got.select(*by, (F.col("stage") * F.lit(float(scale))).alias(x), F.try_divide("s", "w").alias("score"), F.coalesce("w", F.lit(0.0)).alias("nposts"), F.try_divide("t", "w").alias("avg_ntokens"))


def user_averaged(dealt: DataFrame, x: str, author: str = "author", by: tuple[str, ...] = ()) -> DataFrame:
    """(by, x, score, nusers): the mean over authors of their own weighted means. Authors without weight count, but have no mean."""
    own = dealt.groupBy(*by, "stage", author).agg(F.sum(F.col("score") * F.col("weight")).alias("s"), F.sum("weight").alias("w"))
    own = own.withColumn("m", F.try_divide("s", "w"))
    return own.groupBy(*by, F.col("stage").alias(x)).agg(F.avg("m").alias("score"), F.count("*").alias("nusers"))


def by_number(posts: DataFrame, last: int | Column) -> DataFrame:
    """Stages are post numbers 1 to last; numbers count from 0, so everyone's first post is left out."""
    return by_bin(posts.where((F.col("post_number") >= 1) & (F.col("post_number") <= last)), F.col("post_number"))


def by_median_number(posts: DataFrame, users: DataFrame) -> DataFrame:
    """by_number up to the authors' median of total_posts, cut to an integer."""
    median = medians(users, {"m": F.col("total_posts")}).select(F.col("m").cast("int").alias("__last"))
    return by_number(posts.crossJoin(F.broadcast(median)), F.col("__last")).drop("__last")


def info(config, **more) -> list[tuple[str, str]]:
    """The run's metadata as rows (key, value)."""
    return [*config.rows(), *((k, str(v)) for k, v in more.items())]

