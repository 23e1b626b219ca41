"""Per-author profiles and the choice of authors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexitide.functions import dates
from lexitide.operators.clean import IGNORED

CORPUS_END = "2022-12-31"


def profiles(posts: DataFrame, author: str, created: str, submission: Column, top_comment: Column, ignored=IGNORED) -> DataFrame:
    """First and last post, submissions, comments and top-level comments of each author."""
    rows = posts.where(F.col(author).isNotNull())
    if ignored:
        rows = rows.where(~F.col(author).cast("string").isin(*ignored))
    n = lambda c: F.count_if(c)
    return rows.groupBy(F.col(author).alias("author")).agg(
        F.min(created).alias("first_post"),
        F.max(created).alias("last_post"),
        n(submission).alias("submissions"),
        n(~submission).alias("comments"),
        n(~submission & top_comment).alias("top_level_comments"),
    )


def sampling_users(users: DataFrame, min_user_posts: int = 1) -> DataFrame:
    """Authors with enough top-level comments; a minimum of 1 or less keeps all."""
    return users.where(F.col("top_level_comments") >= min_user_posts) if min_user_posts > 1 else users


def trajectory_users(users: DataFrame, low: int = 50, high: int | None = 5000) -> DataFrame:
    total = F.col("top_level_comments") + F.col("submissions")
    out = users.withColumn("total_posts", total).where(F.col("total_posts") >= low)
    return out.where(F.col("total_posts") <= high) if high is not None else out


def ended_users(users: DataFrame, weeks: int = 48, end: str = CORPUS_END) -> DataFrame:
    """Authors whose last post lies weeks or more before the corpus ends."""
    return users.where(F.col("last_post") <= dates.plus_weeks(F.lit(end).cast("timestamp_ntz"), -weeks))


def tiers(users: DataFrame) -> DataFrame:
    """How many authors have exactly one post, more than one, 50 or more (comments of all kinds count)."""
    total = F.col("comments") + F.col("submissions")
    return users.agg(F.count("*").alias("users"), F.count_if(total == 1).alias("one_post"), F.count_if(total > 1).alias("several"), F.count_if(total >= 50).alias("fifty"))


def persistent(users: DataFrame, seconds: int = 0, posts: int = 0) -> DataFrame:
    """Authors active over so many seconds, with so many posts."""
    span = F.timestamp_diff("SECOND", F.col("first_post"), F.col("last_post"))
    return users.where((span >= seconds) & (F.col("comments") + F.col("submissions") >= posts))


def only(rows: DataFrame, users: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(users.select(*keys).distinct(), keys, "left_semi")


def without(rows: DataFrame, used: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(used.select(*keys).distinct(), keys, "left_anti")
