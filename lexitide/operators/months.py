"""Calendar operators: month tables, spines, runs of months, month ranges, admission rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexitide.functions import dates


def month_table(posts: DataFrame, users_per_month: int, posts_per_user: int, author: str = "author", when: str = "true_date", by: tuple[str, ...] = (), gate=None) -> DataFrame:
    """Counts of each month and whether it may be sampled; reason names the first rule that fails.

    gate is a condition on posts (experience above a threshold): then only posts that meet it count
    for posts and candidates, and there is no rule on users.
    """
    ok = F.lit(True) if gate is None else gate
    per_author = posts.withColumn("month", dates.month(F.col(when))).groupBy(*by, "month", author).agg(F.count("*").alias("n"), F.count_if(ok).alias("above"))
    table = per_author.groupBy(*by, "month").agg(
        F.sum("n").alias("nposts"), F.count("*").alias("nusers"), F.count_if(F.col("above") >= posts_per_user).alias("cand_users"), F.sum("above").alias("nposts_above")
    )
    few_posts = F.col("nposts_above") < posts_per_user * 2 * users_per_month
    few_users = (F.col("nusers") < 2 * users_per_month) if gate is None else F.lit(False)
    reason = F.when(few_posts, "posts").when(few_users, "users").when(F.col("cand_users") < users_per_month, "candidates")
    out = table.withColumn("reason", reason).withColumn("success", F.col("reason").isNull())
    return out if gate is not None else out.drop("nposts_above")


def spine(posts: DataFrame, when: str = "true_date") -> DataFrame:
    """Posts of every month from first to last, zeros included, numbered from 1."""
    counts = posts.groupBy(dates.month(F.col(when)).alias("month")).agg(F.count("*").alias("posts"))
    ends = counts.agg(F.min("month").alias("a"), F.max("month").alias("b")).where("a IS NOT NULL")
    months = ends.select(F.posexplode(F.sequence("a", "b", F.expr("INTERVAL 1 MONTH"))).alias("i", "month"))
    return months.join(counts, "month", "left").select("month", (F.col("i") + 1).cast("long").alias("month_number"), F.coalesce("posts", F.lit(0)).cast("long").alias("posts"))


def longest_run(table: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """First and last month of the longest run of successful consecutive rows; the earlier of equal ones."""
    every = Window.partitionBy(*by).orderBy("month") if by else Window.partitionBy(F.lit(0)).orderBy("month")
    numbered = table.withColumn("__i", F.row_number().over(every)).where("success")
    islands = numbered.withColumn("__g", F.col("__i") - F.row_number().over(every)).groupBy(*by, "__g").agg(F.min("month").alias("start_month"), F.max("month").alias("end_month"), F.count("*").alias("months"))
    best = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    return islands.withColumn("__n", F.row_number().over(best.orderBy(F.desc("months"), "start_month"))).where("__n = 1").select(*by, "start_month", "end_month", "months")


def model_range(first_post: str, start_buffer: int = 0, end_buffer: int = 0, earliest: str = "2006-05-01", end: str = "2022-12-31"):
    """(first, last) month that gets a model: after the later of both starts, before the buffered end."""
    import datetime

    d = datetime.date.fromisoformat
    begin = max(d(first_post[:10]), d(earliest) + datetime.timedelta(weeks=4 * start_buffer))
    stop = d(end) - datetime.timedelta(weeks=4 * end_buffer)
    return (begin.replace(day=1) + datetime.timedelta(days=32)).replace(day=1), (stop.replace(day=1) - datetime.timedelta(days=1)).replace(day=1)
