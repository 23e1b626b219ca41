"""Numbers and dates of each author's posts, and experience: saturating cumulative time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexitide.functions import dates

DAY = 86400.0


def seconds(posts: DataFrame, users: DataFrame | None, created: str = "created", author: str = "author", strict: bool = False) -> DataFrame:
    """Seconds since the corpus' first post, and since the author's (from users, or else from the posts). strict: authors without a profile are an error, not null seconds."""
    start = posts.agg(F.min(created).alias("__start"))
    if users is None:
        rows = posts.withColumn("__first", F.min(created).over(Window.partitionBy(author)))
    else:
        rows = posts.join(users.select(F.col("author").alias(author), F.col("first_post").alias("__first")), author, "left")
    if strict:
        rows = rows.withColumn("__first", F.coalesce("__first", F.when(F.col(author).isNotNull(), F.raise_error(F.concat(F.lit("no profile of author "), F.col(author).cast("string"))).cast("timestamp_ntz"))))
    rows = rows.crossJoin(F.broadcast(start))  # one row
    out = rows.withColumn("seconds", dates.seconds_between(F.col("__start"), F.col(created))).withColumn("user_seconds", dates.seconds_between(F.col("__first"), F.col(created)))
    return out.drop("__start", "__first")


def within(posts: DataFrame, first: int, last: int, seconds: str = "user_seconds") -> DataFrame:
    """Posts of an age, in seconds since the author's first, from first to last, both included."""
    return posts.where(F.col(seconds).between(first, last))


def numbered(posts: DataFrame, author: str = "author", order: tuple[str, ...] = ("seconds", "post_id")) -> DataFrame:
    """total_user_posts and post_number, from 0, in one shuffle by author."""
    w = Window.partitionBy(author)
    return posts.withColumn("total_user_posts", F.count("*").over(w)).withColumn("post_number", F.row_number().over(w.orderBy(*order)) - 1)


def dated(posts: DataFrame, start: str) -> DataFrame:
    """true_date from seconds and the corpus' first instant."""
    return posts.withColumn("true_date", dates.plus_seconds(F.lit(start).cast("timestamp_ntz"), F.col("seconds")))


def gaps(activity: DataFrame, author: str = "author", when: str = "true_date", key: str = "post_id") -> DataFrame:
    """dt: days since the author's previous activity, null on the first."""
    w = Window.partitionBy(author).orderBy(when, key)
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    return activity.withColumn("dt", (us(F.col(when)) - us(F.lag(when).over(w))) / F.lit(1e6 * DAY))


def mean_gap(activity: DataFrame, author: str = "author", when: str = "true_date") -> DataFrame:
    """One row, k: the mean gap in days of all authors. Gaps of an author add up to last minus first, so none is computed.

    Spans are added up as decimals: the microseconds of some 40,000 authors over seven years are beyond a long.
    """
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    own = activity.groupBy(author).agg((us(F.max(when)) - us(F.min(when))).alias("span"), (F.count(when) - 1).alias("n"))
    return own.where("n > 0").agg((F.sum(F.col("span").cast("decimal(19,0)")).cast("double") / F.sum("n") / F.lit(1e6 * DAY)).alias("k"))


def experience(activity: DataFrame, author: str = "author", when: str = "true_date", key: str = "post_id") -> DataFrame:
    """dt and experience: the running sum of k * (1 - exp(-dt / k)), k the mean gap of all authors."""
    k = mean_gap(activity, author, when).select(F.col("k").alias("__k"))
    w = Window.partitionBy(author).orderBy(when, key).rowsBetween(Window.unboundedPreceding, 0)
    delta = F.when(F.col("dt").isNull() | (F.coalesce("__k", F.lit(0.0)) == 0), 0.0).otherwise(F.col("__k") * (1 - F.exp(-F.col("dt") / F.col("__k"))))
    return gaps(activity.crossJoin(F.broadcast(k)), author, when, key).withColumn("experience", F.sum(delta).over(w)).drop("__k")
