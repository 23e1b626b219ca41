"""Seeded samples by hash order: the same on any cluster, any partitioning, and in SQL."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw_key(seed, *columns: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(c).cast("string") for c in columns)))


def sample_users(candidates: DataFrame, n: int, seed, by: tuple[str, ...] = ("month",), author: str = "author") -> DataFrame:
    """n authors of each group without replacement. The rank limit also runs before the shuffle."""
    w = Window.partitionBy(*by).orderBy(draw_key(seed, *by, author), author)
    return candidates.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")


def sample_posts(posts: DataFrame, m: int, seed, by: tuple[str, ...] = ("month", "author"), key: str = "post_id") -> DataFrame:
    """m posts of each author of each group."""
    w = Window.partitionBy(*by).orderBy(draw_key(seed, key), key)
    return posts.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= m).drop("__n")


def split(rows: DataFrame, key: str, share: float = 0.8, seed=42) -> DataFrame:
    """part: train for about share of the keys, validation for the rest."""
    x = F.conv(F.substring(draw_key(seed, key), 1, 8), 16, 10).cast("double") / float(1 << 32)
    return rows.withColumn("part", F.when(x < share, "train").otherwise("validation"))


def grid(**lists) -> list[dict]:
    """All combinations of the listed parameter values."""
    return [dict(zip(lists, x, strict=True)) for x in product(*lists.values())]
