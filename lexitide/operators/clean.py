"""Rows from raw submissions and comments: projections, row filters, text cleaning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexitide.functions import dates, text

IGNORED = ("[deleted]", "AutoModerator")
DROPPED = ("[deleted]", "[removed]")


def top_level(kind: Column, parent: Column) -> Column:
    """All but comments that do not answer a submission."""
    return ~((kind == "comment") & ~F.coalesce(parent.startswith("t3_"), F.lit(False)))


def posts(raw: DataFrame, top_level_only: bool = True, join_titles: bool = True) -> DataFrame:
    """Post rows of decoded lines (kind, id, author, created_utc, title, selftext, body, parent_id, num_comments).
    Texts lose their line ends, titles only with join_titles."""
    sub = F.col("kind") == "submission"
    rows = raw.where(top_level(F.col("kind"), F.col("parent_id"))) if top_level_only else raw
    return rows.select(
        F.col("id").alias("post_id"),
        "kind",
        "author",
        dates.from_epoch(F.col("created_utc")).alias("created"),
        F.when(sub, text.join_lines(F.col("title")) if join_titles else F.col("title")).otherwise("").alias("title"),
        text.join_lines(F.coalesce("selftext", "body", F.lit(""))).alias("text"),
        F.when(sub, "").otherwise(F.coalesce("parent_id", F.lit(""))).alias("parent_id"),
        F.when(sub, F.col("num_comments").cast("long")).otherwise(F.lit(0).cast("long")).alias("num_comments"),
    )


def activity(raw: DataFrame) -> DataFrame:
    """All activity, whatever it says, with a mark for what starts or answers a submission."""
    return raw.select(
        F.col("id").alias("post_id"),
        "kind",
        top_level(F.col("kind"), F.col("parent_id")).alias("top_level"),
        "author",
        dates.from_epoch(F.col("created_utc")).alias("created"),
        F.lit("").alias("parent_id"),
    )


def known_authors(rows: DataFrame, author: str = "author") -> DataFrame:
    return rows.where(F.col(author).isNotNull() & ~F.col(author).isin(*IGNORED))


def with_text(rows: DataFrame, body: str = "text") -> DataFrame:
    """Rows that say something: not null, empty, 'nan', deleted or removed."""
    t = F.col(body)
    ok = t.isNotNull() & (t != "") & (t != "nan")
    for x in DROPPED:
        ok = ok & ~t.contains(x)
    return rows.where(ok)


def cleaned(rows: DataFrame, mode: str = "urls_only") -> DataFrame:
    return with_text(known_authors(rows)).withColumn("text", text.clean(F.col("text"), mode))


def first_of(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in the given order, which must be total."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def without_header_echo(rows: DataFrame) -> DataFrame:
    """Drops rows in which any value is the name of its own column."""
    echo = F.lit(False)
    for c in rows.columns:
        echo = echo | F.coalesce(F.col(c).cast("string") == c, F.lit(False))
    return rows.where(~echo)


def compare(column: str, op: str, value) -> Column:
    """column == value or <= value; any other op means >=. The value takes the column's type."""
    c = F.col(column)
    return c == value if op == "==" else c <= value if op == "<=" else c >= value
