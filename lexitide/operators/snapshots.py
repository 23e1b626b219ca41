"""Monthly samples, their models, and the scores of the other posts."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexitide.config import Snapshot
from lexitide.functions import dates
from lexitide.operators import katz, months, packed, sampling
from lexitide.operators.users import only, without


def admitted(posts: DataFrame, config: Snapshot, by: tuple[str, ...] = (), experience: str = "experience") -> DataFrame:
    """The month table under the rules of admission; experience-gated if there is a threshold."""
    gate = None if config.threshold_in_days is None else F.coalesce(F.col(experience) >= config.threshold_in_days, F.lit(False))
    return months.month_table(posts, config.users_per_month, config.posts_per_user, by=by, gate=gate)


def sample(posts: DataFrame, config: Snapshot, seed, experience: str = "experience") -> DataFrame:
    """The sampled posts of every month that may be sampled, with their month."""
    table = admitted(posts, config)
    pool = posts if config.threshold_in_days is None else posts.where(F.col(experience) >= config.threshold_in_days)
    pool = pool.withColumn("month", dates.month(F.col("true_date"))).join(F.broadcast(table.where("success").select("month")), "month", "left_semi")
    candidates = pool.groupBy("month", "author").agg(F.count("*").alias("n")).where(F.col("n") >= config.posts_per_user)
    chosen = sampling.sample_users(candidates, config.users_per_month, seed)
    # Posts are drawn by their keys, and their texts are fetched when few are left: at most users_per_month * posts_per_user a month.
    keys = ["month", "author", "post_id"]
    drawn = sampling.sample_posts(only(pool.select(*keys), F.broadcast(chosen), ["month", "author"]), config.posts_per_user, seed)
    drawn = F.broadcast(drawn.select(*(F.col(k).alias(f"__{k}") for k in keys)))
    same = reduce(and_, (F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys))
    return sampling.sample_posts(pool.join(drawn, same, "left_semi"), config.posts_per_user, seed)


def fit(sampled: DataFrame, config: Snapshot, words: str = "text", keep=lambda df, name: df) -> katz.Model:
    return katz.fit(sampled, ["month"], words, leave_unknown=config.leave_unknown, max_size=config.max_vocab_size, max_discount=config.max_discount, gamma=config.gamma, alpha_mode=config.alpha_mode, keep=keep)


def scores(posts: DataFrame, sampled: DataFrame, model: katz.Model, words: str = "text", exclude_training_posts: bool = True) -> DataFrame:
    """(month, post_id, score) of each post under its own month's model; sampled posts are left out."""
    rows = posts.withColumn("month", dates.month(F.col("true_date")))
    got = katz.entropies(rows, model, words=words).select("month", "post_id", "score")
    return without(got, sampled, ["post_id"]) if exclude_training_posts else got


def progressive_scores(posts: DataFrame, sampled: DataFrame, model: katz.Model, delta: int, words: str = "text") -> DataFrame:
    """Scores under the models of neighbouring months m with m - delta <= date < m + delta; only m's own sample is left out.

    Small models are held by every task, and posts stay where they are. Else a bigram of a month is looked up once for
    each of the 2 delta models; the answers stand side by side in one row, so the rows of posts are shuffled once, and
    not once a model.
    """
    if not 1 <= delta <= 12:
        raise ValueError("delta is 1 to 12 months")
    shifts = list(range(1 - delta, delta + 1))
    rows = posts.withColumn("__own", dates.month(F.col("true_date")))
    models = katz.held(model)
    if models is not None:
        names = [f"__m{i}" for i in range(len(shifts))]
        rows = rows.select("post_id", words, *(F.add_months("__own", s).cast("date").alias(n) for n, s in zip(names, shifts, strict=True)))
        got = packed.looked_up(rows, ["month"], [[n] for n in names], "post_id", words, models)
        return without(katz.with_score(got).select("month", "post_id", "score"), sampled, ["month", "post_id"])
    pairs = katz.pairs_of(rows, ["post_id", "__own"], words)
    dealt = lambda df: df.withColumn("__s", F.explode(F.array(*map(F.lit, shifts)))).withColumn("month", F.add_months("__own", F.col("__s")).cast("date"))
    distinct = dealt(pairs.select("__own", "w1", "w2").distinct())
    bits = katz.bits_of(distinct.select("month", "w1", "w2").distinct(), model)
    side = distinct.join(bits, ["month", "w1", "w2"]).groupBy("__own", "w1", "w2").agg(*(F.max(F.when(F.col("__s") == s, F.col("bits"))).alias(f"__b{i}") for i, s in enumerate(shifts)))
    sums = pairs.join(side, ["__own", "w1", "w2"]).groupBy("post_id").agg(F.count("*").alias("__n"), F.array(*(F.sum(f"__b{i}") for i in range(len(shifts)))).alias("__raw"))
    out = dealt(rows.select("post_id", "__own")).join(model.groups.where("success").select("month"), "month", "left_semi")
    out = without(out, sampled, ["month", "post_id"]).join(sums, "post_id", "left")
    raw = F.element_at("__raw", F.col("__s") + delta)
    return out.select("month", "post_id", F.coalesce(F.try_divide(raw, "__n"), F.lit(0.0)).alias("score"))


def wide(progressive: DataFrame, uid: str, months_: list | None = None) -> DataFrame:
    """One column {uid}_ss_{year}_{month} for each month's model."""
    named = progressive.withColumn("__c", F.concat(F.lit(f"{uid}_ss_"), F.year("month"), F.lit("_"), F.month("month")))
    return named.groupBy("post_id").pivot("__c", months_).agg(F.first("score"))


def unscored_as(rows: DataFrame, scored: DataFrame, value: float = -999.0) -> DataFrame:
    """rows with their score, or value where there is none."""
    return rows.join(scored.select("post_id", "score"), "post_id", "left").withColumn("score", F.coalesce("score", F.lit(value)))
