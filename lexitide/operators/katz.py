"""Katz back-off bigram models with Simple Good-Turing discounts, one for each group of the key columns.

All groups (runs, months) are fitted in one job. Bigrams are counted in one shuffle of packed columns (packed.py) and
known by their words from then on: what a model adds to them are small tables, which are broadcast.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexitide.functions.text import UNKNOWN, bigrams
from lexitide.operators import packed

NO_FOLLOWER = 0.1
#: Words that are named to every task, bigrams of a model that every task holds (16 bytes each), and rows of a table that is broadcast.
NAMED, HELD, BROADCAST = 1 << 18, 1 << 21, 1 << 18
#: Groups of which a stored model is written by all tasks.
FEW = 64


@dataclass
class Model:
    """by: the key columns. vocab(by, token, rank), bigrams(by, w1, w2, n, p_ml, discount, p), unigrams(by, w, n, p),
    alphas(by, w1, alpha), cstars(by, r, n_r, c_star), groups(by, success, reason)."""

    by: list[str]
    vocab: DataFrame
    bigrams: DataFrame
    unigrams: DataFrame
    alphas: DataFrame
    cstars: DataFrame
    groups: DataFrame

    TABLES = ("vocab", "bigrams", "unigrams", "alphas", "cstars", "groups")

    def save(self, path: str) -> None:
        """A folder for each group in every table but the small one of groups, so one month is read alone.

        Of few groups each task writes a file for each; of many, rows are gathered to a few files a group first.
        """
        few = self.groups.count() <= FEW
        for t in self.TABLES:
            df = getattr(self, t)
            if self.by and t != "groups":
                dealt = df if few else df.repartition(*self.by, F.pmod(F.xxhash64(*df.columns), F.lit(4)))
                dealt.write.mode("overwrite").partitionBy(*self.by).parquet(f"{path}/{t}")
            else:
                df.write.mode("overwrite").parquet(f"{path}/{t}")

    @classmethod
    def load(cls, spark, path: str, by: list[str], only: Column | None = None) -> Model:
        """The model, or the groups that meet a condition on the key columns: the others' folders are not read. Keys keep their types, whatever they look like."""
        groups = spark.read.parquet(f"{path}/groups")
        kinds = {f.name: f.dataType for f in groups.schema.fields}
        inference = "spark.sql.sources.partitionColumnTypeInference.enabled"
        before = spark.conf.get(inference)
        spark.conf.set(inference, "false")
        try:
            tables = [groups if t == "groups" else spark.read.parquet(f"{path}/{t}") for t in cls.TABLES]
        finally:
            spark.conf.set(inference, before)
        tables = [df.withColumns({c: F.col(c).cast(kinds[c]) for c in by}) if by else df for df in tables]
        return cls(by, *(df.where(only) if only is not None else df for df in tables))


def token_counts(posts: DataFrame, by: list[str], words: str = "text") -> DataFrame:
    # The outer form: the inner one would have the optimiser compute words a second time, to filter empty ones.
    return posts.select(*by, F.explode_outer(words).alias("token")).where("token IS NOT NULL").groupBy(*by, "token").agg(F.count("*").alias("n"))


def vocabulary(counts: DataFrame, by: list[str], max_size: int | None = None, leave_unknown: float | int | None = None) -> DataFrame:
    """The most frequent tokens of each group, ties by token: max_size of them, or all but leave_unknown (a number, or a share below 1).

    Neither sorts all types of a group: counts of counts show which count the last token has, so only
    tokens from there on up are ranked; and what a number leaves out is ranked from the rare end.
    """
    if max_size is None and not leave_unknown:
        return counts
    if max_size is None and not isinstance(leave_unknown, float):
        left_out = rare(counts, by, int(leave_unknown))
        return counts.join(F.broadcast(left_out) if leave_unknown <= 1000 else left_out, [*by, "token"], "left_anti")
    levels = counts.groupBy(*by, "n").agg(F.count("*").alias("__t"))
    down = Window.partitionBy(*by).orderBy(F.desc("n"))
    size = F.lit(max_size) if max_size is not None else (F.sum("__t").over(Window.partitionBy(*by)) * F.lit(1 - leave_unknown)).cast("int")
    before = F.coalesce(F.sum("__t").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = levels.select(*by, "n", size.alias("__k"), before.alias("__b")).where("__b < __k").groupBy(*by).agg(F.min("n").alias("__n"), F.first("__k").alias("__k"))
    rows = counts.join(F.broadcast(last), by) if by else counts.crossJoin(F.broadcast(last))  # a row a group
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), "token"))
    return rows.where("n >= __n").withColumn("rank", rank).where("rank <= __k").drop("__n", "__k")


def rare(counts: DataFrame, by: list[str], n: int) -> DataFrame:
    """The n rarest tokens of each group. The rank limit also runs before the shuffle."""
    up = Window.partitionBy(*by).orderBy("n", F.desc("token"))
    return counts.withColumn("__r", F.row_number().over(up)).where(F.col("__r") <= n).select(*by, "token")


def small(df: DataFrame) -> DataFrame:
    """Marks a table for broadcast if it has few rows, which are counted: it should be stored or cheap."""
    return F.broadcast(df) if df.limit(BROADCAST + 1).count() <= BROADCAST else df


def outside(counts: DataFrame, vocab: DataFrame, by: list[str], max_size, leave_unknown, own: bool = True) -> packed.Outside | None:
    """What a vocabulary leaves out of its counts, or else what it holds, whichever is few words; None if both are many.

    Only what it holds serves posts that were not counted (own is false).
    """
    if own and max_size is None and not leave_unknown:
        return packed.Outside.nothing()
    here = vocab.count()
    if own and counts.count() - here <= NAMED:
        left = rare(counts, by, int(leave_unknown)) if max_size is None and not isinstance(leave_unknown, float) else counts.join(vocab.select(*by, "token"), [*by, "token"], "left_anti")
        return packed.Outside.of(left, by)
    return packed.Outside.of(vocab, by, inside=True) if here <= NAMED else None


def known_pairs(posts: DataFrame, by: list[str], words: str, counts: DataFrame, vocab: DataFrame, max_size=None, leave_unknown=None, own: bool = True) -> DataFrame:
    """(by, w1, w2, n, total): bigrams with words outside the vocabulary as <UNK>, and how often the first word is followed. own: the posts are those that were counted."""
    spec = outside(counts, vocab, by, max_size, leave_unknown, own)
    if spec is not None:
        return packed.pair_counts(posts, by, words, spec, counts.agg(F.sum("n")).first()[0] or 0)
    return totals(known(pair_counts(posts, by, words), vocab, by), by)


def known_frequencies(posts: DataFrame, by: list[str], words: str, counts: DataFrame, vocab: DataFrame, max_size=None, leave_unknown=None) -> DataFrame:
    """frequencies() of known_pairs(), without these."""
    spec = outside(counts, vocab, by, max_size, leave_unknown)
    if spec is not None:
        return packed.frequencies(posts, by, words, spec, counts.agg(F.sum("n")).first()[0] or 0)
    return frequencies(known_pairs(posts, by, words, counts, vocab, max_size, leave_unknown), by)


def totals(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Bigrams counted again, as after a change of words, with the totals of their first words."""
    got = pairs.groupBy(*by, "w1", "w2").agg(F.sum("n").alias("n"))
    return got.withColumn("total", F.sum("n").over(Window.partitionBy(*by, "w1")))


def pair_counts(posts: DataFrame, keys: list[str], words: str = "text") -> DataFrame:
    """(keys, w1, w2, n): how often each bigram occurs for the keys."""
    return posts.select(*keys, F.inline_outer(bigrams(F.col(words)))).where("w1 IS NOT NULL").groupBy(*keys, "w1", "w2").agg(F.count("*").alias("n"))


def known(pairs: DataFrame, vocab: DataFrame, by: list[str], columns=("w1", "w2")) -> DataFrame:
    """Words outside the group's vocabulary become <UNK>."""
    for c in columns:
        v = vocab.select(*by, F.col("token").alias(c), F.lit(True).alias("__in"))
        pairs = pairs.join(v, [*by, c], "left").withColumn(c, F.when(F.col("__in"), F.col(c)).otherwise(UNKNOWN)).drop("__in")
    return pairs


def frequencies(counts: DataFrame, by: list[str]) -> DataFrame:
    """(by, r, n_r): how many bigrams occur r times."""
    return counts.groupBy(*by, F.col("n").alias("r")).agg(F.count("*").alias("n_r"))


def quantile(p_value: float) -> float:
    """The two-sided quantile of the normal distribution: 1.96 for 0.05."""
    return NormalDist().inv_cdf(1 - p_value / 2)


def good_turing(freq: DataFrame, by: list[str], p_value: float = 0.05) -> tuple[DataFrame, DataFrame]:
    """(cstars, groups). Ascending r: Turing's estimate while it differs significantly from the smoothed one, then the latter for good.

    A group fails if the fitted slope is above -1 or unknown, or if r + 1 is missing before the switch.
    """
    w = Window.partitionBy(*by).orderBy("r")
    r, z = F.col("r").cast("double"), F.col("z")
    before, after = F.coalesce(F.lag("r").over(w), F.lit(0)), F.lead("r").over(w)
    after = F.coalesce(after, 2 * F.col("r") - F.lag("r").over(w))
    total = F.sum("n_r").over(Window.partitionBy(*by))
    base = freq.withColumn("z", 2 * (F.col("n_r") / total) / F.nullif(after - before, F.lit(0)))
    base = base.withColumn("n_next", F.when(F.lead("r").over(w) == F.col("r") + 1, F.lead("n_r").over(w)).cast("double"))
    line = base.groupBy(*by).agg(F.regr_slope(F.ln(z), F.ln(r)).alias("a"), F.regr_intercept(F.ln(z), F.ln(r)).alias("b"))
    s = lambda x: F.exp(F.col("a") * F.ln(x) + F.col("b"))
    n = F.col("n_r").cast("double")
    x = (r + 1) * F.col("n_next") / n
    width = quantile(p_value) * F.sqrt((r + 1) * (r + 1) * (F.col("n_next") / (n * n)) * (1 + F.col("n_next") / n))
    both = base.join(line, by) if by else base.crossJoin(F.broadcast(line))
    both = both.withColumn("x", x).withColumn("y", (r + 1) * s(r + 1) / s(r)).withColumn("width", width)
    every = Window.partitionBy(*by)
    switch = F.min(F.when(F.abs(F.col("x") - F.col("y")) <= F.col("width"), F.col("r"))).over(every)
    gap = F.min(F.when(F.col("n_next").isNull(), F.col("r"))).over(every)
    both = both.withColumn("r_switch", switch).withColumn("r_gap", gap)
    reason = F.when(F.col("a").isNull() | F.isnan("a"), "degenerate").when(F.col("a") > -1, "slope").when(F.col("r_switch").isNull() | (F.col("r_gap") < F.col("r_switch")), "gap")
    both = both.withColumn("reason", reason)
    groups = both.groupBy(*by).agg(F.min("reason").alias("reason"), F.min("a").alias("slope"), F.min("b").alias("intercept"), F.min("r_switch").alias("r_switch")).withColumn("success", F.col("reason").isNull())
    cstars = both.where("reason IS NULL").select(*by, "r", "n_r", F.when(F.col("r") < F.col("r_switch"), F.col("x")).otherwise(F.col("y")).alias("c_star"))
    return cstars, groups


def plain_turing(freq: DataFrame, by: list[str], default: float) -> tuple[DataFrame, DataFrame]:
    """c* = (r + 1) N(r + 1) / N(r); where N(r + 1) is 0, c* / r is the default discount."""
    up = Window.partitionBy(*by).orderBy("r")
    n_next = F.when(F.lead("r").over(up) == F.col("r") + 1, F.lead("n_r").over(up))
    c = F.coalesce((F.col("r") + 1) * F.col("n_next") / F.col("n_r"), F.col("r") * F.lit(float(default)))
    cstars = freq.withColumn("n_next", n_next).select(*by, "r", "n_r", c.alias("c_star"))
    return cstars, freq.select(*by).distinct().withColumn("success", F.lit(True)).withColumn("reason", F.lit(None).cast("string"))


def unigram_model(counts: DataFrame, vocab: DataFrame, by: list[str], gamma: float) -> DataFrame:
    """Lidstone probabilities for the vocabulary and <UNK>, seen or not; the vocabulary's size counts <UNK>.

    vocab has the counts of its tokens, a part of counts; the rest of a group's counts are those of <UNK>.
    """
    every = counts.groupBy(*by).agg(F.sum("n").alias("__n"))
    mine = vocab.groupBy(*by).agg(F.sum("n").alias("__m"), F.count("*").alias("__v"))
    sums = every.join(F.broadcast(mine), by, "left") if by else every.crossJoin(F.broadcast(mine))  # a row a group
    sums = sums.select(*by, "__n", F.coalesce("__m", F.lit(0)).alias("__m"), (F.coalesce("__v", F.lit(0)) + 1).alias("__v"))
    rows = vocab.select(*by, F.col("token").alias("w"), "n")
    rows = rows.join(F.broadcast(sums), by) if by else rows.crossJoin(F.broadcast(sums))
    rows = rows.unionByName(sums.withColumns({"w": F.lit(UNKNOWN), "n": F.col("__n") - F.col("__m")}))
    return rows.select(*by, "w", "n", ((F.col("n") + gamma) / (F.col("__n") + gamma * F.col("__v"))).alias("p"))


def alphas(pairs: DataFrame, unigrams: DataFrame, by: list[str], mode: str = "reference") -> DataFrame:
    """Back-off weights. Mode "reference" divides by the sum over followers of P(first character), as published results do;
    "katz" by 1 minus the sum of P(follower). Contexts never followed, and zero denominators, get 0.1."""
    w = F.col("w2")
    if mode == "reference":
        one = small(unigrams.where(F.length("w") == 1).select(*by, F.col("w").alias("__c"), F.col("p").alias("__p")))  # no other equals a character
        unk = unigrams.where(F.col("w") == UNKNOWN).select(*by, F.col("p").alias("__u"))
        rows = pairs.withColumn("__c", F.substring(w, 1, 1)).join(one, [*by, "__c"], "left")
        rows = rows.join(F.broadcast(unk), by, "left") if by else rows.crossJoin(F.broadcast(unk))  # a row a group
        below = F.sum(F.coalesce("__p", "__u"))
    else:
        rows = pairs.join(unigrams.select(*by, F.col("w").alias("w2"), F.col("p").alias("__p")), [*by, "w2"], "left")
        below = 1 - F.sum("__p")
    got = rows.groupBy(*by, "w1").agg((1 - F.sum("p")).alias("above"), below.alias("below"))
    got = got.select(*by, "w1", F.try_divide("above", "below").alias("alpha"))
    return unigrams.select(*by, F.col("w").alias("w1")).join(got, [*by, "w1"], "left").select(*by, "w1", F.coalesce("alpha", F.lit(NO_FOLLOWER)).alias("alpha"))


def fit(posts: DataFrame, by: list[str], words: str = "text", *, leave_unknown=100, max_size=None, max_discount: float = 0.9, gamma: float = 0.2, alpha_mode: str = "reference", smoothing: str = "sgt", default_discount: float = 0.5, p_value: float = 0.05, keep=lambda df, name: df) -> Model:
    """A model for each group of posts. keep(df, name) may write a table that several others read and give back the stored one."""
    counts = keep(token_counts(posts, by, words), "tokens")
    vocab = keep(vocabulary(counts, by, max_size, leave_unknown), "vocab")
    pairs = keep(known_pairs(posts, by, words, counts, vocab, max_size, leave_unknown), "pairs")
    return of_pairs(pairs, counts, vocab, by, max_discount=max_discount, gamma=gamma, alpha_mode=alpha_mode, smoothing=smoothing, default_discount=default_discount, p_value=p_value, keep=keep)


def of_pairs(pairs: DataFrame, counts: DataFrame, vocab: DataFrame, by: list[str], *, max_discount: float, gamma: float, alpha_mode: str, smoothing: str, default_discount: float, p_value: float = 0.05, keep=lambda df, name: df) -> Model:
    """The model of counted bigrams(by, w1, w2, n, total)."""
    unigrams = keep(unigram_model(counts, vocab, by, gamma), "unigrams")
    freq = keep(frequencies(pairs, by), "frequencies")
    cstars, groups = good_turing(freq, by, p_value) if smoothing == "sgt" else plain_turing(freq, by, default_discount)
    cstars = keep(cstars, "cstars")
    seen = pairs.join(small(cstars.select(*by, F.col("r").alias("n"), "c_star")), [*by, "n"])
    seen = seen.withColumn("p_ml", F.col("n") / F.col("total")).withColumn("discount", F.least(F.col("c_star") / F.col("n"), F.lit(float(max_discount))))
    seen = seen.withColumn("p", F.col("discount") * F.col("p_ml")).select(*by, "w1", "w2", "n", "p_ml", "discount", "p")
    groups = keep(groups, "groups")
    good = groups.where("success").select(*by)
    only = (lambda df: df.join(F.broadcast(good), by, "left_semi")) if by else (lambda df: df)  # a row a group
    return Model(by, only(vocab), seen, only(unigrams), only(alphas(seen, unigrams, by, alpha_mode)), cstars, groups)


def probabilities(pairs: DataFrame, model: Model, mapped: bool = False) -> DataFrame:
    """pairs(by, w1, w2, ...) with the probability of each bigram in the group's model; pairs of groups without one go. mapped: words outside its vocabulary are <UNK> already."""
    by = model.by
    mine = pairs.join(model.groups.where("success").select(*by), by, "left_semi") if by else pairs
    rows = (mine if mapped else known(mine, model.vocab, by)).join(model.bigrams.select(*by, "w1", "w2", "p"), [*by, "w1", "w2"], "left")
    rows = rows.join(model.alphas, [*by, "w1"], "left").join(model.unigrams.select(*by, F.col("w").alias("w2"), F.col("p").alias("p_u")), [*by, "w2"], "left")
    return rows.withColumn("prob", F.coalesce("p", F.col("alpha") * F.col("p_u"))).drop("p", "alpha", "p_u")


def pairs_of(posts: DataFrame, keys: list[str], words: str = "text") -> DataFrame:
    """(keys, w1, w2): a row for each bigram of each post, in no shuffle."""
    return posts.select(*keys, F.inline_outer(bigrams(F.col(words)))).where("w1 IS NOT NULL")


def bits_of(pairs: DataFrame, model: Model, log: str = "log2") -> DataFrame:
    """(by, w1, w2, bits) for distinct pairs(by, w1, w2), under the words as they are: each is looked up once, however many posts hold it."""
    by = model.by
    looked = probabilities(pairs.select(*by, "w1", "w2", F.col("w1").alias("__1"), F.col("w2").alias("__2")), model)
    return looked.select(*by, F.col("__1").alias("w1"), F.col("__2").alias("w2"), (-(F.log2("prob") if log == "log2" else F.ln("prob"))).alias("bits"))


def held(model: Model) -> dict | None:
    """The models in arrays for every task, if they are small: counted first, so they should be stored or cheap."""
    if model.bigrams.limit(HELD + 1).count() > HELD or model.unigrams.limit(HELD // 4 + 1).count() > HELD // 4:
        return None
    by = model.by
    return packed.held(model.bigrams.select(*by, "w1", "w2", "p").toArrow(), model.unigrams.select(*by, "w", "p").toArrow(), model.alphas.select(*by, "w1", "alpha").toArrow(), by)


def with_score(sums: DataFrame) -> DataFrame:
    return sums.withColumn("score", F.coalesce(F.try_divide("raw", "n_bigrams"), F.lit(0.0)))


def entropies(posts: DataFrame, model: Model, key: str = "post_id", words: str = "text", log: str = "log2") -> DataFrame:
    """(by, key, n_bigrams, raw, score): cross-entropy of each post; 0 for posts without bigrams.

    Small models are held by every task, and posts stay where they are. Else rows of posts pass two shuffles, one by
    bigram and one by post; vocabulary and model meet distinct bigrams only.
    """
    by = model.by
    models = held(model)
    if models is not None:
        return with_score(packed.looked_up(posts, by, [by], key, words, models, log)).select(*by, key, "n_bigrams", "raw", "score")
    good = model.groups.where("success").select(*by)
    mine = posts.join(good, by, "left_semi") if by else posts
    rows = pairs_of(mine, [*by, key], words)
    bits = bits_of(rows.select(*by, "w1", "w2").distinct(), model, log)
    sums = rows.join(bits, [*by, "w1", "w2"]).groupBy(*by, key).agg(F.count("*").alias("n_bigrams"), F.sum("bits").alias("raw"))
    out = mine.select(*by, key).join(sums, [*by, key], "left")
    return with_score(out.select(*by, key, F.coalesce("n_bigrams", F.lit(0)).cast("long").alias("n_bigrams"), F.coalesce("raw", F.lit(0.0)).alias("raw")))


def own_entropies(posts: DataFrame, by: list[str], scratch, key: str = "post_id", words: str = "text", *, leave_unknown=100, max_size=None, max_discount: float = 0.9, p_value: float = 0.05) -> DataFrame:
    """(by, key, n_bigrams, n_words, raw, score): posts under the model of their own group that was fitted on just these posts.

    All their bigrams are among the model's, so no model is made: bigrams are counted where their chunks' rows meet, and
    the counts go back to the chunks. What passes the shuffles are distinct bigrams of chunks. scratch holds the tables.
    """
    rows = scratch.save(posts.select(*by, key, words), "posts")
    counts = scratch.save(token_counts(rows, by, words), "tokens")
    vocab = vocabulary(counts, by, max_size, leave_unknown)
    spec = outside(counts, vocab, by, max_size, leave_unknown)
    if spec is None:
        model = fit(rows, by, words, leave_unknown=leave_unknown, max_size=max_size, max_discount=max_discount, p_value=p_value, keep=scratch.save)
        return entropies(rows, model, key, words).join(rows.select(*by, key, F.size(words).cast("long").alias("n_words")), [*by, key])
    n = counts.agg(F.sum("n")).first()[0] or 0
    keys = packed.fields(rows, by)
    stored = scratch.save(packed.kept(rows, by, key, words, spec, n), "chunks")
    scratch.drop("posts", "tokens")
    answered = scratch.save(packed.answers(stored, by, n), "answers")
    freq = scratch.save(packed.answered_frequencies(answered, by, keys), "frequencies")
    stars = good_turing(freq, by, p_value)[0]
    discounts = stars.withColumn("d", F.least(F.col("c_star") / F.col("r"), F.lit(float(max_discount))))
    got = packed.scored(stored, answered, by, [*keys, f"__key {dict(rows.dtypes)[key]}"], discounts, n)
    return with_score(got.withColumnRenamed("__key", key))


def evaluation(scored: DataFrame, by: list[str]) -> DataFrame:
    """Per group: entropy per bigram, mean entropy of posts, perplexity."""
    got = scored.groupBy(*by).agg(F.try_divide(F.sum("raw"), F.sum("n_bigrams")).alias("entropy"), F.avg("score").alias("mean_entropy"), F.count("*").alias("posts"))
    return got.withColumn("perplexity", F.pow(F.lit(2.0), "entropy"))


def grid_search(train: DataFrame, validation: DataFrame, by: list[str], vocab_sizes, default_discounts, max_discounts, words: str = "text", keep=lambda df, name: df) -> DataFrame:
    """Entropy and perplexity of validation posts for all combinations of parameters (plain Good-Turing).

    Both need bigrams of groups, not of posts: posts are counted once, under the largest vocabulary, and the smaller ones,
    which are parts of it, rename the words of those counts.
    """
    counts = keep(token_counts(train, by, words), "tokens")
    most = max(vocab_sizes)
    largest = keep(vocabulary(counts, by, most), "vocab")
    learnt = keep(known_pairs(train, by, words, counts, largest, most), "train")
    asked = keep(known_pairs(validation, by, words, counts, largest, most, own=False), "validation")
    groups = keep(validation.select(*by).distinct(), "groups") if by else None
    out, done = None, {}
    for i, (v, d, m) in enumerate(itertools.product(vocab_sizes, default_discounts, max_discounts)):
        if v not in done:
            vocab = largest.where(F.col("rank") <= v)
            again = lambda df, name: df if v == most else keep(totals(known(df, small(vocab), by), by), f"{v}-{name}")  # noqa: B023, E731
            done[v] = vocab, again(learnt, "train"), again(asked, "validation")
        vocab, pairs, wanted = done[v]
        model = of_pairs(pairs, counts, vocab, by, max_discount=m, gamma=0.2, alpha_mode="reference", smoothing="gt", default_discount=d, keep=lambda df, name: keep(df, f"{i}-{name}"))  # noqa: B023
        size = model.vocab.groupBy(*by).agg(F.count("*").alias("actual_vocab_size"))
        looked = probabilities(wanted.drop("total"), model, mapped=True).groupBy(*by).agg(F.sum(-F.col("n") * F.log2("prob")).alias("raw"), F.sum("n").alias("n_bigrams"))
        if by:
            looked = groups.join(model.groups.where("success").select(*by), by, "left_semi").join(looked, by, "left")
        entropy = F.try_divide("raw", "n_bigrams")
        got = looked.select(*by, entropy.alias("entropy"), F.pow(F.lit(2.0), entropy).alias("perplexity"))
        got = got.join(size, by) if by else got.crossJoin(F.broadcast(size))
        row = got.select(F.lit(v).cast("long").alias("vocab_size"), F.lit(float(d)).alias("default_discount"), F.lit(float(m)).alias("max_discount"), *by, "actual_vocab_size", "entropy", "perplexity")
        out = row if out is None else out.unionByName(row)
    return out
