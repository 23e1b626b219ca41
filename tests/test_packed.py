"""Bigrams in columns against dictionaries, and what the queries over them may shuffle."""

from __future__ import annotations

import datetime
import math
from collections import Counter
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexitide.operators import katz, packed, snapshots
from lexitide.plans import registry
from lexitide.sources.shared import Scratch
from tests.test_katz import corpus

ODD = [("a", 1, "the cat the cat sat the cat".split()), ("a", 2, []), ("a", 3, None), ("a", 2, ["one"]), (None, 1, ["é", "𝔘", "é", "𝔘"]), ("b", 1, ["x" * 70_000, "<UNK>", "x y\nz", "", "the"]), ("b", 1, ["the", "cat"])]


def odd(spark):
    return spark.createDataFrame(ODD, "g string, m int, text array<string>")


@pytest.mark.parametrize("by", [[], ["g"], ["g", "m"]], ids=str)
def test_pair_counts_of_odd_posts(spark, by):
    at = {"g": 0, "m": 1}
    want = Counter((*(r[at[k]] for k in by), a, b) for r in ODD for a, b in zip(r[2] or [], (r[2] or [])[1:], strict=False))
    got = packed.pair_counts(odd(spark), by, "text", packed.Outside.nothing(), 20).collect()
    assert {tuple(r)[:-2]: r["n"] for r in got} == want and len(got) == len(want)
    first = Counter()
    for k, n in want.items():
        first[k[:-1]] += n
    assert all(r["total"] == first[tuple(r)[:-3]] for r in got)
    levels = packed.frequencies(odd(spark), by, "text", packed.Outside.nothing(), 20).collect()
    assert {tuple(r)[:-1]: r["n_r"] for r in levels} == Counter((*k[: len(by)], n) for k, n in want.items())


@pytest.mark.parametrize("inside", [True, False])
def test_words_outside_are_renamed_in_their_group_only(spark, inside):
    listed = spark.createDataFrame([("a", "cat"), ("b", "the"), ("z", "sat")], "g string, token string")
    got = packed.pair_counts(odd(spark), ["g"], "text", packed.Outside.of(listed, ["g"], inside=inside), 20)
    words = {("a", "cat"), ("b", "the"), ("z", "sat")}
    name = lambda g, w: w if ((g, w) in words) == inside else "<UNK>"
    want = Counter((g, name(g, a), name(g, b)) for g, _, t in ODD for a, b in zip(t or [], (t or [])[1:], strict=False))
    assert {(r["g"], r["w1"], r["w2"]): r["n"] for r in got.collect()} == want


@pytest.mark.parametrize("size", [1, 3, 7, 100])
def test_chunks_of_any_size_hold_all(monkeypatch, size):
    monkeypatch.setattr(packed, "CHUNK", size)
    texts = [[f"w{j}" for j in range(i % 6)] for i in range(40)]
    batches = pa.table({"i": range(40), "text": texts}).to_batches(max_chunksize=7)
    got = list(packed.chunks(iter(batches), "text"))
    assert [i for t in got for i in t["i"].to_pylist()] == list(range(40))
    assert all(t.num_rows == 1 or sum(map(len, t["text"].to_pylist())) <= size for t in got)


def test_own_entropies_are_those_of_the_fitted_model(spark):
    rows = [(g, 1000 * g + i, p) for g in range(4) for i, p in enumerate(corpus(g, 40 + 30 * g))]
    df = spark.createDataFrame(rows, "g int, post_id long, text array<string>")
    model = katz.fit(df, ["g"], leave_unknown=5, keep=Scratch(spark, "t").save)
    want = {r["post_id"]: (r["n_bigrams"], r["score"]) for r in katz.entropies(df, model).collect()}
    got = katz.own_entropies(df, ["g"], Scratch(spark, "t"), leave_unknown=5).collect()
    assert want and {r["post_id"]: (r["n_bigrams"], pytest.approx(r["score"])) for r in got} == want
    assert all(r["n_words"] == len(rows[[x[1] for x in rows].index(r["post_id"])][2]) for r in got)


def test_large_and_small_models_score_alike(spark, monkeypatch):
    month = lambda g: datetime.datetime(2020, 1 + g, 1)
    rows = [(month(g), 1000 * g + i, p) for g in range(4) for i, p in enumerate(corpus(g, 40 + 30 * g))]
    df = spark.createDataFrame(rows, "true_date timestamp_ntz, post_id long, text array<string>").withColumn("month", F.to_date("true_date"))
    model = katz.fit(df.where("post_id % 3 > 0"), ["month"], leave_unknown=5, smoothing="gt", keep=Scratch(spark, "t").save)
    sampled = df.where("post_id % 7 = 0")

    def both():
        one = katz.entropies(df, model).collect()
        more = snapshots.progressive_scores(df, sampled, model, 2).collect()
        return {(r["month"], r["post_id"]): (r["n_bigrams"], round(r["raw"], 9), round(r["score"], 9)) for r in one}, {(r["month"], r["post_id"]): round(r["score"], 9) for r in more}

    small = both()
    monkeypatch.setattr(katz, "HELD", 0)
    assert small == both() and len(small[0]) == len(rows) and len(small[1]) > 2 * len(rows)


def test_small_models_shuffle_no_posts(spark):
    df = spark.createDataFrame([(0, i, p) for i, p in enumerate(corpus(3, 100))], "g int, post_id long, text array<string>")
    model = katz.fit(df, ["g"], leave_unknown=5, smoothing="gt", keep=Scratch(spark, "t").save)
    assert "Exchange" not in katz.entropies(df, model)._jdf.queryExecution().executedPlan().toString()


def test_grid_search_counts_posts_once_and_scores_unknown_words(spark):
    train = spark.createDataFrame([(0, i, p) for i, p in enumerate(corpus(3, 100))], "g int, post_id long, text array<string>")
    unseen = spark.createDataFrame([(0, -1, ["<s>", "the", "zzz", "t", "</s>"]), (0, -2, ["<s>"])], "g int, post_id long, text array<string>")
    for size, got in ((r["vocab_size"], r) for r in katz.grid_search(train, unseen, ["g"], [5, 20], [0.5], [0.9]).collect()):
        model = katz.fit(train, ["g"], max_size=size, leave_unknown=None, smoothing="gt")
        sums = katz.entropies(unseen, model).agg(F.sum("raw"), F.sum("n_bigrams")).first()
        assert got["entropy"] == pytest.approx(sums[0] / sums[1]) and got["actual_vocab_size"] == size and math.isfinite(got["perplexity"])


@pytest.mark.parametrize("name,times", [("bigram_counts", 8), ("turing_cstars", 8), ("katz_alphas", 10), ("post_entropy", 9), ("progressive_scores", 3), ("grid_search", 12)])
def test_what_queries_shuffle(spark, name, times):
    """Bytes that shuffles write, as multiples of the documents; before, 26 to 110."""
    data = "/root/testdata/sf0.01"
    gateway = spark.sparkContext._gateway

    def written():
        stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    before = written()
    registry.queries()[name](spark, data).write.format("noop").mode("overwrite").save()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    assert written() - before <= times * Path(data, "documents.parquet").stat().st_size
