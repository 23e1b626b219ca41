from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import pytest

from lexitide.llm import language
from tests.llm import rows

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    return language.train(docs.where(~language.fold()).select("text", "lang"))


def test_held_out_accuracy(spark):
    truth = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang")
    got = language.op6(spark, DATA).join(truth, "doc_id").where("held_out AND lang IS NOT NULL AND lang_pred != 'und'").collect()
    assert len(got) > 100 and np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.98
    assert all(0 <= r["score"] <= 1 for r in got)


def test_fold_is_the_crc(spark):
    got = language.op6(spark, DATA).select("doc_id", "held_out").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)


def test_held_out_rows_do_not_train(spark):
    """Labels of held-out rows may change without any effect."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    from pyspark.sql import functions as F

    other = docs.withColumn("lang", F.when(language.fold(), "xx").otherwise(F.col("lang")))
    a, b = (language.train(d.where(~language.fold()).select("text", "lang")) for d in (docs, other))
    assert a[0] == b[0] and (a[1] == b[1]).all()


def test_mixtures(spark, model):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("length(text) BETWEEN 1500 AND 4000").select("lang", "text").collect()
    text = {}
    for r in docs:
        text.setdefault(r["lang"], r["text"])
    langs = sorted(text)
    for a in langs:
        only = language.identify(text[a], *model)
        assert only[0] == a and [x for x, _ in only[2]] == [a]
        for b in langs:
            if a < b:
                got = language.identify(text[a][:1400] + " " + text[b][:1400], *model)
                assert {x for x, _ in got[2]} == {a, b} and abs(sum(s for _, s in got[2]) - 1) < 1e-6


def test_likelihood_never_falls(model):
    r = np.random.default_rng(0)
    p, c = model[1][r.integers(0, language.BUCKETS, 300)], r.integers(1, 5, 300).astype(float)
    one = [language.shares(p, c, np.array([i]))[1] for i in range(p.shape[1])]
    pi, both = language.shares(p, c, np.arange(p.shape[1]))
    assert both >= max(one) - 1e-9 and abs(pi.sum() - 1) < 1e-9


def plain_mixture(text, langs, table):
    """Expectation-maximisation and the search for the set, one trigram after the other in dictionaries."""
    data = (" " + text.lower() + " ").encode()
    clean = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in data)
    counts: dict = {}
    for i in range(len(clean) - 2):
        a, b, c = clean[i : i + 3]
        if not (b == 32 and 32 in (a, c)):
            code = ((a * 65536 + b * 256 + c) * 2654435761) % 2**32 >> 16
            counts[code] = counts.get(code, 0) + 1
    total = sum(counts.values())
    p = {g: [float(x) for x in table[g]] for g in counts}

    def em(chosen):
        share = {x: 1 / len(chosen) for x in chosen}
        for _ in range(language.ROUNDS if len(chosen) > 1 else 0):
            new = dict.fromkeys(chosen, 0.0)
            for g, n in counts.items():
                whole = sum(share[x] * p[g][x] for x in chosen)
                for x in chosen:
                    new[x] += n * share[x] * p[g][x] / whole / total
            moved = max(abs(new[x] - share[x]) for x in chosen)
            share = new
            if moved < 1e-4:
                break
        return share, sum(n * math.log(sum(share[x] * p[g][x] for x in chosen)) for g, n in counts.items())

    every, _ = em(list(range(len(langs))))
    alone = {x: em([x])[1] for x in range(len(langs))}
    best = max(alone, key=lambda x: (alone[x], -x))
    chosen, share, level = [best], {best: 1.0}, alone[best]
    if sorted(every.values())[-2] > language.TRACE:
        while True:
            tried = [(em([*chosen, x]), x) for x in every if x not in chosen and every[x] > language.TRACE / 2]
            if not tried:
                break
            (new, reached), x = max(tried, key=lambda t: t[0][1])
            if reached - level <= language.PENALTY * math.log(total):
                break
            chosen, share, level = [*chosen, x], new, reached
    return {langs[x]: s for x, s in share.items()}


def test_mixtures_against_plain_expectation_maximisation(spark, model):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("lang IS NOT NULL AND length(text) BETWEEN 200 AND 3000").orderBy("doc_id").limit(60).collect()
    texts = [r["text"][:700] for r in docs] + [f"{a['text'][:300]} {b['text'][:200]}" for a, b in zip(docs[:40], docs[20:60], strict=True)]
    several = 0
    for t in texts:
        want, got = plain_mixture(t, *model), language.identify(t, *model)
        several += len(want) > 1
        assert dict(got[2]) == pytest.approx(want, abs=1e-6) and want[got[0]] == pytest.approx(max(want.values()), abs=1e-6)
    assert several > 10


def test_languages_are_bounded(spark, monkeypatch):
    data = [(f"some words of language number {i} " * (i % 50 + 1), f"l{i}") for i in range(300)]
    df = spark.createDataFrame(data, "text string, lang string").repartition(4)
    langs, table = language.train(df, 20)
    assert len(langs) == 20 and table.shape == (language.BUCKETS, 20) and set(langs) <= {f"l{i}" for i in range(300) if i % 50 >= 45}
    batch = pa.RecordBatch.from_arrays([pa.array([t for t, _ in data]), pa.array([x for _, x in data])], ["text", "lang"])
    whole = pa.Table.from_batches(list(language._count([batch]))).to_pandas()
    monkeypatch.setattr(language, "HELD", 7)
    parts = pa.Table.from_batches(list(language._count([batch]))).to_pandas()
    key = ["lang", "bucket"]
    assert parts.groupby(key)["n"].sum().equals(whole.groupby(key)["n"].sum())


def test_edge_rows(spark, model):
    data = rows.edge_rows()
    got = sorted(((r["doc_id"], r["lang_pred"]) for r in language.predict(rows.frame(spark, data, clashes=True), model).collect()), key=str)
    assert len(got) == len(data)
    und = {d for d, p in got if p == "und"}
    assert {0, 1, 2, 3, 5, 17, 18} <= und and not und & {4, 6, 7, 9, 13, 14}


def test_nothing_learned_and_empty(spark):
    empty = rows.frame(spark, [])
    nothing = language.train(empty.select("text", "lang"))
    assert nothing[0] == [] and language.predict(empty, nothing).count() == 0
    got = language.predict(rows.frame(spark, rows.edge_rows()), nothing).collect()
    assert {(r["lang_pred"], r["score"]) for r in got} == {("und", 0.0)}
    one = language.train(spark.createDataFrame([("ein Text", "de"), (None, "de"), ("text", None)], "text string, lang string"))
    assert one[0] == ["de"] and language.identify("anything", *one)[0] == "de"


def test_result_does_not_depend_on_partitions(spark, model):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    a, b = ({tuple(r[:4]) for r in language.predict(df.repartition(n), model).collect()} for n in (2, 9))
    assert a == b
