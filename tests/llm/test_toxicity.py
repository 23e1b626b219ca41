from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from lexitide.llm import toxicity
from tests.llm import rows

TERMS = {"idiot": 3.0, "clown": 3.0, "clowns": 2.0, "worthl*": 4.0, "bad": 1.0, "pathetic": 5.0}


def edits(a: str, b: str) -> int:
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            last, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, last + (x != y))
    return d[-1]


def brute(word):
    best = None
    for t in sorted(TERMS):
        body = t.rstrip("*")
        if t[-1] == "*":
            e = min(edits(word[:n], body) for n in range(len(word) + 1))
            fuzzy = len(body) >= toxicity.FUZZY + 1
        else:
            e, fuzzy = edits(word, body), len(body) >= toxicity.FUZZY
        if e <= (1 if fuzzy else 0) and (best is None or (e, t) < (best[1], best[0])):
            best = (t, e)
    return best


def test_automaton_against_edit_distance():
    r, a = random.Random(1), toxicity.Automaton(TERMS)
    words = set()
    for t in TERMS:
        for _ in range(400):
            w = list(t.rstrip("*") + r.choice(["", "", "ess", "s"]))
            for _ in range(r.randint(0, 2)):
                at = r.randint(0, len(w))
                what = r.randint(0, 2)
                if what == 0:
                    w.insert(at, r.choice("abclownsidt"))
                elif w and at < len(w):
                    if what == 1:
                        del w[at]
                    else:
                        w[at] = r.choice("abclownsidt")
            words.add("".join(w))
    words |= {"", "b", "the", "bd", "badd", "worth", "worthy"}
    for w in words:
        if w:
            assert a.match(w) == brute(w), w


def test_quotation_is_told_from_abuse():
    m = toxicity.Matcher(TERMS)
    f = lambda t: dict(zip(toxicity.FEATURES, toxicity.features(t, m), strict=True))
    assert f("you are an idiot and a clown")["exact"] > 0 and f("you are an idiot")["address"] > 0
    assert f('the report said "idiot" was used')["quoted"] > 0 and f('the report said "idiot" was used')["exact"] == 0
    assert f("such an idiiot here")["near"] > 0
    assert f(None) == f("") and f("clean words only")["none"] == 1


def plain_features(text):
    """The features by their definition: edit distances to all terms, windows counted one by one."""
    tokens = (text or "").lower().split()
    hits = {}
    for i, t in enumerate(tokens):
        w = toxicity.bare(t)
        m = brute(w) if w else None
        if m:
            hits[i] = (TERMS[m[0]], m[1])
    sums = dict.fromkeys(toxicity.FEATURES, 0.0)
    for i, (weight, distance) in hits.items():
        window = [j for j in range(len(tokens)) if abs(i - j) <= toxicity.WINDOW]
        marks = [j for j in window if set(tokens[j]) & set("\"«»“”„")]
        if len(marks) >= 2 or any(toxicity.bare(tokens[j]) in toxicity._REPORT for j in window):
            sums["quoted"] += 1
        else:
            sums["near" if distance else "exact"] += weight / 4
        sums["crowd"] += len([j for j in window if j in hits and j != i])
        sums["address"] += any(toxicity.bare(tokens[j]) in toxicity._ADDRESS for j in window)
    out = [math.log(1 + sums[k]) for k in ("exact", "near", "quoted", "crowd", "address")]
    return [*out, 10 * len(hits) / max(20, len(tokens)), 0.0 if hits else 1.0]


def test_features_against_their_definition():
    r, m = random.Random(8), toxicity.Matcher(TERMS)
    words = ["you", "said", '"the', 'end"', "idiot", "idot", "Idiots!", "clown,", "clwn", "worthless", "wortless", "bad", "badd", "pathetic.", "patetic", "rest", "of", "it", "--", "«so»"]
    for n in (0, 1, 5, 30, 200):
        for _ in range(30):
            text = " ".join(r.choices(words, weights=[2, 1, 2, 2, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 6, 6, 6, 2, 1], k=n))
            assert np.allclose(toxicity.features(text, m), plain_features(text)), text


def plain_lexicon(data):
    """Terms by counting in dictionaries, with the likelihood ratio written out."""
    seen = [(t, y, toxicity.terms_of(t or "")) for t, y in data]
    n, m = sum(y for *_, y, _ in seen), sum(1 - y for *_, y, _ in seen)

    def ratio(a, b):
        out = 0.0
        for k, total in ((a, n), (b, m)):
            for count, share in ((k, (a + b) / (n + m)), (total - k, 1 - (a + b) / (n + m))):
                out += 2 * count * math.log(count / (total * share)) if count else 0.0
        return out

    toxic, clean = Counter(), Counter()
    for _, y, terms in seen:
        (toxic if y else clean).update(terms)
    pure = {t: a for t, a in toxic.items() if (a + 0.5) / (n + 1) >= 19 * (clean[t] + 0.5) / (m + 1) and ratio(a, clean[t]) >= toxicity.GAIN}
    sides: dict = {}
    for text, y, _ in seen:
        if y:
            w = [x for x in map(toxicity.bare, (text or "").lower().split()) if x]
            own: dict = {}
            for i, x in enumerate(w):
                pair = xxhash.xxh3_64_intdigest(f"{w[i - 1] if i else ''} {w[i + 1] if i + 1 < len(w) else ''}")
                for t in [x, *(x[:k] + "*" for k in range(4, 8) if len(x) > k)]:
                    if t in pure:
                        own[t] = min(pair, own.get(t, pair))
            for t, pair in own.items():
                sides.setdefault(t, set()).add(pair)
    kept = {t: a for t, a in pure.items() if ratio(len(sides[t]), clean[t]) >= toxicity.GAIN}
    return toxicity.choose_terms(kept, clean, n, m)


def test_lexicon_against_plain_counts(spark):
    """Terms that a few texts hold are learned at any size of the corpus; the words of one copied text are not."""
    r = random.Random(12)
    data = [(rows.prose(i, 40), 0) for i in range(900)]
    for i in range(60):
        w = rows.prose(2000 + i, 30).split()
        w.insert(r.randint(0, 29), r.choice(["zwonk", "grubbles", "grubbled", "grubbling"]) if i < 40 else "rarely")
        data.append((" ".join(w), 1))
    for i in range(20):
        w = rows.prose(3000 + i, 30).split()
        if i < 9:
            w[7] = "snarfy"
        data.append((" ".join(w), 1))
    data += [("copied words of a single qwerpish text only", 1)] * 25
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(data)], "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(data)], "doc_id long, toxic int")
    terms, _ = toxicity.train(docs, labels)
    assert terms == pytest.approx(plain_lexicon(data))
    assert "snarfy" in terms and any(t.startswith("grub") for t in terms) and not any(t.startswith("qwer") for t in terms)


def test_rarer_terms_are_learned_from_more_texts():
    """Support is absolute: what suffices does not grow with the corpus."""
    assert toxicity.least_support(100, 1000) == toxicity.least_support(10**8, 10**9) <= 8


def test_held_out_quality(spark):
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "toxic").distinct()
    got = toxicity.op5(spark, d).join(labels, "doc_id").where("held_out").collect()
    y, s = np.array([r["toxic"] for r in got]), np.array([r["score"] for r in got])
    order = s.argsort(kind="stable")
    ranks = np.empty(len(s))
    ranks[order] = np.arange(1, len(s) + 1)
    for v in np.unique(s):
        ranks[s == v] = ranks[s == v].mean()
    auc = (ranks[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (len(y) - y.sum()))
    assert auc > 0.93 and np.mean(y == (s >= 0.5)) > 0.97
    assert all((r["predicted"] == 1) == (r["score"] >= 0.5) for r in got)


def test_only_the_training_fold_is_learned_from(spark):
    from pyspark.sql import functions as F

    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{d}/labels.parquet")
    flipped = labels.withColumn("toxic", F.when(toxicity.fold(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (toxicity.train(docs, x.where(~toxicity.fold())) for x in (labels, flipped))
    assert a[0] == b[0] and np.allclose(a[1], b[1])
    got = toxicity.op5(spark, d).select("doc_id", "held_out").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)


@pytest.fixture(scope="module")
def model():
    return TERMS, np.array([2, 1, -1, 0.5, 0.5, 1, -1, -2.0])


def test_edge_rows(spark, model):
    data = rows.edge_rows() + [(70, "you idiot clown", "en", "s", 1)]
    got = {r["doc_id"]: r for r in toxicity.score(rows.frame(spark, data, clashes=True), model).collect()}
    assert len(got) == len({r[0] for r in data})
    assert got[70]["predicted"] == 1 and got[0]["score"] == got[1]["score"] == got[2]["score"] and all(0 <= r["score"] <= 1 for r in got.values())


def test_nothing_to_learn_and_empty(spark):
    docs = rows.frame(spark, rows.edge_rows())
    for labels in ([], [(9, 1)], [(9, None), (None, 1)]):
        none = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
        assert {r["score"] for r in toxicity.score(docs, none).collect()} == {0.0}
    assert toxicity.score(rows.frame(spark, []), (TERMS, None)).count() == 0
