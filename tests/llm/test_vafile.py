from __future__ import annotations

import math
import random

import numpy as np
import pytest

from lexitide.llm import vafile
from tests import oracle


def brute(data, queries, k):
    ints = lambda v: None if v is None or not v or any(x is None or not math.isfinite(x) for x in v) else [math.floor(1024 * x) for x in v]
    ok = [(i, e) for i, v in data if i is not None and (e := ints(v))]
    out = []
    for q in sorted({i for i in queries if i is not None}):
        best: dict = {}
        for qi, qe in ok:
            if qi == q:
                for i, e in ok:
                    if i != q and len(e) == len(qe):
                        s = max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(qe, e, strict=True))))
                        best[i] = max(best.get(i, s), s)
        out += [(q, r + 1, i, s) for r, (s, i) in enumerate(sorted(((s, i) for i, s in best.items()), key=lambda x: (-x[0], x[1]))[:k])]
    return out


def check(spark, data, queries, k=10, parts=5):
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>").repartition(parts)
    got = vafile.top_k(df, df.where(df.vec_id.isin([q for q in queries if q is not None])), k)
    assert sorted(map(tuple, got.collect())) == brute(data, queries, k)


def vectors(n, dim, seed, spread=1.0):
    r = random.Random(seed)
    return [[r.gauss(0, spread) for _ in range(dim)] for _ in range(n)]


@pytest.mark.parametrize("dim,spread", [(1, 1), (3, 0.01), (16, 1), (16, 500)])
def test_against_brute_force(spark, dim, spread):
    data = list(enumerate(vectors(400, dim, dim, spread)))
    check(spark, data, range(0, 400, 20))


def test_ties_repeats_nulls_and_lengths(spark):
    same = vectors(1, 8, 5)[0]
    data = [(i, same) for i in range(60)] + [(i, vectors(1, 8, i)[0]) for i in range(100, 160)]
    data += [(200, None), (201, []), (202, [None] + same[1:]), (203, [float("nan")] + same[1:]), (204, [float("inf")] + same[1:])]
    data += [(205, same[:4]), (206, same[:4]), (None, same), (100, same), (100, vectors(1, 8, 77)[0]), (0, same), (207, [0.0] * 8), (208, [-1e-9] * 8)]
    check(spark, data, [0, 5, 100, 120, 200, 202, 203, 205, 207, None])


def test_fewer_than_k_and_empty(spark):
    check(spark, [(0, [1.0, 2.0]), (1, [0.5, 0.5]), (2, [0.1, -3.0])], [0, 1, 2])
    check(spark, [(0, [1.0, 2.0])], [0])
    check(spark, [], [])
    check(spark, [(1, [1.0])], [])


def test_huge_components(spark):
    data = [(i, [x * 1e5 for x in v]) for i, v in enumerate(vectors(40, 4, 9))]
    check(spark, data, [0, 7])


def test_components_beyond_exact_doubles(spark):
    """Bounds are widened where doubles round, and give way where they overflow; scores beyond 64 bits tie."""
    r = random.Random(3)
    data = [(i, [x * 1e12 for x in v]) for i, v in enumerate(vectors(60, 3, 11))] + [(100 + i, [r.choice([1e300, -1e300, 3.0]), r.random()]) for i in range(30)]
    data += [(200 + i, [4e15 + i, 4e15]) for i in range(30)]
    check(spark, data, [0, 7, 100, 103, 105, 200, 229])


def test_bounds_hold():
    r = np.random.default_rng(6)
    for scale in (1, 1e3, 1e9, 1e200):
        v, q = np.floor(r.normal(0, scale, (300, 12))), np.floor(r.normal(0, scale, (20, 12)))
        low = v.min(0)
        width = np.maximum(1, np.ceil((v.max(0) - low + 1) / 256))
        lower, upper = vafile.bounds(low, width, np.clip(np.floor((v - low) / width), 0, 255).astype(np.uint8), q)
        for i in range(20):
            for j in range(300):
                s = max(-(2**63), min(2**63 - 1, sum(int(a) * int(b) for a, b in zip(q[i], v[j], strict=True))))
                assert lower[i, j] <= s <= upper[i, j]


def test_small_blocks_and_one_vec_id_in_many(spark):
    """Queries survive blocks of a few cells; a vec_id with vectors in many blocks counts once in the bound."""
    data = [(i % 37, v) for i, v in enumerate(vectors(600, 6, 21))] + [(1000 + i, v) for i, v in enumerate(vectors(40, 6, 22, 0.1))]
    check(spark, data, [0, 1, 2, 1003, 1039], parts=23)


def test_exact_vectors_are_read_for_few(spark, monkeypatch):
    """The cells hold no exact vectors, and about k of a thousand candidates survive the bound."""
    data = list(enumerate(vectors(3000, 16, 31)))
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>").repartition(4)
    seen = {}
    real = vafile.Scratch.save

    def save(self, frame, name):
        out = real(self, frame, name)
        seen[name] = (out.columns, out.count())
        return out

    monkeypatch.setattr(vafile.Scratch, "save", save)
    vafile.top_k(df, df.where("vec_id % 100 = 0")).collect()
    assert seen["cells"][0] == ["block", "dim", "low", "width", "ids", "cells"]
    assert seen["survivors"][1] < 30 * 10 * 3 and seen["cuts"][1] == seen["query-blocks"][1]


def test_all_scores_tie(spark):
    data = [(i, [0.0] * 4 if i % 7 == 0 else v) for i, v in enumerate(vectors(400, 4, 41))]
    check(spark, data, range(0, 400, 21))


def test_matches_sql(spark):
    assert oracle.differences(vafile.op2(spark, oracle.DATA), oracle.connect(), vafile.ORACLES["op2_exact_topk"]) == []


def test_clashing_columns(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(list(enumerate(vectors(50, 4, 3))), "vec_id long, embedding array<float>").select("*", *(F.lit(1).alias(c) for c in ("block", "bucket", "qids", "score", "rank")))
    assert vafile.top_k(df, df.where("vec_id = 0")).count() == 10
