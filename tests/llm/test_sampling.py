from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest

from lexitide.llm import sampling
from tests.llm import rows


@pytest.fixture(scope="module")
def lattice():
    return sampling.Lattice(sampling.public_model())


def ways(lattice, text):
    """All segmentations of a unit as ids, with their weights."""
    if not text:
        return {(): 1.0}
    out = {}
    for n in range(1, len(text) + 1):
        head = text[:n]
        if head in lattice.pieces:
            step, weight = (lattice.pieces[head][0],), lattice.pieces[head][1]
        elif n == 1:
            data = head.encode()
            step, weight = tuple(lattice.bytes[b] for b in data), lattice.byte_weight * len(data)
        else:
            continue
        for rest, w in ways(lattice, text[n:]).items():
            out[step + rest] = out.get(step + rest, 0) + math.exp(weight) * w
    return out


@pytest.mark.parametrize("short", [True, False])
@pytest.mark.parametrize("text", [" hello", "ab", " né漢", " aaa"])
def test_draws_follow_the_lattice(lattice, monkeypatch, text, short):
    if not short:
        monkeypatch.setattr(lattice, "shared", 0)
    lattice.clear()
    want = ways(lattice, text)
    total = sum(want.values())
    n = 20_000
    got = Counter(tuple(g.tolist()) for g in sampling.draw(lattice, [text] * n, list(range(n))))
    assert set(got) <= set(want)
    for w, weight in want.items():
        p = weight / total
        assert abs(got[w] / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-3


def test_lossless_on_edge_rows(spark):
    data = rows.edge_rows() + [(800, "▁marks ▁ and  two   spaces \n\n\ttabs", "en", "s", 1), (801, "😀" * 20, "en", "s", 1)]
    df = rows.frame(spark, data, clashes=True)
    got = sampling.sample(df)
    assert all(r["lossless"] is (None if r["ids"] is None else True) for r in got.collect())
    back = sampling.decoded(got.select("doc_id", "ids"))
    assert sorted(((r[0], r[1]) for r in back.collect()), key=str) == sorted(((r[0], r[1]) for r in data), key=str)


def test_row_key_decides(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    draw = lambda d, **kw: {r["doc_id"]: tuple(r["ids"]) for r in sampling.sample(d, **kw).collect() if r["ids"] is not None}
    a = draw(df.repartition(2))
    assert a == draw(df.repartition(9)) and a != draw(df, seed=8)
    same = spark.createDataFrame([(i, "the quick brown fox jumps over the lazy dog " * 5) for i in range(20)], "doc_id long, text string")
    assert len(set(draw(same).values())) == 20


def test_sharp_draws_are_shorter(lattice):
    text = "some ordinary words in a sentence " * 20
    sharp = sampling.Lattice(sampling.public_model(), 8.0)
    n = lambda lat: sum(len(g) for g in sampling.draw(lat, [text] * 5, list(range(5))))
    assert n(sharp) < n(lattice) < n(sampling.Lattice(sampling.public_model(), 0.0))


def test_memory_bound_does_not_change_draws(lattice, monkeypatch):
    texts = [rows.prose(i, 200) for i in range(6)]
    a = [g.tolist() for g in sampling.draw(lattice, texts, list(range(6)))]
    monkeypatch.setattr(sampling, "ARCS", 10)
    fresh = sampling.Lattice(sampling.public_model())
    b = [sampling.draw(fresh, [t], [i])[0].tolist() for i, t in enumerate(texts)]
    assert a == b


def test_draws_do_not_depend_on_where_nodes_lie(lattice):
    """Shares that differ by 2 ** -40 are told apart, whatever a worker has built before."""
    text = " hello"
    lattice.clear()
    node = lattice.nodes([text])
    arcs = np.arange(lattice.last[node[0] - 1] + 1, lattice.last[node[0]] + 1)
    cut = lattice.low[arcs[-1]]
    assert len(arcs) > 1 and 0 < cut < 1
    near = np.array([cut - 2.0**-40, cut, cut + 2.0**-40])
    want = lattice.ids[lattice.choose(np.repeat(node, 3), near)].tolist()
    assert want[0] != want[1] == want[2]
    lattice.nodes([f" x{i}" for i in range(40_000)])
    lattice.ends.clear()
    moved = lattice.nodes([text])
    assert moved[0] > 100_000
    assert lattice.ids[lattice.choose(np.repeat(moved, 3), near)].tolist() == want


def test_side_by_side_and_one_by_one_agree(lattice, monkeypatch):
    """Sums place by place over many units and sums in logs, unit by unit, give the same shares."""
    units = [" hello", "a", " né漢x", "😀", "  two", "ébè", " aaaa"]
    lattice.clear()
    for u, end in zip(units, lattice.nodes(units).tolist(), strict=True):
        low, prev, ids, arcs, ends = lattice.build_long(u)
        begin = end - int(ends[0])
        a, b = (lattice.last[begin - 1] + 1 if begin else 0), lattice.last[end] + 1
        assert np.diff(np.concatenate(([a - 1], lattice.last[begin : end + 1]))).tolist() == arcs.tolist()
        assert lattice.ids[a:b].tolist() == ids.tolist() and np.allclose(lattice.low[a:b], low)
        assert np.where(lattice.prev[a:b] < 0, -1, lattice.prev[a:b] - begin).tolist() == prev.tolist()


def test_the_check_of_decoding_sees_shifted_rows(lattice):
    a, b = sampling.draw(lattice, ["one two", "three"], [1, 2])
    flat = np.concatenate((a, b))
    assert sampling.lossless(lattice, flat, [a, b], ["one two", "three"]) == [True, True]
    assert sampling.lossless(lattice, flat, [flat[:1], flat[1:]], ["one two", "three"]) == [False, False]
    assert sampling.lossless(lattice, flat, [a, b], ["one two", "thre!"]) == [True, False]


def test_empty_table(spark):
    assert sampling.sample(rows.frame(spark, [])).count() == 0
