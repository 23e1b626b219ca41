from __future__ import annotations

import random
import re

import numpy as np
import pytest

from lexitide.llm import minhash
from lexitide.llm.common import Scratch
from lexitide.llm.components import components
from tests import oracle
from tests.llm import rows


class Groups(dict):
    def __missing__(self, k):
        return k

    def root(self, x):
        while self[x] != x:
            x = self[x]
        return x

    def join(self, a, b):
        a, b = sorted((self.root(a), self.root(b)))
        self[b] = a


def shingle_set(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def brute(data, size, percent):
    sets = [(d, shingle_set(t, size)) for d, t in data]
    groups = Groups()
    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if a is not None and b is not None and s and t and 100 * len(s & t) >= percent * len(s | t):
                groups.join(a, b)
    return sorted(((d, len(s), None if d is None else groups.root(d), d is None or groups.root(d) == d) for d, s in sets), key=str)


def found(df, **kw):
    return sorted((tuple(r) for r in minhash.near_duplicates(df, **kw).collect()), key=str)


def changed(text, share, seed):
    r = random.Random(seed)
    words = text.split()
    for i in range(len(words)):
        if r.random() < share:
            words[i] = f"w{r.randint(0, 10**6)}"
    return " ".join(words)


def test_edge_rows(spark):
    data = rows.edge_rows()
    df = rows.frame(spark, data, clashes=True)
    assert found(df, size=3, percent=85) == brute([r[:2] for r in data], 3, 85)


@pytest.mark.parametrize("size,percent", [(3, 85), (5, 80)])
def test_whole_table(spark, size, percent):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    data = [(r[0], r[1]) for r in df.collect()]
    fast = found(df, size=size, percent=percent)
    assert fast == brute(data, size, percent)
    assert sum(not r[3] for r in fast) > 20


def test_pairs_near_the_threshold(spark):
    data = []
    for i in range(60):
        base = rows.prose(100 + i, 150 + 10 * i)
        data += [(3 * i, base), (3 * i + 1, changed(base, 0.01 + 0.0009 * i, i)), (3 * i + 2, changed(base, 0.05, i))]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(5)
    got = found(df, size=3, percent=85)
    assert got == brute(data, 3, 85)
    assert 20 < sum(not r[3] for r in got) < 100


def test_large_group_in_small_blocks(spark):
    base = rows.prose(7, 120)
    data = [(i, changed(base, 0.02, i)) for i in range(150)] + [(1000 + i, base) for i in range(40)] + [(2000 + i, rows.prose(i, 120)) for i in range(30)]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(7)
    want = brute(data, 3, 85)
    assert found(df, size=3, percent=85, block=500, members=8) == want
    assert found(df, size=3, percent=85, members=20) == want
    assert sum(r[2] == 0 for r in want) > 40


def test_distance_guarantee():
    """Signatures within the distance share a key, wherever the errors are."""
    r = np.random.default_rng(1)
    a = r.integers(0, 2**16, (500, minhash.SYMBOLS)).astype(np.uint16)
    b = a.copy()
    for row in b:
        at = r.choice(minhash.SYMBOLS, 2 * minhash.CHUNKS - 1, replace=False)
        row[at] ^= 1
    assert (minhash.chunk_keys(a) == minhash.chunk_keys(b)).any(axis=1).all()


def test_overlaps_of_many_sets():
    r = np.random.default_rng(2)
    sets = [np.unique(r.integers(0, 90, r.integers(1, 60))).astype(np.uint64) for _ in range(70)]
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    assert (minhash.overlaps(sets) == want).all()


def test_crowded_buckets_lose_nothing(spark):
    """Signatures within the distance are connected, also where a bucket is met block by block; nothing far is linked."""
    texts = [(i, changed(rows.prose(9, 200), 0.004 + 0.002 * (i % 8), i)) for i in range(90)]
    texts += [(200 + i, changed(rows.prose(9, 200), 0.07, i)) for i in range(40)] + [(300 + i, changed(rows.prose(10, 150), 0.01, i)) for i in range(30)]
    sig = {d: minhash.signatures(minhash.shingles(t.encode(), 3), np.array([0]))[0] for d, t in texts}
    reps = spark.createDataFrame([(d, bytearray(x.tobytes())) for d, x in sig.items()], "doc long, sig binary").repartition(5)
    limit = minhash.reach(85)
    near = lambda a, b: int(minhash._apart(*(minhash.sketch(sig[x][None])[0][0] for x in (a, b))) + minhash._apart(*(minhash.sketch(sig[x][None])[0][1] for x in (a, b)))) <= limit
    for bucket in (7, 10_000):
        groups = Groups()
        for r in minhash._candidates(Scratch(spark, "t"), reps, limit, bucket).collect():
            groups.join(r["a"], r["b"])
        ids = list(sig)
        close = [(a, b) for i, a in enumerate(ids) for b in ids[:i] if (sig[a] != sig[b]).sum() <= 2 * minhash.CHUNKS - 1]
        assert len(close) > 500 and all(groups.root(a) == groups.root(b) for a, b in close)
        assert not any(groups.root(a) == groups.root(300) for a in ids if a < 300)
    assert near(0, 1) and not near(0, 300)


def test_stragglers_of_a_large_group(spark):
    """Documents that resemble others of their group but not its least one are still found: chains, two families, lone ones."""
    base = rows.prose(21, 150).split()
    chain, data = list(base), []
    for i in range(60):  # each resembles the one before
        chain[2 * i % 150] = f"c{i}"
        data.append((500 - i, " ".join(chain)))
    other = changed(" ".join(base), 0.06, 77)
    data += [(1000 + i, changed(other, 0.01, i)) for i in range(60)] + [(2000 + i, changed(" ".join(base), 0.09, i)) for i in range(30)]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(6)
    want = brute(data, 3, 85)
    assert len({r[2] for r in want}) > 10
    for kw in ({"members": 6, "block": 2000}, {"members": 16, "bucket": 9}, {}):
        assert found(df, size=3, percent=85, **kw) == want


def test_twenty_thousand_short_near_copies(spark):
    """Each resembles the least one and few of the others."""
    base = rows.prose(31, 60).split()
    data = [(0, " ".join(base))]
    for i in range(1, 20_000):
        at = i % 60
        data.append((i, " ".join([*base[:at], f"x{i}", *base[at + 1 :]])))
    got = found(spark.createDataFrame(data, "doc_id long, text string").repartition(8), size=3, percent=85)
    assert len(got) == 20_000 and {r[2] for r in got} == {0} and sum(r[3] for r in got) == 1


def test_a_unit_of_work_needs_bounded_memory():
    import tracemalloc

    r = np.random.default_rng(4)
    common = r.integers(0, 2**63, 400).astype(np.uint64)
    sets = [np.unique(np.concatenate((common[r.random(400) < 0.9], r.integers(0, 2**63, 200).astype(np.uint64)))) for _ in range(2 * minhash.MEMBERS)]
    tracemalloc.start()
    minhash.overlaps(sets)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 300 << 20


def test_ids_of_any_size(spark):
    base = rows.prose(41, 120)
    ids = [2**63 - 1, 2**62, 2**62 + 1, -(2**63), -(2**62), -1, 0, 2**63 - 2]
    data = [(d, changed(base, 0.01, i)) for i, d in enumerate(ids)] + [(5, rows.prose(42, 50))]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    assert found(df, size=3, percent=85) == brute(data, 3, 85)


def test_repeated_ids_are_one_node(spark):
    a, c, e = (rows.prose(i, 60) for i in (51, 52, 53))
    data = [(1, a), (5, a), (5, c), (7, c), (7, None), (9, None), (9, e), (10, e), (11, ""), (11, None)]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    got = found(df, size=3, percent=85)
    assert got == brute(data, 3, 85)
    assert {(r[0], r[2], r[3]) for r in got if r[0] < 9} == {(1, 1, True), (5, 1, False), (7, 1, False)}
    assert sorted(r["doc_id"] for r in minhash.drop_duplicates(df, 3, 85).collect()) == [1, 9, 11]


@pytest.mark.parametrize("small", [0, None])
def test_components_of_chains_stars_and_rings(spark, small):
    r = random.Random(3)
    links = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(2000 + i, 2000 + (i + 1) % 50) for i in range(50)]
    links += [(2**62 + i, 2**62 + i + 1) for i in range(20)] + [(-(2**63), 2**63 - 1)]
    links += [(r.randint(5000, 5400), r.randint(5000, 5400)) for _ in range(250)]
    r.shuffle(links)
    groups = Groups()
    for a, b in links:
        groups.join(a, b)
    nodes = {x for a, b in links if a != b for x in (a, b)}
    got = components(Scratch(spark, "t"), spark.createDataFrame(links, "a long, b long"), "c", small=small)
    assert sorted(map(tuple, got.collect())) == sorted((x, groups.root(x)) for x in nodes)


def test_drop_duplicates_keeps_one_of_each(spark):
    data = rows.edge_rows()
    df = rows.frame(spark, data, clashes=True)
    out = minhash.drop_duplicates(df)
    assert out.columns == df.columns
    kept = [r["doc_id"] for r in out.collect()]
    want = {r[0] for r in brute([x[:2] for x in data], 5, 80) if r[3] and r[0] is not None}
    assert sorted(k for k in kept if k is not None) == sorted(want)
    assert kept.count(None) == 2


def test_empty_table(spark):
    df = rows.frame(spark, [])
    assert found(df) == [] and minhash.drop_duplicates(df).count() == 0


def test_query_reads_the_whole_table(spark):
    assert minhash.op7(spark, oracle.DATA).count() == spark.read.parquet(f"{oracle.DATA}/documents.parquet").count()
