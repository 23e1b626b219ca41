from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from lexitide.llm import packing
from tests import oracle
from tests.llm import rows


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def check(got, data, tokenizer, max_len=1024):
    """Every id of every document lies in one piece, and pieces fill sequences without gaps."""
    ids = Counter()
    for d, t in data:
        full = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        ids[d, len(full), full.tobytes()] += 1
    pieces = defaultdict(Counter)
    for r in got:
        assert 1 <= r["length"] <= max_len and 0 <= r["ids_crc32"] < 2**32
        pieces[r["doc_id"], r["doc_tokens"]][r["start"], r["length"], r["ids_crc32"]] += 1
    want = defaultdict(Counter)
    for (d, n, full), copies in ids.items():
        for at in range(0, n, max_len):
            part = full[4 * at : 4 * min(n, at + max_len)]
            want[d, n][at, len(part) // 4, zlib.crc32(part)] += copies
    assert pieces == want
    rows_of = defaultdict(list)
    for r in got:
        rows_of[r["sequence_id"]].append((r["offset"], r["length"]))
    assert sorted(rows_of) == list(range(len(rows_of)))
    for parts in rows_of.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= max_len
    return len(rows_of)


def test_edge_rows(spark, tokenizer):
    data = [(r[0], r[1]) for r in rows.edge_rows()]
    data += [(500, "<|endoftext|> a"), (501, "it's  two  spaces \n next\tline 'll "), (502, " lead"), (503, "trail "), (504, "　wide space x"), (505, "a\x1cb \x85 c")]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    check(packing.pack(df).collect(), data, tokenizer)


@pytest.mark.parametrize("text", [" " * 10**7, "\n" * 10**6, "a" + " \n\t\x0b" * 400_000 + "b", "x\u00a0" + "\u3000" * 1_000_000, "word " * 100_000 + " " * 30_000 + "!"])
def test_long_white_space_has_the_same_ids(tokenizer, text):
    """The fast encoder alone ends the process on a million spaces."""
    ids = tokenizer.encode(text, add_special_tokens=False).ids
    assert packing.tokens(packing.public_files()).encode(text) == np.array(ids, "<u4").tobytes()


def test_whole_table_with_little_padding(spark, tokenizer):
    d = "/root/testdata/sf0.01"
    data = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    got = packing.op4(spark, d).collect()
    sequences = check(got, data, tokenizer)
    assert sum(r["length"] for r in got) > 0.97 * 1024 * sequences


def test_clashing_columns_and_empty_table(spark):
    df = rows.frame(spark, rows.edge_rows(), clashes=True)
    assert packing.pack(df).select("doc_id", "start").distinct().count() > 0
    assert packing.pack(rows.frame(spark, [])).count() == 0


def first_fit_room(lengths, max_len):
    """Longest first, one by one, each into a pack with most room, the oldest such."""
    packs = []
    for n in sorted(lengths, reverse=True):
        best = max(range(len(packs)), key=lambda i: (max_len - sum(packs[i]), -i), default=None)
        if best is None or max_len - sum(packs[best]) < n:
            packs.append([n])
        else:
            packs[best].append(n)
    return Counter(map(tuple, packs))


@pytest.mark.parametrize("seed", range(8))
def test_histogram_packs_as_one_by_one(seed):
    r = random.Random(seed)
    lengths = [r.choice([r.randint(1, 64), 64, 7, 1]) for _ in range(r.randint(0, 300))]
    packs = packing.patterns(dict(Counter(lengths)), 64)
    got = Counter()
    for p, n in packs:
        got[p] += n
    assert Counter(x for p, n in packs for x in p for _ in range(n)) == Counter(lengths)
    assert sum(got.values()) == sum(first_fit_room(lengths, 64).values())
    length, rank, sequence, offset = packing.places(packs)
    assert len(set(zip(length.tolist(), rank.tolist(), strict=True))) == len(length)


def test_places_do_not_depend_on_partitions(spark):
    df = spark.read.parquet(f"{oracle.DATA}/documents.parquet").select("doc_id", "text")
    shape = lambda d: sorted(Counter(r["sequence_id"] for r in packing.pack(d).collect()).values())
    assert shape(df.repartition(3)) == shape(df.repartition(11))
