from __future__ import annotations

import duckdb
import pytest

import corpus_pipeline
from lexitide.llm import pii, quality
from tests import oracle
from tests.llm import rows
from tests.llm.test_minhash import brute as near
from tests.llm.test_packing import check as packed
from tests.llm.test_substring import brute as repeats

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def by_hand(docs):
    """Kept (doc_id, text) after each stage but the last, by brute force and SQL."""
    con = duckdb.connect()
    import pandas as pd

    frame = pd.DataFrame(docs, columns=["doc_id", "text"])
    con.register("documents", frame)
    good = {r[0] for r in con.execute(f"WITH {quality.ORACLE_CTE} SELECT doc_id FROM op8 WHERE kept").fetchall()}
    one = [d for d in docs if d[0] in good]
    kept = {r[0] for r in near(one, 5, 80) if r[3]}
    two = [d for d in one if d[0] in kept]
    cut = repeats(two)
    three = [(d, cut[d, t][0]) for d, t in two]
    p = pii.Pseudonyms(pii.TEST_KEY)
    return [one, two, three, [(d, pii.pseudonymise(t, p)[0]) for d, t in three]]


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(f"{oracle.DATA}/documents.parquet")


def test_stages_against_brute_force(spark, small):
    import public_tokenizers
    from tokenizers import Tokenizer

    want = by_hand([(r["doc_id"], r["text"]) for r in small.collect()])
    docs = small
    for (_, stage), expected in zip(corpus_pipeline.STAGES[:-1], want, strict=True):
        docs = spark.createDataFrame(stage(spark, docs, oracle.DATA).collect(), small.schema)
        assert docs.columns == COLUMNS
        assert sorted((r["doc_id"], r["text"]) for r in docs.collect()) == sorted(expected)
    assert len(want[0]) < small.count() and len(want[1]) < len(want[0]) and want[2] != want[1] and want[3] != want[2]
    last = corpus_pipeline.STAGES[-1][1](spark, docs, oracle.DATA).collect()
    packed(last, want[-1], Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")))


def test_run_is_the_chain(spark, tmp_path, small):
    d = rows.save(spark, tmp_path, documents=small)
    got = {(r["doc_id"], r["start"], r["ids_crc32"]) for r in corpus_pipeline.run(spark, d).collect()}
    docs = small
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, d)
    assert got == {(r["doc_id"], r["start"], r["ids_crc32"]) for r in docs.collect()}


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_take_edge_rows(spark, name, stage):
    df = rows.frame(spark, rows.edge_rows(), clashes=True)
    out = stage(spark, df, "")
    assert name == "packing" or out.columns == df.columns
    assert out.count() > 0
    empty = stage(spark, rows.frame(spark, [], clashes=True), "")
    assert empty.count() == 0


def test_stage_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "minhash_near_dedup", "substring_dedup", "pii_pseudonyms", "packing"]
