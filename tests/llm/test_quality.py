from __future__ import annotations

import re

import pytest

from lexitide.llm import quality
from tests import oracle
from tests.llm import rows


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count: dict = {}
    for w in windows:
        count[w] = count.get(w, 0) + 1
    inside = {i + j for i, w in enumerate(windows) if count[w] > 1 for j in range(5)}
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(inside), n < 10 or 100 * len(inside) > 20 * n


def test_counts_on_edge_rows(spark):
    data = rows.edge_rows()
    got = {tuple(r) for r in quality.score(rows.frame(spark, data, clashes=True)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()}
    assert got == {(r[0], *brute(r[1])) for r in data}


def test_keep_leaves_columns_and_good_rows(spark):
    data = rows.edge_rows()
    df = rows.frame(spark, data, clashes=True)
    kept = quality.keep(df)
    assert kept.columns == df.columns
    ids = sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None)
    assert {7, 8, 9, 10, 11, 12} <= set(ids) and not {0, 1, 2, 3, 4, 5, 6, 13} & set(ids)
    assert ids.count(9) == 2


def test_empty_table(spark):
    assert quality.keep(rows.frame(spark, [])).count() == 0


def test_no_python_in_the_plan(spark):
    plan = quality.op8(spark, oracle.DATA)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)


@pytest.mark.parametrize("data", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_matches_sql(spark, data):
    assert oracle.differences(quality.op8(spark, data), oracle.connect(data), quality.ORACLES["op8_quality_rules"]) == []


def test_agrees_with_labels(spark):
    d = "/root/testdata/sf0.01"
    good = spark.read.parquet(f"{d}/labels.parquet").where("quality = 1")
    bad = spark.read.parquet(f"{d}/labels.parquet").where("quality = 0")
    scored = quality.op8(spark, d).where("n_words >= 10")
    assert scored.join(bad, "doc_id", "left_semi").where("kept").count() == 0
    assert scored.join(good, "doc_id", "left_semi").where("NOT kept AND NOT base_failed").count() == 0
