from __future__ import annotations

import random
import re
from bisect import bisect_left, bisect_right
from itertools import accumulate

import pyarrow as pa
import pyarrow.compute as pc
import pytest

from lexitide.llm import substring
from tests.llm import rows

GAP = re.compile(r"[ \t\n\r\x0b\x0c.!?,;:]+")


def units(text: str) -> list[str]:
    out, start = [], 0
    for m in GAP.finditer(text):
        if re.search(r"[.!?,;:\n]", m[0]):
            out.append(text[start : m.end()])
            start = m.end()
    return out + ([text[start:]] if start < len(text) else [])


def spans(text: str):
    """(first, end, key) by the definition: UNITS units or more, WORDS words or more, as few as possible, forward and from behind."""
    u = units(text)
    starts = [m.start() for m in re.finditer(r"(?:(?<=[ \t\n\r\x0b\x0c])|^)[^ \t\n\r\x0b\x0c]", text)]
    words = [bisect_left(starts, at) for at in accumulate(map(len, u), initial=0)]
    n, found = len(u), set()
    for i in range(n + 1):
        e = max(i + substring.UNITS, bisect_left(words, words[i] + substring.WORDS))
        if e <= n:
            found.add((i, e))
        b = min(i - substring.UNITS, bisect_right(words, words[i] - substring.WORDS) - 1)
        if b >= 0:
            found.add((b, i))
    for i, e in sorted(found):
        yield i, e, tuple(x.strip(" \t\n\r\x0b\x0c") for x in u[i:e])


def brute(data: list[tuple]) -> dict:
    """Texts by (doc_id, text) for documents whose ids differ."""
    docs = sorted({(-(1 << 63) if d is None else d, t or "") for d, t in data})
    first: dict = {}
    every = {}
    for d, t in docs:
        every[d, t] = list(spans(t))
        for i, _, key in every[d, t]:
            first.setdefault(key, (d, t, i))
    out = {}
    for d, t in docs:
        gone = {k for i, e, key in every[d, t] if first[key] != (d, t, i) for k in range(i, e)}
        out[d, t] = "".join(x for k, x in enumerate(units(t)) if k not in gone), len(gone)
    return out


def check(spark, data, df):
    got = substring.remove_repeats(df)
    want = brute(data)
    texts = {}
    for r in got.collect():
        texts.setdefault(r["doc_id"], []).append((r["text"], r["__n"]))
    expected = {}
    for d, t in data:
        new, n = want[-(1 << 63) if d is None else d, t or ""]
        expected.setdefault(d, []).append((None if t is None else new, n))
    assert {k: sorted(v, key=str) for k, v in texts.items()} == {k: sorted(v, key=str) for k, v in expected.items()}


@pytest.fixture(autouse=True)
def count_column(monkeypatch):
    real = substring.remove_repeats
    monkeypatch.setattr(substring, "remove_repeats", lambda df: (lambda out: out.toDF(*out.columns[:-1], "__n"))(real(df)))


def test_edge_rows(spark):
    data = [(d, t) for d, t, *_ in rows.edge_rows() if not (t or "").startswith("another")]  # no id with two texts
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    check(spark, data, df)


def test_whole_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").repartition(6)
    check(spark, [tuple(r) for r in df.collect()], df)


@pytest.mark.parametrize("met", [3, 1 << 18])
def test_slices_and_what_a_task_remembers_change_nothing(monkeypatch, met):
    """The two steps in one process over tiny slices, documents in any order, against the definition."""
    monkeypatch.setattr(substring, "SLICE", 700)
    monkeypatch.setattr(substring, "MET", met)
    shared = [rows.prose(600 + i, 45) for i in range(6)]
    r = random.Random(5)
    data = [(i, " ".join([rows.prose(700 + i, 15), *r.choices(shared, k=r.randint(0, 3)), rows.prose(900 + i, 12)])) for i in range(120)]
    data += [data[3], data[40]]
    r.shuffle(data)
    tag = {t: i for i, t in enumerate(sorted({t for _, t in data}))}
    batch = pa.RecordBatch.from_arrays([pa.array([d for d, _ in data]), pa.array([tag[t] for _, t in data]), pa.array([t for _, t in data])], ["doc", "tag", "text"])
    found = pa.Table.from_batches(list(substring._found([batch.slice(i, 9) for i in range(0, len(data), 9)])))
    sent = found.filter(pc.invert(found.column("sure"))).num_rows
    found = found.sort_by([(c, "ascending") for c in ("h1", "h2", "doc", "tag", "first")])
    gone: dict = {}
    for b in substring._later(found.to_batches(max_chunksize=37)):
        for d, _, first, end in zip(*(c.to_pylist() for c in b.columns), strict=True):
            gone.setdefault(d, set()).update(range(first, end))
    want = brute(data)
    assert {d: len(gone.get(d, ())) for d, _ in data} == {d: want[d, t][1] for d, t in data}
    if met > 3:
        assert sent < 0.7 * found.num_rows


def test_a_text_repeated_often_sends_each_span_once(spark):
    text = f"{rows.prose(60, 100)} {rows.prose(61, 100)}"
    data = [(i, text) for i in range(3)] + [(None, text)] * 64 + [(7, text)] * 64
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(32)
    check(spark, data, df)


def test_planted_passage_goes_from_all_but_the_first(spark):
    passage = rows.prose(50, 60)
    data = [(i, f"{rows.prose(200 + i, 30)} Own start, {passage} {rows.prose(300 + i, 30)}") for i in range(20)]
    data += [(100, rows.prose(51, 200))]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(6)
    got = {r["doc_id"]: r["text"] for r in substring.remove_repeats(df).collect()}
    assert got[0] == data[0][1] and got[100] == data[-1][1]
    middle = passage[passage.index(". ") + 2 :]
    for i in range(1, 20):
        assert not any(x in got[i] for x in middle.split(". ")) and rows.prose(200 + i, 30) in got[i] and got[i].endswith(rows.prose(300 + i, 30))


def test_very_long_text_and_no_loss(spark):
    text = rows.prose(77, 150_000)
    df = spark.createDataFrame([(1, text), (2, "short one"), (3, text)], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in substring.remove_repeats(df).collect()}
    assert got[1] == text and got[2] == "short one" and got[3] == ""


def test_columns_stay(spark):
    df = rows.frame(spark, rows.edge_rows(), clashes=True)
    out = substring.remove_repeats(df)
    assert out.columns[: len(df.columns)] == df.columns and out.count() == df.count()
    assert out.select("removed_units").distinct().collect()[0][0] == "own removed_units"


def test_empty_table(spark):
    assert substring.remove_repeats(rows.frame(spark, [])).count() == 0
