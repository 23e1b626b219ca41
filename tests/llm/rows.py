"""Rows that every operator must take: nulls, empty and very long texts, ties, repeats, clashing columns."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns named like what operators make inside or add.
CLASHES = ["removed_units", "n_card", "kept", "component_id", "__c0", "__k0", "__row", "__pairs", "fp", "rank", "task", "n_words", "score"]


def prose(seed: int, words: int) -> str:
    r = random.Random(seed)
    vocabulary = ["the", "of", "and", "to", "in", "that", "was"] * 20 + ["".join(r.choices("abcdefghijklmnop", k=r.randint(3, 8))) for _ in range(400)]
    out = []
    while words > 0:
        n = min(words, r.randint(5, 12))
        out.append(" ".join(r.choices(vocabulary, k=n)).capitalize() + ".")
        words -= n
    return " ".join(out)


def edge_rows() -> list[tuple]:
    long = prose(1, 60_000)
    shared = prose(2, 80)
    texts = [None, "", " ", "\n\n", "word", "???", "a b", long, long, shared, f"{prose(3, 40)} {shared} {prose(4, 40)}", prose(5, 300), prose(5, 300).replace("the", "The", 1), "x" * 100_000, "é" * 50 + " " + "漢字。" * 30, "tab\tand\x0bfeed\x0cend", " non breaking\u0085", "0" * 5000, ". " * 4000]
    rows = [(i, t, ["en", "de", None][i % 3], "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    rows.append(rows[9])  # a repeated row
    rows.append((4, "another text under an id that is taken", "en", None, None))
    rows += [(None, shared, "en", "s", 1), (None, None, None, None, None)]
    return rows


def frame(spark, rows, clashes: bool = False, parts: int = 4):
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    if clashes:
        from pyspark.sql import functions as F

        df = df.select("*", *(F.lit(f"own {c}").alias(c) for c in CLASHES))
    return df


def save(spark, tmp_path, **tables) -> str:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)
