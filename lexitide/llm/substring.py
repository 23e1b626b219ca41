"""Substring deduplication by sliding sentence spans.

A text is cut after every run of sentence or clause marks or line ends (MARKS) with the white space
that follows, so the units joined together give the text again. Clause marks count as ends because
passages are often pasted into the middle of a sentence. From each unit a span runs forward, and to
each unit one runs from behind, over as few units as give UNITS units and WORDS words; so spans cover
a repeated passage from its first whole unit to its last. At sf0.1, of the 2,077 runs of 50 or more words
that an earlier document holds, 90 % go by half or more (what stays is junk: one word again and again,
without marks), and 97.5 % of the documents that share no 50 words with any other, nor repeat them, stay
untouched. With sentence marks alone it is 76 % and 98 % (at 20 words); with 20 words instead of 25, 90 %
and 96.8 %. WORDS is half of 50, as a passage may lose most of a unit at either end. Spans are hashed to 128 bits over the units without
their outer white space and joined over all documents. A unit that lies in any span which is not the
first of its kind, by (doc_id, hash of the text, position), is removed; the rest stays as it was.

Spans met before in the same slice of rows are repeats for certain, so only the first of each slice
enters the join; of those that a slice held twice, a task also remembers the earliest place, and later
slices send only earlier ones. So a passage that a third of all documents hold costs a few rows a task,
not one a document, and no group is gathered anywhere but the distinct spans of one text.

Defined cases: null texts stay null, empty ones empty; a text all of whose units repeat becomes empty;
rows with equal doc_id and text are one document, whose first copy and repeats are cut alike;
null doc_ids count as smaller than all others; very long texts are taken whole; an empty table gives an
empty result; further columns stay as they are, whatever their names (an added column gives way).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexitide.llm.common import Scratch, free_names, splitmix, trimmed

MARKS = b".!?,;:\n"
UNITS, WORDS = 3, 25
#: Bytes of text whose spans are looked at together.
SLICE = 4 << 20
#: Hashes that a task remembers.
MET = 1 << 18

_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\n\r\x0b\x0c")] = True
_MARK = np.zeros(256, bool)
_MARK[list(MARKS)] = True
_P1, _P2 = np.uint64(0x9E3779B97F4A7C15 | 1), np.uint64(0xC2B2AE3D27D4EB4F)


def cut(data: bytes, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the units of the texts that edges bound in data, and the words that begin before each end."""
    a = np.frombuffer(data, np.uint8)
    space = _SPACE[a]
    gap = space | _MARK[a]
    # A unit ends where a gap run that holds a mark ends.
    last = gap.copy()
    last[:-1] &= ~gap[1:]
    ends = np.flatnonzero(last) + 1
    begins = np.flatnonzero(gap & np.concatenate(([True], ~gap[:-1])))
    marks = np.concatenate(([0], np.cumsum(_MARK[a], dtype=np.int32)))
    ends = ends[marks[ends] > marks[begins]] if len(ends) else ends
    ends = np.union1d(ends, edges[1:])
    ends = ends[ends > 0]
    starts = ~space
    starts[1:] &= space[:-1]
    inner = edges[1:-1][edges[1:-1] < len(a)]
    starts[inner] = ~space[inner]
    words = np.concatenate(([0], np.cumsum(starts, dtype=np.int32)))
    return ends, words[ends]


def _powers(p: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, p, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _inverse(p: np.uint64) -> np.uint64:
    return np.uint64(pow(int(p), -1, 1 << 64))


def spans(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """(text, first unit, end unit, hash, hash) of all spans of texts; units count from 0 in each text."""
    edges = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    data = b"".join(texts)
    if not data:
        z = np.empty(0, np.int64)
        return z, z, z, z.astype(np.uint64), z.astype(np.uint64)
    ends, words = cut(data, edges)
    n = len(ends)
    begins = np.concatenate(([0], ends[:-1]))
    h = np.fromiter((xxhash.xxh3_64_intdigest(data[a:b].strip()) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)), np.uint64, n)
    owner = np.searchsorted(edges, ends, "left") - 1
    stop = np.searchsorted(owner, owner, "right")  # the end of the text's units
    before = np.concatenate(([0], words[:-1]))
    i = np.arange(n)
    e = np.maximum(i + UNITS, np.searchsorted(words, before + WORDS, "left") + 1)
    ok = e <= stop
    # The spans from behind: the last beginning from which an end is far enough.
    begin = np.searchsorted(owner, owner, "left")
    back = np.minimum(i + 1 - UNITS, np.searchsorted(before, words - WORDS, "right") - 1)
    far = back >= begin
    both = np.unique(np.concatenate((i[ok] * (n + 1) + e[ok], back[far] * (n + 1) + i[far] + 1)))
    i, e = both // (n + 1), both % (n + 1)
    ok, first = i, begin[i]
    out = []
    for p, hh in ((_P1, h), (_P2, splitmix(h))):
        total = np.concatenate(([np.uint64(0)], np.cumsum(hh * _powers(p, n), dtype=np.uint64)))
        out.append((total[e] - total[i]) * _powers(_inverse(p), n + 1)[i])
    # The number of units is part of what is hashed.
    return owner[ok], i - first, e - first, splitmix(out[0] ^ (e - i).astype(np.uint64)), out[1]


FOUND = "h1 long, h2 long, doc long, tag long, first int, end int, sure boolean"


class _Met:
    """The earliest places (doc, tag, first) of hashes that a task met twice in a slice: at most MET of them, all forgotten beyond."""

    def __init__(self):
        self.hashes, self.places = np.empty((0, 2), np.uint64), np.empty((0, 3), np.int64)

    def later(self, hashes: np.ndarray, places: np.ndarray, often: np.ndarray) -> np.ndarray:
        """Which of distinct hashes, sorted by the first of their two numbers, were met at an earlier place; remembers what is often."""
        out = np.zeros(len(hashes), bool)
        known = np.full(len(hashes), -1)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes[:, 0], hashes[:, 0]), len(self.hashes) - 1)
            known = np.where((self.hashes[at] == hashes).all(axis=1), at, -1)
            mine, theirs = places, self.places[at]
            less = (theirs[:, 0] < mine[:, 0]) | (theirs[:, 0] == mine[:, 0]) & ((theirs[:, 1] < mine[:, 1]) | (theirs[:, 1] == mine[:, 1]) & (theirs[:, 2] < mine[:, 2]))
            out = (known >= 0) & less
            earlier = (known >= 0) & ~less
            self.places[known[earlier]] = places[earlier]
        new = often & (known < 0)
        if new.any():
            h, p = np.concatenate((self.hashes, hashes[new])), np.concatenate((self.places, places[new]))
            h, p = (h, p) if len(h) <= MET else (hashes[new], places[new])
            order = np.unique(h[:, 0], return_index=True)[1]  # of two hashes that begin alike, one is remembered
            self.hashes, self.places = h[order], p[order]
        return out


def _found(batches):
    names = FOUND.replace(" long", "").replace(" int", "").replace(" boolean", "").split(", ")
    met = _Met()
    for batch in batches:
        docs = batch.column(0).fill_null(-(1 << 63)).to_numpy()
        tags, texts, at = batch.column(1).to_numpy(), batch.column(2).cast(pa.binary()), 0
        while at < batch.num_rows:
            part, size, begin = [], 0, at
            while at < batch.num_rows and size < SLICE:
                part.append(texts[at].as_py() or b"")
                size += len(part[-1])
                at += 1
            own, a, e, h1, h2 = spans(part)
            doc, tag = docs[begin:at][own], tags[begin:at][own]
            order = np.lexsort((a, tag, doc, h2, h1))
            doc, tag, a, e, h1, h2 = (x[order] for x in (doc, tag, a, e, h1, h2))
            if not len(doc):
                continue
            same = np.concatenate(([False], (h1[1:] == h1[:-1]) & (h2[1:] == h2[:-1])))
            where = np.concatenate(([True], (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1]) | (a[1:] != a[:-1])))
            keep = ~same | where  # repeated rows are one document
            start = np.maximum.accumulate(np.where(same, 0, np.arange(len(doc))))
            sure = same & ((doc != doc[start]) | (tag != tag[start]) | (a != a[start]))
            heads = np.flatnonzero(~same)
            often = np.diff(np.append(heads, len(doc))) > 1
            sure[heads] = met.later(np.stack((h1[heads], h2[heads]), 1), np.stack((doc[heads], tag[heads], a[heads]), 1), often)
            sure |= same & sure[start]  # whatever is met earlier elsewhere, all of its kind here repeat
            h1 = np.where(sure, splitmix(doc.view(np.uint64) ^ tag.view(np.uint64)) + a.astype(np.uint64), h1)  # not joined, so dealt evenly
            cols = (h1.view(np.int64), h2.view(np.int64), doc, tag, a.astype(np.int32), e.astype(np.int32), sure)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c[keep])) for c in cols], names)


def _later(batches):
    """Of rows sorted by hash, document and place: those that are sure or not the first of their hash."""
    last = None
    for batch in batches:
        sure = batch.column(6)
        if sure.true_count:
            rows = batch.filter(sure)
            yield pa.RecordBatch.from_arrays([rows.column(i) for i in (2, 3, 4, 5)], ["doc", "tag", "first", "end"])
            batch = batch.filter(pc.invert(sure))
        if not batch.num_rows:
            continue
        h1, h2, doc, tag, a = (batch.column(i).to_numpy() for i in range(5))
        new = np.concatenate(([last is None or (h1[0], h2[0]) != last[:2]], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])))
        at = np.maximum.accumulate(np.where(new, np.arange(len(h1)), -1))
        head = [np.where(at >= 0, x[at], last[2 + k] if last else 0) for k, x in enumerate((doc, tag, a))]
        later = (doc != head[0]) | (tag != head[1]) | (a != head[2])
        last = (h1[-1], h2[-1], *(x[-1] for x in head))
        if later.any():
            rows = batch.filter(pa.array(later))
            yield pa.RecordBatch.from_arrays([rows.column(i) for i in (2, 3, 4, 5)], ["doc", "tag", "first", "end"])


def _covered(first: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
    d = np.zeros(n + 1, np.int64)
    np.add.at(d, first, 1)
    np.add.at(d, end, -1)
    return np.cumsum(d[:-1]) > 0


def _without(text: bytes, first: np.ndarray, end: np.ndarray) -> tuple[bytes, int]:
    ends, _ = cut(text, np.array([0, len(text)]))
    gone = _covered(first, end, len(ends))
    begins = np.concatenate(([0], ends[:-1]))
    return b"".join(text[a:b] for a, b in zip(begins[~gone].tolist(), ends[~gone].tolist(), strict=True)), int(gone.sum())


def _cut_out(text: int, cols: list[str]):
    """Columns: those of the documents, then the spans to remove as bytes of pairs of 32-bit numbers, or null."""

    def run(batches):
        for batch in batches:
            texts, lists = batch.column(text).cast(pa.binary()), batch.column(len(cols))
            new, removed = [], np.zeros(batch.num_rows, np.int64)
            for i in range(batch.num_rows):
                body, s = texts[i].as_py(), lists[i].as_py()
                if s and body:
                    pairs = np.array(s, np.int64)
                    body, removed[i] = _without(body, pairs >> 32, pairs & 0xFFFFFFFF)
                new.append(body)
            out = [batch.column(i) for i in range(len(cols))]
            out[text] = pa.array(new, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*out, pa.array(removed)], [*cols, "removed_units"])

    return run


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with repeated spans cut out of text, and the column removed_units added at the end."""
    from pyspark.sql import types as T

    scratch = Scratch(docs.sparkSession, "substring")
    tag = F.xxhash64(F.col(text))
    found = docs.select(F.col(doc_id).cast("long").alias("doc"), tag.alias("tag"), F.col(text).alias("text")).mapInArrow(trimmed(_found), FOUND)
    gone = found.repartition("h1").sortWithinPartitions("h1", "h2", "doc", "tag", "first").mapInArrow(trimmed(_later), "doc long, tag long, first int, end int")
    packed = (F.shiftleft(F.col("first").cast("long"), 32) + F.col("end")).alias("pair")
    # Distinct pairs: as many at most as a text has spans, however often the text is repeated.
    gone = scratch.save(gone.select("doc", "tag", packed).groupBy("doc", "tag").agg(F.collect_set("pair").alias("pairs")), "gone")
    gone = gone.select(F.col("doc").alias("__doc"), F.col("tag").alias("__tag"), F.col("pairs").alias("__pairs"))
    cols, at = docs.columns, docs.columns.index(text)
    plain = docs.toDF(*(f"__c{i}" for i in range(len(cols))))
    at_id = cols.index(doc_id)
    # What is cut out grows with the corpus, so it is never broadcast.
    joined = plain.join(gone.hint("merge"), (F.coalesce(F.col(f"__c{at_id}").cast("long"), F.lit(-(1 << 63))) == F.col("__doc")) & (F.xxhash64(f"__c{at}") == F.col("__tag")), "left").select(*plain.columns, "__pairs")
    schema = T.StructType([*plain.schema.fields[:at], T.StructField(f"__c{at}", T.StringType()), *plain.schema.fields[at + 1 :], T.StructField("removed_units", T.LongType())])
    names = plain.columns
    return joined.mapInArrow(trimmed(_cut_out(at, names)), schema).toDF(*cols, *free_names(["removed_units"], cols))


def op10(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


QUERIES = {"op10_substring_dedup": op10}
ORACLES: dict[str, str] = {}
