"""Sequence packing: shortest-pack-first over the length histogram.

1. One pass tokenises whole texts, adds the closing id and cuts documents into pieces of at most
   MAX_LEN ids. Each task numbers its pieces of each length; what it read is a fixed split, so a
   repeated task numbers them alike, and the numbered pieces are written before they are used.
2. The histogram (at most MAX_LEN numbers, whatever the input) goes to the driver. Lengths are placed
   longest first, each into the packs with most room left; packs alike are one pattern with a count.
3. A piece's rank among those of its length is its number plus a running sum over tasks. Each place
   of a pattern owns an interval of ranks, so a search in a small bounded table yields the sequence.

Tokens come from the public byte-level BPE, run from its ranks. Texts with the start of a special string,
or with a run of white space so long that the fast encoder's pattern could not step back from its end,
go through the slower full tokeniser; the ids are the same.

Defined cases: null or empty texts have one piece of one id; a null doc_id stays null; repeated rows
are packed each for itself; ties between packs go to the older pattern; an empty table gives no
pieces; of further columns none is read.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexitide.llm.common import Scratch, broadcast_if_small

MAX_LEN = 1024
#: Characters of white space in a row that the fast encoder is not given.
SPACES = 20_000
_SPACE = re.compile(r"\s+")


class Tokens:
    """Text to the bytes of its little-endian 32-bit ids."""

    def __init__(self, ranks_file: str, json_file: str, pattern: str):
        import base64

        import tiktoken

        with open(ranks_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.core = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.json_file, self.full = json_file, None

    def encode(self, text: str) -> bytes:
        if "<|" in text or self._long_space(text):
            if self.full is None:
                from tokenizers import Tokenizer

                self.full = Tokenizer.from_file(self.json_file)
            ids = self.full.encode(text, add_special_tokens=False).ids
        else:
            ids = self.core.encode_ordinary(text)
        return np.array(ids, "<u4").tobytes()


    @staticmethod
    def _long_space(text: str) -> bool:
        return len(text) >= SPACES and any(m.end() - m.start() >= SPACES for m in _SPACE.finditer(text))


_tokens: dict = {}


def tokens(files: tuple[str, str, str]) -> Tokens:
    if files not in _tokens:
        _tokens[files] = Tokens(*files)
    return _tokens[files]


def public_files() -> tuple[str, str, str]:
    import public_tokenizers as public

    return public.path("byte_bpe_50k.tiktoken"), public.path("byte_bpe_50k.json"), public.PATTERN


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, task long, nth long"


def _pieces(files: tuple[str, str, str], max_len: int, end_id: int):
    def run(batches):
        enc = tokens(files)
        task, seen = TaskContext.get().partitionId(), np.zeros(max_len + 1, np.int64)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for i, doc in enumerate(ids):
                data = enc.encode(texts[i].as_py() or "") + end
                total = len(data) // 4
                for at in range(0, total, max_len):
                    length = min(max_len, total - at)
                    for col, x in zip(out, (doc, at, length, zlib.crc32(data[4 * at : 4 * (at + length)]), total, task, seen[length]), strict=True):
                        col.append(x)
                    seen[length] += 1
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], SCHEMA.replace(" long", "").split(", "))

    return run


def patterns(histogram: dict[int, int], max_len: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, count) of the packs: longest lengths first, each into the packs with most room.

    What fits nowhere opens new packs, which are the roomiest for the rest of its own length.
    """
    room: dict[int, list] = defaultdict(list)
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            most = max(room, default=0)
            if most < length:
                each = max_len // length
                for copies, count in ((each, left // each), (left % each, 1)):
                    if copies and count:
                        room[max_len - copies * length].append(((length,) * copies, count))
                break
            pack, count = room[most].pop(0)
            took = min(left, count)
            if count > took:
                room[most].insert(0, (pack, count - took))
            if not room[most]:
                del room[most]
            room[most - length].append(((*pack, length), took))
            left -= took
    return [x for packs in room.values() for x in packs]


def places(packs: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, ...]:
    """Rows (length, first rank, first sequence, offset), sorted: rank r of a length is in sequence first + r - rank."""
    used: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for lengths, count in sorted(packs, reverse=True):
        at = 0
        for length in lengths:
            rows.append((length, used[length], sequence, at))
            used[length] += count
            at += length
        sequence += count
    rows.sort()
    return tuple(np.array(c, np.int64) for c in zip(*rows, strict=True)) if rows else (np.empty(0, np.int64),) * 4


def _placed(table: tuple[np.ndarray, ...]):
    length, rank, sequence, offset = table
    key = (length << np.int64(48)) + rank

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            n, r = batch.column(2).to_numpy(), batch.column(5).to_numpy()
            at = np.searchsorted(key, (n << np.int64(48)) + r, "right") - 1
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), pa.array(sequence[at] + r - rank[at]), pa.array(offset[at])], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, files: tuple[str, str, str] | None = None, max_len: int = MAX_LEN, end_id: int = 0) -> DataFrame:
    """A row for each piece of docs(doc_id, text): its cut, its ids' CRC, and its place in a sequence."""
    scratch = Scratch(docs.sparkSession, "packing")
    cut = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_pieces(files or public_files(), max_len, end_id), SCHEMA)
    pieces = scratch.save(cut, "pieces")
    counts = scratch.save(pieces.groupBy("task", "length").count(), "counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    before = F.sum("count").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    base = counts.select("task", "length", F.coalesce(before, F.lit(0)).alias("base"))
    ranked = pieces.join(broadcast_if_small(base, counts.count(), 80), ["task", "length"])
    ranked = ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("nth") + F.col("base")).alias("rank"))
    return ranked.mapInArrow(_placed(places(patterns(histogram, max_len))), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def op4(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


QUERIES = {"op4_packing": op4}
ORACLES: dict[str, str] = {}
