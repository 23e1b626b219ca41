"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexitide.sources.shared import Scratch, shared_dir, temporary

__all__ = ["Scratch", "shared_dir", "temporary", "broadcast_if_small", "free_names", "runs", "splitmix", "table", "tasks", "trimmed"]

#: A side is broadcast only after its rows were counted and came to no more than this many bytes.
BROADCAST_BYTES = 32 << 20

SPACE = b" \t\n\r\x0b\x0c"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_names(names: list[str], taken: list[str]) -> list[str]:
    """Names for added columns: one that the table has already gets underscores in front until it is free."""
    low, out = {c.lower() for c in taken}, []
    for n in names:
        while n.lower() in low:
            n = f"_{n}"
        out.append(n)
    return out


def broadcast_if_small(df: DataFrame, rows: int, bytes_a_row: int) -> DataFrame:
    """Marks df for broadcast if its counted rows fit BROADCAST_BYTES; else the join shuffles."""
    return F.broadcast(df) if rows * bytes_a_row <= BROADCAST_BYTES else df


def tasks(df: DataFrame) -> int:
    """Tasks for a stage of Python work: what the session sets for shuffles."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def trimmed(function):
    """A function of batches that hands freed memory back to the system at its end: idle Python workers stay, and what they keep is missing to others."""

    def run(batches):
        try:
            yield from function(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not every system's library has it
            if trim:
                trim(0)

    return run


def runs(batches, keys: list[str]):
    """Tables of the rows with equal keys, from Arrow batches sorted by keys; a run may span batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows - 1, bool)
        for c in cols:
            change |= c[1:] != c[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        first = tuple(c[0] for c in cols)
        if held and first != last:
            yield pa.Table.from_batches(held)
            held = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a and held:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
        last = tuple(c[-1] for c in cols)
    if held:
        yield pa.Table.from_batches(held)


def splitmix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64, on unsigned 64-bit numbers."""
    x = (x + np.uint64(0x9E3779B97F4A7C15)).astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
