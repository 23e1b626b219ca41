"""Exact top-k search by inner product with vector-approximation files.

Components become integers, floor(1024 * x). The approximation file holds blocks of candidates: per
component a grid of at most 256 equal cells over the block's range, and one byte a component for the cell;
the exact vectors stay in the table. One matrix product over the cells gives bounds of all scores of a
block of queries.

1. Bounds: every block of queries meets every block of cells once, by an equi-join on the cells' bucket.
   A meeting gives one row with the k best lower bounds of each query; the rows of a block of queries are
   merged to the kth best lower bound over all candidates.
2. Survivors: the meetings again, now with that one bound per query for all blocks. Only candidates whose
   upper bound reaches it leave, so what is shuffled grows with queries times k.
3. Exact vectors are read in the order of the upper bounds: first those of the 2 k most promising
   survivors of each query, whose kth best score then is the new bound, then those that still reach it.

Of equal vectors in the table only the smallest k + 1 ids can matter, and only they are stored. Integer
scores fit doubles exactly; for vectors for which they might not, bounds are widened by what rounding
can do (without limit, if they overflow), and Python integers give the scores.

Defined cases: vectors that are null, or hold null or non-finite components, take no part; vectors of
different length are not compared; ties go to the smaller vec_id; repeated rows count once, and a
vec_id with several vectors stands for its best one; scores beyond 64 bits are clipped; no queries or no
table give no rows; further columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexitide.llm.common import Scratch, broadcast_if_small, tasks

SCALE = 1024
#: Cells in a block of candidates (one byte each), most candidates there, queries in a block.
CELLS, CANDIDATES, QUERY_ROWS = 2 << 20, 32_768, 1024
#: Bounds of one slice of queries, so that a meeting needs bounded memory.
SLICE = 4 << 20
EXACT = 2**52
CLIP = float(2**63)

BLOCKS = "block long, dim int, low binary, width binary, ids binary, cells binary"


def integers(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows that take part, their lengths, their components joined together)."""
    n = len(column)
    if not n:
        return np.empty(0, int), np.empty(0, int), np.empty(0)
    column = column.cast(pa.list_(pa.float64()))
    offsets = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False)  # null components become NaN
    bad = np.concatenate(([0], np.cumsum(~np.isfinite(flat))))
    ok = (bad[offsets[1:]] == bad[offsets[:-1]]) & column.is_valid().to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(ok)
    lengths = (offsets[1:] - offsets[:-1])[rows]
    keep = [flat[offsets[r] : offsets[r + 1]] for r in rows.tolist()]
    return rows, lengths, np.floor(SCALE * np.concatenate(keep)) if keep else np.empty(0)


def _by_length(batch):
    """(dim, ids, vectors) for each length in a batch of (vec_id, embedding)."""
    ids = batch.column(0)
    rows, lengths, flat = integers(batch.column(1))
    valid = ids.is_valid().to_numpy(zero_copy_only=False)[rows]
    starts = np.concatenate(([0], np.cumsum(lengths)))
    ids = ids.fill_null(0).to_numpy()[rows]
    for dim in np.unique(lengths).tolist():
        at = np.flatnonzero((lengths == dim) & valid)
        if len(at):
            yield dim, ids[at], flat[starts[at][:, None] + np.arange(dim)[None]].reshape(len(at), dim)


def _blocks(batches):
    task, n = TaskContext.get().partitionId(), 0
    held: dict[int, list] = {}
    names = [x.split()[0] for x in BLOCKS.split(", ")]

    def block(dim: int):
        nonlocal n
        ids, v = (np.concatenate(x) for x in zip(*held.pop(dim), strict=True))
        low = v.min(0)
        width = np.maximum(1, np.ceil((v.max(0) - low + 1) / 256))
        cells = np.clip(np.floor((v - low) / width), 0, 255).astype(np.uint8)
        data = [[(task << 32) + n], [dim], [low.tobytes()], [width.tobytes()], [ids.astype(np.int64).tobytes()], [cells.tobytes()]]
        n += 1
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(data, [pa.int64(), pa.int32(), *[pa.binary()] * 4], strict=True)], names)

    for batch in batches:
        for dim, ids, vectors in _by_length(batch):
            size = max(1, min(CANDIDATES, CELLS // dim))
            for a in range(0, len(ids), size):
                held.setdefault(dim, []).append((ids[a : a + size], vectors[a : a + size]))
                if sum(len(i) for i, _ in held[dim]) >= size:
                    yield block(dim)
    for dim in list(held):
        yield block(dim)


def _query_blocks(batches):
    task, n = TaskContext.get().partitionId(), 0
    for batch in batches:
        for dim, ids, vectors in _by_length(batch):
            for a in range(0, len(ids), QUERY_ROWS):
                yield pa.RecordBatch.from_arrays([pa.array([(task << 32) + n]), pa.array([dim], pa.int32()), pa.array([ids[a : a + QUERY_ROWS].astype(np.int64).tobytes()], pa.binary()), pa.array([vectors[a : a + QUERY_ROWS].tobytes()], pa.binary())], ["qblock", "qdim", "qids", "qvectors"])
                n += 1


def bounds(low, width, cells, queries):
    """(lower, upper) bounds of the scores of queries [query, component] and cells [candidate, component], for certain."""
    with np.errstate(over="ignore", invalid="ignore"):
        base = (queries * width) @ cells.T.astype(np.float64) + (queries @ low)[:, None]
        up, down = np.maximum(queries, 0) @ (width - 1), np.minimum(queries, 0) @ (width - 1)
        big = np.abs(queries).max(1, initial=0) * (np.abs(low) + 256 * width).max(initial=0) * max(1, len(low)) * 4
        slack = np.where(big < EXACT, 0.0, big * 2.0**-40)
        lower, upper = base + (down - slack)[:, None], base + (up + slack)[:, None]
    lower[~np.isfinite(lower)] = -np.inf
    upper[~np.isfinite(upper)] = np.inf
    return np.minimum(lower, CLIP), np.maximum(upper, -CLIP)  # scores are clipped likewise


def _meetings(batches):
    """For each row of a batch: the row, and an iterator over (queries from, to, lower, upper), the query's own id left out."""

    def slices(low, width, cells, ids, qids, queries):
        step = max(1, SLICE // max(1, len(ids)))
        for a in range(0, len(qids), step):
            lower, upper = bounds(low, width, cells, queries[a : a + step])
            own = qids[a : a + step, None] == ids[None]
            lower[own] = upper[own] = -np.inf
            yield a, a + len(lower), lower, upper

    for batch in batches:
        names = batch.schema.names
        for i in range(batch.num_rows):
            row = {c: batch.column(k)[i].as_py() for k, c in enumerate(names)}
            of = lambda c, t=np.float64: np.frombuffer(row[c], t)  # noqa: B023, E731
            ids, qids = of("ids", np.int64), of("qids", np.int64)
            row |= {"ids": ids, "qids": qids}
            yield row, slices(of("low"), of("width"), of("cells", np.uint8).reshape(len(ids), -1), ids, qids, of("qvectors").reshape(len(qids), -1))


def best(ids: np.ndarray, bound: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of bound [query, candidate] the k best of distinct ids, as (ids, bounds), filled up with -inf."""
    n = bound.shape[1]
    if len(np.unique(ids)) < len(ids):  # a vec_id with several vectors counts with its best
        group = np.argsort(ids, kind="stable")
        starts = np.flatnonzero(np.diff(ids[group], prepend=ids[group[0]] - 1))
        ids, bound = ids[group[starts]], np.maximum.reduceat(bound[:, group], starts, axis=1)
        n = len(ids)
    if n > k:
        at = np.argpartition(bound, n - k, axis=1)[:, n - k :]
        return ids[at], np.take_along_axis(bound, at, 1)
    fill = k - n
    return np.pad(np.broadcast_to(ids, bound.shape), ((0, 0), (0, fill))), np.pad(bound, ((0, 0), (0, fill)), constant_values=-np.inf)


def _lower(k: int):
    def run(batches):
        for row, parts in _meetings(batches):
            got = [best(row["ids"], lower, k) for _, _, lower, _ in parts]
            i, s = (np.concatenate(x) for x in zip(*got, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array([row["qblock"]]), pa.array([i.tobytes()], pa.binary()), pa.array([s.tobytes()], pa.binary())], ["qblock", "i", "s"])

    return run


def _cuts(k: int):
    """The kth best lower bound of each query of a block, from the rows of that block."""

    def merged(i, s, j, t):
        i, s = np.concatenate((i, j), 1), np.concatenate((s, t), 1)
        order = np.lexsort((-s, i), axis=1)
        i, s = np.take_along_axis(i, order, 1), np.take_along_axis(s, order, 1)
        s[:, 1:][i[:, 1:] == i[:, :-1]] = -np.inf  # the same candidate from two blocks
        at = np.argpartition(s, k, axis=1)[:, k:]
        return np.take_along_axis(i, at, 1), np.take_along_axis(s, at, 1)

    def run(batches):
        last, held = None, None

        def out():
            return pa.RecordBatch.from_arrays([pa.array([last]), pa.array([held[1].min(1).tobytes()], pa.binary())], ["qblock", "cut"])

        for batch in batches:
            for q, i, s in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                i, s = np.frombuffer(i, np.int64).reshape(-1, k), np.frombuffer(s).reshape(-1, k)
                if q != last and held is not None:
                    yield out()
                held = merged(*held, i, s) if q == last else (i, s)
                last = q
        if held is not None:
            yield out()

    return run


def _survivors(k: int):
    """Candidates whose upper bound reaches the query's cut. Of those whose score is known to equal it, the k smallest ids of a block suffice."""

    def run(batches):
        for row, parts in _meetings(batches):
            cut = np.frombuffer(row["cut"])
            order = np.argsort(row["ids"], kind="stable")
            for a, b, lower, upper in parts:
                at = cut[a:b, None]
                on = (upper >= at) & (upper > -np.inf)
                tied = on & (upper == at) & (lower == upper)
                for q in np.flatnonzero(tied.sum(1) > k).tolist():
                    own = order[tied[q, order]]
                    ids = row["ids"][own]
                    on[q, own[np.searchsorted(ids, np.unique(ids)[:k][-1], "right") :]] = False
                q, c = np.nonzero(on)
                if len(q):
                    yield pa.RecordBatch.from_arrays([pa.array(row["qids"][a + q]), pa.array(row["ids"][c]), pa.array(upper[q, c])], ["query_id", "vec_id", "upper"])

    return run


def dots(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of integer rows, clipped to 64 bits."""
    with np.errstate(over="ignore"):
        safe = np.abs(x).max(1, initial=0) * np.abs(y).max(1, initial=0) * x.shape[1] < EXACT
    out = np.zeros(len(x), np.int64)
    out[safe] = np.einsum("ij,ij->i", x[safe], y[safe]).astype(np.int64)
    for r in np.flatnonzero(~safe).tolist():
        s = sum(int(a) * int(b) for a, b in zip(x[r].tolist(), y[r].tolist(), strict=True))
        out[r] = max(-(2**63), min(2**63 - 1, s))
    return out


def _scored(batches):
    """Rows (query_id, vec_id, query vector, candidate vector), scored where both take part and are of one length."""
    for batch in batches:
        (rows, lengths, flat), (others, sizes, values) = integers(batch.column(2)), integers(batch.column(3))
        both, x, y = np.intersect1d(rows, others, assume_unique=True, return_indices=True)
        begin, start = np.cumsum(lengths) - lengths, np.cumsum(sizes) - sizes
        for dim in np.unique(lengths).tolist():
            on = (lengths[x] == dim) & (sizes[y] == dim)
            span = np.arange(dim)[None]
            s = dots(flat[begin[x[on]][:, None] + span], values[start[y[on]][:, None] + span])
            which = pa.array(both[on])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(which), batch.column(1).take(which), pa.array(s)], ["query_id", "vec_id", "score"])


def _fewer_equal(scratch: Scratch, vectors: DataFrame, k: int) -> DataFrame:
    """vectors without repeated rows that cannot matter: of equal vectors only the smallest k + 1 ids stay. Hashes and ids are all that is counted."""
    h = [F.xxhash64("embedding"), F.xxhash64(F.lit(1), "embedding")]
    many = vectors.groupBy(h[0].alias("h1"), h[1].alias("h2")).agg(F.count("*").alias("n")).where(F.col("n") > k + 1)
    many = scratch.save(many.drop("n"), "many")
    n = many.count()
    if not n:
        return vectors
    marked = vectors.select("*", h[0].alias("h1"), h[1].alias("h2"))
    few = broadcast_if_small(many, n, 32)
    ids = marked.select("h1", "h2", "vec_id").join(few, ["h1", "h2"], "left_semi").distinct()
    rank = F.row_number().over(Window.partitionBy("h1", "h2").orderBy("vec_id"))
    last = scratch.save(ids.withColumn("r", rank).where(F.col("r") <= k + 1).groupBy("h1", "h2").agg(F.max("vec_id").alias("last")), "last")
    out = marked.join(broadcast_if_small(last, n, 40), ["h1", "h2"], "left")
    return out.where("last IS NULL OR vec_id <= last").select("vec_id", "embedding")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score for queries and vectors (vec_id long, embedding array), the query's own vec_id left out."""
    scratch = Scratch(vectors.sparkSession, "vafile")
    takes_part = "vec_id IS NOT NULL AND embedding IS NOT NULL AND size(embedding) > 0"
    pick = lambda df: df.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(takes_part)
    blocks = scratch.save(_fewer_equal(scratch, pick(vectors), k).mapInArrow(_blocks, BLOCKS), "cells")
    n_blocks = blocks.select("block").count()
    asked = scratch.save(pick(queries), "queries")
    n_asked = asked.count()
    asked_blocks = asked.repartition(max(1, -(-n_asked // QUERY_ROWS))).mapInArrow(_query_blocks, "qblock long, qdim int, qids binary, qvectors binary")
    asked_blocks = scratch.save(asked_blocks, "query-blocks")
    # As many buckets as tasks: queries are copied once to each, cells never.
    buckets = max(1, min(n_blocks, tasks(vectors)))
    blocks = blocks.withColumn("bucket", F.pmod(F.xxhash64("block"), F.lit(buckets)).cast("int"))

    def met(few: DataFrame) -> DataFrame:
        few = few.withColumn("qbucket", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
        return blocks.join(few, (F.col("bucket") == F.col("qbucket")) & (F.col("dim") == F.col("qdim"))).drop("qbucket", "qdim", "dim", "bucket", "block")

    lower = met(asked_blocks).mapInArrow(_lower(k), "qblock long, i binary, s binary")
    cuts = scratch.save(lower.repartition("qblock").sortWithinPartitions("qblock").mapInArrow(_cuts(k), "qblock long, cut binary"), "cuts")
    left = met(asked_blocks.join(cuts, "qblock")).mapInArrow(_survivors(k), "query_id long, vec_id long, upper double")
    left = scratch.save(left.groupBy("query_id", "vec_id").agg(F.max("upper").alias("upper")), "survivors")

    def scored(pairs: DataFrame, n: int, name: str) -> DataFrame:
        """Exact scores of n pairs(query_id, vec_id), the best of each."""
        exact = pick(vectors)
        exact = exact.join(broadcast_if_small(pairs.select("vec_id").distinct(), n, 16), "vec_id", "left_semi")
        wanted = asked.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
        rows = pairs.join(exact.withColumnRenamed("embedding", "v"), "vec_id").join(broadcast_if_small(wanted, n_asked, 8 * width + 32), "query_id")
        got = rows.select("query_id", "vec_id", "q", "v").mapInArrow(_scored, "query_id long, vec_id long, score long")
        return scratch.save(got.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")), name)

    width = asked.agg(F.max(F.size("embedding"))).first()[0] or 0
    # The rank limits also run before their shuffles, so a query with very many survivors is never gathered.
    promise = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("upper"), "vec_id"))
    pairs = scratch.save(left.withColumn("r", promise).where(F.col("r") <= 2 * k).select("query_id", "vec_id"), "promising")
    near = scored(pairs, pairs.count(), "first")
    down = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    kth = near.withColumn("r", F.row_number().over(down)).where(F.col("r") == k).select("query_id", F.col("score").cast("double").alias("kth"))
    more = left.join(broadcast_if_small(pairs, n_asked, 32 * k), ["query_id", "vec_id"], "left_anti").join(broadcast_if_small(kth, n_asked, 16), "query_id", "left")
    more = scratch.save(more.where("kth IS NULL OR upper >= kth").select("query_id", "vec_id"), "later")
    n_more = more.count()
    found = near.unionByName(scored(more, n_more, "second")) if n_more else near
    scratch.keep_only("first", "second")
    return found.withColumn("rank", F.row_number().over(down)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return top_k(vectors, vectors.where("vec_id % 100 = 0"))


QUERIES = {"op2_exact_topk": op2}
ORACLES = {
    "op2_exact_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10"""
}
