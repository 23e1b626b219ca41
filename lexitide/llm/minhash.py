"""Near-duplicate documents: b-bit MinHash signatures joined by a multi-index Hamming search.

A document is the set of its distinct word shingles. Its signature holds CHUNKS chunks of WIDTH
symbols, each the low 16 bits of a MinHash. Two signatures that differ in at most 2 * CHUNKS - 1
symbols have, by pigeonhole, a chunk with at most one error; so every chunk is looked up once per
place that may be wrong, with that place left out (which finds equal chunks too). All pairs within
that distance share such a key, whatever the size of the bucket.

1. features: one pass over whole texts gives set size, 128-bit set fingerprint and signature.
2. Equal sets fold into the one with the smallest doc_id before any join, so copies cost one row each.
3. Keys of the distinct sets are sorted; a bucket of up to BUCKET members compares its signatures in
   memory and links those within the distance (a spanning forest, not pairs). Fuller buckets are found by
   a count first and never gathered: all members are tested against the least one in a join, and what is
   too far from it meets every member block by block.
4. Links make candidate groups. A group of up to MEMBERS documents and BLOCK shingles is one unit of work
   that compares all its full shingle sets. Larger ones fold first: every document meets the least one it
   was linked to, in units of that many, then the least of each class so found meet each other. Mostly
   one class is left and all is done. Else the documents outside the largest class meet each other and
   that class, block by block; members of the largest class never meet again. So sets move once or twice
   a document where copies resemble each other, and (documents / MEMBERS) times only those that do not
   resemble the rest of their candidate group. Only spanning forests of confirmed links leave the units.
5. Components of the confirmed links, joined back to all documents by fingerprint.

Defined cases: null or empty texts, and texts without words, have an empty set, are linked with nothing
and kept; fewer words than a shingle make one shingle; rows with equal doc_id are one node, whatever
their texts, and share a component; a null doc_id is linked with nothing and kept; very long texts are
taken whole; an empty table gives an empty result; of further columns none is read, so clashing names do
not matter. Shingles are compared by 64-bit hashes: two different ones of a pair of documents coincide
with a chance near n * n / 2 ** 64.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexitide.llm.common import Scratch, broadcast_if_small, runs, splitmix, trimmed
from lexitide.llm.components import components, forest

CHUNKS, WIDTH = 8, 5
SYMBOLS = CHUNKS * WIDTH
#: Members up to which a bucket is compared in memory; fuller ones meet in blocks of as many.
BUCKET = 4096
#: Documents and shingles in a block of a candidate group; a unit of verification reads two blocks.
MEMBERS, BLOCK = 128, 150_000
#: Shingles that are hashed at a time.
SLICE = 1 << 18

_rng = np.random.default_rng(20240229)
_XOR = _rng.integers(0, 2**64, SYMBOLS, dtype=np.uint64)
_MUL = _rng.integers(0, 2**63, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: bytes | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; bytes.lower and bytes.split know ASCII only."""
    words = text.lower().split() if text else []
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    k = min(size, n)
    acc = h[: n - k + 1] + np.uint64(k)
    for j in range(1, k):
        acc = splitmix(acc) + h[j : n - k + 1 + j]
    return np.unique(splitmix(acc))


def signatures(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A row of SYMBOLS 16-bit symbols for each non-empty run of values."""
    out = np.empty((len(starts), SYMBOLS), np.uint16)
    for k in range(SYMBOLS):
        low = np.minimum.reduceat((values ^ _XOR[k]) * _MUL[k], starts)
        out[:, k] = (splitmix(low) & np.uint64(0xFFFF)).astype(np.uint16)
    return out


def chunk_keys(sig: np.ndarray) -> np.ndarray:
    """SYMBOLS keys a signature: each chunk with each of its places left out."""
    s = sig.astype(np.uint64)
    keys = np.empty((len(s), SYMBOLS), np.uint64)
    for c in range(CHUNKS):
        for gone in range(WIDTH):
            acc = np.full(len(s), c * WIDTH + gone + 1, np.uint64)
            for j in range(WIDTH):
                if j != gone:
                    acc = splitmix(acc) + s[:, c * WIDTH + j]
            keys[:, c * WIDTH + gone] = splitmix(acc)
    return keys


def sketch(sig: np.ndarray) -> np.ndarray:
    """Three low bits of each symbol in two words: symbols that differ there differ in the signature too."""
    half, out = SYMBOLS // 2, np.zeros((len(sig), 2), np.uint64)
    for k in range(SYMBOLS):
        out[:, k // half] |= (sig[:, k].astype(np.uint64) & np.uint64(7)) << np.uint64(3 * (k % half))
    return out


_LOW = np.uint64(sum(1 << (3 * i) for i in range(SYMBOLS // 2)))


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a ^ b
    return np.bitwise_count((d | (d >> np.uint64(1)) | (d >> np.uint64(2))) & _LOW)


def reach(percent: int) -> int:
    """Symbols of a sketch in which a pair at the threshold differs, plus five deviations; at least the guaranteed distance."""
    p = (1 - percent / 100) * 7 / 8
    return max(2 * CHUNKS - 1, math.ceil(SYMBOLS * p + 5 * math.sqrt(SYMBOLS * p * (1 - p))))


def _features(size: int):
    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).cast(pa.binary())
            at = 0
            while at < batch.num_rows:
                sets, held, first = [], 0, at
                while at < batch.num_rows and held < SLICE:
                    sets.append(shingles(texts[at].as_py(), size))
                    held += len(sets[-1])
                    at += 1
                n = np.array([len(s) for s in sets])
                full = np.flatnonzero(n)
                sig: list = [None] * len(sets)
                if len(full):
                    starts = np.concatenate(([0], np.cumsum(n[full])[:-1]))
                    for i, s in zip(full.tolist(), signatures(np.concatenate(sets), starts), strict=True):
                        sig[i] = s.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(first, at - first), pa.array(n, pa.int64()), pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()), pa.array(sig, pa.binary())],
                    ["doc_id", "n_shingles", "fp", "sig"],
                )

    return run


def _keys(batches):
    for batch in batches:
        if not batch.num_rows:
            continue
        sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, SYMBOLS)
        sk = sketch(sig)
        rep = lambda x: pa.array(np.repeat(x, SYMBOLS).astype(np.int64) if x.dtype != np.uint64 else np.repeat(x, SYMBOLS).view(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(chunk_keys(sig).reshape(-1).view(np.int64)), rep(batch.column(0).to_numpy()), rep(sk[:, 0]), rep(sk[:, 1])], ["key", "doc", "s1", "s2"])


def _bucket_links(limit: int, keys: tuple[str, ...] = ("key",)):
    """Links (a, b) within each run of equal keys, which are at most two blocks."""

    def links(doc, s1, s2):
        if len(doc) == 2:
            return (doc[:1], doc[1:]) if _apart(s1[0], s1[1]) + _apart(s2[0], s2[1]) <= limit else (doc[:0], doc[:0])
        near = np.zeros((len(doc), len(doc)), bool)
        for a in range(0, len(doc), 512):
            near[a : a + 512] = _apart(s1[a : a + 512, None], s1[None]) + _apart(s2[a : a + 512, None], s2[None]) <= limit
        np.fill_diagonal(near, False)
        return forest(near, doc)

    def run(batches):
        seen: set = set()  # links repeat from key to key; what a task has emitted, it skips while it remembers it
        for t in runs(batches, list(keys)):
            if t.num_rows < 2:
                continue
            doc, s1, s2 = (t.column(c).to_numpy() for c in ("doc", "s1", "s2"))
            a, b = links(doc, s1.view(np.uint64), s2.view(np.uint64))
            new = [x for x in zip(a.tolist(), b.tolist(), strict=True) if x not in seen]
            if len(seen) > 100_000:
                seen.clear()
            seen.update(new)
            if new:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in new], pa.int64()), pa.array([x[1] for x in new], pa.int64())], ["a", "b"])

    def lone_free(batches):
        # Runs of one row are most of the input: they go before the row-wise part.
        carry = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if carry is not None:
                batch = pa.Table.from_batches([carry, batch]).combine_chunks().to_batches()[0]
            k = batch.column(0).to_numpy()
            last = len(k) - int(np.argmax(k[::-1] != k[-1])) if k[0] != k[-1] else 0
            carry = batch.slice(last)
            k = k[:last]
            if last:
                same = np.concatenate(([False], k[1:] == k[:-1]))
                keep = same | np.concatenate((same[1:], [False]))
                if keep.any():
                    yield batch.slice(0, last).filter(pa.array(keep))
        if carry is not None and carry.num_rows > 1:
            yield carry

    return (lambda batches: run(lone_free(batches))) if len(keys) == 1 else run


def _sets(size: int, columns: int):
    """The columns before the last as they are, and the set of the text in the last."""

    def run(batches):
        for batch in batches:
            texts = batch.column(columns).cast(pa.binary())
            at = 0
            while at < batch.num_rows:
                sets, held, first = [], 0, at
                while at < batch.num_rows and held < SLICE:
                    sets.append(shingles(texts[at].as_py(), size).tobytes())
                    held += len(sets[-1]) // 8
                    at += 1
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(first, at - first) for c in range(columns)), pa.array(sets, pa.binary())], [*batch.schema.names[:columns], "set"])

    return run


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections. Rare shingles add pair by pair, common ones by matrix products."""
    d = len(sets)
    n = np.array([len(s) for s in sets])
    if d == 2:
        both = np.intersect1d(*sets, assume_unique=True).size
        return np.array([[n[0], both], [both, n[1]]], float)
    owner, value = np.repeat(np.arange(d), n), np.concatenate(sets)
    order = np.argsort(value, kind="stable")
    owner, value = owner[order], value[order]
    starts = np.flatnonzero(np.concatenate(([True], value[1:] != value[:-1]))) if len(value) else np.empty(0, int)
    often = np.diff(np.append(starts, len(value)))
    out = np.zeros((d, d), np.float64)
    few = 12
    for f in range(2, few + 1):
        at = starts[often == f]
        if len(at):
            rows = owner[at[:, None] + np.arange(f)]
            x, y = np.triu_indices(f, 1)
            for part in range(0, len(rows), 1 << 14):
                r = rows[part : part + (1 << 14)]
                out += np.bincount((r[:, x] * d + r[:, y]).ravel(), minlength=d * d).reshape(d, d)
    out += out.T
    at = np.flatnonzero(often > few)
    step = max(64, (1 << 22) // d)
    for part in range(0, len(at), step):
        cols = at[part : part + step]
        m = np.zeros((d, len(cols)), np.float32)
        for j, c in enumerate(cols.tolist()):
            m[owner[starts[c] : starts[c] + often[c]], j] = 1
        out += m @ m.T
    np.fill_diagonal(out, n)
    return out


UNIT = ["group", "lo", "hi"]


def _confirm(percent: int):
    def run(batches):
        for t in runs(batches, UNIT):
            if t.num_rows < 2:
                continue
            doc = t.column("doc").to_numpy()
            sets = [np.frombuffer(x, np.uint64) for x in t.column("set").to_pylist()]
            n = np.array([len(s) for s in sets])
            both = overlaps(sets)
            near = 100 * both >= percent * (n[:, None] + n[None] - both)
            np.fill_diagonal(near, False)
            a, b = forest(near, doc)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return run


def _confirmed(sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) among the documents of each unit of sets(group, lo, hi, doc, set)."""
    return sets.select(*UNIT, "doc", "set").repartition(*UNIT).sortWithinPartitions(*UNIT).mapInArrow(trimmed(_confirm(percent)), "a long, b long")


def _meetings(scratch: Scratch, rows: DataFrame, group: str, size: int, name: str, weight: int | None = None) -> DataFrame:
    """rows(group, doc, main, n, ...) once for each unit (lo, hi) it belongs to: all that is not main meets all else of its group, main rows never meet.

    Blocks hold about size documents, and about weight of the sum of n. Groups without such rows have no units.
    """
    parts = lambda kind: F.greatest(F.ceil(F.count_if(kind) / size), F.ceil(F.sum(F.when(kind, F.col("n")).otherwise(0)) / (weight or 1 << 62)))
    sums = rows.groupBy(group).agg(parts(~F.col("main")).cast("long").alias("__r"), parts(F.col("main")).cast("long").alias("__m")).where("__r > 0")
    sums = scratch.save(sums, name)
    dealt = rows.join(broadcast_if_small(sums, sums.count(), 48), group)
    h = F.xxhash64("doc", F.lit(name))
    dealt = dealt.withColumn("__me", F.when(F.col("main"), F.col("__r") + F.pmod(h, F.greatest("__m", F.lit(1)))).otherwise(F.pmod(h, F.col("__r"))))
    last = F.when(F.col("main"), F.col("__r")).otherwise(F.col("__r") + F.col("__m")) - 1
    dealt = dealt.withColumn("__o", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    return dealt.withColumn("lo", F.least("__me", "__o")).withColumn("hi", F.greatest("__me", "__o")).drop("__r", "__m", "__me", "__o")


def _candidates(scratch: Scratch, reps: DataFrame, limit: int, bucket: int) -> DataFrame:
    """Links (a, b) that connect all documents whose signatures are within the distance; stored."""
    keyed = reps.select("doc", "sig").mapInArrow(_keys, "key long, doc long, s1 long, s2 long")
    full = scratch.save(keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > bucket).select("key"), "full-keys")
    rows = full.count()
    few = broadcast_if_small(full, rows, 16)
    plain = keyed.join(few, "key", "left_anti") if rows else keyed
    links = plain.repartition("key").sortWithinPartitions("key").mapInArrow(trimmed(_bucket_links(limit)), "a long, b long")
    if rows:
        hot = scratch.save(keyed.join(few, "key", "left_semi"), "full-buckets")
        least = scratch.save(hot.groupBy("key").agg(F.min(F.struct("doc", "s1", "s2")).alias("l")), "full-least")
        mask = F.lit(int(_LOW))
        three = lambda d: F.bit_count((d.bitwiseOR(F.shiftrightunsigned(d, 1)).bitwiseOR(F.shiftrightunsigned(d, 2))).bitwiseAND(mask))
        apart = three(F.col("s1").bitwiseXOR(F.col("l.s1"))) + three(F.col("s2").bitwiseXOR(F.col("l.s2")))
        tested = hot.join(broadcast_if_small(least, rows, 48), "key").select("key", "doc", "s1", "s2", F.lit(1).alias("n"), F.col("l.doc").alias("b"), (apart <= limit).alias("main"))
        tested = scratch.save(tested, "full-tested")
        links = links.unionByName(tested.where("main AND doc != b").select(F.col("doc").alias("a"), "b").distinct())
        met = _meetings(scratch, tested.drop("b"), "key", bucket, "full-blocks").select("key", "lo", "hi", "doc", "s1", "s2")
        keys = ["key", "lo", "hi"]
        links = links.unionByName(met.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(trimmed(_bucket_links(limit, tuple(keys))), "a long, b long"))
    links = scratch.save(links, "candidate-links")
    scratch.drop(*(x for x in ("full-keys", "full-buckets", "full-least", "full-tested", "full-blocks") if x in scratch.names))
    return links


def _fold(scratch: Scratch, docs: DataFrame, wide: DataFrame, links: DataFrame, size: int, percent: int, members: int, block: int) -> DataFrame:
    """Confirmed links (a, b) of the large groups of wide(component, doc, n); stored, complete up to connection."""
    few = wide.select("doc")
    texts = docs.join(broadcast_if_small(few, few.count(), 16), docs.doc_id == F.col("doc"), "inner").select("doc", "text")
    sets = scratch.save(texts.mapInArrow(trimmed(_sets(size, 1)), "doc long, set binary"), "sets")
    meet = lambda units, name: scratch.save(_confirmed(units.join(sets, "doc"), percent), name)

    def dealt(rows: DataFrame, name: str) -> DataFrame:
        """rows(group, doc, n) in units of so many documents and shingles."""
        sums = rows.groupBy("group").agg(F.greatest(F.ceil(F.count("*") / (members - 1)), F.ceil(F.sum("n") / block)).cast("long").alias("__k"))
        sums = scratch.save(sums, f"{name}-sizes")
        return rows.join(broadcast_if_small(sums, sums.count(), 16), "group").select("group", F.pmod(F.xxhash64("doc", F.lit(3)), "__k").alias("lo"), F.lit(0).cast("long").alias("hi"), "doc")

    def classes(found: DataFrame, name: str) -> tuple[DataFrame, DataFrame, int]:
        """The class of each document, and the groups that have several, with their count."""
        got = components(scratch, found, name).withColumnRenamed("node", "doc").withColumnRenamed("component", "cls")
        cls = scratch.save(wide.join(broadcast_if_small(got, got.count(), 16), "doc", "left").select("component", "doc", "n", F.coalesce("cls", "doc").alias("cls")), f"{name}-classes")
        left = scratch.save(cls.groupBy("component").agg(F.min("cls").alias("x"), F.max("cls").alias("y")).where("x != y").select("component"), f"{name}-open")
        n = left.count()
        return cls, broadcast_if_small(left, n, 16), n

    # Every document meets the least one it was linked to.
    lead = links.select(F.greatest("a", "b").alias("doc"), F.least("a", "b").alias("group")).where("doc != group").groupBy("doc").agg(F.min("group").alias("group"))
    units = scratch.save(dealt(lead.join(broadcast_if_small(wide, wide.count(), 24), "doc").select("group", "doc", "n"), "fold-1"), "unit-members")
    units = units.unionByName(units.select("group", "lo", "hi", F.col("group").alias("doc")).distinct())
    found = meet(units, "fold-1")
    cls, left, n_left = classes(found, "fold-1c")
    if n_left:
        # The least of each class meet each other.
        heads = cls.join(left, "component", "left_semi").where("doc = cls").select(F.col("component").alias("group"), "doc", "n")
        found = found.unionByName(meet(dealt(heads, "fold-2"), "fold-2"))
        cls, left, n_left = classes(found, "fold-2c")
    if n_left:
        # What is outside the largest class meets all documents of the group.
        rest = cls.join(left, "component", "left_semi")
        sizes = rest.groupBy("component", "cls").agg(F.count("*").alias("k"))
        largest = scratch.save(sizes.groupBy("component").agg(F.min_by("cls", F.struct(-F.col("k"), "cls")).alias("big")), "largest")
        rows = rest.join(broadcast_if_small(largest, n_left, 24), "component").select(F.col("component").alias("group"), "doc", "n", (F.col("cls") == F.col("big")).alias("main"))
        met = _meetings(scratch, rows, "group", members, "block-sizes", block)
        found = found.unionByName(meet(met, "cross"))
    return found


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, block: int = BLOCK, members: int = MEMBERS, bucket: int | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs(doc_id, text)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "minhash")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    feats = scratch.save(docs.mapInArrow(trimmed(_features(size)), "doc_id long, n_shingles long, fp binary, sig binary"), "features")
    known = feats.where("fp IS NOT NULL AND doc_id IS NOT NULL")
    reps = scratch.save(
        known.groupBy("fp").agg(F.min(F.struct("doc_id", "n_shingles", "sig")).alias("m"), F.count("*").alias("copies")).select("fp", F.col("m.doc_id").alias("doc"), F.col("m.n_shingles").alias("n"), F.col("m.sig").alias("sig"), "copies"),
        "reps",
    )
    links = _candidates(scratch, reps, reach(percent), bucket or BUCKET)
    groups = components(scratch, links, "candidates").withColumnRenamed("node", "doc")
    groups = reps.select("doc", "n").join(broadcast_if_small(groups, groups.count(), 24), "doc").groupBy("component", "doc").agg(F.max("n").alias("n"))
    groups = scratch.save(groups, "groups")
    large = groups.groupBy("component").agg(F.count("*").alias("d"), F.sum("n").alias("n")).where((F.col("d") > members) | (F.col("n") > block)).select("component")
    large = scratch.save(large, "large")
    n_large = large.count()
    small = groups.join(broadcast_if_small(large, n_large, 16), "component", "left_anti") if n_large else groups
    small = scratch.save(small.select(F.col("component").alias("group"), "doc"), "small")
    texts = docs.join(broadcast_if_small(small, small.count(), 24), docs.doc_id == F.col("doc")).select("group", F.lit(0).cast("long").alias("lo"), F.lit(0).cast("long").alias("hi"), "doc", "text")
    confirmed = _confirmed(texts.mapInArrow(trimmed(_sets(size, 4)), "group long, lo long, hi long, doc long, set binary"), percent)
    if n_large:
        wide = scratch.save(groups.join(broadcast_if_small(large, n_large, 16), "component", "left_semi"), "wide")
        confirmed = confirmed.unionByName(_fold(scratch, docs, wide, links, size, percent, members, block))
    # Rows with equal doc_id are one node: the classes of its texts belong together.
    twice = scratch.save(known.groupBy("doc_id").agg(F.min("fp").alias("x"), F.max("fp").alias("y")).where("x != y").select("doc_id"), "twice")
    if not twice.isEmpty():
        own = known.join(twice, "doc_id", "left_semi").select("doc_id", "fp").distinct().join(reps.select("fp", "doc"), "fp")
        confirmed = confirmed.unionByName(own.select(F.col("doc").alias("a"), F.min("doc").over(Window.partitionBy("doc_id")).alias("b")).where("a != b"))
    joined = components(scratch, confirmed, "links").withColumnRenamed("node", "doc")
    classes = reps.select("fp", "doc", "copies").join(broadcast_if_small(joined, joined.count(), 24), "doc", "left").select("fp", F.coalesce("component", "doc").alias("component"), "doc", "copies")
    shared = scratch.save(classes.where("copies > 1 OR component != doc").select("fp", "component"), "classes")
    out = feats.select("doc_id", "n_shingles", "fp").join(shared, "fp", "left")
    component = F.coalesce("component", "doc_id")
    # A row without words takes the component of the other rows of its doc_id.
    bare = scratch.save(feats.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("fp").alias("k"), F.count("*").alias("n")).where("k > 0 AND k < n").select("doc_id"), "bare")
    if not bare.isEmpty():
        of = out.join(bare, "doc_id", "left_semi").where("fp IS NOT NULL").groupBy("doc_id").agg(F.min(component).alias("of_id"))
        out, component = out.join(scratch.save(of, "of-ids"), "doc_id", "left"), F.coalesce("component", "of_id", "doc_id")
    scratch.keep_only("features", "classes", "of-ids")
    out = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that near_duplicates keeps, one for each doc_id; the columns stay as they are."""
    scratch = Scratch(docs.sparkSession, "dedup")
    found = scratch.save(near_duplicates(docs.select("doc_id", "text"), size, percent), "found")
    gone = scratch.save(found.where("NOT kept").select("doc_id").distinct(), "gone")
    out = docs.join(broadcast_if_small(gone, gone.count(), 24), "doc_id", "left_anti").select(*docs.columns)
    again = found.where("kept AND doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id")
    again = scratch.save(again, "again")
    rows = again.count()
    if not rows:
        return out
    again = broadcast_if_small(again, rows, 24)
    return out.join(again, "doc_id", "left_anti").select(*docs.columns).unionByName(out.join(again, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id"]))


def op7(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), 3, 85)


QUERIES = {"op7_minhash_near_dedup": op7}
ORACLES: dict[str, str] = {}
