"""Bigrams in columns: counts and look-ups over chunks of posts, with few bytes a bigram on the way.

A chunk is some posts of one task, of about CHUNK words. Its distinct bigrams are dealt by group and first word to
buckets, and leave it as one compressed table for each. A bucket is one task's: all bigrams of a first word meet there
and are counted. Everything here works on whole columns; nothing loops over words.
"""

from __future__ import annotations

import ctypes
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pandas.util import hash_array
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexitide.functions.text import UNKNOWN

#: Words of a chunk, rows of a batch that is handed back, words whose bigrams are a bucket at most, and at least if the session's partitions are many.
CHUNK, ROWS, PART, LEAST = 1 << 21, 1 << 16, 1 << 21, 1 << 16


def fields(df: DataFrame, columns: list[str]) -> list[str]:
    kinds = dict(df.dtypes)
    return [f"`{c}` {kinds[c]}" for c in columns]


def combined(array):
    """One array of a column of chunks."""
    got = array.combine_chunks() if isinstance(array, pa.ChunkedArray) else array
    return got if not isinstance(got, pa.ChunkedArray) else pa.concat_arrays(got.chunks) if got.num_chunks else pa.array([], got.type)


def codes(table: pa.Table, columns: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(a number for each row, equal for equal values of the columns, nulls too; the first row of each number)."""
    out = np.zeros(table.num_rows, np.int64)
    for c in columns:
        one = combined(combined(table[c]).dictionary_encode(null_encoding="encode")).indices.to_numpy(zero_copy_only=False)
        out = np.unique(out * (int(one.max(initial=0)) + 1) + one, return_inverse=True)[1].reshape(-1)
    first = np.unique(out, return_index=True)[1]
    return out, first


def keys_of(table: pa.Table, columns: list[str], rows: np.ndarray) -> list[tuple]:
    """The values of the columns in some rows."""
    got = [table[c].take(pa.array(rows)).to_pylist() for c in columns]
    return list(zip(*got, strict=True)) if columns else [()] * len(rows)


def sealed(table: pa.Table) -> bytes:
    """A table as bytes, compressed."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def opened(column) -> list[pa.Table]:
    return [pa.ipc.open_stream(x.as_buffer()).read_all() for x in combined(column)]


def planes(x: np.ndarray) -> np.ndarray:
    """The bytes of numbers, all first ones first: so they compress better."""
    return np.ascontiguousarray(x.astype(np.uint32).view(np.uint8).reshape(-1, 4).T).reshape(-1)


def lists(column) -> tuple[pa.Array, np.ndarray]:
    """(the values of a column of lists, how many each has)."""
    a = combined(column)
    return combined(a.flatten()), pc.list_value_length(a).to_numpy(zero_copy_only=False).astype(np.int64)


def numbers(column) -> np.ndarray:
    return combined(column).to_numpy(zero_copy_only=False)


def chunks(batches, words: str):
    """Tables of about CHUNK words; a post is never cut."""
    held, n = [], 0
    for batch in batches:
        ends = np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(batch.column(words)), 0)), dtype=np.int64)
        a = 0
        while a < batch.num_rows:
            b = int(np.searchsorted(ends, (ends[a - 1] if a else 0) + CHUNK - n, "right"))
            if b <= a and held:
                yield pa.Table.from_batches(held)
                held, n = [], 0
                continue
            b = max(a + 1, b)
            held.append(batch.slice(a, b - a))
            n += int(ends[b - 1] - (ends[a - 1] if a else 0))
            a = b
            if n >= CHUNK or a < batch.num_rows:
                yield pa.Table.from_batches(held)
                held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


@dataclass
class Words:
    """The words of a chunk: lengths of its posts, for each bigram its post and the numbers of its words, and the words by number."""

    lengths: np.ndarray
    post: np.ndarray
    w1: np.ndarray
    w2: np.ndarray
    names: pa.Array

    @classmethod
    def of(cls, table: pa.Table, words: str) -> Words:
        column = combined(table[words])
        lengths = np.asarray(pc.fill_null(pc.list_value_length(column), 0)).astype(np.int64)
        coded = combined(column.flatten()).dictionary_encode(null_encoding="encode")
        number = coded.indices.to_numpy(zero_copy_only=False)
        begins = np.ones(len(number), bool)
        begins[(np.cumsum(lengths) - 1)[lengths > 0]] = False
        at = np.flatnonzero(begins)
        post = np.repeat(np.arange(len(lengths), dtype=np.int32), np.maximum(lengths - 1, 0))
        return cls(lengths, post, number[at], number[at + 1], coded.dictionary)


@dataclass
class Outside:
    """Words of each group that are all it knows (inside), or all that it does not know."""

    groups: list[tuple]
    group: np.ndarray
    words: pa.Array
    inside: bool = False

    @classmethod
    def nothing(cls) -> Outside:
        return cls([], np.zeros(0, np.int64), pa.array([], pa.large_string()))

    @classmethod
    def of(cls, rows: DataFrame, by: list[str], word: str = "token", inside: bool = False) -> Outside:
        """From rows(by, word) that are few."""
        table = rows.select(*by, word).toArrow()
        number, first = codes(table, by)
        return cls(keys_of(table, by, first), number, combined(table[word]).cast(pa.large_string()), inside)

    def renamed(self, group: np.ndarray, groups: list[tuple], word: np.ndarray, names: pa.Array) -> np.ndarray:
        """The numbers of words, with that of <UNK>, one beyond the last name, for those outside."""
        unknown = len(names)
        here = {k: i for i, k in enumerate(groups)}
        to = np.array([here.get(k, -1) for k in self.groups], np.int64)[self.group] if len(self.group) else np.zeros(0, np.int64)
        found = pc.fill_null(pc.index_in(self.words, value_set=names.cast(pa.large_string())), -1).to_numpy(zero_copy_only=False).astype(np.int64) if len(to) else to
        listed = np.sort((to * (unknown + 1) + found)[(to >= 0) & (found >= 0)])
        key = group * (unknown + 1) + word
        at = np.minimum(np.searchsorted(listed, key), max(len(listed) - 1, 0))
        hit = listed[at] == key if len(listed) else np.zeros(len(key), bool)
        return np.where(hit == self.inside, word, unknown)


PACKED = "__kind int, __chunk long, __bucket int, __data binary"


def trimmed(function):
    """A function of batches that hands freed memory back to the system at its end: idle Python workers stay."""

    def run(batches):
        try:
            yield from function(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not every system's library has it
            if trim:
                trim(0)

    return run


def rows(kind: int, chunk: int, bucket: list[int], data: list[bytes]) -> pa.RecordBatch:
    n = len(data)
    columns = [pa.array([kind] * n, pa.int32()), pa.array([chunk] * n, pa.int64()), pa.array(bucket, pa.int32()), pa.array(data, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["__kind", "__chunk", "__bucket", "__data"])


def packer(by: list[str], words: str, outside: Outside, buckets: int, key: str | None = None):
    """A function of batches of posts: for each chunk a table of bigrams for each bucket (__kind 0), and with a key also its posts (1), by the places of their bigrams in these tables, one after another."""

    @trimmed
    def run(batches):
        task, count = TaskContext.get().partitionId(), 0
        for table in chunks(batches, words):
            chunk, count = (task << 32) + count, count + 1
            w = Words.of(table, words)
            group, first = codes(table, by)
            keys, here = keys_of(table, by, first), group[w.post]
            unknown = len(w.names)
            size = unknown + 1
            w1, w2 = (outside.renamed(here, keys, x, w.names) for x in (w.w1, w.w2))
            names = pa.concat_arrays([combined(w.names).cast(pa.large_string()), pa.array([UNKNOWN], pa.large_string())])
            flat = (here * size + w1) * size + w2
            if key:
                pairs, place, n = np.unique(flat, return_inverse=True, return_counts=True)
            else:
                pairs, n = np.unique(flat, return_counts=True)
            posts = table.select(list(dict.fromkeys([*by, *([key] if key else [])]))) if by or key else None
            first_rows = {c: table[c].take(pa.array(first)) for c in by}
            lengths_of_posts = w.lengths
            del flat, w1, w2, here, w, table  # the largest of what a task holds
            heads = pairs // size
            begins = np.flatnonzero(np.diff(heads, prepend=-1))
            lengths = np.diff(np.append(begins, len(pairs)))
            head_group, head = heads[begins] // size, heads[begins] % size
            words_hash = hash_array(names.to_numpy(zero_copy_only=False), categorize=False)
            groups_hash = np.array([crc32(repr(k).encode()) for k in keys], np.uint64)
            bucket = ((words_hash[head] + groups_hash[head_group] * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            lengths = lengths[order]
            ends = np.cumsum(lengths)
            moved = np.repeat(begins[order] - (ends - lengths), lengths) + np.arange(len(pairs))
            offsets = pa.array(np.concatenate([[0], ends]), pa.int64())
            out = {c: first_rows[c].take(pa.array(head_group[order])) for c in by} | {"__w1": names.take(pa.array(head[order]))}
            out["__w2"] = pa.LargeListArray.from_arrays(offsets, names.take(pa.array(pairs[moved] % size)))
            out["__n"] = pa.LargeListArray.from_arrays(offsets, pa.array(n[moved].astype(np.uint32)))
            out = pa.table(out).combine_chunks()
            which, starts = np.unique(bucket[order], return_index=True)
            stops = [*starts[1:].tolist(), len(order)]
            for a in range(0, len(which), 256):
                parts = list(zip(starts[a : a + 256].tolist(), stops[a : a + 256], strict=False))
                yield rows(0, chunk, which[a : a + 256].tolist(), [sealed(out.slice(i, j - i)) for i, j in parts])
            if key:
                back = np.empty(len(pairs), np.int64)
                back[moved] = np.arange(len(pairs))
                posts = pa.table({c: posts[c] for c in by} | {"__key": posts[key], "__size": pa.array(lengths_of_posts)})
                places = pa.table({"__place": pa.array(planes(back[place.reshape(-1)]))})
                yield rows(1, chunk, [0], [sealed(posts)])
                yield rows(2, chunk, [0], [sealed(places)])

    return run


@dataclass
class Counted:
    """The bigrams of a bucket. table: its heads, a group and first word of a chunk each; run: the number of each head, equal for equal ones;
    first: a head of each number; of each distinct bigram the number of its head, its second word and count; total: the count of
    all of a number; and where each packed bigram is among them."""

    table: pa.Table
    run: np.ndarray
    first: np.ndarray
    head: np.ndarray
    w2: pa.Array
    n: np.ndarray
    total: np.ndarray
    place: np.ndarray
    sizes: np.ndarray

    @classmethod
    def of(cls, tables: list[pa.Table], by: list[str]) -> Counted:
        table = pa.concat_tables(tables)
        run, first = codes(table, [*by, "__w1"])
        second, sizes = lists(table["__w2"])
        n, _ = lists(table["__n"])
        coded = second.dictionary_encode(null_encoding="encode")
        size = max(len(coded.dictionary), 1)
        pairs, place = np.unique(np.repeat(run, sizes) * size + numbers(coded.indices), return_inverse=True)
        place = place.reshape(-1)
        sums = np.bincount(place, numbers(n), len(pairs)).astype(np.int64)  # exact: far below 2 ** 53
        head = pairs // size
        total = np.bincount(head, sums, len(first)).astype(np.int64)
        return cls(table, run, first, head, coded.dictionary.take(pa.array(pairs % size)), sums, total, place, sizes)

    def frequencies(self, by: list[str]) -> pa.Table:
        """(by, r, n_r): how many bigrams of each group occur r times."""
        group, rows = codes(self.table, by)
        size = int(self.n.max(initial=0)) + 1
        levels, n_r = np.unique(group[self.first[self.head]] * size + self.n, return_counts=True)
        return pa.table({k: self.table[k].take(pa.array(rows[levels // size])) for k in by} | {"r": pa.array(levels % size), "n_r": pa.array(n_r.astype(np.int64))})


def of_buckets(batches):
    """(batches, tables) of the buckets of a task, which are no more than one."""
    held = [b for b in batches if b.num_rows]
    if held:
        table = pa.Table.from_batches(held)
        yield table, opened(table["__data"])


def counter(by: list[str]):
    """A function of a bucket: (by, w1, w2, n, total of the first word)."""

    @trimmed
    def run(batches):
        for _, tables in of_buckets(batches):
            c = Counted.of(tables, by)
            for a in range(0, len(c.head), ROWS):
                r = c.head[a : a + ROWS]
                at = pa.array(c.first[r])
                out = {k: c.table[k].take(at) for k in by} | {"w1": c.table["__w1"].take(at), "w2": c.w2.slice(a, ROWS), "n": pa.array(c.n[a : a + ROWS]), "total": pa.array(c.total[r])}
                yield from pa.table(out).combine_chunks().to_batches()

    return run


def buckets_for(df: DataFrame, words: int) -> int:
    """Buckets for so many words."""
    session = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, -(-words // PART), min(session, -(-words // LEAST)))


def gathered(packed: DataFrame, buckets: int) -> DataFrame:
    """A bucket a partition."""
    return packed.repartitionById(buckets, F.col("__bucket"))


def pair_counts(posts: DataFrame, by: list[str], words: str, outside: Outside, n: int) -> DataFrame:
    """(by, w1, w2, n, total): how often each bigram occurs in each group and how often its first word is followed; n: about how many words there are."""
    buckets = buckets_for(posts, n)
    packed = posts.select(*by, words).mapInArrow(packer(by, words, outside, buckets), PACKED)
    return gathered(packed, buckets).mapInArrow(counter(by), ", ".join([*fields(posts, by), "w1 string", "w2 string", "n long", "total long"]))


def summed(frequencies: DataFrame, by: list[str]) -> DataFrame:
    return frequencies.groupBy(*by, "r").agg(F.sum("n_r").alias("n_r"))


def frequencies(posts: DataFrame, by: list[str], words: str, outside: Outside, n: int) -> DataFrame:
    """(by, r, n_r): how many bigrams occur r times in each group; no bigram leaves the task that counts it."""

    @trimmed
    def run(batches):
        for _, tables in of_buckets(batches):
            yield from Counted.of(tables, by).frequencies(by).combine_chunks().to_batches(ROWS)

    buckets = buckets_for(posts, n)
    packed = posts.select(*by, words).mapInArrow(packer(by, words, outside, buckets), PACKED)
    return summed(gathered(packed, buckets).mapInArrow(run, ", ".join([*fields(posts, by), "r long", "n_r long"])), by)


def kept(posts: DataFrame, by: list[str], key: str, words: str, outside: Outside, n: int) -> DataFrame:
    """What packer() makes of posts and their keys, to be stored."""
    return posts.select(*by, key, words).mapInArrow(packer(by, words, outside, buckets_for(posts, n), key), PACKED)


def answers(stored: DataFrame, by: list[str], n: int) -> DataFrame:
    """Of kept(): for each table of bigrams their counts in their group and those of their first words (__kind 0); of each bucket its frequencies (3)."""

    @trimmed
    def run(batches):
        for table, tables in of_buckets(batches):
            c = Counted.of(tables, by)
            offsets = np.concatenate([[0], np.cumsum(c.sizes)])
            counts = pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), pa.array(c.n[c.place]))
            out = pa.table({k: c.table[k] for k in by} | {"__total": pa.array(c.total[c.run]), "__n": counts})
            at = 0
            for chunk, bucket, t in zip(table["__chunk"].to_pylist(), table["__bucket"].to_pylist(), tables, strict=True):
                yield rows(0, chunk, [bucket], [sealed(out.slice(at, t.num_rows).combine_chunks())])
                at += t.num_rows
            yield rows(3, 0, [0], [sealed(c.frequencies(by))])

    return gathered(stored.where("__kind = 0"), buckets_for(stored, n)).mapInArrow(run, PACKED)


def answered_frequencies(answered: DataFrame, by: list[str], keys: list[str]) -> DataFrame:
    """(by, r, n_r) of answers(); keys: the fields of by."""

    def run(batches):
        for batch in batches:
            for t in opened(batch.column("__data")):
                yield from t.combine_chunks().to_batches(ROWS)

    return summed(answered.where("__kind = 3").mapInArrow(run, ", ".join([*keys, "r long", "n_r long"])), by)


def whole_chunks(batches):
    """A table for each chunk, from batches sorted by chunk."""
    held = []
    for batch in batches:
        number = numbers(batch.column("__chunk"))
        cuts = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a == b:
                continue
            if held and held[-1].column("__chunk")[0].as_py() != number[a]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def bits(prob: np.ndarray, log: str) -> np.ndarray:
    """Minus the logarithm; nothing of what has none."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(prob > 0, -(np.log2(prob) if log == "log2" else np.log(prob)), 0.0)


def scored(stored: DataFrame, answered: DataFrame, by: list[str], fields: list[str], discounts: DataFrame, n: int, log: str = "log2") -> DataFrame:
    """(by, __key, n_bigrams, n_words, raw) of the posts in kept() whose group is in discounts(by, r, d), a small table; fields: those of by and the key."""
    table = discounts.select(*by, "r", "d").toArrow()
    number, first = codes(table, by)
    r, d = numbers(table["r"]), numbers(table["d"])
    known = {}
    for i, k in enumerate(keys_of(table, by, first)):
        at = np.flatnonzero(number == i)
        at = at[np.argsort(r[at])]
        known[k] = r[at], d[at]

    @trimmed
    def run(batches):
        for table in whole_chunks(batches):
            kind = combined(table["__kind"])
            asked, posts, places = (opened(table.filter(pc.equal(kind, k))["__data"]) for k in (0, 1, 2))
            posts = posts[0]
            place = numbers(places[0]["__place"])
            place = np.ascontiguousarray(place.reshape(4, -1).T).view(np.uint32).reshape(-1)
            value = np.zeros(0)
            if asked:
                asked = pa.concat_tables(asked)
                counts, sizes = lists(asked["__n"])
                counts, total = numbers(counts), np.repeat(numbers(asked["__total"]), sizes)
                group, first = codes(asked, by)
                group, value = np.repeat(group, sizes), np.zeros(len(counts))
                for i, k in enumerate(keys_of(asked, by, first)):
                    if k in known:
                        mine = np.flatnonzero(group == i)
                        value[mine] = bits(known[k][1][np.searchsorted(known[k][0], counts[mine])] * (counts[mine] / total[mine]), log)
            if len(value) != (int(place.max()) + 1 if len(place) else 0):
                raise ValueError("bigrams of a chunk are missing")
            sizes = np.maximum(numbers(posts["__size"]) - 1, 0)
            raw = np.bincount(np.repeat(np.arange(len(sizes)), sizes), value[place], len(sizes))
            group, first = codes(posts, by)
            good = np.array([k in known for k in keys_of(posts, by, first)], bool)[group]
            out = {c: posts[c] for c in by} | {"__key": posts["__key"], "n_bigrams": pa.array(sizes), "n_words": posts["__size"], "raw": pa.array(raw)}
            yield from pa.table(out).filter(pa.array(good)).combine_chunks().to_batches(ROWS)

    together = answered.where("__kind = 0").unionByName(stored.where("__kind > 0")).repartition(buckets_for(stored, n), "__chunk")
    return together.sortWithinPartitions("__chunk", "__kind", "__bucket").mapInArrow(run, ", ".join([*fields, "n_bigrams long", "n_words long", "raw double"]))


@dataclass
class Held:
    """A group's model in arrays: its words with their back-off weights and probabilities, and its bigrams w1 * len(words) + w2, sorted, with theirs."""

    words: pa.Array
    alpha: np.ndarray
    p_u: np.ndarray
    pairs: np.ndarray
    p: np.ndarray

    def bits(self, w: Words, mine: np.ndarray, log: str) -> np.ndarray:
        """Of the bigrams of a chunk at some places."""
        at = pc.index_in(combined(w.names).cast(pa.large_string()), value_set=self.words)
        unknown = pc.index_in(pa.array([UNKNOWN], pa.large_string()), value_set=self.words)[0].as_py()
        at = pc.fill_null(at, unknown).to_numpy(zero_copy_only=False).astype(np.int64)
        a, b = at[w.w1[mine]], at[w.w2[mine]]
        key = a * len(self.words) + b
        if not len(self.pairs):
            return bits(self.alpha[a] * self.p_u[b], log)
        i = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return bits(np.where(self.pairs[i] == key, self.p[i], self.alpha[a] * self.p_u[b]), log)


def held(bigrams: pa.Table, unigrams: pa.Table, alphas: pa.Table, by: list[str]) -> dict[tuple, Held]:
    """The models of all groups, from bigrams(by, w1, w2, p), unigrams(by, w, p) and alphas(by, w1, alpha)."""

    def split(table):
        number, first = codes(table, by)
        return {k: table.take(pa.array(np.flatnonzero(number == i))).combine_chunks() for i, k in enumerate(keys_of(table, by, first))}

    of, us, as_ = split(bigrams), split(unigrams), split(alphas)
    text = lambda t, c: combined(t[c]).cast(pa.large_string())
    real = lambda t, c: combined(t[c]).to_numpy(zero_copy_only=False)
    out = {}
    for k, u in us.items():
        words = text(u, "w")
        number = lambda t, c: pc.index_in(text(t, c), value_set=words).to_numpy(zero_copy_only=False).astype(np.int64)  # noqa: B023, E731
        alpha = np.zeros(len(words))
        alpha[number(as_[k], "w1")] = real(as_[k], "alpha")
        t = of.get(k, bigrams.slice(0, 0))
        pairs = number(t, "w1") * len(words) + number(t, "w2")
        order = np.argsort(pairs)
        out[k] = Held(words, alpha, real(u, "p"), pairs[order], real(t, "p")[order])
    return out


def looked_up(posts: DataFrame, by: list[str], targets: list[list[str]], key: str, words: str, models: dict[tuple, Held], log: str = "log2") -> DataFrame:
    """(by, key, n_bigrams, raw): posts under the models that each of the targets names, a column for each of by; none for those without a model. Nothing is shuffled."""

    @trimmed
    def run(batches):
        for table in chunks(batches, words):
            w = Words.of(table, words)
            sizes = np.maximum(w.lengths - 1, 0)
            for columns in targets:
                group, first = codes(table, columns)
                here, raw, good = group[w.post], np.zeros(len(sizes)), np.zeros(len(sizes), bool)
                for i, k in enumerate(keys_of(table, columns, first)):
                    if k in models:
                        good |= group == i
                        mine = np.flatnonzero(here == i)
                        raw += np.bincount(w.post[mine], models[k].bits(w, mine, log), len(sizes))
                out = {k: table[c] for k, c in zip(by, columns, strict=True)} | {key: table[key], "n_bigrams": pa.array(sizes), "raw": pa.array(raw)}
                yield from pa.table(out).filter(pa.array(good)).combine_chunks().to_batches(ROWS)

    columns = list(dict.fromkeys([c for t in targets for c in t] + [key, words]))
    kinds = dict(posts.dtypes)
    schema = [f"`{k}` {kinds[c]}" for k, c in zip(by, targets[0], strict=True)]
    return posts.select(*columns).mapInArrow(run, ", ".join([*schema, *fields(posts, [key]), "n_bigrams long", "raw double"]))
