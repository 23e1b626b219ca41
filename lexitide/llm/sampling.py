"""Sampled segmentations over a SentencePiece vocabulary, and their lossless decoding.

All segmentations of a text form a lattice of pieces; characters that are no piece go as their UTF-8
bytes. A forward pass sums the weights of all ways to each position, a backward pass draws one way in
proportion to its weight. Draws come from a hash of (seed, row key, unit, step), so a row gets the same
segmentation on any cluster, in any batch, after any retry.

The vocabulary is only read. Its BPE scores are merge ranks, so a piece of rank r weighs
1 / (r + 2.7), Zipf's law; ``sharpness`` is an exponent on the weights (0 draws evenly over all ways, large values tend to the
best one). No piece holds a space after another character, or a line end, so the lattice falls apart
into units at those places; distributions of common units are kept, and all units of a slice of
documents are drawn together, one vectorised step per piece.

Spaces stand for the vocabulary's word mark and nothing is added or normalised: decoding joins pieces and bytes
and gives back the very text, also where it holds the word mark itself.

Defined cases: null texts give null ids, empty ones an empty array; null keys draw as one fixed key;
repeated rows give equal rows; very long texts are taken whole; an empty table gives an empty
result; further columns are not read.
"""

from __future__ import annotations

import math
import re
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexitide.llm.common import splitmix

MARK = "▁"
SEED, SHARPNESS = 7, 1.0
#: Arcs of unit lattices that a worker keeps, units drawn at a time, and new lattices built at a time.
ARCS, UNITS, NEW = 8_000_000, 1 << 18, 1 << 15
#: Bytes up to which lattices are built side by side, and natural log of the least weight their sums may reach.
SHARED, LEAST_LOG = 48, -600.0
_UNIT = re.compile(r"\n| *[^ \n]+| +")


class Lattice:
    """The pieces, and the backward distributions of the units met so far."""

    def __init__(self, model_file: str, sharpness: float = SHARPNESS):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.text: list[bytes] = []
        self.pieces: dict[str, tuple[int, float, float]] = {}  # id, log weight, weight
        self.bytes: dict[int, int] = {}
        n = sp.vocab_size()
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes[int(piece[1:-1], 16)] = i
                self.text.append(bytes([int(piece[1:-1], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i):
                self.text.append(b"")
            else:
                body = piece.replace(MARK, " ")
                self.text.append(body.encode())
                rank = -sp.get_score(i)
                weight = -sharpness * math.log((rank if 0 <= rank < n else n) + 2.7)
                self.pieces[body] = (i, weight, math.exp(weight))
        self.byte_ids = np.array([self.bytes.get(b, 0) for b in range(256)])
        if any(" " in p.lstrip(" ") or "\n" in p for p in self.pieces):
            raise ValueError("a piece crosses the places where units are cut")
        self._tree()
        self.sizes = np.array([len(t) for t in self.text])
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(self.text), np.uint8)
        self.byte_weight = -sharpness * math.log(n + 2.7)
        self.shared = min(SHARED, int(LEAST_LOG / self.byte_weight)) if self.byte_weight else SHARED
        self.clear()

    def _tree(self) -> None:
        """The pieces as a tree from their last characters: node * characters + character leads to a node, by open addressing."""
        chars = sorted({c for p in self.pieces for c in p})
        self.classes = np.zeros(0x110000, np.int32)  # 0: in no piece
        for i, c in enumerate(chars, 1):
            self.classes[ord(c)] = i
        index, self.width = {c: i for i, c in enumerate(chars, 1)}, len(chars) + 1
        steps: dict[int, int] = {}
        ends, weights = [-1], [0.0]
        self.tails: dict = {}
        for body, got in self.pieces.items():
            at, branch = 0, self.tails
            for c in reversed(body):
                key = at * self.width + index[c]
                if key not in steps:
                    steps[key] = len(ends)
                    ends.append(-1)
                    weights.append(0.0)
                at = steps[key]
                found = branch.setdefault(c, [{}, None])
                branch = found[0]
            found[1] = got
            ends[at], weights[at] = got[0], got[2]
        self.piece_at, self.weight_at = np.array(ends, np.int32), np.array(weights)
        self.bits = max(4, (4 * len(steps)).bit_length())
        self.slots, self.leads = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32)
        keys, to = np.array(list(steps), np.int64), np.array(list(steps.values()), np.int32)
        at = self._slot(keys)
        while len(keys):
            free = self.slots[at] < 0
            self.slots[at[free]] = keys[free]  # of several the last one gets the slot
            in_ = self.slots[at] == keys
            self.leads[at[in_]] = to[in_]
            keys, to, at = keys[~in_], to[~in_], (at[~in_] + 1) & ((1 << self.bits) - 1)
        self.root = self._step(np.zeros(self.width, np.int64), np.arange(self.width))
        self.single = np.concatenate(([False], self.piece_at[self.root[1:]] >= 0)) if self.width > 1 else np.zeros(1, bool)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _step(self, node: np.ndarray, char: np.ndarray) -> np.ndarray:
        """Where the tree leads from nodes by characters; 0 for nowhere."""
        keys = node * self.width + char
        at = self._slot(keys)
        got = self.slots[at]
        out = np.where(got == keys, self.leads[at], 0)
        left = np.flatnonzero((got != keys) & (got >= 0))
        while len(left):
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)
            got = self.slots[at[left]]
            hit = got == keys[left]
            out[left[hit]] = self.leads[at[left[hit]]]
            left = left[~hit & (got >= 0)]
        return out

    def clear(self) -> None:
        self.ends: dict[str, int] = {}
        # Arcs lie node by node; low is the share of a node's weight that its earlier arcs hold, last a node's last arc.
        self.low, self.prev, self.ids, self.last = np.empty(0), np.empty(0, np.int32), np.empty(0, np.int32), np.empty(0, np.int32)
        self.n_arcs = self.n_nodes = 0

    def nodes(self, units: list[str]) -> np.ndarray:
        """The node at each unit's end; nodes below 0 are begins, and arcs lead back to those."""
        get = self.ends.get
        at = np.fromiter(map(get, units, repeat(-2)), np.int64, len(units))
        new = np.flatnonzero(at == -2).tolist()
        if new:
            fresh = list(dict.fromkeys(units[i] for i in new))
            long = [u for u in fresh if 4 * len(u) > self.shared and self._is_long(u)]
            once = {}
            for u in long:
                once[u] = self._add(*self.build_long(u))[0]
            short = [u for u in fresh if u not in once] if long else fresh
            for a in range(0, len(short), NEW):
                part = short[a : a + NEW]
                self.ends.update(zip(part, self._add(*self.build_short(part)).tolist(), strict=True))
            at[new] = np.fromiter((once[u] if u in once else get(u) for u in map(units.__getitem__, new)), np.int64, len(new))
        return at

    def _is_long(self, unit: str) -> bool:
        return len(unit) > self.shared or (not unit.isascii() and len(unit.encode("utf-8", "surrogatepass")) > self.shared)

    def _add(self, low: np.ndarray, prev: np.ndarray, ids: np.ndarray, arcs: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Appends nodes with so many arcs each, numbered from 0 among themselves; the numbers that ends have now."""
        base, offset, n, m = self.n_nodes, self.n_arcs, len(arcs), len(low)
        self.low = _room(self.low, offset, m)
        self.prev = _room(self.prev, offset, m)
        self.ids = _room(self.ids, offset, m)
        self.last = _room(self.last, base, n)
        self.low[offset : offset + m] = low
        self.prev[offset : offset + m] = np.where(prev < 0, -1, prev + base)
        self.ids[offset : offset + m] = ids
        self.last[base : base + n] = offset - 1 + np.cumsum(arcs)
        self.n_nodes, self.n_arcs = base + n, offset + m
        return ends + base

    def build_short(self, units: list[str]) -> tuple[np.ndarray, ...]:
        """All lattices side by side: pieces are found backwards from every character, weights summed place by place."""
        size = np.array([len(u) for u in units])
        code = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32)
        char, n, stop = self.classes[code], len(code), np.cumsum(size)
        place = np.arange(n) - np.repeat(stop - size, size)
        # Characters that are no piece have a node after each of their bytes but the last, and an arc for every byte.
        plain = np.flatnonzero(~self.single[char])
        width = np.zeros(n, np.int64)
        c = code[plain].astype(np.int64)
        width[plain] = 1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000)
        node = np.cumsum(np.maximum(width, 1)) - 1
        found = [(plain, np.zeros(len(plain), np.int64))]
        at, state = np.arange(n), self.root[char].astype(np.int64)
        for length in range(1, int(size.max(initial=0)) + 1):
            on = state > 0
            at, state = at[on], state[on]
            if not len(at):
                break
            is_piece = self.piece_at[state] >= 0
            found.append((at[is_piece], state[is_piece]))
            more = place[at] >= length
            at, state = at[more], state[more]
            state = self._step(state, char[at - length]).astype(np.int64)
        length = np.repeat(np.arange(len(found)), [len(f[0]) for f in found])
        at, state = (np.concatenate(x) for x in zip(*found, strict=True))
        arcs = np.ones(node[-1] + 1 if n else 0, np.int64)
        arcs[node] = np.bincount(at, minlength=n)
        first = np.cumsum(arcs) - arcs
        low, prev, ids = np.zeros(len(at) + len(arcs) - n), np.empty(len(at) + len(arcs) - n, np.int64), np.empty(len(at) + len(arcs) - n, np.int64)
        order = np.argsort((place[at] * 64 + length).astype(np.uint16), kind="stable")  # by place, then by length, so later arcs are longer pieces
        at, state, length = at[order], state[order], length[order]
        start = at - np.maximum(length, 1)
        begins = place[at] < np.maximum(length, 1)
        prev_node = np.where(begins, -1, node[start])
        weight = np.where(length > 0, self.weight_at[state], math.exp(self.byte_weight) ** width[at])
        total, rank, before = np.zeros(n), np.zeros(n, np.int64), np.empty(len(at))
        slot = np.empty(len(at), np.int64)
        edges = np.flatnonzero(np.diff(place[at] * 64 + length, prepend=-1, append=-1)) if len(at) else np.zeros(1, np.int64)
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            e = at[a:b]
            before[a:b], slot[a:b] = total[e], rank[e]
            total[e] += weight[a:b] if begins[a] else weight[a:b] * total[start[a:b]]
            rank[e] += 1
        slot += first[node[at]]
        low[slot], prev[slot], ids[slot] = before / total[at], prev_node, self.piece_at[state]
        w = width[plain]
        before_char = np.where(place[plain] == 0, -1, node[plain - 1])
        for k in range(4):  # the arcs of bytes
            of = np.flatnonzero(w > k)
            lead = np.array([0, 0, 0xC0, 0xE0, 0xF0])[w[of]] | (c[of] >> 6 * (w[of] - 1)) if k == 0 else 0x80 | ((c[of] >> 6 * (w[of] - 1 - k)) & 0x3F)
            where = first[node[plain[of]] - w[of] + 1 + k]
            prev[where] = before_char[of] if k == 0 else node[plain[of]] - w[of] + k
            ids[where] = self.byte_ids[lead]
        return low, prev, ids, arcs, node[stop - 1]

    def build_long(self, unit: str) -> tuple[np.ndarray, ...]:
        """The same in logs, which no length exhausts."""
        alpha, at = [], [-1] * (len(unit) + 1)
        low, prev, ids, arcs = [], [], [], []
        for j in range(1, len(unit) + 1):
            ways = []
            i, branch = j - 1, self.tails.get(unit[j - 1])
            if branch is None or branch[1] is None:
                back = at[j - 1]
                here = alpha[back] if back >= 0 else 0.0
                data = unit[j - 1].encode("utf-8", "surrogatepass")
                for b in data[:-1]:
                    here += self.byte_weight
                    low.append(0.0)
                    prev.append(back)
                    ids.append(self.bytes[b])
                    arcs.append(1)
                    back = len(alpha)
                    alpha.append(here)
                ways.append((here + self.byte_weight, back, self.bytes[data[-1]]))
            while branch is not None:
                got = branch[1]
                if got is not None:
                    back = at[i]
                    ways.append((got[1] + alpha[back] if back >= 0 else got[1], back, got[0]))
                i -= 1
                if i < 0:
                    break
                branch = branch[0].get(unit[i])
            top = max(ways)[0]
            weights = [math.exp(a[0] - top) for a in ways]
            total, run = sum(weights), 0.0
            for w, (_, back, piece) in zip(weights, ways, strict=True):
                low.append(run / total)
                prev.append(back)
                ids.append(piece)
                run += w
            arcs.append(len(ways))
            at[j] = len(alpha)
            alpha.append(top + math.log(total))
        return np.array(low), np.array(prev), np.array(ids), np.array(arcs), np.array([at[-1]])

    def choose(self, node: np.ndarray, u: np.ndarray) -> np.ndarray:
        """The arc of each node that u in [0, 1) falls on. Only the node's own shares are compared, wherever its arcs lie."""
        arc = self.last[node].astype(np.int64)
        back = np.flatnonzero(u < self.low[arc])
        while len(back):  # longer pieces, which are likelier, come last
            arc[back] -= 1
            back = back[u[back] < self.low[arc[back]]]
        return arc

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        """The text of ids joined, as bytes."""
        size = self.sizes[ids]
        ends = np.cumsum(size)
        return self.flat[np.repeat(self.starts[ids] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]


def _room(x: np.ndarray, used: int, more: int) -> np.ndarray:
    """x if it has room for more beyond what is used, else a copy of twice that."""
    if used + more <= len(x):
        return x
    out = np.empty(2 * (used + more), x.dtype)
    out[:used] = x[:used]
    return out


def _uniform(seed: np.ndarray, step: int) -> np.ndarray:
    x = splitmix(seed + np.uint64(step * 0xD1342543DE82EF95 & (1 << 64) - 1))
    return (x >> np.uint64(11)).astype(np.float64) / (1 << 53)


def draw(lattice: Lattice, texts: list[str], keys: list, seed: int = SEED) -> list[np.ndarray]:
    """A segmentation of each text, as piece ids."""
    if lattice.n_arcs > ARCS:
        lattice.clear()
    units, counts = [], []
    for text in texts:
        found = _UNIT.findall(text)
        counts.append(len(found))
        units += found
    node = lattice.nodes(units)
    counts = np.array(counts, int)
    first = np.concatenate(([0], np.cumsum(counts)))
    rows = np.array([xxhash.xxh64_intdigest(str(k), seed) for k in keys], np.uint64)
    order = np.arange(first[-1]) - np.repeat(first[:-1], counts)
    seeds = splitmix(np.repeat(rows, counts) + order.astype(np.uint64))
    live, steps = np.arange(first[-1]), []
    pieces = np.zeros(first[-1], np.int64)
    while len(live):
        arc = lattice.choose(node, _uniform(seeds, len(steps)))
        steps.append((live, lattice.ids[arc]))
        pieces[live] += 1
        node = lattice.prev[arc]
        on = np.flatnonzero(node >= 0)
        live, node, seeds = live[on], node[on], seeds[on]
    start = np.concatenate(([0], np.cumsum(pieces)))
    out = np.empty(start[-1], np.int32)
    for s, (who, ids) in enumerate(steps):
        out[start[who + 1] - 1 - s] = ids
    edges = start[first]
    return [out[a:b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]


def decode(lattice: Lattice, ids) -> str:
    return b"".join(map(lattice.text.__getitem__, ids)).decode("utf-8", "surrogatepass")


def lossless(lattice: Lattice, flat: np.ndarray, rows: list[np.ndarray], texts: list[str | None]) -> list[bool | None]:
    """Whether each row's ids decode to its text; flat is the rows joined. All hold if the whole is equal and the rows end at the same bytes."""
    want = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    done = np.concatenate(([0], np.cumsum(lattice.sizes[flat])))
    ends = done[np.cumsum([len(r) for r in rows])] if rows else done[:0]
    if (ends == np.cumsum([len(w) for w in want])).all() and lattice.bytes_of(flat).tobytes() == b"".join(want):
        return [None if t is None else True for t in texts]
    return [None if t is None else decode(lattice, g.tolist()) == t for t, g in zip(texts, rows, strict=True)]


_lattices: dict = {}


def lattice(model_file: str, sharpness: float) -> Lattice:
    if (model_file, sharpness) not in _lattices:
        _lattices[model_file, sharpness] = Lattice(model_file, sharpness)
    return _lattices[model_file, sharpness]


def _encode(model_file: str, sharpness: float, seed: int):
    def run(batches):
        lat = lattice(model_file, sharpness)
        for batch in batches:
            keys, texts, at = batch.column(0).to_pylist(), batch.column(1), 0
            while at < batch.num_rows:
                begin, size, part = at, 0, []
                while at < batch.num_rows and size < 4 * UNITS:
                    part.append(texts[at].as_py())
                    size += len(part[-1] or "")
                    at += 1
                got = draw(lat, [t or "" for t in part], keys[begin:at], seed)
                sizes = np.array([len(g) for g in got])
                flat = np.concatenate(got) if got else np.empty(0, np.int32)
                same = lossless(lat, flat, got, part)
                offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32), mask=np.array([*(t is None for t in part), False]))
                yield pa.RecordBatch.from_arrays([pa.array(keys[begin:at], pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(flat)), pa.array([None if t is None else len(g) for t, g in zip(part, got, strict=True)], pa.int64()), pa.array(same, pa.bool_())], ["doc_id", "ids", "n_pieces", "lossless"])

    return run


def public_model() -> str:
    import public_tokenizers as public

    return public.path("piece_bpe_32k.model")


def sample(docs: DataFrame, model_file: str | None = None, sharpness: float = SHARPNESS, seed: int = SEED) -> DataFrame:
    """doc_id, ids (a sampled segmentation), n_pieces, and lossless (whether decoding gave the text back) for docs(doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_encode(model_file or public_model(), sharpness, seed), "doc_id long, ids array<int>, n_pieces long, lossless boolean")


def _decode(model_file: str):
    def run(batches):
        lat = lattice(model_file, SHARPNESS)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if x is None else decode(lat, x) for x in batch.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return run


def decoded(ids: DataFrame, model_file: str | None = None) -> DataFrame:
    """doc_id and text for ids(doc_id, ids)."""
    return ids.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(_decode(model_file or public_model()), "doc_id long, text string")


def op9(spark, sf_dir: str) -> DataFrame:
    return sample(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


QUERIES = {"op9_piece_sampling": op9}
ORACLES: dict[str, str] = {}
