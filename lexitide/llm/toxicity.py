"""Toxicity scores: a learned lexicon in a trie, met by a Levenshtein automaton, weighed in context.

1. Lexicon. Words and word beginnings (stems) are counted over all toxic and clean training texts. What
   is PURE enough and whose count chance does not explain (a likelihood ratio of GAIN, whatever the size
   of the corpus, so more data teach rarer terms) is a candidate; the TERMS of most gain are kept, which
   bounds what reaches the driver and the workers. Copies of one toxic text make all its rare words look
   pure, so candidates are counted again by the pair of neighbours they stand between, one pair a text,
   equal ones once, and have to reach GAIN with that count too. What is left becomes a term with its log
   odds as weight.
2. Matching. The trie of terms and an automaton of one edit are run together, as one automaton whose
   states are sets of (trie node, edits), made when first met. A word leaves it after a few letters
   unless it is within one edit of a term. Terms of under FUZZY letters match exactly only.
3. Context. Each hit is scored in a window of tokens: quotation marks and reporting words near it
   speak for quotation, further hits and words of address for abuse.
4. A logistic model over sums of these scores is fitted on at most ROWS labelled training texts.

Labels are the only thing taken from other columns. Defined cases: null and empty texts get the score
of a text without hits; rows with a null label or doc_id train nothing; without training rows of both
labels every score is 0; very long texts are taken whole; repeated rows give equal rows; an empty
table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexitide.llm.common import Scratch, broadcast_if_small
from lexitide.llm.language import fold

#: Least likelihood ratio (G squared, one degree of freedom) of a term, and most terms.
GAIN, TERMS = 24.0, 20_000
#: Candidates up to which clean texts are counted for these only; beyond it all terms of clean texts are counted and joined.
KNOWN = 200_000
#: Least probability, at equal priors, that a text with the term is toxic.
PURE = 0.95
STEM = range(4, 8)
FUZZY = 5
#: Tokens on either side that belong to a hit's context.
WINDOW = 6
#: The most labelled rows the logistic model is fitted on.
ROWS = 20_000

_STRIP = " \t\n\r\x0b\x0c.,;:!?\"'`()[]{}<>#$%&*|/\\~^_+=-«»“”‘’„…"
_QUOTES = frozenset("\"«»“”„")
_REPORT = frozenset("said says wrote writes quote quoted quotes called calls reported according dijo dice escribió según dit écrit selon cité sagte sagt schrieb laut zitiert".split())
_ADDRESS = frozenset("you your you're u du dich dir ihr tu te toi vous tú usted".split())


def bare(token: str) -> str:
    return token.strip(_STRIP)


def words(text: str) -> set[str]:
    return {w for w in map(bare, set(text.lower().split())) if w}


def terms_of(text: str) -> set[str]:
    """Words, and word beginnings followed by *, that a text holds."""
    w = words(text)
    return w | {f"{x[:n]}*" for x in w for n in STEM if len(x) > n}


def _emit(n: Counter):
    return pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], ["term", "n"])


def _count(known):
    def run(batches):
        n: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                t = terms_of(text or "")
                n.update(t if known is None else t & known.value)
            if len(n) > 300_000:
                yield _emit(n)
                n = Counter()
        if n:
            yield _emit(n)

    return run


def _document_counts(texts: DataFrame, known=None) -> DataFrame:
    return texts.mapInArrow(_count(known), "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def contexts(text: str, known) -> dict[str, int]:
    """For each known word or stem of a text the least hash of the words on both its sides: copies of a text have the same ones."""
    w = [x for x in map(bare, text.lower().split()) if x]
    out: dict[str, int] = {}
    for i, x in enumerate(w):
        found = [t for t in (x, *(f"{x[:n]}*" for n in STEM if len(x) > n)) if t in known]
        if found:
            sides = xxhash.xxh3_64_intdigest(f"{w[i - 1] if i else ''} {w[i + 1] if i + 1 < len(w) else ''}") - (1 << 63)
            for t in found:
                out[t] = min(out.get(t, sides), sides)
    return out


def _contexts(known):
    def run(batches):
        for batch in batches:
            rows = [r for t in batch.column(0).to_pylist() for r in contexts(t or "", known.value).items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64())], ["term", "sides"])

    return run


def gain(a, b, n, m):
    """Columns: the likelihood ratio of a of n toxic texts and b of m clean ones against one common share."""
    term = lambda k, e: F.when(k > 0, k * F.ln(k / e)).otherwise(0.0)
    both, share = a + b, n / (n + m)
    rest = n + m - both
    return 2 * (term(a, both * share) + term(b, both * (1 - share)) + term(n - a, rest * share) + term(m - b, rest * (1 - share)))


def least_support(n_toxic: int, n_clean: int) -> int:
    """The fewest toxic texts, with no clean one, that can reach GAIN: 2 k ln(all / toxic) is the most that k texts can."""
    return max(2, math.ceil(GAIN / (2 * math.log((n_toxic + n_clean) / n_toxic))))


def choose_terms(toxic: dict[str, int], clean: dict[str, int], n_toxic: int, n_clean: int) -> dict[str, float]:
    """Pure terms with their log odds. A stem replaces words only if it reaches half as many texts again as each of them; longer stems fall to shorter."""
    odds = lambda t: math.log((toxic[t] + 0.5) / (n_toxic + 1)) - math.log((clean.get(t, 0) + 0.5) / (n_clean + 1))
    limit = math.log(PURE / (1 - PURE))
    pure = {t: odds(t) for t in toxic if odds(t) >= limit}
    out: dict[str, float] = {}
    stems = sorted((t for t in pure if t[-1] == "*"), key=lambda t: (len(t), t))
    plain = [t for t in pure if t[-1] != "*"]
    best: dict[str, int] = {}
    for w in plain:
        for n in STEM:
            if len(w) >= n:
                best[f"{w[:n]}*"] = max(best.get(f"{w[:n]}*", 0), toxic[w])
    for s in stems:
        covered = any(f"{s[:n]}*" in out for n in STEM if n < len(s) - 1)
        if not covered and toxic[s] >= 1.5 * best.get(s, 0):
            out[s] = pure[s]
    for w in plain:
        if not any(f"{w[:n]}*" in out for n in STEM if n < len(w)):
            out[w] = pure[w]
    return out


class Automaton:
    """The words within one edit of a term, by sets of (trie node, edits so far); states are made when first met."""

    def __init__(self, terms: dict[str, float]):
        self.next: list[dict[str, int]] = [{}]
        self.ends: list[str | None] = [None]  # the term that ends in a node
        self.long: list[bool] = [False]  # a term of FUZZY letters or more goes through the node
        for t in sorted(terms):
            stem = t[-1] == "*"
            body = t[:-1] if stem else t
            fuzzy = len(body) >= FUZZY + stem
            at = 0
            self.long[0] |= fuzzy
            for c in body:
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.ends.append(None)
                    self.long.append(False)
                at = self.next[at][c]
                self.long[at] |= fuzzy
            self.ends[at] = t
        self.states: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.start = self._state(self._close({(0, 0)}))

    def _fuzzy(self, term: str) -> bool:
        return len(term) - 2 * (term[-1] == "*") >= FUZZY

    def _close(self, s: set) -> frozenset:
        """Adds the states reached by leaving out letters of terms."""
        more = {(m, 1) for n, e in s if e == 0 for m in self.next[n].values() if self.long[m]}
        s = s | more
        return frozenset(x for x in s if x[1] == 0 or (x[0], 0) not in s)

    def _state(self, s: frozenset) -> int:
        if s not in self.states:
            self.states[s] = len(self.sets)
            self.sets.append(s)
            self.moves.append({})
        return self.states[s]

    def _step(self, state: int, c: str) -> int:
        new = set()
        for n, e in self.sets[state]:
            if c in self.next[n]:
                new.add((self.next[n][c], e))
            if e == 0 and self.long[n]:
                new.add((n, 1))  # a letter too many
                new.update((m, 1) for m in self.next[n].values() if self.long[m])  # a wrong letter
        got = self._state(self._close(new)) if new else -1
        self.moves[state][c] = got
        return got

    def match(self, word: str) -> tuple[str, int] | None:
        """(term, edits) of the nearest term, first by edits, then by name."""
        state, best = self.start, None
        for i, c in enumerate(word):
            got = self.moves[state].get(c)
            state = self._step(state, c) if got is None else got
            if state < 0:
                break
            for n, e in self.sets[state]:
                t = self.ends[n]
                if t and (t[-1] == "*" or i == len(word) - 1) and (e == 0 or self._fuzzy(t)) and (best is None or (e, t) < (best[1], best[0])):
                    best = (t, e)
        if len(self.sets) > 200_000:
            self.states, self.sets, self.moves = {}, [], []
            self.start = self._state(self._close({(0, 0)}))
        return best


class Matcher(dict):
    """Lower-cased token to None or (weight, edits), remembered."""

    def __init__(self, terms: dict[str, float]):
        super().__init__()
        self.terms, self.automaton = terms, Automaton(terms)

    def __missing__(self, token: str):
        w = bare(token)
        m = self.automaton.match(w) if w else None
        got = (self.terms[m[0]], m[1]) if m else None
        if len(self) > 300_000:
            self.clear()
        if len(token) < 64:
            self[token] = got
        return got


FEATURES = ("exact", "near", "quoted", "crowd", "address", "share", "none")


def features(text: str | None, matcher: Matcher) -> list[float]:
    """Sums over hits: exact ones, misspelled ones, quoted ones; hits close together, hits with address; their share; whether there is none."""
    tokens = (text or "").lower().split()
    found = list(map(matcher.__getitem__, tokens))
    hits = [i for i, f in enumerate(found) if f is not None]
    exact = near = quoted = crowd = address = 0.0
    for i in hits:
        weight, edits = found[i]
        window = tokens[max(0, i - WINDOW) : i + WINDOW + 1]
        cited = sum(any(q in t for q in _QUOTES) for t in window) >= 2 or any(bare(t) in _REPORT for t in window)
        if cited:
            quoted += 1
        elif edits:
            near += weight / 4
        else:
            exact += weight / 4
        crowd += sum(f is not None for f in found[max(0, i - WINDOW) : i + WINDOW + 1]) - 1
        address += any(bare(t) in _ADDRESS for t in window)
    log = math.log1p
    return [log(exact), log(near), log(quoted), log(crowd), log(address), len(hits) / max(20, len(tokens)) * 10, float(not hits)]


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic weights, intercept last, by Newton steps with a ridge on all but the intercept."""
    x = np.hstack((x, np.ones((len(x), 1))))
    w, lam = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    lam[-1] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(lam), x.T @ (y - p) - lam * w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _featured(terms):
    def run(batches):
        m = Matcher(terms.value)
        for batch in batches:
            x = [features(t, m) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(x, pa.list_(pa.float64()))], ["toxic", "x"])

    return run


def train(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> tuple[dict[str, float], np.ndarray | None]:
    """(terms, weights) from docs(doc_id, text) and labels(doc_id, toxic)."""
    spark = docs.sparkSession
    labels = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", F.col("toxic").cast("int").alias("toxic")).distinct()
    joined = docs.select("doc_id", "text").join(broadcast_if_small(labels, labels.count(), 64), "doc_id")
    n = {r["toxic"]: r["count"] for r in joined.where("toxic IN (0, 1)").groupBy("toxic").count().collect()}
    n_toxic, n_clean = n.get(1, 0), n.get(0, 0)
    if not n_toxic or not n_clean:
        return {}, None
    scratch = Scratch(spark, "toxicity")
    least = least_support(n_toxic, n_clean)
    toxic = scratch.save(_document_counts(joined.where("toxic = 1").select("text")).where(F.col("n") >= least), "toxic")
    n_terms, known = toxic.count(), None
    if n_terms <= KNOWN:
        known = spark.sparkContext.broadcast(frozenset(r["term"] for r in toxic.select("term").collect()))
    clean = _document_counts(joined.where("toxic = 0").select("text"), known).withColumnRenamed("n", "m")
    a, b, n, m = F.col("n").cast("double"), F.coalesce("m", F.lit(0)).cast("double"), F.lit(float(n_toxic)), F.lit(float(n_clean))
    pure = F.ln((a + 0.5) / (n + 1)) - F.ln((b + 0.5) / (m + 1)) >= math.log(PURE / (1 - PURE))
    ranked = toxic.join(clean, "term", "left").select("term", "n", b.cast("long").alias("m"), gain(a, b, n, m).alias("gain"), pure.alias("pure"))
    kept = scratch.save(ranked.where((F.col("gain") >= GAIN) & F.col("pure")).orderBy(F.desc("gain"), "term").limit(TERMS), "kept")
    known = spark.sparkContext.broadcast(frozenset(r["term"] for r in kept.select("term").collect()))
    sides = joined.where("toxic = 1").select("text").mapInArrow(_contexts(known), "term string, sides long").distinct().groupBy("term").agg(F.count("*").alias("k"))
    again = F.col("k").cast("double")
    kept = kept.join(sides, "term").where(gain(again, F.col("m").cast("double"), n, m) >= GAIN).select("term", "n", "m").collect()
    scratch.clear()
    terms = choose_terms({r["term"]: r["n"] for r in kept}, {r["term"]: r["m"] for r in kept}, n_toxic, n_clean)
    part = rows / (n_toxic + n_clean)
    some = joined.where("toxic IN (0, 1)")
    if part < 1:
        some = some.where((F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1_000_003)) / 1_000_003) < part)
    got = some.select("text", "toxic").mapInArrow(_featured(spark.sparkContext.broadcast(terms)), "toxic int, x array<double>").toArrow()
    if not got.num_rows:
        return terms, None
    order = np.argsort(got.column("toxic").to_numpy(), kind="stable")
    x, y = np.array(got.column("x").to_pylist(), float)[order], got.column("toxic").to_numpy()[order].astype(float)
    return terms, fit(x, y)


def _scored(model):
    def run(batches):
        terms, w = model.value
        m = Matcher(terms)
        for batch in batches:
            x = np.array([features(t, m) for t in batch.column(2).to_pylist()], float).reshape(-1, len(FEATURES))
            s = np.zeros(len(x)) if w is None else 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return run


def score(docs: DataFrame, model) -> DataFrame:
    """doc_id, held_out, score, predicted for docs(doc_id, text). The model holds a bounded lexicon and a few weights."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), fold().alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_scored(shared), "doc_id long, held_out boolean, score double, predicted int")


def op5(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score(docs, train(docs, labels.where(~fold())))


QUERIES = {"op5_toxicity": op5}
ORACLES: dict[str, str] = {}
