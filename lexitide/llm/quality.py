"""Quality rules: a threshold table compiled into one Spark projection, without user functions.

Base counts follow the contract of ``op8``; the rules below add ratios of word length, symbols, stop
words and lines. Every expression is linear in the text, or n log n for texts that repeat a window.

Defined cases: a null or empty text has no words and fails the base rule; very long texts are scored
whole; repeated rows and ties give equal rows; an empty table gives an empty result; further columns,
whatever their names, are left alone (``score`` reads the id and the text only, ``keep`` adds none).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD_SPACE = "[ \\x09-\\x0D]+"
SYMBOLS = "[#*$%&|<>]"
WINDOW = 5

#: The commonest function words of English, French, German and Spanish.
STOP_WORDS = sorted(
    set(
        "the of and to in a is that for on with as was it be by this at from are or an not have has he she they we you his her its but which "
        "de la que el y los las del un una se por con no su para es al lo como más pero sus le ya o este porque esta son "
        "les des et une du dans est pour qui sur pas au plus par avec ce il elle sont ne ou mais nous vous leur son ses "
        "der die das und ist nicht ein eine mit auf von zu den im für dem des sich als auch an werden aus er hat dass sie nach wird bei".split()
    )
)


@dataclass(frozen=True)
class Rule:
    """A document fails if it has min_words words or more and its metric lies outside [low, high]."""

    name: str
    metric: str
    low: float | None = None
    high: float | None = None
    min_words: int = 0


#: Metrics are SQL over the base counts and n_stop, n_lines.
RULES = (
    Rule("mean_word_length", "word_chars / n_words", low=2.5, high=12.0),
    Rule("symbol_ratio", "n_symbols / n_words", high=0.1),
    Rule("stop_word_ratio", "n_stop / n_words", low=0.06, min_words=20),
    Rule("duplicate_line_ratio", "n_dup_lines / n_lines", high=0.4),
)


def _let(value: Column, body) -> Column:
    """Evaluates value once per row and hands it to body, also where body refers to it inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeated_words(words: Column) -> Column:
    """Words inside a window of five that the text holds twice or more.

    Windows are compared by 64-bit hashes. Texts whose windows all differ (nearly all) stop after one
    hash set; others sort (hash, position), keep the positions of equal neighbours and sum the gaps.
    """
    hashes = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(WINDOW))))

    def covered(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        same = lambda p, e, j: F.coalesce(F.get(p, j)["h"] == e["h"], F.lit(False))
        twice = _let(pairs, lambda p: F.filter(p, lambda e, k: same(p, e, k + 1) | same(p, e, k - 1)))
        places = F.sort_array(F.transform(twice, lambda e: e["i"]))
        gaps = _let(places, lambda q: F.transform(q, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(q, k + 1) - x, F.lit(WINDOW)))))
        return F.aggregate(gaps, F.lit(0), lambda a, g: a + g)

    counted = _let(hashes(words), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(covered(h)))
    return F.when(F.size(words) < WINDOW, 0).otherwise(counted)


def score(docs: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",), rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The keys, the base counts, a verdict per rule, base_failed and kept.

    The counts leave one generated row each. No filter moves below that, so one on kept or a count does
    not compute them once per mention.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    words = docs.select(
        *(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)),
        t.alias("__text"),
        F.filter(F.split(t, WORD_SPACE), lambda w: w != "").alias("__words"),
        F.filter(F.split(t, "\n"), lambda x: x.rlike("[^ \\x09-\\x0D]")).alias("__lines"),
    )
    w = F.col("__words")
    counted = F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        (F.length("__text") - F.length(F.regexp_replace("__text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        _repeated_words(w).cast("long").alias("n_repeat_words"),
        F.size("__lines").cast("long").alias("n_lines"),
        F.size(F.filter(w, lambda x: F.lower(x).isin(STOP_WORDS))).cast("long").alias("n_stop"),
    )
    counts = words.select(*(F.col(f"__k{i}").alias(k) for i, k in enumerate(keys)), F.inline(F.array(counted)))
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    tests = [_passes(r).alias(f"ok_{r.name}") for r in rules]
    kept = ~base
    for r in rules:
        kept = kept & _passes(r)
    return counts.select("*", base.alias("base_failed"), *tests, kept.alias("kept"))


def _passes(rule: Rule) -> Column:
    m, ok = F.expr(rule.metric.replace(" / ", " / nullif(") + ", 0)" if " / " in rule.metric else rule.metric), F.lit(True)
    if rule.low is not None:
        ok = ok & (m >= rule.low)
    if rule.high is not None:
        ok = ok & (m <= rule.high)
    return F.coalesce(ok, F.lit(False)) | (F.col("n_words") < rule.min_words)


def keep(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of docs that pass, with their columns; the projection runs in the scan's own tasks."""
    names = [f"__c{i}" for i in range(len(docs.columns))]
    scored = score(docs.toDF(*names), names[docs.columns.index(text)], tuple(names), rules)
    return scored.where("kept").select(*names).toDF(*docs.columns)


_STOP_SQL = ", ".join(f"'{w}'" for w in STOP_WORDS)
ORACLE_CTE = rf"""
op8_w AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
op8_g AS (
  SELECT doc_id, unnest(range(1, len(w) - 3)) AS i, w FROM op8_w WHERE len(w) >= 5),
op8_h AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS g FROM op8_g),
op8_r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM op8_h) WHERE n > 1),
op8_c AS (
  SELECT doc_id, sum(least(5, coalesce(nxt - i, 5)))::BIGINT AS n_repeat_words
  FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM op8_r) GROUP BY doc_id),
op8_b AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(length(array_to_string(w, '')), 0)::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(l)::BIGINT AS n_lines,
         len(list_filter(w, lambda x: lower(x) IN ({_STOP_SQL})))::BIGINT AS n_stop
  FROM op8_w LEFT JOIN op8_c USING (doc_id)),
op8_f AS (SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed FROM op8_b),
op8 AS (
  SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
         coalesce(NOT base_failed AND word_chars / n_words BETWEEN 2.5 AND 12 AND n_symbols / n_words <= 0.1
           AND (n_stop / n_words >= 0.06 OR n_words < 20) AND n_dup_lines / nullif(n_lines, 0) <= 0.4, false) AS kept
  FROM op8_f)
"""


def op8(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


QUERIES = {"op8_quality_rules": op8}
ORACLES = {"op8_quality_rules": f"WITH {ORACLE_CTE} SELECT * FROM op8"}
