"""Text expressions: cleaning, tokens, sentence padding, n-grams. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

START, STOP, UNKNOWN = "<s>", "</s>", "<UNK>"
#: Words, runs of sentence marks, single other marks. The classes mean the same in other regex dialects.
TOKEN = r"[\p{L}\p{N}_]+(?:['’][\p{L}\p{N}_]+)*|[.!?]+|[^\p{L}\p{N}_\s]"
URL = r"(?iU)\bhttps?\S+\b"
FULL = r"(?i)[^a-zA-Z\s]|\bhttps?\S+\b"


def join_lines(text: Column) -> Column:
    """Line ends go without a space, so the words beside them join."""
    return F.regexp_replace(text, "[\r\n]", "")


def clean(text: Column, mode: str = "urls_only") -> Column:
    """urls_only removes addresses; full keeps ASCII letters and white space; anything else changes nothing."""
    if mode == "urls_only":
        return F.regexp_replace(text, URL, "")
    return F.regexp_replace(text, FULL, "") if mode == "full" else text


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))


def padded(text: Column) -> Column:
    """Tokens with <s> and </s> around each sentence, flattened; a run of . ! ? ends a sentence.

    Tokens hold no white space and leave out nothing else, so two replacements put single spaces and
    pads between them and one split makes the array: no function runs per token.
    """
    t = F.coalesce(text, F.lit(""))
    apart = F.regexp_replace(t, rf"\s*({TOKEN})\s*", "$1 ")
    marked = F.regexp_replace(apart, r"(?<![^ ])([.!?]+) (?=\S)", f"$1 {STOP} {START} ")
    return F.when(t.rlike(r"\S"), F.split(F.concat(F.lit(f"{START} "), marked, F.lit(STOP)), " ")).otherwise(F.array().cast("array<string>"))


def sentences(text: Column) -> Column:
    """Nested form of padded(): one array of tokens per sentence, without pads."""
    joined = F.array_join(padded(text), "\x1f")
    return F.transform(
        F.filter(F.split(joined, f"{STOP}"), lambda s: s.contains(START)),
        lambda s: F.split(F.regexp_replace(s, f"^\x1f?{START}\x1f|\x1f$", ""), "\x1f"),
    )


def bigrams(words: Column) -> Column:
    """Adjacent pairs as structs (w1, w2); none for fewer than two words."""
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.arrays_zip(F.slice(words, 1, n), F.slice(words, 2, n)).cast("array<struct<w1:string,w2:string>>")


def truncated(words: Column, max_len: int) -> Column:
    return F.slice(words, 1, max_len)


def uid_of(*values: Column, length: int = 8) -> Column:
    """A short identifier of what is given: the same for the same values."""
    return F.substring(F.md5(F.concat_ws(":", *(v.cast("string") for v in values))), 1, length)


def new_uid(length: int = 8) -> str:
    """A random identifier for a run, made once on the driver."""
    import uuid

    return uuid.uuid4().hex[:length]
