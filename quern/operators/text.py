"""Full-text search over a positional token table.

Tokens are runs of letters and digits, lower-cased, with combining marks removed after compatibility decomposition. ``ascii`` does
that in Catalyst for ASCII text; ``unicode`` in a pandas UDF.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = re.compile(r"[^\W_]+")


def fold(text: str | None) -> list[str]:
    """The tokens of a text."""
    if text is None:
        return []
    out = []
    for w in WORD.findall(unicodedata.normalize("NFC", text)):
        plain = "".join(c for c in unicodedata.normalize("NFKD", w) if not unicodedata.combining(c)).lower()
        if plain:
            out.append(plain)
    return out


def _folded(c: Column) -> Column:
    from pyspark.sql.functions import pandas_udf

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(fold)

    return pandas_udf(run, "array<string>")(c)


TOKENIZERS: dict[str, Callable[[Column], Column]] = {
    "ascii": lambda c: F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0)),
    "words": lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)),
    "unicode": _folded,
}


def register(name: str, build: Callable[[Column], Column]) -> None:
    """Add a tokenizer: a function from a text column to an array of tokens."""
    TOKENIZERS[name] = build


def tokens(rows: DataFrame, key: str, text: str, tokenizer: str = "words") -> DataFrame:
    """key, token, pos (from 0): the positional inverted index."""
    return rows.select(key, F.posexplode(TOKENIZERS[tokenizer](F.col(text))).alias("pos", "token")).select(key, "token", "pos")


def _wanted(index: DataFrame, words: list[str]) -> DataFrame:
    return index.where(F.col("token").isin(*words))


def contains_any(index: DataFrame, key: str, words: list[str]) -> DataFrame:
    return _wanted(index, words).select(key).distinct()


def contains_all(index: DataFrame, key: str, words: list[str]) -> DataFrame:
    n = len(set(words))
    return _wanted(index, words).groupBy(key).agg(F.count_distinct("token").alias("n")).where(F.col("n") == n).select(key)


def contains_prefix(index: DataFrame, key: str, prefix: str) -> DataFrame:
    return index.where(F.col("token").startswith(prefix)).select(key).distinct()


def contains_any_prefix(index: DataFrame, key: str, prefixes: list[str]) -> DataFrame:
    hit = F.lit(False)
    for p in prefixes:
        hit = hit | F.col("token").startswith(p)
    return index.where(hit).select(key).distinct()


def contains_all_prefixes(index: DataFrame, key: str, prefixes: list[str]) -> DataFrame:
    """Every prefix has a token; the tokens of the prefixes only are aggregated, to one flag each."""
    hit = F.lit(False)
    for p in prefixes:
        hit = hit | F.col("token").startswith(p)
    flags = [F.max(F.col("token").startswith(p)).alias(f"p{i}") for i, p in enumerate(prefixes)]
    found = index.where(hit).groupBy(key).agg(*flags)
    for i in range(len(prefixes)):
        found = found.where(F.col(f"p{i}"))
    return found.select(key)


def phrase(index: DataFrame, key: str, words: list[str]) -> DataFrame:
    """Documents with the words one after another: every word votes for the place where the phrase would begin."""
    starts = None
    for i, w in enumerate(words):
        own = index.where(F.col("token") == w).select(key, (F.col("pos") - i).alias("start"), F.lit(i).alias("i"))
        starts = own if starts is None else starts.union(own)
    return starts.groupBy(key, "start").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(words)).select(key).distinct()


def all_within(index: DataFrame, key: str, words: list[str], distance: int) -> DataFrame:
    """Documents with all the words in a span of at most ``distance`` positions.

    One ordered pass over the positions of the words in each document: the latest place of every word so far is known at each.
    """
    names = sorted(set(words))
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    latest = [F.last(F.when(F.col("token") == x, F.col("pos")), ignorenulls=True).over(w) for x in names]
    seen = _wanted(index, words).select(key, "pos", *[c.alias(f"_at{i}") for i, c in enumerate(latest)])
    for i in range(len(names)):
        seen = seen.where((F.col("pos") - F.col(f"_at{i}")) < distance)  # null where the word has not come up yet
    return seen.select(key).distinct()
