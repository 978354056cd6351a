"""Tokens, Han segmentation, encoding repair, snippets' building blocks."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}]+"
HAN = r"\p{IsHan}"
#: Pieces that, joined, are the text again: tokens and what stands between them.
PIECE = r"[\p{L}\p{N}]+|[^\p{L}\p{N}]+"
#: The same with every Han character as a piece.
HAN_PIECE = r"\p{IsHan}|[\p{L}\p{N}&&[^\p{IsHan}]]+|[^\p{L}\p{N}]+"


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and numbers, in order; none for null."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), 0)


def _grams(run: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(run) - (n - 1), F.lit(1))), lambda i: F.substring(run, i, n))


def han_bigrams(text: Column) -> Column:
    """The pairs of neighbours in each run of Han characters."""
    runs = F.filter(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(rf"{HAN}{{2,}}"), 0), lambda r: F.length(r) > 1)
    return F.flatten(F.transform(runs, lambda r: _grams(r, 2)))


def search_tokens(text: Column) -> Column:
    """tokens(), but each run of Han characters as its single characters and, behind all others, its bigrams (no dictionary is at hand)."""
    return F.concat(phrase_tokens(text), han_bigrams(text))


def phrase_tokens(text: Column) -> Column:
    """tokens() in which every Han character stands by itself, so that adjacency needs no dictionary."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"\p{IsHan}|[\p{L}\p{N}&&[^\p{IsHan}]]+"), 0)


def joined(tokens_: Column) -> Column:
    """Tokens between single spaces, with one at each end: a phrase is then a substring."""
    return F.concat(F.lit(" "), F.array_join(tokens_, " "), F.lit(" "))


def title_of(text: Column) -> Column:
    return F.substring(F.substring_index(F.coalesce(text, F.lit("")), "\n", 1), 1, 80)


_SUSPECT = re.compile("[Â-ô][\u0080-¿]")


def repaired(text: str | None) -> str | None:
    """UTF-8 that was read as Latin-1, read again; any other text as it is."""
    if text and _SUSPECT.search(text) and all(c <= "ÿ" for c in text):
        try:
            return text.encode("latin-1").decode("utf-8")
        except UnicodeDecodeError:
            return text
    return text


def _repaired_all(text: pd.Series) -> pd.Series:
    return text.map(repaired, na_action="ignore")


def repair_encoding(text: Column) -> Column:
    return F.pandas_udf(_repaired_all, "string")(text)


def highlighted(text: Column, terms: list[str]) -> Column:
    """HTML-escaped text with <mark> around each query term, longest first, upper and lower case alike."""
    for plain, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(plain), F.lit(escaped))
    words = "|".join(re.escape(t) for t in sorted(set(terms), key=lambda t: (-len(t), t)))
    return F.regexp_replace(text, f"(?i)({words})", "<mark>$1</mark>") if words else text
