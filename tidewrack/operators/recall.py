"""Candidates: terms through postings, and the predicates of the query language as pushed-down columns."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewrack.functions import text as tx

WORD = r"[\p{L}\p{N}]"


def site_is(host: Column, site: str) -> Column:
    """The host itself or one below it."""
    return (F.lower(host) == site.lower()) | F.endswith(F.lower(host), F.lit("." + site.lower()))


def type_is(doc_type: Column, kind: str) -> Column:
    return F.lower(doc_type) == kind.lower()


def has_phrase(text: Column, phrase: str) -> Column:
    """The phrase's tokens stand next to each other in this order; Han characters are tokens of their own."""
    words = phrase_words(phrase)
    return F.contains(tx.joined(tx.phrase_tokens(text)), F.lit(" " + " ".join(words) + " ")) if words else F.lit(True)


def wildcard_pattern(term: str) -> str:
    """* any run and ? one letter or number, as a regular expression for a whole token."""
    return f"(^|[^\\p{{L}}\\p{{N}}]){whole_term(term)}($|[^\\p{{L}}\\p{{N}}])"


def whole_term(term: str) -> str:
    return "".join(f"{WORD}*" if c == "*" else WORD if c == "?" else re.escape(c) for c in term.lower())


def has_wildcard(text: Column, term: str) -> Column:
    return F.rlike(F.lower(text), F.lit(wildcard_pattern(term)))


def has_regex(text: Column, pattern: str) -> Column:
    re.compile(pattern)
    return F.rlike(text, F.lit(pattern))


def any_field(docs: DataFrame, predicate, fields=("title", "body", "anchor_text", "url")) -> Column:
    """The predicate holds on one of the fields that docs has."""
    found = [F.coalesce(predicate(F.col(c)), F.lit(False)) for c in fields if c in docs.columns]
    out = found[0]
    for c in found[1:]:
        out = out | c
    return out


def phrase_words(phrase: str) -> list[str]:
    return re.findall(r"[㐀-鿿]|[^\W_㐀-鿿]+", phrase.lower())


def _back(by: int):
    return lambda place: place - F.lit(by)


def phrase_hits(postings: DataFrame, phrase: str) -> DataFrame:
    """doc_id, field of documents in which the phrase's tokens stand next to each other, by postings(term, doc_id, field, positions).

    Each document's few postings of these terms meet in one grouping; their positions, moved to the phrase's start,
    must have one in common.
    """
    words = phrase_words(phrase)
    each = sorted(set(words))
    rows = postings.where(F.col("term").isin(*each)).groupBy("doc_id", "field").agg(*(F.first(F.when(F.col("term") == w, F.col("positions")), ignorenulls=True).alias(f"p{each.index(w)}") for w in each))
    common = None
    for i, word in enumerate(words):
        moved = F.transform(F.col(f"p{each.index(word)}"), _back(i))
        common = moved if common is None else F.array_intersect(common, moved)
    return rows.where(F.size(common) > 0).select("doc_id", "field")


def wildcard_hits(ix: dict[str, DataFrame], term: str) -> DataFrame:
    """doc_id of documents with a term of the wildcard: the postings' terms are matched where they lie, from the wildcard's fixed beginning on."""
    head = re.split(r"[*?]", term.lower())[0]
    own = ix["postings"].select("term", "doc_id").where(F.startswith("term", F.lit(head)))
    return own.where(F.rlike("term", F.lit(f"^{whole_term(term)}$"))).select("doc_id").distinct()


def indexed(term: str) -> bool:
    """Whether a wildcard's signs can stand in one term of the index."""
    return re.fullmatch(r"(?:[^\W_㐀-鿿]|[*?])+", term) is not None


def phrase_by_positions(tokens: DataFrame, phrase: list[str]) -> DataFrame:
    """doc_id, field, pos of each place of a phrase, by equi-joins of positional postings."""
    found = tokens.where(F.col("term") == phrase[0]).select("doc_id", "field", "pos")
    for i, word in enumerate(phrase[1:], 1):
        step = tokens.where(F.col("term") == word).select("doc_id", "field", (F.col("pos") - i).alias("pos"))
        found = found.join(step, ["doc_id", "field", "pos"], "left_semi")
    return found


def vocabulary_matches(stats: DataFrame, term: str) -> DataFrame:
    """Vocabulary terms of a wildcard: the vocabulary is scanned, not the texts."""
    return stats.where(F.rlike("term", F.lit(f"^{whole_term(term)}$"))).select("term")


def candidates(postings: DataFrame, terms: list[str]) -> DataFrame:
    """doc_id of documents with one of the terms in any field."""
    return postings.where(F.col("term").isin(*terms)).select("doc_id").distinct() if terms else postings.select("doc_id").limit(0)
