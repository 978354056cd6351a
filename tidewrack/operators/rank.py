"""Cosine, field fusion, the final score and its corrections."""

from __future__ import annotations

import re
from collections import Counter
from math import log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewrack.config import DEFAULT, RankingConfig
from tidewrack.functions import text as tx
from tidewrack.functions import urls
from tidewrack.operators import index


def query_vector(stats: DataFrame, terms: list[str], mode: str = "smooth") -> DataFrame:
    """term, wq, own idf and, in each row, the query's norm; terms that no document has are left out."""
    counts = Counter(terms)
    own = F.col("idf_smooth" if mode == "smooth" else "idf_raw")
    if not counts:
        return stats.limit(0).select("term", own.alias("idf"), own.alias("wq"), own.alias("q_norm"))
    factor = F.create_map(*(x for t, n in counts.items() for x in (F.lit(t), F.lit(1 + log(n)))))
    rows = stats.where(F.col("term").isin(*counts)).select("term", own.alias("idf"), (factor[F.col("term")] * own).alias("wq"))
    return rows.withColumn("q_norm", F.sqrt(F.sum(F.col("wq") * F.col("wq")).over(Window.partitionBy(F.lit(0)))))  # as many rows as the query has terms


def field_cosines(ix: dict[str, DataFrame], terms: list[str], mode: str = "smooth") -> DataFrame:
    """doc_id, field, sim of documents with a query term; 0 where a norm is 0."""
    q = query_vector(ix["stats"], terms, mode)
    hits = ix["postings"].where(F.col("term").isin(*set(terms))) if terms else ix["postings"].limit(0)
    dots = hits.join(F.broadcast(q), "term").groupBy("doc_id", "field").agg(F.sum(F.col("wq") * index.weight(F.col("tf"), F.col("idf"))).alias("dot"), F.max("q_norm").alias("q_norm"))
    return dots.join(ix["norms"], ["doc_id", "field"]).select("doc_id", "field", F.coalesce(F.try_divide(F.col("dot"), F.col("q_norm") * F.col("norm")), F.lit(0.0)).alias("sim"))


def fused(sims: DataFrame, weights: dict[str, float]) -> DataFrame:
    """doc_id, vsm: the fields' weighted sum."""
    by = F.create_map(*(x for f, w in weights.items() for x in (F.lit(f), F.lit(float(w)))))
    return sims.groupBy("doc_id").agg(F.sum(by[F.col("field")] * F.col("sim")).alias("vsm"))


def freshness(fetched_at: Column, as_of: str, days: float) -> Column:
    """exp(-age / days), 0 without a time."""
    return F.coalesce(F.exp(-F.datediff(F.lit(as_of).cast("date"), fetched_at.cast("date")) / F.lit(days)), F.lit(0.0))


def coverage(tokens: Column, terms: list[str]) -> Column:
    """Share of the distinct query terms that the tokens have."""
    distinct = sorted(set(terms))
    return F.size(F.array_intersect(tokens, F.array(*map(F.lit, distinct)))) / F.lit(float(len(distinct))) if distinct else F.lit(0.0)


def low_quality(title: Column, body: Column, url: Column | None = None) -> Column:
    """Login, CAS and redirect pages, addresses as titles, empty bodies."""
    out = F.rlike(F.lower(title), F.lit(r"^(https?://|www\.)")) | (F.length(F.trim(F.coalesce(body, F.lit("")))) == 0) | (F.length(F.trim(F.coalesce(title, F.lit("")))) == 0)
    return out | F.rlike(url, F.lit(urls.LOGIN)) if url is not None else out


def list_page(title: Column, body: Column) -> Column:
    """Pages of short lines: eight at least, none longer than 40 characters."""
    lines = F.filter(F.split(F.coalesce(body, F.lit("")), "\n"), lambda x: F.length(F.trim(x)) > 0)
    return (F.size(lines) >= 8) & F.forall(lines, lambda x: F.length(x) <= 40)


def intent_hit(tokens: Column, terms: list[str], config: RankingConfig) -> Column:
    """The document speaks of a topic that a query term stands for."""
    words = sorted({w for topic in config.intents.values() if set(topic) & set(terms) for w in topic})
    return F.arrays_overlap(tokens, F.array(*map(F.lit, words))) if words else F.lit(False)


def final_score(vsm: Column, pr_hat: Column, fresh: Column, pers: Column, config: RankingConfig = DEFAULT) -> Column:
    return vsm * (1 + config.alpha * F.log1p(pr_hat)) + config.beta * fresh + config.gamma * pers


def corrected(score: Column, signals: dict[str, Column], config: RankingConfig = DEFAULT) -> Column:
    """The score with its small boosts, then the factors of low-quality and list pages."""
    bonus = config.intent_boost * signals["intent"].cast("double") + config.phrase_boost * signals["exact"].cast("double")
    bonus = bonus + config.coverage_boost * signals["coverage"] + config.title_boost * signals["title_hit"].cast("double")
    factor = F.when(signals["low_quality"], config.low_quality_factor).otherwise(1.0) * F.when(signals["list_page"], config.list_page_factor).otherwise(1.0)
    return (score + bonus) * factor


def display_title(title: Column, body: Column) -> Column:
    """The title if it can be read (three letters in sequence and no bare file name), else the body's first sentence."""
    bad = (F.length(F.trim(F.coalesce(title, F.lit("")))) == 0) | F.rlike(title, F.lit(r"(?i)^[\w%-]+\.(pdf|docx?|xlsx?)$")) | ~F.rlike(title, F.lit(r"[\p{L}]{3}"))
    sentences = F.filter(F.transform(F.split(F.coalesce(body, F.lit("")), r"[。！？.!?\n]"), lambda s: F.trim(s)), lambda s: F.length(s) >= 4)
    return F.when(bad, F.coalesce(F.get(sentences, F.lit(0)), title)).otherwise(title)


def signature(title: Column, body: Column, chars: int) -> Column:
    return F.md5(F.concat(F.coalesce(title, F.lit("")), F.substring(F.coalesce(body, F.lit("")), 1, chars)))


def deduplicated(scored: DataFrame, chars: int = DEFAULT.signature_chars) -> DataFrame:
    """Of rows with one content signature the best-scoring stays, of those the smallest doc_id."""
    w = Window.partitionBy("signature").orderBy(F.desc("score"), "doc_id")
    return scored.withColumn("signature", signature(F.col("title"), F.col("body"), chars)).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def diversified(scored: DataFrame, window: int = DEFAULT.diversity_window, per_host: int = DEFAULT.per_host, by: str = "input") -> DataFrame:
    """rn (rank by score), bucket, and place (order after hosts have been spread) of scored(doc_id, host, score).

    by="input": of the first `window` ranks each host keeps `per_host`, its further ones come behind the window's
    kept ones. by="output": ranks are refilled from below, so the first `window` places hold `per_host` of a host.
    Meant for a result list that recall has already limited.
    """
    rn = scored.withColumn("rn", F.row_number().over(Window.orderBy(F.desc("score"), "doc_id")))
    if by == "input":
        part = Window.partitionBy("host", F.col("rn") <= window).orderBy("rn")
        out = rn.withColumn("_hn", F.row_number().over(part))
        bucket = F.when((F.col("rn") <= window) & (F.col("_hn") <= per_host), 0).when(F.col("rn") <= window, 1).otherwise(2)
    elif by == "output":
        out = rn.withColumn("_hn", F.row_number().over(Window.partitionBy("host").orderBy("rn")))
        out = out.withColumn("_kr", F.sum((F.col("_hn") <= per_host).cast("int")).over(Window.orderBy("rn").rowsBetween(Window.unboundedPreceding, 0)))
        bucket = F.when((F.col("_hn") <= per_host) & (F.col("_kr") <= window), 0).otherwise(1)
    else:
        raise ValueError(f"by {by}: input or output")
    out = out.withColumn("bucket", bucket)
    return out.withColumn("place", F.row_number().over(Window.orderBy("bucket", "rn"))).drop("_hn", "_kr")


def snippets(docs: DataFrame, terms: list[str], config: RankingConfig = DEFAULT) -> DataFrame:
    """doc_id, off, snippet_score, snippet of docs(doc_id, body), a row for each doc_id: the densest window of characters that begins at a hit.

    A window scores three for each distinct term and one for each hit, less a penalty in the first characters, where
    navigation stands; the earliest of equal windows wins. Han characters are terms of their own, and each with the
    next one. A text is cut where a term may begin, so that only these places are rows; texts are joined to the one best
    place of each document.
    """
    words = sorted({t for t in terms if t})
    any_of, letter = "|".join(map(re.escape, words)), rf"[\p{{L}}\p{{N}}&&[^{tx.HAN}]]"
    # before a Han character's term, or one that no letter of its own kind comes before or behind; what begins there is looked at below
    place = rf"(?iu)(?={any_of})(?:(?={tx.HAN})|(?<!{letter})(?=(?:{any_of})(?!{letter})))" if words else "(?!)"
    cuts = docs.select("doc_id", F.split("body", place, -1).alias("cuts"))
    head = lambda cut: F.regexp_extract(cut, rf"^(?:{tx.HAN_PIECE})", 0)
    behind = lambda cut, n: F.when(F.length(cut) > 1, F.substring(cut, 2, 1)).otherwise(F.substring(F.get("cuts", n + 1), 1, 1))
    pieces = cuts.select("doc_id", F.posexplode(F.transform("cuts", lambda cut, n: F.struct(F.length(cut).alias("size"), head(cut).alias("piece"), behind(cut, n).alias("next")))).alias("n", "p"))
    order = Window.partitionBy("doc_id").orderBy("n")
    is_han = lambda piece: F.coalesce(F.rlike(piece, F.lit(rf"^{tx.HAN}$")), F.lit(False))
    off = F.coalesce(F.sum("p.size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pieces = pieces.select("doc_id", off.alias("off"), F.lower("p.piece").alias("term"), is_han(F.col("p.piece")).alias("han"), is_han(F.col("p.next")).alias("next_han"), F.lower("p.next").alias("next"))
    both = F.array("term", F.when(F.col("han") & F.col("next_han"), F.concat("term", "next")))
    hits = pieces.select("doc_id", "off", F.explode(both).alias("term")).where(F.col("term").isin(*set(terms)))
    ahead = Window.partitionBy("doc_id").orderBy("off").rangeBetween(0, config.snippet_chars - 1)
    score = 3 * F.size(F.collect_set("term").over(ahead)) + F.count("*").over(ahead) - F.when(F.col("off") < config.nav_chars, config.nav_penalty).otherwise(0)
    best = hits.withColumn("snippet_score", score).groupBy("doc_id").agg(F.max(F.struct("snippet_score", (-F.col("off")).alias("back"))).alias("best"))
    best = best.select("doc_id", (-F.col("best.back")).alias("off"), F.col("best.snippet_score").cast("long").alias("snippet_score"))
    return best.join(docs.select("doc_id", "body"), "doc_id").select("doc_id", "off", "snippet_score", F.substring("body", F.col("off").cast("int") + 1, F.lit(config.snippet_chars)).alias("snippet"))


NOISE_SENTENCE = r"(?i)(copyright|©|all rights reserved|home ?page|版权所有|首页)"


def sentence_snippets(docs: DataFrame, terms: list[str]) -> DataFrame:
    """doc_id, n, snippet_score, snippet: the best sentence by the same score; navigation and copyright lines are passed over."""
    rows = docs.select("doc_id", F.posexplode(F.split("body", r"[。！？.!?\n]")).alias("n", "s")).withColumn("snippet", F.trim("s"))
    words = tx.tokens(F.col("snippet"))
    wanted = F.array(*map(F.lit, sorted(set(terms))))
    hits = F.filter(words, lambda w: F.array_contains(wanted, w))
    rows = rows.where(~F.rlike("snippet", F.lit(NOISE_SENTENCE))).withColumn("snippet_score", (3 * F.size(F.array_distinct(hits)) + F.size(hits)).cast("long")).where("snippet_score > 0")
    w = Window.partitionBy("doc_id").orderBy(F.desc("snippet_score"), "n")
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("doc_id", "n", "snippet_score", "snippet")
