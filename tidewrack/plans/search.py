"""One search as one lazy plan: parse, recall, filter, score, deduplicate, spread hosts, snippet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewrack.config import DEFAULT, RankingConfig
from tidewrack.functions import text as tx
from tidewrack.operators import index, personal, rank, recall
from tidewrack.plans.query import ParsedQuery, parse

BACKENDS = ("auto", "local")


SEARCHED = ("title", "anchor_text", "attachment_text", "body")


def matching(docs: DataFrame, q: ParsedQuery, ix: dict[str, DataFrame] | None = None) -> DataFrame:
    """docs that meet all parts of the query but the bare words; host and type are pushed down to the scan.

    With an index that has positions, phrases are found in its postings and wildcards in its vocabulary; only
    addresses, regular expressions, and wildcards over signs or Han characters are matched against the rows.
    """
    out = docs
    if q.site:
        out = out.where(recall.site_is(F.col("host"), q.site))
    if q.filetype:
        out = out.where(recall.type_is(F.col("doc_type"), q.filetype))
    positions = ix is not None and "positions" in ix["postings"].columns
    for phrase in q.phrases:
        if positions and recall.phrase_words(phrase):
            out = out.join(recall.phrase_hits(ix["postings"], phrase).select("doc_id").distinct(), "doc_id", "left_semi")
        else:
            out = out.where(recall.any_field(docs, lambda c, p=phrase: recall.has_phrase(c, p), SEARCHED))
    for term in q.wildcards:
        if positions and recall.indexed(term):
            named = F.coalesce(recall.has_wildcard(F.col("url"), term), F.lit(False))
            found = recall.wildcard_hits(ix, term).withColumn("wild", F.lit(True))
            out = out.join(found, "doc_id", "left").where(F.col("wild").isNotNull() | named).drop("wild")
        else:
            out = out.where(recall.any_field(docs, lambda c, t=term: recall.has_wildcard(c, t)))
    for pattern in q.regexes:
        out = out.where(recall.any_field(docs, lambda c, p=pattern: recall.has_regex(c, p)))
    return out


def title_match(docs: DataFrame, q: ParsedQuery) -> Column:
    """A bare word, a wildcard or a regular expression of the query hits the title."""
    own = tx.search_tokens(F.col("title"))
    out = F.arrays_overlap(own, F.array(*map(F.lit, sorted(set(q.terms))))) if q.terms else F.lit(False)
    for term in q.wildcards:
        out = out | recall.has_wildcard(F.col("title"), term)
    for pattern in q.regexes:
        out = out | recall.has_regex(F.col("title"), pattern)
    return F.coalesce(out, F.lit(False))


def term_signals(ix: dict[str, DataFrame], q: ParsedQuery, config: RankingConfig) -> DataFrame:
    """doc_id, coverage, intent, exact of documents with a query term or a word of its topics, from postings alone."""
    terms = sorted(set(q.terms))
    topics = sorted({w for topic in config.intents.values() if set(topic) & set(terms) for w in topic})
    rows = ix["postings"].where(F.col("term").isin(*terms, *topics)).select("doc_id", "term")
    any_of = lambda words: F.coalesce(F.bool_or(F.col("term").isin(*words)), F.lit(False)) if words else F.lit(False)
    out = rows.groupBy("doc_id").agg((F.count_distinct(F.when(F.col("term").isin(*terms), F.col("term"))) / F.lit(float(len(terms)))).alias("coverage"), any_of(topics).alias("intent"))
    whole = [*q.phrases, *([" ".join(q.terms)] if len(q.terms) > 1 else [])]
    hits = [recall.phrase_hits(ix["postings"], p).where(F.col("field").isin("title", "body")).select("doc_id") for p in whole if recall.phrase_words(p)]
    if not hits:
        return out.withColumn("exact", F.lit(False))
    found = hits[0]
    for more in hits[1:]:
        found = found.unionByName(more)
    return out.join(found.distinct().withColumn("exact", F.lit(True)), "doc_id", "left").withColumn("exact", F.coalesce("exact", F.lit(False)))


def search(
    docs: DataFrame,
    query: str,
    ix: dict[str, DataFrame] | None = None,
    *,
    fields: dict[str, str] | None = None,
    pr_hat: DataFrame | None = None,
    pers: DataFrame | None = None,
    as_of: str = "2024-02-01",
    n: int = 60,
    config: RankingConfig = DEFAULT,
    backend: str = "auto",
    site: str | None = None,
    filetype: str | None = None,
    split=tx.search_tokens,
) -> DataFrame:
    """place, doc_id, url, host, doc_type, title, score, signals, snippet, download of the best n documents.

    docs: doc_id, url, host, doc_type, title, body, and, if there, anchor_text, attachment_text, fetched_at. ix: a built
    index of the full corpus, so filters don't change idf; it is built on the fly if none is given. pr_hat(id, pr_hat)
    and pers(doc_id, pers) are joined in if given. With no bare word, all matching documents are candidates.
    """
    if backend not in BACKENDS:
        raise ValueError(f"backend {backend!r} is not supported; recall is native: {', '.join(BACKENDS)}")
    q = parse(query, site, filetype)
    fields = fields or {f: c for f, c in {"title": "title", "anchor": "anchor_text", "attachment": "attachment_text", "body": "body"}.items() if c in docs.columns}
    if ix is None and (q.terms or q.phrases):
        ix = index.build_index(docs, fields, config.idf_mode, positions=True, split=split)
    found = matching(docs, q, ix)
    if q.terms:
        vsm = rank.fused(rank.field_cosines(ix, q.terms, config.idf_mode), config.field_weights)
        found = found.join(vsm.join(term_signals(ix, q, config), "doc_id"), "doc_id")
    else:
        found = found.withColumns({"vsm": F.lit(0.0), "coverage": F.lit(0.0), "intent": F.lit(False), "exact": F.lit(False)})
    if pr_hat is not None:
        found = found.join(pr_hat.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    else:
        found = found.withColumn("pr_hat", F.lit(0.0))
    found = found.join(pers.select("doc_id", "pers"), "doc_id", "left") if pers is not None else found.withColumn("pers", F.lit(0.0))
    signals = {
        "vsm": F.col("vsm"),
        "pr_hat": F.coalesce("pr_hat", F.lit(0.0)),
        "fresh": rank.freshness(F.col("fetched_at"), as_of, config.fresh_days) if "fetched_at" in docs.columns else F.lit(0.0),
        "pers": F.coalesce("pers", F.lit(0.0)),
        "intent": F.col("intent"),
        "exact": F.col("exact"),
        "coverage": F.col("coverage"),
        "title_hit": title_match(docs, q),
        "low_quality": F.coalesce(rank.low_quality(F.col("title"), F.col("body"), F.col("url")), F.lit(False)),
        "list_page": F.coalesce(rank.list_page(F.col("title"), F.col("body")), F.lit(False)),
    }
    scored = found.withColumn("signals", F.struct(*(c.alias(k) for k, c in signals.items())))
    own = {k: F.col(f"signals.{k}") for k in signals}
    base = rank.final_score(own["vsm"], own["pr_hat"], own["fresh"], own["pers"], config)
    scored = scored.withColumn("score", F.round(rank.corrected(base, own, config), 9))  # so that equal documents tie
    top = scored.orderBy(F.desc("score"), "doc_id").limit(config.recall)
    spread = rank.diversified(rank.deduplicated(top, config.signature_chars), config.diversity_window, config.per_host)
    page = spread.where(F.col("place") <= n)
    out = page.join(rank.snippets(page.select("doc_id", "body"), q.terms, config), "doc_id", "left") if q.terms else page.withColumn("snippet", F.substring("body", 1, config.snippet_chars))
    snippet = tx.highlighted(F.coalesce("snippet", F.substring("body", 1, config.snippet_chars)), q.terms)
    return out.select("place", "doc_id", "url", "host", "doc_type", rank.display_title(F.col("title"), F.col("body")).alias("title"), "score", "signals", snippet.alias("snippet"), (F.col("doc_type") != "html").alias("download")).orderBy("place")


def page(results: DataFrame, number: int, size: int) -> DataFrame:
    """One page (from 1) of ordered results."""
    return results.offset((number - 1) * size).limit(size)


def personas(docs: DataFrame, query: str, users: DataFrame, clicks: DataFrame, n: int = 10, config: RankingConfig = DEFAULT, ix: dict[str, DataFrame] | None = None) -> DataFrame:
    """persona, rn, doc_id, doc_type, score: one query's best documents for each of users(persona, user_id, role, interests)."""
    q = parse(query)
    fields = {f: c for f, c in {"title": "title", "body": "body"}.items() if c in docs.columns}
    ix = ix or index.build_index(docs, fields, config.idf_mode)
    vsm = rank.fused(rank.field_cosines(ix, q.terms, config.idf_mode), config.field_weights)
    found = matching(docs, q).join(vsm, "doc_id")
    pers = personal.personalised(found, users.select("user_id", "role", "interests"), clicks, config)
    rows = found.select("doc_id", "doc_type", "vsm").join(pers, "doc_id").join(F.broadcast(users.select("user_id", "persona")), "user_id")
    return personal.top_by_persona(rows.withColumn("score", F.round(F.col("vsm") + config.gamma * F.col("pers"), 6)), n).select("persona", "rn", "doc_id", "doc_type", "score")
