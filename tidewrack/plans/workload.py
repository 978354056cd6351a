"""The registered queries over the test tables, and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewrack.config import DEFAULT
from tidewrack.functions import text as tx
from tidewrack.functions import urls
from tidewrack.operators import frontier, index, pagerank, personal, rank, recall
from tidewrack.plans import bindings as b
from tidewrack.plans import search as s
from tidewrack.scratch import kept
from tidewrack.sources import html
from tidewrack.streaming import logs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

TERMS = ("license", "under", "the")
AS_OF = "2024-02-01"
#: On the test tables these languages stand for web pages and for files.
BOUND = replace(DEFAULT, student_types=("en", "es"), teacher_types=("de", "fr"))

# --- SQL fragments ------------------------------------------------------------------------------------

TOK = r"tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+')) AS term FROM documents)"
TF = f"{TOK}, tf AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY ALL), n AS (SELECT count(*) AS n FROM documents)"
STATS = f"{TF}, st AS (SELECT term, count(*) AS df, ln((max(n) + 1) / (count(*) + 1)) + 1 AS idf_smooth, ln(max(n) / count(*)) AS idf_raw FROM tf, n GROUP BY term)"
IN_TERMS = "(" + ", ".join(f"'{t}'" for t in TERMS) + ")"


def _cosine(mode: str) -> str:
    own = "idf_smooth" if mode == "smooth" else "idf_raw"
    return f"""{STATS}, w AS (SELECT doc_id, term, (1 + ln(tf)) * {own} AS w FROM tf JOIN st USING (term)),
norm AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM w GROUP BY doc_id),
q AS (SELECT term, {own} AS wq FROM st WHERE term IN {IN_TERMS}), qn AS (SELECT sqrt(sum(wq * wq)) AS qn FROM q),
sim AS (SELECT doc_id, coalesce(sum(w * wq) / nullif(max(norm) * max(qn), 0), 0) AS sim FROM w JOIN q USING (term) JOIN norm USING (doc_id), qn GROUP BY doc_id)"""


D = r"d AS (SELECT doc_id, source AS host, lang AS doc_type, left(split_part(coalesce(text, ''), chr(10), 1), 80) AS title, coalesce(text, '') AS body FROM documents)"
TITLE_TOKENS = r"regexp_extract_all(lower(title), '[\p{L}\p{N}]+')"


def _rank_sql(edges: str, rounds: int = 10, d: float = 0.85) -> str:
    """CTEs pr0..pr{rounds}(id, pr) over the CTE body `edges` (src, dst)."""
    out = [
        f"e0 AS MATERIALIZED ({edges})", "v AS MATERIALIZED (SELECT src AS id FROM e0 UNION SELECT dst FROM e0)", "e AS MATERIALIZED (SELECT DISTINCT src, dst FROM e0 WHERE src <> dst)",
        "deg AS MATERIALIZED (SELECT src, count(*) AS degree FROM e GROUP BY src)", "vn AS MATERIALIZED (SELECT count(*)::DOUBLE AS n FROM v)", "pr0 AS MATERIALIZED (SELECT id, 1 / n AS pr FROM v, vn)",
    ]
    for i in range(1, rounds + 1):
        out.append(
            f"pr{i} AS MATERIALIZED (SELECT v.id, (1 - {d}) / n + {d} * (coalesce(g.given, 0) + l.lost / n) AS pr FROM v CROSS JOIN vn "
            f"CROSS JOIN (SELECT coalesce(sum(pr), 0) AS lost FROM pr{i - 1} WHERE id NOT IN (SELECT src FROM deg)) l "
            f"LEFT JOIN (SELECT e.dst AS id, sum(p.pr / degree) AS given FROM e JOIN deg USING (src) JOIN pr{i - 1} p ON p.id = e.src GROUP BY e.dst) g ON g.id = v.id)"
        )
    return ", ".join(out)


HOST = r"lower(regexp_extract(url, '^[A-Za-z]+://([^/:?#]+)', 1))"
PATH = r"regexp_extract(url, '^[A-Za-z]+://[^/?#]+(/[^?#]*)', 1)"
ORIGIN = r"regexp_extract(url, '^([A-Za-z]+://[^/?#]+)', 1)"
_ENDING = rf"lower(regexp_extract({PATH}, '\.([A-Za-z0-9]+)$', 1))"
TYPE = f"CASE WHEN {_ENDING} IN ('html', 'pdf', 'doc', 'docx', 'xls', 'xlsx') THEN {_ENDING} ELSE 'html' END"


def _decoded(x: str) -> str:
    for entity, sign in html.ENTITIES:
        x = "replace({}, '{}', '{}')".format(x, entity, sign.replace("'", "''"))
    return x


def _plain(x: str) -> str:
    stripped = f"regexp_replace({x}, '<[^>]*>', ' ', 'g')"
    return rf"trim(regexp_replace({_decoded(stripped)}, '\s+', ' ', 'g'))"


_LINK = html.LINK.replace("'", "''")
LINKS = rf"""l0 AS (SELECT url, {HOST} AS host, {PATH} AS path, regexp_extract_all(html, '{_LINK}', 1) AS h1, regexp_extract_all(html, '{_LINK}', 2) AS h2, regexp_extract_all(html, '{_LINK}', 3) AS h3, regexp_extract_all(html, '{_LINK}', 4) AS anchors FROM pages),
l1 AS (SELECT url, host, path, i AS n, concat(h1[i + 1], h2[i + 1], h3[i + 1]) AS href, {_plain("anchors[i + 1]")} AS anchor FROM l0, unnest(range(len(anchors))) AS t(i)),
l2 AS (SELECT *, regexp_replace(href, '[?#].*$', '') AS bare FROM l1),
links AS (SELECT host || path AS src, CASE WHEN starts_with(bare, '/') THEN host || bare WHEN regexp_matches(bare, '^[A-Za-z]+://') THEN regexp_replace(bare, '^[A-Za-z]+://', '') ELSE host || regexp_replace(path, '[^/]*$', '') || bare END AS dst, anchor FROM l2 WHERE bare <> '')"""


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# --- pages --------------------------------------------------------------------------------------------


@query("page_parse_title", f"SELECT page_id, {_plain("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")} AS title FROM pages")
def page_parse_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.table(spark, sf_dir, "pages").select("page_id", html.title(F.col("html")).alias("title"))


@query("page_parse_body", f"SELECT page_id, md5(t) AS body_md5, length(t) AS n FROM (SELECT page_id, {_plain(f"regexp_replace(html, '{html.DROPPED}', ' ', 'g')")} AS t FROM pages)")
def page_parse_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = b.table(spark, sf_dir, "pages").select("page_id", html.body(F.col("html")).alias("t"))
    return p.select("page_id", F.md5("t").alias("body_md5"), F.length("t").cast("long").alias("n"))


@query("page_host_distribution", f"SELECT {HOST} AS host, count(*) AS n FROM pages GROUP BY 1")
def page_host_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.table(spark, sf_dir, "pages").groupBy(urls.host(F.col("url")).alias("host")).agg(F.count("*").alias("n"))


@query("page_type_counts", f"SELECT {TYPE} AS doc_type, count(*) AS n FROM pages GROUP BY 1")
def page_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.table(spark, sf_dir, "pages").groupBy(urls.type_of(F.col("url")).alias("doc_type")).agg(F.count("*").alias("n"))


@query("page_links", f"WITH {LINKS} SELECT url, n, href, anchor FROM l1")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.links(b.table(spark, sf_dir, "pages")).withColumn("n", F.col("n").cast("long"))


@query("anchor_aggregate", f"WITH {LINKS} SELECT dst, array_to_string(list_sort(list(anchor)), ' ') AS anchor_text FROM links GROUP BY dst")
def anchor_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.anchors_by_target(b.page_links(spark, sf_dir)).select("dst", "anchor_text")


@query("inlink_count", f"WITH {LINKS} SELECT dst, count(DISTINCT src) AS inlinks_count FROM links GROUP BY dst")
def inlink_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.page_links(spark, sf_dir).groupBy("dst").agg(F.countDistinct("src").alias("inlinks_count"))


@query("snapshot_key", "SELECT page_id, 'snapshots/' || md5(url) || '.html.gz' AS snapshot_path FROM pages")
def snapshot_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.table(spark, sf_dir, "pages").select("page_id", urls.snapshot_path(F.col("url")).alias("snapshot_path"))


@query("snapshot_rewrite", rf"""SELECT page_id, md5('<div class="snapshot-banner">{AS_OF} ' || url || '</div>' || regexp_replace(html, '(href|src)="/', '\1="' || {ORIGIN} || '/', 'g')) AS html_md5 FROM pages""")
def snapshot_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.table(spark, sf_dir, "pages").select("page_id", F.md5(urls.rendered_snapshot(F.col("html"), F.col("url"), F.lit(AS_OF))).alias("html_md5"))


@query("snapshot_lookup", f"SELECT page_id, url, md5(url) AS url_md5 FROM pages WHERE md5(url) = (SELECT md5(url) FROM pages WHERE page_id = 7)")
def snapshot_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = b.table(spark, sf_dir, "pages").select("page_id", "url", F.md5("url").alias("url_md5"))
    return p.join(F.broadcast(p.where("page_id = 7").select("url_md5")), "url_md5", "left_semi").select("page_id", "url", "url_md5")


@query("attachment_type", f"SELECT page_id, CASE WHEN {_ENDING} IN ('html', 'pdf', 'doc', 'docx', 'xls', 'xlsx') THEN {_ENDING} WHEN page_id % 3 = 0 THEN 'pdf' ELSE 'html' END AS doc_type FROM pages")
def attachment_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    served = F.when(F.col("page_id") % 3 == 0, "application/pdf; charset=binary").otherwise("text/html")
    return b.table(spark, sf_dir, "pages").select("page_id", urls.type_of(F.col("url"), served).alias("doc_type"))


@query("path_relocation", "SELECT page_id, '/data/snapshots/' || md5(url) || '.html.gz' AS path FROM pages")
def path_relocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = F.concat(F.lit("C:\\old\\data\\snapshots\\"), F.md5("url"), F.lit(".html.gz"))
    return b.table(spark, sf_dir, "pages").select("page_id", urls.relocated(old, "/data").alias("path"))


@query("domain_check", f"SELECT count(*) FILTER (WHERE NOT ({HOST} = 'example.com' OR ends_with({HOST}, '.example.com'))) AS outside, count(*) AS n FROM pages")
def domain_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.pages(spark, sf_dir).agg(F.count_if(~urls.inside(F.col("host"), "example.com")).alias("outside"), F.count("*").alias("n"))


@query("domain_whitelist", f"SELECT page_id, {HOST} AS host FROM pages WHERE {HOST} = 'example.com' OR ends_with({HOST}, '.example.com')")
def domain_whitelist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.pages(spark, sf_dir).where(urls.inside(F.col("host"), "example.com")).select("page_id", "host")


@query("unique_urls", f"SELECT url, min(page_id) AS doc_id FROM (SELECT page_id, {ORIGIN} || {PATH} AS url FROM pages) GROUP BY url")
def unique_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = b.table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.concat(urls.origin(F.col("url")), urls.path(F.col("url"))).alias("url"), F.lit(None).cast("timestamp").alias("fetched_at"))
    return index.unique_by_url(rows).select("url", "doc_id")


# --- frontier -----------------------------------------------------------------------------------------

FRONTIER = f"{LINKS}, f AS (SELECT 'http://' || dst AS url, split_part(dst, '/', 1) AS host, count(*) AS priority FROM links GROUP BY dst)"


def _frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = b.page_links(spark, sf_dir).groupBy("dst").agg(F.count("*").alias("priority"))
    return found.select(F.concat(F.lit("http://"), "dst").alias("url"), F.split_part("dst", F.lit("/"), F.lit(1)).alias("host"), "priority")


@query("frontier_quota", f"WITH {FRONTIER} SELECT url, host, priority, host_rank FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY priority DESC, url) AS host_rank FROM f) WHERE host_rank <= 3")
def frontier_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frontier.by_quota(_frontier(spark, sf_dir), 3).withColumn("host_rank", F.col("host_rank").cast("long"))


@query("frontier_bounded", f"WITH {FRONTIER} SELECT url, host_rank FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY priority DESC, url) AS host_rank FROM f) WHERE host_rank <= 5 ORDER BY host_rank, priority DESC, url LIMIT 100")
def frontier_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frontier.round_robin(_frontier(spark, sf_dir), 5, 100).select("url", F.col("host_rank").cast("long").alias("host_rank"))


@query("frontier_resume", f"WITH {FRONTIER} SELECT url FROM f WHERE url NOT IN (SELECT url FROM f WHERE priority > 1)")
def frontier_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _frontier(spark, sf_dir)
    return frontier.resumed(f, f.where("priority > 1")).select("url")


@query("frontier_noise", f"WITH {FRONTIER} SELECT url FROM f WHERE NOT regexp_matches(url, '{urls.NOISE}')")
def frontier_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frontier.without_noise(_frontier(spark, sf_dir)).select("url")


@query("frontier_html_only", f"WITH {FRONTIER} SELECT url FROM f WHERE NOT regexp_matches(url, '{urls.ATTACHMENT}')")
def frontier_html_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frontier.html_only(_frontier(spark, sf_dir)).select("url")


@query("frontier_seeds", f"""WITH {FRONTIER}, s AS (SELECT url, host, priority, 'links' AS source FROM f UNION ALL SELECT {ORIGIN} || {PATH}, {HOST}, 10, 'pages' FROM pages UNION ALL SELECT url, host, priority, 'again' FROM f)
SELECT url, host, priority, source FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY priority DESC, source, host) AS n FROM s) WHERE n = 1""")
def frontier_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _frontier(spark, sf_dir)
    p = b.pages(spark, sf_dir).select(F.concat(urls.origin(F.col("url")), urls.path(F.col("url"))).alias("url"), "host", F.lit(10).cast("long").alias("priority"), F.lit("pages").alias("source"))
    return frontier.merged([f.withColumn("source", F.lit("links")), p, f.withColumn("source", F.lit("again"))])


# --- the index ----------------------------------------------------------------------------------------


def _body_tf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.term_frequencies(index.token_rows(b.docs(spark, sf_dir), {"body": "body"}))


def _stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.term_stats(_body_tf(spark, sf_dir), index.count_of(b.docs(spark, sf_dir)))


@query("term_frequency", f"WITH {TF} SELECT doc_id, term, tf FROM tf")
def term_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _body_tf(spark, sf_dir).select("doc_id", "term", "tf")


@query("document_frequency", f"WITH {TF} SELECT term, count(*) AS df FROM tf GROUP BY term")
def document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _body_tf(spark, sf_dir).groupBy("term").agg(F.count("*").alias("df"))


@query("idf_smooth", f"WITH {STATS} SELECT term, round(idf_smooth, 9) AS idf FROM st")
def idf_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stats(spark, sf_dir).select("term", F.round("idf_smooth", 9).alias("idf"))


@query("idf_ltc", f"WITH {STATS} SELECT term, round(idf_raw, 9) AS idf FROM st")
def idf_ltc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stats(spark, sf_dir).select("term", F.round("idf_raw", 9).alias("idf"))


@query("document_norms", f"WITH {STATS} SELECT doc_id, round(sqrt(sum(power((1 + ln(tf)) * idf_smooth, 2))), 6) AS norm FROM tf JOIN st USING (term) GROUP BY doc_id")
def document_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.stored_index(spark, sf_dir, ("body",))["norms"].select("doc_id", F.round("norm", 6).alias("norm"))


@query("frequent_terms", f"WITH {TOK} SELECT term, count(*) AS freq FROM tok GROUP BY term ORDER BY freq DESC, term LIMIT 50")
def frequent_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.token_rows(b.docs(spark, sf_dir), {"body": "body"}).groupBy("term").agg(F.count("*").alias("freq")).orderBy(F.desc("freq"), "term").limit(50)


@query("corpus_stats", f"WITH {D} SELECT count(*) AS n_docs, count(DISTINCT host) AS n_hosts, count(DISTINCT doc_type) AS n_types, round(avg((length(trim(body)) > 0 AND length(trim(title)) > 0)::INT), 6) AS readable_ratio FROM d")
def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.corpus_stats(b.docs(spark, sf_dir))


# --- scores -------------------------------------------------------------------------------------------


def _sims(spark: SparkSession, sf_dir: str, mode: str) -> DataFrame:
    return rank.field_cosines(b.stored_index(spark, sf_dir, ("body",), mode), list(TERMS), mode)


@query("vsm_cosine", f"WITH {_cosine('smooth')} SELECT doc_id, round(sim, 6) AS sim FROM sim")
def vsm_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sims(spark, sf_dir, "smooth").select("doc_id", F.round("sim", 6).alias("sim"))


@query("vsm_cosine_ltc", f"WITH {_cosine('ltc')} SELECT doc_id, round(sim, 6) AS sim FROM sim")
def vsm_cosine_ltc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sims(spark, sf_dir, "ltc").select("doc_id", F.round("sim", 6).alias("sim"))


FUSION = rf"""{D}, tok AS (SELECT doc_id, 'title' AS field, unnest({TITLE_TOKENS}) AS term FROM d UNION ALL SELECT doc_id, 'body', unnest(regexp_extract_all(lower(body), '[\p{{L}}\p{{N}}]+')) FROM d),
tf AS (SELECT doc_id, field, term, count(*) AS tf FROM tok GROUP BY ALL), n AS (SELECT count(*) AS n FROM d),
st AS (SELECT term, ln((max(n) + 1) / (count(DISTINCT doc_id) + 1)) + 1 AS idf FROM tf, n GROUP BY term),
w AS (SELECT doc_id, field, term, (1 + ln(tf)) * idf AS w FROM tf JOIN st USING (term)), norm AS (SELECT doc_id, field, sqrt(sum(w * w)) AS norm FROM w GROUP BY ALL),
q AS (SELECT term, idf AS wq FROM st WHERE term IN {IN_TERMS}), qn AS (SELECT sqrt(sum(wq * wq)) AS qn FROM q),
sim AS (SELECT doc_id, field, coalesce(sum(w * wq) / nullif(max(norm) * max(qn), 0), 0) AS sim FROM w JOIN q USING (term) JOIN norm USING (doc_id, field), qn GROUP BY ALL),
vsm AS (SELECT doc_id, sum(CASE field WHEN 'title' THEN 4.0::DOUBLE ELSE 1.0::DOUBLE END * sim) AS vsm FROM sim GROUP BY doc_id)"""


def _vsm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.fused(rank.field_cosines(b.stored_index(spark, sf_dir), list(TERMS)), DEFAULT.field_weights)


@query("vsm_field_fusion", f"WITH {FUSION} SELECT doc_id, round(vsm, 6) AS vsm FROM vsm")
def vsm_field_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vsm(spark, sf_dir).select("doc_id", F.round("vsm", 6).alias("vsm"))


@query("recall_multi_field", f"WITH {FUSION} SELECT DISTINCT doc_id FROM tf WHERE term IN {IN_TERMS}")
def recall_multi_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recall.candidates(b.stored_index(spark, sf_dir)["postings"], list(TERMS))


@query("recall_top_k", f"WITH {_cosine('smooth')} SELECT doc_id, round(sim, 6) AS sim FROM sim ORDER BY round(sim, 6) DESC, doc_id LIMIT 100")
def recall_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vsm_cosine(spark, sf_dir).orderBy(F.desc("sim"), "doc_id").limit(100)


PR_CLICKS = _rank_sql("SELECT 'u' || user_id AS src, 'd' || (props->>'$.k') AS dst FROM events WHERE event_type = 'click' UNION SELECT 'd' || (props->>'$.k'), 'u' || user_id FROM events WHERE event_type = 'click'")
USER = 7
FINAL = f"""{FUSION}, {PR_CLICKS}, pr AS (SELECT substr(id, 2)::BIGINT AS doc_id, pr / (SELECT max(pr) FROM pr10) AS pr_hat FROM pr10 WHERE starts_with(id, 'd')),
fr AS (SELECT (props->>'$.k')::BIGINT AS doc_id, max(ts) AS fetched_at FROM events GROUP BY 1),
u AS (SELECT c_custkey AS user_id, ['undergraduate', 'graduate', 'teacher', 'alumnus', 'guest'][(c_custkey % 5 + 1)::INT] AS role, lower(c_mktsegment) AS interest FROM customer),
ck AS (SELECT DISTINCT user_id, (props->>'$.k')::BIGINT AS doc_id FROM events WHERE event_type = 'click'),
pers AS (SELECT u.user_id, d.doc_id, least(1.0, 0.4 * contains(lower(title || ' ' || body), interest)::INT + 0.3 * ((role IN ('undergraduate', 'graduate') AND doc_type IN ('en', 'es')) OR (role = 'teacher' AND doc_type IN ('de', 'fr')))::INT + 0.3 * (ck.doc_id IS NOT NULL)::INT)::DOUBLE AS pers
    FROM d CROSS JOIN u LEFT JOIN ck ON ck.user_id = u.user_id AND ck.doc_id = d.doc_id)"""


def _click_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = b.clicks(spark, sf_dir).select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("src"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("dst")).distinct()
    ranks = pagerank.normalised(pagerank.pagerank(pairs.union(pairs.select("dst", "src"))))
    return ranks.where(F.startswith("id", F.lit("d"))).select(F.substring("id", 2, 30).cast("bigint").alias("id"), "pr_hat")


def _pers(spark: SparkSession, sf_dir: str, docs: DataFrame, *users: int) -> DataFrame:
    return personal.personalised(docs, b.users(spark, sf_dir).where(F.col("user_id").isin(*users)), b.clicks(spark, sf_dir), BOUND)


@query("final_score", f"""WITH {FINAL} SELECT doc_id, round(vsm * (1 + 0.5 * ln(1 + coalesce(pr_hat, 0))) + 0.1 * coalesce(exp(-date_diff('day', fetched_at::DATE, DATE '{AS_OF}') / 180.0), 0) + 0.3 * pers, 6) AS score
FROM vsm LEFT JOIN pr USING (doc_id) LEFT JOIN fr USING (doc_id) JOIN (SELECT * FROM pers WHERE user_id = {USER}) USING (doc_id)""")
def final_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = b.docs(spark, sf_dir)
    rows = _vsm(spark, sf_dir).join(_click_ranks(spark, sf_dir).withColumnRenamed("id", "doc_id"), "doc_id", "left")
    rows = rows.join(b.fetched(spark, sf_dir), "doc_id", "left").join(_pers(spark, sf_dir, docs, USER), "doc_id")
    score = rank.final_score(F.col("vsm"), F.coalesce("pr_hat", F.lit(0.0)), rank.freshness(F.col("fetched_at"), AS_OF, DEFAULT.fresh_days), F.col("pers"))
    return rows.select("doc_id", F.round(score, 6).alias("score"))


@query("personalized_score", f"WITH {FINAL} SELECT user_id, doc_id, round(pers, 6) AS pers FROM pers WHERE user_id IN (2, 6, 7)")
def personalized_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pers(spark, sf_dir, b.docs(spark, sf_dir), 2, 6, 7).select("user_id", "doc_id", F.round("pers", 6).alias("pers"))


PERSONAS = f"""{FINAL}, p AS (SELECT CASE user_id WHEN 9 THEN 'guest' WHEN 5 THEN 'undergraduate' ELSE 'teacher' END AS persona, doc_id, doc_type, round(vsm + 0.3 * pers, 6) AS score FROM vsm JOIN pers USING (doc_id) JOIN d USING (doc_id) WHERE user_id IN (9, 5, 7)),
top AS (SELECT persona, row_number() OVER (PARTITION BY persona ORDER BY score DESC, doc_id) AS rn, doc_id, doc_type, score FROM p QUALIFY rn <= 10)"""


def _personas(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = b.users(spark, sf_dir).where(F.col("user_id").isin(9, 5, 7)).withColumn("persona", F.when(F.col("user_id") == 9, "guest").when(F.col("user_id") == 5, "undergraduate").otherwise("teacher"))
    return s.personas(b.docs(spark, sf_dir), " ".join(TERMS), users, b.clicks(spark, sf_dir), 10, BOUND, b.stored_index(spark, sf_dir))


@query("persona_top10", f"WITH {PERSONAS} SELECT persona, rn, doc_id, score FROM top")
def persona_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _personas(spark, sf_dir).select("persona", F.col("rn").cast("long").alias("rn"), "doc_id", "score")


@query("persona_type_mix", f"WITH {PERSONAS} SELECT persona, doc_type, count(*) AS n FROM top GROUP BY ALL")
def persona_type_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _personas(spark, sf_dir).groupBy("persona", "doc_type").agg(F.count("*").alias("n"))


@query("pagerank_links", f"WITH {LINKS}, {_rank_sql('SELECT src, dst FROM links')} SELECT id, round(pr, 9) AS pr FROM pr10")
def pagerank_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pagerank.pagerank(b.page_links(spark, sf_dir).select("src", "dst")).select("id", F.round("pr", 9).alias("pr"))


@query("pagerank_bipartite", f"WITH {_rank_sql("SELECT 's' || l_suppkey AS src, 'p' || l_partkey AS dst FROM lineitem UNION SELECT 'p' || l_partkey, 's' || l_suppkey FROM lineitem")} SELECT id, round(pr, 9) AS pr FROM pr10")
def pagerank_bipartite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pagerank.pagerank(b.dense_links(spark, sf_dir)).select("id", F.round("pr", 9).alias("pr"))


# --- predicates ---------------------------------------------------------------------------------------


def _match(spark: SparkSession, sf_dir: str, text: str, fields: tuple[str, ...] = ("title", "body")) -> DataFrame:
    """The index is needed, and made where there is none yet, for phrases and wildcards alone."""
    from tidewrack.plans.query import parse

    q = parse(text)
    return s.matching(b.docs(spark, sf_dir), q, b.stored_index(spark, sf_dir, fields) if q.phrases or q.wildcards else None).select("doc_id")


@query("search_site", f"WITH {_cosine('smooth')} SELECT doc_id, round(sim, 6) AS sim FROM sim JOIN documents USING (doc_id) WHERE lower(source) = 'src3'")
def search_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vsm_cosine(spark, sf_dir).join(_match(spark, sf_dir, "site:src3"), "doc_id", "left_semi")


@query("search_filetype", f"WITH {_cosine('smooth')} SELECT doc_id, round(sim, 6) AS sim FROM sim JOIN documents USING (doc_id) WHERE lang = 'de'")
def search_filetype(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vsm_cosine(spark, sf_dir).join(_match(spark, sf_dir, "filetype:DE"), "doc_id", "left_semi")


@query("search_phrase", rf"WITH t AS (SELECT doc_id, ' ' || array_to_string(regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}]+'), ' ') || ' ' AS t FROM documents) SELECT doc_id FROM t WHERE contains(t, ' of the ')")
def search_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _match(spark, sf_dir, '"of the"', ("body",))  # a title of 80 characters may end within a word, where the text has no such phrase


@query("search_phrase_positions", rf"""WITH t AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}]+') AS w FROM documents)
SELECT doc_id, (i - 1)::BIGINT AS pos FROM t, unnest(range(1, len(w))) AS r(i) WHERE w[i] = 'of' AND w[i + 1] = 'the'""")
def search_phrase_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = index.token_rows(b.docs(spark, sf_dir), {"body": "body"})
    return recall.phrase_by_positions(tokens, ["of", "the"]).select("doc_id", F.col("pos").cast("long").alias("pos"))


def _pattern_sql(pattern: str, lower: bool) -> str:
    low = (lambda x: f"lower({x})") if lower else (lambda x: x)
    fields = ("title", "body", "'doc://' || host || '/' || doc_id")
    return f"WITH {D} SELECT doc_id FROM d WHERE " + " OR ".join(f"regexp_matches({low(f)}, '{pattern}')" for f in fields)


@query("search_wildcard", _pattern_sql(recall.wildcard_pattern("li*se"), True))
def search_wildcard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _match(spark, sf_dir, "li*se")


@query("search_qmark", _pattern_sql(recall.wildcard_pattern("w?s"), True))
def search_qmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _match(spark, sf_dir, "w?s")


@query("search_regex", _pattern_sql("Licen.{0,2} [uU]nder|version [0-9]+", False))
def search_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _match(spark, sf_dir, "/Licen.{0,2} [uU]nder|version [0-9]+/")


@query("search_combined", f"WITH {_cosine('smooth')}, {D} SELECT doc_id, round(sim, 6) AS sim FROM sim JOIN d USING (doc_id) WHERE doc_type = 'en' AND " + "(" + _pattern_sql(recall.wildcard_pattern("li*se"), True).split("WHERE ")[1] + ")")
def search_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vsm_cosine(spark, sf_dir).join(_match(spark, sf_dir, "li*se filetype:en"), "doc_id", "left_semi")


@query("vocabulary_wildcard", f"WITH {STATS} SELECT DISTINCT doc_id FROM tf WHERE regexp_matches(term, '^th[\\p{{L}}\\p{{N}}]*ng$')")
def vocabulary_wildcard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recall.wildcard_hits(b.stored_index(spark, sf_dir, ("body",)), "th*ng")


# --- result lists -------------------------------------------------------------------------------------

SCORED = f"{D}, sc AS (SELECT doc_id, host, title, body, round(length(body) % 97 / 7.0, 6) AS score FROM d)"


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.docs(spark, sf_dir).withColumn("score", F.round(F.length("body") % 97 / 7.0, 6))


@query("dedup_signature", f"WITH {SCORED} SELECT doc_id, md5(title || left(body, 200)) AS signature, score FROM sc QUALIFY row_number() OVER (PARTITION BY md5(title || left(body, 200)) ORDER BY score DESC, doc_id) = 1")
def dedup_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.deduplicated(_scored(spark, sf_dir)).select("doc_id", "signature", "score")


TOP = f"{SCORED}, top AS (SELECT * FROM sc ORDER BY score DESC, doc_id LIMIT 1000), r AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS rn FROM top)"


@query("host_diversity", f"""WITH {TOP}, h AS (SELECT *, row_number() OVER (PARTITION BY host, rn <= 60 ORDER BY rn) AS hn FROM r), k AS (SELECT *, CASE WHEN rn <= 60 AND hn <= 3 THEN 0 WHEN rn <= 60 THEN 1 ELSE 2 END AS bucket FROM h)
SELECT doc_id, host, rn, bucket, row_number() OVER (ORDER BY bucket, rn) AS place FROM k""")
def host_diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = _scored(spark, sf_dir).orderBy(F.desc("score"), "doc_id").limit(1000)
    return rank.diversified(top).select("doc_id", "host", F.col("rn").cast("long").alias("rn"), "bucket", F.col("place").cast("long").alias("place"))


@query("host_diversity_output", f"""WITH {TOP}, h AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY rn) AS hn FROM r), k AS (SELECT *, sum((hn <= 3)::INT) OVER (ORDER BY rn) AS kr FROM h),
g AS (SELECT *, CASE WHEN hn <= 3 AND kr <= 60 THEN 0 ELSE 1 END AS bucket FROM k) SELECT doc_id, host, rn, bucket, row_number() OVER (ORDER BY bucket, rn) AS place FROM g""")
def host_diversity_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = _scored(spark, sf_dir).orderBy(F.desc("score"), "doc_id").limit(1000)
    return rank.diversified(top, by="output").select("doc_id", "host", F.col("rn").cast("long").alias("rn"), "bucket", F.col("place").cast("long").alias("place"))


@query("term_coverage", rf"WITH {D} SELECT doc_id, round(len(list_intersect(list_distinct(regexp_extract_all(lower(body), '[\p{{L}}\p{{N}}]+')), ['license', 'the', 'under'])) / 3.0, 6) AS coverage FROM d")
def term_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.docs(spark, sf_dir).select("doc_id", F.round(rank.coverage(tx.tokens(F.col("body")), list(TERMS)), 6).alias("coverage"))


@query("low_quality_flag", f"WITH {D} SELECT doc_id, regexp_matches(lower(title), '^(https?://|www\\.)') OR length(trim(body)) = 0 OR length(trim(title)) = 0 OR regexp_matches('doc://' || host || '/' || doc_id, '{urls.LOGIN}') AS low_quality FROM d")
def low_quality_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.docs(spark, sf_dir).select("doc_id", rank.low_quality(F.col("title"), F.col("body"), F.col("url")).alias("low_quality"))


@query("list_page_flag", f"WITH {D}, l AS (SELECT doc_id, list_filter(string_split(body, chr(10)), lambda x: length(trim(x)) > 0) AS lines FROM d) SELECT doc_id, len(lines) >= 8 AND len(list_filter(lines, lambda x: length(x) > 40)) = 0 AS list_page FROM l")
def list_page_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.docs(spark, sf_dir).select("doc_id", rank.list_page(F.col("title"), F.col("body")).alias("list_page"))


@query("title_fallback", rf"""WITH {D}, t AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'file-' || doc_id || '.pdf' ELSE title END AS title, list_filter(list_transform(regexp_split_to_array(body, '[。！？.!?\n]'), lambda x: trim(x)), lambda x: length(x) >= 4) AS ss FROM d)
SELECT doc_id, CASE WHEN length(trim(title)) = 0 OR regexp_matches(title, '(?i)^[\w%-]+\.(pdf|docx?|xlsx?)$') OR NOT regexp_matches(title, '[\p{{L}}]{{3}}') THEN coalesce(ss[1], title) ELSE title END AS title FROM t""")
def title_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("file-"), F.col("doc_id").cast("string"), F.lit(".pdf"))).otherwise(F.col("title"))
    return b.docs(spark, sf_dir).select("doc_id", rank.display_title(title, F.col("body")).alias("title"))


SNIPPET = rf"""{_cosine('smooth')}, c AS (SELECT doc_id, coalesce(text, '') AS body FROM documents WHERE doc_id IN (SELECT doc_id FROM sim ORDER BY round(sim, 6) DESC, doc_id LIMIT 60)),
p AS (SELECT doc_id, body, i AS n, pieces[i + 1] AS piece FROM (SELECT *, regexp_extract_all(body, '{tx.PIECE}') AS pieces FROM c), unnest(range(len(pieces))) AS t(i)),
o AS (SELECT *, coalesce(sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off FROM p), h AS (SELECT doc_id, body, off, lower(piece) AS term FROM o WHERE lower(piece) IN {IN_TERMS}),
g AS (SELECT a.doc_id, a.off, any_value(a.body) AS body, 3 * count(DISTINCT b.term) + count(*) - CASE WHEN a.off < 120 THEN 2 ELSE 0 END AS snippet_score FROM h a JOIN h b ON a.doc_id = b.doc_id AND b.off >= a.off AND b.off < a.off + 160 GROUP BY a.doc_id, a.off)"""


def _top60(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = vsm_cosine(spark, sf_dir).orderBy(F.desc("sim"), "doc_id").limit(60)
    return b.docs(spark, sf_dir).join(F.broadcast(best), "doc_id", "left_semi").select("doc_id", "body")  # 60 rows


@query("snippet_window", f"WITH {SNIPPET} SELECT doc_id, off, snippet_score, md5(substring(body, off + 1, 160)) AS snippet_md5 FROM g QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY snippet_score DESC, off) = 1")
def snippet_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.snippets(_top60(spark, sf_dir), list(TERMS)).select("doc_id", "off", "snippet_score", F.md5("snippet").alias("snippet_md5"))


@query("snippet_sentence", rf"""WITH {_cosine('smooth')}, c AS (SELECT doc_id, coalesce(text, '') AS body FROM documents WHERE doc_id IN (SELECT doc_id FROM sim ORDER BY round(sim, 6) DESC, doc_id LIMIT 60)),
x AS (SELECT doc_id, i::INT AS n, trim(ss[i + 1]) AS snippet FROM (SELECT doc_id, regexp_split_to_array(body, '[。！？.!?\n]') AS ss FROM c), unnest(range(len(ss))) AS t(i)),
y AS (SELECT *, list_filter(regexp_extract_all(lower(snippet), '[\p{{L}}\p{{N}}]+'), lambda w: w IN {IN_TERMS}) AS hits FROM x WHERE NOT regexp_matches(snippet, '{rank.NOISE_SENTENCE}'))
SELECT doc_id, n, 3 * len(list_distinct(hits)) + len(hits) AS snippet_score, md5(snippet) AS snippet_md5 FROM y WHERE len(hits) > 0 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY 3 * len(list_distinct(hits)) + len(hits) DESC, n) = 1""")
def snippet_sentence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.sentence_snippets(_top60(spark, sf_dir), list(TERMS)).select("doc_id", "n", "snippet_score", F.md5("snippet").alias("snippet_md5"))


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.docs(spark, sf_dir).join(vsm_cosine(spark, sf_dir), "doc_id", "left_semi").select("doc_id", "body")


def _every(sql: str) -> str:
    """A snippet query's SQL over every document with a hit, not the best 60."""
    return sql.replace(" ORDER BY round(sim, 6) DESC, doc_id LIMIT 60", "")


@query("snippet_window_all", _every(SQL["snippet_window"]))
def snippet_window_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.snippets(_hits(spark, sf_dir), list(TERMS)).select("doc_id", "off", "snippet_score", F.md5("snippet").alias("snippet_md5"))


@query("snippet_sentence_all", _every(SQL["snippet_sentence"]))
def snippet_sentence_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.sentence_snippets(_hits(spark, sf_dir), list(TERMS)).select("doc_id", "n", "snippet_score", F.md5("snippet").alias("snippet_md5"))


@query("highlight", rf"WITH {D} SELECT doc_id, md5(regexp_replace(replace(replace(replace(title, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '(?i)(license|under|the)', '<mark>\1</mark>', 'g')) AS title_md5 FROM d")
def highlight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.docs(spark, sf_dir).select("doc_id", F.md5(tx.highlighted(F.col("title"), list(TERMS))).alias("title_md5"))


@query("encoding_repair", "SELECT doc_id, md5(text) AS text_md5, n_broken FROM (SELECT doc_id, text, octet_length(encode(text)) - length(text) AS n_broken FROM documents)")
def encoding_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text read as Latin-1 by mistake, and repaired; n_broken: the characters that the mistake added."""
    read = b.table(spark, sf_dir, "documents").withColumn("broken", F.decode(F.encode("text", "UTF-8"), "ISO-8859-1"))
    return read.select("doc_id", F.md5(tx.repair_encoding("broken")).alias("text_md5"), (F.length("broken") - F.length("text")).cast("long").alias("n_broken"))


@query("suggest_terms", rf"""WITH {D}, f AS (SELECT unnest(regexp_extract_all(lower(body), '[\p{{L}}\p{{N}}]+')) AS term FROM d),
s AS (SELECT title AS text, 'title' AS kind, count(*) AS freq FROM d WHERE starts_with(lower(title), 'th') GROUP BY title UNION ALL SELECT term, 'word', count(*) FROM f WHERE starts_with(term, 'th') GROUP BY term)
SELECT text, kind, freq FROM s ORDER BY freq DESC, text, kind LIMIT 20""")
def suggest_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = b.docs(spark, sf_dir)
    words = b.stored_index(spark, sf_dir, ("body",))["postings"].where(F.startswith("term", F.lit("th"))).groupBy("term").agg(F.sum("tf").alias("freq"))
    return personal.suggestions(docs, words, "Th", 20)


@query("recommend_related", rf"""WITH {D}, {TF}, r AS (SELECT t.doc_id, count(DISTINCT t.term) AS shared FROM tf t JOIN (SELECT DISTINCT term FROM tf WHERE doc_id = 11) o USING (term) WHERE t.doc_id <> 11 GROUP BY t.doc_id),
x AS (SELECT doc_id, shared, doc_type, contains(lower(title || ' ' || body), 'machinery') AS i, contains(lower(title || ' ' || body), 'license') AS t FROM r JOIN d USING (doc_id))
SELECT doc_id, shared, round(shared / 10.0 + 2.0 * i::INT + 1.0 * t::INT + 0.5 * (doc_type IN ('de', 'fr'))::INT, 6)::DOUBLE AS score, concat_ws(',', CASE WHEN i THEN 'interest' END, CASE WHEN t THEN 'same topic' END, CASE WHEN doc_type IN ('de', 'fr') THEN 'document resource' END) AS reasons
FROM x ORDER BY score DESC, doc_id LIMIT 20""")
def recommend_related(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = b.docs(spark, sf_dir)
    return personal.recommendations(docs, b.stored_index(spark, sf_dir, ("body",))["postings"], 11, 20, ["machinery"], "teacher", ["license"], config=BOUND)


@query("search_results", None)
def search_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole search: no SQL, as it is the composition of the operators above; tests hold it against them."""
    docs = b.docs(spark, sf_dir).join(b.fetched(spark, sf_dir), "doc_id", "left")
    pers = _pers(spark, sf_dir, b.docs(spark, sf_dir), USER)
    return s.search(docs, " ".join(TERMS), b.stored_index(spark, sf_dir), pr_hat=_click_ranks(spark, sf_dir), pers=pers, as_of=AS_OF, config=BOUND)


LEGAL = replace(BOUND, intents={"legal": ("license", "version")})
_PHRASE = "contains(' ' || array_to_string(regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}]+'), ' ') || ' ', ' license under the ')"
SIGNALS = f"""{FINAL}, got AS (SELECT doc_id, count(DISTINCT term) FILTER (WHERE term IN {IN_TERMS}) / 3.0 AS coverage, bool_or(term IN ('license', 'version')) AS intent, bool_or(field = 'title' AND term IN {IN_TERMS}) AS title_hit FROM tf WHERE term IN {IN_TERMS} OR term = 'version' GROUP BY doc_id),
ln AS (SELECT doc_id, list_filter(string_split(body, chr(10)), lambda x: length(trim(x)) > 0) AS lines FROM d),
sg AS (SELECT doc_id, host, title, body, vsm, coalesce(pr_hat, 0) AS pr_hat, coalesce(exp(-date_diff('day', fetched_at::DATE, DATE '{AS_OF}') / 180.0), 0) AS fresh, pers, intent, coverage, title_hit, {_PHRASE.format("title")} OR {_PHRASE.format("body")} AS exact,
    regexp_matches(lower(title), '^(https?://|www\\.)') OR length(trim(body)) = 0 OR length(trim(title)) = 0 OR regexp_matches('doc://' || host || '/' || doc_id, '{urls.LOGIN}') AS low_quality, len(lines) >= 8 AND len(list_filter(lines, lambda x: length(x) > 40)) = 0 AS list_page
    FROM vsm JOIN d USING (doc_id) JOIN got USING (doc_id) JOIN ln USING (doc_id) LEFT JOIN pr USING (doc_id) LEFT JOIN fr USING (doc_id) JOIN (SELECT doc_id, pers FROM pers WHERE user_id = {USER}) USING (doc_id)),
fs AS (SELECT *, round((vsm * (1 + 0.5 * ln(1 + pr_hat)) + 0.1 * fresh + 0.3 * pers + 0.2 * intent::INT + 0.3 * exact::INT + 0.2 * coverage + 0.2 * title_hit::INT) * (CASE WHEN low_quality THEN 0.3 ELSE 1.0 END)::DOUBLE * (CASE WHEN list_page THEN 0.7 ELSE 1.0 END)::DOUBLE, 9) AS score FROM sg)"""
RANKED = f"""{SIGNALS}, top AS (SELECT * FROM fs ORDER BY score DESC, doc_id LIMIT 1000), dd AS (SELECT * FROM top QUALIFY row_number() OVER (PARTITION BY md5(title || left(body, 200)) ORDER BY score DESC, doc_id) = 1),
r AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS rn FROM dd), h AS (SELECT *, row_number() OVER (PARTITION BY host, rn <= 60 ORDER BY rn) AS hn FROM r),
k AS (SELECT *, CASE WHEN rn <= 60 AND hn <= 3 THEN 0 WHEN rn <= 60 THEN 1 ELSE 2 END AS bucket FROM h), o AS (SELECT *, row_number() OVER (ORDER BY bucket, rn) AS place FROM k)"""


def _legal(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    docs = b.docs(spark, sf_dir).join(b.fetched(spark, sf_dir), "doc_id", "left")
    return s.search(docs, " ".join(TERMS), b.stored_index(spark, sf_dir), pr_hat=_click_ranks(spark, sf_dir), pers=_pers(spark, sf_dir, b.docs(spark, sf_dir), USER), as_of=AS_OF, n=n, config=LEGAL)


@query("search_ranked", f"WITH {RANKED} SELECT place, doc_id, round(score, 6) AS score FROM o WHERE place <= 60")
def search_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole search with every signal and correction, duplicates out and hosts spread."""
    return _legal(spark, sf_dir, 60).select(F.col("place").cast("long").alias("place"), "doc_id", F.round("score", 6).alias("score"))


@query("search_explained", f"WITH {RANKED} SELECT place, doc_id, intent, exact, round(coverage, 6)::DOUBLE AS coverage, title_hit, low_quality, list_page, round(vsm, 6) AS vsm, round(pr_hat, 6)::DOUBLE AS pr_hat, round(fresh, 6)::DOUBLE AS fresh, round(pers, 6) AS pers FROM o")
def search_explained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why each result stands where it does: the signals that its score is made of."""
    rows = _legal(spark, sf_dir, LEGAL.recall)
    flags = [F.col(f"signals.{k}").alias(k) for k in ("intent", "exact", "title_hit", "low_quality", "list_page")]
    return rows.select(F.col("place").cast("long").alias("place"), "doc_id", *flags, *(F.round(f"signals.{k}", 6).alias(k) for k in ("coverage", "vsm", "pr_hat", "fresh", "pers")))


HAN_LETTERS, HAN_SIGNS = "etaoin", "图书馆选课信"
HAN_TERMS = ("图书", "图", "书", "选课", "选", "课")
HAN = rf"""hd AS (SELECT doc_id, translate(lower(coalesce(text, '')), '{HAN_LETTERS}', '{HAN_SIGNS}') AS x FROM documents),
hr AS (SELECT doc_id, unnest(regexp_extract_all(x, '\p{{Han}}+')) AS r FROM hd),
ht AS (SELECT doc_id, unnest(regexp_extract_all(x, '\p{{Han}}')) AS term FROM hd UNION ALL SELECT doc_id, unnest(list_transform(range(1, length(r)), lambda i: substr(r, i, 2))) FROM hr
    UNION ALL SELECT doc_id, unnest(regexp_extract_all(regexp_replace(x, '\p{{Han}}', ' ', 'g'), '[\p{{L}}\p{{N}}]+')) FROM hd),
tf AS (SELECT doc_id, term, count(*) AS tf FROM ht GROUP BY ALL), n AS (SELECT count(*) AS n FROM documents), st AS (SELECT term, ln((max(n) + 1) / (count(*) + 1)) + 1 AS idf FROM tf, n GROUP BY term),
w AS (SELECT doc_id, term, (1 + ln(tf)) * idf AS w FROM tf JOIN st USING (term)), norm AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM w GROUP BY doc_id),
q AS (SELECT term, idf AS wq FROM st WHERE term IN {HAN_TERMS}), qn AS (SELECT sqrt(sum(wq * wq)) AS qn FROM q)"""


def _han(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents with six letters written as Chinese characters, so that runs of them stand among other letters."""
    return b.docs(spark, sf_dir).withColumn("body", F.translate(F.lower("body"), HAN_LETTERS, HAN_SIGNS))


def _han_index(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    write = lambda path: index.store_index(_han(spark, sf_dir), {"body": "body"}, path)
    return index.stored_index(spark, kept(spark, "index-han", f"{sf_dir}/documents.parquet", write))


@query("han_cosine", f"WITH {HAN} SELECT doc_id, round(sum(w * wq) / (max(norm) * max(qn)), 6) AS sim FROM w JOIN q USING (term) JOIN norm USING (doc_id), qn GROUP BY doc_id")
def han_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewrack.plans.query import parse

    return rank.field_cosines(_han_index(spark, sf_dir), parse("图书 选课").terms).select("doc_id", F.round("sim", 6).alias("sim"))


@query("han_phrase", f"WITH {HAN} SELECT doc_id FROM hd WHERE contains(x, '图选课') OR regexp_matches(x, '图[^\\p{{L}}\\p{{N}}]*选[^\\p{{L}}\\p{{N}}]*课')")
def han_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewrack.plans.query import parse

    docs = _han(spark, sf_dir).select("doc_id", "url", "host", "doc_type", "body")
    return s.matching(docs, parse("“图选课”"), _han_index(spark, sf_dir)).select("doc_id")


@query("han_snippet", rf"""WITH hd AS (SELECT doc_id, translate(lower(coalesce(text, '')), '{HAN_LETTERS}', '{HAN_SIGNS}') AS x FROM documents), f AS (SELECT doc_id, x, strpos(x, '图选课') AS pos FROM hd WHERE contains(x, '图选课'))
SELECT doc_id, contains(substr(x, pos, 160), '图选课') AS shown FROM f""")
def han_snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the snippet of each document that has a Han phrase shows one of its pairs."""
    docs = _han(spark, sf_dir).where(F.contains("body", F.lit("图选课"))).select("doc_id", "body")
    return rank.snippets(docs, ["图选", "选课"]).select("doc_id", F.rlike("snippet", F.lit("图选|选课")).alias("shown"))


FIELDS4 = rf"""{LINKS}, pg AS (SELECT page_id AS doc_id, {HOST} || {PATH} AS url, {_plain("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")} AS title, {_plain(f"regexp_replace(html, '{html.DROPPED}', ' ', 'g')")} AS body FROM pages),
an AS (SELECT dst, array_to_string(list_sort(list(anchor)), ' ') AS anchor_text FROM links GROUP BY dst), al AS (SELECT doc_id, url, title, body, coalesce(anchor_text, '') AS anchor_text, CASE WHEN doc_id % 2 = 0 THEN body ELSE '' END AS attachment_text FROM pg LEFT JOIN an ON an.dst = pg.url),
tok AS (SELECT doc_id, f.field, unnest(regexp_extract_all(lower(f.x), '[\p{{L}}\p{{N}}]+')) AS term FROM (SELECT doc_id, unnest([{{'field': 'title', 'x': title}}, {{'field': 'anchor', 'x': anchor_text}}, {{'field': 'attachment', 'x': attachment_text}}, {{'field': 'body', 'x': body}}]) AS f FROM al)),
tf AS (SELECT doc_id, field, term, count(*) AS tf FROM tok GROUP BY ALL), n AS (SELECT count(*) AS n FROM al), st AS (SELECT term, ln((max(n) + 1) / (count(DISTINCT doc_id) + 1)) + 1 AS idf FROM tf, n GROUP BY term),
w AS (SELECT doc_id, field, term, (1 + ln(tf)) * idf AS w FROM tf JOIN st USING (term)), norm AS (SELECT doc_id, field, sqrt(sum(w * w)) AS norm FROM w GROUP BY ALL),
q AS (SELECT term, idf AS wq FROM st WHERE term IN {IN_TERMS}), qn AS (SELECT sqrt(sum(wq * wq)) AS qn FROM q), sim AS (SELECT doc_id, field, sum(w * wq) / (max(norm) * max(qn)) AS sim FROM w JOIN q USING (term) JOIN norm USING (doc_id, field), qn GROUP BY ALL)"""


@query("page_field_fusion", f"WITH {FIELDS4} SELECT doc_id, round(sum(CASE field WHEN 'title' THEN 4.0 WHEN 'anchor' THEN 3.0 WHEN 'attachment' THEN 1.5 ELSE 1.0 END::DOUBLE * sim), 6) AS vsm FROM sim GROUP BY doc_id")
def page_field_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by all four fields: title, anchors of the links to them, attachment text (every second page stands for one) and body."""
    p = b.table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.concat(urls.host(F.col("url")), urls.path(F.col("url"))).alias("url"), html.title(F.col("html")).alias("title"), html.body(F.col("html")).alias("body"))
    docs = index.with_anchors(p, b.page_links(spark, sf_dir)).withColumn("attachment_text", F.when(F.col("doc_id") % 2 == 0, F.col("body")).otherwise(""))
    ix = index.build_index(docs, {"title": "title", "anchor": "anchor_text", "attachment": "attachment_text", "body": "body"})
    return rank.fused(rank.field_cosines(ix, list(TERMS)), DEFAULT.field_weights).select("doc_id", F.round("vsm", 6).alias("vsm"))


@query("docs_with_anchors", f"WITH {LINKS}, pg AS (SELECT page_id AS doc_id, {HOST} || {PATH} AS url FROM pages UNION ALL SELECT 1000000 + row_number() OVER (ORDER BY dst), dst FROM (SELECT DISTINCT dst FROM links)) SELECT url, count(dst) > 0 AS linked, coalesce(array_to_string(list_sort(list(anchor) FILTER (WHERE dst IS NOT NULL)), ' '), '') AS anchor_text, count(DISTINCT src) AS inlinks_count FROM (SELECT DISTINCT url FROM pg) LEFT JOIN links ON dst = url GROUP BY url")
def docs_with_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = b.page_links(spark, sf_dir)
    own = b.table(spark, sf_dir, "pages").select(F.concat(urls.host(F.col("url")), urls.path(F.col("url"))).alias("url"))
    docs = own.union(links.select("dst")).distinct()
    return index.with_anchors(docs, links).select("url", (F.col("inlinks_count") > 0).alias("linked"), "anchor_text", "inlinks_count")


@query("frontier_dry_run", f"""WITH {FRONTIER}, s AS (SELECT url, host, priority FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY priority DESC, source) AS n FROM (SELECT url, host, priority, 'links' AS source FROM f UNION ALL SELECT {ORIGIN} || {PATH}, {HOST}, 10, 'pages' FROM pages)) WHERE n = 1),
k AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY priority DESC, url) AS host_rank FROM s WHERE NOT regexp_matches(url, '{urls.NOISE}') AND url NOT IN (SELECT url FROM f WHERE priority > 1)) SELECT url, host_rank FROM k WHERE host_rank <= 4 ORDER BY host_rank, priority DESC, url LIMIT 200""")
def frontier_dry_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _frontier(spark, sf_dir)
    p = b.pages(spark, sf_dir).select(F.concat(urls.origin(F.col("url")), urls.path(F.col("url"))).alias("url"), "host", F.lit(10).cast("long").alias("priority"), F.lit("pages").alias("source"))
    return frontier.prepared([f.withColumn("source", F.lit("links")), p], f.where("priority > 1"), 4, 200).select("url", F.col("host_rank").cast("long").alias("host_rank"))


@query("robots_allowed", f"WITH {FRONTIER} SELECT url FROM f WHERE NOT (length(host) % 2 = 0 AND regexp_matches(regexp_replace(url, '^http://[^/]+', ''), '^/[a-m]'))")
def robots_allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts of an even length forbid paths that begin with a to m; others have no robots.txt."""
    from tidewrack.sources import robots

    f = _frontier(spark, sf_dir)
    text = F.lit("User-agent: *\n" + "".join(f"Disallow: /{c}\n" for c in "abcdefghijklm"))
    rules = f.select("host").distinct().where(F.length("host") % 2 == 0).select("host", text.alias("robots_txt"))
    return robots.allowed(f, rules, "crawler").select("url")


@query("selfcheck", f"""WITH {FUSION}, b1 AS (SELECT doc_id, body FROM d) SELECT 'documents' AS name, count(*)::DOUBLE AS measured FROM d UNION ALL SELECT 'site', count(*) FROM d WHERE lower(host) = 'src3' UNION ALL SELECT 'filetype', count(*) FROM d WHERE doc_type = 'de'
UNION ALL SELECT 'phrase', count(*) FROM d WHERE {_PHRASE.format("body").replace("license under the", "of the")} OR {_PHRASE.format("title").replace("license under the", "of the")}
UNION ALL SELECT 'wildcard', count(*) FROM ({"SELECT doc_id FROM d WHERE " + _pattern_sql(recall.wildcard_pattern("li*se"), True).split("WHERE ")[1]})
UNION ALL SELECT 'regex', count(*) FROM d WHERE {_pattern_sql("version [0-9]+", False).split("WHERE ")[1]}
UNION ALL SELECT 'snapshot', count(DISTINCT md5(url)) FROM pages UNION ALL SELECT 'self cosine', 1.0 UNION ALL SELECT 'ranked', least(60, count(*)) FROM vsm
UNION ALL SELECT 'suggest', least(20, count(DISTINCT term)) FROM tf WHERE field = 'body' AND starts_with(term, 'th')""")
def selfcheck(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The acceptance run: what each part of the engine finds on the tables, one row for each check."""
    from tidewrack.plans.selfcheck import measured

    return measured(b.docs(spark, sf_dir), b.table(spark, sf_dir, "pages"), b.stored_index(spark, sf_dir), " ".join(TERMS), "src3", "de", '"of the"', "li*se", "/version [0-9]+/", "th")


@query("known_item", rf"""WITH t AS (SELECT item_id, doc_id FROM (SELECT item_id, ' ' || array_to_string(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+'), ' ') || ' ' AS b FROM benchmark),
    (SELECT doc_id, ' ' || array_to_string(regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}]+'), ' ') || ' ' AS x FROM documents) WHERE contains(x, b)) SELECT item_id, count(DISTINCT doc_id) AS n_docs FROM t GROUP BY item_id""")
def known_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents hold each benchmark passage: its first eight words (all of a shorter one) meet the documents' in an equi-join, then the whole passage is checked.

    Lengths of shorter passages, seven at most, are read first; a document is keyed for those and for eight words.
    """
    k = 8
    own = b.table(spark, sf_dir, "benchmark").select("item_id", tx.tokens(F.col("text")).alias("w"), F.least(F.size(tx.tokens(F.col("text"))), F.lit(k)).alias("k"))
    sizes = sorted(r.k for r in own.select("k").distinct().collect())
    own = own.select("item_id", F.xxhash64("k", F.slice("w", 1, k)).alias("key"), tx.joined(F.col("w")).alias("passage"))
    words = b.docs(spark, sf_dir).select("doc_id", tx.tokens(F.col("body")).alias("w"))
    keys = lambda n: F.transform(F.sequence(F.lit(1), F.size("w") - (n - 1)), lambda i: F.xxhash64(F.lit(n), F.slice("w", i, n)))
    each = [F.when(F.size("w") >= n, keys(n)).otherwise(F.array().cast("array<bigint>")) if n else F.array(F.xxhash64(F.lit(0), F.slice("w", 1, 0))) for n in sizes]
    hit = words.select("doc_id", F.explode(F.array_distinct(F.concat(*each))).alias("key")).join(own.select("key", "item_id"), "key").select("doc_id", "item_id").distinct() if sizes else None
    if hit is None:
        return own.select("item_id", F.lit(0).cast("long").alias("n_docs")).limit(0)
    rows = words.join(hit, "doc_id").join(own.select("item_id", "passage"), "item_id")
    return rows.where(F.contains(tx.joined(F.col("w")), F.col("passage"))).groupBy("item_id").agg(F.countDistinct("doc_id").alias("n_docs"))


# --- logs ---------------------------------------------------------------------------------------------


@query("recent_history", "SELECT user_id, rn, event_id, q FROM (SELECT user_id, event_id, (props->>'$.k')::BIGINT AS q, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS rn FROM events WHERE event_type = 'view') WHERE rn <= 5")
def recent_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.recent(b.query_log(spark, sf_dir), 5, "event_id").select("user_id", F.col("rn").cast("long").alias("rn"), "event_id", "q")


@query("click_counts", "SELECT user_id, (props->>'$.k')::BIGINT AS doc_id, count(*) AS clicks FROM events WHERE event_type = 'click' GROUP BY ALL")
def click_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.click_counts(b.clicks(spark, sf_dir))


@query("query_log_clear", "SELECT event_id, user_id FROM events WHERE event_type = 'view' AND user_id <> 7")
def query_log_clear(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewrack.sources.tables import cleared

    return cleared(b.query_log(spark, sf_dir), 7).select("event_id", "user_id")


@query("events_tumbling", "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def events_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.hourly_counts(b.table(spark, sf_dir, "events")).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("events_sessions", """WITH o AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
k AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM o) SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n FROM k GROUP BY user_id, k""")
def events_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = logs.sessions(b.table(spark, sf_dir, "events"))
    return out.select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), F.col("session_end").cast("timestamp_ntz").alias("session_end"), "n")


@query("unique_clicks", "SELECT DISTINCT event_id, user_id FROM events WHERE event_type = 'click'")
def unique_clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.unique_clicks(b.table(spark, sf_dir, "events")).select("event_id", "user_id")


# --- small things that go with them -----------------------------------------------------------------------


@query("result_page", f"WITH {_cosine('smooth')} SELECT doc_id, round(sim, 6) AS sim FROM sim ORDER BY round(sim, 6) DESC, doc_id LIMIT 10 OFFSET 20")
def result_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.page(vsm_cosine(spark, sf_dir).orderBy(F.desc("sim"), "doc_id"), 3, 10)


@query("attachment_lookup", "SELECT page_id, 'attachments/' || md5(url) || '.pdf' AS path FROM pages WHERE page_id = 12")
def attachment_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = b.table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("/old/attachments/"), F.md5("url"), F.lit(".pdf")).alias("path"))
    return stored.where("page_id = 12").select("page_id", F.regexp_replace(urls.relocated(F.col("path"), "."), r"^\./", "").alias("path"))


@query("emails_found", r"SELECT doc_id, array_to_string(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}'), ',') AS emails FROM documents WHERE regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}')")
def emails_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pattern = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
    return b.table(spark, sf_dir, "documents").where(F.rlike("text", F.lit(pattern))).select("doc_id", F.array_join(F.regexp_extract_all("text", F.lit(pattern), 0), ",").alias("emails"))


@query("type_shares", "SELECT lang AS doc_type, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6)::DOUBLE AS percent FROM documents GROUP BY lang")
def type_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The total is taken over the few grouped rows."""
    from pyspark.sql import Window

    counts = b.docs(spark, sf_dir).groupBy("doc_type").agg(F.count("*").alias("n"))
    return counts.withColumn("percent", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))), 6))


@query("clicks_running", "SELECT user_id, event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS clicks FROM events WHERE event_type = 'click'")
def clicks_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return b.clicks(spark, sf_dir).select("user_id", "event_id", F.count("*").over(w).alias("clicks"))
