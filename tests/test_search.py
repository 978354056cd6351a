"""Hand-made corpus: scores by hand, predicates, diversity, snippets, the parts of the search in one plan."""

import datetime as dt
import random
import re
from math import log, sqrt

import pytest
from pyspark.sql import functions as F

from tidewrack.config import DEFAULT
from tidewrack.functions import text as tx
from tidewrack.operators import frontier, index, pagerank, personal, rank, recall
from tidewrack.plans.query import parse, words
from tidewrack.plans.search import matching, personas, search
from tidewrack.sources.html import read_page

DOCS = [
    (1, "http://a.edu/1", "a.edu", "html", "Exam notice", "The exam of the library is open. Exam rooms are listed.", "exam", "", None),
    (2, "http://b.a.edu/2", "b.a.edu", "pdf", "Library rules", "Rules of the library and its reading rooms.", "", "library opening hours", None),
    (3, "http://c.edu/3", "c.edu", "html", "信息公开", "南开大学信息与公开制度，信息化建设。", "", "", None),
    (4, "http://c.edu/login", "c.edu", "docx", "http://c.edu/login", "", "", "", dt.datetime(2024, 1, 31)),
]
SCHEMA = "doc_id long, url string, host string, doc_type string, title string, body string, anchor_text string, attachment_text string, fetched_at timestamp"
FIELDS = {"title": "title", "anchor": "anchor_text", "attachment": "attachment_text", "body": "body"}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, SCHEMA).repartition(2)


def ids(df):
    return sorted(r.doc_id for r in df.collect())


def test_idf_and_cosine_by_hand(spark, docs):
    ix = index.build_index(docs, FIELDS)
    df = {r.term: (r.df, r.idf_smooth, r.idf_raw) for r in ix["stats"].collect()}
    assert df["library"][0] == 2
    assert df["library"][1] == pytest.approx(log(5 / 3) + 1)
    assert df["library"][2] == pytest.approx(log(4 / 2))
    sims = {(r.doc_id, r.field): r.sim for r in rank.field_cosines(ix, ["library", "rules"]).collect()}
    assert sims[(2, "title")] == pytest.approx(1.0)
    w = log(5 / 2) + 1
    v = log(5 / 3) + 1
    assert sims[(1, "body")] < 1
    q = sqrt(w * w + v * v)
    hours = sqrt(v * v + 2 * w * w)
    assert sims[(2, "attachment")] == pytest.approx(v * v / (q * hours))
    vsm = {r.doc_id: r.vsm for r in rank.fused(rank.field_cosines(ix, ["library", "rules"]), DEFAULT.field_weights).collect()}
    assert vsm[2] == pytest.approx(4 * 1 + 1.5 * sims[(2, "attachment")] + sims[(2, "body")])
    assert all(0 <= s <= 1 + 1e-9 for s in sims.values())


def test_ltc_and_zero_norm(spark):
    two = spark.createDataFrame([(1, "x y"), (2, "x z")], "doc_id long, body string")
    ix = index.build_index(two, {"body": "body"}, "ltc")
    assert {r.sim for r in rank.field_cosines(ix, ["x"], "ltc").collect()} == {0.0}  # x is in every document
    assert rank.field_cosines(ix, []).count() == 0


def test_query_grammar():
    q = parse('exam "of the" “图书 馆” site:a.edu filetype:PDF li* w?s /a.{0,2}b/')
    assert (q.site, q.filetype, q.wildcards, q.regexes, q.phrases) == ("a.edu", "PDF", ["li*", "w?s"], ["a.{0,2}b"], ["of the", "图书 馆"])
    assert q.terms == ["exam", "of", "the", "图", "书", "图书", "馆"]
    assert words("ab信息c") == ["ab", "信", "息", "信息", "c"]
    with pytest.raises(Exception):
        parse("/(/")


def test_predicates(docs):
    assert ids(matching(docs, parse("site:a.edu"))) == [1, 2]
    assert ids(matching(docs, parse("site:edu filetype:docx"))) == [4]
    assert ids(matching(docs, parse('"of the library"'))) == [1, 2]
    assert ids(matching(docs, parse('"the of library"'))) == []
    assert ids(matching(docs, parse("libr*"))) == [1, 2]
    assert ids(matching(docs, parse("rul?s"))) == [2]
    assert ids(matching(docs, parse("ibr*"))) == []
    assert ids(matching(docs, parse("/信息.{0,2}/"))) == [3]
    assert ids(matching(docs, parse("“信息与公开”"))) == [3]
    assert ids(matching(docs, parse("“公开信息”"))) == []
    tokens = index.token_rows(docs, FIELDS)
    assert {(r.doc_id, r.field, r.pos) for r in recall.phrase_by_positions(tokens, ["of", "the", "library"]).collect()} == {(1, "body", 2), (2, "body", 1)}


def test_han_tokens(docs):
    row = docs.where("doc_id = 3").select(tx.search_tokens(F.col("title")).alias("t")).first()
    assert sorted(row.t) == sorted(["信", "息", "公", "开", "信息", "息公", "公开"])


def test_search_end_to_end(docs):
    rows = search(docs, "library", n=10).collect()
    assert [r.doc_id for r in rows][0] == 2
    assert rows[0].signals.vsm > 0 and "<mark>" in rows[0].snippet and rows[0].download
    assert search(docs, "library site:nowhere.org").count() == 0
    guest = [r.doc_id for r in rows]
    pers = docs.select("doc_id", F.when(F.col("doc_id") == 1, 1.0).otherwise(0.0).alias("pers"))
    assert search(docs, "library", pers=pers).where("doc_id = 1").first().score > [r for r in rows if r.doc_id == 1][0].score
    assert [r.doc_id for r in search(docs, "library", pers=pers.withColumn("pers", F.lit(0.0))).collect()] == guest
    with pytest.raises(ValueError):
        search(docs, "library", backend="es")


def test_low_quality_is_demoted_not_dropped(docs):
    rows = {r.doc_id: r for r in search(docs, "/edu/").collect()}
    assert set(rows) == {1, 2, 3, 4} and rows[4].signals.low_quality and not rows[1].signals.low_quality
    assert rows[4].signals.fresh == pytest.approx(2.718281828 ** (-1 / 180))


def test_title_fallback(spark):
    df = spark.createDataFrame([("scan_01.pdf", "。x\nReport on rooms. More."), ("Good title", "b"), (None, None)], "title string, body string")
    assert [r[0] for r in df.select(rank.display_title(F.col("title"), F.col("body"))).collect()] == ["Report on rooms", "Good title", None]


def test_pagerank_edge_cases(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "b"), ("b", "b"), ("b", "c"), ("c", "d"), ("e", "a"), (None, "a")], "src string, dst string")
    got = {r.id: r.pr for r in pagerank.pagerank(edges, iterations=20).collect()}
    want = dict.fromkeys("abcde", 0.2)
    links = {"a": ["b"], "b": ["c"], "c": ["d"], "e": ["a"]}
    for _ in range(20):
        lost = want["d"]
        want = {v: 0.15 / 5 + 0.85 * (sum(want[u] for u, out in links.items() if v in out) + lost / 5) for v in want}
    assert got == pytest.approx(want) and sum(got.values()) == pytest.approx(1)
    assert pagerank.pagerank(edges.limit(0)).count() == 0
    assert max(r.pr_hat for r in pagerank.normalised(pagerank.pagerank(edges)).collect()) == pytest.approx(1)


def test_diversity(spark):
    rows = [(i, f"h{i % 4}", float(100 - i // 2)) for i in range(70)]
    df = spark.createDataFrame(rows, "doc_id long, host string, score double")
    for by in ("input", "output"):
        out = rank.diversified(df, by=by).collect()
        assert sorted(r.doc_id for r in out) == list(range(70))
        first = [r for r in out if r.bucket == 0]
        assert len(first) == 12 and max(sum(r.host == h for r in first) for h in ("h0", "h1", "h2", "h3")) == 3
    with pytest.raises(ValueError):
        rank.diversified(df, by="x")


def test_dedup_keeps_best(spark):
    df = spark.createDataFrame([(1, "t", "nav " * 100 + "a", 1.0), (2, "t", "nav " * 100 + "b", 2.0), (3, "u", "x", 0.0)], "doc_id long, title string, body string, score double")
    assert ids(rank.deduplicated(df)) == [2, 3]


def test_snippet_avoids_navigation(spark):
    body = "exam menu " + "x " * 100 + "the exam of the library, exam library rooms " + "y " * 100
    row = rank.snippets(spark.createDataFrame([(1, body)], "doc_id long, body string"), ["exam", "library"]).first()
    assert body[row.off :].startswith("exam of the library") and row.snippet_score == 3 * 2 + 4
    s = rank.sentence_snippets(spark.createDataFrame([(1, "Copyright exam library.\nThe exam library. exam")], "doc_id long, body string"), ["exam", "library"]).first()
    assert s.snippet == "The exam library"


def test_personas_differ(docs, spark):
    users = spark.createDataFrame([("guest", 1, "guest", []), ("undergraduate", 2, "undergraduate", ["exam"]), ("teacher", 3, "teacher", ["rules"])], "persona string, user_id long, role string, interests array<string>")
    clicks = spark.createDataFrame([(3, 2)], "user_id long, doc_id long")
    rows = personas(docs, "library rooms", users, clicks).collect()
    best = {p: [r.doc_id for r in rows if r.persona == p] for p in ("guest", "undergraduate", "teacher")}
    score = {(r.persona, r.doc_id): r.score for r in rows}
    assert score["undergraduate", 1] > score["guest", 1] and score["teacher", 2] > score["guest", 2] and best["teacher"][0] == 2


def test_frontier(spark):
    f = spark.createDataFrame([("http://a/1", "a", 5, "s"), ("http://a/1", "a", 7, "t"), ("http://a/login", "a", 9, "s"), ("http://b/x.pdf", "b", 1, "s"), ("http://a/2", "a", 6, "s")], "url string, host string, priority long, source string")
    fetched = spark.createDataFrame([("http://a/2",)], "url string")
    assert [r.url for r in frontier.prepared([f, f], fetched, 2, 10).collect()] == ["http://a/1", "http://b/x.pdf"]
    assert frontier.html_only(f).where("host = 'b'").count() == 0
    assert frontier.merged([f]).where("url = 'http://a/1'").first().priority == 7


def test_reasons(docs):
    tf = index.term_frequencies(index.token_rows(docs, FIELDS))
    rows = personal.recommendations(docs, tf, 1, 5, ["rules"], "teacher", ["library"]).collect()
    assert rows[0].doc_id == 2 and rows[0].reasons == "interest,same topic,document resource"


def test_page_reader():
    title, text, links = read_page('<title>T</title><script>x</script><p>a<b>b<a href="/l">go <i>on</i></a>')
    assert title == "T" and "x" not in text and links == [("/l", "go on")]
    assert read_page(None) == ("", "", [])


def test_chinese_by_default(docs):
    rows = search(docs, "信息").collect()
    assert [r.doc_id for r in rows] == [3] and "<mark>信息</mark>" in rows[0].snippet
    late = docs.where("doc_id = 3").select("doc_id", F.concat(F.repeat(F.lit("其他内容。"), 60), F.lit("选课办法见通知。")).alias("body"))
    got = rank.snippets(late, words("选课")).first()
    assert got.off == 300 and got.snippet.startswith("选课办法")


def test_stored_index_answers_like_a_built_one(spark, docs, tmp_path):
    index.store_index(docs, FIELDS, str(tmp_path / "ix"), ("smooth", "ltc"))
    for mode in ("smooth", "ltc"):
        stored, built = index.stored_index(spark, str(tmp_path / "ix"), mode), index.build_index(docs, FIELDS, mode)
        for terms in (["library", "rules"], ["信息", "exam"], []):
            a, b = ({(r.doc_id, r.field): round(r.sim, 9) for r in rank.field_cosines(ix, terms, mode).collect()} for ix in (stored, built))
            assert a == b
    stored = index.stored_index(spark, str(tmp_path / "ix"))
    for q in ('"of the library"', '"the of library"', "libr*", "rul?s", "ibr*", "“信息与公开”", "“公开信息”", "信息*", "c.e*", "/Exam/ libr* site:a.edu", "ed?"):
        assert ids(matching(docs, parse(q), stored)) == ids(matching(docs, parse(q))), q
    plan = rank.field_cosines(stored, ["library"])._jdf.queryExecution().toString()
    assert "PushedFilters: [In(term, [library])" in plan or "EqualTo(term,library)" in plan


def test_title_boost_of_patterns(docs):
    rows = {r.doc_id: r for r in search(docs, "libr*").collect()}
    assert rows[2].signals.title_hit and not rows[1].signals.title_hit
    assert {r.doc_id: r.signals.title_hit for r in search(docs, "/Exam n/").collect()} == {1: True}


def shuffled(spark, run):
    """Bytes that run() shuffles."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty()
    empty = spark._jvm.java.util.ArrayList()
    total = lambda: sum(s.shuffleWriteBytes() for s in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(sc.statusStore().stageList(empty, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), empty)))
    before = total()
    run()
    sc.listenerBus().waitUntilEmpty()
    return total() - before


def made_up(spark, n, size):
    """n documents of `size` words, half of them in no other."""
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice("of the a in to".split()) if rng.random() < 0.5 else f"w{rng.getrandbits(40):x}" for _ in range(size))) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, body string").repartition(4)


def test_stored_index_is_made_where_documents_are(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "SEGMENT", 4000)
    monkeypatch.setattr(index, "HOT_TERMS", 3)
    rows = [(i, f"{'Of the library' if i % 3 else '图书 of'} x{i % 7}", f"The rules of it {'exam ' * (i % 4)}x{i} 选课 y{i % 5}") for i in range(300)]
    rows += [(7, "again of the", "of of 选课"), (8, None, None), (9, "", ""), (None, "of no one", "the same")]
    docs = spark.createDataFrame(rows, "doc_id long, title string, body string")
    fields = {"title": "title", "body": "body"}
    index.store_index(docs, fields, str(tmp_path), ("smooth", "ltc"))
    for mode in ("smooth", "ltc"):
        stored, built = index.stored_index(spark, str(tmp_path), mode), index.build_index(docs, fields, mode, positions=True)
        for part, key in (("postings", ("term", "doc_id", "field")), ("stats", ("term",)), ("norms", ("doc_id", "field"))):
            mine, theirs = ({tuple(r[k] for k in key): [round(x, 9) if isinstance(x, float) else x for x in r.asDict().values()] for r in ix[part].select(*key, *(c for c in sorted(built[part].columns) if c not in key)).collect()} for ix in (stored, built))
            assert mine == theirs, part
    files = stored["postings"].select("doc_id", "term", F.input_file_name().alias("file"))
    assert files.select("file").distinct().count() > 2
    assert files.select("doc_id", "file").distinct().count() == files.select("doc_id").distinct().count()  # a document lies in one segment
    for (file,) in files.select("file").distinct().collect():
        terms = [r.term.encode() for r in spark.read.parquet(file).select("term").collect()]
        assert terms == sorted(terms)


def test_index_shuffles_texts_and_their_rare_words_at_most(spark, tmp_path):
    docs = made_up(spark, 400, 500)
    size = docs.agg(F.sum(F.length("body"))).first()[0]
    assert shuffled(spark, lambda: index.store_index(docs, {"body": "body"}, str(tmp_path), ("smooth", "ltc"))) < 3.5 * size


def test_personal_scores_shuffle_no_texts(spark):
    docs = made_up(spark, 400, 500).select("doc_id", F.lit("t").alias("title"), "body", F.lit("html").alias("doc_type"))
    users = spark.createDataFrame([(1, "teacher", ["the"]), (2, "guest", ["zzz"])], "user_id long, role string, interests array<string>")
    clicks = spark.createDataFrame([(1, 3), (5, 3), (2, 4)], "user_id long, doc_id long")
    size = docs.agg(F.sum(F.length("body"))).first()[0]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert shuffled(spark, lambda: personal.personalised(docs.repartition(4), users, clicks).write.format("noop").mode("overwrite").save()) < 1.5 * size
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_snippets_hold_no_row_for_each_word(spark):
    docs = made_up(spark, 50, 500)
    plan = rank.snippets(docs, ["license"])
    assert plan.count() == 0
    odd = ["Xthe theX the-THE, the", "", None, "İthe the ſ", "选the课 选课the", "a选课b 选 课", "The\nlicense  the.", "ΣΑΣ ΣΑς", "c++ the+ +the"]
    rows = [(i, x) for i, x in enumerate(odd)]
    got = {r.doc_id: (r.off, r.snippet_score) for r in rank.snippets(spark.createDataFrame(rows, "doc_id long, body string"), ["the", "license", "选", "选课", "σας"]).collect()}
    assert got == {i: best for i, x in rows if (best := by_words(x or "", ["the", "license", "选", "选课", "σας"]))}
    sizes = [n for n in re.findall(r"posexplode\(([^()]*)", rank.snippets(docs, ["the"])._jdf.queryExecution().analyzed().toString())]
    assert sizes and not any("regexp_extract_all" in n for n in sizes)


def by_words(text, terms):
    """off, score of the best window, word by word."""
    han = "[㐀-鿿]"
    off, hits = 0, []
    pieces = re.findall(rf"{han}|(?:(?!{han})[^\W_])+|[\W_]+", text)
    for n, piece in enumerate(pieces):
        own = [piece.lower()]
        if re.fullmatch(han, piece) and n + 1 < len(pieces) and re.fullmatch(han, pieces[n + 1]):
            own.append(piece + pieces[n + 1])
        hits += [(off, t) for t in own if t in terms]
        off += len(piece)
    best = []
    for at, _ in hits:
        inside = [t for o, t in hits if at <= o < at + DEFAULT.snippet_chars]
        best.append((3 * len(set(inside)) + len(inside) - (DEFAULT.nav_penalty if at < DEFAULT.nav_chars else 0), -at))
    return (-max(best)[1], max(best)[0]) if best else None


def test_pagerank_shuffles_ranks_not_edges(spark):
    pairs = spark.range(200).select(F.concat(F.lit("a"), "id").alias("src")).crossJoin(spark.range(400).select(F.concat(F.lit("b"), "id").alias("dst")))
    edges = pairs.union(pairs.select("dst", "src"))  # 160,000, of 600 vertices
    once, all_ = (shuffled(spark, lambda n=n: pagerank.pagerank(edges, iterations=n)) for n in (1, 10))
    assert all_ < 2 * once
    got = {r.id: r.pr for r in pagerank.pagerank(edges).collect()}
    assert len(got) == 600 and sum(got.values()) == pytest.approx(1) and len({round(x, 12) for x in got.values()}) == 2
