import io
import zipfile

import pytest
from pyspark.sql import functions as F

from tidewrack.functions import text as tx
from tidewrack.functions import urls
from tidewrack.operators import frontier, index
from tidewrack.scratch import Scratch, shared_dir
from tidewrack.sources import attachments, html, robots, tables
from tidewrack.streaming import logs


def archive(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name, text)
    return out.getvalue()


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
DOCX = archive({"word/document.xml": f"<w:document {W}><w:p><w:r><w:t>Hello</w:t></w:r><w:r><w:t> world</w:t></w:r></w:p><w:p/><w:p><w:t>x</w:t></w:p></w:document>"})
XLSX = archive({"xl/sharedStrings.xml": f"<sst {S}><si><t>name</t></si></sst>", "xl/worksheets/sheet1.xml": f'<worksheet {S}><row><c t="s"><v>0</v></c><c><v>3</v></c></row></worksheet>'})


def test_attachments(spark, tmp_path):
    for name, data in {"a.docx": DOCX, "b.xlsx": XLSX, "c.doc": b"old", "d.docx": b"broken"}.items():
        (tmp_path / name).write_bytes(data)
    rows = {r.path.rsplit("/", 1)[-1]: r for r in attachments.read_attachments(spark, str(tmp_path)).collect()}
    assert rows["a.docx"].attachment_text == "Hello world\nx" and rows["b.xlsx"].attachment_text == "name\t3"
    assert rows["c.doc"].attachment_text is None and "no extractor" in rows["c.doc"].problem and "BadZipFile" in rows["d.docx"].problem


def test_robots(spark):
    f = spark.createDataFrame([("http://a/x", "a"), ("http://a/private/x", "a"), ("http://b/private/x", "b")], "url string, host string")
    r = spark.createDataFrame([("a", "User-agent: *\nDisallow: /private/")], "host string, robots_txt string")
    assert sorted(x.url for x in robots.allowed(f, r, "bot").collect()) == ["http://a/x", "http://b/private/x"]


def test_urls(spark):
    rows = spark.createDataFrame([("http://x.a.edu/d/f.PDF?q=1", "text/html"), ("http://a.edu", "application/msword; x"), ("http://nota.edu/#f", None)], "u string, c string")
    got = rows.select(urls.host(F.col("u")).alias("h"), urls.type_of(F.col("u"), F.col("c")).alias("t"), urls.inside(urls.host(F.col("u")), "a.edu").alias("i")).collect()
    assert [tuple(r) for r in got] == [("x.a.edu", "pdf", True), ("a.edu", "doc", True), ("nota.edu", "html", False)]
    joined = spark.createDataFrame([("http://a/b/c", "../d"), ("http://a", None), ("http://[", "x")], "b string, h string").select(urls.resolved(F.col("b"), F.col("h"))).collect()
    assert [r[0] for r in joined][:2] == ["http://a/d", None]
    moved = spark.createDataFrame([("C:\\d\\attachments\\x\\y.pdf",), ("/q/other",)], "p string").select(urls.relocated(F.col("p"), "/new/")).collect()
    assert [r[0] for r in moved] == ["/new/attachments/x/y.pdf", "/q/other"]


def test_repair():
    assert tx.repaired("ä¸\u00ad") == "中" and tx.repaired("clean") == "clean" and tx.repaired(None) is None
    assert tx.repaired("Ã¤ 中") == "Ã¤ 中" and tx.repaired("Ãx") == "Ãx"


def test_round_trips(spark, tmp_path):
    docs = spark.createDataFrame([("t", "b", "a", "", "http://x/1", "x", "html", "s", 0.5, 2)], tables.DOCUMENT)
    tables.write_documents_jsonl(docs, str(tmp_path / "d"))
    assert tables.read_documents_jsonl(spark, str(tmp_path / "d")).collect() == docs.collect()
    links = spark.createDataFrame([("s", "d", 'a "b"')], tables.LINK)
    tables.write_links_tsv(links, str(tmp_path / "l"))
    assert tables.read_links_tsv(spark, str(tmp_path / "l")).collect() == links.collect()
    (tmp_path / "f.txt").write_text("http://a/1\n\n http://a/2 \n")
    assert [r.url for r in tables.read_frontier(spark, str(tmp_path / "f.txt")).collect()] == ["http://a/1", "http://a/2"]
    pages = spark.createDataFrame([("http://x/1", '<a href="/l">')], "url string, html string").withColumn("fetched_at", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    tables.write_snapshots(pages, str(tmp_path / "s"))
    shown = tables.read_snapshot(spark, str(tmp_path / "s"), "http://x/1").first().html
    assert shown.startswith('<div class="snapshot-banner">2024-01-01') and '<a href="http://x/l">' in shown
    ix = index.build_index(spark.createDataFrame([(1, "a b a"), (2, "b")], "doc_id long, body string"), {"body": "body"}, positions=True)
    tables.write_index(ix, str(tmp_path / "ix"))
    back = tables.read_index(spark, str(tmp_path / "ix"))
    assert sorted(map(tuple, back["postings"].select("doc_id", "term", "tf").collect())) == [(1, "a", 2), (1, "b", 1), (2, "b", 1)]
    log = spark.createDataFrame([(1, "q"), (2, "r")], "user_id long, q string")
    tables.append_log(log, str(tmp_path / "log"))
    tables.append_log(log, str(tmp_path / "log"))
    assert tables.cleared(spark.read.parquet(str(tmp_path / "log")), 1).count() == 2


def test_anchors(spark):
    links = spark.createDataFrame([("a", "x", "two"), ("b", "x", "one"), ("a", "x", "one")], "src string, dst string, anchor string")
    docs = spark.createDataFrame([("x",), ("y",)], "url string")
    assert {(r.url, r.anchor_text, r.inlinks_count) for r in index.with_anchors(docs, links).collect()} == {("x", "one one two", 2), ("y", "", 0)}


def test_parsed_equals_builtin(spark):
    pages = spark.createDataFrame([("u", "<html><head><title>A &amp; b</title></head><body><p>x <b>y</b></p><a href='/q'>n</a></body></html>"), ("v", None)], "url string, html string")
    row = {r.url: r for r in html.parsed(pages).collect()}
    assert row["u"].title == "A & b" and row["u"].body == "x y n" and row["u"].links[0].href == "/q" and row["v"].body == ""


EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string"


def test_streams_equal_tables(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    for n, (f, mode) in enumerate(((logs.hourly_counts, "complete"), (logs.unique_clicks, "append"))):
        q = f(stream).writeStream.outputMode(mode).format("memory").queryName(f"out{n}").trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert spark.table(f"out{n}").count() == f(events).count()
    q = logs.sessions(stream).writeStream.outputMode("append").format("memory").queryName("sess").trigger(availableNow=True).start()
    q.awaitTermination(120)
    table = {tuple(r) for r in logs.sessions(events).collect()}
    closed = {tuple(r) for r in spark.table("sess").collect()}
    assert closed and closed <= table


def test_ingest_is_idempotent(spark, tmp_path):
    pages = spark.createDataFrame([("u1", "a"), ("u1", "b"), ("u2", "c")], "url string, html string")
    for _ in range(2):
        pages.write.mode("append").parquet(str(tmp_path / "land"))
        q = logs.ingest(spark, str(tmp_path / "land"), str(tmp_path / "to"), str(tmp_path / "cp"), "url string, html string")
        q.awaitTermination(120)
        assert q.exception() is None
    assert sorted(r.url for r in spark.read.parquet(str(tmp_path / "to")).collect()) == ["u1", "u2"]


class Session:
    """What shared_dir asks of a session."""

    def __init__(self, folder, master):
        self.conf = {"spark.checkpoint.dir": folder} if folder else {}
        self.sparkContext = type("Context", (), {"master": master, "applicationId": "app"})


def test_shared_folder_is_read_from_the_session(spark):
    assert shared_dir(Session("hdfs://x/y", "yarn")) == "hdfs://x/y"
    assert shared_dir(Session(None, "local[2]")) == shared_dir(Session(None, "local[2]"))
    with pytest.raises(RuntimeError):
        shared_dir(Session(None, "yarn"))
    s = Scratch(spark, "t")
    t = s.table(spark.range(3).toDF("id"))
    assert t.count() == 3 and t.scratch_path.startswith(shared_dir(spark))
    s.drop(t)
    with pytest.raises(Exception):
        t.collect()


def test_links_in_all_quotes_and_relative(spark):
    page = '<head><script>x</script><title>T</title></head><a href="/a">one</a> <a class=x href=\'b.html?q=1#f\'>two</a> <a href=../c>three</a><a href="//o.org/x/./y/">four</a><a href="#top">five</a><a href="mailto:a@b">six</a><a data-href="no">seven</a>'
    rows = html.links(spark.createDataFrame([("http://H.org/d/e/p.html", page)], "url string, html string")).select("href", urls.linked(F.col("url"), F.col("href")).alias("dst"), "anchor").collect()
    assert [(r.anchor, r.dst) for r in rows] == [("one", "h.org/a"), ("two", "h.org/d/e/b.html"), ("three", "h.org/d/c"), ("four", "o.org/x/y/"), ("five", None), ("six", None)]
    pairs = [("http://a", "x"), ("http://a/b/", "."), ("http://a/b/c", "../../../d"), ("http://a/b/c", "http://z.org"), ("http://a/b/c", ".."), ("x", "y"), (None, "y")]
    got = spark.createDataFrame(pairs, "b string, h string").select(urls.linked(F.col("b"), F.col("h")).alias("u")).collect()
    assert [r.u for r in got] == ["a/x", "a/b/", "a/d", "z.org/", "a/", None, None]
    assert spark.createDataFrame([(page,)], "h string").select(html.body(F.col("h"))).first()[0] == "one two three four five six seven"


def test_noise_names_whole_labels(spark):
    yes = ["http://a/login", "http://cas.a.edu/x", "http://a/x?redirect=1", "http://a/sso/y", "http://passport.a/", "http://a/logout.html"]
    no = ["http://a/professor", "http://a/lesson", "http://a/case-study", "http://a/forecast", "http://a/cascade", "http://casino-win.example.org/x"]
    left = frontier.without_noise(spark.createDataFrame([(u,) for u in yes + no], "url string")).collect()
    assert [r.url for r in left] == no


def test_clearing_keeps_unknown_users(spark):
    log = spark.createDataFrame([(1, "a"), (None, "b"), (2, "c")], "user_id long, q string")
    assert sorted(r.q for r in tables.cleared(log, 1).collect()) == ["b", "c"]
