"""A small corpus to try the engine on: pages and files of a made-up university in two languages."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tidewrack.sources import tables

TOPICS = (
    ("library", "Library rules", "Rules of the library, its reading rooms and its opening hours.", "图书馆开放时间", "图书馆的开放时间和借阅规则。"),
    ("courses", "Course selection", "How students select courses and where the exam dates stand.", "选课通知", "本学期选课通知与考试安排。"),
    ("admission", "Admission", "Who may apply, and the dates of admission.", "招生信息", "招生简章与报名时间。"),
    ("career", "Jobs and careers", "Job offers and career advice for graduates.", "就业信息", "毕业生就业信息与招聘会。"),
    ("research", "Research news", "News of research groups and their grants.", "科研动态", "科研项目申报与学术讲座。"),
)


def write(spark: SparkSession, out: str, each: int = 20) -> None:
    """documents (JSON lines), links (TSV), frontier (text) and snapshots under `out`: `each` pages of either language for each topic."""
    rows, links = [], []
    for n, (topic, title, body, han_title, han_body) in enumerate(TOPICS):
        host = f"{topic}.example.org"
        for i in range(each):
            for own, (t, text) in (("en", (title, body)), ("zh", (han_title, han_body))):
                kind = "pdf" if i % 5 == 0 else "html"
                url = f"http://{host}/{own}/{i}.{kind}"
                rows.append((f"{t} {i}", f"{text} {i}", t, text if kind == "pdf" else "", url, host, kind, "", 1.0 / (1 + n + i), i))
                links.append((url, f"http://{host}/{own}/{(i + 1) % each}.html", t))
    docs = spark.createDataFrame(rows, tables.DOCUMENT)
    tables.write_documents_jsonl(docs, f"{out}/documents")
    tables.write_links_tsv(spark.createDataFrame(links, tables.LINK), f"{out}/links")
    docs.select("url").write.mode("overwrite").text(f"{out}/frontier")
    page = F.concat(F.lit("<html><head><title>"), "title", F.lit("</title></head><body><p>"), "body", F.lit("</p></body></html>"))
    tables.write_snapshots(docs.select("url", F.current_timestamp().alias("fetched_at"), page.alias("html")), f"{out}/snapshots")
