"""Readers and writers of the search engine's own tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewrack.functions import urls

DOCUMENT = "title string, body string, anchor_text string, attachment_text string, url string, host string, doc_type string, snapshot_path string, pagerank double, inlinks_count long"
LINK = "src_url string, dst_url string, anchor string"
USER = "user_id long, role string, interests array<string>"
QUERY_LOG = "user_id long, ts timestamp, q string"
CLICK_LOG = "user_id long, ts timestamp, doc_id long"


def read_documents_jsonl(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(DOCUMENT).json(path)


def write_documents_jsonl(docs: DataFrame, path: str) -> None:
    docs.write.mode("overwrite").json(path)


def read_links_tsv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LINK).csv(path, sep="\t", quote="")


def write_links_tsv(links: DataFrame, path: str) -> None:
    links.select("src_url", "dst_url", "anchor").write.mode("overwrite").csv(path, sep="\t", quote="")


def read_frontier(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("url")).where("url <> ''")


def write_snapshots(pages: DataFrame, path: str) -> None:
    """url_md5, url, fetched_at, html as gzip-compressed Parquet."""
    rows = pages.select(F.md5("url").alias("url_md5"), "url", "fetched_at", "html")
    rows.write.mode("overwrite").option("compression", "gzip").parquet(path)


def read_snapshot(spark: SparkSession, path: str, url: str) -> DataFrame:
    """The stored snapshot of an address, rendered; no row if there is none."""
    row = spark.read.parquet(path).where(F.col("url_md5") == F.md5(F.lit(url)))
    return row.select("url", "fetched_at", urls.rendered_snapshot(F.col("html"), F.col("url"), F.col("fetched_at").cast("string")).alias("html"))


def write_index(index: dict[str, DataFrame], path: str) -> None:
    """postings, stats and norms; postings lie sorted by term, so a term's lookup prunes row groups."""
    index["postings"].repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/postings")
    for name in ("stats", "norms"):
        index[name].write.mode("overwrite").parquet(f"{path}/{name}")


def read_index(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in ("postings", "stats", "norms")}


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def cleared(log: DataFrame, user_id: int) -> DataFrame:
    """The log without one user's rows; rows of no known user stay."""
    return log.where(~F.col("user_id").eqNullSafe(F.lit(user_id)))
