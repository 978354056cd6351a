"""The engine's tables as views of the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewrack.config import ROLES
from tidewrack.functions import text as tx
from tidewrack.functions import urls
from tidewrack.operators import index
from tidewrack.scratch import kept
from tidewrack.sources import html


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents: source stands for the host, lang for the type, the first line for the title."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.concat(F.lit("doc://"), "source", F.lit("/"), F.col("doc_id").cast("string")).alias("url"), F.col("source").alias("host"), F.col("lang").alias("doc_type"), tx.title_of(F.col("text")).alias("title"), F.coalesce("text", F.lit("")).alias("body"))


def stored_index(spark: SparkSession, sf_dir: str, fields: tuple[str, ...] = ("title", "body"), mode: str = "smooth") -> dict[str, DataFrame]:
    """The index of documents, written once for all queries of an application."""
    write = lambda path: index.store_index(docs(spark, sf_dir), {f: f for f in fields}, path, ("smooth", "ltc"))
    return index.stored_index(spark, kept(spark, "index-" + "-".join(fields), f"{sf_dir}/documents.parquet", write), mode)


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", "url", "html", urls.host(F.col("url")).alias("host"), urls.type_of(F.col("url")).alias("doc_type"))


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst (host and path), anchor of the links of pages."""
    found = html.links(pages(spark, sf_dir).select("url", "html"))
    return found.select(F.concat(urls.host(F.col("url")), urls.path(F.col("url"))).alias("src"), urls.linked(F.col("url"), F.col("href")).alias("dst"), "anchor").where("dst is not null")


def dense_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst: suppliers and parts that share a line item, both ways."""
    pairs = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("src"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dst")).distinct()
    return pairs.union(pairs.select("dst", "src"))


def _keyed(events: DataFrame, kind: str) -> DataFrame:
    return events.where(F.col("event_type") == kind).select("event_id", "user_id", "ts", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


def clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keyed(table(spark, sf_dir, "events"), "click").withColumnRenamed("k", "doc_id")


def query_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keyed(table(spark, sf_dir, "events"), "view").withColumnRenamed("k", "q")


def fetched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fetched_at: the latest event of each key."""
    e = table(spark, sf_dir, "events").select("ts", F.get_json_object("props", "$.k").cast("bigint").alias("doc_id"))
    return e.groupBy("doc_id").agg(F.max("ts").alias("fetched_at"))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    role = F.element_at(F.array(*map(F.lit, ROLES)), (F.col("c_custkey") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), role.alias("role"), F.array(F.lower("c_mktsegment")).alias("interests"))
