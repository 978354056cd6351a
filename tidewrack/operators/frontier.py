"""Crawl frontier: filters, host quotas, resuming, seed merging."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewrack.functions import urls


def without_noise(frontier: DataFrame) -> DataFrame:
    return frontier.where(~F.rlike("url", F.lit(urls.NOISE)))


def html_only(frontier: DataFrame) -> DataFrame:
    return frontier.where(~F.rlike("url", F.lit(urls.ATTACHMENT)))


def by_quota(frontier: DataFrame, quota: int) -> DataFrame:
    """At most `quota` rows of a host, with their rank in it; frontier(url, host, priority)."""
    w = Window.partitionBy("host").orderBy(F.desc("priority"), "url")
    return frontier.withColumn("host_rank", F.row_number().over(w)).where(F.col("host_rank") <= quota)


def round_robin(frontier: DataFrame, quota: int, target: int) -> DataFrame:
    """The first `target` addresses: every host's first, then every host's second, and so on."""
    return by_quota(frontier, quota).orderBy("host_rank", F.desc("priority"), "url").limit(target)


def resumed(frontier: DataFrame, fetched: DataFrame) -> DataFrame:
    """What has not been fetched yet."""
    return frontier.join(fetched.select("url").distinct(), "url", "left_anti")


def merged(lists: list[DataFrame]) -> DataFrame:
    """Seed lists (url, host, priority, source) in one, each url once: of the highest priority, then the first source."""
    out = lists[0]
    for more in lists[1:]:
        out = out.unionByName(more)
    w = Window.partitionBy("url").orderBy(F.desc("priority"), "source")
    return out.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def prepared(lists: list[DataFrame], fetched: DataFrame, quota: int, target: int) -> DataFrame:
    """The dry run: seeds merged, noise dropped, fetched addresses left out, hosts in turns."""
    return round_robin(resumed(without_noise(merged(lists)), fetched), quota, target)
