"""PageRank over an edge list."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewrack.scratch import Scratch


#: Edges that meet their ranks at once, in one task.
BLOCK = 8_000_000


def numbered(edges: DataFrame, scratch: Scratch) -> tuple[DataFrame, int]:
    """id, n of the vertices of edges(src, dst), and the seed of the hash n: the first by which no two vertices share one."""
    ids = scratch.table(edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct())
    for seed in range(1000):
        vertices = ids.select("id", number(F.col("id"), seed).alias("n"))
        if not vertices.groupBy("n").count().where("count > 1").take(1):
            return vertices, seed
    raise RuntimeError("no hash tells all vertices apart")


def number(id_: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), id_)


def given_in(own: pa.Table, ranks: pa.Table) -> pa.Table:
    """n, given: sums of what one block's edges own(s, d, degree) give, of ranks(s, pr)."""
    s, d, degree = (own.column(c).to_numpy() for c in ("s", "d", "degree"))
    keys, pr = ranks.column("s").to_numpy(), ranks.column("pr").to_numpy()
    if not len(s) or not len(keys):
        return pa.table({"n": pa.array([], pa.int64()), "given": pa.array([], pa.float64())})
    order = np.argsort(keys)
    value = pr[order][np.searchsorted(keys[order], s)] / degree
    ends, at = np.unique(d, return_inverse=True)
    return pa.table({"n": ends, "given": np.bincount(at, value, len(ends))})


def pagerank(edges: DataFrame, damping: float = 0.85, iterations: int = 10, cut_every: int = 2) -> DataFrame:
    """id, pr of every vertex of edges(src, dst); ranks sum to 1.

    Duplicate edges and self-loops are left out; the rank of vertices without out-links is spread evenly. Edges are
    dealt once to a grid of blocks, by source and by target. In a round only ranks travel, to the blocks of their row
    that have an edge of theirs, and one sum for each block and target comes back: never a row for each edge. Only where
    some vertices have no out-links are ranks read twice in a round; their lineage is then cut every `cut_every` rounds.
    The result is a written table.
    """
    spark = edges.sparkSession
    scratch = Scratch(spark, "pagerank")
    all_ = edges.where("src is not null and dst is not null").select("src", "dst")
    vertices, seed = numbered(all_, scratch)
    n = vertices.count()
    if not n:
        return vertices.select("id", F.lit(0.0).alias("pr"))
    links = all_.select(number(F.col("src"), seed).alias("s"), number(F.col("dst"), seed).alias("d")).where("s <> d").repartition("s").distinct()
    links = scratch.table(links.withColumn("degree", F.count("*").over(Window.partitionBy("s")).cast("int")))
    side = max(int((2 * spark.sparkContext.defaultParallelism) ** 0.5), int((links.count() / BLOCK) ** 0.5) + 1)
    block = (F.expr(f"pmod(s, {side}) * {side} + pmod(d, {side})")).cast("int")
    own = links.withColumn("block", block).repartition("block").persist(StorageLevel.MEMORY_AND_DISK)  # dealt once, for all rounds
    wanted = scratch.table(own.groupBy("s").agg(F.collect_set("block").alias("blocks")))
    numbers = scratch.table(vertices.select("n"))
    sinks = scratch.table(numbers.join(wanted.select(F.col("s").alias("n")), "n", "left_anti"))
    ranks = numbers.withColumn("pr", F.lit(1.0 / n))
    dangling = bool(sinks.take(1))
    for i in range(1, iterations + 1):
        sent = ranks.withColumnRenamed("n", "s").join(wanted, "s").select("s", "pr", F.explode("blocks").alias("block"))
        sums = own.groupBy("block").cogroup(sent.groupBy("block")).applyInArrow(lambda own, sent: given_in(own, sent), "n long, given double")
        after = numbers.join(sums.groupBy("n").agg(F.sum("given").alias("given")), "n", "left")
        lost = F.lit(0.0)
        if dangling:
            total = ranks.join(sinks, "n", "left_semi").agg(F.coalesce(F.sum("pr"), F.lit(0.0)).alias("lost"))
            after, lost = after.crossJoin(F.broadcast(total)), F.col("lost")  # a single row
        ranks = after.select("n", (F.lit((1 - damping) / n) + damping * (F.coalesce("given", F.lit(0.0)) + lost / n)).alias("pr"))
        if dangling and i % cut_every == 0 and i < iterations:
            ranks = scratch.table(ranks)
    out = scratch.table(vertices.join(ranks, "n").select("id", "pr"))
    own.unpersist()
    return out


def normalised(ranks: DataFrame) -> DataFrame:
    """id, pr_hat: ranks as shares of the largest one."""
    return ranks.crossJoin(F.broadcast(ranks.agg(F.max("pr").alias("top")))).select("id", F.try_divide("pr", "top").alias("pr_hat"))
