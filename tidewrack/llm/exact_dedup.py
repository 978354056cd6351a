"""Exact dedup: sorted digest runs merged up a tree, in built-in functions alone.

Every input partition is a run: its digests in order, each with its smallest identifier and its count. Digests are cut
into slices by their first bytes, so that many tasks merge at once. In each round groups of `fan_in` runs come
together: the runs of a slice travel whole to one task, which merges them in the order of their digests and keeps the
smallest identifier of each, until one run is left; the answers go back down the same tree. So a text that a third
of all rows share never puts more than `fan_in` rows of a round on one key, and no task sees more than `fan_in` runs'
part of a slice.

A digest counts as verified only together with the byte length and a second, unrelated 64-bit hash of the text: all
three are the key at every level.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewrack.llm.common import Scratch, documents, free_name

FAN_IN = 8
KEY = ["digest", "n_bytes", "second"]


def normalised(text: str = "text"):
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _keys(docs: DataFrame) -> DataFrame:
    norm = normalised()
    return docs.select("doc_id", norm.alias("norm")).select(
        "doc_id", F.unhex(F.sha2("norm", 256)).alias("digest"), F.octet_length("norm").cast("long").alias("n_bytes"), F.xxhash64("norm").alias("second")
    )


def merged(rows: DataFrame) -> DataFrame:
    """Runs of rows(slice, run, key, best, n) merged: rows of a run lie in one task, in the order of their digests, and each digest leaves one."""
    order = ["slice", "run", *KEY]
    return rows.repartition("slice", "run").sortWithinPartitions(*order).groupBy(*order).agg(F.min("best").alias("best"), F.sum("n").alias("n"))


def exact_dedup(docs: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each row of docs(doc_id, text, ...).

    Texts are equal when identical after each run of [\\x20\\x09-\\x0D] became one space; a null text is an empty one,
    and empty texts form one group. Of equal texts the row with the smallest doc_id has kept = true; of rows that
    repeat this doc_id one is kept. A null doc_id comes after all others; keep_id is null only if a whole group's is.
    An empty table gives an empty result; other columns are not read.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "exact")
    slices = int(spark.conf.get("spark.sql.shuffle.partitions"))
    head = F.conv(F.hex(F.substring("digest", 1, 2)), 16, 10).cast("int")
    keys = _keys(docs).withColumn("slice", F.floor(head * slices / 65536).cast("int"))
    leaf = scratch.table(keys.select("*", F.spark_partition_id().alias("run"), F.monotonically_increasing_id().alias("row")))
    best = F.struct(F.isnull("doc_id").alias("no_id"), F.col("doc_id").alias("id"), F.col("row").alias("row"))
    runs = int(leaf.agg(F.max("run")).first()[0] or 0) + 1
    levels = [scratch.table(merged(leaf.select("slice", "run", *KEY, best.alias("best"), F.lit(1).cast("long").alias("n"))))]
    while runs > 1:
        levels.append(scratch.table(merged(levels[-1].withColumn("run", F.expr(f"run div {fan_in}").cast("int")))))
        runs = -(-runs // fan_in)
    answer = levels[-1]
    for below in reversed(levels[:-1]):
        above = answer.withColumnRenamed("run", "above")
        answer = below.select("slice", "run", *KEY, F.expr(f"run div {fan_in}").cast("int").alias("above")).join(above, ["slice", "above", *KEY]).select("slice", "run", *KEY, "best", "n")
    return leaf.join(answer, ["slice", "run", *KEY]).select(
        "doc_id", F.col("best.id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("row") == F.col("best.row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of docs that exact_dedup keeps, with all their columns; rows that repeat a kept doc_id with an equal text leave one.

    Null and empty texts are one group, of which one row stays; an empty table gives an empty result; columns may have
    any names.
    """
    sha, other, own_id = (free_name(docs, x) for x in ("_sha", "_other_sha", "_own_id"))
    kept = exact_dedup(docs).where("kept").select(F.col("doc_id").alias(own_id), F.col("text_sha256").alias(other))
    rows = docs.withColumn(sha, F.sha2(normalised(), 256))
    out = rows.join(kept, F.col("doc_id").eqNullSafe(F.col(own_id)) & (F.col(sha) == F.col(other)), "left_semi")
    return out.dropDuplicates(["doc_id", sha]).drop(sha)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


OP8_SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM t WINDOW w AS (PARTITION BY norm)
"""
