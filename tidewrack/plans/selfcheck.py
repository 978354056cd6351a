"""The acceptance run: every kind of query, the cosine, snapshots, ranking and suggestions, each with what it found."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewrack.operators import rank
from tidewrack.plans import search
from tidewrack.plans.query import parse

#: Least value of each check that passes.
LEAST = {"documents": 1, "site": 1, "filetype": 1, "phrase": 1, "wildcard": 1, "regex": 1, "snapshot": 1, "self cosine": 1.0, "ranked": 1, "suggest": 1}


def measured(docs: DataFrame, pages: DataFrame, ix: dict[str, DataFrame], terms: str, site: str, filetype: str, phrase: str, wildcard: str, regex: str, prefix: str) -> DataFrame:
    """name, measured: one row for each check; ix is a stored index of docs."""
    hits = lambda q: search.matching(docs, parse(q), ix).agg(F.count("*").cast("double").alias("measured"))
    words = parse(terms).terms
    own = rank.query_vector(ix["stats"], words)
    found = {
        "documents": docs.agg(F.count("*").cast("double").alias("measured")),
        "site": hits(f"site:{site}"),
        "filetype": hits(f"filetype:{filetype}"),
        "phrase": hits(phrase),
        "wildcard": hits(wildcard),
        "regex": hits(regex),
        "snapshot": pages.agg(F.countDistinct(F.md5("url")).cast("double").alias("measured")),
        "self cosine": own.agg(F.round(F.sum(F.col("wq") * F.col("wq")) / F.max(F.col("q_norm") * F.col("q_norm")), 6).alias("measured")),
        "ranked": rank.fused(rank.field_cosines(ix, words), {"title": 4.0, "body": 1.0}).limit(60).agg(F.count("*").cast("double").alias("measured")),
        "suggest": ix["postings"].where(F.col("field") == "body").where(F.startswith("term", F.lit(prefix))).select("term").distinct().limit(20).agg(F.count("*").cast("double").alias("measured")),
    }
    out = None
    for name, rows in found.items():
        row = rows.select(F.lit(name).alias("name"), "measured")
        out = row if out is None else out.unionByName(row)
    return out


def verdicts(rows: DataFrame) -> DataFrame:
    """name, measured, verdict (PASS or FAIL) of measured()."""
    least = F.create_map(*(F.lit(x) for name, value in LEAST.items() for x in (name, float(value))))
    return rows.withColumn("verdict", F.when(F.col("measured") >= least[F.col("name")], "PASS").otherwise("FAIL"))
