"""The inverted index in long form: postings, term statistics, vector norms, anchors, in-links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewrack.functions import text as tx

FIELDS = ("title", "anchor", "attachment", "body")


def token_rows(docs: DataFrame, fields: dict[str, str], split=tx.search_tokens) -> DataFrame:
    """doc_id, field, pos, term; fields: field name to column. One scan, whatever the number of fields.

    Of search_tokens the words and single characters come first, so that their positions are those of phrases.
    """
    each = F.array(*(F.struct(F.lit(name).alias("field"), split(F.col(column)).alias("terms")) for name, column in fields.items()))
    rows = docs.select("doc_id", F.explode(each).alias("f"))
    return rows.select("doc_id", F.col("f.field").alias("field"), F.posexplode("f.terms").alias("pos", "term"))


def term_frequencies(tokens: DataFrame, positions: bool = False) -> DataFrame:
    """doc_id, field, term, tf and, if asked, the sorted positions."""
    extra = [F.array_sort(F.collect_list("pos")).alias("positions")] if positions else []
    return tokens.groupBy("doc_id", "field", "term").agg(F.count("*").alias("tf"), *extra)


def term_stats(tf: DataFrame, n_docs: DataFrame) -> DataFrame:
    """term, df (documents that have it in any field), idf_smooth, idf_raw; n_docs: one row n."""
    return with_idf(tf.select("term", "doc_id").distinct().groupBy("term").agg(F.count("*").alias("df")), n_docs)


def with_idf(df: DataFrame, n_docs: DataFrame) -> DataFrame:
    """term, df, idf_smooth, idf_raw of df(term, df); n_docs: one row n."""
    df = df.crossJoin(F.broadcast(n_docs))  # a single row
    return df.select("term", "df", idf(F.col("n"), F.col("df"), "smooth").alias("idf_smooth"), idf(F.col("n"), F.col("df"), "ltc").alias("idf_raw"))


def idf(n: Column, df: Column, mode: str) -> Column:
    if mode == "smooth":
        return F.ln((n + 1) / (df + 1)) + 1
    if mode == "ltc":
        return F.ln(n / df)
    raise ValueError(f"idf mode {mode}: smooth or ltc")


def weight(tf: Column, idf_: Column) -> Column:
    return (1 + F.ln(tf)) * idf_


def norms(tf: DataFrame, stats: DataFrame, mode: str = "smooth") -> DataFrame:
    """doc_id, field, norm of the weighted vectors."""
    rows = tf.select("doc_id", "field", "term", "tf").join(stats, "term").select("doc_id", "field", weight(F.col("tf"), F.col("idf_smooth" if mode == "smooth" else "idf_raw")).alias("w"))
    return rows.groupBy("doc_id", "field").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))


def count_of(docs: DataFrame) -> DataFrame:
    return docs.agg(F.count("*").alias("n"))


def build_index(docs: DataFrame, fields: dict[str, str], mode: str = "smooth", positions: bool = False, split=tx.search_tokens) -> dict[str, DataFrame]:
    """postings, stats and norms of docs(doc_id, ...), lazily."""
    tf = term_frequencies(token_rows(docs, fields, split), positions)
    stats = term_stats(tf, count_of(docs))
    return {"postings": tf, "stats": stats, "norms": norms(tf, stats, mode)}


#: Bytes of text that one task of store_index takes at a time: what it sorts stays in memory.
SEGMENT = 1 << 24
#: Terms whose weights every task is given: the most frequent ones, nine in ten postings of a corpus of made-up words.
HOT_TERMS = 100_000


def segments(docs: DataFrame, fields: dict[str, str]) -> int:
    """In how many parts the texts go: more only as they grow, and for a small table as many as there are cores."""
    size = docs.agg(*(F.sum(F.octet_length(F.coalesce(F.col(c).cast("string"), F.lit("")))).alias(f) for f, c in fields.items())).first()
    whole = sum(n or 0 for n in size)
    return max(-(-whole // SEGMENT), min(docs.sparkSession.sparkContext.defaultParallelism, -(-whole // (1 << 20))), 1)


def segment_postings(docs: DataFrame, fields: dict[str, str], split=tx.search_tokens) -> DataFrame:
    """term, doc_id, field, tf, positions, first of each partition's docs, ordered by term, doc_id and field.

    first: of a term's rows of one document (in several fields) the first. Rows that share a doc_id must share a
    partition; they count as one document. Terms are split by Spark and numbered, sorted and counted as arrays of numbers.
    """
    names = sorted(fields)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        table = pa.Table.from_batches(parts).combine_chunks()
        ids = pc.unique(table.column("doc_id"))
        ids = ids.take(pc.sort_indices(ids))
        owner = pc.index_in(table.column("doc_id"), ids).to_numpy()
        words, docs_, places, kinds = [], [], [], []
        for n, name in enumerate(names):
            for column in table.column(name).chunks:
                size = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                words.append(column.flatten())
                docs_.append(np.repeat(owner, size))
                places.append(np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size))
                kinds.append(np.full(size.sum(), n))
        own = pa.chunked_array(words).combine_chunks().dictionary_encode()
        own = own if isinstance(own, pa.DictionaryArray) else own.combine_chunks()
        order = pc.sort_indices(own.dictionary).to_numpy()  # by bytes, as Parquet's statistics are
        number = np.empty(len(order), np.int64)
        number[order] = np.arange(len(order))
        place = np.concatenate(places)
        key = (number[own.indices.to_numpy()] * len(ids) + np.concatenate(docs_)) * len(names) + np.concatenate(kinds)
        at = np.argsort(key, kind="stable") if len(ids) == table.num_rows else np.lexsort((place, key))
        key, place = key[at], place[at].astype(np.int32)
        start = np.flatnonzero(np.diff(key, prepend=-1))
        end = np.append(start[1:], len(key))
        both = key[start] // len(names)
        first = np.diff(both, prepend=-1) != 0
        terms = own.dictionary.take(pa.array(order))
        for i in range(0, len(start), 1 << 16):
            a, b = start[i : i + (1 << 16)], end[i : i + (1 << 16)]
            spot = both[i : i + len(a)]
            lists = pa.ListArray.from_arrays(pa.array(np.append(a - a[0], b[-1] - a[0]).astype(np.int32)), pa.array(place[a[0] : b[-1]]))
            columns = [terms.take(pa.array(spot // len(ids))), ids.take(pa.array(spot % len(ids))), pa.array(names).take(pa.array(key[a] % len(names))), pa.array(b - a), lists, pa.array(first[i : i + len(a)])]
            yield pa.record_batch(columns, ["term", "doc_id", "field", "tf", "positions", "first"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    own = docs.select("doc_id", *(split(F.col(fields[name])).alias(name) for name in names))
    return own.mapInArrow(work, f"term string, doc_id {kind}, field string, tf long, positions array<int>, first boolean")


def store_index(docs: DataFrame, fields: dict[str, str], path: str, modes: tuple[str, ...] = ("smooth",), split=tx.search_tokens) -> None:
    """The index of docs(doc_id, ...), each part written once: postings, stats and norms of each idf mode.

    Only texts are shuffled, by doc_id: postings are made and sorted by term where their document is, so that each file
    is a segment with all terms of its documents, and a lookup reads its terms' pages of each. The norms of a document
    are summed in its segment too, with the weights of HOT_TERMS; rows of other terms, which are few, meet theirs by a
    shuffle.
    """
    spark = docs.sparkSession

    def put(rows: DataFrame, name: str) -> DataFrame:
        rows.write.mode("overwrite").parquet(f"{path}/{name}")
        return spark.read.schema(rows.schema).parquet(f"{path}/{name}")

    own = docs.select("doc_id", *sorted(set(fields.values()))).repartition(segments(docs, fields), "doc_id")
    tf = put(segment_postings(own, fields, split), "postings")
    df = tf.where("first").groupBy("term").agg(F.count("*").alias("df"))  # documents: one row of each, whatever fields have the term
    stats = put(with_idf(df, count_of(docs)).repartitionByRange("term").sortWithinPartitions("term"), "stats")
    rows = tf.select("doc_id", "field", "term", "tf")
    hot = F.broadcast(stats.orderBy(F.desc("df"), "term").limit(HOT_TERMS))
    rest = stats.join(hot.select("term"), "term", "left_anti")
    squares = []
    for part in (rows.join(hot, "term"), rows.join(hot.select("term"), "term", "left_anti").join(rest, "term")):
        each = {mode: weight(F.col("tf"), F.col("idf_smooth" if mode == "smooth" else "idf_raw")) for mode in modes}
        squares.append(part.groupBy("doc_id", "field").agg(*(F.sum(w * w).alias(mode) for mode, w in each.items())))
    put(squares[0].unionByName(squares[1]).groupBy("doc_id", "field").agg(*(F.sqrt(F.sum(mode)).alias(f"norm_{mode}") for mode in modes)), "norms")


def stored_index(spark, path: str, mode: str = "smooth") -> dict[str, DataFrame]:
    """What store_index wrote, with one mode's norms."""
    read = lambda name: spark.read.parquet(f"{path}/{name}")
    return {"postings": read("postings").select("term", "doc_id", "field", "tf", "positions"), "stats": read("stats"), "norms": read("norms").select("doc_id", "field", F.col(f"norm_{mode}").alias("norm"))}


def anchors_by_target(links: DataFrame) -> DataFrame:
    """dst, anchor_text (all anchors, sorted), inlinks_count (distinct sources)."""
    return links.groupBy("dst").agg(F.array_join(F.array_sort(F.collect_list("anchor")), " ").alias("anchor_text"), F.countDistinct("src").alias("inlinks_count"))


def with_anchors(docs: DataFrame, links: DataFrame) -> DataFrame:
    """docs(url, ...) with anchor_text and inlinks_count; empty and 0 without links."""
    found = anchors_by_target(links).withColumnRenamed("dst", "url")
    rest = [c for c in docs.columns if c not in ("anchor_text", "inlinks_count")]
    return docs.select(*rest).join(found, "url", "left").select(*rest, F.coalesce("anchor_text", F.lit("")).alias("anchor_text"), F.coalesce("inlinks_count", F.lit(0)).alias("inlinks_count"))


def unique_by_url(docs: DataFrame) -> DataFrame:
    """Of rows with one url the latest fetched stays, of those the one with the smallest doc_id."""
    w = Window.partitionBy("url").orderBy(F.desc_nulls_last("fetched_at"), "doc_id")
    return docs.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def corpus_stats(docs: DataFrame) -> DataFrame:
    """One row: documents, hosts, types, share of readable documents."""
    readable = (F.length(F.trim("body")) > 0) & (F.length(F.trim("title")) > 0)
    return docs.agg(F.count("*").alias("n_docs"), F.countDistinct("host").alias("n_hosts"), F.countDistinct("doc_type").alias("n_types"), F.round(F.avg(readable.cast("int")), 6).alias("readable_ratio"))
