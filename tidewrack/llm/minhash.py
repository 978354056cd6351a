"""MinHash near-dedup: circulant signatures, banding, and exact Jaccard verification on full shingle sets.

Signatures. A first permutation (the shingle's mixed hash) scatters shingles over a universe of 2^22 places; a second
one ranks the places, and shifting it circularly by k gives coordinate k. Place p therefore contributes a contiguous
window of the second permutation to all coordinates at once.

Candidates. With 32 bands of 5 coordinates a pair of similarity 0.8 shares no band with a probability of 3e-6.

Links without all pairs. Documents with equal sets form a class at once. In each bucket every class is verified
against the bucket's smallest one only, and components of these links are found. What this leaves open is a bucket
with two further members in different components; such members (few, but thousands may hang together) are gathered
into clusters, the clusters cut into blocks of bounded size, and each pair of blocks is compared whole in one task by
products of incidence matrices. So every pair that shares a bucket is either verified or already connected, and no
group of copies is expanded into pairs of rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewrack.llm.common import Scratch, chunks, components, documents, free_name, mix, shingle_hashes, text_buffer, word_hashes

BANDS, ROWS = 32, 5
UNIVERSE_BITS = 22
SEED = 20240607
#: Classes in a block; a task compares two blocks.
BLOCK = 512
PERCENT = 80
#: Of the hashes that links are confirmed by: unrelated to those that make candidates, so no collision gives both.
CHECK_SEED = 1


@cache
def windows(coordinates: int) -> np.ndarray:
    """Row p: what place p contributes to each coordinate, the second permutation shifted circularly."""
    ranks = np.random.default_rng(SEED).permutation(1 << UNIVERSE_BITS).astype(np.uint32)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([ranks, ranks[: coordinates - 1]]), coordinates)


def signature(shingles: np.ndarray, coordinates: int) -> np.ndarray:
    rows, places = windows(coordinates), (shingles >> np.uint64(64 - UNIVERSE_BITS)).astype(np.int64)
    out = rows[places[:1024]].min(axis=0)
    for i in range(1024, len(places), 1024):
        np.minimum(out, rows[places[i : i + 1024]].min(axis=0), out=out)
    return out


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    weights = mix(np.arange(11, 11 + rows, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    keys = (sig.reshape(bands, rows).astype(np.uint64) * weights).sum(axis=1, dtype=np.uint64)
    return mix(keys + mix(np.arange(1, bands + 1, dtype=np.uint64))).view(np.int64)


def sets_of(column: pa.Array, k: int, seed: int = 0) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text; empty without words. Another seed gives unrelated hashes."""
    off, data = text_buffer(column)
    for i, j in chunks(off):
        words, at = word_hashes(data, off[i : j + 1], seed=seed)
        shingles = shingle_hashes(words, k) if len(words) >= k else words
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            own = np.sort(shingles[a : b - k + 1] if b - a >= k else shingle_hashes(words[a:b], k))
            if len(own):
                fresh = np.ones(len(own), bool)
                fresh[1:] = own[1:] != own[:-1]
                own = own[fresh]
            yield own


def signatures(docs: DataFrame, k: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n (distinct shingles), set_key (digest of the set by two unrelated hashes, 128 bits for each shingle), bands; the last two null without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 2048):
                part = batch.slice(i, 2048)
                n, keys, found = [], [], []
                for own, other in zip(sets_of(part.column("text"), k), sets_of(part.column("text"), k, CHECK_SEED), strict=True):
                    n.append(max(len(own), len(other)))
                    keys.append(hashlib.blake2b(own.tobytes() + other.tobytes(), digest_size=16).digest() if len(own) else None)
                    found.append(band_keys(signature(own, bands * rows), bands, rows) if len(own) else None)
                yield pa.record_batch([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(found, pa.list_(pa.int64()))], ["doc_id", "n", "set_key", "bands"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, set_key binary, bands array<long>")


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    return int((both[1:] == both[:-1]).sum())


def linked(shared: int, a: int, b: int, percent: int) -> bool:
    return 100 * shared >= percent * (a + b - shared)


def verified(pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """Of pairs(a, b, a_text, b_text) the (a, b) whose sets are as similar as asked; rows with the same b should be neighbours."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, np.zeros(0, np.uint64)
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                a, b = part.column("a").to_pylist(), part.column("b").to_pylist()
                left, right = [], []
                for n, own in enumerate(sets_of(part.column("a_text"), k, CHECK_SEED)):
                    if b[n] != last:
                        last, held = b[n], next(sets_of(part.column("b_text").slice(n, 1), k, CHECK_SEED))
                    if len(own) and linked(common(own, held), len(own), len(held), percent):
                        left.append(a[n])
                        right.append(b[n])
                yield pa.record_batch([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    return pairs.select("a", "b", "a_text", "b_text").mapInArrow(run, "a long, b long")


def merging_links(sets: list[np.ndarray], groups: list[int], side: np.ndarray, other: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Pairs of groups that links between a set of `side` and a set of `other` merge, as few as connect them."""
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    owner, flat = owner[order], flat[order]
    number = np.concatenate([[0], np.cumsum(flat[1:] != flat[:-1])])
    number = number[: len(flat)]
    often = np.bincount(number)[number] > 1
    owner, number = owner[often], number[often]
    at_side, at_other = np.full(len(sets), -1), np.full(len(sets), -1)
    at_side[side], at_other[other] = np.arange(len(side)), np.arange(len(other))
    shared = np.zeros((len(side), len(other)), np.float32)
    cuts = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]])) if len(number) else np.zeros(0, np.int64)
    for i in range(0, len(cuts), 4096):
        own = slice(cuts[i], cuts[i + 4096] if i + 4096 < len(cuts) else len(number))
        column = np.cumsum(np.concatenate([[0], number[own][1:] != number[own][:-1]]))
        wide = min(4096, len(cuts) - i)
        x, y = np.zeros((len(side), wide), np.float32), np.zeros((len(other), wide), np.float32)
        s, o = at_side[owner[own]], at_other[owner[own]]
        x[s[s >= 0], column[s >= 0]] = 1
        y[o[o >= 0], column[o >= 0]] = 1
        shared += x @ y.T
    shared = shared.astype(np.int64)
    alike = 100 * shared >= percent * (sizes[side][:, None] + sizes[other][None, :] - shared)
    parent = {g: g for g in groups}

    def root(g: int) -> int:
        while parent[g] != g:
            parent[g] = parent[parent[g]]
            g = parent[g]
        return g

    out, label = [], np.array(groups)
    for n, row in zip(side.tolist(), alike, strict=True):
        for g in np.unique(label[other[row]]).tolist():
            a, b = root(groups[n]), root(g)
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((groups[n], g))
    return out


def block_links(members: DataFrame, texts: DataFrame, k: int, percent: int, block: int) -> DataFrame:
    """Pairs (a, b) of components that links inside a cluster merge; members(id, component, cluster)."""
    sizes = members.groupBy("cluster").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    placed = members.join(sizes, "cluster").withColumn("block", F.expr("pmod(xxhash64(id), blocks)").cast("int"))
    cells = placed.join(texts, "id").select("*", F.explode(F.expr("sequence(0, blocks - 1)")).alias("other"))
    cells = cells.select("cluster", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "id", "component", "text")

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        block_of = table.column("block").to_numpy()
        sets = list(sets_of(table.column("text").chunk(0), k, CHECK_SEED))
        lo, hi = table.column("lo")[0].as_py(), table.column("hi")[0].as_py()
        found = merging_links(sets, table.column("component").to_pylist(), np.flatnonzero(block_of == lo), np.flatnonzero(block_of == hi), percent)
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return cells.groupBy("cluster", "lo", "hi").applyInArrow(run, "a long, b long")


def near_dedup(docs: DataFrame, k: int = 5, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs(doc_id, text, ...).

    A document's set: its distinct shingles of k words [^\\x20\\x09-\\x0D]+ with A-Z lowered; with fewer words the whole
    sequence as one; null, empty and blank texts have none and are linked with nothing. Documents with
    100 * intersection >= percent * union are linked; component_id is the smallest doc_id reachable. Rows that repeat
    a doc_id count as one document. A null doc_id is linked with nothing: component_id null, kept true. An empty
    table gives an empty result; further columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "minhash")
    signed = scratch.table(signatures(docs, k, bands, rows))
    full = signed.where("n > 0 and doc_id is not null")
    classes = scratch.table(full.groupBy("set_key").agg(F.min("doc_id").alias("id"), F.first("n").cast("int").alias("n"), F.first("bands").alias("bands")))

    # every class of a bucket against the bucket's smallest
    slots = classes.select("id", "n", F.explode("bands").alias("key"))
    leaders = scratch.table(slots.groupBy("key").agg(F.min(F.struct("id", "n")).alias("leader"), F.count("*").alias("size")).where("size > 1"))
    members = slots.join(leaders, "key").where("id <> leader.id").select("key", "id", "n", F.col("leader.id").alias("leader"), F.col("leader.n").alias("leader_n"))
    members = scratch.table(members)
    wanted = members.select("id").unionByName(members.select(F.col("leader").alias("id"))).distinct()
    texts = scratch.table(docs.select(F.col("doc_id").alias("id"), "text").join(wanted, "id", "left_semi"))
    near = members.where(f"100 * least(n, leader_n) >= {percent} * greatest(n, leader_n)").groupBy("id").agg(F.collect_set("leader").alias("leaders"))
    pairs = texts.join(near, "id").select(F.col("id").alias("a"), F.col("text").alias("a_text"), F.explode("leaders").alias("b"))
    pairs = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("b_text")), "b")
    links = scratch.table(verified(pairs, k, percent).distinct())
    first = components(links, scratch)

    # buckets whose other members are in different components
    labelled = members.select("key", "id").join(first, "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"))
    labelled = scratch.table(labelled)
    mixed = labelled.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min("id").alias("hub")).where("low <> high")
    open_ = scratch.table(labelled.join(mixed.select("key", "hub"), "key").select("id", "component", "hub").distinct())
    clusters = components(open_.select(F.col("id").alias("a"), F.col("hub").alias("b")), scratch).select("id", F.col("component").alias("cluster"))
    inside = scratch.table(open_.select("id", "component").distinct().join(clusters, "id"))
    merges = scratch.table(block_links(inside, texts, k, percent, block).distinct())
    last = components(merges, scratch).select(F.col("id").alias("component"), F.col("component").alias("final"))

    found = classes.select("set_key", "id").join(first, "id", "left").select("set_key", F.coalesce("component", "id").alias("component"))
    found = found.join(last, "component", "left").select("set_key", F.coalesce("final", "component").alias("component_id"))
    out = full.join(found, "set_key").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = signed.where("not (n > 0 and doc_id is not null)").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_smallest(docs: DataFrame, k: int = 5, percent: int = PERCENT) -> DataFrame:
    """The rows of docs that near_dedup keeps, with all their columns.

    Rows without words or doc_id stay; rows that repeat a kept doc_id stay all; an empty table gives an empty result;
    columns may have any names.
    """
    own_id = free_name(docs, "_own_id")
    kept = near_dedup(docs, k, percent).where("kept").select(F.col("doc_id").alias(own_id)).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col(own_id)), "left_semi")


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(documents(spark, sf_dir), k=4)


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Brute force: every pair with a shingle in common, and what can be reached over links.
OP4_SQL = rf"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS g FROM t),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= {PERCENT} * (a.n + b.n - c)),
e AS (SELECT x AS a, y AS b FROM l UNION ALL SELECT y, x FROM l),
r(id, other) AS (SELECT DISTINCT a, a FROM e UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.other),
c AS (SELECT id, min(other) AS component FROM r GROUP BY id)
SELECT t.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.component, t.doc_id) AS component_id, t.doc_id = coalesce(c.component, t.doc_id) AS kept
FROM t LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.id = t.doc_id
"""
