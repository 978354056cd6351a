"""Document fingerprints: threshold-scaled sketches that keep every shingle hash below a fixed fraction of the range.

Two sketches of the same fraction merge by union, and the shared share of their hashes estimates likeness or
containment however unequal the documents are. The smallest hash is kept in any case, so short texts have a sketch.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewrack.llm.common import chunks, documents, shingle_hashes, text_buffer, word_hashes

K = 5
FRACTION = 1 / 8
#: Mean rows in one range of doc_id; ranges are the unit that moves when documents meet the next one.
RANGE_ROWS = 1000


def kept(shingles: np.ndarray, fraction: float = FRACTION) -> np.ndarray:
    """The sketch of a set of hashes: the distinct ones below the fraction, sorted; where there are none, the smallest."""
    if not len(shingles):
        return shingles
    below = np.sort(shingles[shingles <= np.uint64(min(2**64 - 1, int(fraction * 2**64)))])
    return below[np.concatenate([[True], below[1:] != below[:-1]])] if len(below) else shingles.min(keepdims=True)


def sketches(column: pa.Array, k: int = K, fraction: float = FRACTION) -> Iterator[np.ndarray]:
    """Sorted hashes that each text keeps; none without words."""
    off, data = text_buffer(column)
    for i, j in chunks(off):
        words, at = word_hashes(data, off[i : j + 1])
        shingles = shingle_hashes(words, k) if len(words) >= k else words
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            own = shingles[a : b - k + 1] if b - a >= k else shingle_hashes(words[a:b], k)
            yield kept(own, fraction)


def fingerprint(sketch: np.ndarray) -> str:
    """Base64 of the sorted hashes, 8 bytes each, most significant first; empty without words."""
    return base64.b64encode(sketch.astype(">u8").tobytes()).decode()


def hashes(text: str) -> np.ndarray:
    """The sketch that a fingerprint stands for."""
    return np.frombuffer(base64.b64decode(text), ">u8").astype(np.uint64)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Shared share of two sketches' hashes: an estimate of the Jaccard similarity. Two empty ones are alike."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return shared / (len(both) - shared)


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of a's shingles that b has, 1 for an empty a."""
    return float(np.isin(a, b).mean()) if len(a) else 1.0


def merged(a: np.ndarray, b: np.ndarray, fraction: float = FRACTION) -> np.ndarray:
    """The sketch of both documents' shingles together."""
    return kept(np.concatenate([a, b]), fraction)


def fingerprints(docs: DataFrame, k: int = K, fraction: float = FRACTION) -> DataFrame:
    """doc_id, fingerprint for each row of docs(doc_id, text, ...); null, empty and blank texts have an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 1024):
                batch = whole.slice(i, 1024)
                yield pa.record_batch([batch.column("doc_id"), pa.array([fingerprint(s) for s in sketches(batch.column("text"), k, fraction)], pa.string())], ["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fingerprint string")


def with_next(docs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """range, guest, doc_id, text, sorted so that after each row of a range (guest 0, doc_id descending) its next document stands.

    Ranges come from quantiles of doc_id, so the text moves once; the first row of the range after goes along as a
    guest. Only the ranges' bounds and first ids, a few for each thousand rows, are on the driver.
    """
    spark = docs.sparkSession
    ids = docs.select("doc_id").where("doc_id is not null")
    n = max(1, min(50_000, -(-ids.count() // range_rows)))
    bounds = np.unique(ids.approxQuantile("doc_id", [i / n for i in range(1, n)], 0.1 / n) if n > 1 else []).astype(np.int64)

    def number(doc_id: pd.Series) -> np.ndarray:  # from the largest ids down
        return len(bounds) - np.searchsorted(bounds, doc_id.to_numpy(), "right")

    @F.pandas_udf("long")
    def range_of(doc_id: pd.Series) -> pd.Series:
        return pd.Series(number(doc_id), dtype="int64")

    first = {r.part: r.first for r in ids.withColumn("part", range_of("doc_id")).groupBy("part").agg(F.max("doc_id").alias("first")).collect()}
    parts = sorted(first)
    before = {first[p]: parts[i - 1] for i, p in enumerate(parts)}  # the first range's first row follows the last range's last

    @F.pandas_udf("array<struct<part:long,guest:int>>")
    def places(doc_id: pd.Series) -> pd.Series:
        return pd.Series([[(p, 0), (before[i], 1)] if i in before else [(p, 0)] for i, p in zip(doc_id.tolist(), number(doc_id).tolist(), strict=True)])

    spread = docs.select("doc_id", "text").where("doc_id is not null").select("doc_id", "text", F.explode(places("doc_id")).alias("at")).select(F.col("at.part").alias("part"), F.col("at.guest").alias("guest"), "doc_id", "text")
    n = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), len(parts)))
    runs = max(parts, default=0) + 1  # neighbouring ranges go to one task, as many to each
    return spread.repartitionById(n, F.floor(F.col("part") * n / runs).cast("int")).sortWithinPartitions("part", "guest", F.desc("doc_id"))


def edited(text: str, following: str) -> str:
    """The last half of the code points (rounded down) replaced by the first as many, or all, of the next document."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def neighbours(docs: DataFrame, k: int = K, fraction: float = FRACTION, range_rows: int = RANGE_ROWS) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for each row of docs(doc_id, text, ...).

    The next document is the one with the next smaller doc_id, after the last the first; a lone document follows
    itself. A null text is an empty one. Rows that repeat a doc_id follow each other in any order. Rows without a
    doc_id have no place in that order and follow themselves. An empty table gives an empty result; further columns
    are not read.
    """
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def results(pairs: list[tuple[int | None, str, str]]) -> pa.RecordBatch:
        cut = [edited(a, b) for _, a, b in pairs]
        own, other, changed = (list(sketches(pa.array(x, pa.string()), k, fraction)) for x in ([a for _, a, _ in pairs], [b for _, _, b in pairs[-1:]], cut))
        rows = []
        for n, (doc_id, text, following) in enumerate(pairs):
            after = other[-1] if n + 1 == len(pairs) else own[n + 1] if pairs[n + 1][1] is following else next(sketches(pa.array([following], pa.string()), k, fraction))
            rows.append((doc_id, len(text), hashlib.sha256(cut[n].encode()).hexdigest(), fingerprint(own[n]), fingerprint(changed[n]), likeness(own[n], changed[n]), likeness(own[n], after)))
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for whole in batches:
            for i in range(0, whole.num_rows, 256):
                batch, pairs = whole.slice(i, 256), []
                for part, guest, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("part", "guest", "doc_id", "text")), strict=True):
                    text = text or ""
                    if last is not None and last[0] == part and not last[1]:
                        pairs.append((last[2], last[3], text))
                    last = (part, guest, doc_id, text)
                if pairs:
                    yield results(pairs)

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield results([(None, t or "", t or "") for t in batch.column("text").to_pylist()])

    without = docs.select("doc_id", "text").where("doc_id is null").mapInArrow(alone, schema)
    return with_next(docs, range_rows).mapInArrow(run, schema).unionByName(without)


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(documents(spark, sf_dir))
