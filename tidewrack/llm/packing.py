"""Best-fit packing by the sum of squares: each piece goes where the squared counts of open bins per gap become smallest.

Texts become pieces in one pass (written once, as encoding is dear). Pieces are dealt over shards of a stated mean
size; each shard packs its pieces, longest first, with one counter per residual gap. A shard needs memory for its own
rows only and leaves a bin or two partly filled, so the loss is a small constant share whatever the input's size.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewrack.llm.bpe import loaded, slices, vocabulary_path
from tidewrack.llm.common import Scratch, documents

CAPACITY = 1024
END_ID = 2
#: Mean pieces in a shard.
SHARD_PIECES = 16384
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: whole ones, but the first may be shorter."""
    first = n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))] if n > capacity else [(0, n)]


def pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """The pieces of each row of docs(doc_id, text, ...): ids of the whole text, then end_id; null and empty texts have end_id alone."""
    path = path or vocabulary_path()
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for whole in batches:
            for batch in slices(whole):
                rows = []
                for doc_id, ids in zip(batch.column("doc_id").to_pylist(), bpe.encode_column(batch.column("text")), strict=True):
                    ids += end
                    rows += [(doc_id, n, a, size, zlib.crc32(ids[4 * a : 4 * (a + size)])) for n, (a, size) in enumerate(cut(len(ids) // 4, capacity))]
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(run, PIECE)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length in the order given. Of equally good gaps the smallest is taken; a bin is opened only where none has room."""
    count = np.zeros(capacity + 1, np.int64)  # open bins by gap; count[0] and count[capacity] stay 0
    bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    where, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    n = 0
    for k, size in enumerate(lengths.tolist()):
        gap = capacity
        if size < capacity:
            gaps = count[size:capacity]
            if gaps.any():
                # the change of the sum is 2 (count[gap - size] - count[gap]) + 2, or 1 - 2 count[gap] if the bin fills
                change = 2 * (count[: capacity - size] - gaps) + 2
                change[0] -= 1
                change[gaps == 0] = 2**62
                gap = size + int(change.argmin())
        if gap == capacity:
            b, n = n, n + 1
        else:
            b = bins[gap].pop()
            count[gap] -= 1
        where[k], offset[k] = b, capacity - gap
        if gap > size:
            bins[gap - size].append(b)
            count[gap - size] += 1
    return where, offset


def pack(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, end_id: int = END_ID, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for each piece of docs(doc_id, text, ...).

    Null and empty texts are a piece of one token. Rows that repeat a doc_id are packed each. An empty table gives an
    empty result; further columns are not read. sequence_id is the shard's number times 2^32 plus a bin's number.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    table = scratch.table(pieces(docs, capacity, path, end_id))
    shards = max(1, -(-table.count() // shard_pieces))

    def run(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
        where, offset = sum_of_squares(shard["length"].to_numpy(), capacity)
        return shard.assign(sequence_id=shard["shard"].to_numpy() * 2**32 + where, offset=offset).drop(columns="shard")

    key = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shards)).alias("shard")
    return table.select(key, "*").groupBy("shard").applyInPandas(run, PIECE + ", sequence_id long, offset long")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
