"""What several operators share: word hashes over Arrow buffers, connected components."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewrack.scratch import Scratch

#: Bytes of text that are worked on as one flat array.
CHUNK_BYTES = 1 << 20

_U = np.uint64
#: A-Z to a-z, all else as it is.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_LOWER = np.frombuffer(LOWER, np.uint8)
#: Bytes of [\x20\x09-\x0D].
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes outside of words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ once A-Z are lowered.
SIGNS = np.array([not (b >= 128 or chr(b).isalnum()) for b in range(256)])


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """The name, or with underscores behind it, that no column has (upper and lower case are one)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


# --- words and shingles as flat arrays ---------------------------------------------------------------


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, in place."""
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its size, one run after the other."""
    ends = np.cumsum(size)
    return np.repeat(start - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)


#: Places of a word whose numbers are looked up; those of later places are computed.
PLACES = 64


def _number_of(values: np.ndarray, place: np.ndarray, seed: int) -> np.ndarray:
    """The pseudo-random number of each value (up to 256) at its place; 0 for a value of 0."""
    one = values.astype(_U)
    one *= _U(0xD6E8FEB86659FD93)
    one += place.astype(_U) * _U(0x9E3779B97F4A7C15) + _U(seed * 0xA24BAED4963EE407 % 2**64)
    mix(one)
    one *= values != 0
    return one


@cache
def _numbers(seed: int) -> np.ndarray:
    return _number_of(np.tile(np.arange(257), PLACES), np.repeat(np.arange(PLACES), 257), seed)


def byte_sums(values: np.ndarray, place: np.ndarray, starts: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of each run of `values` from one start to the next: the sum of a pseudo-random number for each (place in the run, value).

    A value of 0 adds nothing. Unlike a polynomial modulo 2^64, no texts are known that such a sum can't tell apart.
    """
    late = np.flatnonzero(place >= PLACES)
    at = np.minimum(place, PLACES - 1) if len(late) else place
    one = _numbers(seed)[at * 257 + values]
    if len(late):
        one[late] = _number_of(values[late], place[late], seed)
    return np.add.reduceat(one, starts)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (one more than rows) and bytes of a string (UTF-8) or binary column; a null has no bytes."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind, size = np.int64, 8
    else:
        kind, size = np.int32, 4
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    off = np.frombuffer(offsets, kind, n + 1, column.offset * size).astype(np.int64)
    return off, np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)


def chunks(off: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about `most` bytes; a longer row stands alone."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def word_spans(data: np.ndarray, off: np.ndarray, gap: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (bytes in `data`) of words, by default [^\\x20\\x09-\\x0D]+, and, per row of `off`, the number of its first word (one more than rows)."""
    base = off[0]
    part = data[base : off[-1]]
    if not len(part):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    inside = ~gap[part]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cut = off[1:-1] - base
    cut = cut[cut < len(part)]
    first[cut] |= inside[cut]
    starts = np.flatnonzero(first)
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    before = cut[cut > 0] - 1
    last[before] |= inside[before]
    ends = np.flatnonzero(last) + 1
    return starts + base, ends + base, np.searchsorted(starts, off - base)


def word_hashes(data: np.ndarray, off: np.ndarray, gap: np.ndarray = _SPACE, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of rows, A-Z lowered, and per row the number of its first word; another seed gives unrelated hashes."""
    starts, ends, rows = word_spans(data, off, gap)
    if not len(starts):
        return np.zeros(0, _U), rows
    out = np.empty(len(starts), _U)
    for i, j in chunks(np.append(starts, off[-1])):  # so that a very long text needs no more memory than a short one
        begins = starts[i:j] - starts[i]
        part = data[int(starts[i]) : int(ends[j - 1])]
        place = np.arange(len(part), dtype=np.int64)
        place -= np.repeat(begins, np.diff(np.append(begins, len(part))))
        values = _LOWER[part].astype(np.uint16) + np.uint16(1)
        values[gap[part]] = 0
        out[i:j] = byte_sums(values, place, begins, seed)
    out += (ends - starts).astype(_U) * _U(0xD6E8FEB86659FD93)
    return mix(out), rows


_WEIGHTS = mix(np.arange(1, 65, dtype=_U) * _U(0xA0761D6478BD642F)) | _U(1)


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k words in sequence; with fewer words, one of the whole sequence; none without words."""
    n = len(words)
    if n == 0:
        return words
    size = min(k, n)
    out = np.zeros(n - size + 1, _U)
    for j in range(size):
        out += words[j : n - size + 1 + j] * _WEIGHTS[j]
    if size < k:
        out += _U(size * 0x8EBC6AF09C88C6E3 % 2**64)
    return mix(out)


# --- connected components ------------------------------------------------------------------------------


#: Parts into which the edges of each vertex are dealt before they meet what is known of it.
SALTS = 1024


def with_minimum(edges: DataFrame) -> DataFrame:
    """u, v, m: each edge with the smallest of its u's neighbours.

    A vertex of very many edges never lies in one task: its edges are dealt into parts by v, each part leaves one
    minimum, and the minimum of these goes back to the parts that there are, one row to each.
    """
    dealt = edges.withColumn("s", F.expr(f"pmod(xxhash64(v), {SALTS})").cast("int"))
    parts = dealt.groupBy("u", "s").agg(F.min("v").alias("m"))
    low = parts.groupBy("u").agg(F.min("m").alias("m"), F.collect_list("s").alias("s")).select("u", "m", F.explode("s").alias("s"))
    return dealt.join(low, ["u", "s"]).select("u", "v", "m")


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Smallest id reachable from each id: (id, component) for every id in edges(a, b), self-edges included.

    Alternating large-star and small-star steps until nothing changes: each is a grouped minimum and a join, nothing is
    gathered on the driver, and every round is written to the shared folder. An edge with a null is no edge; repeated
    edges count once; empty edges give an empty result.
    """
    pair = lambda a, b: (F.col(a).alias("u"), F.col(b).alias("v"))
    e = scratch.table(edges.where("a is not null and b is not null").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = lambda t: tuple(t.where("u <> v").agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.sum(F.xxhash64("v", "u").cast("decimal(20,0)"))).first())
    seen = mark(e)
    while seen[0]:
        both = e.where("u <> v")
        both = both.unionByName(both.select(*pair("v", "u")))
        large = scratch.table(with_minimum(both).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct())
        small = with_minimum(large)
        small = small.select(F.explode(F.expr("array(struct(u, m as v), struct(v as u, m as v))")).alias("x")).select("x.u", "x.v").where("u <> v")
        done = scratch.table(small.unionByName(e.where("u = v")).distinct())
        now = mark(done)
        scratch.drop(large)
        scratch.drop(e)
        e = done
        if now == seen:
            break
        seen = now
    return e.select(F.explode(F.expr("array(struct(u as id, v as component), struct(v as id, v as component))")).alias("x")).select("x.*").groupBy("id").agg(F.min("component").alias("component"))
