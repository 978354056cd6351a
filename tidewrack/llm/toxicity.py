"""Toxicity: class-conditional Kneser-Ney models of toxic and ordinary documents, compared by length-normalised log-likelihoods.

Both classes have two interpolated Kneser-Ney models. One spells words: each byte after up to TOP - 1 bytes of its
word, down to LOW - 1; below that both classes back off to shared counts, in how many different words of the whole
corpus a byte follows another. So a word that is new is judged by its spelling. The other has whole words, backed off
to how often each occurs in the whole corpus, labelled or not. Where neither class knows more than the corpus, both
say the same. Counts of the longest contexts are occurrences, those below continuation counts; what is taken from
counts of 1, 2 and 3 or more comes from counts of counts (modified Kneser-Ney).

Copies are collapsed before anything is counted: a word counts once for each different stretch of STRETCH words that
it ends.

A text's score is a logistic curve of its log-likelihood ratio over its length: of the spelling per word and per root
of the words, of whole words per word of the strongest hundredth. The first letter of a word is not compared (a
word's start tells the language). The curve is fitted on documents that the models have not seen (FOLDS parts).

All labelled documents are learned from. Their words and grams are counted on the executors; the driver gathers the
grams with their counts and a number for each different word, and of the documents sums alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewrack.llm.common import LOWER, SIGNS, chunks, documents, mix, spread, text_buffer, word_hashes, word_spans
from tidewrack.llm.quality import held_out_by, sampled_texts
from tidewrack.scratch import Scratch

PREDICT_AT = 0.7
#: Longest and shortest grams (bytes, a word's begin and end included) that each class counts by itself.
TOP, LOW = 5, 3
#: Words of the stretch that counts once.
STRETCH = 5
#: Strongest words that count: every so many-th, and at least so many.
SHARE, STRONGEST = 100, 3
#: Most words that a Python worker remembers with their ratios; the scores don't depend on it.
CACHE_WORDS = 500_000
#: Parts of the labelled documents; the curve is fitted on each part by models of the others.
FOLDS = 4
BEGIN, END = 1, 2
_LOWER = np.frombuffer(LOWER, np.uint8)


# --- what the executors gather ----------------------------------------------------------------------------


def binaries(data: np.ndarray, lengths: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def stretches(words: np.ndarray, at: np.ndarray, size: int = STRETCH) -> np.ndarray:
    """Hash of each word with the size - 1 before it in its text (fewer at the text's begin)."""
    place = np.arange(len(words)) - np.repeat(at[:-1], np.diff(at))
    out = np.minimum(place, size).astype(np.uint64)
    for j in range(size):
        weight = np.uint64((0xA0761D6478BD642F * (2 * j + 1) | 1) % 2**64)
        out[j:] += np.where(place[j:] >= j, words[: len(words) - j], np.uint64(0)) * weight
    return mix(out)


#: Columns of a word's or gram's counts in either class (toxic, ordinary) and each fold.
COUNTS = [f"n{c}_{f}" for c in range(2) for f in range(FOLDS)]


def squeezed(values: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(values).tobytes(), codec="zstd", asbytes=True)


def unsqueezed(data: bytes, n: int, kind: type) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, n * np.dtype(kind).itemsize, codec="zstd"), kind) if n else np.zeros(0, kind)


#: What travels to a bucket of stretches: its different words, how long they are, how often each follows, and 64 bits a stretch.
PACKED = "bucket int, n int, bytes long, words binary, sizes binary, follows binary, stretches binary"


def packed(texts: DataFrame, bits: int) -> DataFrame:
    """PACKED: the words of texts(y, fold, text) by the first bits of their stretches' hashes, in which y and fold then stand."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            off, data = text_buffer(batch.column("text"))
            y, fold = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("y", "fold"))
            for i, j in chunks(off, 8 << 20):
                words, at = word_hashes(data, off[i : j + 1], SIGNS)
                starts, ends, _ = word_spans(data, off[i : j + 1], SIGNS)
                code = np.repeat((y[i:j] * FOLDS + fold[i:j]).astype(np.uint64), np.diff(at))
                value = stretches(words, at)
                bucket = (value >> np.uint64(64 - bits)).astype(np.int64)
                value = (value & np.uint64(2 ** (64 - bits) - 1)) | code << np.uint64(64 - bits)
                order = np.lexsort((words, bucket))
                fresh = np.ones(len(order), bool)
                fresh[1:] = (words[order][1:] != words[order][:-1]) | (bucket[order][1:] != bucket[order][:-1])
                each = np.flatnonzero(fresh)
                size, follows = (ends - starts)[order[each]], np.diff(np.append(each, len(order)))
                chars = _LOWER[data[spread(starts[order[each]], size)]]
                byte_at = np.concatenate([[0], np.cumsum(size)])
                rows: list[tuple] = []
                edges = np.flatnonzero(np.diff(bucket[order[each]], prepend=-1))
                for a, b in zip(edges.tolist(), np.append(edges[1:], len(each)).tolist(), strict=True):
                    own = value[order[each[a] : each[b] if b < len(each) else len(order)]]
                    sized = squeezed(size[a:b].astype(np.uint32)), squeezed(follows[a:b].astype(np.uint32))
                    rows.append((int(bucket[order[each[a]]]), b - a, int(byte_at[b] - byte_at[a]), squeezed(chars[byte_at[a] : byte_at[b]]), *sized, own.tobytes()))
                types = [pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 4]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 7, types, strict=True)], [c.split()[0] for c in PACKED.split(", ")])

    return texts.select("y", "fold", "text").mapInArrow(run, PACKED)


#: Bytes of text for each bucket, and the fewest buckets in bits (y and fold need three).
BUCKET_BYTES, LEAST_BITS = 8 << 20, 6


def fold_counts(texts: DataFrame) -> DataFrame:
    """word, COUNTS: how many different stretches of texts(y, fold, text) of a label each word ends; a stretch counts in the smallest of its folds.

    Each word travels once for its stretches of a bucket. A bucket has its share of every word's stretches, so a
    frequent word is no hot key; a word may have a row from each bucket.
    """
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(LEAST_BITS, (total // BUCKET_BYTES).bit_length())

    def count(table: pa.Table) -> pa.Table:
        parts, follows, values = [], [], []
        for row in table.select(["n", "bytes", "words", "sizes", "follows", "stretches"]).to_pylist():
            parts.append(binaries(unsqueezed(row["words"], row["bytes"], np.uint8), unsqueezed(row["sizes"], row["n"], np.uint32)))
            follows.append(unsqueezed(row["follows"], row["n"], np.uint32))
            values.append(np.frombuffer(row["stretches"], np.uint64))
        words = pa.concat_arrays(parts).dictionary_encode()
        owner, value = np.repeat(words.indices.to_numpy().astype(np.int64), np.concatenate(follows)), np.concatenate(values)
        code = (value >> np.uint64(64 - bits)).astype(np.int64)
        value = value & np.uint64(2 ** (64 - bits) - 1)
        own = owner * 2 + code // FOLDS
        order = np.lexsort((code, value, own))
        once = np.ones(len(order), bool)
        once[1:] = (own[order][1:] != own[order][:-1]) | (value[order][1:] != value[order][:-1])
        kept = order[once]
        n = np.bincount(owner[kept] * 2 * FOLDS + code[kept], minlength=len(words.dictionary) * 2 * FOLDS).reshape(-1, 2, FOLDS)
        return pa.table([words.dictionary, *(pa.array(n[:, 1 - c, f].astype(np.int64)) for c in range(2) for f in range(FOLDS))], names=["word", *COUNTS])

    return packed(texts, bits).groupBy("bucket").applyInArrow(count, ", ".join(["word binary", *(f"{c} long" for c in COUNTS)]))


def counted(texts: DataFrame) -> DataFrame:
    """word, y, fold, n: how many different stretches of texts(y, fold, text) of a label each word ends."""
    each = F.array(*(F.struct(F.lit(1 - c).alias("y"), F.lit(f).alias("fold"), F.sum(f"n{c}_{f}").alias("n")) for c in range(2) for f in range(FOLDS)))
    return fold_counts(texts).groupBy("word").agg(each.alias("c")).select("word", F.explode("c").alias("c")).select("word", "c.y", "c.fold", "c.n").where("n > 0")


def corpus_words(docs: DataFrame) -> DataFrame:
    """word, n: every word of all texts and how often it occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            off, data = text_buffer(batch.column("text"))
            for i, j in chunks(off, 8 << 20):
                hashes, _ = word_hashes(data, off[i : j + 1], SIGNS)
                starts, ends, _ = word_spans(data, off[i : j + 1], SIGNS)
                _, first, n = np.unique(hashes, return_index=True, return_counts=True)
                size = ends[first] - starts[first]
                yield pa.record_batch([binaries(_LOWER[data[spread(starts[first], size)]], size), pa.array(n)], ["word", "n"])

    return docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def shared_pairs(words: DataFrame) -> np.ndarray:
    """How many of the words(word) have byte a before byte b, as a table of 256 by 256; words begin with BEGIN and end with END."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            off, data = text_buffer(batch.column("word"))
            s, place = framed(data[off[0] : off[-1]], np.diff(off))
            total += np.bincount((s[:-1].astype(np.int64) << 8 | s[1:])[place[1:] > 0], minlength=1 << 16)
        seen = np.flatnonzero(total)
        yield pa.record_batch([pa.array(seen), pa.array(total[seen])], ["pair", "n"])

    found = words.select("word").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << 16)
    out[found.column("pair").to_numpy()] = found.column("n").to_numpy()
    return out.reshape(256, 256)


def vocabulary(texts: DataFrame, corpus: DataFrame) -> DataFrame:
    """word, COUNTS, often: the counted words of texts(y, fold, text) and how often corpus(word, n) has each."""
    return fold_counts(texts).groupBy("word").agg(*(F.sum(c).alias(c) for c in COUNTS)).join(corpus.withColumnRenamed("n", "often"), "word")


def without_fold(columns: list, fold: int) -> list:
    """Sums of the columns COUNTS for either class, those of one fold left out (of none: FOLDS)."""
    return [sum(columns[c * FOLDS + f] for f in range(FOLDS) if f != fold) for c in range(2)]


def gram_counts(words: DataFrame) -> tuple[np.ndarray, list[np.ndarray]]:
    """The longest grams (and those at a word's begin) of words(word, COUNTS), ascending, and their COUNTS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            off, data = text_buffer(batch.column("word"))
            lengths = np.diff(off)
            s, place = framed(data[off[0] : off[-1]], lengths)
            use = place >= LOW - 1
            keys, back = np.unique(grams(s, place, TOP)[use], return_inverse=True)
            owner = np.repeat(np.arange(len(lengths)), lengths + 2)[use]
            sums = [np.bincount(back, batch.column(c).to_numpy()[owner], len(keys)).astype(np.int64) for c in COUNTS]
            yield pa.record_batch([pa.array(c) for c in (keys.view(np.int64), *sums)], ["gram", *COUNTS])

    found = words.select("word", *COUNTS).mapInArrow(run, ", ".join(f"{c} long" for c in ("gram", *COUNTS)))
    found = found.groupBy("gram").agg(*(F.sum(c).alias(c) for c in COUNTS)).toArrow()
    keys = found.column("gram").to_numpy()
    order = np.argsort(keys)
    return keys[order].astype(np.uint64), [found.column(c).to_numpy()[order] for c in COUNTS]


# --- the models -------------------------------------------------------------------------------------------


def framed(data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words that lie one after the other, each with BEGIN before and END behind it; each byte's place in its word."""
    size = lengths + 2
    ends = np.cumsum(size)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    first = ends - size
    out[first], out[ends - 1] = BEGIN, END
    out[spread(first + 1, lengths)] = data
    return out, np.arange(len(out)) - np.repeat(first, size)


def grams(s: np.ndarray, place: np.ndarray, n: int) -> np.ndarray:
    """The last n bytes (fewer at a word's begin) up to each place, as one number."""
    out = s.astype(np.uint64)
    for j in range(1, n):
        out[j:] |= np.where(place[j:] >= j, s[: len(s) - j], 0).astype(np.uint64) << np.uint64(8 * j)
    return out


def discounts(counts: np.ndarray) -> np.ndarray:
    """What is taken from counts of 0, 1, 2 and 3 or more."""
    return discounts_by([int((counts == k).sum()) for k in range(1, 5)])


def discounts_by(n: list[int]) -> np.ndarray:
    """What is taken from counts of 0, 1, 2 and 3 or more, from how many counts of 1 to 4 there are."""
    out = [0.0]
    for k in (1, 2, 3):
        known = n[0] and n[1] and n[k - 1]
        out.append(float(np.clip(k - (k + 1) * n[0] / (n[0] + 2 * n[1]) * n[k] / n[k - 1], 0.1 * k, 0.95 * k)) if known else 0.5 * k)
    return np.array(out)


def taken(counts: np.ndarray) -> np.ndarray:
    return discounts(counts)[np.minimum(counts, 3)]


def shared_spelling(pairs: np.ndarray) -> np.ndarray:
    """Probability of each byte (column) after each byte (row): Kneser-Ney over the shared counts."""
    before = (pairs > 0).sum(axis=0) + 1.0
    d = np.where(pairs > 0, 0.75, 0.0)
    total = pairs.sum(axis=1, keepdims=True)
    known = (pairs - d + d.sum(axis=1, keepdims=True) * (before / before.sum())) / np.maximum(total, 1)
    return np.where(total > 0, known, before / before.sum())


def levels(s: np.ndarray, place: np.ndarray, counts: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Grams and counts for LOW to TOP bytes: occurrences of the longest, and of those at a word's begin; else continuation counts.

    counts: of each place's word.
    """
    use = (place >= LOW - 1) & (counts > 0)
    keys, back = np.unique(grams(s, place, TOP)[use], return_inverse=True)
    return shorter(keys, np.bincount(back, counts[use], len(keys)).astype(np.int64))


def shorter(keys: np.ndarray, n: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Grams and counts for LOW to TOP bytes from the longest (and those at a word's begin), ascending, and their occurrences."""
    out = [(keys, n)]
    for size in range(TOP - 1, LOW - 1, -1):
        full = keys >> np.uint64(8 * size) > 0
        less, different = np.unique(keys[full] & np.uint64(256**size - 1), return_counts=True)
        keys, n = np.concatenate([less, keys[~full]]), np.concatenate([different, n[~full]])
        order = np.argsort(keys)
        keys, n = keys[order], n[order]
        out.insert(0, (keys, n))
    return out


class Level:
    """One length of grams in both classes: what a gram has of its own, and what its context leaves to backoff."""

    def __init__(self, size: int, classes: list[tuple[np.ndarray, np.ndarray]]):
        whole = [(k[f], n[f]) for k, n in classes for f in [k >> np.uint64(8 * (size - 1)) > 0]]
        self.keys = np.union1d(*(k for k, _ in whole))
        self.contexts = np.unique(self.keys >> np.uint64(8))
        self.own, self.rest = np.zeros((2, len(self.keys) + 1)), np.ones((2, len(self.contexts) + 1))  # last: grams and contexts never seen
        for c, (k, n) in enumerate(whole):
            at, up = np.searchsorted(self.keys, k), np.searchsorted(self.contexts, k >> np.uint64(8))
            d, total = taken(n), np.bincount(up, n, len(self.contexts))
            self.own[c, at] = (n - d) / total[up]
            self.rest[c, :-1] = np.where(total > 0, np.bincount(up, d, len(self.contexts)) / np.maximum(total, 1), 1.0)

    def refine(self, p: np.ndarray, key: np.ndarray) -> np.ndarray:
        at, up = (number(x, known) for x, known in ((key, self.keys), (key >> np.uint64(8), self.contexts)))
        return self.own[:, at] + self.rest[:, up] * p


def number(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Each one's number in the sorted known ones, else their count."""
    at = np.searchsorted(known, x)
    return np.where((at < len(known)) & (known[np.minimum(at, max(0, len(known) - 1))] == x), at, len(known)) if len(known) else np.zeros(len(x), np.int64)


class WordShares:
    """Whole words of both classes, backed off to their share of the corpus; each class has how many words of counts 1 to 4 and its total."""

    def __init__(self, counts_of: list[list[int]], more: list[int], totals: list[int]):
        self.less = [discounts_by(n) for n in counts_of]
        taken_off = [less[1] * n[0] + less[2] * n[1] + less[3] * m for less, n, m in zip(self.less, counts_of, more, strict=True)]
        self.totals = [max(1, t) for t in totals]
        self.left = [t / total or 1.0 for t, total in zip(taken_off, self.totals, strict=True)]
        self.other = np.float32(np.log(self.left[0] / self.left[1]))  # of words in neither class

    def ratios(self, counts: np.ndarray, often: np.ndarray) -> np.ndarray:
        own = [np.log((n - less[np.minimum(n, 3)]) / total + left * often) for n, less, total, left in zip(counts, self.less, self.totals, self.left, strict=True)]
        return (own[0] - own[1]).astype(np.float32)


class Models:
    """Both classes' models; counts: of each word in the toxic (0) and the ordinary class (1); often: each word's share of the corpus."""

    def __init__(self, data: np.ndarray, lengths: np.ndarray, counts: np.ndarray, pairs: np.ndarray, often: np.ndarray):
        s, place = framed(data, lengths)
        both = [levels(s, place, own) for own in np.repeat(counts, lengths + 2, axis=1)]
        shares = WordShares([[int((own == k).sum()) for k in range(1, 5)] for own in counts], [int((own > 2).sum()) for own in counts], [int(own.sum()) for own in counts])
        hashes = word_hashes(data, np.concatenate([[0], np.cumsum(lengths)]), np.zeros(256, bool))[0]
        self._of(both, pairs, hashes, shares.ratios(counts, often), shares.other)

    @classmethod
    def gathered(cls, both: list, pairs: np.ndarray, hashes: np.ndarray, ratios: np.ndarray, other: np.float32) -> Models:
        """From what the executors counted: either class's levels, and the words' hashes and ratios."""
        own = cls.__new__(cls)
        own._of(both, pairs, hashes, ratios, other)
        return own

    def _of(self, both: list, pairs: np.ndarray, hashes: np.ndarray, ratios: np.ndarray, other: np.float32) -> None:
        self.shared = shared_spelling(pairs)
        self.levels = [Level(LOW + i, [both[0][i], both[1][i]]) for i in range(TOP - LOW + 1)]
        order = np.argsort(hashes)
        self.words, self.word_ratio, self.other = hashes[order], ratios[order], other

    def spelled(self, data: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Log-probability of each word's spelling in either class."""
        s, place = framed(data, lengths)
        p = np.ones((2, len(s)))
        p[:, 1:] = self.shared[s[:-1], s[1:]]
        for size, level in enumerate(self.levels, LOW):
            at = np.flatnonzero(place >= size - 1)
            p[:, at] = level.refine(p[:, at], grams(s, place, size)[at])
        p[:, place == 0] = 1.0
        return np.add.reduceat(np.log(p), np.cumsum(lengths + 2) - lengths - 2, axis=1) if len(lengths) else np.zeros((2, 0))

    def ratios(self, hashes: np.ndarray, data: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Log-likelihood ratios of each word, by its spelling and as a word."""
        if not len(hashes):
            return np.zeros((2, 0), np.float32)
        spelled = self.spelled(data, lengths)
        return np.stack([spelled[0] - spelled[1], np.append(self.word_ratio, self.other)[number(hashes, self.words)]]).astype(np.float32)


FEATURES = 4


def length_normalised(ratio: np.ndarray) -> np.ndarray:
    """Of a text's words' ratios (by spelling, as words): per word, per root of the words, per word of the strongest, and the log of the length."""
    n = ratio.shape[1]
    if not n:
        return np.zeros(FEATURES)
    most = max(STRONGEST, n // SHARE)
    strongest = np.partition(ratio[1], n - most)[n - most :] if n > most else ratio[1]
    total = float(ratio[0].sum(dtype=np.float64))
    return np.array([total / n, total / n**0.5, float(strongest.sum(dtype=np.float64)) / most, np.log1p(n)])


class Scorer:
    """Scores of texts; remembers words' ratios from chunk to chunk."""

    def __init__(self, models: Models, weights: np.ndarray, center: np.ndarray, scale: np.ndarray):
        self.models, self.weights, self.center, self.scale = models, weights, center, scale
        self.known, self.value = np.zeros(0, np.uint64), np.zeros((2, 0), np.float32)

    def curve(self, features: np.ndarray) -> np.ndarray:
        x = np.clip((features - self.center) / self.scale, -6, 6)
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -30, 30)))

    def features(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        hashes, at = word_hashes(data, off, SIGNS)
        starts, ends, _ = word_spans(data, off, SIGNS)
        each, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        place = number(each, self.known)
        new = np.flatnonzero(place == len(self.known))
        if len(self.known) + len(new) > CACHE_WORDS:
            self.known, self.value, new = self.known[:0], self.value[:, :0], np.arange(len(each))
        size = ends[first[new]] - starts[first[new]]
        found = self.models.ratios(each[new], _LOWER[data[spread(starts[first[new]], size)]], size)
        where = np.searchsorted(self.known, each[new])
        self.known, self.value = np.insert(self.known, where, each[new]), np.insert(self.value, where, found, axis=1)
        ratio = self.value[:, np.searchsorted(self.known, each)][:, back]
        return np.array([length_normalised(ratio[:, a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]).reshape(-1, FEATURES)

    def score(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        return self.curve(self.features(data, off))


def sums(rows: DataFrame, of: Callable[[np.ndarray, np.ndarray], np.ndarray], scale: int) -> list[float]:
    """Column sums of of(y, x) over rows(y, x): of whole numbers (`scale` to 1), so the order of rows doesn't matter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column("x").flatten().to_numpy().reshape(-1, FEATURES)
                total = np.rint(of(batch.column("y").to_numpy(), x) * scale).astype(np.int64).sum(axis=0)
                yield pa.record_batch([pa.array([total.tolist()], pa.list_(pa.int64()))], ["total"])

    return [sum(column) / scale for column in zip(*(r.total for r in rows.mapInArrow(run, "total array<long>").collect()), strict=True)]


def logistic(rows: DataFrame, decay: float = 1e-2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights and, last, the intercept, by Newton steps over rows(y, x); center and scale of x; both labels weigh the same.

    Of the rows only sums reach the driver.
    """
    found = np.array(sums(rows, lambda y, x: np.column_stack([y == 1, y != 1, x]), 1 << 24))
    n = found[:2]
    center = found[2:] / n.sum()
    scale = np.sqrt(np.array(sums(rows, lambda y, x: (x - center) ** 2, 1 << 24)) / n.sum()) + 1e-6
    size = FEATURES + 1
    w, keep = np.zeros(size), np.append(np.full(FEATURES, decay), 1e-6)
    for _ in range(50):

        def parts(y: np.ndarray, x: np.ndarray, w: np.ndarray = w) -> np.ndarray:
            x = np.column_stack([np.clip((x - center) / scale, -6, 6), np.ones(len(x))])
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            both = np.column_stack([(p * (1 - p) + 1e-6)[:, None] * (x[:, :, None] * x[:, None, :]).reshape(len(x), -1), x * (p - y)[:, None]])
            return np.column_stack([both * (y == 1)[:, None], both * (y != 1)[:, None]])

        found = np.array(sums(rows, parts, 1 << 32)).reshape(2, -1)
        found = (found * (0.5 / np.maximum(1, n))[:, None]).sum(axis=0)
        step = np.linalg.solve(found[: size * size].reshape(size, size) + np.diag(keep), found[size * size :] + keep * w)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w, center, scale


def featured(texts: DataFrame, scorer: Scorer) -> DataFrame:
    """y, x: the features of each of texts(y, text)."""
    held = texts.sparkSession.sparkContext.broadcast(scorer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            off, data = text_buffer(batch.column("text"))
            for i, j in chunks(off):
                x = held.value.features(data, off[i : j + 1])
                yield pa.record_batch([batch.column("y").slice(i, j - i), pa.array(x.tolist(), pa.list_(pa.float64()))], ["y", "x"])

    return texts.select("y", "text").mapInArrow(run, "y int, x array<double>")


def word_shares(words: DataFrame) -> list[WordShares]:
    """Of words(COUNTS), without each fold and, last, with all."""
    asked = []
    for f in range(FOLDS + 1):
        for n in without_fold([F.col(c) for c in COUNTS], f):
            asked += [F.count(F.when(n == k, 1)) for k in range(1, 5)] + [F.count(F.when(n > 2, 1)), F.coalesce(F.sum(n), F.lit(0))]
    found = words.agg(*(a.alias(f"a{i}") for i, a in enumerate(asked))).first()
    rows = [list(found[i : i + 6]) for i in range(0, len(found), 6)]
    return [WordShares([r[:4] for r in two], [r[4] for r in two], [r[5] for r in two]) for two in zip(rows[::2], rows[1::2], strict=True)]


def word_ratios(words: DataFrame, shares: WordShares, total: int, fold: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and ratios of words(word, COUNTS, often) that either class has without the fold; the others have shares.other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            off, data = text_buffer(batch.column("word"))
            counts = np.stack(without_fold([batch.column(c).to_numpy() for c in COUNTS], fold))
            known = counts.any(axis=0)
            hashes = word_hashes(data, off, np.zeros(256, bool))[0]
            ratios = shares.ratios(counts[:, known], batch.column("often").to_numpy()[known] / total)
            yield pa.record_batch([pa.array(hashes[known].view(np.int64)), pa.array(ratios)], ["hash", "ratio"])

    found = words.mapInArrow(run, "hash long, ratio float").toArrow()
    return found.column("hash").to_numpy().view(np.uint64), found.column("ratio").to_numpy()


def fit(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "toxic") -> Scorer | None:
    """None if there are not two documents of each label to learn from.

    On the driver: of the labelled documents' words a hash and a ratio each, their grams with counts, 65,536 shared
    counts, and sums over the documents' features; no text.
    """
    fold = F.pmod(F.xxhash64("doc_id", F.lit(label)), F.lit(FOLDS)).cast("int").alias("fold")
    scratch = Scratch(docs.sparkSession, "toxicity")
    texts = scratch.table(sampled_texts(docs, labels, label, learn, None).select("y", fold, "text"))
    rows = {r.y: r.n for r in texts.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if min(rows.get(y, 0) for y in (0, 1)) < 2:
        return None
    corpus = scratch.table(corpus_words(docs))
    total = corpus.agg(F.sum("n")).first()[0]
    words = scratch.table(vocabulary(texts, corpus))
    keys, counts = gram_counts(words)
    if not len(keys):
        return None
    pairs = shared_pairs(corpus)
    scratch.drop(corpus)
    shares = word_shares(words)

    def models(fold: int) -> Models:
        both = [shorter(keys[n > 0], n[n > 0]) for n in without_fold(counts, fold)]
        return Models.gathered(both, pairs, *word_ratios(words, shares[fold], total, fold), shares[fold].other)

    plain = np.append(np.zeros(FEATURES), 0.0), np.zeros(FEATURES), np.ones(FEATURES)
    parts = [scratch.table(featured(texts.where(F.col("fold") == f), Scorer(models(f), *plain))) for f in range(FOLDS)]
    scratch.drop(texts)
    curve = logistic(reduce(DataFrame.unionByName, parts).coalesce(FOLDS))
    whole = models(FOLDS)
    for table in (words, *parts):
        scratch.drop(table)
    return Scorer(whole, *curve)


def toxicity(docs: DataFrame, labels: DataFrame, modulus: int = 3, rest: int = 1, predict_at: float = PREDICT_AT) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs(doc_id, text, ...), by models that learn from labels whose crc32(doc_id as text) mod `modulus` is not `rest`.

    Null and empty texts have no words and get the score of ratios of 0. A null doc_id is not held out. Without two
    documents of each label every score is 0.5; a doc_id with both labels is not learned from. Repeated rows each give
    a row, an empty table none; further columns are not read. What is sent to every task: the grams of the
    labelled documents and 12 bytes for each of their different words.
    """
    held_out = held_out_by(modulus, rest)
    scorer = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, ~held_out))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = scorer.value
        for batch in batches:
            off, data = text_buffer(batch.column("text"))
            scores = [np.zeros(0)]
            for i, j in chunks(off):
                scores.append(own.score(data, off[i : j + 1]) if own else np.full(j - i, 0.5))
            score = np.concatenate(scores)
            yield pa.record_batch([batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= predict_at).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
