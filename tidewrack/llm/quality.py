"""Quality classifier: attention-based multiple-instance learning over passages.

A document is a bag of passages of PASSAGE_WORDS words. Each passage's surface statistics go through one hidden layer;
gated attention, learned from document labels alone, weighs the passages; the weighted mean is scored. So a document
whose junk stands in one part of it is found by that part.

Fitting uses at most SAMPLE labelled documents of each label, those with the smallest hashes of doc_id: their passage
statistics are computed on the executors and gathered, the network (a few hundred weights) is fitted on the driver and
sent to every task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewrack.llm.common import chunks, documents, text_buffer, word_hashes, word_spans

PASSAGE_WORDS = 32
#: Most labelled documents of each label that the fit reads.
SAMPLE = 2500
HIDDEN, ATTENTION, EPOCHS, RATE, DECAY, SEED = 16, 8, 200, 0.02, 1e-4, 7
PREDICT_AT = 0.3
CLASSES = ("lower", "upper", "digit", "space", "newline", "stop", "exclaim", "bar", "symbol", "wide")


def _class_of() -> np.ndarray:
    out = np.full(256, CLASSES.index("symbol"), np.uint8)
    for b in range(256):
        c = chr(b)
        name = "wide" if b >= 128 else "lower" if c.islower() else "upper" if c.isupper() else "digit" if c.isdigit() else "newline" if c in "\n\r" else "space" if c.isspace() else "stop" if c in ".,;:'\"?()-" else "exclaim" if c == "!" else "bar" if c == "|" else ""
        if name:
            out[b] = CLASSES.index(name)
    return out


_CLASS = _class_of()
FEATURES = len(CLASSES) + 7


def passage_statistics(data: np.ndarray, off: np.ndarray, words: int = PASSAGE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """A row of FEATURES for each passage of texts `off` in `data`, and each text's first passage (one more than texts); a text without words is one passage of zeros."""
    starts, ends, at = word_spans(data, off)
    hashes, _ = word_hashes(data, off)
    n_words = np.diff(at)
    n = np.maximum(1, -(-n_words // words))
    first = np.concatenate([[0], np.cumsum(n)])
    out = np.zeros((first[-1], FEATURES), np.float32)
    owner = np.repeat(np.arange(len(n)), n)
    rank = np.arange(first[-1]) - first[owner]
    full = n_words[owner] > 0
    head = (at[owner] + rank * words)[full]  # first word of each passage
    if len(head):
        size = np.minimum(words, (at[1:][owner] - at[owner] - rank * words)[full]).astype(np.float32)
        begin = starts[head]
        stop = np.append(begin[1:], off[-1])
        last = ends[head + size.astype(np.int64) - 1]
        part, base = data[off[0] : off[-1]], off[0]
        kinds = _CLASS[part]
        edges = np.stack([begin - base, np.minimum(last, stop) - base], axis=1)
        length = (edges[:, 1] - edges[:, 0]).astype(np.float32)
        total = np.zeros(len(part) + 1, np.int32)
        columns = []
        for c in range(len(CLASSES)):
            np.cumsum(kinds == c, out=total[1:])
            columns.append((total[edges[:, 1]] - total[edges[:, 0]]) / length)
        letters = (ends - starts).astype(np.float32)
        same = np.zeros(len(hashes), np.float32)
        same[1:] = hashes[1:] == hashes[:-1]
        same[head] = 0
        passage = np.repeat(np.arange(len(head), dtype=np.uint64), size.astype(np.int64))
        keys = np.sort((passage << np.uint64(40)) | (hashes >> np.uint64(24)))
        fresh = np.ones(len(keys), bool)
        fresh[1:] = keys[1:] != keys[:-1]
        distinct = np.bincount((keys[fresh] >> np.uint64(40)).astype(np.int64), minlength=len(head))
        mean = np.add.reduceat(letters, head) / size
        columns += [mean / 10, np.sqrt(np.maximum(0, np.add.reduceat(letters**2, head) / size - mean**2)) / 10, np.add.reduceat(same, head) / size, distinct / size, np.add.reduceat((letters == 1).astype(np.float32), head) / size, size / words, np.log1p(n_words[owner][full]) / 10]
        out[full] = np.stack(columns, axis=1)
    return out, first


class Attention:
    """One hidden layer, gated attention over a bag's passages, a logistic score; fitted by Adam on whole batches."""

    def __init__(self, weights: dict[str, np.ndarray], center: np.ndarray, scale: np.ndarray):
        self.w, self.center, self.scale = weights, center, scale

    @classmethod
    def start(cls, x: np.ndarray, hidden: int, attention: int, seed: int) -> Attention:
        rng, f = np.random.default_rng(seed), x.shape[1]
        normal = lambda a, b: (rng.standard_normal((a, b)) / np.sqrt(a)).astype(np.float32)
        weights = {"e": normal(f, hidden), "eb": np.zeros(hidden, np.float32), "v": normal(hidden, attention), "u": normal(hidden, attention), "a": normal(attention, 1)[:, 0], "o": normal(hidden, 1)[:, 0], "ob": np.zeros(1, np.float32)}
        return cls(weights, x.mean(axis=0), x.std(axis=0) + 1e-3)

    def forward(self, x: np.ndarray, first: np.ndarray) -> tuple:
        w = self.w
        x = np.clip((x - self.center) / self.scale, -8, 8)
        h = np.tanh(x @ w["e"] + w["eb"])
        t, g = np.tanh(h @ w["v"]), 1 / (1 + np.exp(-(h @ w["u"])))
        s = (t * g) @ w["a"]
        n = np.diff(first)
        s = np.exp(s - np.repeat(np.maximum.reduceat(s, first[:-1]), n))
        alpha = s / np.repeat(np.add.reduceat(s, first[:-1]), n)
        z = np.add.reduceat(h * alpha[:, None], first[:-1], axis=0)
        return x, h, t, g, alpha, z, 1 / (1 + np.exp(-np.clip(z @ w["o"] + w["ob"], -30, 30)))

    def score(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        return self.forward(x, first)[-1]

    def fit(self, x: np.ndarray, first: np.ndarray, y: np.ndarray, epochs: int, rate: float, decay: float) -> None:
        w, n = self.w, np.diff(first)
        m, v = ({k: np.zeros_like(a) for k, a in w.items()} for _ in range(2))
        for epoch in range(1, epochs + 1):
            xs, h, t, g, alpha, z, p = self.forward(x, first)
            d = ((p - y) / len(y)).astype(np.float32)
            wide = np.repeat(d, n)
            dh = alpha[:, None] * wide[:, None] * w["o"]
            da = wide * (h @ w["o"])
            ds = alpha * (da - np.repeat(np.add.reduceat(alpha * da, first[:-1]), n))
            dt, dg = ds[:, None] * w["a"] * g * (1 - t**2), ds[:, None] * w["a"] * t * g * (1 - g)
            dh += dt @ w["v"].T + dg @ w["u"].T
            de = dh * (1 - h**2)
            grad = {"e": xs.T @ de, "eb": de.sum(axis=0), "v": h.T @ dt, "u": h.T @ dg, "a": (t * g).T @ ds, "o": z.T @ d, "ob": d.sum(keepdims=True)}
            for k in w:
                step = grad[k] + decay * w[k]
                m[k] += 0.1 * (step - m[k])
                v[k] += 0.001 * (step**2 - v[k])
                w[k] -= (rate * (m[k] / (1 - 0.9**epoch)) / (np.sqrt(v[k] / (1 - 0.999**epoch)) + 1e-8)).astype(np.float32)


def bags(docs: DataFrame, words: int = PASSAGE_WORDS) -> DataFrame:
    """doc_id, y, passages (binary: float32 rows of FEATURES) for each row of docs(doc_id, y, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            off, data = text_buffer(batch.column("text"))
            found = []
            for i, j in chunks(off):
                x, first = passage_statistics(data, off[i : j + 1], words)
                found += [x[a:b].tobytes() for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
            yield pa.record_batch([batch.column("doc_id"), batch.column("y"), pa.array(found, pa.binary())], ["doc_id", "y", "passages"])

    return docs.select("doc_id", "y", "text").mapInArrow(run, "doc_id long, y int, passages binary")


def training_rows(labels: DataFrame, label: str, learn: Column, sample: int | None) -> DataFrame:
    """doc_id, y: all rows to learn from, or at most `sample` of each label, the ones whose doc_id hashes smallest.

    A doc_id that is labelled both 0 and 1 is not learned from.
    """
    rows = labels.where(learn & F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.min(label).cast("int").alias("y"), F.max(label).alias("other")).where("y = other").select("doc_id", "y")
    if sample is None:
        return rows
    one = lambda y: rows.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    return one(0).unionByName(one(1))


def sampled_texts(docs: DataFrame, labels: DataFrame, label: str, learn: Column, sample: int | None) -> DataFrame:
    """doc_id, y, text of the documents to learn from; of rows that repeat a doc_id the smallest text."""
    chosen = training_rows(labels, label, learn, sample)
    if sample is not None:
        chosen = F.broadcast(chosen)  # 2 * sample rows at most
    return docs.select("doc_id", "text").join(chosen, "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))


def fit(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "quality", sample: int = SAMPLE, epochs: int = EPOCHS) -> Attention | None:
    """None if not both labels are there to learn from."""
    found = bags(sampled_texts(docs, labels, label, learn, sample)).collect()
    y = np.array([r.y for r in found], np.float32)
    if not len(y) or y.min() == y.max():
        return None
    found.sort(key=lambda r: (r.doc_id, r.y, bytes(r.passages)))
    y = np.array([r.y for r in found], np.float32)
    x = [np.frombuffer(r.passages, np.float32).reshape(-1, FEATURES) for r in found]
    first = np.concatenate([[0], np.cumsum([len(a) for a in x])])
    x = np.concatenate(x)
    model = Attention.start(x, HIDDEN, ATTENTION, SEED)
    model.fit(x, first, y, epochs, RATE, DECAY)
    return model


def held_out_by(modulus: int, rest: int) -> Column:
    return (F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == rest) & F.col("doc_id").isNotNull()


def scored(docs: DataFrame, model: Attention | None, held_out: Column, predict_at: float = PREDICT_AT, words: int = PASSAGE_WORDS) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs(doc_id, text, ...).

    Null, empty and blank texts are one passage of zeros and scored like any. A null doc_id is not held out. Without
    a model (no labels of both kinds) every score is 0.5. Repeated rows each give a row, an empty table none; further
    columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            off, data = text_buffer(batch.column("text"))
            scores = [np.zeros(0)]
            for i, j in chunks(off):
                x, first = passage_statistics(data, off[i : j + 1], words)
                scores.append(model.score(x, first) if model else np.full(j - i, 0.5))
            score = np.concatenate(scores).astype(np.float64)
            yield pa.record_batch([batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= predict_at).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def quality(docs: DataFrame, labels: DataFrame, modulus: int = 5, rest: int = 0, sample: int = SAMPLE) -> DataFrame:
    """Scores of all docs by a model that learns from labels whose crc32(doc_id as text) mod `modulus` is not `rest`."""
    held_out = held_out_by(modulus, rest)
    return scored(docs, fit(docs, labels, ~held_out, sample=sample), held_out)


def keep_good(docs: DataFrame, labels: DataFrame, modulus: int = 5, rest: int = 0, sample: int = SAMPLE, keep_at: float = PREDICT_AT, words: int = PASSAGE_WORDS) -> DataFrame:
    """The rows of docs with a score of keep_at at least, with all their columns; all rows without a model.

    Null and empty texts are scored like any; repeated rows are judged alike; an empty table gives an empty result;
    columns may have any names.
    """
    model = fit(docs, labels, ~held_out_by(modulus, rest), sample=sample)
    if model is None:
        return docs
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            off, data = text_buffer(batch.column(at))
            scores = [np.zeros(0)]
            for i, j in chunks(off):
                scores.append(model.score(*passage_statistics(data, off[i : j + 1], words)))
            yield batch.filter(pa.array(np.concatenate(scores) >= keep_at))

    return docs.mapInArrow(run, docs.schema)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
