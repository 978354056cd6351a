"""BPE encoding and decoding with a public vocabulary, by batched numpy merge rounds.

The words of many texts that were not seen lately lie as symbols in one flat array. In each round every word merges
its lowest-ranked pair at all its places; ranks are found by binary search over the sorted pair keys. Words that
have no pair left drop out, so later rounds touch little.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from tidewrack.llm.common import byte_sums, chunks, documents, mix, spread, text_buffer

VOCABULARY = "byte_bpe_50k.json"
#: Bytes of text whose words are encoded together.
CHUNK_BYTES = 3 << 20
#: Most words that a Python worker remembers with their ids (and those of a chunk); the encoding doesn't depend on it.
CACHE_WORDS = 1_000_000
_NONE = np.int32(2**31 - 1)
_LETTER, _NUMBER, _SPACE = 1, 2, 3  # all else is 0


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}


@cache
def kinds() -> np.ndarray:
    """Letter, number, white space or other, for each code point."""
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    text, out = "".join(map(chr, points)), np.zeros(0x110000, np.uint8)
    for kind, pattern in ((_LETTER, r"\p{L}"), (_NUMBER, r"\p{N}"), (_SPACE, r"\p{White_Space}")):
        out[[ord(c) for c in regex.findall(pattern, text)]] = kind
    return out


def word_starts(points: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Where words begin in code points that hold texts one after the other; docs: where each text begins, in order, without repeats.

    Words are runs of letters, of numbers or of other signs, each with one space (U+0020) before it; an apostrophe
    that begins a word takes s, t, m, d, re, ve or ll after it; other white space stands by itself, up to the last of
    its signs before a word.
    """
    kind = kinds()[points]
    n = len(points)
    head = np.zeros(n, bool)
    head[docs] = True
    start = head.copy()
    start[1:] |= kind[1:] != kind[:-1]
    space = kind == _SPACE
    follows = np.zeros(n, bool)  # a sign after white space of its own text
    follows[1:] = ~space[1:] & space[:-1] & ~head[1:]
    at = np.flatnonzero(follows)
    start[at - 1] = True
    start[at[points[at - 1] == 32]] = False
    at = np.flatnonzero((points == 39) & start)
    at = at[at + 1 < n]
    if len(at):
        end = np.append(docs[1:], n)[np.searchsorted(docs, at, "right") - 1]
        one = points[np.minimum(at + 1, n - 1)]
        two = points[np.minimum(at + 2, n - 1)]
        is_in = lambda x, letters: np.isin(x, [ord(c) for c in letters])
        short = is_in(one, "stmd") & (at + 1 < end)
        long = ((is_in(one, "rv") & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))) & (at + 2 < end)
        for found, size in ((short, 2), (long & ~short, 3)):
            start[at[found] + 1] = False
            after = at[found] + size
            start[after[after < n]] = True
    return np.flatnonzero(start)


class Spans:
    """Numbered runs of values in one array that grows."""

    def __init__(self, kind: type):
        self.at, self.n, self.values, self.end = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1 << 16, kind), 0

    def insert(self, where: np.ndarray, values: np.ndarray, n: np.ndarray) -> None:
        end = self.end + len(values)
        if end > len(self.values):
            self.values = np.concatenate([self.values, np.zeros(end, self.values.dtype)])
        self.values[self.end : end] = values
        self.at = np.insert(self.at, where, self.end + np.cumsum(n) - n)
        self.n = np.insert(self.n, where, n)
        self.end = end


class BatchedBPE:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab, letters = spec["model"]["vocab"], byte_letters()
        self.special = {t["content"].encode(): t["id"] for t in spec["added_tokens"]}
        self.byte_id = np.zeros(256, np.int32)
        for letter, b in letters.items():
            self.byte_id[b] = vocab[letter]
        self.size = 1 + max([*vocab.values(), *self.special.values()])
        text = {i: bytes(letters[c] for c in t) for t, i in vocab.items() if t.encode() not in self.special} | {i: t for t, i in self.special.items()}
        pieces = [text.get(i, b"") for i in range(self.size)]
        self.piece_len = np.array([len(p) for p in pieces], np.int64)
        self.piece_start = np.concatenate([[0], np.cumsum(self.piece_len)[:-1]])
        self.blob = np.frombuffer(b"".join(pieces), np.uint8)
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int32)
        keys, first = np.unique(keys, return_index=True)
        self.keys, self.ranks = np.append(keys, 2**62), np.append(first, 0).astype(np.int32)
        self.made = made
        self.forget()

    def forget(self) -> None:
        """Drops the words remembered from chunk to chunk: sorted hashes, each with its place in the ids."""
        self.known = np.zeros(0, np.uint64)
        self.words, self.ids = Spans(np.uint8), Spans(np.int32)

    def remember(self, hashes: np.ndarray, words: np.ndarray, sizes: np.ndarray) -> None:
        """hashes: sorted, none of them known; words: their bytes, one word after the other."""
        if len(self.known) + len(hashes) > CACHE_WORDS:
            self.forget()
        at = np.searchsorted(self.known, hashes)
        self.known = np.insert(self.known, at, hashes)
        self.words.insert(at, words, sizes)
        self.ids.insert(at, *self.merge(words, sizes))

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) * self.size + right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE)

    def merge(self, data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words that lie in `data` one after the other, and how many each has."""
        symbols, word = self.byte_id[data], np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
        done_symbols, done_words = [], []
        rank = np.full(len(symbols), _NONE)
        rank[:-1] = self.rank(symbols[:-1], symbols[1:])
        rank[:-1][word[1:] != word[:-1]] = _NONE
        while len(symbols):
            starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            low = np.minimum.reduceat(rank, starts)
            low = np.repeat(low, np.diff(np.append(starts, len(symbols))))
            live = low != _NONE
            if not live.all():
                done_symbols.append(symbols[~live])
                done_words.append(word[~live])
                symbols, word, rank, low = symbols[live], word[live], rank[live], low[live]
                if not len(symbols):
                    break
            chosen = rank == low
            if (chosen[1:] & chosen[:-1]).any():  # as in aaa: from the left, every other place
                places = np.arange(len(chosen))
                head = chosen & ~np.concatenate([[False], chosen[:-1]])
                chosen &= (places - np.maximum.accumulate(np.where(head, places, 0))) % 2 == 0
            spots = np.flatnonzero(chosen)
            symbols[spots] = self.made[low[spots]]
            stay = np.ones(len(symbols), bool)
            stay[spots + 1] = False
            spots -= np.arange(len(spots))
            symbols, word, rank = symbols[stay], word[stay], rank[stay]
            touched = np.zeros(len(symbols), bool)
            touched[spots] = True
            touched[spots[spots > 0] - 1] = True
            near = np.flatnonzero(touched)
            rank[near] = _NONE
            near = near[near + 1 < len(symbols)]
            near = near[word[near] == word[near + 1]]
            rank[near] = self.rank(symbols[near], symbols[near + 1])
        words = np.concatenate([np.zeros(0, np.int32), *done_words])
        order = np.argsort(words, kind="stable")
        return np.concatenate([np.zeros(0, np.int32), *done_symbols])[order], np.bincount(words, minlength=len(lengths))

    def encode_plain(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts without special tokens, `off` in `data`, one after the other, and where each text's begin (one more than texts)."""
        base = int(off[0])
        part = data[base : int(off[-1])]
        if not len(part):
            return np.zeros(0, np.uint32), np.zeros(len(off), np.int64)
        points = np.frombuffer(part.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        first = np.unique(off[:-1][off[:-1] < off[-1]]) - base
        if len(points) == len(part):
            starts = word_starts(points, first)
        else:
            lead = np.flatnonzero((part & 0xC0) != 0x80)
            starts = lead[word_starts(points, np.searchsorted(lead, first))]
        lengths = np.diff(np.append(starts, len(part)))
        place = np.arange(len(part)) - np.repeat(starts, lengths)
        hashes = byte_sums(part.astype(np.uint16) + np.uint16(1), place, starts)
        hashes = mix(hashes + lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        order = np.argsort(hashes)
        hashes = hashes[order]
        new = np.ones(len(hashes), bool)
        new[1:] = hashes[1:] != hashes[:-1]
        back = np.empty(len(order), np.int64)
        back[order] = np.cumsum(new) - 1
        hashes, which = hashes[new], order[new]
        at = np.searchsorted(self.known, hashes)
        known = at < len(self.known)
        known[known] = self.known[at[known]] == hashes[known]
        if not known.all():
            fresh = which[~known]
            before = len(self.known)
            self.remember(hashes[~known], part[spread(starts[fresh], lengths[fresh])], lengths[fresh])
            if len(self.known) != before + len(fresh) and known.any():  # the memory was full
                self.forget()
                self.remember(hashes, part[spread(starts[which], lengths[which])], lengths[which])
            at = np.searchsorted(self.known, hashes)
        mine = at[back]
        counts = self.ids.n[mine]
        other = self.words.n[mine] != lengths  # equal hashes prove nothing: each word is held against the remembered one
        same = np.flatnonzero(~other)
        differ = self.words.values[spread(self.words.at[mine[same]], lengths[same])] != (part if len(same) == len(mine) else part[spread(starts[same], lengths[same])])
        if differ.any():
            heads = np.cumsum(lengths[same]) - lengths[same]
            other[same] |= np.logical_or.reduceat(differ, heads)
        ids = self.ids.values[spread(self.ids.at[mine], counts)]
        if other.any():
            odd = np.flatnonzero(other)
            found, n = self.merge(part[spread(starts[odd], lengths[odd])], lengths[odd])
            source = self.ids.at[mine]
            source[odd] = len(self.ids.values) + np.cumsum(n) - n
            counts[odd] = n
            ids = np.concatenate([self.ids.values, found])[spread(source, counts)]
        total = np.cumsum(counts)
        return ids.astype(np.uint32), np.concatenate([[0], total])[np.searchsorted(starts, off - base)]

    def encode_column(self, column: pa.Array) -> Iterator[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; a special token's string in a text is that token. A null has none."""
        off, data = text_buffer(column)
        for i, j in chunks(off, CHUNK_BYTES):
            part = data[off[i] : off[j]].tobytes()
            if any(s in part for s in self.special):
                yield from (self.encode_mixed(part[a - off[i] : b - off[i]]) for a, b in zip(off[i:j].tolist(), off[i + 1 : j + 1].tolist(), strict=True))
            else:
                ids, at = self.encode_plain(data, off[i : j + 1])
                raw, at = ids.tobytes(), (at * 4).tolist()
                yield from (raw[a:b] for a, b in zip(at[:-1], at[1:], strict=True))

    def encode_mixed(self, text: bytes) -> bytes:
        parts = regex.split(b"(" + b"|".join(map(regex.escape, self.special)) + b")", text)
        plain = lambda p: self.encode_plain(np.frombuffer(p, np.uint8), np.array([0, len(p)]))[0].tobytes()
        return b"".join(self.special[p].to_bytes(4, "little") if n % 2 else plain(p) for n, p in enumerate(parts))

    def decode_bytes(self, ids: bytes) -> bytes:
        tokens = np.frombuffer(ids, "<u4").astype(np.int64)
        lengths = self.piece_len[tokens]
        ends = np.cumsum(lengths)
        if not len(ends):
            return b""
        return self.blob[np.repeat(self.piece_start[tokens] - ends + lengths, lengths) + np.arange(ends[-1])].tobytes()

    def decode(self, ids: bytes) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


_LOADED: dict[str, BatchedBPE] = {}


def loaded(path: str) -> BatchedBPE:
    """One encoder for each vocabulary in a Python worker, kept from task to task."""
    if path not in _LOADED:
        _LOADED[path] = BatchedBPE(path)
    return _LOADED[path]


def slices(batch: pa.RecordBatch, rows: int = 512) -> Iterator[pa.RecordBatch]:
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids (binary: little-endian unsigned 32-bit) for each row of docs(doc_id, text, ...); null and empty texts have no ids."""
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for whole in batches:
            for batch in slices(whole):
                yield pa.record_batch([batch.column("doc_id"), pa.array(list(bpe.encode_column(batch.column("text"))), pa.binary())], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids binary")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, text for each row of encoded(doc_id, ids); null ids give an empty text, bytes that are no UTF-8 give U+FFFD."""
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for whole in batches:
            for batch in slices(whole):
                yield pa.record_batch([batch.column("doc_id"), pa.array([bpe.decode(x or b"") for x in batch.column("ids").to_pylist()], pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: each text encoded and decoded again in one pass, without a shuffle.

    Null and empty texts have 0 tokens and the digests of no bytes. Texts of any length are encoded whole, repeated
    rows each give a row, a null doc_id stays null, further columns are not read.
    """
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, sha = loaded(path), hashlib.sha256
        for whole in batches:
            for batch in slices(whole):
                n, ids_sha, text_sha = [], [], []
                for ids in bpe.encode_column(batch.column("text")):
                    n.append(len(ids) // 4)
                    ids_sha.append(sha(ids).hexdigest())
                    text_sha.append(sha(bpe.decode(ids).encode()).hexdigest())
                yield pa.record_batch([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(documents(spark, sf_dir))
