"""License scans: an exact set-similarity join of text blocks with license templates.

Template tokens are ordered by their frequency in the whole corpus, rarest first. A block can hold enough of a
template only if it has a token of the template's prefix (all but the last needed ones); candidates then pass a length
filter and a positional filter, which bounds what the rest of both can still share, before the exact count.
A template also names the tokens that tell it from others (mit, lesser, nc), which the block must have; and where all
tokens of a template found belong to a wider one that is found as fully in the same block, the wider one alone counts.
Blocks are the lines of a text; of a longer line, every window of WINDOW words, STEP apart. A template that is wrapped
over lines counts where a stretch of the whole text, as long as the template and 1 / threshold of that at most, holds
enough of it: in wider windows, words of unrelated lines would add up to a short template.

The templates are a fixed short list, so each task holds them and no text is shuffled; the only thing gathered is one
count for each template token.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewrack.llm.common import documents

THRESHOLD = 0.8
WINDOW, STEP = 64, 32
#: Phrases whose every place counts, and their labels.
BASE = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}
#: Label, wording (of which the distinct tokens count), and the tokens that a block must have in any case.
TEMPLATES = (
    ("mit", "released under the mit license", "mit"),
    ("mit", "licensed under the mit license", "mit"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "granted charge obtaining"),
    ("mit", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", "restriction sublicense"),
    ("apache", "licensed under the apache license version 2 0", "apache"),
    ("apache", "you may not use this file except in compliance with the license", "file except compliance"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", "applicable agreed writing"),
    ("gpl", "licensed under the gnu general public license version 3", "gnu general public"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license", "redistribute gnu general"),
    ("lgpl", "licensed under the gnu lesser general public license", "lesser"),
    ("lgpl", "you can redistribute it and or modify it under the terms of the gnu lesser general public license", "redistribute lesser"),
    ("agpl", "licensed under the gnu affero general public license", "affero"),
    ("agpl", "you can redistribute it and or modify it under the terms of the gnu affero general public license", "redistribute affero"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution binary forms"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "redistributions retain disclaimer"),
    ("bsd", "licensed under the bsd license", "bsd"),
    ("mpl", "subject to the terms of the mozilla public license", "mozilla"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "purpose fee granted"),
    ("zlib", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely", "anyone alter freely"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered"),
    ("cc-by", "licensed under cc by 4 0", "cc by"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-nd", "licensed under cc by nd 4 0", "cc by nd"),
    ("cc0", "released under cc0 1 0 universal public domain dedication", "cc0"),
    ("proprietary", "all rights reserved no part may be reproduced without permission", "reserved reproduced"),
)
#: Bytes of words stay, A-Z lowered; line feeds stay; all else becomes a space.
_WORDS = bytes(b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 or b == 10 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def _texts(batch: pa.RecordBatch) -> Iterator[bytes]:
    for text in batch.column("text").cast(pa.binary()).to_pylist():
        yield (text or b"").translate(_WORDS)


def blocks(line: list[bytes], window: int = WINDOW, step: int = STEP) -> Iterator[list[bytes]]:
    """The words of a line if they are few, else windows a step apart, the last one full."""
    if len(line) <= window:
        yield line
    else:
        for i in range(ceil((len(line) - window) / step) + 1):
            at = min(i * step, len(line) - window)
            yield line[at : at + window]


class Matcher:
    """Templates in the corpus order of their tokens."""

    def __init__(self, templates: list[tuple[str, str, str]], counts: dict[str, int], threshold: float):
        self.order: dict[bytes, tuple[int, str]] = {t.encode(): (counts.get(t, 0), t) for _, words, _ in templates for t in words.split()}
        self.templates, self.stretch, self.by_prefix = [], [], {}
        for n, (label, words, always) in enumerate(templates):
            tokens = sorted({w.encode() for w in words.split()}, key=self.order.__getitem__)
            need = ceil(threshold * len(tokens) - 1e-9)
            self.templates.append((label, tokens, need, frozenset(w.encode() for w in always.split())))
            self.stretch.append(ceil(len(words.split()) / threshold - 1e-9))
            for i, token in enumerate(tokens[: len(tokens) - need + 1]):
                self.by_prefix.setdefault(token, []).append((n, i))
        self.prefix = frozenset(self.by_prefix)
        sets = [frozenset(tokens) for _, tokens, _, _ in self.templates]
        #: Templates that hold all of a template's tokens and more.
        self.wider = [[m for m, other in enumerate(sets) if own < other] for own in sets]

    def best(self, shares: dict[int, float]) -> Iterator[tuple[str, float]]:
        """Label and share of each template found, but for those of which a wider one is found as well: it says all that they say."""
        for n, share in shares.items():
            if not any(shares.get(m, 0.0) >= share for m in self.wider[n]):
                yield self.templates[n][0], share

    def find(self, block: list[bytes]) -> Iterator[tuple[str, float]]:
        own = set(block)
        known = sorted((t for t in own if t in self.order), key=self.order.__getitem__)
        seen, shares = set(), {}
        for j, token in enumerate(known):
            for n, i in self.by_prefix.get(token, ()):
                _, tokens, need, always = self.templates[n]
                if n in seen or len(own) < need:
                    continue
                seen.add(n)  # at the first shared token, so nothing before it is shared
                if 1 + min(len(tokens) - i - 1, len(known) - j - 1) >= need and always <= own:
                    shared = sum(t in own for t in tokens)
                    if shared >= need:
                        shares[n] = shared / len(tokens)
        return self.best(shares)

    def wrapped(self, words: list[bytes]) -> Iterator[tuple[str, float]]:
        """Templates of which a stretch of the words, whatever the line ends, holds enough."""
        places: dict[bytes, list[int]] = {}
        for at, word in enumerate(words):
            if word in self.order:
                places.setdefault(word, []).append(at)
        shares = {}
        for n, ((_, tokens, need, always), size) in enumerate(zip(self.templates, self.stretch, strict=True)):
            if sum(t in places for t in tokens) < need or not all(t in places for t in always):
                continue
            inside, most, left = Counter(), 0, 0
            hits = sorted((at, t) for t in tokens for at in places.get(t, ()))
            for at, token in hits:
                inside[token] += 1
                while at - hits[left][0] >= size:
                    gone = hits[left][1]
                    inside[gone] -= 1
                    if not inside[gone]:
                        del inside[gone]
                    left += 1
                if len(inside) > most and all(t in inside for t in always):
                    most = len(inside)
            if most >= need:
                shares[n] = most / len(tokens)
        return self.best(shares)


def token_counts(docs: DataFrame, templates=TEMPLATES) -> dict[str, int]:
    """How often each template token occurs in all texts."""
    wanted = frozenset(t.encode() for _, words, _ in templates for t in words.split())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for text in _texts(batch):
                counts.update(filter(wanted.__contains__, text.split()))
        yield pa.record_batch([pa.array([t.decode() for t in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], ["token", "n"])

    rows = docs.select("text").mapInArrow(run, "token string, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    return {r.token: r.n for r in rows}


def phrases(words: list[bytes], base: dict) -> list[tuple[int, str]]:
    """Start and label of each place where a phrase's words stand in sequence."""
    ends: dict[bytes, list] = {}
    for phrase, label in base.items():
        own = [w.encode() for w in phrase]
        ends.setdefault(own[-1], []).append((own, label))
    at = []
    for last, found in ends.items():
        i = -1
        for _ in range(words.count(last)):
            i = words.index(last, i + 1)
            at += [(i - len(own) + 1, label) for own, label in found if i >= len(own) - 1 and words[i - len(own) + 1 : i + 1] == own]
    return at


def license_scan(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD, base=None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for each row of docs(doc_id, text, ...).

    score: 1 with a base phrase, else the largest share of a template found in a block or a stretch over lines, 0 without any. Null and empty
    texts have no words and empty labels; repeated rows each give a row; a null doc_id stays null; an empty table gives
    an empty result; further columns are not read.
    """
    base = BASE if base is None else base
    matcher = Matcher(list(templates), token_counts(docs, templates), threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_words = frozenset(p[-1].encode() for p in base)
        for whole in batches:
            for k in range(0, whole.num_rows, 2048):
                batch = whole.slice(k, 2048)
                rows = []
                for text in _texts(batch):
                    words = text.split()
                    found = [] if last_words.isdisjoint(words) else phrases(words, base)
                    score, labels = float(bool(found)), {label for _, label in found}
                    if not matcher.prefix.isdisjoint(words):
                        shares = list(matcher.wrapped(words)) if b"\n" in text else []
                        for line in text.split(b"\n"):
                            for block in blocks(line.split()):
                                if not matcher.prefix.isdisjoint(block):
                                    shares += matcher.find(block)
                        for label, share in shares:
                            labels.add(label)
                            score = max(score, share)
                    starts = [i for i, _ in found]
                    rows.append((len(words), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found})), ",".join(sorted(labels)), score))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64())
                yield pa.record_batch([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True))], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(documents(spark, sf_dir))


def _sql() -> str:
    listed = ", ".join(f"({n}, '{label}', {sorted(set(words.split()))}, {always.split()})" for n, (label, words, always) in enumerate(TEMPLATES))
    return rf"""
WITH t(n, label, tokens, always) AS (VALUES {listed}),
wider AS (SELECT a.n, b.n AS other FROM t a JOIN t b ON len(a.tokens) < len(b.tokens) AND list_has_all(b.tokens, a.tokens)),
d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM d),
b AS (SELECT doc_id, unnest(
    list_transform(list_filter(range(1, len(words)), lambda i: words[i + 1] = 'license' AND words[i] IN ('mit', 'apache')), lambda i: {{'start': i - 1, 'label': words[i]}})
    || list_transform(list_filter(range(1, len(words) - 1), lambda i: words[i + 2] = 'license' AND words[i + 1] = 'public' AND words[i] = 'general'), lambda i: {{'start': i - 1, 'label': 'gpl'}})) AS hit FROM w),
bs AS (SELECT doc_id, count(*) AS n_base, min(hit.start) AS first_word, max(hit.start) AS last_word, string_agg(DISTINCT hit.label, ',' ORDER BY hit.label) AS base_labels FROM b GROUP BY doc_id),
l AS (SELECT doc_id, regexp_extract_all(line, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)),
k AS (SELECT doc_id, row_number() OVER () AS id, block FROM (SELECT doc_id, unnest(CASE WHEN len(words) <= {WINDOW} THEN [words]
    ELSE list_transform(range(0, CAST(ceil((len(words) - {WINDOW}) / {STEP}.0) AS BIGINT) + 1), lambda i: list_slice(words, least(i * {STEP}, len(words) - {WINDOW}) + 1, least(i * {STEP}, len(words) - {WINDOW}) + {WINDOW})) END) AS block FROM l)),
f AS (SELECT doc_id, id, n, label, len(list_intersect(list_distinct(block), tokens)) / len(tokens) AS share FROM k, t
    WHERE len(list_intersect(list_distinct(block), tokens)) >= ceil({THRESHOLD} * len(tokens) - 1e-9) AND list_has_all(block, always)),
c AS (SELECT doc_id, label, max(share) AS share FROM f WHERE NOT EXISTS (SELECT 1 FROM wider w JOIN f o ON o.n = w.other WHERE w.n = f.n AND o.id = f.id AND o.share >= f.share) GROUP BY doc_id, label),
a AS (SELECT doc_id, label, share FROM c UNION ALL SELECT doc_id, hit.label, 1.0 FROM b),
s AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score FROM a GROUP BY doc_id)
SELECT w.doc_id, len(words) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM w LEFT JOIN bs USING (doc_id) LEFT JOIN s USING (doc_id)
"""


OP2_SQL = _sql()
