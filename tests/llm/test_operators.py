"""Each operator against a library, SQL or a brute-force version, and on odd input."""

import hashlib
import json
import re
import time
import zlib
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tests.oracle import SF, connect, same
from tidewrack.llm import bpe, exact_dedup, fingerprints, html_main, licenses, minhash, packing, quality, substring, toxicity
from tidewrack.llm.common import SIGNS, components, free_name, text_buffer, word_hashes, word_spans
from tidewrack.llm.queries import QUERIES, SQL
from tidewrack.scratch import Scratch

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.integers(40)) for _ in range(n))


def make(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, blank, very long, repeated rows, ties, and extra columns named like the operators' own."""
    long = prose(np.random.default_rng(5), 30_000) + " " + "x" * 50_000
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "One two three"), (4, "One two three"), (5, "one  two\nthree"), (6, long), (7, "Ünï 日本語 🎉 <|endoftext|> x"), (None, "no id"), (None, None), (8, "!!!! ????"), (9, "of " * 300)]
    df = make(spark, rows)
    return df.withColumns({c: F.lit("clash") for c in ("digest", "run", "kept", "score", "_sha", "_own_id", "_cuts", "component_id", "at", "part", "sequence_id", "y", "held_out")}).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(1, 9)], "doc_id long, quality int, toxic int")


def test_odd_input_everywhere(spark, odd, labels):
    none = odd.limit(0)
    runs = {
        "bpe": bpe.round_trip, "licenses": licenses.license_scan, "fingerprints": fingerprints.neighbours, "minhash": minhash.near_dedup, "exact": exact_dedup.exact_dedup,
        "toxicity": lambda d: toxicity.toxicity(d, labels), "quality": lambda d: quality.quality(d, labels),
    }
    for name, f in runs.items():
        rows = f(odd).collect()
        assert len(rows) == 12, name
        assert sorted(str(r.doc_id) for r in rows) == sorted(["None", "None", *map(str, [1, 2, 3, 4, 4, 5, 6, 7, 8, 9])]), name
        assert f(none).collect() == [], name
    packed = packing.pack(odd).collect()
    assert {r.doc_id for r in packed} == {None, *range(1, 10)} and packing.pack(none).collect() == []
    assert substring.repeated_passages(none).collect() == []
    assert substring.repeated_passages(odd).columns == [c.split()[0] for c in substring.SPAN.split(", ")]
    assert not toxicity.toxicity(odd, labels.limit(0)).where("score <> 0.5").count()
    assert not quality.quality(odd, labels.limit(0)).where("score <> 0.5").count()


def test_odd_input_in_the_pipeline(spark, odd, labels, tmp_path):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for docs in (odd, odd.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == odd.columns
            out.collect()
    kept = exact_dedup.keep_first(odd).select("doc_id", "text").collect()
    assert sorted(r.doc_id for r in kept if r.doc_id) == [1, 3, 4, 5, 6, 7, 8, 9]


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, name):
    same(QUERIES[name](spark, SF), SQL[name], connect())


# --- shared parts ---------------------------------------------------------------------------------------


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="aB z\n\té日 \x0b", max_size=12), max_size=6))
def test_word_spans_and_hashes(texts):
    off, data = text_buffer(pa.array(texts, pa.string()))
    starts, ends, at = word_spans(data, off)
    words = [w for t in texts for w in re.findall(rb"[^\x20\x09-\x0D]+", t.encode())]
    assert [bytes(data[a:b]) for a, b in zip(starts, ends, strict=True)] == words
    assert np.diff(at).tolist() == [len(re.findall(rb"[^\x20\x09-\x0D]+", t.encode())) for t in texts]
    hashes, _ = word_hashes(data, off)
    low = [w.translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))) for w in words]
    assert len(set(zip(low, hashes.tolist(), strict=True))) == len(set(low)) == len(set(hashes.tolist()))
    signs, _, _ = word_spans(data, off, SIGNS)
    assert len(signs) == sum(len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t))) for t in texts)


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(i, i + 1) for i in range(1000, 1040)] + [(2000, 2000)] + [(3000 + i * 7 % 1500, 3700) for i in range(1, 1500)]
    parent = {v: v for e in edges for v in e}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()}
    assert got == {v: root(v) for v in parent}


def test_free_name(spark):
    assert free_name(spark.createDataFrame([(1, 2)], "x int, X_ int"), "x") == "x__"


# --- BPE and packing ------------------------------------------------------------------------------------

PATH = bpe.vocabulary_path()
TOKENIZER = Tokenizer.from_file(PATH)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=40), st.text(alphabet="ab 's't're'll \n\t12!!aaaa", max_size=60)), max_size=5))
def test_bpe_equals_tokenizers(texts):
    model = bpe.loaded(PATH)
    for text, ids in zip(texts, model.encode_column(pa.array(texts, pa.string())), strict=True):
        want = TOKENIZER.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want
        assert model.decode(ids) == TOKENIZER.decode(want, skip_special_tokens=False)


def test_bpe_long_words_special_tokens_and_full_memory(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 3)
    model = bpe.BatchedBPE(PATH)
    texts = ["a" * 9999, "ab" * 5000, "x<|endoftext|> y<|endoftext|>", "<|endoftext|>", "one two three four five", "don't 've 'S", "\u0085 　a"]
    for text, ids in zip(texts, model.encode_column(pa.array(texts)), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids


def thue_morse(n):
    """Two words of the letters a and b that polynomial hashes modulo 2^64 can't tell apart from n = 1,024 on."""
    word = "".join("ab"[i.bit_count() % 2] for i in range(n))
    return [word, word.translate(str.maketrans("ab", "ba"))]


def test_bpe_tells_words_apart_whatever_their_hashes(monkeypatch):
    texts = [w for n in (1024, 2048, 4096) for w in thue_morse(n)] + ["the quick brown fox", "pack my box with five dozen jugs", "fox box pox five dozen"]
    plain = bpe.byte_sums
    for bits in (2**64 - 1, 3):
        monkeypatch.setattr(bpe, "byte_sums", lambda *a, bits=bits: plain(*a) & np.uint64(bits))
        model = bpe.BatchedBPE(PATH)
        for _ in range(2):
            for text, ids in zip(texts, model.encode_column(pa.array(texts)), strict=True):
                assert np.frombuffer(ids, "<u4").tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids


def test_op1_rows(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op1_bpe"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = TOKENIZER.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(TOKENIZER.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert {r.doc_id: r.text for r in bpe.decode(bpe.encode(docs)).collect()} == texts


def test_op7_rows(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op7_packing"](spark, SF).collect()
    by_doc, by_bin = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_bin.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(texts)
    total = 0
    for doc, own in by_doc.items():
        ids = np.array([*TOKENIZER.encode(texts[doc] or "", add_special_tokens=False).ids, 2], "<u4")
        own.sort(key=lambda r: r.piece)
        assert [(r.piece, r.start) for r in own] == list(enumerate(np.cumsum([0, *(r.length for r in own)])[:-1].tolist()))
        assert sum(r.length for r in own) == len(ids) and all(r.length == 1024 for r in own[1:])
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in own)
        total += len(ids)
    for own in by_bin.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == np.cumsum([0, *(r.length for r in own)])[:-1].tolist() and sum(r.length for r in own) <= 1024
    assert len(by_bin) <= 1.02 * total / 1024 + 2


def test_sum_of_squares_takes_the_least_sum():
    rng = np.random.default_rng(3)
    lengths, capacity = rng.integers(1, 31, 300), 30
    where, offset = packing.sum_of_squares(lengths, capacity)
    gaps = {}
    for size, b, at in zip(lengths.tolist(), where.tolist(), offset.tolist(), strict=True):
        options = {}
        for gap in {g for g in gaps.values() if g >= size}:
            after = list(gaps.values())
            after.remove(gap)
            after.append(gap - size)
            counts = np.bincount([g for g in after if g > 0], minlength=capacity)
            options[gap] = int((counts**2).sum())
        if options:
            assert options[gaps[b]] == min(options.values())
        assert at == capacity - gaps.get(b, capacity)
        gaps[b] = gaps.get(b, capacity) - size
    assert packing.cut(2500, 1024) == [(0, 452), (452, 1024), (1476, 1024)] and packing.cut(1024, 1024) == [(0, 1024)]


# --- licenses, fingerprints -----------------------------------------------------------------------------


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("released under the mit license licensed apache version 2 0 gnu general public lesser cc by nc 4 x y".split()), max_size=70))
def test_license_filters_lose_nothing(words):
    counts = {w: n * 7919 % 13 for n, w in enumerate(sorted({w for _, t, _ in licenses.TEMPLATES for w in t.split()}))}
    matcher = licenses.Matcher(list(licenses.TEMPLATES), counts, licenses.THRESHOLD)
    block = [w.encode() for w in words]
    found = {}
    for n, (label, text, always) in enumerate(licenses.TEMPLATES):
        own = {w.encode() for w in text.split()}
        if len(own & set(block)) >= licenses.THRESHOLD * len(own) - 1e-9 and set(always.encode().split()) <= set(block):
            found[n] = (label, len(own & set(block)) / len(own), own)
    want = {(label, share) for label, share, own in found.values() if not any(own < other and more >= share for _, more, other in found.values())}
    assert set(matcher.find(block)) == want


def test_license_rows(spark):
    texts = ["Released under the MIT License.", "MIT license mit LICENSE apache license general public license public license", "see license", "free x " * 90 + "licensed under cc by nc 4.0 " + "tail " * 90]
    rows = {r.doc_id: r for r in licenses.license_scan(make(spark, enumerate(texts))).collect()}
    assert (rows[0].n_base, rows[0].first_word, rows[0].labels, rows[0].score) == (1, 3, "mit", 1.0)
    assert (rows[1].n_base, rows[1].first_word, rows[1].last_word, rows[1].base_labels, rows[1].n_words) == (4, 0, 6, "apache,gpl,mit", 11)
    assert (rows[2].n_base, rows[2].first_word, rows[2].labels, rows[2].score) == (0, None, "", 0.0)
    assert (rows[3].labels, rows[3].base_labels, rows[3].score) == ("cc-by-nc", "", 1.0)


def test_license_labels(spark):
    want = {
        "Licensed under the MIT license": "mit", "licensed under the Apache License": "apache", "released under the license": "", "licensed under the license": "",
        "licensed under the GNU Lesser General Public License": "gpl,lgpl", "licensed under the GNU General Public License version 2": "gpl", "licensed under the GNU Affero General Public License": "agpl,gpl",
        "licensed under CC BY NC 4.0": "cc-by-nc", "licensed under CC BY 4.0": "cc-by", "licensed under CC BY-SA 4.0": "cc-by-sa", "Licensed under the BSD license": "bsd",
        "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License": "gpl,lgpl",
        "you may not use this file except in compliance with the License": "apache", "we use this file in the license of the public domain": "", "Permission to enter is granted free of charge to any person": "",
    }
    rows = licenses.license_scan(make(spark, enumerate(want))).collect()
    assert {list(want)[r.doc_id]: r.labels for r in rows} == want
    wrapped = licenses.license_scan(make(spark, enumerate(t.replace(" ", "\n") for t in want))).collect()
    assert {list(want)[r.doc_id]: r.labels for r in wrapped} == want




def test_licenses_wrapped_over_lines(spark):
    wrapped = {
        "bsd": "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions",
        "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the",
        "isc": "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided",
        "gpl": "you can redistribute it and/or modify\nit under the terms of the GNU General\nPublic\nLicense",
    }
    rows = licenses.license_scan(make(spark, enumerate(f"{'some words before ' * n}\n{t}\n{'and after ' * 50}" for n in (0, 10, 17, 40) for t in wrapped.values()))).collect()
    assert all(list(wrapped)[r.doc_id % 4] in r.labels.split(",") and r.score == 1.0 for r in rows)


def test_fingerprint_rows(spark):
    rng = np.random.default_rng(2)
    texts = {i * 3: prose(rng, int(rng.integers(0, 400))) for i in range(60)}
    texts[300] = texts[3]
    rows = {r.doc_id: r for r in fingerprints.neighbours(make(spark, texts.items()).repartition(5), range_rows=7).collect()}
    order = sorted(texts, reverse=True)

    def shingles(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())

    assert len(rows) == len(texts)
    errors = []
    for n, i in enumerate(order):
        text, after = texts[i], texts[order[(n + 1) % len(order)]]
        cut = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        r = rows[i]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(cut.encode()).hexdigest()
        a, b = shingles(text), shingles(cut)
        if len(a) > 100:
            share = len(a & b) / len(a | b)
            errors.append((r.near_edited - share) / (share * (1 - share) / (fingerprints.FRACTION * len(a | b)) + 1e-6) ** 0.5)
    assert rows[300].fingerprint == rows[3].fingerprint
    assert 0.7 < np.mean(np.square(errors)) ** 0.5 < 1.3 and abs(np.mean(errors)) < 3 / len(errors) ** 0.5  # as a random sample of the union's shingles
    one = fingerprints.neighbours(make(spark, [(5, "a b c d e f")])).collect()[0]
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(b"a b c a b c").hexdigest()


def test_fingerprints_near_next_against_full_sets(spark):
    rng = np.random.default_rng(22)
    texts, words = {}, prose(rng, 3000).split()
    for i in range(30):
        for j in rng.integers(0, 3000, 40):
            words[j] = prose(rng, 1)
        texts[i] = " ".join(words)
    whole = {i: {tuple(t.split()[j : j + 5]) for j in range(2996)} for i, t in texts.items()}
    rows = {r.doc_id: r for r in fingerprints.neighbours(make(spark, texts.items()), range_rows=7).collect()}
    errors = [abs(rows[i].near_next - len(whole[i] & whole[(i - 1) % 30]) / len(whole[i] | whole[(i - 1) % 30])) for i in texts]
    assert max(errors) < 0.12 and np.mean(errors) < 0.04
    full = fingerprints.neighbours(make(spark, texts.items()), fraction=1.0).collect()
    assert all(r.near_next == pytest.approx(len(whole[r.doc_id] & whole[(r.doc_id - 1) % 30]) / len(whole[r.doc_id] | whole[(r.doc_id - 1) % 30])) for r in full)


def test_sketches_merge():
    rng = np.random.default_rng(4)
    a, b = prose(rng, 3000), prose(rng, 300)
    x, y, z = fingerprints.sketches(pa.array([a, b, a + " " + b]))
    assert fingerprints.containment(y, z) > 0.9 and abs(fingerprints.containment(x, z) - 1) < 0.05
    assert abs(len(fingerprints.merged(x, y)) - len(z)) < 5
    for n in range(1, 40):  # the sketch of the union, short texts and long ones
        sets = [np.unique(rng.integers(0, 2**64, n, dtype=np.uint64)) for _ in range(2)]
        one, two, both = (fingerprints.kept(s, 0.125) for s in (*sets, np.union1d(*sets)))
        assert fingerprints.merged(one, two, 0.125).tolist() == both.tolist()
    assert fingerprints.hashes(fingerprints.fingerprint(x)).tolist() == x.tolist()


# --- near and exact copies ------------------------------------------------------------------------------


def brute_components(texts, k, percent):
    low = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().translate(low).split()
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} or ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def test_near_dedup_equals_brute_force(spark):
    rng = np.random.default_rng(9)
    texts, base = {}, prose(rng, 120).split()
    for i in range(90):  # one loose group: neighbours by various edits, many of them just below the bound
        w = list(base)
        for j in rng.integers(0, len(w), int(rng.integers(0, 12))):
            w[j] = prose(rng, 1)
        texts[i * 7 % 1000 + 5] = " ".join(w)
    for i in range(2000, 2060):
        texts[i] = prose(rng, int(rng.integers(0, 9)))
    texts |= {3000: texts[5], 3001: texts[5].upper(), 3002: None, 3003: " "}
    texts |= {4000 + i: w for i, w in enumerate([*thue_morse(1024), *thue_morse(4096)])}
    want = brute_components(texts, 4, 80)
    for block in (16, 512):
        rows = minhash.near_dedup(make(spark, texts.items()).repartition(4), k=4, block=block).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == want
        assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_near_dedup_of_the_table(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op4_minhash"](spark, SF).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == brute_components(texts, 4, 80)


def test_signature_estimates_similarity():
    rng = np.random.default_rng(8)
    a = rng.integers(0, 2**64, 400, dtype=np.uint64)
    b = np.concatenate([a[:300], rng.integers(0, 2**64, 100, dtype=np.uint64)])
    same_ = np.mean(minhash.signature(a, 2048) == minhash.signature(b, 2048))
    assert abs(same_ - 300 / 500) < 0.05


def test_exact_dedup_levels(spark):
    rows = [(1000 - i, f"t {i % 7}" if i % 3 else " t  0\n") for i in range(500)]
    df = make(spark, rows).repartition(13)
    for fan_in in (2, 8):
        got = {r.doc_id: r for r in exact_dedup.exact_dedup(df, fan_in).collect()}
        groups = {}
        for i, t in rows:
            groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t), []).append(i)
        for own in groups.values():
            assert all((got[i].keep_id, got[i].group_size, got[i].kept) == (min(own), len(own), i == min(own)) for i in own)
    plan = exact_dedup.exact_dedup(df)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# --- passages -------------------------------------------------------------------------------------------


def test_substring_finds_planted_passages(spark):
    rng = np.random.default_rng(6)
    passage = prose(rng, 60).split()
    fuzzy = list(passage)
    fuzzy[30] = "changed"
    del fuzzy[45]
    texts = {i: prose(rng, 200) for i in range(40)}
    for i, p in ((3, passage), (9, passage), (20, fuzzy), (31, [w.upper() for w in passage])):
        w = texts[i].split()
        texts[i] = " ".join([*w[: i * 3], *p, *w[i * 3 :]])
    texts[50], texts[51] = "is onhe. " * 60, "x y z " + "is onhe. " * 80
    docs = make(spark, texts.items()).repartition(4)
    rows = substring.repeated_passages(docs).collect()
    assert {(r.doc_id, r.source_doc_id) for r in rows} == {(9, 3), (20, 3), (31, 3), (51, 50)}
    for r in rows:
        if r.doc_id != 51:
            assert abs(r.start_word - 3 * r.doc_id) <= 1 and abs(r.end_word - 3 * r.doc_id - 60) <= 2 and r.source_start in range(8, 12)
    left = {r.doc_id: r for r in substring.without_passages(docs, spark.createDataFrame(rows)).collect()}
    assert len(left[9].text.split()) in (199, 200, 201) and left[3].text == texts[3] and left[0].text == texts[0]
    assert left[9].n_chars == len(left[9].text) and len(left) in (41, 42)


def test_substring_covers_every_exact_repeat(spark):
    rows = QUERIES["op9_substring"](spark, SF).collect()
    texts = {r.doc_id: (r.text or "").lower().split() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    first, need = {}, set()
    for i in sorted(texts):
        own = [tuple(texts[i][j : j + 50]) for j in range(len(texts[i]) - 49)]
        need |= {i} if any(first.get(g, i) != i for g in own) else set()
        for g in own:
            first.setdefault(g, i)
    assert need <= {r.doc_id for r in rows}
    assert all(r.source_doc_id < r.doc_id and r.end_word - r.start_word >= 50 and 100 * r.n_matched >= 80 * (r.end_word - r.start_word) for r in rows)


def test_substring_passages_whose_parts_stand_in_earlier_documents(spark):
    rng = np.random.default_rng(12)
    texts = {}
    for n in range(10, 110, 10):
        parts = [prose(rng, 20) for _ in range(3)]
        texts |= {n + i: f"{prose(rng, 80)} {part} {prose(rng, 80)}" for i, part in enumerate(parts)}
        texts |= {n + i: f"{prose(rng, 80)} {' '.join(parts)} {prose(rng, 80)}" for i in (3, 4)}
    rows = substring.repeated_passages(make(spark, texts.items())).collect()
    assert {(r.doc_id, r.start_word, r.end_word, r.source_doc_id, r.source_start) for r in rows} == {(n + 4, 80, 140, n + 3, 80) for n in range(10, 110, 10)}


def test_substring_passages_of_which_earlier_documents_have_small_pieces(spark):
    rng = np.random.default_rng(16)
    passage = prose(rng, 60).split()
    texts = {10 + i: f"{prose(rng, 60)} {' '.join(passage[6 * i : 6 * i + 14])} {prose(rng, 60)}" for i in range(8)}
    texts |= {i: f"{prose(rng, 100)} {' '.join(passage)} {prose(rng, 40)}" for i in (100, 200)}
    rows = substring.repeated_passages(make(spark, texts.items())).collect()
    assert {(r.doc_id, r.start_word, r.end_word, r.source_doc_id) for r in rows} == {(200, 100, 160, 100)}


def test_substring_passages_late_in_a_source_that_has_their_lines_before(spark):
    rng = np.random.default_rng(13)
    lines = [prose(rng, 9) for _ in range(7)]
    early = " ".join(f"{line} {prose(rng, 9)}" for line in lines[::-1])
    texts = {1: f"{early} {' '.join(lines)} {prose(rng, 50)}", 2: f"{prose(rng, 40)} {' '.join(lines)} {prose(rng, 40)}"}
    rows = substring.repeated_passages(make(spark, texts.items())).collect()
    assert {(r.doc_id, r.start_word, r.end_word, r.source_doc_id, r.source_start) for r in rows} >= {(2, 40, 103, 1, 126)}


def test_substring_exact_repeats_of_which_earlier_documents_have_all_but_a_word(spark):
    rng = np.random.default_rng(22)
    texts, size = {}, 50
    for n in range(0, 400, 20):
        passage = prose(rng, size + n // 20 % 3).split()
        pieces = [passage[i : i + size - 1] for i in range(len(passage) - size + 2)]
        texts |= {n + i: f"{prose(rng, 60)} {' '.join(p)} {prose(rng, 60)}" for i, p in enumerate(pieces)}
        texts |= {n + i: f"{prose(rng, 60)} {' '.join(passage)} {prose(rng, 60)}" for i in (10, 11, 12)}
    rows = substring.repeated_passages(make(spark, texts.items())).collect()
    assert {(r.doc_id, r.start_word, r.end_word) for r in rows} == {(n + i, 60, 60 + size + n // 20 % 3) for n in range(0, 400, 20) for i in (11, 12)}
    assert all(r.source_doc_id % 20 in (10, 11) and r.source_start == 60 for r in rows)


def test_pipeline_cuts_repeats_of_which_earlier_documents_have_all_but_a_word(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = np.random.default_rng(23)
    texts, want = {}, {}
    for n in range(0, 200, 20):
        passage, before, behind = prose(rng, 50).split(), prose(rng, 60), prose(rng, 60)
        texts |= {n + i: f"{prose(rng, 60)} {' '.join(passage[i : i + 49])} {prose(rng, 60)}" for i in (0, 1)}
        texts |= {n + 10: f"{prose(rng, 60)} {' '.join(passage)} {prose(rng, 60)}", n + 11: f"{before} {' '.join(passage)} {behind}"}
        want |= {n + i: texts[n + i].split() for i in (0, 1, 10)} | {n + 11: f"{before} {behind}".split()}
    left = pipeline.substring_stage(spark, make(spark, texts.items()), SF).collect()
    assert {r.doc_id: r.text.split() for r in left} == want


def test_substring_windows_of_a_common_passage_are_taken_once(spark, monkeypatch):
    rng = np.random.default_rng(26)
    passage = prose(rng, 90)
    docs = make(spark, [(i, f"{prose(rng, 60)} {passage} {prose(rng, 60)}") for i in range(40)])
    repeated, table = [], substring.Scratch.table

    def counted(self, df):
        out = table(self, df)
        if df.columns == ["doc_id", "pos", "window"]:
            repeated.append(out.groupBy("window").count().where("count > 1").count())
        return out

    monkeypatch.setattr(substring.Scratch, "table", counted)
    assert {r.doc_id for r in substring.repeated_passages(docs).collect() if r.start_word <= 60 and r.end_word >= 150} == set(range(1, 40))
    assert repeated[0] < 10  # of the 41 windows of the passage none; what stands beside it may agree by chance


@pytest.mark.parametrize("common", [0, substring.COMMON])
def test_substring_changed_passages_of_which_earlier_documents_have_every_seed(spark, common, monkeypatch):
    """Documents before have all 30 words in sequence of the passage, so each seed's first document is another than the source; by joins and in blocks alike."""
    monkeypatch.setattr(substring.run_matches, "__defaults__", (common, 4))
    rng = np.random.default_rng(25)
    texts, want = {}, set()
    for n in range(0, 600, 60):
        passage = prose(rng, 56).split()
        texts |= {n + i: f"{prose(rng, 60)} {' '.join(passage[i : i + 30])} {prose(rng, 60)}" for i in range(27)}
        edited = [*passage[:28], "changed", *passage[29:]]
        texts |= {n + 30: f"{prose(rng, 70)} {' '.join(passage)} {prose(rng, 50)}", n + 31: f"{prose(rng, 50)} {' '.join(edited)} {prose(rng, 50)}"}
        want.add((n + 31, 50, 106, 55, n + 30, 70, 126))
    rows = substring.repeated_passages(make(spark, texts.items())).collect()
    assert {tuple(r) for r in rows} == want


def test_substring_seeds_of_a_common_passage_meet_their_first_document_in_one_row(spark):
    rng = np.random.default_rng(24)
    passage = prose(rng, 80)
    docs = make(spark, [(i, f"{prose(rng, 60)} {passage} {prose(rng, 60)}") for i in range(60)])
    long = substring.seeds(docs, 5, 10, 50, 27).where("whole").select("seed", "doc_id", "pos")
    held = substring.repeated_passages(docs).select("doc_id", "start_word", "end_word").distinct()
    left = {r.seed: r.open for r in substring.open_seeds(long, held, 50, 27).collect()}
    shared = [r.seed for r in long.groupBy("seed").count().where("count = 60").collect()]
    assert len(shared) > 1 and {left.get(seed, 0) for seed in shared} <= {0, 59}  # the first document's at least, as it has no span
    assert substring.open_seeds(long, held, 50, 27).count() == len(left)


def test_substring_seeds_within_equal_spans_are_not_taken_again(spark, monkeypatch):
    """Pieces of a common passage leave its seeds open in their documents; of the others only the first has windows to compare."""
    rng = np.random.default_rng(27)
    passage = prose(rng, 120).split()
    texts = {i: f"{prose(rng, 60)} {' '.join(passage)} {prose(rng, 60)}" for i in range(40)}
    texts |= {i: f"{prose(rng, 60)} {' '.join(passage[3 * i - 90 : 3 * i - 50])} {prose(rng, 60)}" for i in range(40, 46)}
    taken, whole = [], substring.whole_windows

    def counted(docs, *sizes):
        inner = F.col("pos").between(83, 130)  # all windows around lie within the passage
        taken.extend(r.doc_id for r in docs.select("doc_id", F.explode("at").alias("pos")).where(inner).collect())
        return whole(docs, *sizes)

    monkeypatch.setattr(substring, "whole_windows", counted)
    rows = substring.repeated_passages(make(spark, texts.items())).collect()
    assert {r.doc_id for r in rows if r.start_word <= 60 and r.end_word >= 180} == set(range(1, 40))
    assert 0 in taken and not set(taken) & set(range(1, 40))


def test_shuffle_files_go_once_a_scratch_table_is_written(spark):
    blocks = lambda: {b for b in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks().mkString(" ").split() if b.startswith("shuffle_")}
    before, scratch = blocks(), Scratch(spark, "shuffles")
    out = scratch.table(spark.range(100_000).selectExpr("id % 1000 as k", "id").groupBy("k").agg(F.max("id").alias("m")).join(spark.range(1000).toDF("k").repartition(3, "k"), "k"))
    for _ in range(50):  # they go in the background
        if not (left := blocks() - before):
            break
        time.sleep(0.1)
    assert not left and out.count() == 1000
    scratch.drop(out)


def test_substring_stretches_left_out_reach_no_passage():
    rng = np.random.default_rng(28)
    lines = [rng.integers(2, 2**63, n).astype(np.uint64) for n in (25, 27, 30, 33, 8, 6)]
    short, long = 0, 0
    for _ in range(60):
        texts = []
        for _ in range(2):
            parts = [x for _ in range(12) for x in (lines[rng.integers(6)], rng.integers(2, 2**63, rng.integers(0, 9)).astype(np.uint64))]
            texts.append(np.concatenate(parts))
        a, b = texts
        x, y = np.nonzero(substring.windows(a, 25)[:, None] == substring.windows(b, 25)[None, :])
        may = substring.may_reach(a, b, x, y, np.full(len(x), 25), 50, 60)
        for i in range(len(x)):
            _, same, places = substring.align(a, b, [x[i], x[i] + 20], [y[i], y[i] + 20], 5)
            assert may[i] or len(same) < 50
            short, long = short + (not may[i]), long + (len(same) >= 50)
    assert short > 100 and long > 100


def test_substring_finds_every_passage_of_the_stated_similarity(spark):
    """Five-word shingles similar to 0.8: a changed, lost or added word for each 54 words (what lies beyond a change at the edge may go)."""
    rng = np.random.default_rng(15)
    texts, want = {}, set()
    for n in range(60):
        passage = [f"p{n}w{i}" for i in range((60, 114, 168)[n % 3])]
        edited = list(passage)
        for m in range(len(passage) // 54):
            at = 54 * m + int(rng.integers(0, 54))
            edited[at] = ("changed", "", "one more")[n // 3 % 3]
        sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (passage, " ".join(edited).split())]
        if len(sets[0] & sets[1]) >= 0.8 * len(sets[0] | sets[1]):
            want.add((2 * n + 1, 2 * n))
        texts |= {2 * n: f"{prose(rng, 80)} {' '.join(passage)} {prose(rng, 80)}", 2 * n + 1: f"{prose(rng, 80)} {' '.join(edited)} {prose(rng, 80)}"}
    assert len(want) > 30
    assert want <= {(r.doc_id, r.source_doc_id) for r in substring.repeated_passages(make(spark, texts.items())).collect()}


def test_substring_recall_below_the_stated_similarity(spark):
    """Passages of 60 words with a changed word in every so many: how many are found."""
    rng = np.random.default_rng(17)
    texts, wide = {}, (7, 10, 15, 20)
    for n in range(160):
        passage = [f"p{n}w{i}" for i in range(60)]
        every = wide[n % 4]
        edited = ["changed" if i % every == every - 1 else w for i, w in enumerate(passage)]
        texts |= {2 * n: f"{prose(rng, 80)} {' '.join(passage)} {prose(rng, 80)}", 2 * n + 1: f"{prose(rng, 80)} {' '.join(edited)} {prose(rng, 80)}"}
    found = {r.doc_id for r in substring.repeated_passages(make(spark, texts.items())).collect() if r.source_doc_id == r.doc_id - 1}
    recall = {every: np.mean([2 * n + 1 in found for n in range(160) if wide[n % 4] == every]) for every in wide}
    print(recall)
    assert recall[20] == 1 and recall[15] >= 0.95 and recall[10] >= 0.9 and recall[7] >= 0.5


def test_substring_long_seeds_cover_every_window():
    rng = np.random.default_rng(14)
    words = rng.integers(0, 2**63, 40).astype(np.uint64)[rng.integers(0, 3, 400)]
    hashes = substring.windows(words, 5)
    groups = {}
    for i in range(396):
        groups.setdefault(tuple(words[i : i + 5].tolist()), set()).add(int(hashes[i]))
    assert all(len(h) == 1 for h in groups.values()) and len(set.union(*groups.values())) == len(groups)
    x, y = np.array([3, 9, 20, 5, 90]), np.array([13, 19, 30, 2, 100])
    assert list(substring.runs(x, y, 27, 5, 60)) == [([3, 9, 20, 25, 31, 42], [13, 19, 30, 35, 41, 52]), ([90, 112], [100, 122])]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(0, 60)), min_size=1, max_size=25, unique=True))
def test_best_chain_equals_quadratic_search(matches):
    matches = sorted(matches, key=lambda m: (m[0], -m[1]))
    best = []
    for i, (x, y) in enumerate(matches):
        before = [best[j] - 0.05 * (x + y - sum(matches[j])) for j in range(i) if matches[j][0] < x and matches[j][1] < y]
        best.append(5 + max([0, *before]))
    found = substring.chain([m[0] for m in matches], [m[1] for m in matches], 5, 0.05, 10**6)
    assert sorted(i for c in found for i in c) == list(range(len(matches)))
    value = lambda c: 5 * len(c) - 0.05 * (sum(matches[c[-1]]) - sum(matches[c[0]]))
    assert max(map(value, found)) == pytest.approx(max(best))
    assert all(matches[a][0] < matches[b][0] and matches[a][1] < matches[b][1] for c in found for a, b in zip(c, c[1:], strict=False))


# --- models ---------------------------------------------------------------------------------------------


def test_quality_on_held_out_rows(spark):
    sf = SF.replace("0.001", "0.01")
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = QUERIES["op10_quality"](spark, sf).collect()
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95


def test_toxicity_on_held_out_rows(spark):
    sf = SF.replace("0.001", "0.1")
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = QUERIES["op6_toxicity"](spark, sf).collect()
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    hit = [r for r in held if truth[r.doc_id]]
    assert np.mean([r.predicted for r in hit]) > 0.85 and np.mean([truth[r.doc_id] for r in held if r.predicted]) > 0.9


def plain_kneser_ney(counts, pairs, top=toxicity.TOP, low=toxicity.LOW):
    """Probability of a word's spelling by dictionaries, from counts of words and, below `low`, pairs of the corpus."""
    tables = {top: {}}
    for w, c in counts.items():
        s = b"\x01" + w + b"\x02"
        for i in range(low - 1, len(s)):
            g = s[max(0, i - top + 1) : i + 1]
            tables[top][g] = tables[top].get(g, 0) + c
    for n in range(top - 1, low - 1, -1):
        tables[n] = {}
        for g, c in tables[n + 1].items():
            if len(g) == n + 1:
                tables[n][g[1:]] = tables[n].get(g[1:], 0) + 1
            else:
                tables[n][g] = tables[n].get(g, 0) + c
    less = {n: toxicity.discounts(np.array([c for g, c in t.items() if len(g) == n])) for n, t in tables.items()}

    def p(word):
        s, out = b"\x01" + word + b"\x02", 1.0
        for i in range(1, len(s)):
            row, column = pairs[s[i - 1]], (pairs > 0).sum(axis=0) + 1
            base = column[s[i]] / column.sum()
            q = (max(row[s[i]] - 0.75, 0) + 0.75 * (row > 0).sum() * base) / row.sum() if row.sum() else base
            for n in range(low, min(top, i + 1) + 1):
                g = s[i - n + 1 : i + 1]
                own = {h: c for h, c in tables[n].items() if len(h) == n and h[:-1] == g[:-1]}
                if own:
                    d = {h: less[n][min(3, c)] for h, c in own.items()}
                    q = (own.get(g, 0) - d.get(g, 0) + sum(d.values()) * q) / sum(own.values())
            out *= q
        return out

    return p


def test_kneser_ney_equals_dictionaries(spark):
    rng = np.random.default_rng(21)
    word = lambda: "".join(rng.choice(list("abcdeé"), int(rng.integers(1, 8)))).encode()
    words = sorted({word() for _ in range(150)})
    counts = np.array([rng.integers(0, 5, len(words)), rng.integers(0, 5, len(words))])
    new = [word() for _ in range(40)]
    corpus = spark.createDataFrame([(bytes(w), 1) for w in {*words, *new[:10]}], "word binary, n long")
    pairs = toxicity.shared_pairs(corpus)
    want = np.zeros((256, 256))
    for w in {*words, *new[:10]}:
        for a, b in zip(b"\x01" + w, w + b"\x02"):
            want[a, b] += 1
    assert (pairs == want).all()
    flat = lambda ws: (np.frombuffer(b"".join(ws), np.uint8), np.array([len(w) for w in ws]))
    often = rng.random(len(words))
    models = toxicity.Models(*flat(words), counts, pairs, often)
    spelled = models.spelled(*flat([*words, *new]))
    for c in (0, 1):
        p = plain_kneser_ney({w: int(n) for w, n in zip(words, counts[c], strict=True) if n}, pairs)
        assert np.allclose(np.exp(spelled[c]), [p(w) for w in [*words, *new]], rtol=1e-6)
    less = [toxicity.discounts(own) for own in counts]
    known = lambda c, n: (counts[c][n] - less[c][min(3, counts[c][n])] + sum(less[c][min(3, k)] for k in counts[c]) * often[n]) / counts[c].sum()
    off = np.cumsum([0, *map(len, words)])
    hashes = word_hashes(flat(words)[0], off, np.zeros(256, bool))[0]
    assert np.allclose(models.ratios(hashes, *flat(words))[1], [np.log(known(0, n) / known(1, n)) for n in range(len(words))], atol=1e-4)


def test_toxicity_counts_copies_once(spark):
    text = "One two three four five six, one two three four five seven"
    rows = spark.createDataFrame([(1, 0, text), (1, 0, text.upper()), (1, 0, "zero " + text), (0, 0, "one")], "y int, fold int, text string")
    got = {(bytes(r.word), r.y): r.n for r in toxicity.counted(rows).collect()}
    assert got[b"six", 1] == 1 and got[b"five", 1] == 2 and got[b"seven", 1] == 1 and got[b"one", 1] == 3 and got[b"one", 0] == 1


def test_toxicity_words_travel_in_ten_bytes_a_stretch(spark):
    """Counts equal those of dictionaries; what is shuffled of a stretch is its hash and a share of its word."""
    rng = np.random.default_rng(27)
    words = [f"word{i}" for i in range(300)]
    rows = [(int(i % 9 == 0), i % 4, " ".join(rng.choice(words, 400))) for i in range(300)]
    rows += [(y, (fold + 1) % 4, text) for y, fold, text in rows[:100]]
    first = {}
    for y, fold, text in rows:
        w = text.split()
        for i in range(len(w)):
            key = y, w[i], tuple(w[max(0, i - 4) : i + 1]), min(i, 5)
            first[key] = min(fold, first.get(key, fold))
    want = {}
    for (y, word, *_), fold in first.items():
        want[word, y, fold] = want.get((word, y, fold), 0) + 1
    texts = spark.createDataFrame(rows, "y int, fold int, text string").coalesce(1)
    assert {(r.word.decode(), r.y, r.fold): r.n for r in toxicity.counted(texts).collect()} == want
    sent = toxicity.packed(texts, 6).selectExpr("sum(length(words) + length(sizes) + length(follows) + length(stretches))").first()[0]
    assert sent < 10 * 400 * len(rows)


def test_toxicity_learns_from_every_labelled_document(spark):
    texts = {i: f"plain{i} alpha beta gamma" if i < 3300 else f"nasty{i} delta beta" for i in range(3310)}
    labels = spark.createDataFrame([(i, int(i >= 3300)) for i in texts], "doc_id long, toxic int")
    scorer = toxicity.fit(make(spark, texts.items()), labels, F.lit(True))
    own = [t.split()[0].encode() for t in texts.values()]
    hashes = word_hashes(np.frombuffer(b"".join(own), np.uint8), np.cumsum([0, *map(len, own)]), np.zeros(256, bool))[0]
    assert np.isin(hashes, scorer.models.words).all() and len(scorer.models.words) == len(own) + 4


def test_attention_gradient():
    rng = np.random.default_rng(0)
    x, first, y = rng.standard_normal((12, 3)).astype(np.float32), np.array([0, 4, 5, 12]), np.array([0, 1, 1], np.float32)
    model = quality.Attention.start(x, 4, 3, 0)
    loss = lambda: -np.mean(y * np.log(model.score(x, first)) + (1 - y) * np.log(1 - model.score(x, first)))
    before = loss()
    model.fit(x, first, y, 60, 0.02, 0.0)
    assert loss() < before / 2


def test_html_on_marked_pages(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = QUERIES["op5_html"](spark, SF).collect()
    import html as h

    assert len(rows) == len(pages)
    for r in rows:
        inner = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        want = "\n".join(t for t in (" ".join(h.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner)) if t)
        assert (r.text, r.n_chars) == (want, len(want))


CLUTTER = (
    '<div class="ad">Buy cheap shoes now at the shop. Click here.</div>', '<form action="/s"><label>Email</label><input><p>Subscribe to our newsletter.</p></form>',
    '<div class="comments"><p>I do not agree with this at all, said one.</p></div>', '<div class="cookie notice">We use cookies, do you agree?</div>', "<aside><p>Related: ten more stories for you to read.</p></aside>",
    '<section class="comments"><h3>Two comments</h3><div class="comment"><p>First!</p></div></section>', "<nav><ul><li><a href='/a'>Next page</a></li></ul></nav>", "<script>var x = '<p>no</p>';</script><style>p {}</style>",
)


def test_html_clutter_inside_articles(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    models, right = html_main.fit([r.html for r in pages]), []
    for r in pages:
        inside = [m.end() for m in re.finditer("</p>", r.html) if r.html.index("<article>") < m.end() < r.html.index("</article>")]
        at = inside[len(inside) // 2] if inside else r.html.index("</article>")
        odd = [r.html[:at] + x + r.html[at:] for x in ("", *CLUTTER, '<p>Before it. <span class="ad">Sponsored words here.</span> After it.</p>')]
        plain, *others, line = html_main.main_texts(list(map(html_main.parse, odd)), models)
        assert all(t == plain for t in others) or len(plain.split()) < 20  # of an article of a few words, nearly always
        right += [t == plain for t in others]
        assert sorted(line.split("\n")) == sorted([*plain.split("\n"), "Before it. After it."])
    assert np.mean(right) > 0.99


def test_html_without_marks_and_very_long(spark):
    long = "".join(f"<p>Paragraph {i} has &eacute; and some words, which go on for a while.</p>" for i in range(30_000))
    pages = [(1, "<html><head><title>x</title><p>Some text that is long enough to be read by all.<p>And more text, again and again."), (2, f"<body><nav><a href='/'>Home</a></nav><article>{long}</article><footer>end</footer>")]
    rows = {r.page_id: r.text for r in html_main.extract(spark.createDataFrame([(i, "u", t) for i, t in pages], "page_id long, url string, html string")).collect()}
    assert rows[1] == "Some text that is long enough to be read by all.\nAnd more text, again and again."
    assert rows[2] == "\n".join(f"Paragraph {i} has é and some words, which go on for a while." for i in range(30_000))


def test_html_on_odd_pages(spark):
    odd = [(1, None), (2, ""), (3, "plain words"), (4, "<p>a<p>b<ul><li>x<li>y</ul>"), (5, "<" * 50), (6, '<div class="a>b" id=\'c\'>' + "text. " * 2000), (None, "<html><body><article><p>x &amp; y</article>"), (7, "<div>" * 3000), (8, "<script>never closed <p>x")]
    df = spark.createDataFrame([(i, None, t, "clash") for i, t in odd], "page_id long, url string, html string, text string")
    rows = html_main.extract(df, made=60).collect()
    assert len(rows) == len(odd) and all(r.n_chars == len(r.text) for r in rows)
    assert html_main.extract(df.limit(0), made=20).collect() == []


def test_decoding_is_consistent():
    rng = np.random.default_rng(1)
    page = html_main.parse("<body><div><p>a</p><div><p>b</p><p>c</p></div></div><nav><ul><li>d</li></ul></nav></body>")
    forest = html_main.Forest.of([page, page])
    n = len(forest.parent)
    for _ in range(50):
        keep, mixed = rng.standard_normal(n) * 3, rng.standard_normal(n) * 3
        kept = html_main.decode(forest, keep, mixed)
        assert all(kept[i] for i in range(n) if forest.parent[i] >= 0 and kept[forest.parent[i]])
        log = lambda m: -np.logaddexp(0, -m)
        inner = set(forest.parent.tolist())

        def best(i, state):  # brute force over the states of one tree
            kids = [c for c in range(n) if forest.parent[c] == i]
            own = {"keep": log(keep[i]) + (log(-mixed[i]) if i in inner else 0), "drop": log(-keep[i]) + (log(-mixed[i]) if i in inner else 0), "mixed": log(mixed[i])}[state]
            return own + sum(best(c, state) if state != "mixed" else max(best(c, s) for s in ("keep", "drop", "mixed") if s != "mixed" or c in inner) for c in kids)

        states = {s: best(0, s) for s in ("keep", "drop", "mixed")}
        assert kept[0] == (max(states, key=states.get) == "keep")


# --- the pipeline ---------------------------------------------------------------------------------------


def test_pipeline_stage_by_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    scratch = Scratch(spark, "t")
    stages = dict(corpus_pipeline.STAGES)
    good = scratch.table(stages["quality classifier"](spark, docs, SF))
    assert good.schema == docs.schema and 0 < good.count() <= docs.count()
    rows = good.collect()
    once = scratch.table(stages["exact dedup"](spark, good, SF))
    groups = {}
    for r in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r.text or ""), []).append(r.doc_id)
    assert sorted(r.doc_id for r in once.collect()) == sorted(map(min, groups.values()))
    near = scratch.table(stages["near dedup"](spark, once, SF))
    want = brute_components({r.doc_id: r.text for r in once.collect()}, 5, 80)
    assert sorted(r.doc_id for r in near.collect()) == sorted(i for i, (_, c) in want.items() if c == i)
    cut = scratch.table(stages["substring dedup"](spark, near, SF))
    before, after = ({r.doc_id: r for r in t.collect()} for t in (near, cut))
    touched = {r.doc_id for r in substring.repeated_passages(near).collect()}
    assert all(after[i] == before[i] for i in before if i not in touched)
    assert all(len(after[i].text) < len(before[i].text) and after[i].n_chars == len(after[i].text) for i in touched if i in after)
    packed = stages["packing"](spark, cut, SF).collect()
    assert {r.doc_id for r in packed} == set(after)
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).select("doc_id", "piece", "length").collect())) == sorted((r.doc_id, r.piece, r.length) for r in packed)


def test_names():
    assert [n for n in QUERIES if not re.match(r"op\d+_", n)] == [] and {int(re.match(r"op(\d+)", n)[1]) for n in QUERIES} == set(range(1, 11))
    assert json.dumps(sorted(SQL))
