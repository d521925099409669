"""Packing and byte-level BPE against the public tokenizer libraries, and packing's limits."""

import base64
import random
import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from relief.llm import byte_bpe, packing

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
WORDS = public_tokenizers.path("word_bpe_49k.json")
PARTS = ["a", "B", "é", "ß", "İ", "Σ", "1", "²", "  ", " ", "'s", "'LL", "'ll", "中", "\U0001f600", "_", "-", "\n", "\t", "\r\n", "word", "Hello", ".", ",", "###", "٣", "ǅ", "́", "<|endoftext|>", "\x01", "\x1c", " ", " ", "​"]


def fuzz(seed, n=400):
    rng = random.Random(seed)
    out = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 60))) for _ in range(n)]
    return [*out, "", "a" * 3000, " " * 2000, "é" * 1500, "ab" * 900, "word, " * 9000, None]


@pytest.fixture(scope="module")
def bpe():
    return byte_bpe.ByteBpe.load(RANKS, PATTERN)


def test_ids_equal_the_library_and_decode_back(bpe):
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = fuzz(1)
    for text, ids in zip(texts, bpe.encode_texts(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text or "")
        assert bpe.decode(ids) == (text or "").encode()


@pytest.mark.parametrize("long", [1, 7, 64, 1 << 11])
def test_long_matches_equal_the_library(bpe, monkeypatch, long):
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    monkeypatch.setattr(byte_bpe, "LONG", long)
    rng = random.Random(long)
    texts = ["".join(rng.choice(letters) for _ in range(n)) for n in (2, 9, 130, 2049, 5000) for letters in ("a", "ab", "aab", "abcdefghijklmnopqrstuvwxyz", "éa中", " ", "-=")]
    bpe.known.clear()
    for text, ids in zip(texts, bpe.encode_texts(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)


def test_a_very_long_match_takes_little_more_than_linear_time(bpe):
    rng = random.Random(0)
    text = "".join(rng.choice("abcdefghij") for _ in range(300_000))
    start = time.perf_counter()
    assert bpe.decode(bpe.encode_texts([text])[0]) == text.encode()
    assert time.perf_counter() - start < 10


def test_cache_may_be_emptied_between_batches(bpe):
    texts = fuzz(2, 50)
    once = bpe.encode_texts(texts)
    bpe.known.clear()
    assert [bpe.encode_texts([t], cache=5)[0] for t in texts] == once


def test_pair_table_finds_its_pairs_and_no_others():
    rng = np.random.default_rng(0)
    left, right = rng.integers(0, 300, 5000), rng.integers(0, 300, 5000)
    pairs = {(int(a), int(b)): k for k, (a, b) in enumerate(zip(left, right, strict=True))}
    a, b = np.array(list(pairs)).T
    table = byte_bpe.PairTable(a, b, np.array(list(pairs.values()), np.int32))
    asked = rng.integers(-1, 320, (200, 2, 30)).astype(np.int32)
    got = table.rank(asked[:, 0], asked[:, 1])
    want = [[pairs.get((int(x), int(y)), byte_bpe.NO_RANK) for x, y in zip(p, q, strict=True)] for p, q in asked]
    assert np.array_equal(got, want)


def test_encode_decode_queries(spark, bpe):
    texts = fuzz(3, 60)
    rows = [(i, t, b"clash", 5) for i, t in enumerate(texts)] + [(None, "x", None, 1), (3, "again", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids binary, n_tokens int")
    encoded = byte_bpe.encode(docs, RANKS, PATTERN)
    got = byte_bpe.decode(encoded, RANKS, PATTERN).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
        assert r.n_tokens * 4 == len(r.ids)
    for i, t in enumerate(texts):
        assert any(bytes(r.decoded) == (t or "").encode() for r in by[i])
    assert byte_bpe.decode(byte_bpe.encode(docs.limit(0), RANKS, PATTERN), RANKS, PATTERN).collect() == []
    nulls = spark.createDataFrame([(1, None)], "doc_id long, ids binary")
    assert byte_bpe.decode(nulls, RANKS, PATTERN).first().decoded is None


def reference_ids(texts):
    t = Tokenizer.from_file(WORDS)
    t.encode_special_tokens = True
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


@pytest.mark.parametrize("cache", [10, 500_000])
def test_word_encoder_equals_the_tokenizer(cache):
    packing._known.clear()
    texts = fuzz(4) + ["it's. we're, a.b. x\ny. 1. ², _. a_. ſt. ŉ, µ,ß. İ! Σ. ΑΣ."]
    encode = packing.word_encoder(WORDS, 2, cache)()
    got = [ids for lo in range(0, len(texts), 50) for ids in encode(pa.array(texts[lo : lo + 50], pa.string()))]
    assert [g.tolist() for g in got] == [[*ids, 2] for ids in reference_ids(texts)]


def check_pieces(rows, limits, ids_of, losses=None):
    """Every id in exactly one piece, sequences gapless and within limits; returns their lengths."""
    docs, sequences = {}, {}
    for r in rows:
        docs.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    assert docs.keys() == {k for k, v in ids_of.items() if v}
    for k, pieces in docs.items():
        pieces.sort(key=lambda r: r.start)
        assert [x for r in pieces for x in np.frombuffer(r.ids, "<u4").tolist()] == ids_of[k]
        assert [r.start for r in pieces] == np.cumsum([0] + [r.length for r in pieces])[:-1].tolist()
        assert all(r.doc_tokens == len(ids_of[k]) and 4 * r.length == len(r.ids) > 0 for r in pieces)
    out = []
    for pieces in sequences.values():
        pieces.sort(key=lambda r: r.offset)
        assert [r.offset for r in pieces] == np.cumsum([0] + [r.length for r in pieces])[:-1].tolist()
        total = sum(r.length for r in pieces)
        assert total <= limits.tokens and len(pieces) <= limits.segments
        if losses:
            assert sum(sum(losses[r.doc_id][r.start : r.start + r.length]) for r in pieces) <= limits.loss
        out.append(total)
    return out


def test_packing_documents_without_padding(spark):
    rng = random.Random(7)
    texts = fuzz(5, 150) + [" ".join(rng.choice(["alpha", "beta", "gamma,"]) for _ in range(rng.randint(1, 3000))) for _ in range(60)]
    rows = [(i, t, "clash") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)
    got = packing.pack(docs, packing.word_encoder(WORDS, 2)).collect()
    ids_of = {i: [*ids, 2] for i, ids in enumerate(reference_ids(texts))}
    lengths = check_pieces(got, packing.Limits(), ids_of)
    assert all(n == 4096 or n & (n - 1) == 0 for n in lengths)  # nothing to pad
    crc = packing.pack(docs, packing.word_encoder(WORDS, 2)).select("doc_id", "start", "ids", F.crc32("ids").alias("c")).first()
    assert crc.c == zlib.crc32(bytes(crc.ids))


def numbers():
    """An encoder whose texts are token counts; a local function, so that workers need not import this file."""

    def make():
        return lambda texts: [np.arange(int(t or 0), dtype=np.uint32) for t in texts.to_pylist()]

    return make


@pytest.mark.parametrize("cut", [True, False])
def test_three_limits_hold_together(spark, cut):
    rng = random.Random(9)
    limits = packing.Limits(tokens=64, segments=5, loss=40)
    rows, losses = [], {}
    for i in range(400):
        n = rng.choice([0, 1, 2, rng.randint(1, 30), rng.randint(20, 60 if not cut else 300)])
        share = rng.random()
        losses[i] = [int(rng.random() < share) for _ in range(n)]
        rows.append((i, str(n), losses[i]))
    docs = spark.createDataFrame(rows, "doc_id long, text string, mask array<int>").repartition(2)
    got = packing.pack(docs, numbers(), loss_col="mask", limits=limits, window=32, cut=cut).collect()
    lengths = check_pieces(got, limits, {i: list(range(int(n))) for i, n, _ in rows}, losses)
    if cut:
        assert all(n & (n - 1) == 0 for n in lengths)
    else:
        whole = {i for i, n, mask in rows if int(n) <= 64 and sum(mask) <= 40}
        assert all(r.length == r.doc_tokens for r in got if r.doc_id in whole)
        assert sum(lengths) / (64 * len(lengths)) > 0.6


def test_packing_null_repeated_and_empty(spark):
    docs = spark.createDataFrame([(None, "3"), (1, "2"), (1, "2"), (2, None)], "doc_id long, text string").coalesce(1)
    got = packing.pack(docs, numbers(), limits=packing.Limits(8, 8, 8)).collect()
    assert sum(r.length for r in got) == 7 and sum(r.length for r in got if r.doc_id == 1) == 4
    assert not [r for r in got if r.doc_id == 2]
    assert packing.pack(docs.limit(0), numbers()).collect() == []


def test_packer_takes_the_largest_dot_product():
    """Whole documents, as a plain loop would place them: of those that fit, the one whose demand lies best along what is free."""
    rng = random.Random(3)
    limits = packing.Limits(tokens=64, segments=4, loss=20)
    sizes = [(k, rng.randint(1, 40)) for k in range(60)]
    demand = {k: (n, 1, rng.randint(0, min(n, 20))) for k, n in sizes}
    packer = packing.Packer(limits, 60, False)
    got = []
    for k, n in sizes:
        mask = np.array([1] * demand[k][2] + [0] * (n - demand[k][2]))
        got += packer.add(packing.Piece(k, 0, np.arange(n), mask, n))
    got = [[p.doc for p in sequence] for sequence in [*got, *packer.finish()]]
    cap, waiting, want = (64, 4, 20), [k for k, _ in sizes], []
    while waiting:
        free, sequence = list(cap), []
        while True:
            fits = [k for k in waiting if all(d <= f for d, f in zip(demand[k], free, strict=True))]
            if not fits:
                break
            value = {k: sum(d * f / c / c for d, f, c in zip(demand[k], free, cap, strict=True)) for k in fits}
            top = max(value.values())
            best = [k for k in fits if abs(value[k] - top) < 1e-12]
            pick = next(k for k in got[len(want)][len(sequence) : len(sequence) + 1] if k in best)  # any of equal ones
            waiting.remove(pick)
            free = [f - d for f, d in zip(free, demand[pick], strict=True)]
            sequence.append(pick)
        want.append(sequence)
    assert got == want
