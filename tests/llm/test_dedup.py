"""Suffix and substring dedup against brute force."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import rounds, substring, suffix

LAST = rounds.LAST


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def ordered(rows):
    return sorted((LAST if r.doc_id is None else r.doc_id, r.text or "") for r in rows)


def brute_suffix(rows, length):
    docs = [(k, t.encode()) for k, t in ordered(rows)]
    first = {}
    for k, b in docs:
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            first[w] = min(first.get(w, (k, i)), (k, i))
    out = Counter()
    for k, b in docs:
        gone = [False] * len(b)
        for i in range(len(b) - length + 1):
            if first[b[i : i + length]] < (k, i):
                gone[i : i + length] = [True] * length
        spans = sum(g and not p for g, p in zip(gone, [False, *gone]))
        out[(k, len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone) if not g)))] += 1
    return out


def brute_words(rows, size=13):
    docs = [(k, re.findall(r"[^\x20\x09-\x0D]+", t)) for k, t in ordered(rows)]
    first = {}
    for k, w in docs:
        for i in range(len(w) - size + 1):
            first.setdefault(tuple(w[i : i + size]), k)
    out = Counter()
    for k, w in docs:
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            if first[tuple(w[i : i + size])] < k:
                gone[i : i + size] = [True] * size
        out[(k, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g).encode()))] += 1
    return out


def key(r):
    return LAST if r.doc_id is None else r.doc_id


@pytest.fixture(params=[400, 3 << 20])
def block_bytes(request, monkeypatch):
    monkeypatch.setattr(rounds, "BLOCK_BYTES", request.param)
    monkeypatch.setattr(rounds, "SHARD_KEYS", max(50, request.param // 20))


def test_suffix_dedup(docs, block_bytes):
    got = suffix.digests(docs).collect()
    assert Counter((key(r), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute_suffix(docs.collect(), 100)
    assert sum(r.n_removed for r in got) > 0


def test_substring_dedup(docs, block_bytes):
    got = substring.digests(docs).collect()
    assert Counter((key(r), r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute_words(docs.collect())
    assert sum(r.n_removed for r in got) > 0


def test_empty_tables(no_docs):
    assert suffix.digests(no_docs).count() == 0
    assert substring.digests(no_docs).count() == 0


def test_later_copies_by_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(20):
        parts = [bytes(rng.choice(list(b"ab"), rng.integers(12, 60)).astype(np.uint8)) for _ in range(5)]
        positions = np.cumsum([0] + [len(p) + 5 for p in parts[:-1]])
        seen = set()
        wanted = []
        for p in parts:
            row = []
            for i in range(len(p) - 9):
                row.append(p[i : i + 10] in seen)
                seen.add(p[i : i + 10])
            wanted.append(row)
        assert [x.tolist() for x in suffix.later_copies(parts, positions, 10)] == wanted


def test_longest_previous_factors_by_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(30):
        parts = [bytes(rng.choice(list(b"ab"), rng.integers(11, 40)).astype(np.uint8)) for _ in range(4)]
        positions = rng.permutation(4) * 100
        got = suffix.previous_factors(parts, positions, 11)
        windows = [(int(q) + i, p[i : i + 11]) for p, q in zip(parts, positions, strict=True) for i in range(len(p) - 10)]
        common = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b, strict=True)) if x != y), 11)
        wanted = [max((common(w, v) for r, v in windows if r < q), default=0) for q, w in windows]
        assert np.concatenate(got).tolist() == wanted


def thue_morse(n: int, flip: bool) -> str:
    return "".join("ab"[(i.bit_count() & 1) ^ flip] for i in range(n))


def test_words_on_which_polynomial_hashes_collide(spark):
    same = " ".join(f"w{i}" for i in range(12))
    docs = spark.createDataFrame([(1, f"{same} {thue_morse(1024, False)}"), (2, f"{same} {thue_morse(1024, True)}")], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in substring.digests(docs).collect()} == {1: 0, 2: 0}


def test_a_row_repeated_and_a_passage_in_many_blocks(spark, monkeypatch):
    import random

    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    passage = " ".join(word() for _ in range(40))
    rows = [(5, passage)] * 3000 + [(i, f"{word()} {word()} {passage} {word()}") for i in range(10, 150)]
    monkeypatch.setattr(rounds, "BLOCK_BYTES", 8000)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    most = rounds.in_blocks(docs)[0].groupBy("block").count().agg({"count": "max"}).first()[0]
    assert most < 300
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.digests(docs).collect())
    assert got == brute_suffix(docs.collect(), 100)
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring.digests(docs).collect())
    assert got == brute_words(docs.collect())


def test_hot_anchors_are_those_of_many_unlike_stretches(spark, monkeypatch):
    """A passage with other ends in each of 400 documents and some 90 blocks stays together as bytes; its windows are dealt out, with the same results, if that is too many."""
    import random

    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    passage = " ".join(word() for _ in range(40))
    rows = [(i, f"{word()} {word()} {passage} {word()} {word()}") for i in range(400)]
    monkeypatch.setattr(rounds, "BLOCK_BYTES", 1200)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert rounds.in_blocks(docs)[0].select("block").distinct().count() >= 80
    wanted = brute_suffix(docs.collect(), 100)
    for most in (rounds.HOT_ITEMS, 50):
        found = suffix.dedup(docs, most=most)
        got = found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
        assert Counter(map(tuple, got)) == wanted


def test_items_of_a_key_are_unlike_ones():
    """Blocks with a key five times, but few unlike items of it, are many blocks of a key that isn't hot."""
    import pandas as pd

    keys = np.arange(100, dtype=np.uint64)
    items = np.concatenate((keys, np.repeat(keys[:10], 4)))
    for given, hot in ((keys, []), (items, list(range(10)))):
        sent = pd.DataFrame([m for i in range(80) for m in rounds.sketch(i, np.repeat(keys, 5), 1, given)], columns=["block", "kind", "shard", "payload"])
        answers = pd.concat([rounds.merge_sketches(g, 400) for _, g in sent.groupby(["kind", "shard"])])
        a = answers[answers.block == 3]
        assert np.flatnonzero(rounds.hot(keys, list(zip(a.kind, a.shard, a.payload)), 1)).tolist() == hot


def test_ids_at_the_end_of_the_range(spark):
    docs = spark.createDataFrame([(rounds.LAST, "a b"), (None, "c")], "doc_id long, text string")
    for op in (suffix, substring):
        assert sorted(r.doc_id or 0 for r in op.digests(docs).collect()) == [0, rounds.LAST]


def test_whole_characters():
    text = "aé\ufffdb".encode()
    gone = np.array([0, 0, 1, 0, 0, 0, 0], bool)
    assert text[:1] + "\ufffdb".encode() == bytes(x for x, g in zip(text, suffix.widened(text, gone), strict=True) if not g)


def test_sketch_loses_nothing():
    rng = np.random.default_rng(5)
    import pandas as pd

    blocks = [rng.integers(0, 3000, 800).astype(np.uint64) for _ in range(6)]
    sent = pd.DataFrame([m for i, b in enumerate(blocks) for m in rounds.sketch(i, b, 3)], columns=["block", "kind", "shard", "payload"])
    answers = pd.concat([rounds.merge_sketches(g) for _, g in sent.groupby(["kind", "shard"])])
    counts = Counter(np.concatenate(blocks).tolist())
    for i, b in enumerate(blocks):
        a = answers[answers.block == i]
        flags = rounds.estimated_repeated(b, list(zip(a.kind, a.shard, a.payload)), 3)
        assert all(f for x, f in zip(b.tolist(), flags) if counts[x] > 1)
        assert sum(f for x, f in zip(b.tolist(), flags) if counts[x] == 1) < 10


def test_pack_round_trip():
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 1 << 40, 100), rng.integers(0, 255, 0).astype(np.uint8)
    x, y = rounds.unpack(rounds.pack(a, b), np.int64, np.uint8)
    assert (x == a).all() and len(y) == 0
