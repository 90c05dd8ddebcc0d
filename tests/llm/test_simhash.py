"""Fingerprints and components against brute force."""

import re

import numpy as np
import xxhash

from tidemark.llm import simhash


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 3:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_components(docs):
    rows = docs.collect()
    prints = [brute_fingerprint(r.text) for r in rows]
    roots = brute_components(prints)
    least = {}
    for r, root in zip(rows, roots):
        least[root] = min(least.get(root, 10**9), 10**9 if r.doc_id is None else r.doc_id)
    wanted = sorted((-1 if r.doc_id is None else r.doc_id, f"{p:016x}", None if least[root] == 10**9 else least[root]) for r, p, root in zip(rows, prints, roots))
    got = simhash.components(docs).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.fingerprint, r.component_id) for r in got) == wanted


def test_index_finds_every_link():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    prints = set(base.tolist())
    for b in base[:20].tolist():
        x = b
        for _ in range(30):
            for bit in rng.choice(64, rng.integers(1, 6), replace=False):
                x ^= 1 << int(bit)
            prints.add(x)
    prints = np.array(sorted(prints), np.uint64)
    roots = brute_components(prints.tolist())
    found = list(range(len(prints)))
    for q in range(4):
        shared = (prints >> np.uint64(16 * q)) & np.uint64(0xFFFF)
        _, bucket = np.unique(shared, return_inverse=True)
        to = simhash.linked(prints, bucket)
        for i, j in enumerate(to.tolist()):
            assert bucket[i] == bucket[j]
            a, b = i, j
            while found[a] != a:
                a = found[a]
            while found[b] != b:
                b = found[b]
            found[max(a, b)] = min(a, b)
    for i in range(len(prints)):
        a = i
        while found[a] != a:
            a = found[a]
        assert a == roots[i]


def test_split_buckets_lose_nothing(spark, docs, monkeypatch):
    rng = np.random.default_rng(8)
    base = int(rng.integers(0, 1 << 62))
    rows = sorted({base ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 48, (200, 2))})
    frame = spark.createDataFrame([(r,) for r in rows], "bits long")
    whole = {tuple(r) for r in simhash.connected(simhash.local_links(simhash.buckets(frame))).collect()}
    monkeypatch.setattr(simhash, "BUCKET", 20)
    split = {tuple(r) for r in simhash.connected(simhash.local_links(simhash.buckets(frame))).collect()}
    assert whole == split and len(whole) > 100


def test_gray_order_keeps_prefixes_together():
    x = np.arange(1 << 12, dtype=np.uint64) << np.uint64(52)
    order = np.argsort(simhash.gray_rank(x))
    for bits in (1, 4, 8):
        top = (x[order] >> np.uint64(64 - bits)).tolist()
        assert sum(a != b for a, b in zip(top, top[1:])) == (1 << bits) - 1
    assert all(bin(int(a) ^ int(b)).count("1") == 1 for a, b in zip(x[order].tolist(), x[order][1:].tolist()))


def test_keep_first_and_empty(docs, no_docs):
    kept = simhash.keep_first(docs).collect()
    assert {r.component_id for r in simhash.components(docs).collect()} - {None} == {r.doc_id for r in kept if r.doc_id is not None}
    assert len({r.doc_id for r in kept if r.doc_id is not None}) == sum(r.doc_id is not None for r in kept)
    assert simhash.components(no_docs).count() == 0 and simhash.keep_first(no_docs).count() == 0
