"""Near copies against brute force over shingle sets."""

import random

import corpus_pipeline
import numpy as np
import pytest

from tidemark.llm import simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingle_set(text):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_roots(texts):
    """The first text of each text's component."""
    sets, parent = [shingle_set(t) for t in texts], list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j])):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def make_texts():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    texts = []
    for _ in range(25):
        base = [word() for _ in range(rng.choice([6, 40, 150, 400]))]
        texts.append(" ".join(base))
        for edits in (1, 2, 4, 6, 12):
            copy = list(base)
            for _ in range(edits):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
            base = rng.choice([base, copy])
    return texts + [texts[0], texts[0].upper(), "", "a b", "a  B"]


def test_near_stage_against_brute_force(spark):
    """No document goes without a link; of the links between different sets at least 0.9 are found (0.8 is where the index may miss some)."""
    texts = make_texts()
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], SCHEMA)
    roots = brute_roots(texts)
    wanted = set(roots)
    assert 25 < len(wanted) < len(texts) - 40
    got = [r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()]
    assert wanted <= set(got) and len(got) == len(set(got))
    assert len(texts) - len(got) >= 0.9 * (len(texts) - len(wanted))


def test_components_are_never_wider_than_brute_force(spark):
    texts = make_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    roots, of_label = brute_roots(texts), {}
    found = {r.id: bytes(r.label) for r in simhash.near_components(docs).collect()}
    for i, root in enumerate(roots):
        assert of_label.setdefault(found[i], root) == root


def test_similar_pairs_by_brute_force(monkeypatch):
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 30, n).astype(np.uint64)) for n in (0, 1, 5, 40, 60, 80, 80, 90)] + [np.arange(70_000, dtype=np.uint64), np.arange(69_000, dtype=np.uint64)]
    every = np.arange(len(sets))
    got = set(zip(*(x.tolist() for x in simhash.similar_pairs(sets, every, every, (4, 5)))))
    both = lambda a, b: len(set(a.tolist()) & set(b.tolist()))
    assert got == {(i, j) for i in every.tolist() for j in every.tolist() if 9 * both(sets[i], sets[j]) >= 4 * (len(sets[i]) + len(sets[j]))}


def test_a_component_of_several_blocks(spark, monkeypatch):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(60):
        copy = list(base)
        for _ in range(rng.randint(1, 5)):
            copy[rng.randrange(300)] = f"x{rng.random()}"
        texts.append(" ".join(copy))
    monkeypatch.setattr(simhash, "MEMBERS", 7)
    monkeypatch.setattr(simhash, "BUCKET", 20)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert len(simhash.keep_first(docs).collect()) == len(set(brute_roots(texts)))


def test_index_with_a_wide_limit_by_brute_force():
    rng = np.random.default_rng(6)
    base = rng.integers(0, 1 << 63, 12, np.uint64)
    bits = base[rng.integers(0, 12, 400)]
    for _ in range(9):
        bits = bits ^ (np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64))
    bucket = np.repeat([0, 1, 2, 3, 4], [1, 40, 64, 65, 230])
    allowed = rng.random((400, 400)) < 0.9
    allowed |= allowed.T
    got = simhash.linked_within(bits, bucket, 10, lambda i, j: allowed[i, j])
    wanted = list(range(400))
    for i in range(400):
        for j in range(i):
            if bucket[i] == bucket[j] and allowed[i, j] and int(bits[i] ^ bits[j]).bit_count() <= 10:
                a, b = wanted[i], wanted[j]
                wanted = [min(a, b) if x in (a, b) else x for x in wanted]
    assert len(set(wanted)) > 20
    assert len(set(zip(got.tolist(), wanted))) == len(set(wanted)) == len(set(got.tolist()))


def test_sides_of_a_bucket_by_brute_force():
    """Buckets with two sides, smaller and larger than a node: links lie between the sides alone."""
    rng = np.random.default_rng(8)
    bits = rng.integers(0, 1 << 63, 40, np.uint64)[rng.integers(0, 40, 500)]
    for _ in range(4):
        bits = bits ^ (np.uint64(1) << rng.integers(0, 64, 500).astype(np.uint64))
    bucket = np.repeat([0, 1, 2, 3], [50, 60, 190, 200])
    side = np.where((bucket == 1) | (bucket == 3), rng.integers(0, 2, 500), 0).astype(np.int8)
    got = simhash.linked_within(bits, bucket, 4, lambda i, j: np.ones(len(i), bool), side)
    wanted = list(range(500))
    for i in range(500):
        for j in range(i):
            if bucket[i] == bucket[j] and (bucket[i] % 2 == 0 or side[i] != side[j]) and int(bits[i] ^ bits[j]).bit_count() <= 4:
                a, b = wanted[i], wanted[j]
                wanted = [min(a, b) if x in (a, b) else x for x in wanted]
    assert 20 < len(set(wanted)) < 480
    assert len(set(zip(got.tolist(), wanted))) == len(set(wanted)) == len(set(got.tolist()))


def test_a_large_bucket_loses_no_candidate(spark, monkeypatch):
    """Pairs that share one quarter of all, the same for all of them: their only bucket has more sets than are compared at once."""
    rng = np.random.default_rng(9)
    rows = []
    for i in range(60):
        wide = rng.integers(0, 256, (4 * simhash.WIDE, 2), np.uint8)
        wide[0] = (0, 7)
        other = wide.copy()
        other[1:, 1] ^= 1  # a bit of every other quarter
        rows += [(2 * i, 100, wide.tobytes()), (2 * i + 1, 100, other.tobytes())]
    sets = spark.createDataFrame(rows, "node long, size long, wide binary").repartition(3)
    monkeypatch.setattr(simhash, "BUCKET", 10)
    bucketed = simhash.wide_buckets(sets)
    assert bucketed.groupBy("bucket", "low", "high").count().agg({"count": "max"}).first()[0] <= 60
    found = {(r.node, r.label) for r in simhash.connected(simhash.candidates(bucketed, simhash.NEAR)).collect()}
    assert found == {(n, n - n % 2) for n in range(120)}


def test_whole_groups():
    import pyarrow as pa

    x = np.sort(np.random.default_rng(1).integers(0, 40, 500))
    batches = pa.table({"x": x, "n": np.arange(500)}).to_batches(max_chunksize=13)
    for size in (1, 20, 1000):
        parts = list(simhash.whole_groups(iter(batches), ["x"], size))
        assert np.concatenate([t.column("n").to_numpy() for t, _ in parts]).tolist() == list(range(500))
        seen = [set(t.column("x").to_pylist()) for t, _ in parts]
        assert sum(map(len, seen)) == len(set(x.tolist()))
        assert all((np.unique(g, return_inverse=True)[1] == np.unique(t.column("x").to_numpy(), return_inverse=True)[1]).all() for t, g in parts)


def test_rows_without_ids(spark):
    text = " ".join(f"w{i}" for i in range(200))
    near = text + " end"
    rows = [(None, text), (None, near), (7, near), (None, "only once in here"), (None, "only once in here"), (3, "some other text"), (3, "and yet another one")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA)
    got = sorted(((r.doc_id or 0, r.text) for r in simhash.keep_first(docs).collect()))
    assert got == [(0, "only once in here"), (3, "and yet another one"), (3, "some other text"), (7, near)]


def linked_roots(sets):
    """Components of sets by their exact similarity."""
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(sets))]


def test_short_texts_lose_no_link(spark):
    """Pairs of 9- and 8-word texts have similarity 0.8; one of each pair stays."""
    rng = random.Random(12)
    rows = []
    for i in range(300):
        words = [f"w{rng.randrange(10**9)}" for _ in range(9)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words[:8]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(r.doc_id for r in simhash.keep_first(docs).collect()) == list(range(0, 600, 2))


def test_short_sets_by_brute_force(spark):
    """Texts of few words from few others: many links and many that just aren't any."""
    rng = random.Random(13)
    rows = []
    for i in range(60):
        words = [f"v{i}x{rng.randrange(3)}y{k}" for k in range(rng.randint(1, 13))]
        for _ in range(6):
            cut = words[rng.randint(0, 1) : len(words) - rng.randint(0, 2)]
            if cut and rng.random() < 0.4:
                cut[rng.choice([0, -1])] = f"z{rng.randrange(3)}"
            rows.append((len(rows), " ".join(cut)))
    sets = [{" ".join(t.split()[k : k + 5]) for k in range(max(1, len(t.split()) - 4))} if t else set() for _, t in rows]
    roots = linked_roots(sets)
    wanted = sorted({min(j for j, q in enumerate(roots) if q == r) for r in roots})
    got = sorted(r.doc_id for r in simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect())
    assert got == wanted


@pytest.mark.parametrize("sizes", [(a, b) for b in range(1, 16) for a in range(1, b + 1) if 5 * a >= 4 * b and a > 8 or a == 8 and b == 10])
def test_recall_by_size(sizes):
    """Random sets of the least overlap that is similar share a bucket within the limits."""
    a, b = sizes
    both = -(-4 * (a + b) // 9)
    rng = np.random.default_rng(a * 100 + b)
    hits = 0
    for _ in range(100):
        h = rng.integers(0, 1 << 63, a + b, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        x, y = (simhash.wide_fingerprints(np.unique(s)) for s in (h[:a], np.concatenate((h[:both], h[a : a + b - both]))))
        away = np.bitwise_count(x ^ y)
        shared = any((x[w] ^ y[w]) >> np.uint64(16 * q) & np.uint64((1 << simhash.BAND) - 1) == 0 for w in range(simhash.WIDE) if away[w] <= simhash.NEAR_BITS for q in range(4))
        hits += bool(shared and away.sum() <= simhash.WIDE_BITS)
    assert hits >= 90
