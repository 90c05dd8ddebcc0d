"""The trie of conversations against brute force and SQL."""

import hashlib
import random
import zlib

import pytest
from oracle import connect, difference

from tidemark.llm import registry, trie

SF = "/root/testdata/sf0.01"


def brute(rows):
    """Nodes from rebuilt paths; ``rows`` have conv_id, turn, role and text, and no two turns of a conversation tie."""
    own = {}
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        own.setdefault(c, []).append((role or "", text or ""))
    members, ends = {}, {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        path = tuple(own.get(base, [])[:h]) + tuple(ts[h:])
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
        ends.setdefault(path, []).append(c)
    kids = {}
    for p in members:
        if p:
            kids[p[:-1]] = kids.get(p[:-1], 0) + 1
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for p, cs in members.items():
        own_saved = (len(cs) - 1) * len(p[-1][1]) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in kids
            saved[p[:d]] += own_saved
    digest = lambda p: hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()
    return sorted((min(cs), len(p), min(members[p[:-1]]) if p else -1, len(cs), kids.get(p, 0), leaves[p], saved[p], digest(p)) for p, cs in members.items())


def found(df):
    return sorted(tuple(-1 if x is None else x for x in r) for r in df.collect())


SCHEMA = "conv_id long, turn long, role string, text string, k1 long, depth int, part int, n long"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], SCHEMA).repartition(3)


def random_rows():
    rng = random.Random(3)
    rows = []
    for c in [*range(-120, 140, 3), -100, 1, 100, 250, 7000]:
        for t in rng.sample(range(12), rng.randint(1, 9)):
            turn = None if t == 0 else t
            rows.append((c, turn, rng.choice(["user", "", None]), rng.choice(["a", "bé", "", None, "long text " * 3])))
    rows += [(5001, t, "user", f"t{t % 2}") for t in range(70)] + [(5002, t, "user", f"t{t % 2}") for t in range(65)]
    rows.append((None, 1, "user", "x"))
    return rows


def test_against_brute_force(spark):
    rows = random_rows()
    assert found(trie.trie(frame(spark, rows))) == brute(rows)


def test_small_stretches_and_strings_change_nothing(spark, monkeypatch):
    rows = random_rows()
    monkeypatch.setattr(trie, "STRETCH", 4)
    monkeypatch.setattr(trie, "PACKED", 2)
    assert found(trie.trie(frame(spark, rows))) == brute(rows)


def test_one_conversation_and_one_path_hold_most_rows(spark):
    rows = [(777, t, "user", str(t % 3)) for t in range(900)] + [(c, t, "user", "same") for c in range(1000, 1200) for t in range(3)]
    assert found(trie.trie(frame(spark, rows))) == brute(rows)


def test_ties_and_repeated_rows(spark):
    own, other = [c for c in range(1, 99) if zlib.crc32(str(c).encode()) % 6 == 0][:2]
    rows = [(own, 5, "user", "b"), (own, 5, "user", "a"), (own, 5, "user", "a"), (own, None, "user", "z"), (other, 1, "u", "x"), (other, 1, "u", "x")]
    once = found(trie.trie(frame(spark, rows)))
    again = found(trie.trie(frame(spark, rows[::-1])))
    assert once == again and max(r[1] for r in once) == 4
    # null first, then the two equal turns next to each other
    placed = sorted((r.conv_id, r.pos, bytes(r.digest)) for r in trie.numbered(trie.turns(frame(spark, rows))).collect())
    assert [p for c, p, _ in placed if c == own] == [1, 2, 3, 4]
    digests = [d for c, _, d in placed if c == own]
    assert digests[1] == digests[2] or digests[2] == digests[3]


def test_no_rows_and_null_ids(spark):
    assert trie.trie(frame(spark, [])).count() == 0
    assert trie.trie(frame(spark, [(None, 1, "u", "x")])).count() == 0


def test_conversation_without_turns_is_at_the_root(spark):
    c = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 == 5)
    (row,) = trie.trie(frame(spark, [(c, 1, "u", "x")])).collect()
    assert (row.conv_id, row.depth, row.parent_conv_id, row.n_convs, row.n_children, row.n_leaves, row.saved_tokens) == (c, 0, None, 1, 0, 1, 0)
    assert row.ends_sha256 == hashlib.sha256(str(c).encode()).hexdigest()


@pytest.mark.parametrize("name", ["op12_prefix_trie"])
def test_same_as_sql(spark, name):
    assert difference(registry.queries()[name](spark, SF).toPandas(), connect(SF).sql(registry.oracle_sql()[name]).df()) == ""
