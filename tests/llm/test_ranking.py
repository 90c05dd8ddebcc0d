"""Ranked search against brute force and SQL."""

import math
import random
import re
from collections import Counter

import pytest
from oracle import connect, difference

from tidemark.llm import ranking, registry

SF = "/root/testdata/sf0.01"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k=10):
    """Rows of item, rank, doc_id and score; rows of ``docs`` are (doc_id, text), of ``items`` (item_id, text)."""
    counted = [(i, Counter(ws), len(ws)) for i, t in docs if (ws := words(t))]
    big_n, big_l = len(counted), sum(n for _, _, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, []).extend(words(t))
    out = []
    for item, ts in asked.items():
        scored = []
        for doc_id, c, n in counted:
            m = 25 + (75 * n * big_n) // big_l
            score = sum(math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in ts)
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0))
        out += [(item, r, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def found(df):
    return sorted(map(tuple, df.collect()), key=repr)


ITEMS = "item_id long, text string, doc_id long, score long, id long"


def item_frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3) for r in rows], ITEMS)


def some_items(docs):
    rng = random.Random(2)
    texts = [r.text for r in docs.select("text").collect() if r.text]
    rows = [(i, " ".join(rng.choice(texts).split()[:12])) for i in range(30)]
    return [*rows, (31, None), (32, ""), (33, "... !!"), (34, "zzz-unknown"), (35, "TWO Words two"), (36, "é" * 3), (None, "one word"), (35, "more words"), (-4, texts[9])]


def test_against_brute_force(spark, docs):
    rows = some_items(docs)
    got = found(ranking.search(docs, item_frame(spark, rows)))
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()], rows)
    assert len(got) > 200


@pytest.mark.parametrize(("name", "value"), [("CHUNK_BYTES", 300), ("ENTRIES", 40), ("PIECE", 5), ("DEPTH", 1)])
def test_bounds_change_nothing(spark, docs, monkeypatch, name, value):
    rows = some_items(docs)
    wanted = brute([(r.doc_id, r.text) for r in docs.collect()], rows, 3)
    monkeypatch.setattr(ranking, name, value)
    assert found(ranking.search(docs, item_frame(spark, rows), 3)) == wanted


def test_ties_and_repeats(spark):
    rows = [(i, "same words here") for i in (9, 4, 4, 7, None, 12)] + [(1, "other"), (2, None), (3, "  "), (30, "rare " + "filler " * 200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    items = [(1, "same same rare"), (2, "other")]
    got = found(ranking.search(docs, item_frame(spark, items), 4))
    assert got == brute(rows, items, 4)
    assert [r[2] for r in got if r[0] == 1] == [4, 4, 7, 9]


def test_reading_stops_early(spark):
    """A few documents hold a rare term; of the many that hold the common one only the head of the list is read."""
    rows = [(i, f"common filler{i} " * (1 + i % 50)) for i in range(20_000)] + [(i, "common rare words") for i in range(20_000, 20_040)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(1)
    items = item_frame(spark, [(1, "common rare")])
    assert ranking.looked_up(docs, items) < 2000
    assert found(ranking.search(docs, items)) == brute(rows, [(1, "common rare")])


def test_pieces_cut_no_term(monkeypatch):
    text = "a bb  CCC-dddd é" + "x" * 50 + " end"
    whole = [t.decode() for piece in ranking.terms(text.encode()) for t in piece]
    assert whole == words(text)
    for size in range(1, 40):
        monkeypatch.setattr(ranking, "PIECE", size)
        assert [t.decode() for piece in ranking.terms(text.encode()) for t in piece] == whole


def test_empty_tables(spark, docs, no_docs):
    assert ranking.search(no_docs, item_frame(spark, [(1, "word")])).count() == 0
    assert ranking.search(docs, item_frame(spark, [])).count() == 0
    assert ranking.search(docs.where("text is null"), item_frame(spark, [(1, "word")])).count() == 0


def test_same_as_sql(spark):
    name = "op13_ranked_search"
    assert difference(registry.queries()[name](spark, SF).toPandas(), connect(SF).sql(registry.oracle_sql()[name]).df()) == ""
