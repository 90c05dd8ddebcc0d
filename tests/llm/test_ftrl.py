"""The classifier against a plain version, by held-out accuracy, and in its edge cases."""

import math
import re

import numpy as np
import pytest

from tidemark.llm import ftrl, registry

SF = "/root/testdata/sf0.1"
RUNS = re.compile(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\x00-\x20\x7f]+")


def plain_vector(text: str) -> dict[tuple, float]:
    """n-grams of words and of shapes, by what they are."""
    raw = (text or "").encode()
    words = [m[0] for m in RUNS.finditer(raw)]
    low = [re.sub(rb"[A-Z]", lambda m: m[0].lower(), w) for w in words]
    shapes = []
    for i, w in enumerate(words):
        upper, digits = len(re.findall(rb"[A-Z]", w)), len(re.findall(rb"[0-9]", w))
        mark = not re.match(rb"[0-9A-Za-z\x80-\xff]", w)
        shape = ("mark", w[0], min(len(w), 3)) if mark else ("digits",) if digits else ("upper", min(upper, 2))
        shapes.append((shape, 1 if i and low[i] == low[i - 1] else 2 if i > 1 and low[i] == low[i - 2] else 0))
    counts = {}
    for grams in (zip(low), zip(low, low[1:]), zip(shapes), zip(shapes, shapes[1:]), zip(shapes, shapes[1:], shapes[2:])):
        for g in grams:
            counts[g] = counts.get(g, 0) + 1
    values = {g: 1 + math.log(n) for g, n in counts.items()}
    norm = math.sqrt(sum(v * v for v in values.values()))
    return {g: v / norm for g, v in values.items()}


def vector(*texts: str) -> list[tuple[np.ndarray, np.ndarray]]:
    raw = [t.encode() for t in texts]
    return [ftrl.scaled(*x) for x in ftrl.counted(np.append(0, np.cumsum([len(r) for r in raw])), np.frombuffer(b"".join(raw), np.uint8))]


TEXTS = ["The cat, the CAT!! and 3 cats | a | b", "", "  \n ", "x", "Der Der Der Der. a. a. a. a.", "é Éa ñ%%% so%%%so"]


def test_vectors_against_plain_features(monkeypatch):
    for text, (places, values) in zip(TEXTS, vector(*TEXTS), strict=True):
        wanted = plain_vector(text)
        assert places[-1] == ftrl.DIM and values[-1] == 1.0
        assert np.allclose(sorted(values[:-1]), sorted(wanted.values()))  # so few n-grams don't share places
    # equal n-grams of different documents have equal places
    a, b = vector("one two", "zero one two")
    assert len(set(a[0]) & set(b[0])) >= 4


def test_pieces_change_nothing(monkeypatch):
    text = " ".join(TEXTS * 40)
    (whole,) = vector(text)
    monkeypatch.setattr(ftrl, "PIECE", 37)
    places, values = ftrl.scaled(*ftrl.long_counts(np.frombuffer(text.encode(), np.uint8)))
    assert np.array_equal(places, whole[0]) and np.allclose(values, whole[1])


def test_updates_against_plain_ftrl():
    rng = np.random.default_rng(5)
    rows = [(np.unique(rng.integers(0, 50, 8)), int(y)) for y in rng.integers(0, 2, 60)]
    state, z, n = ftrl.State.empty(), {}, {}
    for places, y in rows:
        values = rng.random(len(places))
        state.learn(places, values, y)
        weight = lambda i: 0.0 if abs(z.get(i, 0.0)) <= ftrl.L1 else (math.copysign(ftrl.L1, z[i]) - z[i]) / ((ftrl.BETA + math.sqrt(n[i])) / ftrl.ALPHA + ftrl.L2)
        before = {i: weight(i) for i in places.tolist()}
        p = 1 / (1 + math.exp(-sum(before[i] * v for i, v in zip(places.tolist(), values))))
        for i, v in zip(places.tolist(), values):
            g = (p - y) * v
            rate = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / ftrl.ALPHA
            z[i], n[i] = z.get(i, 0.0) + g - rate * before[i], n.get(i, 0.0) + g * g
    assert np.allclose([state.z[i] for i in sorted(z)], [z[i] for i in sorted(z)])
    assert np.allclose([state.n[i] for i in sorted(n)], [n[i] for i in sorted(n)])


def test_held_out_documents(spark):
    rows = registry.queries()["op11_quality_classifier"](spark, SF).cache()
    assert rows.count() == 10_000 and rows.where("score not between 0 and 1 or predicted <> int(score >= 0.5)").count() == 0
    tried = rows.where("held_out").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").groupBy("quality", "predicted").count().collect()
    n = {(r.quality, r.predicted): r["count"] for r in tried}
    assert n[1, 1] / (n[1, 1] + n.get((1, 0), 0)) > 0.99 and n[0, 0] / (n[0, 0] + n.get((0, 1), 0)) > 0.95


LABELS = "doc_id long, quality int, toxic int, text string, label int"


def test_edge_cases(spark, docs, monkeypatch):
    monkeypatch.setattr(ftrl, "EPOCHS", 2)
    ids = [r.doc_id for r in docs.select("doc_id").collect()]
    labels = spark.createDataFrame([(i, n % 2, 0, "x", 7) for n, i in enumerate(ids)] + [(3, 0, 0, None, 1), (3, None, 1, None, 1), (None, 1, 0, "", 0), (6, 5, 0, "", 0)], LABELS)
    once, again = (sorted(map(tuple, ftrl.judged(docs, labels).collect()), key=repr) for _ in range(2))
    assert len(once) == len(ids) and once == again
    empty = {s for i, _, s, _ in once if i in {r.doc_id for r in docs.where("trim(coalesce(text, '')) = '' or text is null").collect()} and i is not None}
    assert len(empty) <= 2 and all(0 <= s <= 1 for *_, s, _ in once)


def test_no_labels_no_documents(spark, docs, no_docs):
    none = spark.createDataFrame([], LABELS)
    assert {r.score for r in ftrl.judged(docs, none).collect()} == {0.5}
    assert ftrl.judged(no_docs, none).count() == 0
    assert ftrl.judged(no_docs, spark.createDataFrame([(1, 1, 0, "", 0)], LABELS)).count() == 0


def test_repeated_ids_are_learned_once(spark):
    once = spark.createDataFrame([(2, "a b c"), (3, "d e f")], "doc_id long, text string")
    often = once.unionByName(once.where("doc_id = 2").crossJoin(spark.range(50)).drop("id")).repartition(4)
    labels = spark.createDataFrame([(2, 1, 0, "", 0), (3, 0, 0, "", 0)] * 3, LABELS)
    assert np.array_equal(ftrl.learn(once, labels), ftrl.learn(often, labels))


@pytest.mark.parametrize("bound", [10, 100])
def test_bound_of_learning(spark, bound):
    labels = spark.range(5000).selectExpr("id AS doc_id", "1 AS quality")
    assert 0 < ftrl.chosen(labels, "doc_id", "quality", bound).count() < 2 * bound + 10
