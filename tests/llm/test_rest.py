"""Language ID, quality rules, mixing, HTML, top-k, licences and the pipeline."""

import html as entities
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import tokenizers
import xxhash

import corpus_pipeline
from tidemark.llm import html, langid, licenses, mixing, quality, registry, topk
from tidemark.llm.shared import tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# Language ID


def brute_ranked(text):
    words = re.findall(r"[^\W\d_]+", text.lower())
    counts = Counter()
    for w in words:
        padded = [0, *map(ord, w), 0]
        for n in (1, 2, 3):
            for i in range(len(padded) - n + 1):
                g = padded[i : i + n]
                if n == 1 and g == [0] or n == 3 and g[1] == 0:
                    continue
                key = 0
                for x in g:
                    key = key << 21 | x
                counts[key] += 1
    return [k for k, _ in sorted(counts.items(), key=lambda kv: (-kv[1], kv[0]))[: langid.PROFILE]]


@pytest.mark.parametrize("text", ["", "...", "Hello, hello World", "Été à la plage! 12 été", "a"])
def test_ranked_grams(text):
    assert langid.ranked(text).tolist() == brute_ranked(text)


def test_language_of_clear_texts(spark):
    en = ["the cat and the dog were in the house with this thing", "that is what they would have thought about the weather"]
    de = ["der hund und die katze sind nicht in dem schönen haus", "das ist was wir über das wetter gedacht haben würden"]
    rows = [(i, (en if i % 2 else de)[i % 4 // 2], "en" if i % 2 else "de", "x") for i in range(40)] + [(100, None, "en", "y"), (101, "12 !", "de", None), (None, "the house and the weather", None, None), (102, "and that would be the thing", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    got = {(r.doc_id, r.lang_pred): r for r in langid.identify(df).collect()}
    assert all((i, "en" if i % 2 else "de") in got for i in range(40))
    assert (100, "und") in got and (101, "und") in got and (102, "en") in got and (None, "en") in got
    assert all(0 <= r.score <= 1 for r in got.values()) and got[101, "und"].score == 0
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got.values() if r.doc_id is not None)


def test_out_of_place_by_replay(spark, docs, monkeypatch):
    """Profiles and distances counted in plain Python, with all languages at once and one at a time."""
    import zlib

    rows = docs.select("doc_id", "text", "lang").collect()
    counts = defaultdict(Counter)
    for r in rows:
        if r.doc_id is not None and r.text is not None and r.lang is not None and zlib.crc32(str(r.doc_id).encode()) % 3 != 1:
            for word in re.findall(r"[^\W\d_]+", r.text.lower()):
                padded = [0, *map(ord, word), 0]
                for n in (1, 2, 3):
                    for i in range(len(padded) - n + 1):
                        g = padded[i : i + n]
                        if not (n == 1 and g == [0]):
                            counts[r.lang][sum(x << 21 * (n - 1 - k) for k, x in enumerate(g))] += 1
    profiles = {lang: {g: k for k, (g, _) in enumerate(sorted(c.items(), key=lambda x: (-x[1], x[0]))[: langid.PROFILE])} for lang, c in counts.items()}

    def wanted(text):
        own = brute_ranked(text or "")
        if not own:
            return "und", 0.0
        away = {lang: sum(min(abs(p[g] - k), langid.PROFILE) if g in p else langid.PROFILE for k, g in enumerate(own)) for lang, p in profiles.items()}
        best = min(sorted(away), key=away.__getitem__)
        return best, 1 - away[best] / (langid.PROFILE * len(own))

    for together in (1000, 1):
        monkeypatch.setattr(langid, "LANGUAGES", together)
        got = Counter((r.doc_id, r.lang_pred, round(r.score, 9)) for r in langid.identify(docs).collect())
        assert got == Counter((r.doc_id, wanted(r.text)[0], round(wanted(r.text)[1], 9)) for r in rows)


def test_nothing_to_learn_from(spark, no_docs):
    df = spark.createDataFrame([(0, "the cat", None)], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in langid.identify(df).collect()] == ["und"]
    assert langid.identify(no_docs).count() == 0


# Quality


def brute_signals(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality_signals(docs, no_docs):
    got = quality.judged(docs).collect()
    assert len(got) == docs.count() and quality.judged(no_docs).count() == 0
    base = Counter((r.doc_id, *brute_signals(r.text)) for r in docs.collect())
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == base
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (not r.base_failed and r.quality >= 0.5)


def test_verdict_by_replay(docs):
    """Expectation-maximisation over every document, in plain Python, gives the same quality and verdict."""
    import math

    rows = quality.judged(docs).collect()
    names = [c for c in rows[0].asDict() if c.startswith("vote_")]
    votes = [[r[n] for n in names] for r in rows]
    share, table = 0.5, [[list(c) for c in quality.START] for _ in names]

    def good(v):
        odds = math.log(share) - math.log(1 - share) + sum(math.log(t[1][x + 1]) - math.log(t[0][x + 1]) for t, x in zip(table, v))
        return 1 / (1 + math.exp(max(-700, min(700, -odds))))

    for _ in range(quality.ROUNDS):
        p = [good(v) for v in votes]
        before, share = share, min(1 - 1e-4, max(1e-4, sum(p) / len(p)))
        for k in range(len(names)):
            for c in (0, 1):
                n = [1 + sum(q if c else 1 - q for q, v in zip(p, votes) if v[k] == x) for x in (-1, 0, 1)]
                table[k][c] = [x / sum(n) for x in n]
        if abs(share - before) < 1e-9:
            break
    for r, v in zip(rows, votes):
        assert r.quality == pytest.approx(good(v), abs=1e-6) and r.kept == (not r.base_failed and good(v) >= quality.KEEP)


def test_many_distinct_words_fall_back():
    words = [b"a", b"b", b"c", b"x", b"a", b"b", b"c", b"y"]
    assert quality.repeated_words_of(words) == 6
    assert quality.repeated_words(np.array([0, 1, 2, 3, 0, 1, 2, 4])) == 6


def test_estimates_find_the_planted_accuracies():
    rng = np.random.default_rng(0)
    good = rng.random(20_000) < 0.7
    right = np.array([0.95, 0.9, 0.85, 0.8, 0.7])
    votes = np.where(rng.random((20_000, 5)) < right, np.where(good, 1, -1)[:, None], np.where(good, -1, 1)[:, None])
    votes[rng.random(votes.shape) < 0.2] = 0
    patterns = Counter(map(tuple, votes.tolist()))
    share, table = quality.fit(list(patterns.items()), 5)
    assert abs(share - 0.7) < 0.03
    found = table[:, 1, 2] / (table[:, 1, 0] + table[:, 1, 2])
    assert np.abs(found - right).max() < 0.04
    assert ((quality.posterior(votes, share, table) > 0.5) == good).mean() > 0.95


# Mixing


def targets(spark, words, weights):
    rows = spark.createDataFrame(list(zip(range(len(words)), words, map(float, weights))), "number long, words long, weight double")
    return [r.target for r in mixing.with_targets(rows).sort("number").collect()]


def test_targets(spark):
    assert targets(spark, [100, 100, 100], [5, 2, 1]) == pytest.approx([187.5, 75, 37.5])
    assert targets(spark, [10, 1000], [5, 2]) == pytest.approx([30, 980])
    assert targets(spark, [0, 10], [5, 2]) == [0, 10]
    assert targets(spark, [], []) == []
    assert targets(spark, [0], [5.0]) == [0]
    rng = np.random.default_rng(1)
    words, weights = rng.integers(0, 1000, 60).tolist(), [5, 2, 1] * 20
    out, full = np.zeros(60), np.zeros(60, bool)
    while True:  # share the rest by weight until none is above its limit
        open_ = np.where(full, 0, weights)
        out = np.where(full, 3.0 * np.array(words), (sum(words) - 3 * sum(w for w, f in zip(words, full) if f)) * open_ / open_.sum())
        if not (above := out > 3 * np.array(words)).any():
            break
        full |= above
    assert targets(spark, words, weights) == pytest.approx(out.tolist())


def test_drawn_counts(spark, monkeypatch):
    rng = np.random.default_rng(2)
    wanted = rng.random(50) * 100
    wanted[7] = 0
    rows = spark.createDataFrame([(i, float(w)) for i, w in enumerate(wanted)], "number long, slots double")
    by_fan = []
    for fan in (4096, 5):  # drawn among all at once, and down a tree
        monkeypatch.setattr(mixing, "FAN", fan)
        counts = {}
        for seed in range(12):
            got = mixing.shard_counts(rows, seed, 64).collect()
            shards = Counter()
            for r in got:
                shards[r.shard] += r["count"]
            assert sum(shards.values()) == round(wanted.sum()) and set(list(shards.values())[:-1]) <= {64, round(wanted.sum()) % 64}
            counts[seed] = Counter()
            for r in got:
                counts[seed][r.number] += r["count"]
        totals = np.array([[c[i] for i in range(50)] for c in counts.values()])
        assert totals[:, 7].max() == 0 and (totals.std(axis=0).max() > 0)  # another seed draws other counts
        off = (totals.mean(axis=0) - wanted) / np.sqrt(np.maximum(wanted, 1))
        assert np.abs(off).max() < 1.5 and np.abs(totals - wanted).mean() < 1 and np.abs(totals - wanted).max() < 6  # 50 rounded fractions are off by two or so together
        by_fan.append(totals)
    assert mixing.shard_counts(rows.limit(0)).count() == 0


def test_spread_of_drawn_counts(spark):
    """A shard's counts vary as multinomial draws do, before and after totals are brought to the targets."""
    wanted = np.array([12000.0, 7000, 4000, 1500, 900, 200])
    rows = spark.createDataFrame([(i, float(w)) for i, w in enumerate(wanted)], "number long, slots double")
    share = wanted / wanted.sum()
    for counts in (mixing.multinomial_counts, mixing.shard_counts):
        table = np.zeros((400, 6))
        for r in counts(rows, 3, 64).collect():
            table[r.shard, r.number] = r["count"]
        assert (table.sum(axis=1) == 64).all()
        assert table.var(axis=0) == pytest.approx(64 * share * (1 - share), rel=0.2)
        correlation = np.corrcoef(table.T)[0, 1]
        assert correlation == pytest.approx(-np.sqrt(share[0] * share[1] / (1 - share[0]) / (1 - share[1])), abs=0.1)
    assert np.abs(table.sum(axis=0) - wanted).max() <= 1


def xxh(seed, *values):
    for v in values:
        seed = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else v, seed)
    return seed - (1 << 64) if seed >> 63 else seed


def replayed(size, key):
    """A source's permutation in plain Python."""
    primes = (1_000_003, 1_000_033, 1_000_037, 1_000_039, 1_000_081, 1_000_099, 1_000_117, 1_000_121)
    long, number = (lambda x: int(x).to_bytes(8, "little", signed=True)), (lambda x: int(x).to_bytes(4, "little"))
    out = list(range(size))
    for r in range(4):
        a, b, c = (xxh(42, long(key), number(r), x) for x in "abc")
        first = a % (1 << 30) % 8
        prime = next(p for p in (primes[(first + i) % 8] for i in range(8)) if size % p)
        out = [(i * prime + b % (1 << 30)) % size for i in out]
        cut = c % size + 1
        out = [cut - 1 - i if i < cut else i for i in out]
    return out


def test_slots_by_replay(spark):
    from pyspark.sql import functions as F

    sources = spark.createDataFrame([(0, 7, 18.0), (1, 40, 25.0), (2, 1, 3.0), (3, 0, 0.0), (4, 64, 100.5)], "number long, blocks long, slots double")
    drawn = mixing.shard_counts(sources, 5, 16).checkpoint()
    got = Counter((r.shard, r.number, r.block) for r in mixing.slots(sources, drawn, 5).collect())
    first, wanted = Counter(), Counter()
    of = {r.number: r.blocks for r in sources.collect()}
    for r in sorted(drawn.collect()):
        for slot in range(first[r.number], first[r.number] + r["count"]):
            turn, index = divmod(slot, of[r.number])
            if turn < 3:
                key = xxh(42, (5).to_bytes(4, "little"), r.number.to_bytes(8, "little"), turn.to_bytes(8, "little"))
                wanted[r.shard, r.number, replayed(of[r.number], key)[index]] += 1
        first[r.number] += r["count"]
    assert got == wanted and len({s for s, _, _ in got}) == 10
    one = drawn.groupBy("number").agg(F.sum("count").alias("count")).withColumn("shard", F.lit(0).cast("long"))
    assert Counter((r.number, r.block) for r in mixing.slots(sources, one, 5).collect()) == sum((Counter({k[1:]: n}) for k, n in got.items()), Counter())  # the counts alone decide what is taken; shards, where it goes


def test_another_seed_takes_other_words(docs):
    taken = [Counter((r.id, r.tie, r.from_word) for r in mixing.mixed(docs, seed=seed)[1].collect()) for seed in (1, 2)]
    assert taken[0] != taken[1]


def test_mix(docs, no_docs):
    rows = docs.collect()
    got = mixing.shares(docs).collect()
    size = lambda t: len(WORD.findall(t or ""))
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((r.doc_id, size(r.text)) for r in rows)
    assert all(0 <= r.taken <= 3 * r["size"] for r in got)
    by_target = defaultdict(int)
    for r in got:
        by_target[r.source_size, r.target] += r.taken
    assert sum(t for _, t in by_target) == pytest.approx(sum(r["size"] for r in got))
    assert all(abs(taken - target) <= 4 * mixing.BLOCK_WORDS for (_, target), taken in by_target.items())
    clashing = docs.selectExpr("*", "1 AS mix_id", "2 AS mix_copies", "3 AS pieces", "4 AS row", "5 AS nth", "6 AS mix_tie")
    assert mixing.mix(clashing).columns == clashing.columns and mixing.mix(clashing).count() == mixing.mix(docs).count()
    again = mixing.shares(docs.repartition(3)).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))
    out = mixing.mix(docs).collect()
    assert Counter((r.doc_id, size(r.text)) for r in out) == Counter((r.doc_id, r.taken) for r in got if r.taken)
    assert all(r.n_chars == len(r.text) for r in out)
    assert set(mixing.mix(docs).columns) == set(docs.columns)
    assert mixing.shares(no_docs).count() == 0 and mixing.mix(no_docs).count() == 0


def test_cut():
    text = "a  b\nc d e"
    assert mixing.cut(text, [(0, 2, 1), (2, 3, 1)]) == text
    assert mixing.cut(text, [(0, 2, 2), (3, 2, 1)]) == "a  b\nd e\na  b"


# HTML

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var x="<p>no</p>";</script></head><body class="has-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a href="/a">menu</a></ul></nav><div class="cookie-notice">We use cookies</div>
<div id="main-1"><div class="ad">Buy</div><article class="post"><h1>Head &amp; shoulders</h1><p>First <b>bold
text</b> with a <a href="/l">link</a>.<p>Second&nbsp;one<br>goes on.</p><form>Subscribe <input></form><ul><li>x<li>y</ul></article></div>
<section id="comments"><p>Nice post! I like it a lot, really, so much that I write a long comment.</p></section><aside>Related</aside><footer>&copy; us</footer>"""


def test_page():
    assert html.main_text(PAGE) == "Head & shoulders\nFirst bold text with a link.\nSecond one goes on.\nx\ny"
    assert html.main_text(None) == "" and html.main_text("") == "" and html.main_text("<p>") == ""
    assert html.main_text("just text < 3 &amp; more") == "just text < 3 & more"
    assert html.main_text("<div>a</div><!-- never closed <p>b</p>") == "a"


def test_host_votes(spark):
    good = "<body><div class='story-{i}'><p>" + "word " * 30 + "</p></div><div class='box'><p>" + "side " * 2 + "</p></div></body>"
    odd = "<body><div class='story-9'><p>short piece here</p></div><div class='box'><p>" + "side " * 2 + "</p></div></body>"
    rows = [(i, f"https://H.example/{i}", good.replace("{i}", str(i)), "t") for i in range(5)] + [(5, "https://h.example/x", odd, "t"), (6, None, "<p>alone</p>", None), (7, "https://o.example", None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in html.extract(pages, keep=["page_id", "url"]).collect()}
    assert got[5].text == "short piece here"
    assert got[0].text == ("word " * 30).strip() and got[6].text == "alone" and got[7].text == "" and got[7].n_chars == 0
    assert html.extract(pages.limit(0)).count() == 0
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_winner_join_without_broadcast(spark, monkeypatch):
    pages = spark.createDataFrame([(1, "http://a/", "<p>x y</p>"), (2, "http://b/", "<p>z</p>")], "page_id long, url string, html string")
    whole = sorted(map(tuple, html.extract(pages).collect()))
    monkeypatch.setattr(html, "SMALL_WINNERS", 0)
    assert sorted(map(tuple, html.extract(pages).collect())) == whole
    assert entities.unescape("&amp;") == "&"


# Top-k


def test_top_k(spark, monkeypatch):
    rng = np.random.default_rng(6)
    vectors = rng.normal(0, 0.3, (230, 10)).astype(np.float32)
    vectors[100:140] = vectors[0]
    rows = [(i, v.tolist(), i) for i, v in enumerate(vectors)]
    rows += [(300, None, 0), (350, [float("nan")] * 10, 0), (400, [None] * 10, 0), (None, vectors[3].tolist(), 0), (450, [float("inf")] + [0.0] * 9, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    whole = np.floor(vectors.astype(np.float64) * 256).astype(np.int64)
    wanted = []
    for q in range(0, 230, 50):
        scored = sorted(((-int(whole[q] @ whole[c]), c) for c in range(230) if c != q))[:5]
        wanted += [(q, k + 1, c, -s) for k, (s, c) in enumerate(scored)]
    for queries in (16_384, 2):
        monkeypatch.setattr(topk, "QUERIES", queries)
        assert sorted(map(tuple, topk.nearest(df).collect())) == wanted
    few = df.where("vec_id IN (0, 1, 50)")
    assert Counter(r.query_id for r in topk.nearest(few).collect()) == {0: 2, 50: 2}
    assert topk.nearest(df.limit(0)).count() == 0


@pytest.mark.parametrize("size", [1.0, 1e12, 1e200])
def test_top_k_of_any_size(spark, size):
    rng = np.random.default_rng(8)
    vectors = (rng.normal(0, size, (60, 7))).tolist()
    vectors[20] = vectors[0][:]
    vectors[21] = [*vectors[0][:6], np.nextafter(vectors[0][6], np.inf).item()]
    vectors[22] = vectors[0][:5]  # shorter
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>").repartition(3)
    whole = [[int(x) * 256 if abs(x) >= 1 << 52 else int(np.floor(x * 256)) for x in v] for v in vectors]
    for q in (0, 50):
        scored = sorted((-sum(a * b for a, b in zip(whole[q], whole[c])), c) for c in range(60) if c != q)[:5]
        got = sorted((r["rank"], r.vec_id, r.score) for r in topk.nearest(df).collect() if r.query_id == q)
        assert got == [(n + 1, c, max(-(1 << 63), min((1 << 63) - 1, -s))) for n, (s, c) in enumerate(scored)]


def test_top_k_prunes(spark):
    """The share of the pairs that is left to phase 3; figures in the README."""
    rng = np.random.default_rng(9)
    centres = rng.normal(0, 1, (20, 64))
    for name, vectors, most in (("clustered", centres[rng.integers(0, 20, 2000)] + rng.normal(0, 0.3, (2000, 64)), 0.15), ("random", rng.normal(0, 1, (2000, 64)), 0.4)):
        vectors /= np.linalg.norm(vectors, axis=1)[:, None]
        df = spark.createDataFrame(list(enumerate(vectors.tolist())), "vec_id long, embedding array<double>")
        share = topk.kept_pairs(df, df.where("vec_id % 50 = 0")) / (40 * 2000)
        print(name, share)
        assert 0 < share < most


# Licences


def test_licences(spark, docs):
    mit = licenses.TEXTS["MIT"]
    rows = [(1, mit, "d"), (2, "Copyright (c) 2020 Someone\n\n" + mit.upper().replace("SUBLICENSE", "sub-license"), "d"), (3, mit[:-20], "d"), (4, None, None), (5, "x\nReleased under the MIT Licence.\nLicensed under CC BY-NC 4.0\n", None), (5, "x", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, digest string")
    got = sorted(((r.doc_id, r.license_id or "", r.n_notices, r.notice_ids or "") for r in licenses.scan(df).collect()))
    assert got == [(1, "MIT", 0, ""), (2, "MIT", 0, ""), (3, "", 0, ""), (4, "", 0, ""), (5, "", 0, ""), (5, "", 2, "CC-BY-NC-4.0,MIT")]
    documents = docs.select("doc_id", "text").toPandas()  # noqa: F841  read by DuckDB
    want = duckdb.sql(licenses.sql()).fetchall()
    assert Counter((r.doc_id, r.digest, r.license_id, r.n_notices, r.notice_ids) for r in licenses.scan(docs).collect()) == Counter((None if r[0] is None or r[0] != r[0] else int(r[0]), *r[1:]) for r in want)


def test_every_query_has_its_number():
    names = set(registry.queries())
    assert "pipeline" in names and {int(n[2:].split("_")[0]) for n in names if n.startswith("op")} == set(range(1, 14))


# Pipeline


def test_language_stage_corrects_labels_and_takes_wanted_languages(spark):
    en = ["the cat and the dog were in the house with this thing", "that is what they would have thought about the weather"]
    de = ["der hund und die katze sind nicht in dem schönen haus", "das ist was wir über das wetter gedacht haben würden"]
    rows = [(i, (en if i % 2 else de)[i % 4 // 2], "en" if i % 2 else "de", "s", 1) for i in range(60)]
    rows += [(100, "the house and the weather", "de", "s", 1), (101, "das schöne haus und der hund", None, "s", 1), (102, "12 !!", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.lang for r in corpus_pipeline.language_id(spark, docs, "").collect()}
    assert got[100] == "en" and got[101] == "de" and 102 not in got and len(got) == 62
    only = {r.doc_id: r.lang for r in corpus_pipeline.language_id(spark, docs, "", ("de",)).collect()}
    assert only == {i: lang for i, lang in got.items() if lang == "de"}


def test_suffix_stage_keeps_whole_characters(spark):
    shared = "".join(chr(0x430 + i) for i in range(80))
    rows = [(1, "aé" + shared + " b", "en", "s", 1), (2, "genuine \ufffd stays ũ" + shared + "\ufffd", "en", "s", 1)]  # é and ũ end with the same byte
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.suffix_dedup(spark, docs, "").collect()}
    want = "genuine \ufffd stays \ufffd"
    assert got == {1: (rows[0][1], len(rows[0][1])), 2: (want, len(want))}


def test_mix_stage_by_replay(spark, docs):
    """The texts of the stage are put together again from the pieces, word by word."""
    stage_docs = docs.select(corpus_pipeline.COLUMNS)
    pieces = defaultdict(list)
    for r in mixing.mixed(stage_docs)[1].collect():
        pieces[r.id, r.tie, r.number, r.start].append((r.from_word, r.n_words, r.times))
    texts = {r.doc_id: r.text for r in stage_docs.collect()}
    many = Counter(r.doc_id for r in stage_docs.collect())
    got = {r.doc_id: r.text for r in corpus_pipeline.mix_sources(spark, stage_docs, "").collect()}
    for (i, *_), parts in pieces.items():
        if i is not None and many[i] == 1:
            words = WORD.findall(texts[i])
            taken = [w for turn in range(3) for a, n, t in sorted(parts) if t > turn for w in words[a : a + n]]
            assert WORD.findall(got[i]) == taken


def test_pipeline_stages(spark, docs, tmp_path):
    stage_docs = docs.select(corpus_pipeline.COLUMNS)
    langs = corpus_pipeline.language_id(spark, stage_docs, "")
    assert Counter((r.doc_id, r.text) for r in langs.collect()) == Counter((r.doc_id, r.text) for r in docs.collect() if r.text and re.search(r"[^\W\d_]", r.text))
    frame = stage_docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, frame, "")
        if name != "encode":
            assert out.columns == corpus_pipeline.COLUMNS
        path = str(tmp_path / name)
        out.write.parquet(path)
        frame = spark.read.parquet(path)
    library = tokenizers.Tokenizer.from_file(tokenizer_path())
    library.no_truncation()
    library.no_padding()
    texts = {r.doc_id: r.text for r in spark.read.parquet(str(tmp_path / "mix_sources")).collect()}
    for r in frame.collect():
        assert r.doc_id is None or r.token_ids == library.encode(texts[r.doc_id], add_special_tokens=False).ids
    empty = stage_docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "").count() == 0
