"""Encoding and decoding against the tokenizers library."""

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import bpe
from tidemark.llm.shared import tokenizer_path

ODD = [None, "", " ", "Héllo  wörld's 123 <|endoftext|> foò!! ÀÉİ ﬁ <|STARTOFTEXT|>x", "ΑΣ ΣΑΣ", "a\x1cb \x85c d", "é́ 가", "'s'S don't ''t", "aaaaaaaaaa" * 30, "日本語 ١٢٣ 🙂🙂", "x<|endoftext|><|startoftext|>y", "<| |>"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


@pytest.fixture(scope="module")
def model():
    return bpe.WordBpe(tokenizer_path())


def both(library, text):
    ids = library.encode(text, add_special_tokens=False).ids
    return " ".join(map(str, ids)), library.decode(ids, skip_special_tokens=False)


#: Marks of Unicode 16 whose combining class Python's tables don't have, and letters that compose with them.
NEW_MARKS = "".join(chr(c) for a, b in ((0x897, 0x897), (0x1ACF, 0x1AEB), (0x10D69, 0x10D6D), (0x10EFA, 0x10EFC), (0x11380, 0x113FF), (0x11B60, 0x11B67), (0x16100, 0x1613F), (0x16D40, 0x16D7F), (0x1E5EE, 0x1E5EF), (0x1E6E0, 0x1E6FF)) for c in range(a, b + 1))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"], exclude_characters=NEW_MARKS), max_size=40), min_size=1, max_size=5))
def test_any_text(library, model, texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    assert list(model.encode(texts)) == [both(library, t) for t in texts]


def test_every_code_point(library, model):
    """In texts of 64 code points each, beside letters, digits and others."""
    for between in ("a", "7", " ", "-"):
        texts = [between.join(map(chr, range(a, a + 64))) for a in range(0, 0x110000, 64) if not 0xD800 <= a < 0xE000]
        for at in range(0, len(texts), 1000):
            assert list(model.encode(texts[at : at + 1000])) == [both(library, t) for t in texts[at : at + 1000]]


def test_odd_texts(library, model):
    texts = [t or "" for t in ODD]
    assert list(model.encode(texts)) == [both(library, t) for t in texts]


def test_digests(spark, docs, library):
    rows = [(i, t, "x") for i, t in enumerate(ODD)]
    extra = spark.createDataFrame(rows, "doc_id long, text string, ids string").unionByName(docs.select("doc_id", "text", docs.lang.alias("ids")))
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(extra, tokenizer_path()).collect())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    wanted = []
    for r in extra.collect():
        ids, decoded = both(library, r.text or "")
        wanted.append((r.doc_id is None, r.doc_id or 0, len(ids.split()), sha(ids), sha(decoded)))
    assert got == sorted(wanted)


def test_arrays_and_decode(spark, library):
    df = spark.createDataFrame([(1, "the cat sat", 5), (2, None, 6)], "doc_id long, text string, token_ids int")
    encoded = bpe.encode(df, tokenizer_path())
    rows = {r.doc_id: r for r in bpe.decode(encoded, tokenizer_path()).collect()}
    assert rows[1].token_ids == library.encode("the cat sat", add_special_tokens=False).ids
    assert rows[1].decoded == both(library, "the cat sat")[1]
    assert rows[2].token_ids == [] and rows[2].decoded == ""


def test_empty_table(no_docs):
    assert bpe.digests(no_docs, tokenizer_path()).count() == 0


def test_cache_bound(library):
    small = bpe.WordBpe(tokenizer_path(), remembered=5)
    texts = [f"w{i} x{i}" for i in range(20)]
    for t in texts:
        assert list(small.encode([t])) == [both(library, t)]
    assert len(small.chunks) <= 5
