"""Long texts are hashed and counted in pieces, with the results of whole texts and in memory that is a small multiple of the text's."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import langid, substring, suffix
from tidemark.llm.rounds import Block


def block(texts):
    return Block(pa.table({"id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts, pa.string())}))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdeéж") for _ in range(rng.randint(1, 9))) for _ in range(50)]
    line = lambda n: "".join(rng.choice(words) + rng.choice(["  ", " ", "\n", "\t"]) for _ in range(n))
    return [line(5), line(900), "", " \n ", "x" * 3000, line(40) * 12, line(2), "short"]


def windows_of(stretches):
    """The anchor of every window by document and place."""
    out = {}
    for anchor, owner, start, n in zip(*(x.tolist() for x in (stretches.anchor, stretches.owner, stretches.start, stretches.windows)), strict=True):
        for i in range(start, start + n):
            assert (owner, i) not in out
            out[owner, i] = anchor
    return out


@pytest.mark.parametrize("piece", [1, 64, 1000])
def test_stretches_in_pieces(texts, monkeypatch, piece):
    some = block(texts)
    whole = windows_of(suffix.Stretches(some, suffix.LENGTH, suffix.GRAM))
    assert set(whole) == {(i, at) for i, t in enumerate(some.texts) for at in range(len(t) - suffix.LENGTH + 1)}
    monkeypatch.setattr(suffix, "CHUNK", piece)
    assert windows_of(suffix.Stretches(some, suffix.LENGTH, suffix.GRAM)) == whole


@pytest.mark.parametrize("piece", [1, 64, 1000])
def test_windows_in_pieces(texts, monkeypatch, piece):
    some = block(texts)
    whole = substring.Windows(some)
    assert whole.n_words == sum(len(t.split()) for t in some.texts) and whole.words == [len(t.split()) for t in some.texts]
    monkeypatch.setattr(substring, "CHUNK", piece)
    pieces = substring.Windows(some)
    assert pieces.words == whole.words and all((getattr(pieces, x) == getattr(whole, x)).all() for x in ("hash", "owner", "start"))


@pytest.mark.parametrize("piece", [1, 2, 3, 50])
def test_grams_in_pieces(texts, monkeypatch, piece):
    whole = [langid.ranked(t).tolist() for t in texts]
    monkeypatch.setattr(langid, "PIECE", piece)
    assert [langid.ranked(t).tolist() for t in texts] == whole


def peak(run):
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_memory_of_a_long_text():
    rng = np.random.default_rng(2)
    letters = rng.choice(np.frombuffer(b"abcdefgh  ", np.uint8), 16_000_000).tobytes().decode()
    some = block([letters])
    assert peak(lambda: langid.ranked(letters)) < 20 * len(letters)
    assert peak(lambda: substring.Windows(some)) < 20 * len(letters)
    assert peak(lambda: suffix.Stretches(some, suffix.LENGTH, suffix.GRAM)) < 20 * len(letters)
