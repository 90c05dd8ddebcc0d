"""Byte-pair encoding and decoding with a public word-end BPE vocabulary file.

Encoding works on many words at once: the symbols of all words of a batch lie in one flat numpy array, a
binary search over the sorted keys of the merge table gives the rank of every neighbouring pair, and each
round merges the lowest-rank pair of every word. A chunk of a text between white space always gives the same
tokens, so each worker keeps a bounded cache from chunks to their tokens.

Edge cases: a null or empty text has no tokens and decodes to the empty string; a text of any length is
encoded whole; the strings of special tokens in a text become those tokens; other columns pass through.
Categories and cases of characters are those of Unicode 16, also where Python's tables are older; compositions and the order of several combining marks on
one letter are those of Python's tables.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.arrow import column_of, release, slices, text_buffers, texts_of

#: Chunks that a worker remembers before it starts anew.
CACHE_CHUNKS = 300_000

#: str.split() takes these for white space, the vocabulary's pattern doesn't.
ODD_SPACE = re.compile("[\x1c-\x1f]")
#: Unicode white space.
SPACES = "\\t-\\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WHITE = re.compile(f"[{SPACES}]+")
#: Letters and numbers, and lower-case forms, of Unicode versions later than Python's tables (first, last, distance).
LATER = {
    "L": "\u1c89-\u1c8a\ua7cb-\ua7cd\ua7da-\ua7dc\U000105c0-\U000105f3\U00010d4a-\U00010d65\U00010d6f-\U00010d85\U00010ec2-\U00010ec4\U00011380-\U00011389\U0001138b\U0001138e\U00011390-\U000113b5"
    "\U000113b7\U000113d1\U000113d3\U00011bc0-\U00011be0\U00013460-\U000143fa\U00016100-\U0001611d\U00016d40-\U00016d6c\U00018cff\U0001e5d0-\U0001e5ed\U0001e5f0",
    "N": "\U00010d40-\U00010d49\U000116d0-\U000116e3\U00011bf0-\U00011bf9\U00016130-\U00016139\U00016d70-\U00016d79\U0001ccf0-\U0001ccf9\U0001e5f1-\U0001e5fa",
}
LATER_CASES = [(0x1C89, 0x1C89, 1), (0xA7CB, 0xA7CB, 0x264 - 0xA7CB), (0xA7CC, 0xA7CC, 1), (0xA7CE, 0xA7CE, 1), (0xA7D2, 0xA7D2, 1), (0xA7D4, 0xA7D4, 1), (0xA7DA, 0xA7DA, 1), (0xA7DC, 0xA7DC, 0x19B - 0xA7DC), (0x10D50, 0x10D65, 0x20), (0x16EA0, 0x16EB8, 0x1B)]
LATER_LOWER = {c: c + step for first, last, step in LATER_CASES for c in range(first, last + 1)}


@lru_cache(maxsize=2)
def category(letter: str) -> str:
    """Ranges, for a character class, of the code points whose Unicode category starts with a letter."""
    out, start = [], None
    for i in range(sys.maxunicode + 2):
        inside = i <= sys.maxunicode and unicodedata.category(chr(i))[0] == letter
        if inside and start is None:
            start = i
        elif not inside and start is not None:
            out.append(f"\\U{start:08x}-\\U{i - 1:08x}")
            start = None
    return "".join(out) + LATER[letter]


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies.

    Printable Latin-1 bytes stand for themselves; the others take code points from 256 on, in order.
    """
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


class WordBpe:
    """The vocabulary file's model: normalising, splitting, merging and decoding."""

    def __init__(self, path: str, decoding: bool = True, remembered: int = CACHE_CHUNKS):
        self.decoding, self.remembered = decoding, remembered
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = [""] * (1 + max([*vocab.values(), *self.special.values()]))
        for token, i in [*vocab.items(), *self.special.items()]:
            self.strings[i] = token
        self.special_pattern = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        pattern = split["pattern"]["Regex"].replace(r"\p{L}", category("L")).replace(r"\p{N}", category("N")).replace(r"\s", SPACES)
        self.pieces = re.compile(pattern.replace("[[", "[").replace("]]", "]")).findall
        symbols = byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], np.int64)
        self.final = np.array([vocab[s + suffix] for s in symbols], np.int64)
        self.base = len(self.strings)
        left, right, made = [], [], []
        for a, b in (m if isinstance(m, list) else m.split(" ") for m in model["merges"]):
            left.append(vocab[a])
            right.append(vocab[b])
            made.append(vocab[a + b])
        keys = np.array(left, np.int64) * self.base + np.array(right, np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), np.array(made, np.int64)
        self.chunks: dict[str, tuple[str, str]] = {}
        self.words: dict[str, tuple[str, str]] = {}
        self.decimals = [str(i) for i in range(len(self.strings))]

    def merge(self, words: list[bytes]) -> list[list[int]]:
        """Token ids of each word (not empty), by rounds over one flat array of all their symbols."""
        lengths = np.array([len(w) for w in words], np.int64)
        ends = np.cumsum(lengths)
        raw = np.frombuffer(b"".join(words), np.uint8)
        symbols = self.inner[raw]
        symbols[ends - 1] = self.final[raw[ends - 1]]
        owner = np.repeat(np.arange(len(words)), lengths)
        done_symbols, done_owner = [], []
        never = len(self.keys)
        while len(symbols):
            pairs = symbols[:-1] * self.base + symbols[1:]
            at = np.searchsorted(self.keys, pairs)
            at[at == never] = 0
            rank = np.where((self.keys[at] == pairs) & (owner[:-1] == owner[1:]), self.ranks[at], never)
            rank = np.append(rank, never)
            starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            best = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.append(starts, len(symbols)))
            live = np.repeat(best < never, sizes)
            if not live.all():
                done_symbols.append(symbols[~live])
                done_owner.append(owner[~live])
                symbols, owner, rank = symbols[live], owner[live], rank[live]
                if not len(symbols):
                    break
                best, sizes = best[best < never], sizes[best < never]
            hit = rank == np.repeat(best, sizes)
            if (hit[1:] & hit[:-1]).any():  # of overlapping equal pairs, the first, third, ... merge
                where = np.flatnonzero(hit)
                run = np.cumsum(np.append(True, np.diff(where) != 1))
                first = where[np.append(True, np.diff(run) != 0)]
                hit[where[(where - first[run - 1]) % 2 == 1]] = False
            where = np.flatnonzero(hit)
            symbols[where] = self.made[rank[where]]
            keep = np.ones(len(symbols), bool)
            keep[where + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        flat, who = np.concatenate(done_symbols), np.concatenate(done_owner)
        flat = flat[np.argsort(who, kind="stable")].tolist()
        ends = np.cumsum(np.bincount(who, minlength=len(words))).tolist()
        return [flat[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def learn(self, chunks: set[str]) -> None:
        """Put the tokens of chunks into the cache: their ids as decimals joined by one space, and decoded."""
        words, known, several = self.words, self.chunks, {}
        single = {}
        for chunk in chunks:
            text = chunk.lower() if chunk.isascii() else unicodedata.normalize("NFC", chunk).replace("Σ", "σ").lower().translate(LATER_LOWER)
            if text.isalpha():
                single[chunk] = text
            elif len(pieces := self.pieces(text)) == 1:
                single[chunk] = pieces[0]
            else:
                several[chunk] = pieces
        new = list({*single.values(), *(w for pieces in several.values() for w in pieces)} - words.keys())
        if new:
            decimals = self.decimals
            for word, ids in zip(new, self.merge([w.encode() for w in new]), strict=True):
                words[word] = (" ".join([decimals[i] for i in ids]), self.decode(ids) if self.decoding else "")
        for chunk, word in single.items():
            known[chunk] = words[word]
        for chunk, pieces in several.items():
            ids, decoded = zip(*[words[w] for w in pieces], strict=True)
            known[chunk] = (" ".join(ids), " ".join(decoded) if self.decoding else "")
        if len(words) > self.remembered:
            self.words = {}

    def decode(self, ids) -> str:
        """The file names no decoder: tokens joined by one space, special tokens included."""
        strings = self.strings
        return " ".join([strings[i] for i in ids])

    def forget(self) -> None:
        """Empty the caches; workers outlive their tasks."""
        self.chunks, self.words = {}, {}

    def split(self, text: str) -> list[str]:
        """Chunks between white space, special tokens apart."""
        if "<|" in text and self.special_pattern is not None:
            out = []
            for i, part in enumerate(self.special_pattern.split(text)):
                out += [part] if i % 2 else self.split_plain(part)
            return out
        return self.split_plain(text)

    def split_plain(self, text: str) -> list[str]:
        return [c for c in WHITE.split(text) if c] if ODD_SPACE.search(text) else text.split()

    def encode(self, texts: list[str]) -> Iterator[tuple[str, str]]:
        """Ids of each text as decimals joined by one space, and the decoded text."""
        split = [self.split(t) for t in texts]
        needed = set().union(*split)
        if len(self.chunks) + len(needed) > self.remembered:
            self.chunks = {}
        if missing := needed - self.chunks.keys():
            for token, i in self.special.items():
                if token in missing:
                    self.chunks[token] = (str(i), token)
                    missing.discard(token)
            self.learn(missing)
        lookup = self.chunks.__getitem__
        for chunks in split:
            ids, decoded = zip(*map(lookup, chunks), strict=True) if chunks else ((), ())
            yield " ".join(ids), " ".join(decoded)


def id_lists(texts: list[str]) -> pa.Array:
    """Lists of ids from their decimals joined by one space."""
    parts = [np.array(t.split(), np.int32) if t else np.zeros(0, np.int32) for t in texts]
    offsets = np.append(0, np.cumsum([len(p) for p in parts])).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts)))


@lru_cache(maxsize=2)
def load(path: str, decoding: bool = True, remembered: int = CACHE_CHUNKS) -> WordBpe:
    return WordBpe(path, decoding, remembered)


def encode(df: DataFrame, tokenizer_path: str, text_col: str = "text", ids_col: str = "token_ids", as_text: bool = False, decoded_col: str | None = None, keep: list[str] | None = None, remembered: int = CACHE_CHUNKS) -> DataFrame:
    """``df`` with the token ids of ``text_col``.

    ``ids_col`` is an array of ints, or with ``as_text`` their decimals joined by one space. ``decoded_col`` adds
    the decoded text of those ids; ``keep`` names the columns to pass through (all by default). The tokenizer file has to be at ``tokenizer_path`` on every executor.
    Each worker remembers ``remembered`` chunks while its task runs. An existing column of the same name is replaced.
    """
    added = [c for c in (ids_col, decoded_col) if c]
    kept = [c for c in (df.columns if keep is None else keep) if c not in added]
    fields = [df.schema[c] for c in kept] + [T.StructField(ids_col, T.StringType() if as_text else T.ArrayType(T.IntegerType(), False))]
    fields += [T.StructField(decoded_col, T.StringType())] if decoded_col else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(tokenizer_path, bool(decoded_col), remembered)
        for batch in batches:
            offsets, data = text_buffers(column_of(batch, text_col))
            for a, b in slices(offsets, 1 << 20):
                part = [t.decode("utf-8", "replace") for t in texts_of(offsets[a : b + 1] - offsets[a], data[offsets[a] : offsets[b]])]
                ids, decoded = zip(*model.encode(part), strict=True)
                ids = pa.array(ids, pa.string()) if as_text else id_lists(ids)
                columns = [column_of(batch, c).slice(a, b - a) for c in kept] + [ids]
                if decoded_col:
                    columns.append(pa.array(decoded, pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])
        model.forget()
        release()

    return df.select(*(df[c] for c in df.columns if c in kept or c == text_col)).mapInArrow(run, T.StructType(fields))


def decode(df: DataFrame, tokenizer_path: str, ids_col: str = "token_ids", decoded_col: str = "decoded") -> DataFrame:
    """``df`` with the decoded text of an array of token ids; a null array gives the empty string."""
    kept = [c for c in df.columns if c != decoded_col]
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(decoded_col, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(tokenizer_path)
        for batch in batches:
            decoded = [model.decode(x or []) for x in column_of(batch, ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(column_of(batch, c) for c in kept), pa.array(decoded, pa.string())], names=schema.names)

    return df.select(*kept).mapInArrow(run, schema)


def digests(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Per document: n_tokens and the digests of its ids and of its decoded text."""
    out = encode(docs.select("doc_id", "text"), tokenizer_path, as_text=True, ids_col="ids", decoded_col="decoded", keep=["doc_id"])
    ids = F.col("ids")
    spaces = F.length(ids) - F.length(F.translate(ids, " ", ""))
    return out.select(
        "doc_id",
        F.when(F.length(ids) == 0, 0).otherwise(spaces + 1).cast("long").alias("n_tokens"),
        F.sha2(ids.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
