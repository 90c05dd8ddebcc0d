"""Substring dedup of word windows with a count-min prefilter.

A window is ``WINDOW`` consecutive words of one document, and a word is removed if a window over it has the same
words as one that starts in a document with a smaller id. First the blocks' sketches are merged and estimate how
often each window occurs; the estimates are never too low. Then only windows estimated repeated are grouped
exactly, by the 128-bit XXH3 digest of their words joined by one space, and the least document of each group keeps its words.
The sketch's own hash of a window is put together from its words' hashes; that some texts make it collide only adds windows to the second pass.

A block sends a window once, with its least document, so a passage that a third of all documents share
is as many rows as there are blocks with it.

Edge cases: null or empty texts, and texts of fewer words than a window, keep all they have; a null id counts as
the greatest; documents with equal ids don't remove each other's words; white space is ASCII white space, and
words are compared byte for byte; texts of any length are taken whole.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import rounds
from tidemark.llm.rounds import Block, U

WINDOW = 13
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
BREAK = re.compile(rb"[\x20\x09-\x0D]")
#: Bytes of documents whose windows are hashed at once.
CHUNK = 1 << 18


class Windows:
    """Words and windows of a block: of each window the sketch's hash, the document's place and its first word's place."""

    def __init__(self, block: Block):
        self.words: list[int] = []
        first, owner, start = [], [], []
        group: list[int] = []
        size = base = 0
        for i, text in enumerate(block.texts):
            group.append(i)
            size += len(text) + 1
            if size >= CHUNK or i == len(block.texts) - 1:
                hashes, counts = hashed_words(b"\n".join(block.texts[j] for j in group) + b"\n", [len(block.texts[j]) for j in group])
                own = np.repeat(np.arange(len(group)), counts)
                n = len(own) - WINDOW + 1
                if n > 0:
                    at = np.flatnonzero(own[:n] == own[WINDOW - 1 :])
                    first.append(rounds.mix(rounds.range_hashes(hashes, at, at + WINDOW, 2), rounds.SEEDS[2]))
                    owner.append(own[at] + group[0])
                    start.append(at + base)
                base += len(own)
                self.words += counts.tolist()
                group, size = [], 0
        join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        self.hash = join(first, np.uint64)
        self.owner, self.start = join(owner, np.int64), join(start, np.int64)
        self.n_words = base

    def digests(self, block: Block, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Both halves of the 128-bit digests of the windows at ``at``, by their words joined by one space."""
        owner = self.owner[at]
        before = np.cumsum([0, *self.words])
        edges = np.append(np.flatnonzero(np.append(True, owner[1:] != owner[:-1])), len(at)).tolist() if len(at) else [0]
        digest = xxhash.xxh3_128_digest
        found = []
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            words = block.texts[owner[a]].split()  # of bytes: at ASCII white space
            joined = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
            starts = np.append(0, ends[:-1] + 1)
            first = self.start[at[a:b]] - before[owner[a]]
            found += [digest(joined[x:y]) for x, y in zip(starts[first].tolist(), ends[first + WINDOW - 1].tolist(), strict=True)]
        halves = np.frombuffer(b"".join(found), U).reshape(-1, 2)
        return halves[:, 0], halves[:, 1]


def hashed_words(data: bytes, lengths: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of texts that each end with a line end, and each text's number of words; long texts are hashed in pieces of whole words."""
    hashes, starts, at = [np.zeros(0, U)], [np.zeros(0, np.int64)], 0
    while at < len(data):
        space = BREAK.search(data, at + 2 * CHUNK)
        raw = np.frombuffer(data, np.uint8, (space.end() if space else len(data)) - at, at)
        is_space = SPACE[raw]
        first = np.flatnonzero(~is_space & np.append(True, is_space[:-1]))
        end = np.flatnonzero(~is_space[:-1] & is_space[1:]) + 1
        hashes.append(rounds.mix(rounds.range_hashes(rounds.byte_values(0)[raw], first, end, 0) ^ (end - first).astype(U), rounds.SEEDS[0]))
        starts.append(first + at)
        at += len(raw)
    bounds = np.cumsum(np.array([0, *lengths], np.int64) + np.array([0] + [1] * len(lengths), np.int64))
    return np.concatenate(hashes), np.diff(np.searchsorted(np.concatenate(starts), bounds))


class Candidates:
    """A block's distinct windows that are estimated repeated, in the order in which it sends them."""

    def __init__(self, block: Block, windows: Windows, answers: list, shards: int):
        self.at = np.flatnonzero(rounds.estimated_repeated(windows.hash, answers, shards))
        hashes, check = windows.digests(block, self.at)
        self.order = np.argsort(hashes, kind="stable")  # of equal windows the least document comes first
        h, c = hashes[self.order], check[self.order]
        if ((h[1:] == h[:-1]) & (c[1:] != c[:-1])).any():  # unlike windows with the same first hash
            self.order = np.lexsort((np.arange(len(h)), check, hashes))
            h, c = hashes[self.order], check[self.order]
        new = np.append(True, (h[1:] != h[:-1]) | (c[1:] != c[:-1])) if len(h) else np.zeros(0, bool)
        self.group = np.cumsum(new) - 1
        self.first = np.flatnonzero(new)
        self.hash, self.check = h[self.first], c[self.first]
        self.owner = windows.owner[self.at][self.order]
        shard = ((self.hash >> U(32)) * U(shards)) >> U(32)  # grows with the hash, so the shards are ranges
        edges = np.append(np.flatnonzero(np.append(True, shard[1:] != shard[:-1])), len(shard)) if len(shard) else np.zeros(0, int)
        self.ranges = [(int(shard[a]), int(a), int(b)) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def resolve(rows: pd.DataFrame) -> pd.DataFrame:
    """Which windows of each message start in a document of another block with a smaller id."""
    parts = [rounds.unpack(p, np.uint64, np.uint64, np.int64) for p in rows["payload"]]
    sizes = [len(p[0]) for p in parts]
    hashes, check, ids = (np.concatenate([p[i] for p in parts]) for i in range(3))
    order = np.lexsort((ids, check, hashes))
    h, c = hashes[order], check[order]
    new = np.append(True, (h[1:] != h[:-1]) | (c[1:] != c[:-1]))
    least = ids[order][np.flatnonzero(new)][np.cumsum(new) - 1]
    later = np.zeros(len(ids), bool)
    later[order] = ids[order] > least
    answers = [rounds.pack(np.packbits(x)) for x in np.split(later, np.cumsum(sizes)[:-1])]
    return pd.DataFrame({"block": rows["block"], "kind": rows["kind"], "shard": rows["shard"], "payload": answers})


def removed_words(block: Block, windows: Windows, answers: list, shards: int) -> np.ndarray:
    """Which of the block's words are removed."""
    found = Candidates(block, windows, answers, shards)
    elsewhere = np.zeros(len(found.hash), bool)
    by = {shard: payload for kind, shard, payload in answers if kind == rounds.ROWS}
    for shard, a, b in found.ranges:
        elsewhere[a:b] = np.unpackbits(rounds.unpack(by[shard], np.uint8)[0], count=b - a)
    least = block.ids[found.owner[found.first]] if len(found.first) else found.first
    gone = elsewhere[found.group] | (block.ids[found.owner] > least[found.group]) if len(found.group) else np.zeros(0, bool)
    starts = windows.start[found.at[found.order[gone]]]
    edges = np.bincount(starts, minlength=windows.n_words + 1)[: windows.n_words + 1] - np.bincount(starts + WINDOW, minlength=windows.n_words + 1)[: windows.n_words + 1]
    return np.cumsum(edges)[: windows.n_words] > 0


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document its id, n_words, n_removed and ``kept_text``: the kept words joined by one space."""
    blocks, total = rounds.in_blocks(docs, id_col, text_col)
    shards = rounds.shards_for(total // 6)

    def keys_of(block: Block) -> tuple[np.ndarray, None]:
        return Windows(block).hash, None

    def candidates(number: int, block: Block, answers: list) -> list:
        found = Candidates(block, Windows(block), answers, shards)
        ids = block.ids[found.owner[found.first]] if len(found.first) else np.zeros(0, np.int64)
        return [(number, rounds.ROWS, shard, rounds.pack(found.hash[a:b], found.check[a:b], ids[a:b])) for shard, a, b in found.ranges]

    def finish(block: Block, answers: list) -> pa.Table:
        windows = Windows(block)
        removed = removed_words(block, windows, answers, shards)
        kept_text, n_removed, at = [], [], 0
        for text, n in zip(block.texts, windows.words, strict=True):
            gone = removed[at : at + n]
            at += n
            words = text.split()
            n_removed.append(int(gone.sum()))
            if n_removed[-1]:
                words = [words[i] for i in np.flatnonzero(~gone).tolist()]
            kept_text.append(b" ".join(words))
        ids = pa.array(block.ids, mask=block.missing)
        return pa.table({"id": ids, "n_words": pa.array(windows.words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_text": pa.array(kept_text, pa.binary()).cast(pa.string())})

    found = rounds.run(blocks, keys_of, candidates, resolve, finish, "id long, n_words long, n_removed long, kept_text string", shards)
    return found.withColumnRenamed("id", id_col)


def digests(docs: DataFrame) -> DataFrame:
    """Per document: n_words, n_removed and the digest of the kept words joined by one space."""
    return dedup(docs.select("doc_id", "text")).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
