"""Rounds of compact messages between blocks of documents and shards of a hashed key space.

Operators that look for passages shared by documents first have to know which of their many keys (of word
windows, of byte passages) occur more than once. Documents are dealt into blocks of a few MB; each block sends
each shard one message with its sorted counters, difference-coded and compressed; each shard merges the
messages and answers each block with one bit a counter. Messages and answers are rows that Spark shuffles, so
nothing passes through the driver, memory is bounded by a block or a shard, and both numbers grow with the
input. All rounds of an operator are one Spark plan that uses the shuffle of the documents again.

The sketch is a count-min sketch: ``ROWS`` rows of counters that saturate at two. A key is estimated repeated if
its counter is in every row, so no repeated key is lost, and few others are taken along.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.arrow import column_of, release, text_buffers

#: Bytes of text in a block; the keys that a shard is meant for; counters of a row of the sketch in a shard.
BLOCK_BYTES = 3 << 20
SHARD_KEYS = 2 << 20
COUNTER_BITS = 24
ROWS = 2
#: A key with this many items, unlike ones of each block counted, is hot: operators whose keys gather unlike items deal these out by something finer. What is
#: finer is much more to send, and a shard takes a key's items at once, so this is as many as fit a task well (16,384 stretches of bytes are 2 MB, to be sorted in 60).
HOT_ITEMS = 1 << 14
#: Size of the table in which a block looks up which of its counters are repeated.
LOOKUP_BITS = 22
LAST = np.iinfo(np.int64).max
MESSAGE = "block long, kind int, shard int, payload binary"

U = np.uint64
SEEDS = [U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9)]


def mix(x: np.ndarray, seed: U) -> np.ndarray:
    """A well-spread 64-bit hash of 64-bit numbers."""
    x = (x ^ seed) * U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(29)
    return x


@lru_cache(maxsize=4)
def byte_values(which: int) -> np.ndarray:
    return np.random.default_rng(1000 + which).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)


BASES = [(0x9DDFEA08EB382D69, pow(0x9DDFEA08EB382D69, -1, 1 << 64)), (0xB492B66FBE98F273, pow(0xB492B66FBE98F273, -1, 1 << 64)), (0x9AE16A3B2F90404F, pow(0x9AE16A3B2F90404F, -1, 1 << 64))]


@lru_cache(maxsize=8)
def _powers(which: int, inverse: int, size: int) -> np.ndarray:
    out = np.full(size, U(BASES[which][inverse]))
    out[0] = 1
    return np.multiply.accumulate(out)


def powers(which: int, inverse: int, size: int) -> np.ndarray:
    """Powers of a base (or of its inverse modulo 2 to the power 64), from the zeroth on."""
    return _powers(which, inverse, 1 << max(16, int(size).bit_length()))[:size]


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int) -> np.ndarray:
    """A polynomial hash of ``values[start:end]`` for each pair, independent of where it lies."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(which, 0, len(values)), out=total[1:])
    return (total[ends] - total[starts]) * powers(which, 1, len(values) + 1)[starts]


@lru_cache(maxsize=1)
def codec() -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes: each byte place of the numbers apart, compressed."""
    parts = []
    for a in arrays:
        a = np.ascontiguousarray(a)
        planes = a.view(np.uint8).reshape(len(a), a.itemsize).T
        parts.append(np.array([len(a)], np.int64).tobytes() + np.ascontiguousarray(planes).tobytes())
    return codec()[0].compress(b"".join(parts))


def unpack(data: bytes, *types) -> list[np.ndarray]:
    raw, at, out = codec()[1].decompress(data), 0, []
    for t in map(np.dtype, types):
        n = int(np.frombuffer(raw, np.int64, 1, at)[0])
        planes = np.frombuffer(raw, np.uint8, n * t.itemsize, at + 8).reshape(t.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).view(t).reshape(n))
        at += 8 + n * t.itemsize
    return out


def in_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carried: tuple[str, ...] = ()) -> tuple[DataFrame, int]:
    """``block``, ``id`` and ``text`` of each document (null texts as empty), and all texts' bytes.

    Rows are dealt by their content and their place in the input, so that repeated rows don't fill one block. Columns in ``carried`` go
    with their documents as ``carried_0``, ``carried_1`` and so on.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    plain = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), *(F.col(c).alias(f"carried_{i}") for i, c in enumerate(carried)))
    total = plain.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_BYTES))
    return plain.select(F.pmod(F.xxhash64("id", "text", F.monotonically_increasing_id()), F.lit(blocks)).alias("block"), *plain.columns), total


def shards_for(keys: int) -> int:
    return max(1, -(-int(keys) // SHARD_KEYS))


class Block:
    """The documents of a block in an order that doesn't depend on how the shuffle delivered them."""

    def __init__(self, table: pa.Table):
        offsets, data = text_buffers(column_of(table, "text"))
        column = column_of(table, "id")
        missing = column.is_null().to_numpy(zero_copy_only=False)
        ids = column.fill_null(LAST).to_numpy(zero_copy_only=False).astype(np.int64)
        raw = data.tobytes()
        texts = [raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        order = sorted(range(len(ids)), key=lambda i: (ids[i], missing[i], texts[i]))
        self.table, self.order = table, order
        #: Ids with null as the greatest, and which are null.
        self.ids, self.missing = ids[order], missing[order]
        self.texts = [texts[i] for i in order]

    def carried(self, number: int) -> list[pa.Array]:
        """The carried columns in the order of the documents."""
        return [column_of(self.table, f"carried_{i}").take(pa.array(self.order, pa.int64())) for i in range(number)]


def counters(keys: np.ndarray, row: int, shards: int) -> np.ndarray:
    """The key's shard and its counter there, in one number."""
    h = mix(keys, SEEDS[row])
    shard = ((h >> U(32)) * U(shards)) >> U(32)
    return shard << U(COUNTER_BITS) | h & U((1 << COUNTER_BITS) - 1)


def distinct(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct codes and which of them are there more than once."""
    codes = np.sort(codes)
    if not len(codes):
        return codes, np.zeros(0, bool)
    first = np.append(True, codes[1:] != codes[:-1])
    at = np.flatnonzero(first)
    return codes[at], np.diff(np.append(at, len(codes))) > 1


def by_shard(codes: np.ndarray, bits: int) -> Iterator[tuple[int, int, int]]:
    """The shards of sorted codes and their ranges."""
    if len(codes):
        shard = (codes >> U(bits)).astype(np.int64)
        at = np.append(np.flatnonzero(np.append(True, shard[1:] != shard[:-1])), len(codes))
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            yield int(shard[a]), a, b


def messages(rows: list[tuple[int, int, int, bytes]]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [(), (), (), ()]
    return pa.table({"block": pa.array(columns[0], pa.int64()), "kind": pa.array(columns[1], pa.int32()), "shard": pa.array(columns[2], pa.int32()), "payload": pa.array(columns[3], pa.binary())})


def sketch(block: int, keys: np.ndarray, shards: int, items: np.ndarray | None = None) -> list[tuple[int, int, int, bytes]]:
    """A block's counters for every row and shard of the sketch; ``items`` has each key as often as the block has unlike items of it (else one each)."""
    out = []
    for row in range(ROWS):
        codes, twice = distinct(counters(keys, row, shards))
        many = np.ones(len(codes), np.uint16)
        if items is not None:
            known, number = np.unique(counters(items, row, shards), return_counts=True)
            many[np.searchsorted(codes, known)] = np.minimum(number, 65535)
        low = (codes & U((1 << COUNTER_BITS) - 1)).astype(np.uint32)
        for shard, a, b in by_shard(codes, COUNTER_BITS):
            out.append((block, row, shard, pack(np.diff(low[a:b], prepend=np.uint32(0)), np.packbits(twice[a:b]), many[a:b][twice[a:b]] if items is not None else many[:0])))
    return out


def merge_sketches(rows: pd.DataFrame, most: int = HOT_ITEMS) -> pd.DataFrame:
    """Merge a shard's part of the sketch; the answers say which of a block's counters reached two, and which have ``most`` items or more."""
    items, repeated = np.zeros(1 << COUNTER_BITS, np.uint16), np.zeros(1 << COUNTER_BITS, bool)
    sent = []
    for payload in rows["payload"]:
        steps, bits, many = unpack(payload, np.uint32, np.uint8, np.uint16)
        at = np.cumsum(steps, dtype=np.uint32)
        before, twice = items[at], np.unpackbits(bits, count=len(at)).astype(bool)
        repeated[at[(before > 0) | twice]] = True
        more = np.ones(len(at), np.uint32)
        if len(many):
            more[twice] = many
        items[at] = np.minimum(before + more, 65535)
        sent.append(at)
    answers = [pack(np.packbits(repeated[at]), np.packbits(items[at] >= most)) for at in sent]
    return pd.DataFrame({"block": rows["block"], "kind": rows["kind"], "shard": rows["shard"], "payload": answers})


def answered(keys: np.ndarray, answers: list[tuple[int, int, bytes]], shards: int, row: int, which: int) -> tuple[np.ndarray, np.ndarray]:
    """The counters in a row of all of a block's keys, and those counters of which the answers (kind, shard, payload) to this block say so."""
    codes = counters(keys, row, shards)
    known, _ = distinct(codes)
    bits = np.zeros(len(known), bool)
    found = {shard: payload for kind, shard, payload in answers if kind == row}
    for shard, a, b in by_shard(known, COUNTER_BITS):
        bits[a:b] = np.unpackbits(unpack(found[shard], np.uint8, np.uint8)[which], count=b - a)
    return codes, known[bits]


def estimated_repeated(keys: np.ndarray, answers: list[tuple[int, int, bytes]], shards: int) -> np.ndarray:
    """Which keys the merged sketch estimates at two or more."""
    flags = np.ones(len(keys), bool)
    fold = lambda c: (c ^ c >> U(LOOKUP_BITS)) & U((1 << LOOKUP_BITS) - 1)
    for row in range(ROWS):
        codes, repeated = answered(keys, answers, shards, row, 0)
        lookup = np.zeros(1 << LOOKUP_BITS, bool)
        lookup[fold(repeated)] = True
        flags &= lookup[fold(codes)]
    return flags


def hot(keys: np.ndarray, answers: list[tuple[int, int, bytes]], shards: int) -> np.ndarray:
    """Which keys' counters have many items in every row; the same for a key in whatever block it is."""
    flags = np.ones(len(keys), bool)
    for row in range(ROWS):
        codes, found = answered(keys, answers, shards, row, 1)
        flags &= np.isin(codes, found) if len(found) else False
    return flags


def answers_in(table: pa.Table) -> list[tuple[int, int, bytes]]:
    kinds, shards, payloads = (column_of(table, c).to_pylist() for c in ("kind", "shard", "payload"))
    return list(zip(kinds, shards, payloads, strict=True))


def run(
    blocks: DataFrame,
    keys_of: Callable[[Block], tuple[np.ndarray, np.ndarray | None]],
    candidates: Callable[[int, Block, list], list],
    resolve: Callable[[pd.DataFrame], pd.DataFrame],
    finish: Callable[[Block, list], pa.Table],
    schema: str,
    shards: int,
    most: int = HOT_ITEMS,
) -> DataFrame:
    """The rounds: sketch, merge, send candidates, resolve them exactly, finish each document.

    ``keys_of`` gives a block's keys and, where hot ones are asked for, the items of ``sketch``; ``most`` items make a key hot; ``candidates`` gives messages of kind ``ROWS`` to the exact round; ``resolve``
    answers a shard's messages; ``finish`` makes the result rows of a block from all answers.
    """

    def first(key, table):
        keys, items = keys_of(Block(table))
        return messages(sketch(key[0].as_py(), keys, shards, items))

    def merged(rows):
        return merge_sketches(rows, most)

    def second(key, table, answers):
        return messages(candidates(key[0].as_py(), Block(table), answers_in(answers)) if table.num_rows else [])

    def third(key, table, answers):
        release()  # of the block before
        return finish(Block(table), answers_in(answers))

    sketched = blocks.groupBy("block").applyInArrow(first, MESSAGE)
    estimates = sketched.groupBy("kind", "shard").applyInPandas(merged, MESSAGE)
    sent = blocks.groupBy("block").cogroup(estimates.groupBy("block")).applyInArrow(second, MESSAGE)
    resolved = sent.groupBy("shard").applyInPandas(resolve, MESSAGE)
    answers = estimates.unionByName(resolved)
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(third, schema)
