"""SimHash near-duplicates with a Gray-order hierarchical index.

A fingerprint has a bit set if more than half of the XXH64 hashes (seed 42) of a text's word shingles have it;
fingerprints that differ in at most ``MAX_BITS`` bits are linked, and a component is all that links reach.

Equal fingerprints are one row from the start. Of four quarters of a fingerprint at least one is free of
differences between two linked ones, so each distinct fingerprint goes into four buckets, one a quarter, and
Spark shuffles the buckets; a bucket of more than ``BUCKET`` fingerprints is split by the quarters of its other
bits, which loses no link either. Within its buckets a task sorts fingerprints by Gray rank, which puts those with the same leading
bits together: each run of equal leading bytes is a node that holds the bits its fingerprints share. The search goes
down the nodes level by level, adds up the differences and drops a node with all below it once they pass the limit. What
remains is merged at once into local components, so a task sends one row a fingerprint, not its pairs. Components
over all buckets come from minimum labels with pointer jumping on the linked fingerprints.

``components`` takes 64-bit fingerprints at their word. ``near_components`` finds texts whose sets of word shingles have a Jaccard similarity of 0.8 or
more: for those, 64 bits differ in about ten places and no pigeonhole is left, so a set gets ``WIDE`` fingerprints of 64 bits, from as many mixes
of its hashes, and goes into four buckets of each, by 12 bits of its quarters. The same index, with limits on the bits of the bucket's fingerprint and of all of them, gives candidate
components, without a pair being sent. In each of them the sets themselves are then compared, in pairs of blocks of ``MEMBERS`` sets, so a link holds exactly and none between candidates is lost.
A pair of similarity 0.8 shares a bucket with probability 1 - (1 - 0.848 ** 12) ** 32 = 0.992, and one of 0.9 with 0.9999; a component may still be joined
through other members. The bits of few shingles vary more, so sets of up to ``SHORT`` shingles are linked by digests of the subsets that they share, exactly. Its members are compared block by block, so the work of one candidate component grows with the square of its distinct sets.

Edge cases: a null or empty text, or one of white space alone, has fingerprint zero and is linked like any other;
texts of one or two words are one shingle; a null id never names a component that has another; rows with equal ids each
get a row; texts of any length count whole; other columns of the input, of any names, are left out of ``components`` and kept by ``keep_first``. For ``near_components`` a
text without a word has the empty set, and empty sets are equal; texts of up to five words are one shingle; a row without an id stays only if its component has none with one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.arrow import column_of, release, slices, text_buffers, texts_of
from tidemark.llm.shared import shared_path

SHINGLE = 3
MAX_BITS = 3
BUCKET = 50_000
#: Pairs of a fingerprint and a node that the search holds at once.
FRONTIER = 2_000_000
#: Times that a too large bucket is split again.
SPLITS = 3
#: Near duplicates: words of a shingle, the least similarity as a fraction, fingerprints of a set, and bits in which candidates may differ in the
#: bucket's fingerprint (of 64) and in all (of 512; sets of similarity 0.8 differ in 78, with a deviation of 8).
NEAR_SHINGLE = 5
NEAR = (4, 5)
WIDE = 8
NEAR_BITS, WIDE_BITS = 18, 106
#: Fingerprints in a node of the index for such limits.
NODE = 64
#: Bits of each quarter of 16 that name a bucket; fewer find more links and make larger buckets.
BAND = 12
#: Sets of a candidate component that are compared at once with as many others; rows of buckets that a task takes together.
MEMBERS = 1000
TOGETHER = 100_000
#: Shingles of a small set: the bits of few shingles vary too much for the index, so links between such sets are found by their subsets.
SHORT = 9
#: Rows of 16 bytes that are broadcast at most.
SMALL = 500_000
U = np.uint64
MIXES = np.random.default_rng(42).integers(0, 1 << 64, WIDE, np.uint64)


def shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    """The hashes of a text's shingles, in order."""
    words = text.lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], 42) for a, b in zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)], np.uint64)


def majority(rows: np.ndarray) -> np.ndarray:
    """The bits that more than half of the rows of 64-bit numbers have, by column."""
    ones = np.zeros(rows.shape[1] * 64, np.int64)
    for at in range(0, len(rows), 255):
        part = np.ascontiguousarray(rows[at : at + 255]).view(np.uint8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(rows), bitorder="little").view(np.uint64)


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    return int(majority(shingle_hashes(text, shingle)[:, None])[0])


def wide_fingerprints(found: np.ndarray) -> np.ndarray:
    """``WIDE`` fingerprints of a set of hashes, each from another mix of them."""
    x = (found[:, None] ^ MIXES) * U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    return majority(x ^ x >> U(29))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``id`` and ``bits``, the fingerprint as a signed long, of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = text_buffers(column_of(batch, "text"))
            for a, b in slices(offsets):
                found = [fingerprint(t, shingle) for t in texts_of(offsets[a : b + 1] - offsets[a], data[offsets[a] : offsets[b]])]
                bits = pa.array(np.array(found, np.uint64).view(np.int64))
                yield pa.RecordBatch.from_arrays([column_of(batch, "id").slice(a, b - a), bits], names=["id", "bits"])
        release()

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, bits long")


def bucket_masks() -> list[int]:
    """Bits that a bucket's fingerprints share: four quarters, and below each the quarters of its other bits, and so on."""
    masks, level = [], [0]
    for _ in range(SPLITS):
        below = []
        for mask in level:
            free = [i for i in range(64) if not mask >> i & 1]
            for q in range(4):
                below.append(mask | sum(1 << i for i in free[len(free) * q // 4 : len(free) * (q + 1) // 4]))
        masks += below
        level = below
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def buckets(distinct: DataFrame) -> DataFrame:
    """``mask``, ``shared`` and ``bits``: every distinct fingerprint in each of its buckets."""
    masks = F.array(*(F.lit(m).cast("long") for m in bucket_masks()))
    keyed = lambda df, ids: df.select("bits", F.explode(ids).alias("mask")).withColumn("shared", F.element_at(masks, F.col("mask") + 1).bitwiseAND(F.col("bits")))
    level = keyed(distinct, F.array(*map(F.lit, range(4))))
    kept = []
    for _ in range(SPLITS - 1):
        large = level.groupBy("mask", "shared").count().where(F.col("count") > BUCKET).select("mask", "shared", F.lit(True).alias("large"))
        marked = level.join(large, ["mask", "shared"], "left")
        kept.append(marked.where(F.col("large").isNull()).select("mask", "shared", "bits"))
        first_below = 4 * F.col("mask") + 4
        level = keyed(marked.where("large").select("bits", "mask"), F.transform(F.array(*map(F.lit, range(4))), lambda q: q + first_below))
    kept.append(level.select("mask", "shared", "bits"))
    out = kept[0]
    for part in kept[1:]:
        out = out.unionByName(part)
    return out


def gray_rank(bits: np.ndarray) -> np.ndarray:
    """The place of each bit pattern in Gray order; equal leading bits give equal leading bits of the rank."""
    rank = bits.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> U(shift)
    return rank


def roots_of(parent: np.ndarray) -> np.ndarray:
    while True:
        above = parent[parent]
        if (above == parent).all():
            return parent
        parent = above


def unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Components after linking every ``a`` with its ``b``; a component is named by its least place."""
    while True:
        ra, rb = parent[a], parent[b]
        apart = ra != rb
        if not apart.any():
            return parent
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
        parent = roots_of(parent)


def linked(bits: np.ndarray, bucket: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """For fingerprints (uint64) with their buckets' numbers: the place of one in the same local component."""
    n = len(bits)
    order = np.lexsort((gray_rank(bits), bucket))
    bits, bucket = bits[order], bucket[order]
    # nodes of each level: where they start; level 0 is the bucket, level 8 the fingerprint itself
    edge = np.append(True, bucket[1:] != bucket[:-1])
    starts = [np.flatnonzero(edge)]
    for level in range(1, 9):
        top = bits >> U(64 - 8 * level)
        edge = edge | np.append(True, top[1:] != top[:-1])
        starts.append(np.flatnonzero(edge))
    children = [np.append(np.searchsorted(starts[i + 1], starts[i]), len(starts[i + 1])) for i in range(8)]
    parent = np.arange(n)
    node_of = np.searchsorted(starts[0], np.arange(n), side="right") - 1
    sizes = np.diff(np.append(starts[0], n))[node_of]
    asked = np.flatnonzero(sizes > 1)
    weight = np.cumsum(np.minimum(sizes[asked], 256))
    at = 0
    while at < len(asked):
        end = max(at + 1, int(np.searchsorted(weight, (weight[at - 1] if at else 0) + FRONTIER // 8)))
        query = asked[at:end]
        node, apart = node_of[query], np.zeros(len(query), np.uint8)
        at = end
        parts = [(query, node, apart, 0)]
        while parts:
            query, node, apart, level = parts.pop()
            fan = children[level][node + 1] - children[level][node]
            if len(query) > 1 and fan.sum() > FRONTIER:
                half = len(query) // 2
                parts += [(query[half:], node[half:], apart[half:], level), (query[:half], node[:half], apart[:half], level)]
                continue
            below = np.repeat(children[level][node] - np.append(0, np.cumsum(fan)[:-1]), fan) + np.arange(int(fan.sum()))
            query, apart = np.repeat(query, fan), np.repeat(apart, fan)
            byte = lambda x, lv=level: (x >> U(56 - 8 * lv)) & U(255)
            apart = apart + np.bitwise_count(byte(bits[starts[level + 1][below]]) ^ byte(bits[query]))
            near = (apart <= limit) & (starts[level + 1][below] <= query)  # each pair once: nodes start at or before it
            query, below, apart = query[near], below[near], apart[near]
            if level < 7:
                if len(query):
                    parts.append((query, below, apart, level + 1))
            else:
                parent = unite(parent, query, starts[8][below])
    out = np.empty(n, np.int64)
    out[order] = order[roots_of(parent)]
    return out


def linked_within(bits: np.ndarray, bucket: np.ndarray, limit: int, check: Callable[[np.ndarray, np.ndarray], np.ndarray], side: np.ndarray | None = None) -> np.ndarray:
    """``linked`` for a wide limit, where single fingerprints differ too little from each other for a tree of bytes to prune.

    Nodes are runs of ``NODE`` fingerprints in Gray order with the bits that all of theirs share: two nodes that differ in more than ``limit`` shared bits are
    dropped as a whole, and the others' fingerprints are compared, all at once. Buckets of no more than a node are compared by their distance in the order,
    many buckets at once. ``check`` says which of the pairs (places) within the limit are linked. In buckets with a ``side`` of 1, these are compared with those
    of side 0, and neither among themselves.
    """
    n = len(bits)
    side = np.zeros(n, np.int8) if side is None else side
    order = np.lexsort((gray_rank(bits), side, bucket))
    bits, bucket, side = bits[order], bucket[order], side[order]
    parent = np.arange(n)
    start = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    size = np.diff(np.append(start, n))
    after = np.repeat(start + size, size) - np.arange(n)  # rows of the bucket from here on
    firsts = size - (np.add.reduceat(side, start, dtype=np.int64) if n else size)  # rows of side 0
    whole = np.repeat(firsts == size, size)

    def link(a: np.ndarray, b: np.ndarray) -> None:
        nonlocal parent
        apart = parent[a] != parent[b]
        a, b = a[apart], b[apart]
        passed = check(order[a], order[b])
        parent = unite(parent, a[passed], b[passed])

    here = np.flatnonzero(np.repeat(size <= NODE, size))
    for step in range(1, NODE):
        here = here[after[here] > step]
        if not len(here):
            break
        met = here[whole[here] | (side[here] != side[here + step])]
        near = met[np.bitwise_count(bits[met] ^ bits[met + step]) <= limit]
        link(near, near + step)
    for first, rows, split in zip(*(x[size > NODE].tolist() for x in (start, size, firsts)), strict=True):
        mine = bits[first : first + rows]
        at = np.append(np.arange(0, split, NODE), np.arange(split, rows, NODE))
        own = -(-split // NODE)
        every, some = np.bitwise_and.reduceat(mine, at), np.bitwise_or.reduceat(mine, at)
        shared = ~(every ^ some)
        for k, a in enumerate(at[:own].tolist()):
            since = k if split == rows else own
            apart = np.bitwise_count((every[k] ^ every[since:]) & shared[k] & shared[since:])
            met = since + np.flatnonzero(apart <= limit)
            others = (at[met][:, None] + np.arange(NODE)).ravel()
            others = others[others < rows]
            i, j = np.nonzero(np.bitwise_count(mine[a : min(a + NODE, split), None] ^ mine[others]) <= limit)
            keep = a + i < others[j]
            link(first + a + i[keep], first + others[j[keep]])
    out = np.empty(n, np.int64)
    out[order] = order[roots_of(parent)]
    return out


def whole_groups(batches: Iterator[pa.RecordBatch], by: list[str], size: int = TOGETHER) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups of equal values in ``by``, by which the batches are sorted, and the groups' numbers; some ``size`` rows, or one larger group, at a time."""

    def numbers(table: pa.Table) -> np.ndarray:
        new = np.zeros(table.num_rows, bool)
        for name in by:
            x = column_of(table, name).to_numpy(zero_copy_only=False)
            new[1:] |= x[1:] != x[:-1]
        return np.cumsum(new)

    held: list[pa.RecordBatch] = []
    rows = wanted = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= max(size, wanted):
            table = pa.Table.from_batches(held)
            group = numbers(table)
            last = int(np.searchsorted(group, group[-1]))
            if last:
                yield table.slice(0, last), group[:last]
            held = table.slice(last).combine_chunks().to_batches()
            rows = table.num_rows - last
            wanted = 2 * rows  # a large group isn't looked through again for each batch
    if rows:
        table = pa.Table.from_batches(held)
        yield table, numbers(table)


def local_links(bucketed: DataFrame) -> DataFrame:
    """``a`` and ``b``: each fingerprint with the one that names its local component, where they differ."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bucket in whole_groups(batches, ["mask", "shared"]):
            bits = column_of(table, "bits").to_numpy().view(np.uint64)
            to = linked(bits, bucket)
            a = np.flatnonzero(to != np.arange(len(bits)))
            yield pa.RecordBatch.from_arrays([pa.array(bits[a].view(np.int64)), pa.array(bits[to[a]].view(np.int64))], names=["a", "b"])

    return bucketed.repartition("mask", "shared").sortWithinPartitions("mask", "shared").mapInArrow(run, "a long, b long").distinct()


def connected(links: DataFrame) -> DataFrame:
    """``node`` and ``label`` for the nodes of ``links`` (a, b): the least node of each connected component.

    In each round every node points to its least neighbour, if that is less, and one step on from there; edges are then between what their ends point
    to, once each, so that they become fewer with every round. The least node of a component always points to itself.
    """
    edges = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a != b").distinct().checkpoint()
    names = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).distinct().withColumn("label", F.col("node"))
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        point = both.groupBy(F.col("a").alias("at")).agg(F.min("b").alias("to")).select("at", F.least("at", "to").alias("to")).checkpoint()
        onward = point.select(F.col("at").alias("to"), F.col("to").alias("on"))
        point = point.join(onward, "to").select("at", "on").checkpoint()
        ends = lambda name: point.select(F.col("at").alias(name), F.col("on").alias(f"{name}_on"))
        moved = edges.join(ends("a"), "a").join(ends("b"), "b").select(F.least("a_on", "b_on").alias("a"), F.greatest("a_on", "b_on").alias("b"))
        edges = moved.where("a != b").distinct().checkpoint()
        names = names.join(point.withColumnRenamed("at", "label"), "label", "left").select("node", F.coalesce("on", "label").alias("label")).checkpoint()
    return names


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: its id, ``fingerprint`` in hexadecimal and ``component_id``, the least id that links reach."""
    prints = fingerprints(docs, id_col, text_col).checkpoint()
    distinct = prints.groupBy("bits").agg(F.min("id").alias("least"))
    labels = connected(local_links(buckets(distinct.select("bits"))))
    named = distinct.join(labels.withColumnRenamed("node", "bits"), "bits", "left").withColumn("label", F.coalesce("label", "bits"))
    least = named.groupBy("label").agg(F.min("least").alias("component_id"))
    of_bits = named.select("bits", "label").join(least, "label").select("bits", "component_id")
    out = prints.join(of_bits, "bits")
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")


def subsets(found: np.ndarray, near: tuple[int, int]) -> list[bytes]:
    """Digests of a small set and of its subsets that a similar set may share, each with its number of shingles on top."""
    missing = len(found) * (near[1] - near[0]) // near[1]  # a similar set lacks no more of them
    kept = (np.delete(found, list(gone)) for n in range(missing + 1) for gone in combinations(range(len(found)), n) if n < len(found))
    return [bytes([len(k)]) + xxhash.xxh3_128_digest(k.tobytes()) for k in kept]


def short_links(rows: DataFrame, near: tuple[int, int]) -> DataFrame:
    """``a`` and ``b``: links between small sets (``key, size, parts``), exactly.

    Two similar sets share a subset of i shingles that has (x + y) * i >= x * (a + b), and two that share such a subset are similar. Of all sets with one subset
    the smallest is linked to the most others, so a link to it joins all that this subset links; no pairs are made.
    """
    some = rows.where(F.col("parts").isNotNull()).select("key", "size", "parts").dropDuplicates(["key"])
    each = some.select("key", "size", F.explode("parts").alias("part"))
    least = each.groupBy("part").agg(F.min(F.struct("size", "key")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("part", "first")
    shared = F.conv(F.hex(F.substring("part", 1, 1)), 16, 10).cast("long")
    alike = (near[0] + near[1]) * shared >= near[0] * (F.col("size") + F.col("first.size"))
    return each.join(least, "part").where(alike & (F.col("key") != F.col("first.key"))).select(F.col("key").alias("a"), F.col("first.key").alias("b")).distinct()


def keyed_sets(docs: DataFrame, id_col: str, text_col: str, shingle: int, near: tuple[int, int]) -> DataFrame:
    """``row``, the columns of docs, with ``id``, the ``key`` of its set of shingles, the set's ``size``, its ``wide`` fingerprints and, of a small set, its ``parts``."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    schema = T.StructType([rows.schema["row"], T.StructField("id", T.LongType()), T.StructField("key", T.BinaryType()), T.StructField("size", T.LongType()), T.StructField("wide", T.BinaryType()), T.StructField("parts", T.ArrayType(T.BinaryType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = text_buffers(column_of(batch, "text"))
            for a, b in slices(offsets):
                found = [np.unique(shingle_hashes(t, shingle)) for t in texts_of(offsets[a : b + 1] - offsets[a], data[offsets[a] : offsets[b]])]
                keys = pa.array([xxhash.xxh3_128_digest(f.tobytes()) for f in found], pa.binary())
                wide = pa.array([wide_fingerprints(f).tobytes() for f in found], pa.binary())
                parts = pa.array([subsets(f, near) if 0 < len(f) <= SHORT else None for f in found], pa.list_(pa.binary()))
                yield pa.RecordBatch.from_arrays([*(column_of(batch, c).slice(a, b - a) for c in ("row", "id")), keys, pa.array(map(len, found), pa.int64()), wide, parts], names=schema.names)
        release()

    return rows.mapInArrow(run, schema)


def wide_buckets(sets: DataFrame) -> DataFrame:
    """Every set (``node, size, wide``) in the buckets of all quarters of its fingerprints: ``bucket`` (with the quarter's number on top), ``low``, ``high`` and ``block``.

    A bucket of over ``BUCKET`` sets is dealt into blocks of about as many, and each of its sets goes into all pairs (``low``, ``high``) of its ``block`` with a
    block, so that any two sets of the bucket meet in one of them; other buckets are one block.
    """
    number = 4 * WIDE
    bits = lambda band: F.conv(F.hex(F.substring("wide", 2 * band + 1, 2)), 16, 10).cast("long")
    quarter = lambda band: bits(band).bitwiseAND((1 << BAND) - 1) + band.cast("long") * 65536
    level = sets.select("*", F.explode(F.sequence(F.lit(0), F.lit(number - 1))).alias("band")).select("node", "size", "wide", quarter(F.col("band")).alias("bucket"))
    none = F.lit(0).cast("int")
    whole = level.withColumns({"low": none, "high": none, "block": none})
    if sets.count() <= BUCKET:  # then no bucket has more
        return whole
    large = level.groupBy("bucket").count().where(F.col("count") > BUCKET).select("bucket", F.ceil(F.col("count") / BUCKET).cast("int").alias("blocks")).checkpoint()
    if large.isEmpty():
        return whole
    # at most as many rows as there are buckets, 4 * WIDE << BAND
    placed = level.join(F.broadcast(large), "bucket", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    pair = lambda other: F.struct(F.least("block", other).alias("low"), F.greatest("block", other).alias("high"))
    met = placed.select("node", "size", "wide", "bucket", "block", F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), pair)).alias("pair"))
    return met.select("node", "size", "wide", "bucket", "pair.low", "pair.high", "block")


def candidates(bucketed: DataFrame, near: tuple[int, int]) -> DataFrame:
    """``a`` and ``b``: each set's node with the one that names its candidate component in a bucket, where they differ."""
    by = ["bucket", "low", "high"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, group in whole_groups(batches, by):
            wide = np.frombuffer(b"".join(column_of(table, "wide").to_pylist()), U).reshape(-1, WIDE)
            size = column_of(table, "size").to_numpy()

            def check(i: np.ndarray, j: np.ndarray, wide=wide, size=size) -> np.ndarray:
                near_size = near[1] * np.minimum(size[i], size[j]) >= near[0] * np.maximum(size[i], size[j])
                near_size[near_size] = np.bitwise_count(wide[i[near_size]] ^ wide[j[near_size]]).sum(axis=1, dtype=np.int64) <= WIDE_BITS
                return near_size

            bits = wide[np.arange(len(wide)), column_of(table, "bucket").to_numpy() // 65536 // 4]
            block, low = (column_of(table, c).to_numpy() for c in ("block", "low"))
            to = linked_within(bits, group, NEAR_BITS, check, (block != low).astype(np.int8))
            a = np.flatnonzero(to != np.arange(len(bits)))
            node = column_of(table, "node")
            yield pa.RecordBatch.from_arrays([node.take(pa.array(a)), node.take(pa.array(to[a]))], names=["a", "b"])
        release()

    return bucketed.repartition(*by).sortWithinPartitions(*by).mapInArrow(run, "a long, b long").distinct()


def similar_pairs(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, near: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a set in ``left`` and one in ``right`` (places) whose similarity reaches ``near``: i / (a + b - i) >= x / y means (x + y) * i >= x * (a + b)."""
    size = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    _, code, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count > 1
    place = (np.cumsum(shared) - 1)[code]
    owner = np.repeat(np.arange(len(sets)), size)[shared[code]]
    place = place[shared[code]]
    both = np.zeros((len(left), len(right)), np.int64)
    for start in range(0, int(shared.sum()), 1 << 16):  # a part of the shared shingles at a time, a bit each
        here = (place >= start) & (place < start + (1 << 16))
        words = -(-min(1 << 16, int(shared.sum()) - start) // 64)
        bits = np.zeros((len(sets), words), np.uint64)
        at = place[here] - start
        np.bitwise_or.at(bits, (owner[here], at // 64), U(1) << (at % 64).astype(np.uint64))
        others = bits[right]
        for n, i in enumerate(left.tolist()):
            both[n] += np.bitwise_count(bits[i] & others).sum(axis=1, dtype=np.int64)
    total = size[left][:, None] + size[right][None, :]
    i, j = np.nonzero((near[0] + near[1]) * both >= near[0] * total)
    return left[i], right[j]


def exact_links(members: DataFrame, near: tuple[int, int]) -> DataFrame:
    """``a`` and ``b``: links between sets (label, key, hashes) of the same candidate component, as trees of what is linked in each pair of blocks."""
    blocks = members.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).cast("int").alias("blocks"))
    placed = members.join(blocks, "label").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    pair = lambda other: F.struct(F.least("block", other).alias("low"), F.greatest("block", other).alias("high"))
    met = placed.select("label", "key", "hashes", "block", F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), pair)).alias("pair"))
    met = met.select("label", "pair.low", "pair.high", "block", "key", "hashes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, group in whole_groups(batches, ["label", "low", "high"], 2 * MEMBERS):
            key = column_of(table, "key")
            block, low, high = (column_of(table, c).to_numpy() for c in ("block", "low", "high"))
            hashes = [np.frombuffer(h, U) for h in column_of(table, "hashes").to_pylist()]
            parent = np.arange(len(hashes))
            edges = np.append(np.flatnonzero(np.append(True, group[1:] != group[:-1])), len(group)).tolist()
            for x, y in zip(edges[:-1], edges[1:], strict=True):
                rows = np.arange(y - x)
                of_low = rows[block[x:y] == low[x]] if low[x] != high[x] else rows
                of_high = rows[block[x:y] == high[x]]
                i, j = similar_pairs(hashes[x:y], of_low, of_high, near)
                parent = unite(parent, x + i, x + j)
            a = np.flatnonzero(parent != np.arange(len(parent)))
            yield pa.RecordBatch.from_arrays([key.take(pa.array(a)), key.take(pa.array(parent[a]))], names=["a", "b"])
        release()

    by = ["label", "low", "high"]
    return met.repartition(*by).sortWithinPartitions(*by).mapInArrow(run, "a binary, b binary").distinct()


def with_hashes(rows: DataFrame, shingle: int) -> DataFrame:
    """``label``, ``key`` and ``hashes``, the set itself as sorted 64-bit numbers, of rows with a ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = text_buffers(column_of(batch, "text"))
            for a, b in slices(offsets):
                found = [np.unique(shingle_hashes(t, shingle)).tobytes() for t in texts_of(offsets[a : b + 1] - offsets[a], data[offsets[a] : offsets[b]])]
                yield pa.RecordBatch.from_arrays([*(column_of(batch, c).slice(a, b - a) for c in ("label", "key")), pa.array(found, pa.binary())], names=["label", "key", "hashes"])
        release()

    return rows.select("label", "key", "text").mapInArrow(run, "label long, key binary, hashes binary")


def where_in(rows: DataFrame, some: DataFrame, by: str, how: str) -> DataFrame:
    """``rows`` joined with rows of few columns; these are broadcast if they are counted to be at most ``SMALL``, else both sides are shuffled."""
    return rows.join(F.broadcast(some) if some.count() <= SMALL else some, by, how)


def labelled(docs: DataFrame, id_col: str, text_col: str, shingle: int, near: tuple[int, int]) -> tuple[DataFrame, DataFrame]:
    """The rows, written with a ``place`` of their own, and of each ``place, id, key`` of its set, and ``label``, the key that names its component."""
    spark = docs.sparkSession
    path = shared_path(spark, "simhash-sets")
    keyed_sets(docs, id_col, text_col, shingle, near).withColumn("place", F.monotonically_increasing_id()).write.parquet(path)
    rows = spark.read.parquet(path)  # places stay as they were written
    node = F.xxhash64("key")  # sets of equal nodes, which are hardly any, are candidates as one
    sets = rows.where("size > 0").groupBy(node.alias("node")).agg(F.first("size").alias("size"), F.first("wide").alias("wide")).checkpoint()
    found = connected(candidates(wide_buckets(sets), near))
    members = where_in(rows.select("key", F.col("row")[text_col].alias("text"), node.alias("node")), found, "node", "inner").dropDuplicates(["key"])
    links = connected(exact_links(with_hashes(members, shingle).checkpoint(), near).unionByName(short_links(rows, near)))
    labels = rows.select("place", "id", "key").join(links.withColumnRenamed("node", "key"), "key", "left").withColumn("label", F.coalesce("label", "key"))
    return rows, labels


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = NEAR_SHINGLE, near: tuple[int, int] = NEAR) -> DataFrame:
    """``id``, ``key`` of the set, and ``label``, the key that names its component, of every row."""
    return labelled(docs, id_col, text_col, shingle, near)[1].select("id", "key", "label")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = NEAR_SHINGLE, near: tuple[int, int] = NEAR) -> DataFrame:
    """``docs`` with one row of each component of near duplicates: the one with the least id."""
    rows, labels = labelled(docs, id_col, text_col, shingle, near)
    rank = F.struct(F.col("id").isNull().alias("missing"), "id", "key", "place")
    labels = labels.select("label", "place", rank.alias("rank")).checkpoint()
    first = labels.groupBy("label").agg(F.min("rank").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("label", "first.place")
    gone = labels.join(first.withColumnRenamed("place", "first"), "label").where("place != first").select("place").checkpoint()
    return where_in(rows.select("row", "place"), gone, "place", "left_anti").select("row.*")
