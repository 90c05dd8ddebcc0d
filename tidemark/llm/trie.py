"""Prefix trie of conversations, rolled up by pointer jumping.

A node is a distinct sequence of first turns. Its key is a digest of that sequence, so equal prefixes meet by key and
the edges to parents come with the rows: no level of the trie is built after the other.

1. Turns become digests (SHA-256 of role and text) where they are read; texts are never shuffled. Equal turns are counted before that.
2. Positions come from ranges of (conversation, turn, digest): rows are numbered within a range, and what a conversation has in
   earlier ranges is added, so one conversation may fill many tasks.
3. A prefix's key is the exclusive or, over its turns, of two 64-bit hashes of a turn's digest and its depth. That can be summed
   up in stretches of ``STRETCH`` turns, so long conversations are spread here, too, and a node's key less its last turn is its parent's key.
4. Rows of members are grouped by key: smallest member, number of members, parent.
5. Pointer jumping: in round r a node of depth 2^r or more knows its ancestor 2^r turns up and the sums over the descendants less than
   2^r turns below. It adds its sums to that ancestor, and takes over the ancestor's ancestor. So a trie of depth d needs log2(d) rounds,
   each over fewer nodes, and all ancestors get their leaves and savings. Each round is checkpointed.

Joins on the key of a node have one row a key on one side; a node with very many children makes the other side skewed, which
adaptive execution splits. The root takes no part in such joins: it's the end of every path.

The digest of the members that end at a node is streamed: ids are packed into strings by ranges of (node, id), and a task feeds a
node's strings to SHA-256 one after the other, so no node's ids are in memory together.

Edge cases: null roles and texts are empty; a null turn comes first; turns with equal numbers are ordered by their digests, and repeated
rows are turns of their own; a null conversation id takes no part; a conversation without rebuilt turns is a member of the root alone; an empty
table gives an empty result, without a root; other columns are left out; texts are digested whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.arrow import column_of

#: Conversations share the first turns of the one whose id is the multiple of this below; fewer than ``SHARES`` of them.
HUNDRED, SHARES = 100, 6
#: Turns of a conversation that are summed up together.
STRETCH = 1024
#: Conversation ids in a packed string.
PACKED = 65_536
KEY = ["k1", "k2"]


def turn_digest(role: Column, text: Column) -> Column:
    """SHA-256 of a turn; the role's length keeps role and text apart."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    return F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))


def turns(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id, turn, digest, chars`` and how often a conversation has the row, ``n``."""
    rows = conversations.where(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), turn_digest(F.col(role), F.col(text)).alias("digest"),
        F.length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("chars"),
    )
    return rows.groupBy("conv_id", "turn", "digest", "chars").agg(F.count(F.lit(1)).alias("n"))


def numbered(rows: DataFrame) -> DataFrame:
    """``conv_id, pos, digest, chars``: turns with their place in the conversation, from 1."""
    spark = rows.sparkSession
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("digest")]
    ranges = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.repartitionByRange(ranges, *order).withColumn("part", F.spark_partition_id()).checkpoint()
    totals = dealt.groupBy("conv_id", "part").agg(F.sum("n").alias("n"))
    earlier = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    # a range continues at most one conversation of earlier ranges, so there are no more rows than ranges
    carried = totals.withColumn("before", earlier).where(F.col("before") > 0).select("conv_id", "part", "before")
    within = Window.partitionBy("conv_id", "part").orderBy(*order[1:])
    placed = dealt.withColumn("last", F.sum("n").over(within)).join(F.broadcast(carried), ["conv_id", "part"], "left")
    last = F.col("last") + F.coalesce("before", F.lit(0))
    return placed.select("conv_id", F.explode(F.sequence(last - F.col("n") + 1, last)).alias("pos"), "digest", "chars")


def word(number: int, digest: Column, depth: Column) -> Column:
    return F.xxhash64(F.lit(number), depth.cast("long"), digest)


def keys(digest: Column, depth: Column) -> list[Column]:
    """A turn's two hashes at its depth."""
    return [word(i, digest, depth).alias(k) for i, k in enumerate(KEY)]


def own_first(conv_id: Column) -> Column:
    """How many first turns a conversation takes from the one at the multiple of a hundred."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % SHARES).cast("int")


def members(placed: DataFrame) -> DataFrame:
    """A row for each rebuilt conversation and depth, root included: ``k1, k2, depth, p1, p2`` (the parent's key), ``conv_id, chars, ends`` (whether it's the conversation's last turn)."""
    start = (F.col("conv_id") - F.col("conv_id") % HUNDRED).alias("base")
    lengths = placed.groupBy("conv_id").agg(F.max("pos").alias("length"))
    firsts = placed.where((F.col("conv_id") % HUNDRED == 0) & (F.col("pos") < SHARES))
    bases = firsts.groupBy(F.col("conv_id").alias("base")).agg(F.array_sort(F.collect_list(F.struct("pos", *keys(F.col("digest"), F.col("pos")), "chars"))).alias("firsts"))
    # at most SHARES - 1 turns a base, and fewer than 2 * HUNDRED conversations share them
    convs = lengths.withColumn("h", own_first(F.col("conv_id"))).select("*", start).join(bases, "base", "left")
    borrowed = F.slice(F.coalesce("firsts", F.array().cast("array<struct<pos:bigint,k1:bigint,k2:bigint,chars:bigint>>")), 1, F.col("h"))
    both = lambda name: F.aggregate("borrowed", F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(x[name])).alias(f"base_{name}")
    convs = convs.withColumn("borrowed", borrowed).select("conv_id", "length", "h", "borrowed", F.size("borrowed").alias("m"), *map(both, KEY)).checkpoint()
    total = F.col("m") + F.greatest(F.col("length") - F.col("h"), F.lit(0))

    # the turns taken from the base: at most SHARES - 1 a conversation, as prefixes of its array
    first = convs.select("conv_id", total.alias("total"), F.posexplode("borrowed").alias("at", "turn"), "borrowed")
    upto = lambda name, n: F.aggregate(F.slice("borrowed", 1, n), F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(x[name]))
    depth = F.col("at") + 1
    head = first.select(*(upto(k, depth).alias(k) for k in KEY), depth.cast("long").alias("depth"), *(upto(k, F.col("at")).alias(p) for k, p in zip(KEY, ("p1", "p2"), strict=True)), "conv_id", F.col("turn.chars").alias("chars"), (depth == F.col("total")).alias("ends"))

    # its own turns, by stretches: sums within a stretch, and of the stretches before
    stretch = F.floor(F.col("pos") / STRETCH).alias("stretch")
    spread = convs.where(F.col("length") > F.col("h")).select("conv_id", total.alias("total"), "h", "m", "base_k1", "base_k2", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("length") / STRETCH))).alias("stretch"))
    own = placed.select("conv_id", "pos", "digest", "chars", stretch).join(spread, ["conv_id", "stretch"]).where(F.col("pos") > F.col("h"))
    own = own.withColumn("depth", (F.col("pos") - F.col("h") + F.col("m")).cast("long"))
    own = own.select("conv_id", "stretch", "depth", "chars", "base_k1", "base_k2", (F.col("depth") == F.col("total")).alias("ends"), *(c.alias(f"own_{k}") for c, k in zip(keys(F.col("digest"), F.col("depth")), KEY, strict=True)))
    within = Window.partitionBy("conv_id", "stretch").orderBy("depth")
    own = own.withColumns({f"sum_{k}": F.bit_xor(f"own_{k}").over(within) for k in KEY}).checkpoint()
    sums = own.groupBy("conv_id", "stretch").agg(*(F.bit_xor(f"own_{k}").alias(k) for k in KEY))
    before = Window.partitionBy("conv_id").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("conv_id", "stretch", *(F.bit_xor(k).over(before).alias(f"before_{k}") for k in KEY)).where(F.col("before_k1").isNotNull())
    whole = lambda k: F.col(f"base_{k}").bitwiseXOR(F.col(f"sum_{k}")).bitwiseXOR(F.coalesce(f"before_{k}", F.lit(0).cast("long")))
    tail = own.join(sums, ["conv_id", "stretch"], "left").select(*(whole(k).alias(k) for k in KEY), "depth", *(whole(k).bitwiseXOR(F.col(f"own_{k}")).alias(p) for k, p in zip(KEY, ("p1", "p2"), strict=True)), "conv_id", "chars", "ends")

    none = F.lit(None).cast("long")
    root = convs.select(*(F.lit(0).cast("long").alias(k) for k in KEY), F.lit(0).cast("long").alias("depth"), none.alias("p1"), none.alias("p2"), "conv_id", F.lit(0).cast("long").alias("chars"), (total == 0).alias("ends"))
    return root.unionByName(head).unionByName(tail)


def packed(ends: DataFrame) -> DataFrame:
    """``k1, k2, first_id, ids``: the ids of each node in ascending order, comma-joined in strings of at most ``PACKED`` ids."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, ids, out = None, [], []

        def close() -> None:
            if ids:
                out.append((*node, ids[0], ",".join(map(str, ids))))
                ids.clear()

        def send() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) if out else [()] * 4
            out.clear()
            return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())], names=[*KEY, "first_id", "ids"])

        for batch in batches:
            for k1, k2, i in zip(*(column_of(batch, c).to_pylist() for c in (*KEY, "conv_id")), strict=True):
                if node != (k1, k2) or len(ids) >= PACKED:
                    close()
                    node = k1, k2
                ids.append(i)
            yield send()
        close()
        yield send()

    ranges = max(1, int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = [*KEY, "conv_id"]
    return ends.select(*order).repartitionByRange(ranges, *order).sortWithinPartitions(*order).mapInArrow(pack, "k1 long, k2 long, first_id long, ids string")


def end_digests(ends: DataFrame) -> DataFrame:
    """``k1, k2, ends_sha256`` of every node at which conversations end."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, running = None, None
        for batch in batches:
            out = []
            for k1, k2, ids in zip(*(column_of(batch, c) for c in (*KEY, "ids")), strict=True):
                ids = ids.as_py().encode()
                if node == (k1.as_py(), k2.as_py()):
                    running.update(b"," + ids)
                else:
                    if node is not None:
                        out.append((*node, running.hexdigest()))
                    node, running = (k1.as_py(), k2.as_py()), hashlib.sha256(ids)
            yield rows(out)
        yield rows([] if node is None else [(*node, running.hexdigest())])

    def rows(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) if out else [()] * 3
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:2]), pa.array(columns[2], pa.string())], names=[*KEY, "ends_sha256"])

    parts = max(1, int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = packed(ends).repartition(parts, *KEY).sortWithinPartitions(*KEY, "first_id")
    return dealt.mapInArrow(digest, "k1 long, k2 long, ends_sha256 string")


def nodes(rows: DataFrame) -> DataFrame:
    """A row for each node: key, depth, parent's key, smallest member, members, own savings."""
    grouped = rows.groupBy(*KEY, "depth").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.min("chars").alias("chars"), F.min("p1").alias("p1"), F.min("p2").alias("p2"))
    return grouped.withColumn("saved", (F.col("n_convs") - 1) * F.col("chars")).drop("chars")


def rolled_up(tree: DataFrame) -> DataFrame:
    """``k1, k2, n_leaves, saved_tokens`` of each node from ``k1, k2, depth, p1, p2, leaves, saved``, its own, by pointer jumping."""
    sums = ["leaves", "saved"]
    up = lambda df: df.groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(*(F.sum(s).alias(s) for s in sums))
    deepest = tree.agg(F.max("depth")).first()[0] or 0
    gathered, active, jump = tree.select(*KEY, *sums), tree.where(F.col("depth") > 0), 1
    while jump <= deepest:
        given = up(active)  # to the ancestors this many turns up
        gathered = gathered.unionByName(given)
        if 2 * jump <= deepest:
            going = active.where(F.col("depth") >= 2 * jump)
            over = active.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("p1").alias("q1"), F.col("p2").alias("q2"))
            more = given.select(*KEY, *(F.col(s).alias(f"more_{s}") for s in sums))
            moved = going.join(more, KEY, "left").select(*KEY, "depth", "p1", "p2", *((F.col(s) + F.coalesce(f"more_{s}", F.lit(0))).alias(s) for s in sums))
            active = moved.join(over, ["p1", "p2"]).select(*KEY, "depth", F.col("q1").alias("p1"), F.col("q2").alias("p2"), *sums).checkpoint()
        jump *= 2
    return gathered.groupBy(*KEY).agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))


def trie(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The nodes of the trie of rebuilt conversations, each with its members, children, leaves and savings."""
    rows = members(numbered(turns(conversations, conv_id, turn, role, text))).checkpoint()
    tree = nodes(rows).checkpoint()
    children = tree.where(F.col("depth") > 0).groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count(F.lit(1)).alias("n_children"))
    tree = tree.join(children, KEY, "left").fillna(0, ["n_children"]).withColumn("leaves", (F.col("n_children") == 0).cast("long")).checkpoint()
    parents = tree.where(F.col("depth") > 0).select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    root = tree.where(F.col("depth") == 0).select(F.col("conv_id").alias("parent_conv_id"))  # one row, or none
    deep = tree.where(F.col("depth") > 1).join(parents, ["p1", "p2"])
    high = tree.where(F.col("depth") < 2).join(F.broadcast(root), F.col("depth") == 1, "left")
    found = deep.unionByName(high)
    found = found.select(*KEY, "conv_id", "depth", "parent_conv_id", "n_convs", "n_children")
    found = found.join(rolled_up(tree.select(*KEY, "depth", "p1", "p2", "leaves", "saved")), KEY)
    found = found.join(end_digests(rows.where("ends")), KEY, "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())))
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


#: The same in SQL: paths as lists of turns, and subtrees by all prefixes of each node's path. CRC-32 is written out bit by bit.
SQL = """
WITH turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos, {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS t
  FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT conv_id, list(t ORDER BY pos) AS ts FROM turns GROUP BY conv_id
), shared AS (
  SELECT conv_id, ts, conv_id - conv_id % 100 AS base,
    xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
      lambda a, b: list_reduce(list_prepend(xor(a, b), [CAST(0 AS BIGINT) FOR i IN range(8)]), lambda x, z: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))),
      CAST(4294967295 AS BIGINT)) % 6 AS h
  FROM own
), rebuilt AS (
  SELECT s.conv_id, list_concat(coalesce(list_slice(b.ts, 1, s.h), []), list_slice(s.ts, s.h + 1, len(s.ts))) AS ts
  FROM shared s LEFT JOIN own b ON b.conv_id = s.base
), member AS (
  SELECT conv_id, d AS depth, list_slice(ts, 1, d) AS path, d = len(ts) AS ends FROM rebuilt, unnest(range(0, len(ts) + 1)) AS r(d)
), node AS (
  SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
  FROM member GROUP BY path, depth
), kids AS (
  SELECT list_slice(path, 1, depth - 1) AS path, depth - 1 AS depth, count(*) AS n_children FROM node WHERE depth > 0 GROUP BY 1, 2
), full_node AS (
  SELECT n.*, coalesce(k.n_children, 0) AS n_children, CASE WHEN n.depth = 0 THEN 0 ELSE (n.n_convs - 1) * len(n.path[n.depth].text) END AS saved
  FROM node n LEFT JOIN kids k ON k.depth = n.depth AND k.path = n.path
), sums AS (
  SELECT list_slice(path, 1, d) AS path, d AS depth, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(saved) AS saved_tokens
  FROM full_node, unnest(range(0, depth + 1)) AS r(d) GROUP BY 1, 2
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM full_node n JOIN sums s ON s.depth = n.depth AND s.path = n.path LEFT JOIN node p ON p.depth = n.depth - 1 AND p.path = list_slice(n.path, 1, n.depth - 1)
"""
