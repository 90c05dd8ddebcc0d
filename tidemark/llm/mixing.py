"""Mixing sources to target weights, in blocks of fixed length.

The words of a source's documents, in order of their ids, are packed into blocks of ``BLOCK_WORDS`` words.
The mix is made in output shards of ``SHARD_BLOCKS`` blocks. Each shard draws for itself, in a task and from a seed of its own, how many blocks it takes of each
source, from a multinomial distribution by the targets. Totals of such draws stray from the targets by the root of what is drawn, which small tables would show; so
a source that was drawn too often gives up slots, evenly over all its draws, and those drawn too seldom get them, in the same shards. What is moved is that root, and a shard's
counts keep the spread that draws with given totals have. A source's draws number its slots through the shards; a pseudorandom permutation of
the source's blocks, another one for every pass over them, says which block fills a slot, and blocks are joined by source and number.

Sources, in order of their code points with a null source last, have the weights 5, 2, 1, 5, 2, 1, ... A source's
target is its share of all words by weight, at most ``MOST`` times its own; what is above is shared among the
others by weight until none is above. A block fills at most ``MOST`` slots, so no document is repeated more often; slots drawn beyond that stay empty.

Numbers of blocks come from sums over ranges of documents that Spark sorts (source, id, and a hash of the text as a tie-break), never from one
source in one task. Sources, targets and draws are tables; a shard draws down a tree of groups of ``FAN`` sources, so no task holds all of them.
All draws are seeded: the same table and seed give the same mix, and another seed other counts.

Edge cases: a null or empty text has size 0 and nothing is taken of it, and its source has target 0 if it has no words; a null id sorts first;
rows with equal ids are documents of their own; an empty table gives an empty mix; texts of any length count whole; other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.arrow import column_of, release

WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3
BLOCK_WORDS = 64
#: Blocks in an output shard, and slots that a task fills.
SHARD_BLOCKS = 4096
SLOTS = 200_000
#: Sources, or groups of sources, among which a task draws at once.
FAN = 4096
SEED = 20_240_501
WORD = regex.compile(r"[^\x20\x09-\x0D]+")


def word_count(text: Column) -> Column:
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))), F.lit(0)).cast("long")


def with_targets(sources: DataFrame, most: float = MOST) -> DataFrame:
    """``sources`` (words, weight) with the ``target``: words to take of each, all words together, none above ``most`` times its words.

    A source is at its limit if its words for each unit of weight are under some level; the level rises until those under it stay the same.
    """
    ratio = F.col("words") / F.col("weight")
    level, at_limit = -1.0, -1
    while True:
        full = ratio < level
        total, taken, share, n = sources.agg(F.sum("words"), F.sum(F.when(full, F.col("words")).otherwise(0)), F.sum(F.when(~full, F.col("weight")).otherwise(0.0)), F.count(F.when(full, 1))).first()
        rest = (total or 0) - most * (taken or 0)
        if n == at_limit or not share:
            return sources.withColumn("target", F.when(full, most * F.col("words")).otherwise(rest * F.col("weight") / F.lit(share or 1.0)).cast("double"))
        level, at_limit = rest / share / most, n


def drawn_of(count: int, weights: np.ndarray, seed: tuple[int, ...]) -> np.ndarray:
    """How many of ``count`` draws fall on each."""
    return np.random.default_rng(seed).multinomial(count, weights / weights.sum())


def shard_counts(sources: DataFrame, seed: int = SEED, shard_blocks: int = SHARD_BLOCKS) -> DataFrame:
    """``shard``, ``number`` and ``count``: the blocks that each output shard takes of each of ``sources`` (number, slots), where any."""
    drawn = multinomial_counts(sources, seed, shard_blocks).checkpoint()
    return at_targets(sources, drawn, seed).checkpoint()


def multinomial_counts(sources: DataFrame, seed: int, shard_blocks: int) -> DataFrame:
    """``shard``, ``number`` and ``count`` as each shard draws them for itself, down a tree of groups of sources."""
    spark = sources.sparkSession
    total, n = sources.agg(F.round(F.sum("slots")).cast("long"), F.count(F.lit(1))).first()
    total = total or 0
    shards = -(-total // shard_blocks)
    tree = []
    level = sources.where("slots > 0").select(F.col("number").alias("child"), F.col("slots").alias("weight"))
    while True:
        groups = level.groupBy(F.floor(F.col("child") / FAN).alias("node")).agg(F.sort_array(F.collect_list(F.struct("child", "weight"))).alias("children"), F.sum("weight").alias("weight"))
        tree.append(groups.select("node", "children"))
        if n <= FAN:
            break
        level, n = groups.select(F.col("node").alias("child"), "weight"), -(-n // FAN)

    def draw(depth: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                shard, node, count = [], [], []
                for s, n, c, children in zip(*(batch.column(x).to_pylist() for x in ("shard", "node", "count", "children")), strict=True):
                    found = drawn_of(c, np.array([x["weight"] for x in children]), (seed, depth, s, n))
                    at = np.flatnonzero(found)
                    shard += [s] * len(at)
                    node += [children[i]["child"] for i in at.tolist()]
                    count += found[at].tolist()
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (shard, node, count)], names=["shard", "node", "count"])

        return run

    size = F.least(F.lit(shard_blocks), total - F.col("id") * shard_blocks)
    # all start at the root, whose number 0 isn't written as a constant, so that the join stays one by a key
    rows = spark.range(shards).select(F.col("id").alias("shard"), F.shiftright("id", 62).alias("node"), size.cast("long").alias("count"))
    for depth, groups in enumerate(reversed(tree)):
        groups = F.broadcast(groups) if depth == 0 else groups  # the root is one row of FAN children at most
        rows = rows.join(groups, "node").select("shard", "node", "count", "children").mapInArrow(draw(depth), "shard long, node long, count long")
    return rows.select("shard", F.col("node").alias("number"), "count")


def with_first(drawn: DataFrame) -> DataFrame:
    """``drawn`` (shard, number, count) with ``first``, what earlier shards have of the same source; by ranges of shards, as a source may be in all of them."""
    some = drawn.withColumn("range", F.floor(F.col("shard") / 4096))
    of_ranges = some.groupBy("number", "range").agg(F.sum("count").alias("n"))
    before = lambda w, x: F.coalesce(F.sum(x).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    of_ranges = of_ranges.select("number", "range", before(Window.partitionBy("number").orderBy("range"), "n").alias("offset"))
    first = F.col("offset") + before(Window.partitionBy("number", "range").orderBy("shard"), "count")
    return some.join(of_ranges, ["number", "range"]).select("shard", "number", "count", first.alias("first"))


def at_targets(sources: DataFrame, drawn: DataFrame, seed: int) -> DataFrame:
    """``drawn`` with the total of each source at its ``slots`` (a fraction is rounded up or down by chance); the totals of shards stay.

    Slots given up and slots to fill are paired in a pseudorandom order. As fractions are rounded for each source alone, a few are without partner and stay as drawn.
    """
    chance = F.pmod(F.xxhash64(F.lit(seed), "number", F.lit("round")), F.lit(1 << 30)) / (1 << 30)
    totals = drawn.groupBy("number").agg(F.sum("count").alias("drawn"))
    off = sources.select("number", F.floor(F.col("slots") + chance).alias("wanted")).join(totals, "number", "left").withColumn("drawn", F.coalesce("drawn", F.lit(0)))
    off = off.select("number", "drawn", (F.col("drawn") - F.col("wanted")).alias("excess"), F.pmod(F.xxhash64(F.lit(seed), "number", F.lit("give")), F.greatest("drawn", F.lit(1))).alias("shift")).where("excess <> 0").checkpoint()
    # of a source's draws 0 to drawn - 1, the excess is spread evenly; so many of the count draws from first on
    given = with_first(drawn).join(off.where("excess > 0"), "number").withColumn("n", F.expr("((first + count) * excess + shift) div drawn - (first * excess + shift) div drawn")).where("n > 0")
    given = given.select("shard", F.col("number").alias("giver"), F.explode(F.sequence(F.lit(1), "n")).alias("i"))
    wanting = off.where("excess < 0").select(F.col("number").alias("taker"), F.explode(F.sequence(F.lit(1), -F.col("excess"))).alias("i"))
    mixed_up = lambda df, *by: in_order(df, F.xxhash64(F.lit(seed), *by), *map(F.col, by))
    moved = mixed_up(given, "shard", "giver", "i").drop("i").join(mixed_up(wanting, "taker", "i").drop("i"), "number")
    changes = moved.select("shard", F.explode(F.array(*(F.struct(F.col(c).alias("number"), F.lit(n).cast("long").alias("count")) for c, n in (("giver", -1), ("taker", 1))))).alias("x")).select("shard", "x.*")
    return drawn.unionByName(changes).groupBy("shard", "number").agg(F.sum("count").alias("count")).where("count > 0")


def permuted(index: Column, size: Column, constants: Column, rounds: int = 4) -> Column:
    """The place of ``index`` in a pseudorandom permutation of 0 to ``size`` - 1 that ``constants(size, key)`` describes.

    Each round maps i to (i * a + b) mod size, with a multiplier that has no common factor with the size, and then
    turns the order of a part of the range; both are one-to-one.
    """
    out = index
    for r in range(rounds):
        a, b, cut = (constants[3 * r + x] for x in range(3))
        out = F.pmod(out * a + b, size)
        out = F.when(out < cut, cut - 1 - out).otherwise(out)
    return out


def constants(size: Column, key: Column, rounds: int = 4) -> Column:
    """The numbers of a permutation, three a round."""
    out = []
    for r in range(rounds):
        a, b = (F.pmod(F.xxhash64(key, F.lit(r), F.lit(x)), F.lit(1 << 30)) for x in "ab")
        out += [coprime(a, size), b, F.pmod(F.xxhash64(key, F.lit(r), F.lit("c")), size) + 1]
    return F.array(*out)


def coprime(a: Column, size: Column) -> Column:
    """Of eight primes, the first from place ``a`` on that does not divide ``size`` (their product exceeds any size)."""
    primes = (1_000_003, 1_000_033, 1_000_037, 1_000_039, 1_000_081, 1_000_099, 1_000_117, 1_000_121)
    first = F.pmod(a, F.lit(len(primes))).cast("int")
    chosen = F.filter(F.transform(F.sequence(F.lit(0), F.lit(len(primes) - 1)), lambda i: F.element_at(F.array(*map(F.lit, primes)), (F.pmod(i + first, F.lit(len(primes))) + 1).cast("int"))), lambda p: size % p != 0)
    return F.element_at(chosen, 1).cast("long")


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """``id``, ``source``, ``tie`` and ``size`` of every document."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), F.xxhash64(text).alias("tie"), word_count(F.col(text_col)).alias("size"))


def placed(sizes: DataFrame) -> DataFrame:
    """``sizes`` with ``start``, the words of the same source before each document, by sums over sorted ranges."""
    ranges = sizes.repartitionByRange("source", "id", "tie").sortWithinPartitions("source", "id", "tie", "size").withColumn("part", F.spark_partition_id()).checkpoint()
    inside = Window.partitionBy("part", "source").orderBy("id", "tie", "size").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    of_parts = ranges.groupBy("part", "source").agg(F.sum("size").alias("words"))
    offsets = of_parts.select("part", "source", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("offset"))
    same = (F.col("r.part") == F.col("o.part")) & F.col("r.source").eqNullSafe(F.col("o.source"))
    local = ranges.withColumn("ahead", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return local.alias("r").join(offsets.alias("o"), same).select("r.id", "r.source", "r.tie", "r.size", (F.col("offset") + F.col("ahead")).alias("start"))


def in_order(rows: DataFrame, *by: Column) -> DataFrame:
    """``rows`` with ``number``, their places in an order, from 0 on; ranges of rows are numbered apart."""
    ranges = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("part", F.spark_partition_id()).checkpoint()
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # of one row a partition
    offsets = ranges.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(before, F.lit(0)).alias("offset"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(*by)) - 1
    return ranges.withColumn("inside", inside).join(offsets, "part").withColumn("number", F.col("offset") + F.col("inside")).drop("part", "inside", "offset")


def weighed(documents: DataFrame, block_words: int) -> DataFrame:
    """Per source its ``number``, ``source_size``, ``target``, ``blocks`` and the ``slots`` that meet the target."""
    found = documents.groupBy("source").agg(F.sum("size").alias("words"))
    found = in_order(found, F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("number") % len(WEIGHTS) + 1).cast("int"))
    found = with_targets(found.withColumn("weight", weight).checkpoint())
    blocks = F.ceil(F.col("words") / block_words)
    slots = F.when(F.col("words") > 0, F.col("target") * blocks / F.col("words")).otherwise(0.0)
    return found.select("number", "source", F.col("words").alias("source_size"), "target", blocks.cast("long").alias("blocks"), slots.alias("slots"))


def slots(sources: DataFrame, drawn: DataFrame, seed: int = SEED) -> DataFrame:
    """``shard``, ``number`` and ``block`` of each slot of the mix."""
    each = with_first(drawn).join(sources.select("number", "blocks"), "number")
    end = F.least(F.col("first") + F.col("count"), MOST * F.col("blocks"))
    each = each.withColumn("end", end).where("first < end")
    turns = F.sequence(F.floor(F.col("first") / F.col("blocks")), F.floor((F.col("end") - 1) / F.col("blocks")))
    each = each.select("shard", "number", "blocks", "first", "end", F.explode(turns).alias("turn")).checkpoint()
    total = each.agg(F.sum(F.least("end", (F.col("turn") + 1) * F.col("blocks")) - F.greatest("first", F.col("turn") * F.col("blocks")))).first()[0] or 0
    low, high = F.greatest("first", F.col("turn") * F.col("blocks")), F.least("end", (F.col("turn") + 1) * F.col("blocks"))
    passes = each.repartition(max(8, -(-total // SLOTS)), "shard", "number", "turn").select("shard", "number", "blocks", (low % F.col("blocks")).alias("low"), (high - low).alias("n"), constants(F.col("blocks"), F.xxhash64(F.lit(seed), "number", "turn")).alias("constants"))
    one = passes.select("shard", "number", "blocks", "constants", F.explode(F.sequence(F.col("low"), F.col("low") + F.col("n") - 1)).alias("index"))
    return one.select("shard", "number", permuted(F.col("index"), F.col("blocks"), F.col("constants")).alias("block"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block_words: int = BLOCK_WORDS, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """The documents with their sources' figures and places, and the pieces of them that the mix takes.

    Documents: ``id, source, tie, size, start, number, source_size, target``. Pieces: ``id, tie, number, start, from_word, n_words``
    (words of the document), ``times``, how often the mix takes them, and ``shards``, the output shard of each time.
    """
    documents = placed(sized(docs, id_col, text_col, source_col).checkpoint()).checkpoint()
    sources = weighed(documents, block_words).checkpoint()
    chosen = slots(sources, shard_counts(sources, seed), seed)
    times = chosen.groupBy("number", "block").agg(F.sort_array(F.collect_list("shard")).alias("shards")).withColumn("times", F.size("shards"))  # MOST at most
    known = documents.alias("d").join(sources.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")))
    known = known.select("d.id", "d.source", "d.tie", "d.size", "d.start", "s.number", "s.source_size", "s.target")
    first, last = (F.floor(x / block_words) for x in (F.col("start"), F.col("start") + F.col("size") - 1))
    parts = known.where("size > 0").select("id", "tie", "start", "size", "number", F.explode(F.sequence(first, last)).alias("block"))
    begin = F.greatest(F.col("start"), F.col("block") * block_words)
    end = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block_words)
    pieces = parts.join(times, ["number", "block"]).select("id", "tie", "number", "start", (begin - F.col("start")).alias("from_word"), (end - begin).alias("n_words"), "times", "shards")
    return known, pieces


def shares(docs: DataFrame) -> DataFrame:
    """Per document: size, source_size, target, ``taken``, the words that the mix takes of it, repeats counted, and ``first_shard``, the first output shard with any."""
    known, pieces = mixed(docs.select("doc_id", "text", "source"))
    taken = pieces.groupBy("number", "start").agg(F.sum(F.col("n_words") * F.col("times")).alias("taken"), F.min(F.element_at("shards", 1)).alias("first_shard"))
    columns = [F.col("id").alias("doc_id"), "size", "source_size", "target"]
    some = known.where("size > 0").join(taken, ["number", "start"], "left").select(*columns, F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_shard")
    return some.unionByName(known.where("size = 0").select(*columns, F.lit(0).cast("long").alias("taken"), F.lit(None).cast("long").alias("first_shard")))


def cut(text: str, pieces: list[tuple[int, int, int]]) -> str:
    """The pieces of a text (first word, words, times), in order and as often as they are taken, with their own white space."""
    words = [(m.start(), m.end()) for m in WORD.finditer(text)]
    out = []
    for turn in range(max(t for _, _, t in pieces)):
        last = None
        for first, n, times in pieces:
            if times <= turn:
                continue
            a, b = words[first][0], words[first + n - 1][1]
            if last == first:  # goes on from the piece before: keep the white space between
                out[-1] = out[-1] + text[words[first - 1][1] : b]
            else:
                out.append(text[a:b])
            last = first + n
    return "\n".join(out)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` as the mix has them: documents that it takes nothing of go, the others have the words taken, repeats included.

    A document that is taken whole and once keeps its text as it is. ``length_col``, if there is one, gets the new number of code points.
    """
    _, pieces = mixed(docs, id_col, text_col, source_col)
    key = F.coalesce(F.col("id").cast("long"), F.lit(-(1 << 63)))
    by_doc = pieces.groupBy(key.alias("mix_id"), "tie", "number", "start").agg(F.sort_array(F.collect_list(F.struct("from_word", "n_words", "times"))).alias("pieces"))
    # rows with equal ids and texts have equal sizes, so it doesn't matter which of them gets which pieces
    copies = by_doc.groupBy("mix_id", F.col("tie").alias("mix_tie")).agg(F.sort_array(F.collect_list(F.struct("number", "start", "pieces"))).alias("mix_copies"))
    keyed = docs.select(F.struct(*docs.columns).alias("row"), F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("mix_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("mix_tie"))
    nth = F.row_number().over(Window.partitionBy("mix_id", "mix_tie").orderBy(F.col("row")[source_col].asc_nulls_last()))
    joined = keyed.join(copies, ["mix_id", "mix_tie"]).withColumn("nth", nth).where(F.col("nth") <= F.size("mix_copies"))
    joined = joined.select("row", F.element_at("mix_copies", F.col("nth"))["pieces"].alias("pieces"))

    names = docs.columns
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            rows = column_of(batch, "row").flatten()
            for text, pieces in zip(rows[at].to_pylist(), column_of(batch, "pieces").to_pylist(), strict=True):
                found = [(p["from_word"], p["n_words"], p["times"]) for p in pieces]
                whole = all(t == 1 for _, _, t in found) and sum(n for _, n, _ in found) == len(WORD.findall(text))
                texts.append(text if whole else cut(text, found))
            rows[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(rows, names=names)
        release()

    out = joined.mapInArrow(run, T.StructType([docs.schema[c] for c in names]))
    return out.withColumn(length_col, F.length(text_col).cast(docs.schema[length_col].dataType)) if length_col in names else out
