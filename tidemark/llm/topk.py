"""Exact top-k inner products in three phases with a uniform threshold.

A vector's components lie in ``LISTS`` lists of neighbouring components, and its score with a query is the sum of its entries, its scores
in the lists.

Phase 1 gathers, in every partition of the vectors, the ``k`` highest entries of each list for each query, and sends the ``k`` best
scores of the vectors that they belong to. The k-th best score of those is the cutoff; it is at most the true k-th score, so it is safe.
Phase 2 broadcasts the cutoffs: a vector with all entries below the ``LISTS``-th part of the cutoff can't reach it, and neither can one whose entries
above that part, with that part in place of the others, add up to less. Phase 3 resolves the exact scores of what remains, and the best ``k`` of each partition are merged.

Queries are taken in chunks of at most ``QUERIES`` rows and ``CHUNK_BYTES`` bytes, which are what is broadcast, and the vectors are read where
they lie: nothing of them is shuffled but the best of each partition. Equal vectors need no special care: ties go to the smaller id.

Scores are exact whatever their size. Entries of integers whose products stay below 2 ** 53 are exact as doubles; for larger ones
the bounds are widened by their rounding, and what remains is resolved in integers of any length, by which rows are ranked, too.

Edge cases: vectors that are null, or hold null or non-finite components, take no part, as queries and as candidates; lengths are those of
the longest vector, shorter ones count as zero there; a score beyond a long is shown as the nearest long; a null id takes no part; rows with equal ids count
each (a query never meets rows with its own id), and query rows with equal ids are one query, of the least of their vectors; an empty table gives an
empty result; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.arrow import column_of, int_column, release

LISTS = 4
#: Queries, and bytes of their components, that are broadcast at once.
QUERIES = 16_384
CHUNK_BYTES = 64 << 20
#: Pairs of a query and a vector, or components of vectors, that a task holds at once.
CELLS = 2_000_000
EXACT = float(1 << 53)
LONG = (1 << 63) - 1


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors of a list column as rows of doubles, filled up with zeros."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), width))
    out[np.repeat(np.arange(len(column)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def exponent(largest: float) -> int:
    return int(np.frexp(largest)[1]) if largest else 0


def floored(x: np.ndarray, scale: int, shift: int) -> np.ndarray:
    """``floor(scale * x)`` times two to the power ``-shift``; doubles from 2 ** 52 on are whole, so they aren't rounded."""
    large = np.abs(x) >= 1 << 52
    small = np.floor(np.where(large, 0.0, x) * scale)
    return np.where(large, np.ldexp(x, -shift) * scale, np.ldexp(small, -shift))


def whole(x: np.ndarray, scale: int) -> list[int]:
    """``floor(scale * x)`` as integers of any length."""
    return [int(a) * scale if abs(a) >= 1 << 52 else int(np.floor(a * scale)) for a in x.tolist()]


@dataclass
class Task:
    """What a task knows of a chunk of queries: ids in order, components, their scaled integers and, from phase 2 on, their cutoffs."""

    ids: np.ndarray
    raw: np.ndarray
    scale: int
    shift: int
    bits: int
    k: int
    cutoff: np.ndarray | None = None

    @property
    def exact(self) -> bool:
        return self.bits <= 53

    def prepared(self) -> Task:
        self.whole = floored(self.raw, self.scale, self.shift)
        self.length = np.sqrt((self.whole * self.whole).sum(axis=1))
        return self

    def parts(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]]:
        """Ids, components, entries in each list (queries by vectors) and rounding of a bounded number of vectors at a time."""
        width = self.raw.shape[1]
        rows = max(1, CELLS // max(len(self.ids), width))
        for batch in batches:
            ids, column = int_column(batch, "id"), column_of(batch, "v")
            for at in range(0, len(ids), rows):
                raw = matrix(column.slice(at, rows), width)
                v = floored(raw, self.scale, self.shift)
                slack = np.zeros((len(self.ids), 1))
                if not self.exact:
                    slack[:, 0] = self.length * np.sqrt((v * v).sum(axis=1)).max() * width * 2.0**-48
                yield ids[at : at + rows], raw, [self.whole[:, a:b] @ v[:, a:b].T for a, b in cuts(width)], slack

    def own(self, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a query and a row with its id."""
        at = np.minimum(np.searchsorted(self.ids, others), len(self.ids) - 1)
        j = np.flatnonzero(self.ids[at] == others)
        return at[j], j


def cuts(width: int) -> list[tuple[int, int]]:
    edges = [width * i // LISTS for i in range(LISTS + 1)]
    return list(zip(edges[:-1], edges[1:], strict=True))


def highest(x: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest of each row, in any order."""
    n = x.shape[1]
    return np.argpartition(x, n - k, axis=1)[:, n - k :] if n > k else np.broadcast_to(np.arange(n), x.shape)


def sufficient(entries: list[np.ndarray], cutoff: np.ndarray, slack: np.ndarray) -> np.ndarray:
    """Which pairs may reach their query's cutoff: those with an entry at or above its uniform threshold and a high enough upper bound."""
    cutoff = cutoff[:, None] - slack
    threshold = cutoff / len(entries)
    sent = [e >= threshold for e in entries]
    upper = sum(np.where(m, e, threshold) for m, e in zip(sent, entries, strict=True))
    return np.logical_or.reduce(sent) & ((upper >= cutoff - np.abs(cutoff) * 1e-12) | np.isneginf(cutoff))


def gather(task: Task, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Phase 1: the best ``k`` scores, for each query, of the vectors with the highest entries of each list."""
    task.prepared()
    best = np.full((len(task.ids), task.k), -np.inf)
    for others, _, entries, slack in task.parts(batches):
        i, j = task.own(others)
        for e in entries:
            e[i, j] = -np.inf
        places = np.sort(np.concatenate([highest(e, task.k) for e in entries], axis=1), axis=1)
        scores = sum(np.take_along_axis(e, places, axis=1) for e in entries) - slack  # never above the true ones
        scores[:, 1:][places[:, 1:] == places[:, :-1]] = -np.inf  # of several lists, but one vector
        both = np.concatenate((best, scores), axis=1)
        best = np.take_along_axis(both, highest(both, task.k), axis=1)
    i, j = np.nonzero(best > -np.inf)
    yield pa.RecordBatch.from_arrays([pa.array(task.ids[i]), pa.array(best[i, j])], names=["query_id", "score"])


def resolve(task: Task, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Phases 2 and 3: the exact scores of what may reach the cutoff; of each query the best ``k``."""
    task.prepared()
    kept: list[tuple[int, int, int]] = []  # query's place, -score, id
    numbers = {}
    for others, raw, entries, slack in task.parts(batches):
        keep = sufficient(entries, task.cutoff, slack)
        keep[task.own(others)] = False
        i, j = np.nonzero(keep)
        if task.exact:
            scores = sum(e[i, j] for e in entries).astype(np.int64)
            by = np.lexsort((others[j], -scores, i))
            i, j, scores = i[by], j[by], scores[by]
            first = np.append(np.full(min(task.k, len(i)), True), i[task.k :] != i[: -task.k])
            i, j, scores = i[first], j[first], scores[first].tolist()
        else:
            for x in np.unique(i).tolist():
                numbers.setdefault(x, whole(task.raw[x], task.scale))
            of = {y: whole(raw[y], task.scale) for y in np.unique(j).tolist()}
            scores = [sum(a * b for a, b in zip(numbers[x], of[y], strict=True)) for x, y in zip(i.tolist(), j.tolist(), strict=True)]
        kept += zip(i.tolist(), (-s for s in scores), others[j].tolist(), strict=True)
        if len(kept) > 4 * task.k * len(task.ids):
            kept = first_of_each(kept, task.k)
    kept = first_of_each(kept, task.k)
    size = task.bits // 8 + 1
    columns = [pa.array([int(task.ids[i]) for i, _, _ in kept], pa.int64()), pa.array([v for _, _, v in kept], pa.int64())]
    columns += [pa.array([max(-LONG - 1, min(LONG, -s)) for _, s, _ in kept], pa.int64())]
    columns += [pa.array([(s + (1 << 8 * size - 1)).to_bytes(size, "big") for _, s, _ in kept], pa.binary())]
    yield pa.RecordBatch.from_arrays(columns, names=["query_id", "id", "score", "place"])
    release()


def first_of_each(kept: list[tuple[int, int, int]], k: int) -> list[tuple[int, int, int]]:
    kept.sort()
    return [row for n, row in enumerate(kept) if n < k or kept[n - k][0] != row[0]]


def sound(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id`` and ``v``, the components as doubles, of the rows that take part."""
    x = F.col(vector_col)
    takes_part = F.col(id_col).isNotNull() & x.isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return df.where(takes_part).select(F.col(id_col).cast("long").alias("id"), x.cast("array<double>").alias("v"))


def chunks(queries: DataFrame, vectors: DataFrame, scale: int, k: int) -> Iterator[Task]:
    """The queries, in chunks."""
    sizes = [F.count(F.lit(1)), F.max(F.size("v")), F.max(F.greatest(F.array_max("v"), -F.array_min("v")))]
    n, width, top = queries.agg(*sizes).first()
    _, other_width, other_top = vectors.agg(*sizes).first()
    width = max(LISTS, width or 0, other_width or 0)
    largest = max(top or 0.0, other_top or 0.0)
    place = max(0, exponent(largest)) + exponent(scale)
    bits = 2 * (place + 1) + exponent(width) + 1  # no sum of products has more
    shift = place if bits > 53 else 0
    number = -(-n // max(1, min(QUERIES, CHUNK_BYTES // (8 * width))))
    for c in range(number):
        found = queries.where(F.pmod(F.xxhash64("id"), F.lit(number)) == c).toArrow().combine_chunks().sort_by("id")
        if found.num_rows:
            yield Task(int_column(found, "id"), matrix(column_of(found, "v"), width), scale, shift, bits, k)


def with_cutoffs(task: Task, vectors: DataFrame) -> Task:
    """Phase 1 over all vectors; a query with fewer than ``k`` candidates has no cutoff."""
    sent = vectors.sparkSession.sparkContext.broadcast(task)
    scores = vectors.mapInArrow(lambda batches: gather(sent.value, batches), "query_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc())
    found = scores.withColumn("place", F.row_number().over(order)).where(F.col("place") == task.k).select("query_id", "score").toArrow()
    task.cutoff = np.full(len(task.ids), -np.inf)
    task.cutoff[np.searchsorted(task.ids, int_column(found, "query_id"))] = column_of(found, "score").to_numpy()
    return task


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """``query_id, rank, <id>, score``: the ``k`` rows of ``vectors`` with the highest integer inner products for each row of ``queries``."""
    spark = vectors.sparkSession
    rows = sound(vectors, id_col, vector_col)
    asked = sound(queries, id_col, vector_col).groupBy("id").agg(F.min("v").alias("v")).checkpoint()
    found = spark.createDataFrame([], "query_id long, id long, score long, place binary")
    for task in chunks(asked, rows, scale, k):
        sent = spark.sparkContext.broadcast(with_cutoffs(task, rows))
        found = found.unionByName(rows.mapInArrow(lambda batches, sent=sent: resolve(sent.value, batches), "query_id long, id long, score long, place binary"))
    order = Window.partitionBy("query_id").orderBy("place", "id")
    ranked = found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(id_col), "score")


def kept_pairs(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> int:
    """How many pairs of a query and a vector phase 2 leaves to phase 3."""
    rows = sound(vectors, id_col, vector_col)
    asked = sound(queries, id_col, vector_col).groupBy("id").agg(F.min("v").alias("v"))
    total = 0
    for task in chunks(asked, rows, scale, k):
        sent = vectors.sparkSession.sparkContext.broadcast(with_cutoffs(task, rows))

        def count(batches, sent=sent):
            task = sent.value.prepared()
            kept = sum(int(sufficient(entries, task.cutoff, slack).sum()) for _, _, entries, slack in task.parts(batches))
            yield pa.RecordBatch.from_arrays([pa.array([kept], pa.int64())], names=["kept"])

        total += rows.mapInArrow(count, "kept long").agg(F.sum("kept")).first()[0] or 0
    return total


def is_query(id_col: Column) -> Column:
    return id_col % 50 == 0


def nearest(embeddings: DataFrame) -> DataFrame:
    """The five highest scores of every row whose id is divisible by 50, against every other row."""
    rows = embeddings.select("vec_id", "embedding")
    return top_k(rows, rows.where(is_query(F.col("vec_id"))))


#: The same in SQL, over every pair of a query and a candidate.
SQL = """
WITH sound AS (
  SELECT vec_id, list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM sound q JOIN sound c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
