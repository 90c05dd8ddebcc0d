"""Ranked lexical search by Fagin's threshold algorithm.

Terms are maximal runs of ASCII letters, digits and all characters beyond ASCII, with A-Z lower-cased. A document's score for an item is
the sum over the item's terms of the term's weight and of how often the document has it against the document's length, in 64-bit integers.

1. One pass reads the texts: of every document it keeps the number of its terms and how often it has each term that some item asks for. This
   forward index is written once; the terms of documents are never shuffled. Counts of documents by term, of all documents and of all terms come from it.
2. A task takes its documents in groups of bounded size. For a group it has the forward index and, for each term, the documents in the order of the
   term's share of the score (impact). For each item, the lists of its terms are read round robin, some entries of each at a time; each document that turns up is scored
   from the forward index; the sum of the shares last read is the threshold, and no document not yet seen can score more. Reading stops when the threshold is strictly below the
   k-th best score, which is taken along from group to group, so ties at the end are never lost.
3. The best ``k`` documents of each task for each item meet in a window by item.

Items are taken in chunks of bounded size, which is all that is broadcast; each chunk reads the documents anew.

Edge cases: a null text has no term and a document without terms counts in no statistic; items without terms, and documents with score 0, give no rows; an item's repeated
terms count as often as it has them; rows with one item id, null among them, are one item with the terms of all its rows; repeated documents are documents of their own, so one id
may have several ranks; of equal scores the smaller doc_id comes first, a null id last; texts are read whole, in pieces of bounded size; empty tables give
an empty result; columns other than ids and texts are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from tidemark.llm.arrow import column_of, release, text_buffers

K = 10
#: Bytes of items' texts that are broadcast at once.
CHUNK_BYTES = 8 << 20
#: Bytes of text that are split into terms at once.
PIECE = 1 << 20
#: Entries of the forward index that a group has at most (or one document).
ENTRIES = 2_000_000
#: Entries of each list that are read before the threshold is looked at, at first and at most.
DEPTH, DEEPEST = 32, 4096
SCALE = 1_000_000_000


def term_table() -> bytes:
    """Bytes of terms as they are, A-Z in lower case, all others as spaces."""
    keep = bytes([*range(48, 58), *range(97, 123), *range(128, 256)])
    return bytes(b + 32 if 65 <= b < 91 else b if b in keep else 32 for b in range(256))


TABLE = term_table()


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, a piece at a time; no term is cut."""
    at = 0
    while at < len(text):
        end = min(len(text), at + PIECE)
        piece = text[at:end].translate(TABLE)
        if end < len(text):
            cut = piece.rfind(b" ")
            while cut < 0 and end < len(text):  # one term fills the piece
                more = text[end : end + PIECE].translate(TABLE)
                end += len(more)
                cut = more.find(b" ")
                cut = len(piece) + cut if cut >= 0 else cut
                piece += more
            if cut >= 0:
                piece, end = piece[:cut], at + max(cut, 1)
        yield piece.split()
        at = end


@dataclass
class Chunk:
    """Items and their terms: the terms' numbers, and for each item those it has and how often."""

    items: list
    numbers: dict[bytes, int]
    asked: list[np.ndarray]
    times: list[np.ndarray]
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    documents: int = 0
    total: int = 0

    @staticmethod
    def of(rows: list[Row]) -> Chunk:
        counts: dict = {}
        for r in rows:
            own = counts.setdefault(r.item_id, {})
            for piece in terms((r.text or "").encode()):
                for t in piece:
                    own[t] = own.get(t, 0) + 1
        counts = {i: own for i, own in counts.items() if own}
        numbers = {t: n for n, t in enumerate(sorted({t for own in counts.values() for t in own}))}
        asked = [np.array([numbers[t] for t in own], np.int64) for own in counts.values()]
        return Chunk(list(counts), numbers, asked, [np.array(list(own.values()), np.int64) for own in counts.values()])

    def weigh(self, documents: int, total: int, found: dict[int, int]) -> Chunk:
        """Set the weights of terms from the numbers of documents that have them."""
        df = np.array([found.get(i, 0) for i in range(len(self.numbers))], np.int64)
        self.weights = np.floor(1000 * np.log((2 * documents + 2) / (2 * df + 1))).astype(np.int64)
        self.documents, self.total = documents, total
        return self


def forward_index(docs: DataFrame, numbers: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """``id, n`` (terms with repeats) and, of the terms asked for, ``terms`` (ascending) and ``tf`` of every document with a term."""
    sent = docs.sparkSession.sparkContext.broadcast(numbers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, width = sent.value, len(sent.value)
        for batch in batches:
            offsets, data = text_buffers(column_of(batch, "text"))
            n, sizes, found, tf = [], [], [], []
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                length, counts = 0, None
                for piece in terms(data[a:b].tobytes()):
                    length += len(piece)
                    hits = np.fromiter(filter(None, map(known.get, piece)), np.int64)
                    if b - a > PIECE:
                        counts = np.bincount(hits, minlength=width + 1) + (0 if counts is None else counts)
                    elif len(hits):
                        at, times = np.unique(hits, return_counts=True)
                        found.append(at)
                        tf.append(times)
                        counts = at
                if counts is not None and b - a > PIECE:
                    found.append(np.flatnonzero(counts))
                    tf.append(counts[found[-1]])
                n.append(length)
                sizes.append(len(found[-1]) if counts is not None else 0)
            lists = [pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(np.concatenate(x or [np.zeros(0, np.int64)]), t)) for x, t in ((found, pa.int32()), (tf, pa.int64()))]
            rows = pa.RecordBatch.from_arrays([column_of(batch, "id"), pa.array(n, pa.int64()), *lists], names=["id", "n", "terms", "tf"])
            yield rows.filter(pa.array(np.array(n) > 0))
        release()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, n long, terms array<int>, tf array<long>")


def term_documents(index: DataFrame, width: int) -> dict[int, int]:
    """How many documents have each term; tasks add up, so a row a task and term is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(width, np.int64)
        for batch in batches:
            counts += np.bincount(column_of(batch, "terms").flatten().to_numpy(zero_copy_only=False) - 1, minlength=width)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], names=["term", "n"])

    totals = index.select("terms").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    return {r.term: r.n for r in totals.toLocalIterator()}  # no more than the terms asked for


class Group:
    """A bounded number of documents: forward index and impact-sorted lists."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, terms: np.ndarray, impacts: np.ndarray, width: int):
        self.ids, self.terms, self.impacts = ids, terms, impacts
        self.edges = np.append(0, np.cumsum(sizes))
        doc = np.repeat(np.arange(len(ids)), sizes)
        order = np.lexsort((doc, -impacts, terms))
        self.listed, self.shares = doc[order], impacts[order]
        self.lists = np.searchsorted(terms[order], np.arange(width + 1))

    def scores(self, docs: np.ndarray, worth: np.ndarray) -> np.ndarray:
        """Scores of documents, looked up in the forward index; ``worth`` is what each term counts for the item."""
        starts, sizes = self.edges[docs], self.edges[docs + 1] - self.edges[docs]
        at = np.repeat(starts - np.append(0, np.cumsum(sizes)[:-1]), sizes) + np.arange(sizes.sum())
        return np.add.reduceat(worth[self.terms[at]] * self.impacts[at], np.append(0, np.cumsum(sizes)[:-1]))

    def search(self, asked: np.ndarray, worth: np.ndarray, best: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """The best ``k`` scores and ids of those found before and of this group's documents, and how many documents were looked up."""
        starts, ends = self.lists[asked], self.lists[asked + 1]
        going = (ends > starts) & (worth[asked] > 0)
        starts, ends, each = starts[going], ends[going], worth[asked][going]
        seen, depth, step, looked = np.zeros(len(self.ids), bool), 0, DEPTH, 0
        while len(starts):
            depth = min(depth + step, int((ends - starts).max()))
            upto = np.minimum(starts + depth, ends)
            new = np.concatenate([self.listed[max(a, b - step) : b] for a, b in zip(starts, upto, strict=True)])
            new = np.unique(new[~seen[new]])
            if len(new):
                seen[new] = True
                looked += len(new)
                best = leading(np.append(best[0], self.scores(new, worth)), np.append(best[1], self.ids[new]), k)
            # the share last read of each list; a list that is read to its end has none left
            left = np.where(upto < ends, self.shares[upto - 1], 0)
            if not left.any() or (len(best[0]) == k and int((each * left).sum()) < best[0][-1]):
                break
            step = min(2 * step, DEEPEST)
        return *best, looked


def leading(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` highest positive scores, of equal ones those of smaller ids."""
    if len(scores) > 4 * k:
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        scores, ids = scores[scores >= floor], ids[scores >= floor]
    order = np.lexsort((ids, -scores))[:k]
    order = order[scores[order] > 0]
    return scores[order], ids[order]


#: A null id, which comes after all others.
NULL = np.iinfo(np.int64).max


def groups(batches: Iterator[pa.RecordBatch], chunk: Chunk) -> Iterator[Group]:
    """The forward index of a task in groups of bounded size."""
    held: list[tuple] = []

    def close() -> Group:
        ids, sizes, found, impacts = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        return Group(ids, sizes, found, impacts, len(chunk.numbers))

    entries = 0
    for batch in batches:
        lists = column_of(batch, "terms")
        offsets = lists.offsets.to_numpy().astype(np.int64)
        column = column_of(batch, "id")
        ids = column.fill_null(NULL).to_numpy(zero_copy_only=False).astype(np.int64)
        n = column_of(batch, "n").to_numpy()
        found = lists.values.to_numpy()[offsets[0] : offsets[-1]].astype(np.int64) - 1
        tf = column_of(batch, "tf").values.to_numpy()[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        m = 25 + (75 * n * chunk.documents) // chunk.total
        impacts = (SCALE * tf) // (1000 * tf + 8 * np.repeat(m, np.diff(offsets)))
        start = 0
        while start < len(ids):
            end = int(np.searchsorted(offsets, offsets[start] + max(ENTRIES - entries, 0), side="right")) - 1
            end = min(len(ids), max(end, start + (not held)))
            if end > start:
                a, b = offsets[start], offsets[end]
                held.append((ids[start:end], np.diff(offsets[start : end + 1]), found[a:b], impacts[a:b]))
                entries += b - a
            if end < len(ids):
                yield close()
                entries = 0
            start = end
    if held:
        yield close()


def found_in(batches: Iterator[pa.RecordBatch], chunk: Chunk, k: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], int]:
    """The best documents of a task for each item, and how many were looked up."""
    best = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(chunk.items)
    looked = 0
    for group in groups(batches, chunk):
        worth = np.zeros(len(chunk.numbers), np.int64)
        for i, (asked, times) in enumerate(zip(chunk.asked, chunk.times, strict=True)):
            worth[asked] = chunk.weights[asked] * times
            scores, ids, n = group.search(asked, worth, best[i], k)
            best[i], looked = (scores, ids), looked + n
            worth[asked] = 0
    return best, looked


def chunks(items: DataFrame, id_col: str, text_col: str) -> Iterator[Chunk]:
    """Items by the bytes of their texts, all rows of one item together."""
    rows = items.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    total = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    number = -(-total // CHUNK_BYTES)
    for c in range(number):
        chunk = Chunk.of(rows.where(F.pmod(F.xxhash64("item_id"), F.lit(number)) == c).collect())  # of bounded size
        if chunk.items:
            yield chunk


def prepared(docs: DataFrame, chunk: Chunk, doc_id: str, doc_text: str) -> DataFrame | None:
    """The forward index for a chunk's terms, written, and the chunk with weights; none if no document has a term."""
    numbers = {t: i + 1 for t, i in chunk.numbers.items()}  # from 1, so that a term that isn't asked for and number 0 differ
    index = forward_index(docs, numbers, doc_id, doc_text).checkpoint()
    documents, total = index.agg(F.count(F.lit(1)), F.sum("n")).first()
    if not documents:
        return None
    chunk.weigh(documents, total, term_documents(index, len(numbers)))
    return index


def search(docs: DataFrame, items: DataFrame, k: int = K, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``<item_id>, rank, <doc_id>, score``: the ``k`` documents with the highest scores above 0 for each item."""
    spark = docs.sparkSession
    schema = "item long, id long, score long"
    found = spark.createDataFrame([], schema)
    for chunk in chunks(items, item_id, item_text):
        index = prepared(docs, chunk, doc_id, doc_text)
        if index is None:
            continue
        sent = spark.sparkContext.broadcast(chunk)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            best, _ = found_in(batches, sent.value, k)
            sizes = [len(s) for s, _ in best]
            numbers = [i for i, n in zip(sent.value.items, sizes, strict=True) for _ in range(n)]
            ids = np.concatenate([i for _, i in best] or [np.zeros(0, np.int64)])
            columns = [pa.array(numbers, pa.int64()), pa.array(ids, pa.int64(), mask=ids == NULL), pa.array(np.concatenate([s for s, _ in best] or [ids]), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["item", "id", "score"])
            release()

        found = found.unionByName(index.mapInArrow(run, schema))
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)
    return ranked.select(F.col("item").alias(item_id), "rank", F.col("id").alias(doc_id), "score")


def looked_up(docs: DataFrame, items: DataFrame, k: int = K) -> int:
    """How many pairs of an item and a document are scored, of all that there are."""
    total = 0
    for chunk in chunks(items, "item_id", "text"):
        index = prepared(docs, chunk, "doc_id", "text")
        if index is not None:
            sent = docs.sparkSession.sparkContext.broadcast(chunk)
            count = lambda batches, sent=sent: iter([pa.RecordBatch.from_arrays([pa.array([found_in(batches, sent.value, k)[1]], pa.int64())], names=["n"])])
            total += index.mapInArrow(count, "n long").agg(F.sum("n")).first()[0] or 0
    return total


#: The same in SQL: every document with one of an item's terms is scored.
SQL = r"""
WITH words AS (
  SELECT rowid AS doc, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws
  FROM (SELECT row_number() OVER () AS rowid, doc_id, text FROM documents)
), stats AS (
  SELECT count(*) AS big_n, CAST(sum(len(ws)) AS BIGINT) AS big_l FROM words WHERE len(ws) > 0
), tfs AS (
  SELECT doc, doc_id, len(ws) AS n, term, count(*) AS tf FROM (SELECT doc, doc_id, ws, unnest(ws) AS term FROM words) GROUP BY ALL
), dfs AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * (SELECT big_n FROM stats) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tfs GROUP BY term
), asked AS (
  SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), scored AS (
  SELECT item_id, doc, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * big_n) // big_l)))) AS BIGINT) AS score
  FROM asked JOIN dfs USING (term) JOIN tfs USING (term), stats GROUP BY item_id, doc, doc_id
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""
