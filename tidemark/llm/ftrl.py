"""Quality classifier: logistic regression on hashed word n-grams, learned by follow-the-regularised-leader.

Words are runs of letters and digits, lower-cased in A-Z, or runs of other marks; white space parts them. A document's features are
its words, its pairs of words and, so that words never seen count as well, its n-grams of one to three word shapes (case, digits, which mark,
whether the word repeats one of the two before it). Each n-gram is hashed to one of ``DIM`` places; its value is one plus
the logarithm of its count, and a document's values have length one. The score is the logistic function of the sparse dot product with the weights.

Weights are learned by FTRL-Proximal with a rate of its own for each place. At most some ``TRAINED`` labelled documents take part, chosen by a hash
of their ids, so the classifier is the same whatever the cluster does. They are dealt to ``SHARDS`` shards; in each of ``EPOCHS`` rounds every shard goes on from the state
that is broadcast (two numbers a place) and sends what it changed; a place's change is the mean over the shards that changed it. Only
the state, which is bounded by ``DIM``, and the labels of those chosen, which are bounded by ``TRAINED``, reach the driver and all tasks.

Edge cases: an empty or null text has the constant feature alone and gets the score of that; without any labels every score is 0.5; labels that are null
or other than 0 and 1 aren't learned from; of several labels of a document the lower counts; a null id takes no part in learning; rows with equal ids are
scored each and learned from once; a document of any length is read whole, in pieces of bounded size (a single word that fills a piece is cut there); an
empty table gives an empty result; columns other than the id and the text are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.arrow import column_of, release, slices, text_buffers
from tidemark.llm.langid import held_out
from tidemark.llm.rounds import SEEDS, U, mix, range_hashes

BITS = 17
DIM = 1 << BITS
#: Labelled documents to learn from, about; shards and rounds of learning.
TRAINED = 20_000
SHARDS = 32
EPOCHS = 6
#: Learning rate, its smoothing, and the weights of both penalties.
ALPHA, BETA, L1, L2 = 3.0, 1.0, 0.02, 0.0
#: Bytes of one document that are turned into arrays at once.
PIECE = 4 << 20
SPACE, WORD, MARK = 0, 1, 2


def byte_classes() -> np.ndarray:
    classes = np.full(256, WORD, np.uint8)
    classes[:128] = MARK
    classes[[*range(48, 58), *range(65, 91), *range(97, 123)]] = WORD
    classes[[*range(33), 127]] = SPACE
    return classes


CLASSES = byte_classes()
LOWER = np.array([b + 32 if 65 <= b < 91 else b for b in range(256)], np.uint8)
BYTE_VALUES = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)


@dataclass
class Words:
    """Words of several documents: hashes, shapes, and the number of each word's document."""

    hashes: np.ndarray
    shapes: np.ndarray
    doc: np.ndarray

    @staticmethod
    def of(data: np.ndarray, offsets: np.ndarray) -> Words:
        n = len(data)
        classes = CLASSES[data]
        first = np.ones(n, bool)
        first[1:] = classes[1:] != classes[:-1]
        inner = offsets[1:-1]
        first[inner[inner < n]] = True
        starts = np.flatnonzero(first)
        ends = np.append(starts[1:], n)
        word = classes[starts] != SPACE
        starts, ends = starts[word], ends[word]
        hashes = range_hashes(BYTE_VALUES[LOWER[data]], starts, ends, 0)
        upper = np.append(0, np.cumsum((data >= 65) & (data < 91)))
        digits = np.append(0, np.cumsum((data >= 48) & (data < 58)))
        n_upper, n_digits, lead = upper[ends] - upper[starts], digits[ends] - digits[starts], data[starts].astype(np.int64)
        shapes = np.where(n_digits > 0, 3, np.where(n_upper > 1, 2, np.where(n_upper == 1, 1, 0)))
        marks = classes[starts] == MARK
        shapes = np.where(marks, 8 + 4 * lead + np.minimum(ends - starts, 3), shapes)
        return Words(hashes, shapes, np.searchsorted(offsets, starts, side="right") - 1)

    def features(self, known: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Places of all n-grams and the documents that they are in; those that end in the first ``known`` words are left out."""
        h, doc, n = self.hashes, self.doc, len(self.hashes)
        same = [np.append(np.zeros(min(i, n), bool), (h[i:] == h[:-i]) & (doc[i:] == doc[:-i])) if n > i else np.zeros(n, bool) for i in (1, 2)]
        shape = (self.shapes * 3 + np.where(same[0], 1, np.where(same[1], 2, 0))).astype(np.uint64) + U(1)
        places, docs = [], []

        def add(codes: np.ndarray, kind: int, size: int) -> None:
            """n-grams of ``size`` words; codes belong to the last."""
            inside = np.arange(len(codes)) + size - 1 >= known
            if size > 1:
                inside &= doc[size - 1 :] == doc[: 1 - size]
            places.append((mix(mix(codes[inside], SEEDS[kind % 3]) + U(kind), SEEDS[1]) >> U(64 - BITS)).astype(np.int64))
            docs.append(doc[size - 1 :][inside])

        add(h, 1, 1)
        add(shape, 3, 1)
        if n > 1:
            add(h[1:] * SEEDS[2] + mix(h[:-1], SEEDS[0]), 2, 2)
            add(shape[1:] + shape[:-1] * U(4096), 4, 2)
        if n > 2:
            add(shape[2:] + shape[1:-1] * U(4096) + shape[:-2] * U(1 << 24), 5, 3)
        return np.concatenate(places), np.concatenate(docs)

    def last(self, n: int) -> Words:
        return Words(self.hashes[-n:], self.shapes[-n:], self.doc[-n:])

    def then(self, more: Words) -> Words:
        return Words(*(np.concatenate((getattr(self, f), getattr(more, f))) for f in ("hashes", "shapes", "doc")))


def scaled(places: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A document's places and values from its counts, the constant feature last."""
    values = 1.0 + np.log(counts)
    norm = np.sqrt((values * values).sum())
    return np.append(places, DIM), np.append(values / norm if norm else values, 1.0)


def long_counts(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places and counts of one document, piece by piece."""
    counts, at = np.zeros(DIM, np.int64), 0
    before = Words.of(data[:0], np.zeros(2, np.int64))
    while at < len(data):
        end = min(len(data), at + PIECE)
        if end < len(data):
            classes = CLASSES[data[at : end + 1]]
            changes = np.flatnonzero(classes[1:] != classes[:-1])
            end = at + int(changes[-1]) + 1 if len(changes) else end
        words = before.then(Words.of(data[at:end], np.array([0, end - at])))
        places, _ = words.features(len(before.hashes))
        counts += np.bincount(places, minlength=DIM)
        before, at = words.last(4), end  # two words back, and two more that these may repeat
    places = np.flatnonzero(counts)
    return places, counts[places]


def counted(offsets: np.ndarray, data: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of n-grams and their counts in each document, in order."""
    for a, b in slices(offsets):
        part = data[offsets[a] : offsets[b]]
        if b - a == 1 and len(part) > PIECE:
            yield long_counts(part)
            continue
        words = Words.of(part, offsets[a : b + 1] - offsets[a])
        places, docs = words.features()
        found, counts = np.unique(docs << BITS | places, return_counts=True)
        edges = np.searchsorted(found, np.arange(b - a + 1) << BITS)
        for i in range(b - a):
            x, y = edges[i], edges[i + 1]
            yield found[x:y] & (DIM - 1), counts[x:y]


@dataclass
class State:
    """For each place the two numbers of FTRL-Proximal: the leader's slope and the sum of squared gradients."""

    z: np.ndarray
    n: np.ndarray

    @staticmethod
    def empty() -> State:
        return State(np.zeros(DIM + 1), np.zeros(DIM + 1))

    def weights(self, places: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[places], self.n[places]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, places: np.ndarray, values: np.ndarray, label: int) -> None:
        w, n = self.weights(places), self.n[places]
        gradient = (logistic(float(w @ values)) - label) * values
        grown = n + gradient * gradient
        self.z[places] += gradient - (np.sqrt(grown) - np.sqrt(n)) / ALPHA * w
        self.n[places] = grown


def logistic(x: float) -> float:
    return 1.0 / (1.0 + np.exp(-min(max(x, -35.0), 35.0)))


def chosen(labels: DataFrame, id_col: str, label_col: str, bound: int) -> DataFrame:
    """``id, label`` of at most about ``bound`` labelled documents."""
    sound = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min(F.col(label_col).cast("int")).alias("label"))
    total = sound.count()
    limit = min(1 << 30, (bound << 30) // max(total, 1))
    return sound.where(F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1 << 30)) < limit)


def training_rows(docs: DataFrame, labelled: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``shard, place, id, label, places, counts`` of the labelled documents; a shard is in one partition, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, labels = column_of(batch, "id"), column_of(batch, "label")
            for at, (places, counts) in enumerate(counted(*text_buffers(column_of(batch, "text")))):
                columns = [ids.slice(at, 1), labels.slice(at, 1), *(pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, pa.int32())) for x in (places, counts))]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "label", "places", "counts"])
        release()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(F.broadcast(labelled), "id")
    found = rows.mapInArrow(run, "id long, label int, places array<int>, counts array<int>")
    dealt = found.select(F.pmod(F.xxhash64("id", F.lit(12)), F.lit(SHARDS)).cast("int").alias("shard"), F.xxhash64("id", F.lit(13)).alias("place"), *found.columns)
    return dealt.repartition(SHARDS, "shard").sortWithinPartitions("shard", "place", "id", F.xxhash64("places", "counts"))


def shard_changes(batches: Iterator[pa.RecordBatch], start: State) -> Iterator[pa.RecordBatch]:
    """What each shard changes in the state, going on from ``start``; of rows with one id the first is learned from."""
    own, shard, before = None, None, None

    def close() -> Iterator[pa.RecordBatch]:
        if own is not None:
            at = np.flatnonzero(own.n != start.n)
            parts = [pa.array(at, pa.int32()), pa.array((own.z - start.z)[at], pa.float32()), pa.array((own.n - start.n)[at], pa.float32())]
            lists = [pa.ListArray.from_arrays(pa.array([0, len(at)], pa.int32()), x) for x in parts]
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), *lists], names=["shard", "at", "dz", "dn"])

    for batch in batches:
        shards, ids, labels, places, counts = (column_of(batch, c) for c in ("shard", "id", "label", "places", "counts"))
        for i, (number, doc, label) in enumerate(zip(shards.to_pylist(), ids.to_pylist(), labels.to_pylist(), strict=True)):
            if number != shard:
                yield from close()
                own, shard, before = State(start.z.copy(), start.n.copy()), number, None
            if doc != before:
                own.learn(*scaled(places[i].values.to_numpy(), counts[i].values.to_numpy()), label)
            before = doc
    yield from close()


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", bound: int = TRAINED) -> np.ndarray:
    """The weights of all places, the constant's last."""
    spark = docs.sparkSession
    rows = training_rows(docs, chosen(labels, id_col, label_col, bound), id_col, text_col).checkpoint()
    state = State.empty()
    for _ in range(EPOCHS):
        sent = spark.sparkContext.broadcast(state)
        changes = rows.mapInArrow(lambda batches, sent=sent: shard_changes(batches, sent.value), "shard int, at array<int>, dz array<float>, dn array<float>")
        found = changes.toArrow().combine_chunks().sort_by("shard")  # at most SHARDS rows of at most DIM + 1 places
        dz, dn, touched = np.zeros(DIM + 1), np.zeros(DIM + 1), np.zeros(DIM + 1)
        for at, z, n in zip(*(column_of(found, c) for c in ("at", "dz", "dn")), strict=True):
            at = at.values.to_numpy()
            dz[at] += z.values.to_numpy()
            dn[at] += n.values.to_numpy()
            touched[at] += 1
        touched = np.maximum(touched, 1)
        state = State(state.z + dz / touched, state.n + dn / touched)
        sent.unpersist()
    return state.weights()


def score(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``<id>, score`` of every document."""
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value
        for batch in batches:
            vectors = (scaled(*x) for x in counted(*text_buffers(column_of(batch, "text"))))
            scores = [logistic(float(w[places] @ values)) for places, values in vectors]
            yield pa.RecordBatch.from_arrays([column_of(batch, "id"), pa.array(scores, pa.float64())], names=[id_col, "score"])
        release()

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, rows.select(F.col("id").alias(id_col)).withColumn("score", F.lit(0.5)).schema)


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: whether it was held out of learning, its score and the predicted label."""
    usable = labels.where(~F.coalesce(held_out(F.col("doc_id")), F.lit(True)))
    scored = score(docs, learn(docs, usable))
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
