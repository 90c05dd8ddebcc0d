"""Language identification by rank-order profiles.

A language's profile lists its most frequent character n-grams (one to three letters of lower-case words,
with a mark at both word ends) in order. A document is compared with each profile by the out-of-place
distance: for each of the document's most frequent n-grams, by how many ranks its place differs, or the
profile's length if it isn't there. The nearest profile wins.

Profiles are counted over all documents that may be learned from: tasks add up the n-grams of their batches,
Spark sums them by language and n-gram, and only ``PROFILE`` n-grams a language reach the driver and the
tasks, of ``LANGUAGES`` languages at once; documents meet the profiles of more languages one such part after the other.

Edge cases: a text that is null or has no letter gets ``und`` and score 0, and so does every text if there is
nothing to learn from; of equally near languages the first by code points wins; equally frequent n-grams
rank by their code points; texts of any length count whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.arrow import column_of, release, slices, text_buffers

#: n-grams in a language's profile, and in a document's.
PROFILE = 400
#: Symbols of a text whose n-grams are counted at once.
PIECE = 1 << 18
#: Languages whose profiles are broadcast together (some 6 kB each).
LANGUAGES = 1000
#: Rows of distinct n-grams that a task gathers before it sends them on.
GATHERED = 400_000
UNKNOWN = "und"


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Whether a code point is a letter, by code point."""
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def symbols(text: str) -> np.ndarray:
    """Lower-case letters as code points, with one zero before, after and between words; empty without a letter."""
    lowered, parts = text.lower(), []
    for at in range(0, len(lowered), PIECE):
        codes = np.frombuffer(lowered[at : at + PIECE].encode("utf-32-le", "replace"), np.int32)
        parts.append(np.where(letters()[codes], codes, 0))
    codes = np.concatenate((np.zeros(1, np.int32), *parts, np.zeros(1, np.int32)))
    if not codes.any():
        return np.zeros(0, np.int32)
    return codes[np.append(True, (codes[1:] != 0) | (codes[:-1] != 0))]


def grams(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All n-grams of one to three symbols, 21 bits a symbol, ascending, and how often each occurs; a lone word mark isn't one."""
    keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for at in range(0, len(codes), PIECE):
        some = codes[at : at + PIECE + 2].astype(np.int64)
        one = some[:PIECE]
        two = some[:-1] << 21 | some[1:]
        three = (two[:-1] << 21 | some[2:])[some[1:-1] != 0]
        found, n = np.unique(np.concatenate((one[one != 0], two[:PIECE], three)), return_counts=True)
        if at == 0:
            keys, counts = found, n
            continue
        keys, at_key = np.unique(np.concatenate((keys, found)), return_inverse=True)
        counts = np.bincount(at_key, np.concatenate((counts, n)), len(keys)).astype(np.int64)
    return keys, counts


def ranked(text: str, size: int = PROFILE) -> np.ndarray:
    """The text's most frequent n-grams, most frequent first."""
    keys, counts = grams(symbols(text))
    return keys[np.argsort(-counts, kind="stable")[:size]]


class Profiles:
    """Ranks of the n-grams of all profiles in one table, for look-ups by binary search."""

    def __init__(self, rows: list[tuple[str, int, int]]):
        self.languages = sorted({lang for lang, _, _ in rows})
        self.keys = np.array(sorted({key for _, key, _ in rows}), np.int64)
        self.ranks = np.full((len(self.languages), len(self.keys) + 1), -1, np.int64)
        at = {lang: i for i, lang in enumerate(self.languages)}
        for lang, key, rank in rows:
            self.ranks[at[lang], np.searchsorted(self.keys, key)] = rank

    def nearest(self, own: np.ndarray) -> tuple[str, float]:
        """The language whose profile is nearest to a document's ranked n-grams (there have to be some), and the score."""
        at = np.searchsorted(self.keys, own)
        at[at == len(self.keys)] = 0
        at = np.where(self.keys[at] == own, at, len(self.keys))
        ranks = self.ranks[:, at]
        away = np.where(ranks < 0, PROFILE, np.minimum(np.abs(ranks - np.arange(len(own))), PROFILE)).sum(axis=1)
        best = int(np.argmin(away))
        return self.languages[best], 1.0 - float(away[best]) / (PROFILE * len(own))


def learn(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> list[Profiles]:
    """Profiles of every language in ``lang_col``, in parts, from all its texts; rows with a null in either are left out."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}

        def fold(lang: str) -> int:
            keys, counts = (np.concatenate(x) for x in zip(*held[lang], strict=True))
            keys, at = np.unique(keys, return_inverse=True)
            held[lang] = [(keys, np.bincount(at, counts, len(keys)).astype(np.int64))]
            return len(keys)

        def send() -> Iterator[pa.RecordBatch]:
            for lang in list(held):
                fold(lang)
                keys, counts = held.pop(lang)[0]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys), pa.array(counts)], names=["lang", "gram", "n"])

        for batch in batches:
            offsets, data = text_buffers(column_of(batch, text_col))
            langs = np.array(column_of(batch, lang_col).to_pylist(), object)
            for a, b in slices(offsets, 1 << 20):
                at = offsets[a : b + 1]
                for lang in set(langs[a:b]):
                    raw = b" ".join(data[at[i] : at[i + 1]].tobytes() for i in np.flatnonzero(langs[a:b] == lang))
                    codes = symbols(raw.decode("utf-8", "replace"))
                    if len(codes):
                        held.setdefault(lang, []).append(grams(codes))
                        if len(held[lang]) > 8:
                            fold(lang)
            if sum(len(k) for parts in held.values() for k, _ in parts) > GATHERED:
                yield from send()
        yield from send()
        release()

    rows = labelled.select(text_col, lang_col).where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    totals = rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.col("n").desc(), F.col("gram"))
    top = totals.withColumn("place", F.row_number().over(order)).where(F.col("place") <= PROFILE)
    top = top.select("lang", "gram", "place").checkpoint()
    languages = sorted(r.lang for r in top.select("lang").distinct().collect())
    parts = []
    for at in range(0, len(languages), LANGUAGES):
        rows = top.where(F.col("lang").between(languages[at], languages[min(at + LANGUAGES, len(languages)) - 1])).collect()
        parts.append(Profiles([(r.lang, r.gram, r.place - 1) for r in rows]))
    return parts


def predict(df: DataFrame, profiles: list[Profiles], text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``df`` (or its columns in ``keep``) with ``lang_pred`` and ``score``: 1 less the share of the greatest possible distance."""
    kept = [c for c in (df.columns if keep is None else keep) if c not in ("lang_pred", "score")]
    names = [*kept, "lang_pred", "score"]
    shared = [df.sparkSession.sparkContext.broadcast(part) for part in profiles]

    def nearest(text: str) -> tuple[str, float]:
        own = ranked(text) if text and shared else ()
        best = UNKNOWN, 0.0
        for i, part in enumerate(shared if len(own) else ()):
            found = part.value.nearest(own)
            best = found if i == 0 or found[1] > best[1] else best  # parts are in order, so of equals the first stays
        return best

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = text_buffers(column_of(batch, text_col))
            for a, b in slices(offsets):
                langs, scores = zip(*(nearest(data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace")) for i in range(a, b)), strict=True)
                columns = [column_of(batch, c).slice(a, b - a) for c in kept]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=names)
        release()

    source = df.select(*(df[c] for c in df.columns if c in kept or c == text_col))
    schema = df.select(*kept).withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0)}).schema
    return source.mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    """Documents that nothing is learned from: those whose id, as text, has a CRC-32 of remainder 1 by 3."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def identify(docs: DataFrame) -> DataFrame:
    """Per document: whether it was held out of learning, its predicted language and the score."""
    profiles = learn(docs.where(~F.coalesce(held_out(F.col("doc_id")), F.lit(True))))
    found = predict(docs.select("doc_id", "text"), profiles, keep=["doc_id"])
    return found.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")
