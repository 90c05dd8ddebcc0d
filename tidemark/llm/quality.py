"""Quality rules as weak supervision.

Each rule votes for a document (1), against it (-1) or abstains (0). Expectation-maximisation over the
counted vote patterns estimates how often each rule is right about good and about bad documents, and a
document is kept if the posterior probability that it is good reaches ``KEEP``. Patterns are counted over all
documents; there are at most three to the power of the number of rules of them, whatever the input's size.

Words are runs of bytes other than ASCII white space. Edge cases: a null or empty text has no words and is not
kept; lines without a word never count as repeated; texts of any length count whole; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.arrow import column_of, slices, text_buffers, texts_of

MIN_WORDS = 50
KEEP = 0.5
ROUNDS = 200
#: Distinct words to number at once; three numbers of 21 bits make a window's key.
VOCABULARY = 300_000
SIGNALS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_upper", "n_marks", "n_symbol_words"]


def repeated_words(ids: np.ndarray, size: int = 3) -> int:
    """Words that lie in a window of ``size`` words found at least twice; ids are below 2 to the power 21."""
    n = len(ids) - size + 1
    if n < 2:
        return 0
    keys = ids[:n].copy()
    for i in range(1, size):
        keys = keys << 21 | ids[i : n + i]
    order = np.argsort(keys)
    ordered = keys[order]
    same = ordered[1:] == ordered[:-1]
    if not same.any():
        return 0
    starts = order[np.append(same, False) | np.append(False, same)]
    edges = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + size, -1)
    return int((np.cumsum(edges)[:-1] > 0).sum())


def byte_class(chars: bytes) -> np.ndarray:
    table = np.zeros(256, np.int64)
    table[list(chars)] = 1
    return table


def signals(df: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``df`` (or its columns in ``keep``) with a long for each of ``SIGNALS``, over the whole text."""
    kept = [c for c in (df.columns if keep is None else keep) if c not in SIGNALS]
    space = byte_class(b" \t\n\r\x0b\x0c")
    first = np.array([(b & 0xC0) != 0x80 for b in range(256)], np.int64)
    upper = byte_class(bytes(range(65, 91)))
    tables = {
        "word_chars": first * (1 - space),
        "n_symbols": byte_class(b"#*$%&|<>"),
        "n_letters": byte_class(bytes([*range(65, 91), *range(97, 123), *range(0xC2, 0xF5)])),
        "n_upper": upper,
        "n_marks": byte_class(b"!?"),
    }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers: dict[bytes, int] = defaultdict(count().__next__)
        for batch in batches:
            offsets, data = text_buffers(column_of(batch, text_col))
            for a, b in slices(offsets):
                at = offsets[a : b + 1] - offsets[a]
                part = data[offsets[a] : offsets[b]]
                out = {}
                for name, table in tables.items():
                    total = np.append(0, np.cumsum(table[part]))
                    out[name] = total[at[1:]] - total[at[:-1]]
                rows = []
                for text in texts_of(at, part):
                    words = text.split()
                    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
                    if len(numbers) + len(words) > VOCABULARY:
                        numbers = defaultdict(count().__next__)
                    ids = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
                    if len(numbers) >= 1 << 21:  # one text with more distinct words: its own numbers, two words at a time
                        repeats = repeated_words_of(words)
                    else:
                        repeats = repeated_words(ids)
                    rows.append((len(words), len(lines) - len(set(lines)), repeats, len(lines), sum(1 for w in words if w[-1] in b"#*$%&|<>")))
                out |= dict(zip(["n_words", "n_dup_lines", "n_repeat_words", "n_lines", "n_symbol_words"], np.array(rows, np.int64).reshape(-1, 5).T, strict=True))
                columns = [column_of(batch, c).slice(a, b - a) for c in kept] + [pa.array(np.ascontiguousarray(out[s]), pa.int64()) for s in SIGNALS]
                yield pa.RecordBatch.from_arrays(columns, names=[*kept, *SIGNALS])

    source = df.select(*(df[c] for c in df.columns if c in kept or c == text_col))
    schema = df.select(*kept).withColumns({s: F.lit(0).cast("long") for s in SIGNALS}).schema
    return source.mapInArrow(run, schema)


def repeated_words_of(words: list[bytes]) -> int:
    """``repeated_words`` for a text with more distinct words than 21 bits can number."""
    numbers: dict[bytes, int] = defaultdict(count().__next__)
    ids = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
    _, pair = np.unique(ids[:-1] << 32 | ids[1:], return_inverse=True)
    _, triple, sizes = np.unique(pair[:-1] << 32 | ids[2:], return_inverse=True, return_counts=True)
    starts = np.flatnonzero(sizes[triple] > 1)
    covered = np.zeros(len(ids), bool)
    for i in range(3):
        covered[starts + i] = True
    return int(covered.sum())


def vote(good: Column, bad: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0).cast("int")


def rules() -> dict[str, Column]:
    """The rules' votes from the signals; each abstains between its two limits."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    lines = F.greatest(F.col("n_lines"), F.lit(1))
    chars = F.greatest(F.col("word_chars"), F.lit(1))
    share = lambda a, b: F.col(a) / b
    return {
        "length": vote(F.col("n_words") >= 80, F.col("n_words") < MIN_WORDS),
        "word_length": vote(share("word_chars", words).between(3.0, 9.0), ~share("word_chars", words).between(2.0, 14.0)),
        "symbols": vote(share("n_symbols", words) <= 0.05, share("n_symbols", words) > 0.3),
        "dup_lines": vote(share("n_dup_lines", lines) <= 0.1, share("n_dup_lines", lines) > 0.3),
        "repeats": vote(share("n_repeat_words", words) <= 0.15, share("n_repeat_words", words) > 0.5),
        "capitals": vote(share("n_upper", F.greatest(F.col("n_letters"), F.lit(1))) <= 0.3, share("n_upper", F.greatest(F.col("n_letters"), F.lit(1))) > 0.6),
        "marks": vote(share("n_marks", words) <= 0.1, share("n_marks", words) > 0.5),
        "letters": vote(share("n_letters", chars) >= 0.85, share("n_letters", chars) < 0.75),
        "symbol_words": vote(share("n_symbol_words", words) <= 0.1, share("n_symbol_words", words) > 0.3),
    }


#: Where the estimates start, by class (bad, good) and vote (-1, 0, 1): a vote against seldom meets a good document.
START = [[0.4, 0.1, 0.5], [0.05, 0.1, 0.85]]


def fit(patterns: list[tuple[tuple[int, ...], int]], n_rules: int) -> tuple[float, np.ndarray]:
    """Share of good documents and, per rule, class (bad, good) and vote (-1, 0, 1), the vote's probability.

    The start tells the classes apart, so they can't change places; one is added to each count of a vote, so a
    rule that never votes wrongly keeps a chance to.
    """
    votes = np.array([p for p, _ in patterns], np.int64).reshape(len(patterns), n_rules) + 1
    weight = np.array([n for _, n in patterns], float)
    share = 0.5
    table = np.tile(np.array(START), (n_rules, 1, 1))
    if not len(patterns):
        return share, table
    for _ in range(ROUNDS):
        good = posterior(votes - 1, share, table)
        before, share = share, float(np.clip((weight * good).sum() / weight.sum(), 1e-4, 1 - 1e-4))
        for r in range(n_rules):
            for c, p in enumerate((1 - good, good)):
                counts = np.bincount(votes[:, r], weight * p, 3) + 1.0
                table[r, c] = counts / counts.sum()
        if abs(share - before) < 1e-9:
            break
    return share, table


def posterior(votes: np.ndarray, share: float, table: np.ndarray) -> np.ndarray:
    """Probability that a document with these votes is good."""
    logs = np.log(table)
    at = np.arange(votes.shape[1])
    bad = np.log(1 - share) + logs[at, 0, votes + 1].sum(axis=1)
    good = np.log(share) + logs[at, 1, votes + 1].sum(axis=1)
    return 1 / (1 + np.exp(np.clip(bad - good, -700, 700)))


def judge(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From a table with the signals: the same with each rule's vote and ``quality``, and the rules' accuracies."""
    votes = rules()
    names = [f"vote_{r}" for r in votes]
    voted = df.withColumns(dict(zip(names, votes.values(), strict=True)))
    counted = [(tuple(r[:-1]), r[-1]) for r in voted.groupBy(*names).count().collect()]
    counted.sort()
    share, table = fit(counted, len(names))
    spark = df.sparkSession
    weights = np.log(table[:, 1] / table[:, 0])
    logit = F.lit(float(np.log(share / (1 - share))))
    for name, w in zip(names, weights, strict=True):
        logit = logit + F.when(F.col(name) == -1, float(w[0])).when(F.col(name) == 0, float(w[1])).otherwise(float(w[2]))
    rows = [(n[5:], float(t[1, 2] / (t[1, 0] + t[1, 2])), float(t[0, 0] / (t[0, 0] + t[0, 2]))) for n, t in zip(names, table, strict=True)]
    accuracies = spark.createDataFrame(rows, "rule string, right_on_good double, right_on_bad double")
    return voted.withColumn("quality", 1 / (1 + F.exp(-logit))), accuracies


def judged(docs: DataFrame) -> DataFrame:
    """Per document of ``documents``: base signals, whether they fail it, the posterior quality and ``kept``."""
    base = signals(docs.select("doc_id", "text"), keep=["doc_id"])
    scored, _ = judge(base.checkpoint())
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return scored.withColumn("base_failed", failed).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~failed & (F.col("quality") >= KEEP)).alias("kept"), "quality", *[c for c in scored.columns if c.startswith("vote_")],
    )
