"""Suffix-array dedup of byte passages with longest-previous-factor arrays.

A byte is removed if a string of ``LENGTH`` bytes over it also starts earlier: in a document with a smaller id, or
earlier in the same document. Windows never cross documents, and all are judged on the input.

Suffixes that share ``LENGTH`` bytes have to meet in one place to be sorted together. Each window has an anchor, the
least hash of the ``GRAM``-byte strings in it, and consecutive windows with the same anchor form one stretch; equal
windows always lie in stretches of the same anchor. The rounds of ``tidemark.llm.rounds`` first find the anchors that
may be there more than once, then send only their stretches, by anchor, to shards. A shard drops stretches that are
the same as earlier ones (all their windows are later copies), sorts the suffixes of the others where an anchor has
several, and computes their longest previous factors: of the previous and the next suffix in that order that start earlier, the longer
common prefix. A window whose factor reaches ``LENGTH`` is a later copy.

Stretches of an anchor that has very many unlike ones, such as the ends of a passage that goes on differently each time, would all meet in
one task. They are taken apart: each of their windows goes to a shard by its own 128-bit hash, where the least position
of each is the earlier copy. That is some fifteen times as much to send, so it is done from ``rounds.HOT_ITEMS`` stretches on.

A block sends equal stretches once, the earliest, so copies that a third of all documents share are as many rows
as there are blocks with them. Long stretches (of periodic text) are cut.

Edge cases: a null or empty text, or one shorter than ``LENGTH``, keeps all it has; a null id counts as the
greatest; rows with equal ids count as the same document, ordered by place alone; bytes may be cut within a character (the kept bytes are
binary); texts of any length are taken whole.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import rounds
from tidemark.llm.rounds import Block, U

LENGTH = 100
GRAM = 32
#: Windows in a stretch at most.
STRETCH = 1024
#: Bytes of documents that are hashed at once, and of stretches that are sorted at once (or those of one anchor, if more).
CHUNK = 1 << 18


def sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    out, span = x, 1
    while span < width:
        step = min(span, width - span)
        out = np.minimum(out[: len(out) - step], out[step:])
        span += step
    return out


class Stretches:
    """A block's stretches: anchor, document's place, first window and number of windows, in order."""

    def __init__(self, block: Block, length: int, gram: int):
        anchor, owner, start, windows = [], [], [], []
        group: list[tuple[int, int, bytes]] = []
        size = 0

        def hash_group() -> None:
            owners, firsts = (np.array([piece[x] for piece in group], np.int64) for x in (0, 1))
            a, o, s, w = self.of_chunk(b"".join(piece for _, _, piece in group), np.array([len(piece) for _, _, piece in group], np.int64), length, gram)
            anchor.append(a)
            owner.append(owners[o])
            start.append(s + firsts[o])
            windows.append(w)

        for i, text in enumerate(block.texts):
            # a long text comes in pieces of CHUNK windows, which share all bytes of a window but one
            for first in range(0, len(text) - length + 1, CHUNK):
                group.append((i, first, text[first : first + CHUNK + length - 1]))
                size += len(group[-1][2])
                if size >= CHUNK:
                    hash_group()
                    group, size = [], 0
        if group:
            hash_group()
        join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        self.anchor, self.owner = join(anchor, np.uint64), join(owner, np.int64)
        self.start, self.windows = join(start, np.int64), join(windows, np.int64)

    @staticmethod
    def of_chunk(data: bytes, lengths: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
        raw = np.frombuffer(data, np.uint8)
        n = len(raw) - gram + 1
        at = np.arange(n)
        hashes = rounds.mix(rounds.range_hashes(rounds.byte_values(0)[raw], at, at + gram, 0), rounds.SEEDS[0])
        least = sliding_minimum(hashes, length - gram + 1)
        ends = np.cumsum(lengths)
        inside = np.ones(len(raw), bool)  # windows that start there stay in one document
        for e in ends.tolist():
            inside[e - length + 1 : e] = False
        inside = inside[: len(least)]
        new = np.append(True, (least[1:] != least[:-1]) | ~inside[:-1])
        new[np.append(0, ends[:-1])[np.append(0, ends[:-1]) < len(new)]] = True
        first = np.flatnonzero(new & inside)
        stop = np.append(np.flatnonzero(new | ~inside), len(least))
        windows = stop[np.searchsorted(stop, first, side="right")] - first
        if len(windows) and windows.max() > STRETCH:
            parts = -(-windows // STRETCH)
            nth = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
            first, windows = np.repeat(first, parts) + nth * STRETCH, np.repeat(windows, parts) - nth * STRETCH
            windows = np.minimum(windows, STRETCH)
        owner = np.searchsorted(ends, first, side="right")
        return rounds.mix(least[first], rounds.SEEDS[1]), owner, first - (ends - lengths)[owner], windows


class Candidates:
    """The stretches of a block whose anchors are estimated repeated; equal ones point to the first of them."""

    def __init__(self, block: Block, stretches: Stretches, answers: list, shards: int, length: int):
        repeated = np.flatnonzero(rounds.estimated_repeated(stretches.anchor, answers, shards))
        is_hot = rounds.hot(stretches.anchor, answers, shards)[repeated]  # asked for all keys that were sketched: the answers are in their order
        at, self.hot = repeated[~is_hot], repeated[is_hot]
        shard = (((stretches.anchor[at] >> U(32)) * U(shards)) >> U(32)).astype(np.int64)
        order = np.lexsort((stretches.start[at], block.ids[stretches.owner[at]], shard))
        self.at, shard = at[order], shard[order]
        seen: dict[bytes, int] = {}
        owners, starts = stretches.owner[self.at].tolist(), stretches.start[self.at].tolist()
        sizes = (stretches.windows[self.at] + length - 1).tolist()
        first = np.empty(len(self.at), np.int64)
        earlier = np.zeros(len(self.at), bool)
        self.bytes: list[bytes] = []
        for i, (o, s, n) in enumerate(zip(owners, starts, sizes, strict=True)):
            content = block.texts[o][s : s + n]
            first[i] = f = seen.setdefault(content, i)
            if f == i:
                self.bytes.append(content)
            else:
                g = owners[f]
                earlier[i] = block.ids[o] > block.ids[g] or s > starts[f]
        self.earlier = earlier  # a later copy of a stretch in this block
        self.first = first
        self.sent = np.flatnonzero(first == np.arange(len(first)))
        shard = shard[self.sent]
        edges = np.append(np.flatnonzero(np.append(True, shard[1:] != shard[:-1])), len(shard)) if len(shard) else np.zeros(0, int)
        self.ranges = [(int(shard[a]), int(a), int(b)) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def unlike(block: Block, stretches: Stretches, length: int) -> np.ndarray:
    """Of the stretches that share their anchor with others of the block, one for each content, and all others."""
    order = np.argsort(stretches.anchor, kind="stable")
    a = stretches.anchor[order]
    same = a[1:] == a[:-1]
    shared = order[np.append(False, same) | np.append(same, False)] if len(order) else order
    taken = np.ones(len(order), bool)
    seen: set[bytes] = set()
    for i, o, s, n in zip(shared.tolist(), stretches.owner[shared].tolist(), stretches.start[shared].tolist(), stretches.windows[shared].tolist(), strict=True):
        digest = xxhash.xxh3_128_digest(block.texts[o][s : s + n + length - 1])
        taken[i] = digest not in seen
        seen.add(digest)
    return np.flatnonzero(taken)


class Apart:
    """The windows of hot stretches of a block, by their hashes; of equal ones the earliest comes first."""

    def __init__(self, block: Block, stretches: Stretches, hot: np.ndarray, shards: int, length: int):
        hashes, checks, owner, start = [], [], [], []
        for o in np.unique(stretches.owner[hot]).tolist():
            mine = hot[stretches.owner[hot] == o]
            n = stretches.windows[mine]
            at = np.repeat(stretches.start[mine] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
            text = block.texts[o]
            halves = np.frombuffer(b"".join([xxhash.xxh3_128_digest(text[a : a + length]) for a in at.tolist()]), U).reshape(-1, 2)
            hashes.append(halves[:, 0])
            checks.append(halves[:, 1])
            owner.append(np.full(len(at), o))
            start.append(at)
        join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        hashes, checks, owner, start = join(hashes, np.uint64), join(checks, np.uint64), join(owner, np.int64), join(start, np.int64)
        ids = block.ids[owner]
        order = np.lexsort((start, ids, checks, hashes))
        self.hash, self.check, self.owner, self.start, self.ids = (x[order] for x in (hashes, checks, owner, start, ids))
        self.group, self.first, self.later = later_of_equal(self.hash, self.check, self.ids, self.start)
        shard = ((self.hash[self.first] >> U(32)) * U(shards)) >> U(32)
        edges = np.append(np.flatnonzero(np.append(True, shard[1:] != shard[:-1])), len(shard)) if len(shard) else np.zeros(0, int)
        self.ranges = [(int(shard[a]), int(a), int(b)) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def later_of_equal(hashes: np.ndarray, checks: np.ndarray, ids: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For sorted windows: their groups of equal ones, the groups' first places, and which are at a later position than the first."""
    new = np.append(True, (hashes[1:] != hashes[:-1]) | (checks[1:] != checks[:-1])) if len(hashes) else np.zeros(0, bool)
    group, first = np.cumsum(new) - 1, np.flatnonzero(new)
    at = first[group] if len(first) else first
    return group, first, (ids != ids[at]) | (start != start[at])


def resolve_apart(payloads: list[bytes]) -> list[bytes]:
    """Which windows of each message have an earlier copy in another block."""
    parts = [rounds.unpack(p, np.uint64, np.uint64, np.int64, np.int64) for p in payloads]
    hashes, checks, ids, start = (np.concatenate([p[i] for p in parts]) for i in range(4))
    order = np.lexsort((start, ids, checks, hashes))
    later = np.zeros(len(ids), bool)
    later[order] = later_of_equal(hashes[order], checks[order], ids[order], start[order])[2]
    return [rounds.pack(np.packbits(x)) for x in np.split(later, np.cumsum([len(p[0]) for p in parts])[:-1])]


def factors(position: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Longest previous factors of suffixes in suffix order, from their positions and each one's common prefix with the one before.

    A suffix's longest previous factor is the longer of its common prefixes with the previous and the next suffix in that order that
    start at a smaller position. Both are found by jumping over larger positions, and what lies between gives the least common prefix.
    """
    best = np.zeros(len(position), np.int64)
    for backward in (True, False):
        p = position if backward else position[::-1]
        low = common.copy() if backward else np.append(0, common[:0:-1])
        to = np.arange(len(p)) - 1
        open_ = np.flatnonzero(to >= 0)
        while len(open_ := open_[p[to[open_]] >= p[open_]]):
            low[open_] = np.minimum(low[open_], low[to[open_]])
            to[open_] = to[to[open_]]
            open_ = open_[to[open_] >= 0]
        found = np.where(to >= 0, low, 0)
        np.maximum(best, found if backward else found[::-1], out=best)
    return best


def leading_bytes(x: np.ndarray) -> np.ndarray:
    """The number of leading zero bytes of 64-bit numbers."""
    return sum(((x >> U(8 * k)) == 0).astype(np.int64) for k in range(8))


def suffix_order(words: np.ndarray, at: np.ndarray, position: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of suffixes in order of their first ``length`` bytes, then of position, and the common prefix (``length`` at most) with the one before.

    ``words`` are the eight bytes from each byte on and ``at`` is where each suffix starts. Suffixes are sorted by eight bytes at a time,
    and those that differ from both neighbours have their place and leave the sort.
    """
    order = np.arange(len(at))
    common = np.zeros(len(at), np.int64)
    live, group = order.copy(), np.zeros(len(at), np.int64)
    for offset in [*range(0, length - 8, 8), max(0, length - 8)]:
        if not len(live):
            break
        taken = order[live]
        key = words[at[taken] + offset]
        by = np.argsort(key, kind="stable") if offset == 0 else np.lexsort((key, group))
        order[live] = taken[by]
        key = key[by]
        same = group[1:] == group[:-1]
        apart = key[1:] ^ key[:-1]
        split = same & (apart != 0)
        common[live[1:][split]] = offset + leading_bytes(apart[split])
        group = np.cumsum(np.append(False, ~same | split))
        several = (np.bincount(group) > 1)[group]
        live, group = live[several], group[several]
    if len(live):
        taken = order[live]
        order[live] = taken[np.lexsort((position[taken], group))]
        common[live[1:][group[1:] == group[:-1]]] = length
    return order, common


def previous_factors(stretches: list[bytes], positions: np.ndarray, length: int) -> list[np.ndarray]:
    """For stretches with distinct first positions: the longest previous factor, ``length`` at most, of each of their windows in any of them."""
    sizes = np.array([len(s) for s in stretches], np.int64)
    raw = np.frombuffer(b"".join(stretches) + bytes(8), np.uint8)
    words = np.zeros(len(raw) - 8, np.uint64)
    for i in range(min(8, length)):
        words |= raw[i : len(raw) - 8 + i].astype(np.uint64) << U(56 - 8 * i)
    windows = sizes - length + 1
    nth = np.arange(int(windows.sum())) - np.repeat(np.cumsum(windows) - windows, windows)
    position = np.repeat(positions, windows) + nth
    order, common = suffix_order(words, np.repeat(np.cumsum(sizes) - sizes, windows) + nth, position, length)
    out = np.empty(len(order), np.int64)
    out[order] = factors(position[order], common)
    return np.split(out, np.cumsum(windows)[:-1])


def later_copies(stretches: list[bytes], positions: np.ndarray, length: int) -> list[np.ndarray]:
    """Which windows of the stretches have an earlier copy: their longest previous factors reach ``length``."""
    return [f >= length for f in previous_factors(stretches, positions, length)]


def runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def repeats_itself(text: bytes, start: int, end: int, length: int, gram: int) -> bool:
    """Whether the stretch ``text[start:end]`` may hold a window twice.

    Its windows then overlap and repeat with a period, so the string of ``gram`` bytes from its last window's start,
    which lies in all windows of an uncut stretch, comes again after it; longer stretches always have a period.
    """
    last = end - length
    if last - start > length - gram:
        return True
    return last > start and text.find(text[last : last + gram], last + 1, end) >= 0


def resolver(length: int, gram: int):
    def resolve(rows: pd.DataFrame) -> pd.DataFrame:
        """For each message, the ranges of windows with an earlier copy: stretch, first window, end; for windows apart, a bit each."""
        apart = (rows["kind"] == rounds.ROWS + 1).to_numpy()
        if apart.any():
            taken, rest = rows[apart], rows[~apart]
            done = taken.assign(payload=resolve_apart(taken["payload"].tolist()))
            return pd.concat([done, resolve(rest)]) if len(rest) else done
        anchor, ids, start, row, nth, content = [], [], [], [], [], []
        for i, payload in enumerate(rows["payload"]):
            a, d, s, n, b = rounds.unpack(payload, np.uint64, np.int64, np.int64, np.int32, np.uint8)
            anchor.append(a)
            ids.append(d)
            start.append(s)
            row.append(np.full(len(a), i))
            nth.append(np.arange(len(a)))
            joined, ends = b.tobytes(), np.cumsum(n).tolist()
            content += [joined[x:y] for x, y in zip([0, *ends[:-1]], ends, strict=True)]
        anchor, ids, start, row, nth = map(np.concatenate, (anchor, ids, start, row, nth))
        order = np.lexsort((start, ids, anchor))
        found: list[list[tuple[int, int, int]]] = [[] for _ in range(len(rows))]
        a = anchor[order]
        edges = np.append(np.flatnonzero(np.append(True, a[1:] != a[:-1])), len(a)).tolist()
        picked: list[int] = []
        size = 0
        ties: dict[int, list[int]] = {}

        def sort_picked() -> None:
            by = np.lexsort((start[picked], ids[picked]))
            chosen = np.array(picked)[by]
            document = np.cumsum(np.append(False, ids[chosen][1:] != ids[chosen][:-1]))
            span = int(start[chosen].max()) + max(len(content[i]) for i in picked)
            flags = later_copies([content[i] for i in chosen], document * span + start[chosen], length)
            for i, f in zip(chosen.tolist(), flags, strict=True):
                for j in (i, *ties.get(i, ())):
                    found[row[j]] += [(int(nth[j]), p, q) for p, q in runs(f)]

        order = order.tolist()
        for x, y in zip(edges[:-1], edges[1:], strict=True):
            first: dict[bytes, int] = {}
            for i in order[x:y]:
                c = content[i]
                f = first.setdefault(c, i)
                if ids[f] < ids[i] or start[f] < start[i]:
                    found[row[i]].append((int(nth[i]), 0, len(c) - length + 1))
                elif f != i:
                    ties.setdefault(f, []).append(i)
            if len(first) > 1 or repeats_itself(c, 0, len(c), length, gram):
                picked += first.values()
                size += sum(map(len, first))
                if size > CHUNK:
                    sort_picked()
                    picked, size = [], 0
        if picked:
            sort_picked()
        answers = []
        for ranges in found:
            answers.append(rounds.pack(*(np.array([r[k] for r in sorted(ranges)], np.int32) for k in range(3))))
        return pd.DataFrame({"block": rows["block"], "kind": rows["kind"], "shard": rows["shard"], "payload": answers})

    return resolve


def widened(text: bytes, gone: np.ndarray) -> np.ndarray:
    """``gone`` with all bytes of the characters of which it has some."""
    character = np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)
    return (np.bincount(character, gone) > 0)[character]


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, carried: tuple[str, ...] = (), whole_characters: bool = False, most: int = rounds.HOT_ITEMS) -> DataFrame:
    """Per document its id, n_bytes, n_removed, n_spans, ``kept``, the remaining bytes joined, and its columns in ``carried``.

    Anchors with ``most`` unlike stretches are dealt out window by window; the results are the same. With ``whole_characters`` a character of which some bytes are removed goes as a whole from ``kept``, which then stays UTF-8; the counts are the same.
    """
    blocks, total = rounds.in_blocks(docs, id_col, text_col, carried)
    shards = rounds.shards_for(total // 6)

    def keys_of(block: Block) -> np.ndarray:
        s = Stretches(block, length, gram)
        places = zip(s.owner.tolist(), s.start.tolist(), (s.windows + length - 1).tolist(), strict=True)
        twice = [i for i, (o, a, n) in enumerate(places) if repeats_itself(block.texts[o], a, a + n, length, gram)]
        keys = np.concatenate((s.anchor, s.anchor[twice])) if twice else s.anchor
        return keys, s.anchor[unlike(block, s, length)]

    def candidates(number: int, block: Block, answers: list) -> list:
        stretches = Stretches(block, length, gram)
        found = Candidates(block, stretches, answers, shards, length)
        out = []
        at = found.at[found.sent]
        sizes = np.array([len(b) for b in found.bytes], np.int32)
        for shard, a, b in found.ranges:
            content = np.frombuffer(b"".join(found.bytes[a:b]), np.uint8)
            payload = rounds.pack(stretches.anchor[at[a:b]], block.ids[stretches.owner[at[a:b]]], stretches.start[at[a:b]], sizes[a:b], content)
            out.append((number, rounds.ROWS, shard, payload))
        if len(found.hot):
            w = Apart(block, stretches, found.hot, shards, length)
            for shard, a, b in w.ranges:
                f = w.first[a:b]
                out.append((number, rounds.ROWS + 1, shard, rounds.pack(w.hash[f], w.check[f], w.ids[f], w.start[f])))
        return out

    def finish(block: Block, answers: list) -> pa.Table:
        stretches = Stretches(block, length, gram)
        found = Candidates(block, stretches, answers, shards, length)
        by = {shard: payload for kind, shard, payload in answers if kind == rounds.ROWS}
        covered = [np.zeros(len(t) + 1, np.int32) for t in block.texts]
        owner, start, windows = stretches.owner[found.at], stretches.start[found.at], stretches.windows[found.at]
        marks: list[np.ndarray] = []
        for shard, a, b in found.ranges:
            nth, p, q = rounds.unpack(by[shard], np.int32, np.int32, np.int32)
            i = found.sent[a + nth]
            marks.append(np.stack((i, p, q), axis=1))
        ranges = np.concatenate(marks) if marks else np.zeros((0, 3), np.int64)
        # what holds for the first of equal stretches holds for its later copies, which are also whole later copies
        whole = np.flatnonzero(found.earlier)
        tied = np.flatnonzero((found.first != np.arange(len(found.first))) & ~found.earlier)
        if len(tied):
            mine = {}
            for i, p, q in ranges.tolist():
                mine.setdefault(i, []).append((p, q))
            more = [(i, p, q) for i in tied.tolist() for p, q in mine.get(int(found.first[i]), ())]
            ranges = np.concatenate((ranges, np.array(more, np.int64).reshape(-1, 3)))
        ranges = np.concatenate((ranges, np.stack((whole, np.zeros(len(whole), np.int64), windows[whole]), axis=1)))
        for i, p, q in ranges.tolist():
            c, s = covered[owner[i]], start[i]
            c[s + p] += 1
            c[s + q - 1 + length] -= 1
        if len(found.hot):
            w = Apart(block, stretches, found.hot, shards, length)
            elsewhere = np.zeros(len(w.first), bool)
            replies = {shard: payload for kind, shard, payload in answers if kind == rounds.ROWS + 1}
            for shard, a, b in w.ranges:
                elsewhere[a:b] = np.unpackbits(rounds.unpack(replies[shard], np.uint8)[0], count=b - a)
            gone = elsewhere[w.group] | w.later
            for o in np.unique(w.owner[gone]).tolist():
                at = w.start[gone & (w.owner == o)]
                np.add.at(covered[o], at, 1)
                np.add.at(covered[o], at + length, -1)
        removed, spans, kept = [], [], []
        for text, c in zip(block.texts, covered, strict=True):
            gone = np.cumsum(c[:-1]) > 0 if c.any() else None
            if gone is None:
                removed.append(0)
                spans.append(0)
                kept.append(text)
            else:
                removed.append(int(gone.sum()))
                spans.append(int((gone & ~np.append(False, gone[:-1])).sum()))
                gone = widened(text, gone) if whole_characters else gone
                kept.append(np.frombuffer(text, np.uint8)[~gone].tobytes())
        count = lambda x: pa.array(x, pa.int64())
        ids = pa.array(block.ids, mask=block.missing)
        extra = dict(zip(carried, block.carried(len(carried)), strict=True))
        return pa.table({"id": ids, "n_bytes": count([len(t) for t in block.texts]), "n_removed": count(removed), "n_spans": count(spans), "kept": pa.array(kept, pa.binary()), **extra})

    schema = T.StructType([T.StructField("id", T.LongType()), *(T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")), T.StructField("kept", T.BinaryType()), *(docs.schema[c] for c in carried)])
    found = rounds.run(blocks, keys_of, candidates, resolver(length, gram), finish, schema, shards, most)
    return found.withColumnRenamed("id", id_col)


def digests(docs: DataFrame) -> DataFrame:
    """Per document: n_bytes, n_removed, n_spans and the digest of the remaining bytes."""
    return dedup(docs.select("doc_id", "text")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
