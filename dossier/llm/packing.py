"""Best-fit packing of token sequences after Martello-Toth dominance reduction.

Lengths are at most the capacity, so the instance is a histogram of at most that many classes, whatever the number of documents; only it comes to the driver.
1. Reduction: of each size in turn, a set that provably dominates every other one with such a piece is fixed as often as it can be made: a full piece; a pair
   that fills a sequence; a piece that nothing fits with; with the largest that fits, where no two do or no two are larger; with the two that dominate all twos,
   where no three fit. Sizes are gone through again until nothing is fixed any more.
2. What remains is packed best-fit, largest first: the fullest sequence that takes a piece gets it. Sequences of one content are one pattern with a count.
3. Each piece gets its place by its rank within its length class, from one global sort whose key ends in doc_id and piece: no class is one task's work.

Nulls: a null text is an empty one and has the end id only; a null doc_id is packed like any other. Repeated rows are packed each; an empty table gives an
empty one; other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.llm import buffers as B
from dossier.llm import tokens
from dossier.llm.common import cut, frugal, lines, positions, prepare

Pattern = tuple[tuple[int, ...], int]


def dominating(left: dict[int, int], sizes: list[int], big: int, capacity: int) -> tuple[str, tuple[int, ...]] | None:
    """A set with one piece of size `big` that is at least as good as every other set that fits with it, and the rule that says so. sizes: those of left, ascending.

    A set is as good as another if its pieces, one to one, are as large as groups of the other's that they may stand for."""
    gap = capacity - big
    many = lambda k: left.get(k, 0) - (k == big)
    if not gap:
        return "full", (big,)
    if many(gap) > 0:  # whatever else fits is no more than this one piece
        return "exact", (big, gap)
    small: list[int] = []
    for k in sizes:
        small += [k] * min(3 - len(small), many(k))
        if len(small) == 3 or k > gap:
            break
    if not small or small[0] > gap:
        return "alone", (big,)
    fitting = [k for k in sizes[: bisect_right(sizes, gap)] if many(k) > 0] if sum(small) > gap or len(small) < 3 else []
    if not fitting:
        return None  # three or more may join, and no one set has the best of all of them
    most = fitting[-1]
    if len(small) == 1 or small[0] + small[1] > gap:
        return "one", (big, most)
    pairs = []
    for a in fitting:
        at = bisect_right(fitting, min(a, gap - a)) - 1
        if at >= 0 and fitting[at] == a and many(a) == 1:
            at -= 1
        if at >= 0:
            pairs.append((a, fitting[at]))
    if most >= max(a + b for a, b in pairs):
        return "one of two", (big, most)
    a, b = max(pairs)
    return ("two", (big, a, b)) if a == most and all(d <= b for _, d in pairs) else None


def reduction(counts: dict[int, int], capacity: int, tally: dict[str, int] | None = None) -> tuple[list[Pattern], dict[int, int]]:
    """Patterns that some best packing has, and the counts that remain. tally: gets the pieces that each rule has fixed.

    Every size is looked at in turn, from the largest down, and all again as long as something was fixed, since fewer pieces may join then. What dominates
    still does when equal sets are gone, so a set is fixed as often as it can be made."""
    left, fixed = {k: n for k, n in counts.items() if n > 0}, []
    sizes, before = sorted(left), None
    while before != (before := len(fixed)):
        for big in sizes[::-1]:
            while left.get(big) and (found := dominating(left, sizes, big, capacity)):
                rule, items = found
                times = min(left[x] // items.count(x) for x in items)
                fixed.append((items, times))
                if tally is not None:
                    tally[rule] = tally.get(rule, 0) + times * len(items)
                for x in set(items):
                    left[x] -= times * items.count(x)
                    if not left[x]:
                        del left[x]
                        sizes.pop(bisect_left(sizes, x))
    return fixed, left


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best-fit decreasing, whole classes at a time: a piece goes to the sequence with the least room that takes it, which then has the least room again. So of
    sequences of one room each is filled before the next, and at most one gets fewer copies than it could take."""
    rooms: list[tuple[int, int]] = []  # room, number of the group; sorted
    groups: list[tuple[tuple[int, ...], int]] = []

    def group(items: tuple[int, ...], times: int, room: int) -> None:
        groups.append((items, times))
        if room:
            insort(rooms, (room, len(groups) - 1))

    for x in sorted(counts, reverse=True):
        n = counts[x]
        while n:
            k = bisect_left(rooms, (x, -1))
            room, (items, times) = (rooms[k][0], groups[rooms[k][1]]) if k < len(rooms) else (capacity, ((), n))
            each = min(room // x, n)
            used = min(times, n // each)
            if k < len(rooms):
                _, g = rooms.pop(k)
                groups[g] = (items, 0)
                if used < times:
                    group(items, times - used, room)
            group(items + (x,) * each, used, room - each * x)
            n -= used * each
    return [(items, times) for items, times in groups if times]


class Plan:
    """Where the piece of a length and rank goes: segments of ranks of a length, each one place in the sequences of one pattern."""

    def __init__(self, patterns: list[Pattern]):
        segments, taken, base = [], {}, 0
        for items, times in patterns:
            offset = 0
            for x in items:
                begin = taken.get(x, 0)
                segments.append((x, begin, base, offset))
                taken[x] = begin + times
                offset += x
            base += times
        self.sequences = base
        s = np.array(sorted(segments), np.int64).reshape(-1, 4)
        self.length, self.begin, self.base, self.offset = s.T
        self.key = (self.length << 44) + self.begin

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.key, (length << 44) + rank, "right") - 1
        return self.base[at] + rank - self.begin[at], self.offset[at]


def _pieces(path: str, end_id: int, capacity: int):
    def run(batches):
        encoder = tokens.encoder(path)
        for batch in batches:
            data, at = B.column(batch["text"])
            for i, j in B.pieces(at):
                docs, out = batch["doc_id"].slice(i, j - i), []
                for k, ids in enumerate(encoder.encode(data[at[i] : at[j]], at[i : j + 1] - at[i])):
                    raw = np.append(ids.astype("<u4"), np.uint32(end_id)).astype("<u4").tobytes()
                    for p, a in enumerate(range(0, len(raw), 4 * capacity)):
                        own = raw[a : a + 4 * capacity]
                        out.append((k, p, a // 4, len(own) // 4, zlib.crc32(own)))
                k, *rest = np.array(out, np.int64).reshape(-1, 5).T
                yield pa.RecordBatch.from_arrays([docs.take(pa.array(k)), pa.array(rest[0].astype(np.int32)), *map(pa.array, rest[1:])], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def pieces(docs: DataFrame, path: str, end_id: int = 1, capacity: int = 4096) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each document's ids with the end id, cut where they are longer than the capacity."""
    prepare(docs.sparkSession)
    return lines(docs).mapInArrow(frugal(_pieces(path, end_id, capacity)), "doc_id long, piece int, start long, length long, ids_crc32 long")


def _placed(plan):
    def run(batches):
        for b in batches:
            s, o = plan.value.place(b["length"].to_numpy(), b["rank"].to_numpy())
            yield b.drop_columns(["rank"]).append_column("sequence_id", pa.array(s)).append_column("offset", pa.array(o))

    return run


def pack(docs: DataFrame, path: str, end_id: int = 1, capacity: int = 4096) -> DataFrame:
    """The pieces with sequence_id and offset."""
    spark = docs.sparkSession
    # cut first: a range partitioning reads its input twice, and texts are encoded once
    rows, _ = positions(cut(pieces(docs, path, end_id, capacity)), ["length", "doc_id", "piece"])
    per = rows.groupBy("part", "length").agg(F.count("*").alias("n"), F.min("pos").alias("low")).collect()  # as many as parts and lengths at most
    counts: dict[int, int] = {}
    shift = []
    for r in sorted(per):
        shift.append((r.part, r.length, counts.get(r.length, 0) - r.low))
        counts[r.length] = counts.get(r.length, 0) + r.n
    fixed, left = reduction(counts, capacity)
    plan = spark.sparkContext.broadcast(Plan(fixed + best_fit(left, capacity)))
    starts = spark.createDataFrame(shift or [(0, 0, 0)], "part int, length long, shift long")
    out = rows.join(F.broadcast(starts), ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("pos") + F.col("shift")).alias("rank"))
    return out.mapInArrow(_placed(plan), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
