"""Token ids in grammar-compressed files: Re-Pair over shards of documents in ascending doc_id order.

In a shard the most frequent id pairs become nonterminals, round after round, until no pair occurs LEAST times without overlap: from there on a rule takes as
much room as it saves. The rules, the length that each nonterminal expands to and where each document's symbols begin are stored beside the symbols, so a
document is decoded alone. No pair spans two documents.

A file set is a Parquet table with one row a shard (binary columns), written and read by Spark alone; texts are range-partitioned and sorted by doc_id, and a
task ends a shard after SHARD ids. Nulls: a null text is an empty one and has the end id only; null doc_ids come first. Rows of one doc_id follow one another
by their texts' hashes, then by the texts, and each is written; an empty table gives an empty one; other columns are ignored. A text of any length is one
document of one shard, which then has more than SHARD ids.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.llm import buffers as B
from dossier.llm import tokens
from dossier.llm.common import cut, lines, prepare, remove, shared_path

#: Ids of a shard. Occurrences from which a rule pays: it is two symbols and a length, and each occurrence saves one symbol.
SHARD, LEAST = 1 << 18, 4
_LAST = np.int32((1 << 31) - 1)


class _Sequence:
    """Symbols linked to their neighbours in the document, so that a replacement touches its neighbours only.

    Each place where a frequent pair begins knows the pair's number. A pair's occurrences all arise in one round and only get fewer, so pairs are sorted and
    counted once, when they arise; later counts are counts of numbers. `most` holds how often the pair of a place occurs, at most, and 0 where that is fewer
    than `least`: such a place is out of the game until a neighbour changes."""

    def __init__(self, ids: np.ndarray, starts: np.ndarray, least: int):
        n = len(ids)
        self.seq, self.least = ids.astype(np.uint32), least
        self.after, self.before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        self.before[starts] = -1
        self.after[np.r_[starts[1:], n][: len(starts)] - 1] = -1
        self.live, self.most, self.rank = np.ones(n, bool), np.zeros(n, np.int32), np.full(n + 1, _LAST)
        self.number, self.pairs, self.mark = np.zeros(n, np.int32), np.zeros(0, np.int64), np.zeros(n, bool)
        self.open: np.ndarray | None = None  # the places in the game, once they are few
        self.born(np.flatnonzero(self.after >= 0))

    def born(self, at: np.ndarray) -> None:
        """Numbers and counts the pairs of new places; those that occur too seldom stay out."""
        a, b = self.seq[at], self.seq[self.after[at]]
        # half as wide where it can be: sorting is most of the work
        keys = (a << 16) | b if len(a) and max(a.max(), b.max()) < 1 << 16 else (a.astype(np.int64) << 32) | b
        order = np.argsort(keys)
        keys = keys[order]
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][: len(keys)])
        n = np.diff(np.r_[first, len(keys)])
        often = n >= self.least
        first, n = first[often], n[often]
        at = at[order[np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())]]
        self.most[at] = np.repeat(n, n)
        self.number[at] = np.repeat(np.arange(len(self.pairs), len(self.pairs) + len(n)), n)
        place = order[first]
        self.pairs = np.r_[self.pairs, (a[place].astype(np.int64) << 32) | b[place]]
        if self.open is not None:
            self.open = np.sort(np.r_[self.open, at])

    def apart(self, at: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Which of the sorted places don't overlap an earlier one of the same pair: in a run of one symbol every other place."""
        twin = np.flatnonzero(((self.pairs >> 32) == (self.pairs & 0xFFFFFFFF))[own])
        out = np.ones(len(at), bool)
        if len(twin):
            place = at[twin]
            new = np.r_[True, (self.after[place[:-1]] != place[1:]) | (own[twin[1:]] != own[twin[:-1]])]
            step = np.arange(len(place)) - np.flatnonzero(new)[np.cumsum(new) - 1]
            out[twin[step % 2 == 1]] = False
        return out

    def round(self, level: int, first: int) -> np.ndarray | None:
        """Replaces pairs that occur `level` times or more. Where two overlap, the more frequent one has the place; a pair left with fewer places waits.
        The pairs replaced, or None if no pair occurs so often."""
        at = np.flatnonzero(self.most >= level) if self.open is None else self.open[self.most[self.open] >= level]
        if level == self.least and len(at) < len(self.seq) // 16:
            self.open = at
        own = self.number[at]
        fine = self.apart(at, own)
        n = np.bincount(own[fine], minlength=len(self.pairs))
        exact = n[own]
        self.most[at] = np.where(exact >= self.least, exact, 0)
        often = np.flatnonzero(n >= level)
        if not len(often):
            return None
        rank = np.empty(len(self.pairs), np.int32)
        rank[often[np.lexsort((self.pairs[often], -n[often]))]] = np.arange(len(often))
        use = fine & (exact >= level)
        at, own = at[use], own[use]
        mine = rank[own]
        self.rank[at] = mine
        wins = (mine < self.rank[self.after[at]]) & (mine < self.rank[self.before[at]])
        self.rank[at] = _LAST
        at, own = at[wins], own[wins]
        chosen = np.bincount(own, minlength=len(self.pairs)) >= level
        keep = chosen[own]
        at, own = at[keep], own[keep]
        gone = self.after[at]
        after = self.after[gone]
        self.seq[at] = (first + np.cumsum(chosen) - 1)[own]
        self.live[gone] = False
        self.after[at] = after
        self.before[after[after >= 0]] = at[after >= 0]
        left = self.before[at]
        left = left[left >= 0]
        self.most[at] = self.most[left] = self.most[gone] = 0
        pairs = self.pairs[chosen]
        self.mark[at] = True
        alone = left[~self.mark[left]]
        self.mark[at] = False
        if self.open is not None:
            self.open = self.open[self.most[self.open] > 0]
        self.born(np.r_[at[after >= 0], alone])
        return pairs


def compress(ids: np.ndarray, starts: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Symbols, where each document's begin, rules [nonterminal, 2], and the first nonterminal.

    Frequent pairs first: the count asked for halves from round to round down to `least`, where rounds go on until no pair occurs `least` times without
    overlap. A pair that reaches the count but loses places to a more frequent one is looked at again in the next round."""
    first = base = int(ids.max()) + 1 if len(ids) else 0
    s, rules = _Sequence(ids, starts, least), []
    level = int(s.most.max()) // 2 if len(ids) else 0
    while level:
        level = max(level, least)
        pairs = s.round(level, base)
        if pairs is not None:
            rules.append(np.stack([pairs >> 32, pairs & 0xFFFFFFFF], 1))
            base += len(pairs)
        elif level == least:
            break
        level //= 2
    return s.seq[s.live].astype(np.uint32), (np.r_[0, np.cumsum(s.live)][starts]).astype(np.int64), np.concatenate([np.zeros((0, 2), np.int64), *rules]).astype(np.uint32), first


def _lengths(rules: np.ndarray, first: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """How many ids each nonterminal stands for, and the rules by depth."""
    pair = rules.astype(np.int64) - first
    inner, pair = pair >= 0, np.maximum(pair, 0)
    size, todo, known, steps = np.zeros(len(rules), np.int64), np.arange(len(rules)), np.zeros(len(rules), bool), []
    while len(todo):
        ready = (~inner[todo] | known[pair[todo]]).all(1)
        now, todo = todo[ready], todo[~ready]
        size[now] = np.where(inner[now], size[pair[now]], 1).sum(1)
        known[now] = True
        steps.append(now)
    return size, steps


def expansions(rules: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids that all nonterminals stand for, one after another, and where each one's begin (one more: the end). All rules of a depth at once."""
    size, steps = _lengths(rules, first)
    pair = rules.astype(np.int64) - first
    inner, pair = pair >= 0, np.maximum(pair, 0)
    at = np.r_[0, np.cumsum(size)]
    flat = np.zeros(at[-1], np.uint32)
    for now in steps:
        begin = at[now]
        for side in (0, 1):
            p, own = pair[now, side], inner[now, side]
            flat[begin[~own]] = rules[now[~own], side]
            n = np.where(own, size[p], 1)
            m, ends = n[own], np.cumsum(n[own])
            step = np.arange(ends[-1] if len(ends) else 0)
            flat[np.repeat(begin[own] - (ends - m), m) + step] = flat[np.repeat(at[p[own]] - (ends - m), m) + step]
            begin = begin + n
    return flat, at


def expand(seq: np.ndarray, first: int, flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Ids of a sequence of symbols, of one document or of many."""
    rule = np.maximum(seq.astype(np.int64) - first, -1)
    table = np.concatenate([flat, seq[rule < 0].astype(np.uint32)])
    begin, size = np.empty(len(seq), np.int64), np.ones(len(seq), np.int64)
    begin[rule < 0] = len(flat) + np.arange((rule < 0).sum())
    begin[rule >= 0], size[rule >= 0] = at[rule[rule >= 0]], np.diff(at)[rule[rule >= 0]]
    ends = np.cumsum(size)
    return table[np.repeat(begin - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]


def narrow(x: np.ndarray) -> bytes:
    """The width of a number in one byte, then the numbers, little-endian in as few bytes as the largest takes."""
    top = int(x.max()) if len(x) else 0
    width = max(1, (top.bit_length() + 7) // 8)
    return bytes([width]) + np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def widen(x: bytes) -> np.ndarray:
    own = np.frombuffer(x, np.uint8, offset=1).reshape(-1, x[0])
    out = np.zeros((len(own), 8), np.uint8)
    out[:, : x[0]] = own
    return out.view("<u8").ravel().astype(np.int64)


SCHEMA = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("start", pa.int64()), ("n_ids", pa.int64()), ("first_rule", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_symbols", pa.binary()), ("rules", pa.binary()), ("lengths", pa.binary()), ("symbols", pa.binary())])
COLUMNS = "part int, shard int, start long, n_ids long, first_rule long, doc_ids array<long>, doc_symbols binary, rules binary, lengths binary, symbols binary"


def _shards(path: str, end_id: int):
    def run(batches):
        encoder = tokens.encoder(path)
        held, docs, n, start, shard, part = [], [], 0, 0, 0, 0

        def out():
            ids, starts = np.concatenate(held), np.cumsum([0, *map(len, held)])[:-1]
            seq, starts, rules, first = compress(ids, starts)
            row = [part, shard, start, len(ids), first, list(docs), narrow(starts), narrow(rules.ravel()), narrow(_lengths(rules, first)[0]), narrow(seq)]
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, SCHEMA, strict=True)], schema=SCHEMA)

        for batch in batches:
            data, at = B.column(batch["text"])
            part = batch["part"][0].as_py() if batch.num_rows else part
            for i, j in B.pieces(at):
                got = encoder.encode(data[at[i] : at[j]], at[i : j + 1] - at[i])
                for doc, ids in zip(batch["doc_id"].slice(i, j - i).to_pylist(), got, strict=True):
                    held.append(np.append(ids, ids.dtype.type(end_id)))
                    docs.append(doc)
                    n += len(ids) + 1
                    if n >= SHARD:
                        yield out()
                        start, shard, held, docs, n = start + n, shard + 1, [], [], 0
        if held:
            yield out()

    return run


def write(docs: DataFrame, folder: str, path: str, end_id: int) -> None:
    """The documents' ids in ascending doc_id order, as shards under folder."""
    spark = prepare(docs.sparkSession)
    n = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = ["doc_id", F.xxhash64("text")]
    rows = lines(docs).repartitionByRange(n, *order).sortWithinPartitions(*order, "text").withColumn("part", F.spark_partition_id())
    rows.mapInArrow(_shards(path, end_id), COLUMNS).write.parquet(folder)


def _decoded(batches):
    for batch in batches:
        for row in batch.to_pylist():
            rules, first = widen(row["rules"]).reshape(-1, 2), row["first_rule"]
            flat, at = expansions(rules, first)
            seq, starts = widen(row["symbols"]), widen(row["doc_symbols"])
            out, start = [], row["start"]
            size = np.ones(len(seq), np.int64)
            size[seq >= first] = widen(row["lengths"])[seq[seq >= first] - first]
            sums = np.r_[0, np.cumsum(size)]
            ids = expand(seq, first, flat, at).astype("<u4")
            for doc, a, b in zip(row["doc_ids"], starts, np.r_[starts[1:], len(seq)], strict=True):
                own = ids[sums[a] : sums[b]]
                out.append((row["part"], doc, start + int(sums[a]), len(own), zlib.crc32(own.tobytes())))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), *[pa.int64()] * 4), strict=True)], names=["part", "doc_id", "start", "n_tokens", "ids_crc32"])


def document(row: dict, k: int) -> np.ndarray:
    """The ids of the k-th document of a shard, by random access: only the rules that it uses are expanded."""
    starts, seq, rules, first = widen(row["doc_symbols"]), widen(row["symbols"]), widen(row["rules"]).reshape(-1, 2), row["first_rule"]
    own = seq[starts[k] : starts[k + 1] if k + 1 < len(starts) else len(seq)]
    while (rule := own >= first).any():
        n = 1 + rule
        at = np.cumsum(n) - n
        pairs = rules[own[rule] - first]
        own = np.repeat(own, n)
        own[at[rule]], own[at[rule] + 1] = pairs.T
    return own


def read(spark, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 of each document under folder."""
    shards = spark.read.schema(COLUMNS).parquet(folder)
    before, total = [], 0
    for r in sorted(shards.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()):
        before.append((r.part, total))
        total += r.n
    starts = spark.createDataFrame(before or [(0, 0)], "part int, before long")
    rows = shards.mapInArrow(_decoded, "part int, doc_id long, start long, n_tokens long, ids_crc32 long")
    return rows.join(F.broadcast(starts), "part").select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, path: str, end_id: int = 2, folder: str | None = None) -> DataFrame:
    """Writes the documents' ids and returns what the files hold. Without a folder of the caller's the files go once they are read."""
    spark, own = docs.sparkSession, folder or shared_path(docs.sparkSession, "grammar")
    write(docs, own, path, end_id)
    if folder:
        return read(spark, folder)
    out = cut(read(spark, own))
    remove(spark, own)
    return out
