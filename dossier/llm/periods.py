"""Periodic runs of words: suffix trees of the words and of their reversal, constant-time common extensions on Euler tours, Lyndon roots extended both ways.

A run is a stretch of words with smallest period q whose length is at least `length` and `exponent` * q and that no neighbour extends. Each word of a run occurs
floor(exponent) times in it, so words that are rarer in their stretch can't be in any: they cut a text into stretches, again and again until all words of a stretch are
frequent enough. Nothing is lost by it, and only what may hold a run meets the trees. All stretches of a piece of the input, ended by separators of their own, are
one string; Ukkonen's algorithm builds its tree and that of the reversed string. Tours of the trees are ranked by pointer doubling, and a table of minima over the
depths along a tour gives the longest common extension of any two places at once. From the order of the suffixes, under the alphabet and under its reverse, follows the
longest Lyndon word at each place; each run has one of them as its root, so each is extended to both sides and kept if it is long enough.

Words: bytes between ASCII spaces, compared by 64-bit hashes within a text. A null or empty text has no words and no run. Texts may be of any length; repeated rows get
the same answer each; an empty table gives an empty one; other columns are ignored unless they are carried."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from dossier.llm import buffers as B
from dossier.llm.common import frugal, lines, prepare

#: Words that share a tree at most (a longer stretch has its own).
GROUP = 1 << 15


def suffix_tree(s: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Parent, first symbol and string depth of each node but the root (number 0), and the leaf of each suffix. s ends in a symbol that it has nowhere else."""
    n, width = len(s), max(s, default=0) + 1
    edges: dict[int, int] = {}
    begin, end, link, leaves = [0], [0], [0], []
    node = edge = length = left = 0
    for i, c in enumerate(s):
        left += 1
        inner = 0
        while left:
            if not length:
                edge = i
            key = node * width + s[edge]
            below = edges.get(key)
            if below is None:
                edges[key] = len(begin)
                at = node
            else:
                first = begin[below]
                size = end[below] - first
                if size > i + 1 - first:
                    size = i + 1 - first
                if length >= size:
                    edge += size
                    length -= size
                    node = below
                    continue
                if s[first + length] == c:
                    length += 1
                    if inner:
                        link[inner] = node
                    break
                at = len(begin)
                begin.append(first)
                end.append(first + length)
                link.append(0)
                edges[key] = at
                begin[below] = first + length
                edges[at * width + s[first + length]] = below
                edges[at * width + c] = at + 1
            if inner:
                link[inner] = at
            inner = at if below is not None else 0
            leaves.append(len(begin))
            begin.append(i)
            end.append(n)
            link.append(0)
            left -= 1
            if node:
                node = link[node]
            elif length:
                length -= 1
                edge = i - left + 1
    keys, child = np.fromiter(edges.keys(), np.int64, len(edges)), np.fromiter(edges.values(), np.int64, len(edges))
    parent, symbol = np.zeros(len(begin), np.int64), np.zeros(len(begin), np.int64)
    parent[child], symbol[child] = keys // width, keys % width
    return parent, symbol, np.array(end) - np.array(begin), np.array(leaves, np.int64)


def tour(parent: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """Place of each step of the Euler tour from the root: going down to node v is step v, going up from it step v + number of nodes. Children in the order of their symbols."""
    n = len(parent)
    order = np.lexsort((symbol[1:], parent[1:])) + 1
    same = parent[order[1:]] == parent[order[:-1]]
    follow = np.arange(2 * n)
    follow[:n] += n  # from a leaf up again
    follow[n + 1 :] = parent[1:] + n
    follow[n + order[:-1][same]] = order[1:][same]
    first = order[np.r_[True, ~same]] if len(order) else order
    follow[parent[first]] = first
    ahead = (follow != np.arange(2 * n)).astype(np.int32)  # all but the last step, up from the root
    while True:
        more = ahead[follow]
        if not more.any():
            return ahead[0] - ahead
        ahead = ahead + more
        follow = follow[follow]


class Extensions:
    """Longest common extensions to the right of any two places of s."""

    def __init__(self, s: list[int]):
        self.parent, self.symbol, edge, leaves = suffix_tree(s)
        place, n = tour(self.parent, self.symbol), len(self.parent)
        step = np.zeros(2 * n, np.int64)
        step[place[:n]], step[place[n:]] = edge, -edge
        depth = np.cumsum(step).astype(np.int32)
        self.leaves, self.at = leaves, place[leaves]
        self.rows = [depth]
        while 2 << len(self.rows) - 1 <= len(depth):
            half, low = 1 << len(self.rows) - 1, self.rows[-1]
            self.rows.append(np.minimum(low[:-half], low[half:]))
        self.width = max(len(r) for r in self.rows)

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        a, b = self.at[i], self.at[j]
        a, b = np.minimum(a, b), np.maximum(a, b)
        level = np.frexp(b - a + 1)[1] - 1
        out = np.zeros(len(i), np.int64)
        for k in np.unique(level).tolist():
            own = level == k
            out[own] = np.minimum(self.rows[k][a[own]], self.rows[k][b[own] - (1 << k) + 1])
        return out

    def ranks(self, ends: int) -> tuple[np.ndarray, np.ndarray]:
        """Ranks of the suffixes under the order of symbols and under its reverse; symbols below `ends` come first in both."""
        turned = np.where(self.symbol < ends, self.symbol, 2 * int(self.symbol.max(initial=0)) + 1 - self.symbol)
        other = tour(self.parent, turned)[self.leaves]
        return tuple(np.argsort(np.argsort(p)) for p in (self.at, other))


def next_smaller(rank: list[int]) -> list[int]:
    """For each place the next one whose rank is smaller (the length, if there is none)."""
    n = len(rank)
    out = [n] * n
    for i in range(n - 2, -1, -1):
        own, j = rank[i], i + 1
        while j < n and rank[j] > own:
            j = out[j]
        out[i] = j
    return out


def runs(words: np.ndarray, at: np.ndarray, length: int, exponent: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and period of each run of stretches of word numbers (from 0); at: where each begins, and the end."""
    m = len(at) - 1
    gap = np.arange(m)
    full = np.insert(words.astype(np.int64) + m + 1, at[1:], gap + 1)
    full = np.r_[0, full]  # separators 0 to m, each one once
    right, left = Extensions(full[1:].tolist()), Extensions(full[:-1][::-1].tolist())
    i, q = [], []
    for rank in right.ranks(m + 1):
        following = np.array(next_smaller(rank.tolist()), np.int64)
        i.append(np.arange(len(following)))
        q.append(following - i[-1])
    i, q = np.concatenate(i), np.concatenate(q)
    ok = (full[1:][i] > m) & (i + q < len(full) - 1)
    i, q = i[ok], q[ok]
    after = right(i, i + q)
    back = len(full) - 2 - i  # of the word before place i of full[1:], in the reversed string
    before = left(back, back - q)
    size = before + q + after
    ok = (size >= length) & (size >= exponent * q)
    found = np.unique(np.stack([i[ok] - before[ok], q[ok], size[ok]]), axis=1)
    stretch = np.searchsorted(at + np.arange(m + 1), found[0], "right") - 1  # a separator stands before all but the first
    return found[0] - stretch, found[2], found[1]


def frequent(words: np.ndarray, doc: np.ndarray, length: int, times: int) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the stretches in which each word occurs so often, each of one doc."""
    place, part = np.arange(len(words)), doc.astype(np.uint64)
    while True:
        before = len(place)
        _, inverse, count = np.unique(words[place] ^ B.mix(part + np.uint64(1)), return_inverse=True, return_counts=True)
        place = place[count[inverse] >= times]
        new = np.r_[True, (np.diff(place) > 1) | (doc[place[1:]] != doc[place[:-1]])] if len(place) else np.zeros(0, bool)
        number = np.cumsum(new) - 1
        enough = np.bincount(number, minlength=1)[number] >= length
        place, number = place[enough], number[enough]
        if len(place) == before or not len(place):
            new = np.r_[True, number[1:] != number[:-1]] if len(place) else new[:0]
            last = np.r_[new[1:], True] if len(place) else new[:0]
            return place[new], place[last] + 1
        part = number.astype(np.uint64)


def found(data: np.ndarray, at: np.ndarray, length: int, exponent: float) -> tuple[np.ndarray, ...]:
    """Of each text of data (ended by newlines): begin and end of its words, first word of each text, and start (word of the piece), length, period of its runs, by text, start, period."""
    begin, end = B.word_bounds(data)
    words, first = B.hashed_runs(data, begin, end), np.searchsorted(begin, at)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(first))
    a, b = frequent(words, doc, length, max(1, int(exponent))) if len(words) else (begin[:0], begin[:0])
    parts, i = [], 0
    size = np.r_[0, np.cumsum(b - a)]
    while i < len(a):
        j = max(i + 1, int(np.searchsorted(size, size[i] + GROUP, "right")) - 1)
        place = np.repeat(a[i:j] - (size[i:j] - size[i]), np.diff(size[i : j + 1])) + np.arange(size[j] - size[i])
        number = np.unique(words[place], return_inverse=True)[1]
        start, span, q = runs(number, size[i : j + 1] - size[i], length, exponent)
        parts.append((place[start], span, q))
        i = j
    start, span, q = (np.concatenate(c) for c in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 3
    order = np.lexsort((q, start))
    return begin, end, first, start[order], span[order], q[order]


def collapsed(data: np.ndarray, begin: np.ndarray, end: np.ndarray, first: np.ndarray, start: np.ndarray, span: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts without the words that a run holds after its first period, joined by spaces, and where each text's begin."""
    over = np.zeros(len(begin) + 1, np.int64)
    np.add.at(over, start + q, 1)
    np.add.at(over, start + span, -1)
    stay = np.cumsum(over)[:-1] == 0
    b, e = begin[stay], end[stay]
    doc = np.searchsorted(first, np.flatnonzero(stay), "right") - 1
    last = np.r_[doc[1:] != doc[:-1], True] if len(doc) else np.zeros(0, bool)
    text, mark = data.copy(), np.zeros(len(data) + 1, np.int8)
    text[e] = 32
    mark[b] += 1
    np.add.at(mark, e + ~last, -1)
    size = np.bincount(doc, e - b + ~last, len(first) - 1).astype(np.int64)
    return text[np.cumsum(mark[:-1], dtype=np.int8) > 0], np.r_[0, np.cumsum(size)]


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _run(carried: list[str], length: int, exponent: float):
    def run(batches):
        for batch in batches:
            data, at = B.column(batch["text"])
            for i, j in B.pieces(at):
                part = data[at[i] : at[j]]
                begin, end, first, start, span, q = found(part, at[i : j + 1] - at[i], length, exponent)
                text, ends = collapsed(part, begin, end, first, start, span, q)
                doc = np.searchsorted(first, start, "right") - 1
                items = pa.StructArray.from_arrays([pa.array(x) for x in (start - first[doc], span, q)], fields=list(RUN))
                each = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(j - i + 1)).astype(np.int32)), items)
                kept = pa.StringArray.from_buffers(j - i, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(text.tobytes()))
                yield pa.RecordBatch.from_arrays([*(batch[c].slice(i, j - i) for c in carried), pa.array(np.diff(first)), each, kept], names=[*carried, "n_words", "runs", "collapsed"])

    return run


def periodic(docs: DataFrame, length: int = 6, exponent: float = 4, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns to carry, n_words, runs (array of start, length, period by start and period) and collapsed (the text without repetitions) of each row."""
    if exponent < 2:
        raise ValueError("a run holds its period twice at least")
    prepare(docs.sparkSession)
    rows = lines(docs, *carry)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.drop("text").schema)
    return rows.mapInArrow(frugal(_run(["doc_id", *carry], length, exponent)), f"{kinds}, n_words long, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")
