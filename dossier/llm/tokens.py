"""Token ids of whole texts, a batch at a time. A text falls into units that a tokenizer encodes one by one; each distinct unit is encoded once by the
tokenizers library, and numpy looks up the others by a 64-bit hash and compares their bytes. Texts with characters whose units are not told apart here go to the library whole."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from dossier.llm import buffers as B


def _heads(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The first eight bytes from each begin as a number; those beyond the size are 0."""
    words = np.ndarray(len(data), "<u8", np.r_[data, np.zeros(8, np.uint8)], strides=(1,))
    return words[begin] & (np.uint64((1 << 64) - 1) >> ((8 - np.clip(size, 0, 8)) * 8).astype(np.uint64)) * (size > 0)


class Units:
    """Hash of a unit -> its bytes and ids. encode gets the units that are new, as bytes. When the table is full it begins anew. Where two units have one hash, the
    units of that call are encoded one by one."""

    BITS = 21

    def __init__(self, encode: Callable[[list[bytes]], list]):
        self.encode = encode
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(1 << self.BITS, np.uint64)
        self.place = np.zeros(1 << self.BITS, np.int32)
        self.first, self.count, self.ids, self.n, self.used = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32), np.zeros(1 << 18, np.uint16), 0, 0
        self.begin, self.size, self.head, self.bytes, self.filled = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.uint64), np.zeros(1 << 20, np.uint8), 0

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Entry of each hash, or -1."""
        mask = (1 << self.BITS) - 1
        slot = (h >> np.uint64(64 - self.BITS)).astype(np.int64)
        seen = self.keys[slot]
        out = np.where(seen == h, self.place[slot], -1)
        open_ = np.flatnonzero((seen != h) & (seen != 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & mask
            seen = self.keys[slot[open_]]
            hit = seen == h[open_]
            out[open_[hit]] = self.place[slot[open_[hit]]]
            open_ = open_[~hit & (seen != 0)]
        return out

    def _add(self, h: np.ndarray, units: list[bytes]) -> None:
        if (self.n + len(h)) > 0.6 * len(self.keys):
            self.clear()
        got = self.encode(units)
        count = np.array([len(x) for x in got], np.int32)
        flat = np.fromiter((i for x in got for i in x), np.int64, int(count.sum()))
        raw, size = np.frombuffer(b"".join(units), np.uint8), np.array([len(u) for u in units])
        while self.n + len(h) > len(self.first):
            self.first, self.count, self.begin, self.size, self.head = (np.r_[x, np.zeros_like(x)] for x in (self.first, self.count, self.begin, self.size, self.head))
        while self.filled + len(raw) > len(self.bytes):
            self.bytes = np.r_[self.bytes, np.zeros_like(self.bytes)]
        if len(flat) and flat.max() > np.iinfo(self.ids.dtype).max:
            self.ids = self.ids.astype(np.uint32)
        while self.used + len(flat) > len(self.ids):
            self.ids = np.r_[self.ids, np.zeros_like(self.ids)]
        own = np.arange(self.n, self.n + len(h))
        self.first[own], self.count[own] = self.used + np.cumsum(count) - count, count
        self.ids[self.used : self.used + len(flat)] = flat
        self.begin[own], self.size[own], self.head[own] = self.filled + np.cumsum(size) - size, size, _heads(raw, np.cumsum(size) - size, size)
        self.bytes[self.filled : self.filled + len(raw)] = raw
        self.n, self.used, self.filled = self.n + len(h), self.used + len(flat), self.filled + len(raw)
        slot, mask, left = (h >> np.uint64(64 - self.BITS)).astype(np.int64), (1 << self.BITS) - 1, np.arange(len(h))
        while len(left):
            free = left[self.keys[slot[left]] == 0]
            _, one = np.unique(slot[free], return_index=True)
            put = free[one]
            self.keys[slot[put]], self.place[slot[put]] = h[put], own[put]
            left = left[~np.isin(left, put)]
            slot[left] = (slot[left] + 1) & mask

    def _same(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray, entry: np.ndarray) -> bool:
        """Whether each entry is that of just these bytes: the first eight as one number, then the others one by one."""
        size = end - begin
        if not ((self.size[entry] == size) & (self.head[entry] == _heads(data, begin, size))).all():
            return False
        long = np.flatnonzero(size > 8)
        begin, entry, size = begin[long] + 8, entry[long], size[long] - 8
        before = np.cumsum(size) - size
        step = np.arange(size.sum())
        return bool((data[np.repeat(begin - before, size) + step] == self.bytes[np.repeat(self.begin[entry] + 8 - before, size) + step]).all())

    def _one_by_one(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = data.tobytes()
        units = [raw[a:b] for a, b in zip(begin.tolist(), end.tolist(), strict=True)]
        distinct = list(dict.fromkeys(units))
        ids = dict(zip(distinct, self.encode(distinct), strict=True))
        return np.array([i for u in units for i in ids[u]], np.uint32), np.array([len(ids[u]) for u in units], np.int64)

    def lookup(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the units data[b:e], one after another, and how many each unit has."""
        h = B.hashed_runs(data, begin, end) | np.uint64(1)
        entry = self._find(h)
        new = np.flatnonzero(entry < 0)
        if len(new):
            keys, one = np.unique(h[new], return_index=True)
            raw = data.tobytes()
            at = new[one]
            cleared = self.n + len(keys) > 0.6 * len(self.keys)
            if cleared and len(at) < len(np.unique(h)):
                self.clear()
                return self.lookup(data, begin, end)
            self._add(keys, [raw[a:b] for a, b in zip(begin[at].tolist(), end[at].tolist(), strict=True)])
            entry[new] = self._find(h[new])
        if not self._same(data, begin, end, entry):
            return self._one_by_one(data, begin, end)
        count = self.count[entry].astype(np.int64)
        ends = np.cumsum(count)
        return self.ids[np.repeat(self.first[entry] - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)], count


#: Classes of bytes: sentinel 0, white space 1, letters 2, digits 3, others 4.
CLASS = np.full(256, 4, np.uint8)
CLASS[[9, 10, 11, 12, 13, 32]] = 1
CLASS[65:91] = CLASS[97:123] = CLASS[0x80:0xC4] = 2
CLASS[48:58] = 3
#: Bytes of texts that the library gets whole: controls, the apostrophe (contractions) and characters above U+00FF.
ODD = np.ones(256, bool)
ODD[[9, 10, 11, 12, 13]] = ODD[32:127] = ODD[0x80:0xC0] = ODD[0xC3] = False
ODD[39] = True


def plain(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which texts have only ASCII and the letters U+00C0 to U+00FF."""
    bad = ODD[data]
    sign = np.flatnonzero(data == 0xC3) + 1
    bad[sign[(data[sign] == 0x97) | (data[sign] == 0xB7)]] = True
    sums = np.r_[0, np.cumsum(bad)]
    return sums[at[1:]] == sums[at[:-1]]


def _classes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    c = CLASS[data]
    c[at[1:] - 1] = 0
    return c, np.r_[np.uint8(0), c[:-1]]


def spaced_units(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of letters, digits or others, each with one space before it; what else there is of white space stands alone."""
    c, before = _classes(data, at)
    after = np.r_[c[1:], np.uint8(0)]
    joined = (before == 1) & (np.r_[np.uint8(0), data[:-1]] == 32)
    start = (c == 0) | ((c == 1) & ((before != 1) | (after >= 2))) | ((c >= 2) & (c != before) & ~joined)
    edge = np.flatnonzero(start)
    begin, end = edge[:-1], edge[1:]
    keep = c[begin] != 0
    return data, begin[keep], end[keep]


def lowered_units(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of letters or others in lower case, and single digits; no white space."""
    c, before = _classes(data, at)
    edge = np.flatnonzero((c != before) | (c == 3) | (c == 0))
    begin, end = edge[:-1], edge[1:]
    keep = c[begin] >= 2
    data = B.LOWER[data]
    high = np.flatnonzero((data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[:-1] == 0xC3)) + 1
    data[high] += 0x20
    return data, begin[keep], end[keep]


#: Bytes as the characters that byte-level vocabularies write for them: printable ones themselves, the others from U+0100 on.
_printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_CHARS = {b: chr(b) for b in _printable} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in _printable)}


class Encoder:
    """Ids of whole texts by a vocabulary file of the tokenizers library, byte-level with or without lower case and word ends."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True  # their strings in a text are text
        self.cut = spaced_units if isinstance(self.whole.pre_tokenizer, pre_tokenizers.ByteLevel) else lowered_units
        model = self.whole.model
        self.units = Units(lambda units: [[t.id for t in model.tokenize("".join(map(BYTE_CHARS.__getitem__, u)))] for u in units])

    def encode(self, data: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
        """Ids of each text; texts end in a newline that isn't encoded."""
        data, begin, end = self.cut(raw := data, at)
        fine = plain(raw, at)
        first = np.searchsorted(begin, at)
        if not fine.all():
            use = np.repeat(fine, np.diff(first))
            begin, end = begin[use], end[use]
            first = np.searchsorted(begin, at)
        ids, count = self.units.lookup(data, begin, end)
        ends = np.r_[0, np.cumsum(count)][first].tolist()
        out = [ids[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
        if not fine.all():
            odd = np.flatnonzero(~fine).tolist()
            texts = [raw[at[k] : at[k + 1] - 1].tobytes().decode("utf-8", "replace") for k in odd]
            for k, e in zip(odd, self.whole.encode_batch(texts, add_special_tokens=False), strict=True):
                out[k] = np.array(e.ids, np.uint32)
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker process: its units stay known from task to task."""
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = Encoder(path)
    return _encoders[path]
