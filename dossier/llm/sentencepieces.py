"""SentencePiece encoding and decoding by batched numpy Viterbi over a model file's pieces and scores.

A text falls into units (a run of spaces with what follows it) that no piece spans, so their best paths are the text's. New units of one length advance
together: for each end and each piece length a substring hash of all of them probes the sorted piece keys, the better score wins, and backpointers are kept as
arrays. A character without a piece costs ten less than the worst piece and is written as byte pieces. Scores and ties are those of the library's unigram
decoder (single precision, the earliest begin wins).

Nulls: a null text is an empty one without ids; a text of any length is encoded whole; repeated rows get the same answer each; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.llm import buffers as B
from dossier.llm.common import prepare
from dossier.llm.tokens import Units

BASE = np.uint64(0x9E3779B97F4A7C15)
#: Units of one length that advance together, at most.
TOGETHER = 4096
#: Places of a unit whose pieces are probed at once.
STRETCH = 1 << 15


def _hash(points: np.ndarray) -> int:
    h = 0
    for p in points.tolist():
        h = (h * int(BASE) + p + 1) & (1 << 64) - 1
    return h


class Pieces:
    """Sorted keys of the pieces of a model file, their scores, and the bytes of all ids."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = [i for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        points = [np.array([ord(c) for c in model.id_to_piece(i)], np.uint64) for i in ids]
        keys = np.array([_hash(p) for p in points], np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array(ids, np.int32)[order]
        self.scores = np.array([model.get_score(i) for i in ids], np.float32)[order]
        self.longest = max(map(len, points))
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self.keys >> np.uint64(44)] = True
        self.unknown = np.float32(min(self.scores) - np.float32(10))
        self.bytes = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        own = [b"" if model.is_control(i) or model.is_unknown(i) else bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode() for i in range(model.vocab_size())]
        self.flat, self.at = np.frombuffer(b"".join(own), np.uint8), np.r_[0, np.cumsum([len(b) for b in own])]

    def _probed(self, sums: np.ndarray, power: np.ndarray, first: int, ends: int, widest: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores and ids of the pieces that end at each place from first to ends, the widest ones first; -inf where there is none, -1 for a character without a piece."""
        gain = np.full((widest, ends - first, sums.shape[1]), -np.inf, np.float32)
        found = np.full(gain.shape, -1, np.int32)
        gain[-1] = self.unknown
        for w in range(1, widest + 1):
            low = max(first, w)
            if low >= ends:
                break
            key = sums[low:ends] - sums[low - w : ends - w] * power[w]
            end, row = np.nonzero(self.maybe[key >> np.uint64(44)])
            key = key[end, row]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            place = (widest - w, end[hit] + low - first, row[hit])
            gain[place], found[place] = self.scores[at[hit]], self.ids[at[hit]]
        return gain, found

    def best(self, words: np.ndarray) -> list[list[int]]:
        """Ids of the best path of each row of code points."""
        n, size = words.shape
        sums = np.zeros((size + 1, n), np.uint64)
        power = B.powers(int(BASE), self.longest + 1)
        for k in range(size):
            sums[k + 1] = sums[k] * BASE + words[:, k] + np.uint64(1)
        score = np.zeros((size + 1, n), np.float32)
        width, piece = np.zeros((size + 1, n), np.int16), np.zeros((size + 1, n), np.int32)
        widest, every = min(self.longest, size), np.arange(n)
        for first in range(1, size + 1, STRETCH):
            ends = min(first + STRETCH, size + 1)
            gain, found = self._probed(sums, power, first, ends, widest)
            for end in range(first, ends):
                most = min(widest, end)
                reached = gain[widest - most :, end - first] + score[end - most : end]
                k = reached.argmax(0)  # the longest piece, which begins earliest, among equals
                score[end], width[end], piece[end] = reached[k, every], most - k, found[widest - most + k, end - first, every]
        out: list[list[int]] = [[] for _ in range(n)]
        at = np.full(n, size)
        rows = np.arange(n)
        while len(rows):
            p, w = piece[at[rows], rows], width[at[rows], rows]
            for r, i, a in zip(rows.tolist(), p.tolist(), at[rows].tolist(), strict=True):
                if i >= 0:
                    out[r].append(i)
                else:
                    out[r] += self.bytes[list(chr(int(words[r, a - 1])).encode("utf-8", "replace"))][::-1].tolist()
            at[rows] -= w
            rows = rows[at[rows] > 0]
        return [x[::-1] for x in out]

    def encode_units(self, units: list[bytes]) -> list[list[int]]:
        words = [np.frombuffer(u.decode("utf-8", "replace").replace(" ", "▁").encode("utf-32-le"), np.uint32) for u in units]
        size, out = np.array([len(w) for w in words]), [[] for _ in units]
        for s in np.unique(size):
            own = np.flatnonzero(size == s)
            step = max(1, TOGETHER * 32 // max(32, int(s)))
            for k in range(0, len(own), step):
                part = own[k : k + step].tolist()
                for u, ids in zip(part, self.best(np.stack([words[i] for i in part]).astype(np.uint64)), strict=True):
                    out[u] = ids
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes that ids stand for, without the space that encoding puts first."""
        size = np.diff(self.at)[ids]
        ends = np.cumsum(size)
        return self.flat[np.repeat(self.at[ids] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)].tobytes()[1:]


class Encoder:
    def __init__(self, path: str):
        self.pieces = Pieces(path)
        self.units = Units(self.pieces.encode_units)

    def encode(self, data: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
        """Ids of each text; texts begin with the space that is put before them (or are empty) and end in a newline that isn't encoded."""
        space = data == 32
        starts = space & ~np.r_[False, space[:-1]]
        starts[at[:-1]] = True
        begin = np.flatnonzero(starts)
        end = np.r_[begin[1:], len(data)]
        end = end - np.isin(end, at[1:])
        keep = end > begin
        begin, end = begin[keep], end[keep]
        ids, count = self.units.lookup(data, begin, end)
        ends = np.r_[0, np.cumsum(count)][np.searchsorted(begin, at)].tolist()
        return [ids[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _run(path: str):
    def run(batches):
        e = encoder(path)
        for batch in batches:
            data, at = B.column(batch["text"])
            for i, j in B.pieces(at):
                part, ends = data[at[i] : at[j]], at[i : j + 1] - at[i]
                got = e.encode(part, ends)
                same = [e.pieces.decode(ids) == part[a + 1 : b - 1].tobytes() for ids, a, b in zip(got, ends[:-1], ends[1:], strict=True)]
                raw = [ids.astype("<u4").tobytes() for ids in got]
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(i, j - i), pa.array([len(r) // 4 for r in raw], pa.int64()), pa.array([zlib.crc32(r) for r in raw], pa.int64()), pa.array(same), pa.array(raw, pa.binary())], names=["doc_id", "n_tokens", "ids_crc32", "round_trip", "ids"])

    return run


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_crc32, round_trip (decoding gives the text again), ids (little-endian, 4 bytes each) of each row."""
    prepare(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.concat(F.when(text != "", F.lit(" ")).otherwise(""), text, F.lit("\n")).alias("text"))
    return rows.mapInArrow(_run(path), "doc_id long, n_tokens long, ids_crc32 long, round_trip boolean, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text of rows of doc_id and ids."""

    def run(batches):
        e = encoder(path)
        for b in batches:
            texts = [e.pieces.decode(np.frombuffer(x or b"", "<u4")).decode("utf-8", "replace") for x in b["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(texts)], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
