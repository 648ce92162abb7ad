"""Toxicity behind a noisy channel: leetspeak, spaced-out and drawn-out letters are lattices; Viterbi finds their likeliest reading under a character model.

1. Trigram counts of all texts make the character model.
2. A text that holds a suspicious run of characters is read again: each run becomes a lattice (a sign stands for a letter or for nothing, a gap stays or goes,
   three equal letters are one or two), the best path replaces the run. Other texts have one path only and stay as they are.
3. From at most SAMPLE labelled texts of each kind (crc32 of the id modulo 3 not 1): in how many toxic and other texts each word beginning and word occurs. Its
   weight is the log of a low estimate of the one rate over a high estimate of the other; all that speak for toxic texts are kept.
4. A few monotonic trees turn a text's sum, share and maximum of weights into a score. In learning, a text's own count is taken off first.

Nulls and empty texts are texts without words; a text of any length is read whole; repeated rows get the same answer each; without labels of both kinds every
score is 0; an empty table gives an empty one; other columns are ignored, but for those that a caller asks to be carried.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.llm import buffers as B
from dossier.llm.common import frugal, labelled, lines, prepare, remainder
from dossier.llm.trees import Forest, boosted

#: Labelled texts of each kind that are learnt from, at most.
SAMPLE = 4000
#: Bytes of the word beginnings that are weighed, besides whole words.
PREFIXES = (3, 4, 5, 6, 7, 8)
#: Letters that a sign may stand for.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "+": "t"}
#: Characters of the runs whose readings a worker remembers, at most.
REMEMBERED = 100
#: Log costs: reading a sign as a letter, dropping it, closing a gap.
AS_LETTER, DROP, CLOSE = -1.0, -3.0, -1.0

_FOLD = np.zeros(256, np.int64)
_FOLD[65:91] = _FOLD[97:123] = np.arange(1, 27)
_FOLD[128:] = 27
_LETTER = _FOLD > 0
_SIGN = np.zeros(256, bool)
_SIGN[[ord(c) for c in LEET]] = True
_GAP = np.zeros(256, bool)
_GAP[[ord(c) for c in " .-_*"]] = True
_LOWER = B.LOWER.copy()
_LOWER[0x80:0x9F] += 0x20  # the second byte of accented capitals
_CODES = B.CODES[_LOWER]

#: Runs that become lattices: single letters and signs with gaps between, words of letters and signs, three equal letters.
RUNS = re.compile(r"(?<![a-z0-9@$!+])[a-z0-9@$!+](?:[ .\-_*]{1,3}[a-z0-9@$!+](?![a-z0-9@$!+])){2,}|(?<![a-z0-9@$!+])[a-z]*(?:[0-9@$!+][a-z0-9@$!+]*[a-z0-9@$]|[0-9@$])|(?<![a-z])[a-z]*([a-z])\1\1[a-z]*")
_ASCII = np.zeros(256, bool)
_ASCII[65:91] = _ASCII[97:123] = True
_TOKEN = _ASCII.copy()
_TOKEN[[ord(c) for c in "0123456789@$!+"]] = True


def trigrams(batches):
    n = np.zeros(28**3, np.int64)
    for batch in batches:
        data, _ = B.column(batch["text"])
        for i in range(0, len(data), B.CHUNK):
            s = _FOLD[data[i : i + B.CHUNK]]
            n += np.bincount((s[:-2] * 28 + s[1:-1]) * 28 + s[2:], minlength=28**3)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(28**3, dtype=np.int32)), pa.array(n)], names=["gram", "n"])


def character_model(docs: DataFrame) -> np.ndarray:
    """Log chances [two before, one before, letter], from all texts of docs."""
    n = np.zeros(28**3)
    for r in lines(docs).select("text").mapInArrow(trigrams, "gram int, n long").where("n > 0").groupBy("gram").agg(F.sum("n").alias("n")).collect():
        n[r.gram] = r.n
    n = n.reshape(28, 28, 28) + 0.1
    return np.log(n / n.sum(2, keepdims=True))


def lattice(run: str) -> list[list[tuple[str, float]]]:
    """For each place of a run its readings and their costs."""
    out: list[list[tuple[str, float]]] = []
    for m in re.finditer(r"([a-z])\1{2,}|.", run, re.S):
        c = m[0][0]
        if len(m[0]) > 1:
            out += [[(c, 0.0)], [(c, 0.0), ("", 0.0)]]
        elif c in LEET:
            out.append([*((x, AS_LETTER) for x in LEET[c]), ("", DROP)])
        elif c in " .-_*":
            out.append([(" ", 0.0), ("", CLOSE)])
        else:
            out.append([(c, 0.0)])
    return out


def viterbi(places: list[list[tuple[str, float]]], model: np.ndarray) -> str:
    """The likeliest reading. A state is the last two letters and keeps its better path, the first one among equals; paths share their beginnings, so a run of any length is read in linear time."""
    code = lambda c: ord(c) - 96 if "a" <= c <= "z" else 0 if c == " " else 27
    states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    for readings in places:
        after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (score, path) in states.items():
            for c, cost in readings:
                key, s = ((a, b), score + cost) if not c else ((b, x := code(c)), score + cost + model[a, b, x])
                if key not in after or s > after[key][0]:
                    after[key] = (s, (path, c) if c else path)
        states = after
    path, letters = max(((s + model[a, b, 0], p) for (a, b), (s, p) in states.items()), key=lambda x: x[0])[1], []
    while path:
        path, c = path
        letters.append(c)
    return "".join(reversed(letters))


def restorer(model: np.ndarray):
    """text -> text with its suspicious runs read anew."""

    def read(run: str) -> str:
        if not any("a" <= c <= "z" for c in run):
            return run
        return viterbi(lattice(run), model)

    often = lru_cache(1 << 16)(read)
    return lambda text: RUNS.sub(lambda m: (often if len(m[0]) <= REMEMBERED else read)(m[0]), text.lower())


def suspicious(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which texts hold a run that RUNS matches and that has more than one reading (and perhaps a few others)."""
    low, n = _LOWER[data], len(data)
    letters, signs, gaps = (np.r_[0, np.cumsum(m[data])] for m in (_ASCII, _SIGN, _GAP))
    edge = np.flatnonzero(np.diff(np.r_[False, _TOKEN[data], False].view(np.int8)))
    begin, end = edge[::2], edge[1::2]
    lettered = letters[end] > letters[begin]
    odd = begin[lettered & (signs[end] > signs[begin])]
    if len(begin) > 2:
        wide = begin[1:] - end[:-1]
        near = (end[:-1] - begin[:-1] == 1) & (end[1:] - begin[1:] == 1) & (wide <= 3) & (gaps[begin[1:]] - gaps[end[:-1]] == wide)
        odd = np.r_[odd, begin[:-2][near[:-1] & near[1:] & (lettered[:-2] | lettered[1:-1] | lettered[2:])]]
    if n > 2:
        odd = np.r_[odd, np.flatnonzero(_ASCII[data[:-2]] & (low[:-2] == low[1:-1]) & (low[1:-1] == low[2:]))]
        odd = np.r_[odd, np.flatnonzero((data[:-1] == 0xC4) & (data[1:] == 0xB0)), np.flatnonzero((data[:-2] == 0xE2) & (data[1:-1] == 0x84) & (data[2:] == 0xAA))]  # their lower case is ASCII
    out = np.zeros(len(at) - 1, bool)
    out[np.searchsorted(at, odd, "right") - 1] = True
    return out


def restored(data: np.ndarray, at: np.ndarray, restore) -> tuple[np.ndarray, np.ndarray]:
    odd = suspicious(data, at)
    if not odd.any():
        return data, at
    parts = [data[a:b].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    for k in np.flatnonzero(odd):
        parts[k] = restore(parts[k].decode("utf-8", "replace")).encode("utf-8", "replace").rstrip(b"\n") + b"\n"
    return np.frombuffer(b"".join(parts), np.uint8), np.r_[0, np.cumsum([len(p) for p in parts])]


def beginnings(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """[words, kinds] hashes of each word's beginnings and of the word, 0 for a beginning that is longer than the word; the first word of each text. Words here are runs of letters."""
    letter = _LETTER[data]
    edge = np.flatnonzero(letter[1:] != letter[:-1]) + 1
    edge = np.r_[0, edge] if len(letter) and letter[0] else edge
    begin, end = edge[::2], edge[1::2]
    out = np.zeros((len(begin), len(PREFIXES) + 1), np.uint64)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_CODES[data] * B.powers(B.BASE, len(data)), out=sums[1:])
        back = B.powers(B.INVERSE, len(data) + 1)[begin]
        for k, width in enumerate(PREFIXES):
            fits = end - begin > width
            out[fits, k] = B.mix((sums[begin[fits] + width] - sums[begin[fits]]) * back[fits] + np.uint64(width))
        out[:, -1] = B.mix((sums[end] - sums[begin]) * back + (end - begin + 1000).astype(np.uint64))
    return out, np.searchsorted(begin, at)


def _stem_counts(shared):
    def run(batches):
        restore = restorer(shared.value)
        held, kinds = [], []
        for batch in batches:
            data, at = B.column(batch["text"])
            label = batch["label"].to_numpy()
            for i, j in B.pieces(at):
                keys, first = beginnings(*restored(data[at[i] : at[j]], at[i : j + 1] - at[i], restore))
                for k in range(j - i):
                    own = np.unique(keys[first[k] : first[k + 1]])
                    held.append(own)
                    kinds.append(np.full(len(own), label[i + k], np.int64))
        if held:
            k, back = np.unique(np.concatenate(held), return_inverse=True)
            toxic = np.concatenate(kinds)
            t = np.bincount(back, toxic, len(k)).astype(np.int64)
            n = np.bincount(back, minlength=len(k))
            for i in range(0, len(k), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 50_000]) for x in (k.view(np.int64), t, n - t)], names=["key", "t", "c"])

    return run


class Stems:
    """Weights of word beginnings: in how many of how many toxic and other texts they occur."""

    def __init__(self, keys: np.ndarray, t: np.ndarray, c: np.ndarray, toxic: int, clean: int):
        order = np.argsort(keys)
        self.keys, self.t, self.c, self.toxic, self.clean = keys[order], t[order].astype(float), c[order].astype(float), max(1, toxic), max(1, clean)

    def weight(self, t: np.ndarray, c: np.ndarray) -> np.ndarray:
        low, high = np.maximum(t - 1.5 * np.sqrt(np.maximum(t, 0)), 1e-9) / self.toxic, (c + 1 + 1.5 * np.sqrt(np.maximum(c + 1, 0))) / self.clean
        w = np.log(low / high)
        return np.where((t >= 3) & (w > 0.7), w, 0)

    def facts(self, data: np.ndarray, at: np.ndarray, own: np.ndarray | None = None) -> np.ndarray:
        """For each text: log of the sum of weights, log of their share of words, the largest weight, words that have any. own: labels of texts that were counted."""
        keys, first = beginnings(data, at)
        n = np.diff(first)
        best = np.zeros(len(keys))
        if len(self.keys) and len(keys):
            doc = np.repeat(np.arange(len(n)), n)
            for k in range(keys.shape[1]):
                place = np.minimum(np.searchsorted(self.keys, keys[:, k]), len(self.keys) - 1)
                hit = np.flatnonzero((self.keys[place] == keys[:, k]) & (keys[:, k] != 0))
                t, c = self.t[place[hit]], self.c[place[hit]]
                if own is not None:
                    mine = own[doc[hit]]
                    t, c = t - mine, c - (1 - mine)
                best[hit] = np.maximum(best[hit], self.weight(t, c))
        sums, hits = np.diff(np.r_[0, np.cumsum(best)][first]), np.diff(np.r_[0, np.cumsum(best > 0)][first])
        most = np.array([best[a:b].max() if b > a else 0 for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)])
        return np.stack([np.log1p(np.maximum(sums, 0)), np.log1p(100 * np.maximum(sums, 0) / np.maximum(n, 1)), most, np.minimum(hits, 20)], 1)


def _training_facts(model, stems):
    def run(batches):
        restore = restorer(model.value)
        for batch in batches:
            data, at = B.column(batch["text"])
            label = batch["label"].to_numpy()
            for i, j in B.pieces(at):
                x = stems.value.facts(*restored(data[at[i] : at[j]], at[i : j + 1] - at[i], restore), label[i:j])
                yield pa.RecordBatch.from_arrays([pa.array(label[i:j]), *(pa.array(x[:, k]) for k in range(4))], names=["label", "a", "b", "c", "d"])

    return run


def fit(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> tuple[np.ndarray, Stems, Forest | None]:
    sc = docs.sparkSession.sparkContext
    model = character_model(docs)
    shared = sc.broadcast(model)
    some = labelled(docs, labels, "toxic", remainder(3) != 1, bound).select("label", F.concat("text", F.lit("\n")).alias("text"))
    sizes = dict(some.groupBy("label").count().collect())
    counts = some.mapInArrow(frugal(_stem_counts(shared)), "key long, t long, c long").groupBy("key").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    table = counts.where(f"t >= 3 and t * {sizes.get(0, 0)} > 2 * c * {sizes.get(1, 0)}").toPandas()  # of the words of at most 2 * bound texts
    stems = Stems(table["key"].to_numpy(np.int64).view(np.uint64), table["t"].to_numpy(), table["c"].to_numpy(), sizes.get(1, 0), sizes.get(0, 0))
    if len(sizes) < 2:
        return model, stems, None
    rows = some.mapInArrow(_training_facts(shared, sc.broadcast(stems)), "label int, a double, b double, c double, d double").toPandas().sort_values(["label", "a", "b", "c", "d"])
    return model, stems, boosted(rows[["a", "b", "c", "d"]].to_numpy(), rows["label"].to_numpy(float), np.array([1, 1, 1, 1]), trees=40, depth=3, rate=0.2)


def _score(shared, carried: list[str]):
    def run(batches):
        model, stems, forest = shared.value
        restore = restorer(model)
        for batch in batches:
            data, at = B.column(batch["text"])
            for i, j in B.pieces(at):
                p = forest.probability(stems.facts(*restored(data[at[i] : at[j]], at[i : j + 1] - at[i], restore)))
                yield pa.RecordBatch.from_arrays([*(batch[c].slice(i, j - i) for c in carried), pa.array(p)], names=[*carried, "score"])

    return run


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, bound: int = SAMPLE, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, score, predicted and the columns to carry of each row."""
    spark = prepare(docs.sparkSession)
    fitted = fit(docs, labels, bound)
    rows = lines(docs, *carry)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.drop("text").schema)
    scored = rows.mapInArrow(frugal(_score(spark.sparkContext.broadcast(fitted), ["doc_id", *carry])), f"{kinds}, score double") if fitted[2] else rows.select("doc_id", *carry, F.lit(0.0).alias("score"))
    return scored.select("doc_id", (remainder(3) == 1).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *carry)
