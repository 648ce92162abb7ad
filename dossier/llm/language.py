"""Language identification by prediction by partial matching: a byte context tree for each language, orders 0 to 3, escapes of method C, frozen after learning.

The code length of a text under a language is exact: each byte is coded in the longest context that the tree has; where it was never seen there, an escape leads
to the next shorter one, where the symbols already seen above are excluded, and in the end to equal chances of the bytes that are left. A tree is three tables:
counts of a context's bytes, their totals, and how much of the shorter context's counts the longer one's bytes make up. What a context and a byte cost is worked
out once and remembered by each worker, so a text's length is a sum of remembered numbers.

Learnt from whole texts of at most BYTES bytes in all, as many of each language (the first by a hash of the id; crc32 of the id modulo 4 not 2; the last text of
a language may go over). A null text or one without a letter is `und`, score 0; a text may be of any length. Between equal code lengths the first language by
name wins. Repeated rows get the same answer each; without learning rows all is `und`; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.llm import buffers as B
from dossier.llm.common import cut, lines, prepare, remainder
from dossier.operators.order import within_budget

#: Bytes of the texts that are learnt from, over all languages; contexts with bytes whose costs a worker remembers (it begins anew when they are more).
BYTES, REMEMBERED = 32 << 20, 1 << 21
#: Learnt bytes of one task.
TASK = 4 << 20
#: Bits of a symbol (a byte and 1; 0 stands before a text), and of the contexts of each order.
BITS, ORDERS = 9, 3
_SYMBOL = (1 << BITS) - 1


def grams(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Each byte with the three before it in its text, the oldest first."""
    s = data.astype(np.int64) + 1
    out = s.copy()
    for k in range(1, ORDERS + 1):
        before = np.zeros(len(s), np.int64)
        before[k:] = s[: max(0, len(s) - k)]
        for edge in range(k):
            first = at[:-1] + edge
            before[first[first < at[1:]]] = 0
        out |= before << (k * BITS)
    return out


def _count(batches):
    total: dict[int, list] = {}
    for batch in batches:
        data, at = B.column(batch["text"])
        langs = batch["lang"].to_numpy()
        for i, j in B.pieces(at):
            g = grams(data[at[i] : at[j]], at[i : j + 1] - at[i])
            whose = np.repeat(langs[i:j], np.diff(at[i : j + 1]))
            for lang in np.unique(langs[i:j]):
                held = total.setdefault(int(lang), [])
                held.append(np.unique(g[whose == lang], return_counts=True))
                if len(held) > 64:
                    total[int(lang)] = [_merged(held)]
    for lang, held in total.items():
        k, n = _merged(held)
        for i in range(0, len(k), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k[i : i + 50_000]), lang, np.int32)), pa.array(k[i : i + 50_000]), pa.array(n[i : i + 50_000].astype(np.int64))], names=["lang", "gram", "n"])


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their n."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]][: len(k)])
    return k[first], np.add.reduceat(n[order], first) if len(first) else n[:0]


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    return _summed(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))


def _found(keys: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each asked key stands among the sorted keys, and whether it does."""
    if not len(keys):
        return np.zeros(len(asked), np.int64), np.zeros(len(asked), bool)
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return at, keys[at] == asked


class Tree:
    """Counts of one language. Of each order: contexts with their bytes and counts (pairs, n); contexts (own), the total of their counts, how many bytes they have
    seen (kinds), and how much those bytes count in the next shorter context (shared)."""

    def __init__(self, gram: np.ndarray, n: np.ndarray):
        self.orders = []
        for k in range(ORDERS + 1):
            pairs, count = _summed(gram & ((1 << (k + 1) * BITS) - 1), n)
            own, total = _summed(pairs >> BITS, count)
            kinds = np.diff(np.r_[np.searchsorted(pairs >> BITS, own), len(pairs)])
            shared = np.zeros(len(own), np.int64)
            if k:
                above_pairs, above = self.orders[-1][:2]
                shared = _summed(pairs >> BITS, above[_found(above_pairs, pairs & ((1 << k * BITS) - 1))[0]])[1]
            self.orders.append((pairs, count, own, total, kinds, shared))

    def bits(self, gram: np.ndarray) -> np.ndarray:
        """What the last byte of each gram costs after the others."""
        out, done = np.zeros(len(gram)), np.zeros(len(gram), bool)
        excluded, gone = np.zeros(len(gram), np.int64), np.zeros(len(gram), np.int64)
        for k in range(ORDERS, -1, -1):
            pairs, count, own, total, kinds, shared = self.orders[k]
            at, known = _found(own, (gram & ((1 << (k + 1) * BITS) - 1)) >> BITS)
            if not len(own):
                continue
            t, d = total[at] - excluded, kinds[at] - gone
            some = known & ~done & (d > 0)
            whole = np.maximum(t + np.where(kinds[at] < 256, d, 0), 1)  # a context that has seen every byte needs no escape
            place, seen = _found(pairs, gram & ((1 << (k + 1) * BITS) - 1))
            hit = some & seen
            out[hit] += np.log2(whole[hit]) - np.log2(count[place[hit]])
            done |= hit
            left = some & ~seen
            out[left] += np.log2(whole[left]) - np.log2(d[left])
            excluded, gone = np.where(known, shared[at], 0), np.where(known, kinds[at], 0)
        out[~done] += np.log2(256 - gone[~done])
        return out


class Model:
    """The trees of all languages, and the costs under each that a worker has worked out."""

    def __init__(self, langs: list[str], lang: np.ndarray, gram: np.ndarray, n: np.ndarray):
        self.langs = langs
        self.trees = [Tree(gram[lang == k], n[lang == k]) for k in range(len(langs))]
        self.forget()

    def forget(self) -> None:
        self.known, self.costs = np.zeros(0, np.int64), np.zeros((0, len(self.langs)), np.float32)

    def lengths(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Bits of each text under each language."""
        g = grams(data, at)
        order = np.argsort(g)
        ordered = g[order]
        first = np.r_[True, ordered[1:] != ordered[:-1]][: len(g)]
        own = np.empty(len(g), np.int32)
        own[order] = np.cumsum(first) - 1
        distinct = ordered[first]
        place, known = _found(self.known, distinct)
        if not known.all():
            if len(self.known) + (~known).sum() > REMEMBERED:
                self.forget()
                known[:] = False
            new = distinct[~known]
            keys, costs = np.r_[self.known, new], np.concatenate([self.costs, np.stack([t.bits(new) for t in self.trees], 1).astype(np.float32)])
            by = np.argsort(keys)
            self.known, self.costs = keys[by], costs[by]
            place, _ = _found(self.known, distinct)
        return np.add.reduceat(self.costs[place[own]], at[:-1], axis=0, dtype=np.float64)


def fit(docs: DataFrame, limit: int = BYTES) -> Model | None:
    spark = docs.sparkSession
    known = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang")).where((remainder(4) != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    sizes = {r.lang: r.n for r in known.groupBy("lang").agg(F.sum(F.octet_length("text") + 1).alias("n")).collect()}
    if not sizes:
        return None
    langs, each = sorted(sizes), limit // len(sizes)
    table = spark.createDataFrame([(x, i, min(1.0, 2 * each / sizes[x])) for i, x in enumerate(langs)], "lang string, k int, share double")
    chance = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    # the share of ids leaves about twice as many bytes as asked for, the running sum then no more than those
    some = cut(lines(known.join(F.broadcast(table), "lang").where(chance < F.col("share")), F.col("k").alias("lang"), F.xxhash64("doc_id").alias("place")))
    some = within_budget(some, ["place", "doc_id", "text"], F.octet_length("text"), each, ["lang"]).select("lang", "text")
    some = some.coalesce(max(1, limit // TASK))  # a bounded number of bytes: few tasks count them, so few counts of one gram are added up
    got = some.mapInArrow(_count, "lang int, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()  # no more rows than bytes learnt from
    return Model(langs, got["lang"].to_numpy(), got["gram"].to_numpy(), got["n"].to_numpy())


def _predict(shared):
    def run(batches):
        model = shared.value
        names = pa.array(model.langs)
        for batch in batches:
            data, at = B.column(batch["text"])
            for i, j in B.pieces(at):
                bits = model.lengths(data[at[i] : at[j]], at[i : j + 1] - at[i])
                best = bits.argmin(1)
                score = 1 / np.exp2(np.maximum(bits.min(1, keepdims=True) - bits, -1000)).sum(1)
                yield pa.RecordBatch.from_arrays([*(batch[c].slice(i, j - i) for c in ("doc_id", "lettered")), names.take(pa.array(best)), pa.array(score), pa.array(bits.min(1))], names=["doc_id", "lettered", "lang", "score", "bits"])

    return run


def identify(docs: DataFrame, limit: int = BYTES) -> DataFrame:
    """doc_id, held_out, lang_pred, score, bits of each row."""
    spark = prepare(docs.sparkSession)
    model = fit(docs, limit)
    rows = lines(docs.withColumn("lettered", F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False))), "lettered")
    if model is None:
        out = rows.select("doc_id", F.lit(False).alias("lettered"), F.lit("und").alias("lang"), F.lit(0.0).alias("score"), F.lit(0.0).alias("bits"))
    else:
        out = rows.mapInArrow(_predict(spark.sparkContext.broadcast(model)), "doc_id long, lettered boolean, lang string, score double, bits double")
    return out.select("doc_id", (remainder(4) == 2).alias("held_out"), F.when(F.col("lettered"), F.col("lang")).otherwise("und").alias("lang_pred"), F.when(F.col("lettered"), F.col("score")).otherwise(0.0).alias("score"), "bits")
