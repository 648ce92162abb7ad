"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests. One fingerprint minus another, peeled, gives the digests that only one text has.

Paragraphs end at line ends, at sentence ends and, in long sentences, after words whose hash says so, so that an edit changes the paragraphs near it only. A fingerprint has
three tables of 2^k cells; the cell of a digest is a hash of it modulo 2^k, so a fingerprint folds in half by adding the cells that fall together, and any two can be brought
to one size. k is the smallest one at which the fingerprint gives back all digests of its own text, so equal texts have equal fingerprints and a long text has a longer one.

Two fingerprints are folded to a small size, subtracted and peeled; where that fails, to the double size, and so on up to the size of the smaller one. Where even that can't hold
the difference (texts that share little), each is peeled by itself. So the likeness, common digests over all digests of both, follows from the two fingerprints alone
(`alike` does it for two returned strings), and few cells are looked at where little differs.

Each text is compared with its edited text (its last half replaced by the first half of the next document's) and with the next document, in descending doc_id
order, after the last the first. Texts are dealt to ranges of that order, whose bounds come from a sample of keys; the first row of each range goes to the range before it as
well, so texts move once and nothing is joined.

Nulls: a null text is an empty one; two empty texts are alike (1.0); null doc_ids come last. Rows of equal ids follow one another by a hash of their text, then by
it, and may be in many ranges; a text of any length is read whole; a table of one row is its own next; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.llm import buffers as B
from dossier.llm.common import frugal, prepare
from dossier.operators.order import range_number

#: The power of two of the smallest table; digests for each cell of one table that are tried first; words after which a long paragraph may end: one in CUT.
LEAST, FILL, CUT = 1, 2, 16
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?"]] = True


def digests(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct paragraph digests of all texts, one after another, and where each text's begin."""
    data = np.frombuffer(b"".join(t + b"\n" for t in texts), np.uint8)
    at = np.r_[0, np.cumsum([len(t) + 1 for t in texts])]
    begin, end = B.word_bounds(data)
    if not len(begin):
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    words = B.hashed_runs(data, begin, end)
    newline = np.r_[0, np.cumsum(data == 10)]
    last = (newline[np.r_[begin[1:], len(data)]] > newline[end]) | _STOP[data[end - 1]] | (words % np.uint64(CUT) == 0)
    stop = np.flatnonzero(last)
    start = np.r_[0, stop[:-1] + 1]
    keys = B.hashed_runs(data, begin[start], end[stop])
    doc = np.searchsorted(at, begin[start], "right") - 1
    order = np.lexsort((keys, doc))
    keys, doc = keys[order], doc[order]
    new = np.r_[True, (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1])]
    return keys[new], np.searchsorted(doc[new], np.arange(len(at)))


def places(keys: np.ndarray) -> list[np.ndarray]:
    """Three hashes of each key; its cell in a table is one of them modulo the table's size."""
    return [B.mix(keys + np.uint64(B.BASE * (k + 1) & (1 << 64) - 1)) for k in range(3)]


def checked(keys: np.ndarray) -> np.ndarray:
    return (B.mix(keys ^ np.uint64(0xA5A5A5A5A5A5A5A5)) >> np.uint64(32)).astype(np.uint32)


class Sketches:
    """Cells (count, sum of keys, sum of 32-bit key hashes) of many texts at once: three tables of 2 ** power cells each, one text after another."""

    def __init__(self, power: np.ndarray):
        self.power = power.astype(np.int64)
        self.size = 1 << self.power
        self.base = np.r_[0, np.cumsum(3 * self.size)]
        self.count, self.keys, self.check = np.zeros(self.base[-1], np.int32), np.zeros(self.base[-1], np.uint64), np.zeros(self.base[-1], np.uint32)

    def cells(self, keys: np.ndarray, doc: np.ndarray) -> list[np.ndarray]:
        return [self.base[doc] + t * self.size[doc] + (h & (self.size[doc] - 1).astype(np.uint64)).astype(np.int64) for t, h in enumerate(places(keys))]

    def add(self, keys: np.ndarray, doc: np.ndarray, sign: np.ndarray) -> None:
        h = checked(keys)
        for p in self.cells(keys, doc):
            np.add.at(self.count, p, sign.astype(np.int32))
            np.add.at(self.keys, p, keys * sign.astype(np.int64).view(np.uint64))
            np.add.at(self.check, p, h * sign.astype(np.int32).view(np.uint32))

    def folded(self, which: np.ndarray, power: np.ndarray) -> Sketches:
        """Those of the texts `which`, each at a power that is no larger than its own."""
        out = Sketches(power)
        n = 3 * self.size[which]
        doc = np.repeat(np.arange(len(which)), n)
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        own = self.size[which][doc]
        to = out.base[doc] + at // own * out.size[doc] + (at % own & (out.size[doc] - 1))
        of = self.base[which][doc] + at
        np.add.at(out.count, to, self.count[of])
        np.add.at(out.keys, to, self.keys[of])
        np.add.at(out.check, to, self.check[of])
        return out

    def minus(self, other: Sketches) -> Sketches:
        out = Sketches(self.power)
        out.count, out.keys, out.check = self.count - other.count, self.keys - other.keys, self.check - other.check
        return out

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Digests that are found, their text and sign, and whether all of a text were found. The cells are used up."""
        found: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32))]
        owner = np.repeat(np.arange(len(self.power)), 3 * self.size)
        look = np.flatnonzero(np.abs(self.count) == 1)
        while len(look):
            sign = self.count[look]
            k = self.keys[look] * sign.astype(np.int64).view(np.uint64)
            pure = checked(k) * sign.view(np.uint32) == self.check[look]
            look, k = look[pure], k[pure]
            if not len(look):
                break
            order = np.lexsort((k, owner[look]))
            look, k = look[order], k[order]
            new = np.r_[True, (k[1:] != k[:-1]) | (owner[look[1:]] != owner[look[:-1]])]
            look, k = look[new], k[new]
            doc, sign = owner[look], self.count[look].copy()
            found.append((k, doc, sign))
            touched = np.unique(np.concatenate(self.cells(k, doc)))
            self.add(k, doc, -sign)
            look = touched[np.abs(self.count[touched]) == 1]
        rest = np.r_[0, np.cumsum((self.count != 0) | (self.keys != 0) | (self.check != 0))]
        return *(np.concatenate(c) for c in zip(*found, strict=True)), rest[self.base[1:]] == rest[self.base[:-1]]


def fingerprints(keys: np.ndarray, at: np.ndarray) -> tuple[Sketches, np.ndarray, np.ndarray]:
    """A sketch of each text's digests, of the smallest size at which it gives them back; and what it gives back: digests, sorted by text and digest, and their text."""
    n = np.diff(at)
    power = np.maximum(LEAST, np.ceil(np.log2(np.maximum(n / FILL, 1))).astype(np.int64))
    doc = np.repeat(np.arange(len(n)), n)
    while True:
        s = Sketches(power)
        s.add(keys, doc, np.ones(len(keys), np.int32))
        got, owner, _, whole = s.folded(np.arange(len(n)), power).peel()
        if whole.all():
            order = np.lexsort((got, owner))
            return s, got[order], owner[order]
        power = power + ~whole


def likeness(a: Sketches, b: Sketches, own_a: tuple[np.ndarray, np.ndarray], own_b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each pair: common over all digests, digests that only the one and only the other has, and the cells at which the difference was peeled (0: each was peeled by itself).

    own_a, own_b: what the sketches give back by themselves (digests and their text)."""
    n = len(a.power)
    na, nb = np.bincount(own_a[1], minlength=n), np.bincount(own_b[1], minlength=n)
    plus, minus, cells = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    left, power, most = np.arange(n), np.full(n, LEAST), np.minimum(a.power, b.power)
    while len(left):
        _, doc, sign, whole = a.folded(left, power[left]).minus(b.folded(left, power[left])).peel()
        ok = left[whole]
        plus[ok], minus[ok] = np.bincount(doc[sign > 0], minlength=len(left))[whole], np.bincount(doc[sign < 0], minlength=len(left))[whole]
        cells[ok] = 3 << power[ok]
        left = left[~whole]
        alone = left[power[left] == most[left]]
        if len(alone):
            pairs = [np.stack([o.astype(np.uint64)[m := np.isin(o, alone)], k[m]]) for k, o in (own_a, own_b)]
            both = np.unique(np.concatenate([np.unique(p, axis=1) for p in pairs], axis=1), axis=1, return_counts=True)
            common = np.bincount(both[0][0][both[1] == 2].astype(np.int64), minlength=n)[alone]
            plus[alone], minus[alone] = na[alone] - common, nb[alone] - common
        left = left[power[left] < most[left]]
        power[left] += 1
    united = na + minus
    return np.where(united > 0, (na - plus) / np.maximum(united, 1), 1.0), plus, minus, cells


def written(s: Sketches) -> list[str]:
    """Each sketch as a string: its power, then counts, keys and checks of its cells."""
    wide = [x.astype(t) for x, t in ((s.count, "<u4"), (s.keys, "<u8"), (s.check, "<u4"))]
    return [base64.b64encode(bytes([p]) + b"".join(x[a:b].tobytes() for x in wide)).decode() for p, a, b in zip(s.power.tolist(), s.base[:-1].tolist(), s.base[1:].tolist(), strict=True)]


def read(fingerprint: str) -> tuple[Sketches, np.ndarray, np.ndarray]:
    """A written sketch and the digests it gives back."""
    data = base64.b64decode(fingerprint)
    s = Sketches(np.array([data[0]]))
    n = len(s.count)
    s.count, s.keys, s.check = np.frombuffer(data, "<u4", n, 1).astype(np.int32), np.frombuffer(data, "<u8", n, 1 + 4 * n).astype(np.uint64), np.frombuffer(data, "<u4", n, 1 + 12 * n).astype(np.uint32)
    got, owner, _, whole = s.folded(np.array([0]), s.power).peel()
    if not whole.all():
        raise ValueError("this is no whole fingerprint")
    return s, got, owner


def alike(fingerprint: str, other: str) -> float:
    """The likeness of two texts from their returned fingerprints."""
    (a, *own_a), (b, *own_b) = read(fingerprint), read(other)
    return float(likeness(a, b, tuple(own_a), tuple(own_b))[0][0])


def _some(s: Sketches, own: tuple[np.ndarray, np.ndarray], first: int, stop: int) -> tuple[Sketches, tuple[np.ndarray, np.ndarray]]:
    out = s.folded(np.arange(first, stop), s.power[first:stop])
    inside = (own[1] >= first) & (own[1] < stop)
    return out, (own[0][inside], own[1][inside] - first)


def compared(texts: list[str]) -> list[list]:
    """The columns of RESULT of each text but the last, each beside the one after it."""
    m = len(texts) - 1
    edited = [(t[: len(t) - len(t) // 2] + f[: len(t) // 2]).encode("utf-8", "surrogatepass") for t, f in zip(texts[:-1], texts[1:], strict=True)]
    every, *own = fingerprints(*digests([t.encode() for t in texts]))
    new, *own_new = fingerprints(*digests(edited))
    (mine, had), (after, had_after) = _some(every, tuple(own), 0, m), _some(every, tuple(own), 1, m + 1)
    near, gone, came, cells = likeness(mine, new, had, tuple(own_new))
    far = likeness(mine, after, had, had_after)[0]
    return [[len(t) for t in texts[:-1]], [hashlib.sha256(e).hexdigest() for e in edited], written(mine), written(new), near, far, gone, came, cells]


COLUMNS = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, only_own long, only_edited long, cells long"
_KINDS = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}
RESULT = pa.schema([("doc_id", pa.int64()), *((c.split()[0], _KINDS[c.split()[1]]) for c in COLUMNS.split(", "))])


def _run(batches):
    """Rows of a range in their order; the last one of each range belongs to the range after it and is only looked at."""
    held, part = None, None
    for batch in batches:
        ranges, (_, at) = batch["part"].to_numpy(), B.column(batch["text"])
        for i, j in B.pieces(at):
            docs, texts, parts = batch["doc_id"].slice(i, j - i).to_pylist(), batch["text"].slice(i, j - i).to_pylist(), ranges[i:j].tolist()
            edge = [0, *(k for k in range(1, len(parts)) if parts[k] != parts[k - 1]), len(parts)]
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                ids, own = docs[a:b], texts[a:b]
                if held is not None and part == parts[a]:
                    ids, own = [held[0], *ids], [held[1], *own]
                held, part = (ids[-1], own[-1]), parts[a]
                if len(own) > 1:
                    columns = [ids[:-1], *compared(own)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, RESULT, strict=True)], schema=RESULT)


def versions(docs: DataFrame) -> DataFrame:
    """doc_id and COLUMNS of each row: only_own and only_edited count the digests that were peeled, cells says at which size."""
    spark = prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # ids go down, nulls come last: a bitwise complement turns the order of longs without leaving them
    keys = {"k0": F.col("doc_id").isNull().cast("int"), "k1": F.coalesce(F.bitwise_not("doc_id"), F.lit(0)), "k2": F.xxhash64("text")}
    keyed = rows.withColumns(keys)
    own = range_number(keyed, list(keys))
    firsts = sorted(keyed.groupBy(own.alias("part")).agg(F.min(F.struct(*keys)).alias("first")).collect())
    if not firsts:
        return spark.createDataFrame([], f"doc_id long, {COLUMNS}")
    # the first row of each range is the last of the range before it; that of the first range comes after the last
    before = {tuple(r.first): (firsts[k - 1].part, k == 0) for k, r in enumerate(firsts)}
    lead = F.array(*(F.struct(*(F.lit(x).alias(k) for k, x in zip(keys, key, strict=True)), F.lit(p).alias("part")) for key, (p, _) in before.items()))
    also = F.filter(lead, lambda b: (b["k0"] == F.col("k0")) & (b["k1"] == F.col("k1")) & (b["k2"] == F.col("k2")))
    dealt = keyed.withColumn("own", own)
    copies = dealt.where(F.size(also) > 0).withColumn("to", F.get(also, F.lit(0))["part"])
    # of repeated rows one is enough
    copies = copies.dropDuplicates(list(keys)).select("doc_id", "text", *keys, F.col("to").alias("part"), F.lit(1).alias("after"))
    both = dealt.select("doc_id", "text", *keys, F.col("own").alias("part"), F.lit(0).alias("after")).unionByName(copies)
    n = max(r.part for r in firsts) + 1
    placed = both.repartitionById(n, F.col("part").cast("int")).sortWithinPartitions("part", "after", *keys, "text")
    return placed.select("part", "doc_id", "text").mapInArrow(frugal(_run), f"doc_id long, {COLUMNS}")
