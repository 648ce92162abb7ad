"""Near-duplicate documents: universal hash minima in bands, verified by signature and then on full sets, joined by large-star and small-star.

The set of a document: its distinct shingles of `size` words (A-Z lower-cased, words between ASCII spaces); fewer words make one shingle, no word none.
Documents of equal sets are one class at once (an aggregate, so a class of a third of all rows is one row a task). Classes that share a band bucket are
first compared with the bucket's smallest one, and joined to components. In buckets that still hold several components the members outside the largest one
are compared with all others, block by block, if they are no more than CROWD; so a member is copied for a bounded number of blocks of those.

The members of other buckets meet by a prefix filter instead, which leaves out no link: of two sets with so much in common each has one of the other's
rarest n - ceil(percent n) + 1 shingles among its own, whatever order stands for rarity. The order is that of counts over all members in a table of bounded
size. So members that share an opening and little else, however many, have no key in common. Members of a shingle's bucket are compared with the smallest
one again, and only what then holds several components is compared in blocks. No bucket is one task's work, no pair inside a component is ever made, and no
link is left out.

Nulls: a null or empty text has no shingles and is linked with nothing; a null doc_id stays alone with a null component. Repeated rows get the same
answer each; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.llm import buffers as B
from dossier.llm.common import cut, cut_small, frugal, lines, only_ids, prepare

#: Hash functions; chances, at most, that a pair at the asked similarity shares no band, and that its signatures agree too seldom to be a candidate.
HASHES, NO_BAND, UNLIKELY = 100, 1e-5, 1e-9
#: Members of a bucket that one block holds; members outside its largest component up to which it is compared in blocks; counters of shingles that say which are rare.
BLOCK, CROWD, COUNTERS = 256, 4096, 1 << 17
_random = np.random.default_rng(7)
SLOPES = (_random.integers(0, 1 << 31, HASHES, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
SHIFTS = _random.integers(0, 1 << 32, HASHES, dtype=np.uint32)


@lru_cache
def layout(percent: int) -> tuple[int, int, int]:
    """Bands, rows of each, and equal minima that a candidate has at least: as many rows and minima as NO_BAND and UNLIKELY allow at this similarity."""
    p = percent / 100
    rows = max((r for r in range(1, HASHES + 1) if (1 - p**r) ** (HASHES // r) <= NO_BAND), default=0)
    if not rows:
        raise ValueError(f"{HASHES} hash functions find pairs at {percent} % too seldom")
    least, below = 0, (1 - p) ** HASHES
    while least < HASHES and below <= UNLIKELY:
        least += 1
        below += comb(HASHES, least) * p**least * (1 - p) ** (HASHES - least)
    return HASHES // rows, rows, least


def shingle_sets(data: np.ndarray, at: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """Of each text in data, the sorted distinct hashes of its shingles."""
    begin, end = B.word_bounds(data)
    words = B.hashed_runs(data, begin, end, B.LOWER_CODES)
    first = np.searchsorted(begin, at)
    grams = B.combine(words, size)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= size:
            x = np.sort(grams[a : b - size + 1])
            yield x[np.r_[True, x[1:] != x[:-1]]]
        elif b > a:
            yield B.combine(np.r_[words[a:b], np.uint64(b - a)], b - a + 1)
        else:
            yield words[:0]


def minima(x: np.ndarray) -> np.ndarray:
    """The least value of each hash function over a set that is not empty."""
    low, out = (x ^ (x >> np.uint64(32))).astype(np.uint32), None
    for i in range(0, len(low), 2048):
        with np.errstate(over="ignore"):
            least = ((low[i : i + 2048, None] ^ SHIFTS) * SLOPES).min(0)
        out = least if out is None else np.minimum(out, least)
    return out


def _signed(size: int, percent: int, carried: list[str]):
    bands_n, rows_n, _ = layout(percent)

    def run(batches):
        for batch in batches:
            data, at = B.column(batch["text"])
            for i, j in B.pieces(at):
                n, h, sig = [], [], []
                for x in shingle_sets(data[at[i] : at[j]], at[i : j + 1] - at[i], size):
                    n.append(len(x))
                    h.append((x.sum(dtype=np.uint64), B.mix(x + np.uint64(1)).sum(dtype=np.uint64)))
                    sig.append(minima(x) if len(x) else SHIFTS)
                s = np.stack(sig)
                keys = s[:, : bands_n * rows_n].reshape(len(s), bands_n, rows_n).astype(np.uint64)
                with np.errstate(over="ignore"):
                    k = np.broadcast_to(np.arange(bands_n, dtype=np.uint64), (len(s), bands_n))
                    for r in range(rows_n):
                        k = B.mix(k * np.uint64(B.BASE) + keys[:, :, r])
                h = np.array(h, np.uint64).reshape(-1, 2).view(np.int64)
                bands = pa.ListArray.from_arrays(np.arange(0, k.size + 1, bands_n, dtype=np.int32), pa.array(k.ravel().view(np.int64)))
                sigs = [x.tobytes() for x in (s & np.uint32(255)).astype(np.uint8)]
                own = [batch[c].slice(i, j - i) for c in carried]
                yield pa.RecordBatch.from_arrays([*own, pa.array(n, pa.int64()), pa.array(h[:, 0]), pa.array(h[:, 1]), bands, pa.array(sigs, pa.binary())], names=[*carried, "n", "h1", "h2", "bands", "sig"])

    return run


SETS = pa.schema([("doc_id", pa.int64()), ("grams", pa.list_(pa.int64()))])


def _sets(size: int):
    def run(batches):
        for batch in batches:
            data, at = B.column(batch["text"])
            for i, j in B.pieces(at):
                own = [x.view(np.int64) for x in shingle_sets(data[at[i] : at[j]], at[i : j + 1] - at[i], size)]
                ends = np.cumsum([0, *map(len, own)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(i, j - i), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(own)))], schema=SETS)

    return run


def _slots(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(40)).astype(np.int64) % COUNTERS


def _counted(size: int):
    """How many sets of a task hold a shingle of each counter."""

    def run(batches):
        count = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            data, at = B.column(batch["text"])
            for i, j in B.pieces(at):
                for x in shingle_sets(data[at[i] : at[j]], at[i : j + 1] - at[i], size):
                    np.add.at(count, _slots(x), 1)
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(count[some])], names=["slot", "n"])

    return run


def rarest(x: np.ndarray, count: np.ndarray, percent: int) -> np.ndarray:
    """Of a set the shingles one of which each set with so much in common has as well: the first n - ceil(percent n / 100) + 1 by count, then by value."""
    n = len(x) - -(-percent * len(x) // 100) + 1
    return x[np.lexsort((x, count[_slots(x)]))[:n]] if len(x) else x


def _prefixes(size: int, percent: int, count: np.ndarray):
    def run(batches):
        for batch in batches:
            data, at = B.column(batch["text"])
            for i, j in B.pieces(at):
                own = [rarest(x, count, percent).view(np.int64) for x in shingle_sets(data[at[i] : at[j]], at[i : j + 1] - at[i], size)]
                ends = np.cumsum([0, *map(len, own)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(i, j - i), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(own)))], schema=SETS)

    return run


def _likely(percent: int):
    """Keeps pairs whose set sizes and signatures leave the similarity possible."""
    least = layout(percent)[2]

    def run(batches):
        for b in batches:
            n, m = b["n"].to_numpy(), b["m"].to_numpy()
            x, y = (np.frombuffer(b[c].cast(pa.binary()).buffers()[2] or b"", np.uint8)[b[c].offset * HASHES :][: len(n) * HASHES].reshape(len(n), -1) if len(n) else np.zeros((0, 1), np.uint8) for c in ("sig", "other"))
            keep = (100 * np.minimum(n, m) >= percent * np.maximum(n, m)) & ((x == y).sum(1) >= least)
            yield b.select(["a", "b"]).filter(pa.array(keep))

    return run


def components(links: DataFrame) -> DataFrame:
    """node, root: of each node of links (a, b), the smallest node of its component. Large-star and small-star in turn until nothing changes."""
    edges, before = cut_small(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct()), None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut_small(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The runs of rows with equal keys of a sorted partition, whichever batches they stand in."""
    held = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = t if held is None else pa.concat_tables([held, t])
        k = np.stack([t[c].to_numpy() for c in keys])
        cuts = np.flatnonzero((k[:, 1:] != k[:, :-1]).any(0)) + 1
        for a, b in zip(np.r_[0, cuts[:-1]].tolist() if len(cuts) else [], cuts.tolist(), strict=True):
            yield t.slice(a, b - a)
        held = t.slice(int(cuts[-1])) if len(cuts) else t
    if held is not None and held.num_rows:
        yield held


def _matrix(t: pa.Table, name: str, kind, width: int) -> np.ndarray:
    c = t[name].combine_chunks()
    return np.frombuffer(b"".join(c.to_pylist()), kind).reshape(-1, width) if pa.types.is_binary(c.type) else c.flatten().to_numpy().reshape(-1, width)


def _open_pairs(t: pa.Table, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a block that may be links between components and share no earlier band than this bucket's (where members have their bands)."""
    bands_n, _, least = layout(percent)
    n, root, side = t["n"].to_numpy(), t["root"].to_numpy(), t["side"].to_numpy()
    banded = len(t["bands"][0]) > 0
    sig, bands = _matrix(t, "sig", np.uint8, HASHES), _matrix(t, "bands", np.int64, bands_n) if banded else None
    two = t["x"][0].as_py() != t["y"][0].as_py()
    i, j = (np.repeat(np.flatnonzero(side == 0), (side == 1).sum()), np.tile(np.flatnonzero(side == 1), (side == 0).sum())) if two else np.triu_indices(len(n), 1)
    ok = (root[i] != root[j]) & (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j]))
    i, j = i[ok], j[ok]
    key, out = t["key"][0].as_py(), []
    for a in range(0, len(i), 8192):
        p, q = i[a : a + 8192], j[a : a + 8192]
        own = bands[p, (bands[p] == bands[q]).argmax(1)] == key if banded else True
        out.append(((sig[p] == sig[q]).sum(1) >= least) & own)
    ok = np.concatenate(out) if out else np.zeros(0, bool)
    return i[ok], j[ok]


ACTIVE = "key long, x int, y int, side int, rep long, root long, n long, bands array<long>, sig binary"


def _active(percent: int):
    """Members of blocks that have a partner to be verified."""

    def run(batches):
        for t in groups(batches, ["key", "x", "y"]):
            i, j = _open_pairs(t, percent)
            if len(i):
                yield from t.take(np.unique(np.r_[i, j])).to_batches()

    return run


def _verified(percent: int):
    """Links between components: full sets are compared, pairs that are already joined in this block are not."""

    def run(batches):
        for t in groups(batches, ["key", "x", "y"]):
            i, j = _open_pairs(t, percent)
            rep, root, sets, up = t["rep"].to_pylist(), t["root"].to_pylist(), t["grams"].combine_chunks(), {}

            def top(x, up=up):
                while up.get(x, x) != x:
                    x = up[x]
                return x

            found = []
            for p, q in zip(i.tolist(), j.tolist(), strict=True):
                if top(root[p]) != top(root[q]):
                    x, y = sets[p].values.to_numpy(), sets[q].values.to_numpy()
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    if 100 * both >= percent * (len(x) + len(y) - both):
                        up[top(root[p])] = top(root[q])
                        found.append((rep[p], rep[q]))
            if found:
                a, b = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _confirmed(pairs: DataFrame, facts: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) that are links: sizes and signatures first, then full sets."""
    pairs = pairs.join(facts.select(F.col("rep").alias("a"), "n", "sig"), "a").join(facts.select(F.col("rep").alias("b"), F.col("n").alias("m"), F.col("sig").alias("other")), "b")
    pairs = cut(pairs.mapInArrow(_likely(percent), "a long, b long"))
    ids = cut_small(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    sets = cut(only_ids(texts, ids).mapInArrow(frugal(_sets(size)), "doc_id long, grams array<long>"))
    both = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("grams").alias("x")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("grams").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    return cut(both.where(100 * common >= percent * (F.size("x") + F.size("y") - common)).select("a", "b"))


def _in_blocks(still: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Links between components of the same bucket: rows of _rooted with n, bands, sig. Members outside the largest component of a bucket, in blocks, meet one another and the blocks of that component."""
    outside, inside = (F.greatest(F.ceil(F.col(c) / BLOCK), F.lit(1)).cast("int") for c in ("others", "most"))
    at = F.xxhash64("rep")
    still = still.withColumn("own", F.when(F.col("largest"), outside + F.pmod(at, inside)).otherwise(F.pmod(at, outside)).cast("int"))
    still = still.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("largest"), outside).otherwise(outside + inside) - 1)))
    still = still.select("key", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), (F.col("own") > F.col("other")).cast("int").alias("side"), "rep", "root", "n", "bands", "sig")
    block = ["key", "x", "y"]
    active = cut(still.repartition(*block).sortWithinPartitions(*block).mapInArrow(_active(percent), ACTIVE))
    ids = cut_small(active.select(F.col("rep").alias("doc_id")).distinct())
    sets = only_ids(texts, ids).mapInArrow(frugal(_sets(size)), "doc_id long, grams array<long>").withColumnRenamed("doc_id", "rep")
    return cut(active.join(sets, "rep").select(*active.columns, "grams").repartition(*block).sortWithinPartitions(*block).mapInArrow(frugal(_verified(percent)), "a long, b long"))


def _rooted(members: DataFrame, found: DataFrame) -> DataFrame:
    """Members of buckets (key, rep) that hold several components, with root; whether that is the bucket's largest component, how many members that has (most), and how many are in others."""
    known = members.join(found.select(F.col("node").alias("rep"), "root"), "rep", "left").select("key", "rep", F.coalesce("root", "rep").alias("root"))
    each = known.groupBy("key", "root").agg(F.count("*").alias("n"))
    mixed = each.groupBy("key").agg(F.max(F.struct("n", "root")).alias("top"), F.sum("n").alias("all")).where(F.col("all") > F.col("top.n"))
    return known.join(mixed, "key").select("key", "rep", "root", (F.col("root") == F.col("top.root")).alias("largest"), F.col("top.n").alias("most"), (F.col("all") - F.col("top.n")).alias("others"))


def _with_links(found: DataFrame, more: DataFrame) -> DataFrame:
    """found (node, root) after more links: only the roots that they join are looked at again."""
    edges = more
    for c in ("a", "b"):
        edges = edges.join(found.select(F.col("node").alias(c), F.col("root").alias(f"r_{c}")), c, "left").withColumn(f"r_{c}", F.coalesce(f"r_{c}", c))
    top = components(edges.select(F.col("r_a").alias("a"), F.col("r_b").alias("b")))
    moved = found.join(top.select(F.col("node").alias("root"), F.col("root").alias("__r")), "root", "left").select("node", F.coalesce("__r", "root").alias("root"))
    return cut_small(moved.unionByName(top))


def _by_prefixes(crowd: DataFrame, found: DataFrame, links: DataFrame, facts: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """found after links and all others among the classes of crowd (rep): buckets of rare shingles, compared with their smallest member, what still holds several components in blocks."""
    few = only_ids(texts, cut_small(crowd.select(F.col("rep").alias("doc_id")).distinct()))
    count = np.zeros(COUNTERS, np.int64)
    for r in few.mapInArrow(frugal(_counted(size)), "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toLocalIterator():  # COUNTERS rows at most
        count[r.slot] = r.n
    keys = cut(few.mapInArrow(frugal(_prefixes(size, percent, count)), "doc_id long, grams array<long>").select(F.explode("grams").alias("key"), F.col("doc_id").alias("rep")))
    shared = keys.groupBy("key").agg(F.min("rep").alias("center"), F.count("*").alias("members")).where("members > 1")
    members = cut(keys.join(shared, "key"))
    root = lambda c: F.coalesce(F.col(f"root_{c}"), F.col(c))
    pairs = members.where("rep != center").select(F.col("rep").alias("a"), F.col("center").alias("b")).distinct()
    for c in ("a", "b"):
        pairs = pairs.join(found.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}")), c, "left")
    links = links.unionByName(_confirmed(pairs.where(root("a") != root("b")).select("a", "b"), facts, texts, size, percent))
    found = _with_links(found, links) if links.take(1) else found
    still = _rooted(members, found).join(facts.drop("bands"), "rep").withColumn("bands", F.array().cast("array<long>"))
    late = _in_blocks(still, texts, size, percent)
    return _with_links(found, late) if late.take(1) else found


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 85, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept and the columns to carry of each row: links where 100 * common >= percent * united shingles."""
    prepare(docs.sparkSession)
    texts, rows = lines(docs), lines(docs, *carry)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.drop("text").schema)
    base = cut(rows.mapInArrow(frugal(_signed(size, percent, ["doc_id", *carry])), f"{kinds}, n long, h1 long, h2 long, bands array<long>, sig binary"))
    whole = base.where("n > 0 and doc_id is not null")
    classes = cut(whole.groupBy("h1", "h2", "n").agg(F.min(F.struct("doc_id", "bands", "sig")).alias("x")).select("h1", "h2", "n", F.col("x.doc_id").alias("rep"), "x.bands", "x.sig"))
    facts = classes.select("rep", "n", "bands", "sig")

    keys = classes.select(F.explode("bands").alias("key"), "rep")
    shared = keys.groupBy("key").agg(F.min("rep").alias("center"), F.count("*").alias("members")).where("members > 1")
    members = cut(keys.join(shared, "key"))

    links = _confirmed(members.where("rep != center").select(F.col("rep").alias("a"), F.col("center").alias("b")).distinct(), facts, texts, size, percent)
    found = components(links)

    still = cut(_rooted(members, found))
    late = _in_blocks(still.where(F.col("others") <= CROWD).join(facts, "rep"), texts, size, percent)
    crowd = still.where(F.col("others") > CROWD)
    if crowd.take(1):
        found = _by_prefixes(crowd, found, late, facts, texts, size, percent)
    elif late.take(1):
        found = _with_links(found, late)

    class_roots = classes.join(found.select(F.col("node").alias("rep"), "root"), "rep", "left").select("h1", "h2", "n", F.coalesce("root", "rep").alias("root"))
    out = base.select("doc_id", *carry, "n", "h1", "h2").join(class_roots, ["h1", "h2", "n"], "left")
    own = F.when(F.col("n") > 0, F.coalesce("root", "doc_id")).otherwise(F.col("doc_id"))
    own = F.when(F.col("doc_id").isNotNull(), own)
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), F.coalesce(own == F.col("doc_id"), F.lit(True)).alias("kept"), *carry)
