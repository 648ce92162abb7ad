"""Each operator against a brute-force version, and on nulls, empty and repeated rows, empty tables and extra columns."""

import collections
import hashlib
import itertools
import math
import pathlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from dossier.llm import buffers as B
from dossier.llm import docstats, grammar, hilbert, language, minhash, packing, quality_rules, rule_ensemble, sentencepieces, sketches, tokens, toxicity, trees

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = str.maketrans({chr(k): chr(k + 32) for k in range(65, 91)})
#: A table with all odd cases, and columns whose names the operators use inside.
ODD = [(1, "a b c d e f", "en", "s", 1), (2, None, None, None, None), (3, "", "en", "s", 0), (4, "a b c d e f", "en", "s", 1), (4, "a b c d e f", "en", "s", 1), (5, " \n\t", "en", None, 3), (6, "é 漢字 don't  x\u00a0 y", None, "s", 9), (7, "long words here " * 3000, "de", "s", 48000), (None, "no id", "en", "s", 5)]


def path(name):
    return pytest.importorskip("public_tokenizers").path(name)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark, sf):
    return spark.read.parquet(f"{sf}/labels.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS).withColumns({c: F.lit("x") for c in ("score", "part", "n", "sig", "root", "label", "rank", "text_crc32")})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def operators(labels):
    return {
        "toxicity": lambda d: toxicity.score(d, labels), "hilbert": lambda d: hilbert.hilbert_shards(d, ["lang", "source"], 24), "language": language.identify, "minhash": minhash.near_duplicates,
        "quality": lambda d: quality_rules.quality(d, labels), "grammar": lambda d: grammar.round_trip(d, path("byte_bpe_50k.json")), "rules": lambda d: rule_ensemble.classify(d, labels), "sketches": sketches.versions,
        "pieces": lambda d: sentencepieces.encode(d, path("piece_bpe_32k.model")), "packing": lambda d: packing.pack(d, path("word_bpe_49k.json")),
    }


@pytest.mark.parametrize("name", ["toxicity", "hilbert", "language", "minhash", "quality", "grammar", "rules", "sketches", "pieces", "packing"])
def test_odd_rows(odd, none, labels, name):
    run = operators(labels)[name]
    got = run(odd).collect()
    ids = collections.Counter(r.doc_id for r in got)
    assert set(ids) == {r[0] for r in ODD} and (name == "packing" or len(got) == len(ODD)) and ids[4] == 2
    assert run(none).collect() == []


def test_odd_values(odd, labels):
    """What the docstrings say of nulls, empty texts and repeated rows."""
    run = operators(labels)
    rows = {name: collections.defaultdict(list) for name in run}
    for name, f in run.items():
        for r in f(odd).collect():
            rows[name][r.doc_id].append(r)
    text = {i: t or "" for i, t, *_ in ODD}
    for name in ("toxicity", "rules"):
        own = rows[name]
        assert own[2][0].score == own[3][0].score == own[5][0].score and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for x in own.values() for r in x)
        assert len({r.score for i in (1, 4) for r in own[i]}) == 1 and own[None][0].held_out is False
    placed = sorted((r.shard, r.slot) for x in rows["hilbert"].values() for r in x)
    assert [s for s, _ in placed] == sorted(k * 24 // 9 for k in range(9)) and {t for _, t in placed} == {0}
    assert all(r.size == len(text[i].encode()) + 8 and r.text_crc32 == zlib.crc32(text[i].encode()) and r.grown_shard is None for i, x in rows["hilbert"].items() for r in x)
    assert all((r.lang_pred, r.score) == ("und", 0.0) for i in (2, 3, 5) for r in rows["language"][i]) and rows["language"][7][0].lang_pred in ("en", "de")
    assert {i: [(r.n_shingles, r.component_id, r.kept) for r in x] for i, x in rows["minhash"].items()} == {
        1: [(2, 1, True)], 2: [(0, 2, True)], 3: [(0, 3, True)], 4: [(2, 1, False)] * 2, 5: [(0, 5, True)], 6: [(1, 6, True)], 7: [(3, 7, True)], None: [(1, None, True)],
    }
    assert all((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) == (0, 0, 0, 0, 0, True, False) for i in (2, 3, 5) for r in rows["quality"][i])
    assert (rows["quality"][7][0].n_words, rows["quality"][7][0].n_repeat_words, rows["quality"][7][0].base_failed) == (9000, 9000, True)
    end = zlib.crc32(np.array([2], "<u4").tobytes())
    order = sorted((r for x in rows["grammar"].values() for r in x), key=lambda r: r.start)
    assert [r.doc_id for r in order] == [None, 1, 2, 3, 4, 4, 5, 6, 7] and [r.start for r in order] == [0, *itertools.accumulate(r.n_tokens for r in order[:-1])]
    assert all((r.n_tokens, r.ids_crc32) == (1, end) for i in (2, 3) for r in rows["grammar"][i])
    down = [7, 6, 5, 4, 4, 3, 2, 1, None]
    for k, i in enumerate(down):
        after = text[down[(k + 1) % len(down)]]
        for r in rows["sketches"][i]:
            if i != 4:  # one of the two rows of 4 is followed by the other
                edited = text[i][: len(text[i]) - len(text[i]) // 2] + after[: len(text[i]) // 2]
                assert (r.n_chars, r.edited_sha256) == (len(text[i]), hashlib.sha256(edited.encode()).hexdigest())
    assert rows["sketches"][3][0].near_next == 1.0 and sorted(r.near_next for r in rows["sketches"][4]) == [0.0, 1.0]
    assert all((r.n_tokens, r.ids_crc32, r.round_trip) == (0, 0, True) for i in (2, 3) for r in rows["pieces"][i]) and all(r.round_trip for x in rows["pieces"].values() for r in x)
    assert all((r.piece, r.start, r.length) == (0, 0, 1) for i in (2, 3) for r in rows["packing"][i]) and len(rows["packing"][4]) == 2
    assert [r.length for r in sorted(rows["packing"][7], key=lambda r: r.piece)][:-1] == [4096] * (len(rows["packing"][7]) - 1)


@pytest.fixture(scope="module")
def long_docs(spark):
    rng = np.random.default_rng(21)
    words = [f"{a}{b}" for a in ("the", "der", "le", "run", "stone", "x") for b in ("ing", "ung", "ment", "s", "")]
    one = ["\n" if k % 97 == 96 else words[w] + str(rng.integers(0, 300)) for k, w in enumerate(rng.integers(0, len(words), 250_000))]
    two = list(one)
    two[1000] = "changed"
    return spark.createDataFrame([(0, " ".join(one), "en", "s", 0), (1, " ".join(two), "en", "s", 0), (3, "short text of a few words", "en", "s", 0)], DOCS)


def test_long_texts(long_docs, labels):
    """Texts of two million characters, longer than a chunk, a batch and a shard, against plain versions."""
    from tokenizers import Tokenizer

    run, text = operators(labels), {r.doc_id: r.text for r in long_docs.collect()}
    got = {name: collections.defaultdict(list) for name in run}
    for name, f in run.items():
        for r in f(long_docs).collect():
            got[name][r.doc_id].append(r)
    assert all(0 <= got[n][i][0].score <= 1 for n in ("toxicity", "rules") for i in text)
    assert all(got["hilbert"][i][0].size == len(t.encode()) + 8 and got["hilbert"][i][0].text_crc32 == zlib.crc32(t.encode()) for i, t in text.items())
    assert {got["language"][i][0].lang_pred for i in text} == {"en"}
    s = sets(text.items())
    assert {i: (x[0].n_shingles, x[0].component_id) for i, x in got["minhash"].items()} == {0: (len(s[0]), 0), 1: (len(s[1]), 0), 3: (len(s[3]), 3)}
    w = WORD.findall(text[0])
    grams = collections.Counter(zip(w, w[1:], w[2:], strict=False))
    twice = {k + d for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for d in range(3)}
    assert (got["quality"][0][0].n_words, got["quality"][0][0].word_chars, got["quality"][0][0].n_repeat_words) == (len(w), sum(map(len, w)), len(twice))
    start = 0
    for name, vocabulary, end_id in (("grammar", "byte_bpe_50k.json", 2), ("packing", "word_bpe_49k.json", 1)):
        whole = Tokenizer.from_file(path(vocabulary))
        for i, t in text.items():
            ids = np.array([*whole.encode(t, add_special_tokens=False).ids, end_id], "<u4")
            if name == "grammar":
                r = got[name][i][0]
                assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
                start += len(ids)
            else:
                own = sorted(got[name][i], key=lambda r: r.piece)
                assert [(r.start, r.length, r.ids_crc32) for r in own] == [(a, len(ids[a : a + 4096]), zlib.crc32(ids[a : a + 4096].tobytes())) for a in range(0, len(ids), 4096)]
    digests = {i: set(sketches.digests([t.encode()])[0].tolist()) for i, t in text.items()}
    assert got["sketches"][1][0].near_next == pytest.approx(len(digests[0] & digests[1]) / len(digests[0] | digests[1])) and got["sketches"][1][0].near_next > 0.99
    assert all(x[0].round_trip for x in got["pieces"].values())


def sets(rows, size=5):
    out = {}
    for i, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        out[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
    return out


def components(s, percent=85):
    up = {i: i for i in s}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(sorted(s), 2):
        both = len(s[a] & s[b])
        if both and 100 * both >= percent * (len(s[a]) + len(s[b]) - both):
            x, y = top(a), top(b)
            up[max(x, y)] = min(x, y)
    return {i: top(i) for i in s}


def variants(n, words, seed, edits):
    rng = np.random.default_rng(seed)
    base = [f"w{k}" for k in rng.integers(0, 5000, words)]
    for _ in range(n):
        w = list(base)
        for p in rng.integers(0, words, edits):
            w[p] = f"e{rng.integers(0, 10**6)}"
        yield " ".join(w)


def test_minhash(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    # a large group of near copies of which some are near to some others only, and one of far copies that share buckets
    rows += [(10_000 + k, t) for k, t in enumerate([*variants(120, 90, 1, 1), *variants(60, 90, 2, 3), *variants(30, 400, 3, 9)])]
    s = sets(rows)
    want = components(s)
    got = {r.doc_id: r for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {i: (len(s[i]), want[i], want[i] == i) for i in s}


def pairs_apart(n, words, edits):
    """n pairs of texts that differ in words far from each other: their similarity is (words - 4 - 5 * edits) / (words - 4 + 5 * edits)."""
    for k in range(n):
        w = [f"p{k}w{i}" for i in range(words)]
        yield " ".join(w)
        for e in range(edits):
            w[10 + e * (words // edits)] = f"e{e}"
        yield " ".join(w)


@pytest.mark.parametrize("percent, words, edits", [(70, 90, 3), (80, 106, 2), (85, 130, 2)])
def test_minhash_loses_no_link_at_any_percent(spark, percent, words, edits):
    rows = list(enumerate(pairs_apart(150, words, edits)))
    s = sets(rows)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 5, percent).collect()}
    assert got == components(s, percent) and len(set(got.values())) == 150


@pytest.mark.parametrize("block", [2, 8])
def test_minhash_in_crowded_buckets(spark, monkeypatch, block):
    """Buckets of more members than a block go by rare shingles: the same answer as pair by pair."""
    monkeypatch.setattr(minhash, "BLOCK", block)
    monkeypatch.setattr(minhash, "CROWD", block)
    rows = list(enumerate([*variants(60, 90, 1, 1), *variants(60, 90, 2, 3), *variants(20, 400, 3, 9), *pairs_apart(10, 130, 2)]))
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == components(sets(rows))


def test_a_crowd_without_links_isn_t_compared_in_pairs(spark, monkeypatch):
    """Two thousand classes that share three quarters of their words and lie in the same buckets, and two links among them: no block is filled by them."""
    rng, opening = np.random.default_rng(4), " ".join(f"o{k}" for k in range(150))
    rows = [(k, f"{opening} " + " ".join(f"x{k}y{i}" for i in range(30 + int(rng.integers(0, 8))))) for k in range(2000)]
    rows += [(5000, rows[700][1] + " end"), (5001, rows[800][1] + " last")]
    monkeypatch.setattr(minhash, "CROWD", 256)
    made = []
    inner = minhash._in_blocks
    monkeypatch.setattr(minhash, "_in_blocks", lambda still, *a: made.append(still.count()) or inner(still, *a))
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: k for k in range(2000)} | {5000: 700, 5001: 800}
    assert len(made) == 2 and made[0] < 200 and made[1] == 0


def test_rare_shingles_lose_no_pair():
    rng, count = np.random.default_rng(9), np.random.default_rng(1).integers(0, 9, minhash.COUNTERS)
    for _ in range(300):
        x = np.unique(rng.integers(0, 1 << 63, int(rng.integers(1, 60)), dtype=np.uint64))
        y = np.unique(np.r_[x[rng.random(len(x)) > 0.1], rng.integers(0, 1 << 63, int(rng.integers(0, 8)), dtype=np.uint64)])
        both = len(np.intersect1d(x, y))
        if len(y) and 100 * both >= 85 * (len(x) + len(y) - both):
            assert len(np.intersect1d(minhash.rarest(x, count, 85), minhash.rarest(y, count, 85)))


@pytest.mark.parametrize("percent", [20, 50, 70, 80, 85, 95, 99, 100])
def test_minhash_layout(percent):
    bands, rows, least = minhash.layout(percent)
    p = percent / 100
    assert bands * rows <= minhash.HASHES and (1 - p**rows) ** bands <= 1e-5
    assert sum(math.comb(100, i) * p**i * (1 - p) ** (100 - i) for i in range(least)) <= 1e-9


def test_components(spark):
    edges = [(k, k + 1) for k in range(1, 40)] + [(100, 90), (90, 95), (95, 100), (7, 7)]
    got = {r.node: r.root for r in minhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[k] == 1 for k in range(2, 41)) and got[100] == got[95] == 90


def test_counts(docs):
    for r, c in zip(sorted(docs.collect()), sorted(docstats.statistics(docs).collect()), strict=True):
        w = WORD.findall(r.text)
        grams = collections.Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        twice = {k + d for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for d in range(3)}
        lines = [x for x in r.text.split("\n") if WORD.search(x)]
        assert (c.n_words, c.word_chars, c.n_symbols, c.n_dup_lines, c.n_repeat_words, c.n_distinct) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", r.text)), len(lines) - len(set(lines)), len(twice), len(set(w)))


def test_trees_are_monotonic():
    rng = np.random.default_rng(0)
    x = rng.random((2000, 3))
    y = ((x[:, 0] + 0.3 * np.sin(9 * x[:, 0]) < 0.5) ^ (rng.random(2000) < 0.1)).astype(float)
    f = trees.boosted(x, y, np.array([-1, 0, 0]))
    grid = np.c_[np.linspace(0, 1, 50), np.full((50, 2), 0.5)]
    assert (np.diff(f.margin(grid)) <= 1e-12).all()
    assert ((f.probability(x) > 0.5) == y).mean() > 0.8
    slow = [f.base + sum(v[walk(f, t, g)] for t, v in enumerate(f.value)) for g in grid]
    assert np.allclose(f.margin(grid), slow)


def walk(f, t, row):
    at = 0
    for _ in range(f.depth):
        at = 2 * at + 1 + int(row[f.feature[t, at]] > f.threshold[t, at])
    return at


def test_rules_compile_to_the_same_score(spark):
    rng = np.random.default_rng(1)
    x = rng.random((500, 2))
    y = ((x[:, 0] > 0.5) & (x[:, 1] < 0.7)).astype(float)
    b, rules = rule_ensemble.fit(x, y)
    on = trees.holds([r for r, _ in rules], x)
    want = 1 / (1 + np.exp(-(b + on @ np.array([w for _, w in rules]))))
    df = spark.createDataFrame(x.tolist(), "a double, b double")
    got = [r.s for r in df.select(rule_ensemble.compiled(b, rules, [F.col("a"), F.col("b")]).alias("s")).collect()]
    assert np.allclose(got, want) and ((want > 0.5) == y).mean() > 0.95


def test_lasso_is_at_its_optimum():
    rng = np.random.default_rng(4)
    x = rng.random((400, 12)) < 0.4
    x[:, 11] = x[:, 10]  # two equal rules
    y = (rng.random(400) < 1 / (1 + np.exp(-(2.0 * x[:, 0] - 1.5 * x[:, 1] + 0.2)))).astype(float)
    penalty = 0.01
    b, w = trees.lasso_logistic(x, y, penalty)

    def loss(b, w):
        m = x @ w + b
        return np.mean(np.log1p(np.exp(m)) - y * m) + penalty * np.abs(w).sum()

    slope = x.T @ (1 / (1 + np.exp(-(x @ w + b))) - y) / len(y)
    assert np.abs(slope[w == 0]).max() <= 1.02 * penalty and np.allclose(slope[w != 0], -penalty * np.sign(w[w != 0]), atol=0.02 * penalty)
    assert {0, 1} <= set(np.flatnonzero(w)) and (w == 0).sum() >= 4
    # a search without slopes: one number after another over a grid that gets finer ends no lower
    bs, ws, wide = 0.0, np.zeros(12), 1.0
    while wide > 1e-4:
        before = loss(bs, ws)
        for k in range(-1, 12):
            tries = [(bs + d * wide, ws) if k < 0 else (bs, ws + d * wide * (np.arange(12) == k)) for d in (-1, 0, 1)]
            tries += [] if k < 0 else [(bs, np.where(np.arange(12) == k, 0, ws))]
            bs, ws = min(tries, key=lambda t: loss(*t))
        wide = wide if loss(bs, ws) < before - 1e-12 else wide / 2
    assert loss(b, w) <= loss(bs, ws) + 1e-6


def test_paths_by_walking():
    """Every step of every row on every tree is one of the rules, and the rule holds for just the rows that come there."""
    rng = np.random.default_rng(8)
    x = np.round(rng.random((300, 4)), 2)
    f = trees.boosted(x, (x[:, 0] * x[:, 1] > x[:, 2] / 3).astype(float), np.zeros(4, int), trees=6, depth=3)
    seen = collections.defaultdict(set)
    for t in range(6):
        for r, row in enumerate(x):
            at, box = 0, {}
            for _ in range(3):
                k, cut = int(f.feature[t, at]), float(f.threshold[t, at])
                at = 2 * at + 1 + int(row[k] > cut)
                if math.isfinite(cut):
                    lo, hi = box.get(k, (-math.inf, math.inf))
                    box[k] = (lo, min(hi, cut)) if row[k] <= cut else (max(lo, cut), hi)
                    seen[tuple(sorted((c, *v) for c, v in box.items()))].add(r)
    rules = trees.paths(f)
    assert set(rules) == set(seen)
    on = trees.holds(rules, x)
    assert all(set(np.flatnonzero(on[:, k])) == seen[r] for k, r in enumerate(rules))


def test_no_rule_is_left_out():
    """More paths than any fixed number: all that have support come to the lasso."""
    rng = np.random.default_rng(11)
    x = rng.random((3000, 8))
    y = (np.sin(9 * x).sum(1) + rng.normal(0, 1, 3000) > 0).astype(float)
    got = {}
    kept, rule_ensemble.lasso_logistic = rule_ensemble.lasso_logistic, lambda on, y, penalty: (got.update(n=on.shape[1]), (0.0, np.zeros(on.shape[1])))[1]
    try:
        rule_ensemble.fit(x, y)
    finally:
        rule_ensemble.lasso_logistic = kept
    assert got["n"] > 400


@pytest.fixture(scope="module")
def larger(spark):
    d = "/root/testdata/sf0.1"
    return spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")


def held_out(scored, labels, label):
    rows = scored.where("held_out").join(labels.select("doc_id", F.col(label).alias("y")), "doc_id").collect()
    return np.mean([r.predicted == r.y for r in rows])


def test_held_out_accuracy(larger):
    docs, labels = larger
    assert held_out(toxicity.score(docs, labels), labels, "toxic") > 0.97
    assert held_out(rule_ensemble.classify(docs, labels), labels, "quality") > 0.97
    rows = language.identify(docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.98


def test_quality_keeps_good_texts(larger):
    docs, labels = larger
    rows = quality_rules.quality(docs, labels).join(labels, "doc_id").where("not base_failed").collect()
    assert np.mean([r.kept for r in rows if r.quality == 1]) > 0.99 and np.mean([r.kept for r in rows if r.quality == 0]) < 0.1


def test_noisy_channel(docs):
    restore = toxicity.restorer(toxicity.character_model(docs))
    assert restore("the st1ng") == "the sting" and restore("thaaaat th@t") == "that that"
    assert restore("a t h e r e x").replace(" ", "") == "atherex"
    places = toxicity.lattice("s1!p")
    model = toxicity.character_model(docs)
    code = lambda c: 0 if c == " " else ord(c) - 96

    def cost(choice):
        s, a, b = sum(x[1] for x in choice), 0, 0
        for c in [x[0] for x in choice if x[0]] + [" "]:
            s, a, b = s + model[a, b, code(c)], b, code(c)
        return s

    assert toxicity.viterbi(places, model) == "".join(x[0] for x in max(itertools.product(*places), key=cost))


def plain_tree(texts):
    """Counts of the bytes after each context of up to three symbols, by dictionaries."""
    seen = collections.defaultdict(collections.Counter)
    for t in texts:
        s = [None, None, None, *t]
        for k in range(3, len(s)):
            for order in range(4):
                seen[order, tuple(s[k - order : k])][s[k]] += 1
    return seen


def plain_bits(seen, text):
    """Method C with exclusions, byte by byte."""
    s, bits = [None, None, None, *text], 0.0
    for k in range(3, len(s)):
        excluded = set()
        for order in range(3, -1, -1):
            here = {b: n for b, n in seen.get((order, tuple(s[k - order : k])), {}).items() if b not in excluded}
            if not here:
                continue
            total, escapes = sum(here.values()), len(here) if len(here) + len(excluded) < 256 else 0
            if s[k] in here:
                bits -= math.log2(here[s[k]] / (total + escapes))
                break
            bits -= math.log2(escapes / (total + escapes))
            excluded |= set(here)
        else:
            bits += math.log2(256 - len(excluded))
    return bits


@pytest.mark.parametrize("text", ["éf u c", "s h 1 t", "w.0.r.d", "a . b . c . d", "a2@2b", "x3", "cooool", "Ünm1x", "\u212a e e p", "b-@-d", "é1a", "aaa2"])
def test_what_runs_match_is_suspicious(text):
    raw = ("zz " + text + "\n").encode()
    assert toxicity.RUNS.search(text.lower()) and toxicity.suspicious(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0]


def test_no_text_with_a_second_reading_is_passed_over():
    rng = np.random.default_rng(12)
    signs = list("ab1@2. -_*é\nZ!+7x") + ["  ", "aa", "İ"]
    texts = ["".join(rng.choice(signs, rng.integers(1, 9))) for _ in range(4000)]
    raw = [(t + "\n").encode() for t in texts]
    data, at = np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(r) for r in raw])]
    odd = toxicity.suspicious(data, at)
    for t, o in zip(texts, odd, strict=True):
        for m in toxicity.RUNS.finditer(t.lower()):
            assert o or not any("a" <= c <= "z" for c in m[0]) or all(len(x) == 1 for x in toxicity.lattice(m[0])), t
    assert 0.1 < odd.mean() < 0.9
    clean = "The year 2026 had 365 days. 1 2 3 4! Straße, o'clock @ 10.30\n".encode()
    assert not toxicity.suspicious(np.frombuffer(clean, np.uint8), np.array([0, len(clean)]))[0]


def test_stem_weights_by_counting(docs):
    """Weights and facts of a few texts against sets of word beginnings."""
    texts = [r.text.lower() for r in docs.orderBy("doc_id").limit(30).collect()] + 4 * ["tox toxic word", "tox word", "toxins here", "the toxic one"] + ["tox", ""]
    label = np.array([0] * 30 + [1] * 16 + [0, 0])
    words = [re.findall(r"[a-z\u0080-\U0010ffff]+", t) for t in texts]
    stems = lambda w: [w.encode()[:k] for k in toxicity.PREFIXES if len(w.encode()) > k] + [w.encode() + b"$"]
    t, c = collections.Counter(), collections.Counter()
    for ws, y in zip(words, label, strict=True):
        (t if y else c).update({s for w in ws for s in stems(w)})

    def weight(s, own=None):
        a, b = t[s] - (own == 1), c[s] - (own == 0)
        if a < 3:
            return 0.0
        w = math.log((a - 1.5 * math.sqrt(a)) / 16 / ((b + 1 + 1.5 * math.sqrt(b + 1)) / 32))
        return w if w > 0.7 else 0.0

    raw = [(x + "\n").encode() for x in texts]
    data, at = np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(r) for r in raw])]
    keys, first = toxicity.beginnings(data, at)
    name = {}
    for k, ws in enumerate(words):
        assert first[k + 1] - first[k] == len(ws)
        for row, w in zip(keys[first[k] : first[k + 1]], ws, strict=True):
            named = [w.encode()[:p] if len(w.encode()) > p else None for p in toxicity.PREFIXES] + [w.encode() + b"$"]
            for h, s in zip(row.tolist(), named, strict=True):
                assert (s is None) == (h == 0) and name.setdefault(h, s) == s
    known = np.array(sorted(h for h, s in name.items() if s and t[s] >= 3), np.uint64)
    model = toxicity.Stems(known, np.array([t[name[int(h)]] for h in known]), np.array([c[name[int(h)]] for h in known]), 16, 32)
    for own in (None, label.astype(float)):
        got = model.facts(data, at, own)
        for k, ws in enumerate(words):
            best = [max(weight(s, None if own is None else label[k]) for s in stems(w)) for w in ws]
            want = [math.log1p(sum(best)), math.log1p(100 * sum(best) / max(1, len(ws))), max(best, default=0), min(20, sum(x > 0 for x in best))]
            assert got[k] == pytest.approx(want)
    assert model.facts(data, at)[30, 0] > 0


def test_units_with_one_hash(monkeypatch):
    """Where hashes say nothing, bytes do."""
    e = tokens.Encoder(path("byte_bpe_50k.json"))
    want = [e.whole.encode(t, add_special_tokens=False).ids for t in ("one two three", "two one", "six")]
    monkeypatch.setattr(B, "hashed_runs", lambda data, begin, end, codes=None: (end - begin).astype(np.uint64) * np.uint64(2) + np.uint64(1))
    data, at = np.frombuffer(b"one two three\ntwo one\nsix\n", np.uint8), np.array([0, 14, 22, 26])
    for _ in range(2):
        assert [x.tolist() for x in e.encode(data, at)] == want


def test_code_lengths(spark):
    """Against a coder over dictionaries, with bytes and contexts that were never learnt, zero bytes, and texts shorter than a context."""
    learnt = {"xx": ["the cat sat on the mat", "a \0 b", "", "\0\0\0"], "yy": ["der hund, der bellt", "\x00der é", "aaaaaaaa"]}
    k = itertools.count()
    rows = [(i, t, lang) for lang, ts in learnt.items() for t in ts for i in itertools.islice((i for i in k if zlib.crc32(str(i).encode()) % 4 != 2), 1)]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    trees = [plain_tree([(t + "\n").encode() for t in learnt[x]]) for x in model.langs]
    texts = [(t + "\n").encode() for t in ["the dog sat", "", "a", "\0", "zzz \u6f22", "der hund", "aaaa\0aaaa", "the cat sat on the mat" * 3]]
    for _ in range(2):  # worked out, then remembered
        got = model.lengths(np.frombuffer(b"".join(texts), np.uint8), np.r_[0, np.cumsum([len(t) for t in texts])])
        assert np.allclose(got, [[plain_bits(tree, t) for tree in trees] for t in texts], atol=1e-4)
    kept, language.REMEMBERED = language.REMEMBERED, 5
    try:
        assert np.allclose(model.lengths(np.frombuffer(texts[0] + texts[5], np.uint8), np.array([0, 12, 21])), got[[0, 5]])
    finally:
        language.REMEMBERED = kept


def test_every_context_is_a_distribution(docs):
    model = language.fit(docs)
    rng = np.random.default_rng(2)
    for tree in model.trees:
        own = tree.orders[3][2]
        for c in [*rng.choice(own, 40).tolist(), 0, *rng.integers(0, 1 << 27, 10).tolist()]:
            assert np.exp2(-tree.bits((np.int64(c) << 9) | np.arange(1, 257))).sum() == pytest.approx(1)


def test_languages_are_learnt_within_the_bytes(docs):
    few, all_ = language.fit(docs, 40_000), language.fit(docs)
    longest = max(len(r.text.encode()) for r in docs.collect())
    assert all(5_000 < t.orders[0][3].sum() <= 10_000 + longest for t in few.trees)
    assert sum(t.orders[0][3].sum() for t in all_.trees) == sum(len(r.text.encode()) + 1 for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 != 2 and r.lang)


def test_hilbert(docs):
    c = np.array(list(itertools.product(range(8), repeat=3)))
    walk = c[np.argsort(hilbert.curve_index(c, 3))]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()
    rows = hilbert.hilbert_shards(docs, ["lang", "source"], 24).collect()
    sizes = collections.Counter(r.shard for r in rows)
    assert len(sizes) == 24 and max(sizes.values()) - min(sizes.values()) <= 1
    at = sorted(rows, key=lambda r: (r.shard, r.slot))
    assert [r.slot for r in at] == [k for s in range(24) for k in range(sizes[s])]
    assert [(r.hilbert, r.doc_id) for r in at] == sorted((r.hilbert, r.doc_id) for r in rows)
    text = {r.doc_id: r.text.encode() for r in docs.collect()}
    assert all(r.size == len(text[r.doc_id]) + 8 and r.text_crc32 == zlib.crc32(text[r.doc_id]) for r in rows)


def test_cells_of_any_number_of_values(spark):
    """One way for few values and for many: in order, no value in two cells, no cell with many more rows than its share but for one hot value."""
    n = 20_000
    rows = spark.range(n).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 50).cast("int")).alias("text"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.sha1(F.col("id").cast("string"))).alias("word"))
    cuts = hilbert._word_cuts(rows, "word", 5)
    assert 20 <= len(cuts) < 32 and cuts == sorted(set(cuts))
    got = collections.Counter(r.c for r in rows.select(hilbert._cell("word", cuts, "string").alias("c")).collect())
    assert sorted(got.values())[-2] < 2 * n / 32
    few = spark.createDataFrame([("a",)] * 5 + [("b",)] * 90 + [(None,)] * 3 + [("c",)] * 5, "word string")
    cuts = hilbert._word_cuts(few, "word", 5)
    cells = {r.word: r.c for r in few.select("word", hilbert._cell("word", cuts, "string").alias("c")).distinct().collect()}
    assert cells[None] == cells["a"] == 0 < cells["b"] < cells["c"]


def test_shards_prune_files(spark, docs, tmp_path):
    import pyarrow.parquet as pq

    folder = str(tmp_path / "shards")
    hilbert.write_shards(docs.withColumn("slot", F.lit("x")), ["lang", "source"], 24, folder)
    back = spark.read.parquet(folder)
    want = {(r.doc_id, r.shard, r.slot) for r in hilbert.hilbert_shards(docs, ["lang", "source"], 24).collect()}
    assert {(r.doc_id, r.shard, r.slot) for r in back.collect()} == want
    assert sorted(map(tuple, back.select(docs.columns).collect())) == sorted(map(tuple, docs.collect()))
    ranges = []
    for f in pathlib.Path(folder).rglob("*.parquet"):
        own = pq.ParquetFile(f).metadata.row_group(0)
        stats = {own.column(k).path_in_schema: own.column(k).statistics for k in range(own.num_columns)}
        ranges.append([(stats[c].min, stats[c].max) for c in ("lang", "source")])
    asked = docs.select("lang", "source").distinct().collect()
    read = sum(all(lo <= v <= hi for v, (lo, hi) in zip(q, r, strict=True)) for q in asked for r in ranges)
    assert read < 0.35 * len(asked) * len(ranges)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder(docs, name):
    from tokenizers import Tokenizer

    texts = [r.text for r in docs.collect()] + ["  a  b\n\n c ", "don't I'm", "a\u00a0 b", "ÀÉ×x9 12 3", "", "   ", "\n x\n", "<|endoftext|> hi", "x!!  \t y 。漢字", " É é 1 2"]
    whole = Tokenizer.from_file(path(name))
    whole.encode_special_tokens = True
    raw = [(t + "\n").encode() for t in texts]
    data, at = np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(r) for r in raw])]
    e = tokens.Encoder(path(name))
    e.units.BITS = 12  # the table overflows now and then
    e.units.clear()
    for i, j in B.pieces(at, 1 << 12):
        for t, ids in zip(texts[i:j], e.encode(data[at[i] : at[j]], at[i : j + 1] - at[i]), strict=True):
            assert ids.tolist() == whole.encode(t, add_special_tokens=False).ids


def test_grammar(spark, docs):
    from tokenizers import Tokenizer

    whole, start = Tokenizer.from_file(path("byte_bpe_50k.json")), 0
    got = {r.doc_id: r for r in grammar.round_trip(docs, path("byte_bpe_50k.json")).collect()}
    for r in sorted(docs.collect()):
        ids = [*whole.encode(r.text, add_special_tokens=False).ids, 2]
        x = got[r.doc_id]
        assert (x.start, x.n_tokens, x.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def left_pairs(seq, at):
    """How often each pair occurs inside the documents, without overlap."""
    n = collections.Counter()
    for a, b in itertools.pairwise([*at.tolist(), len(seq)]):
        k = a
        while k + 1 < b:
            pair = (seq[k], seq[k + 1])
            n[pair] += 1
            k += 2 if pair[0] == pair[1] and k + 2 < b and seq[k + 2] == seq[k] else 1
    return n


def test_repair():
    rng = np.random.default_rng(3)
    ids = np.concatenate([np.tile([5, 6, 7, 5], 200), np.full(101, 9), rng.integers(0, 4, 3000), np.repeat(8, 7)]).astype(np.uint32)
    starts = np.array([0, 333, 334, 900, 2500])
    seq, at, rules, first = grammar.compress(ids, starts)
    flat, ends = grammar.expansions(rules, first)
    assert len(seq) < 0.35 * len(ids) and (grammar.expand(seq, first, flat, ends) == ids).all()
    assert max(left_pairs(seq, at).values()) < grammar.LEAST and max(np.diff(ends)) > 64
    row = {"doc_symbols": grammar.narrow(at), "symbols": grammar.narrow(seq), "rules": grammar.narrow(rules.ravel()), "first_rule": first}
    for k in range(len(at)):  # random access
        assert (grammar.document(row, k) == ids[starts[k] : starts[k + 1] if k + 1 < len(starts) else len(ids)]).all()
    for nothing in (np.zeros(0, np.uint32), np.array([7], np.uint32)):
        assert grammar.compress(nothing, np.arange(len(nothing)))[0].tolist() == nothing.tolist()


def test_no_frequent_pair_is_left_in_a_shard(larger):
    """On real texts; and fewer bytes than plain ids take."""
    e = tokens.encoder(path("byte_bpe_50k.json"))
    raw = [(r.text + "\n").encode() for r in larger[0].orderBy("doc_id").limit(400).collect()]
    data, at = np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(r) for r in raw])]
    own = e.encode(data, at)
    ids, starts = np.concatenate(own), np.cumsum([0, *map(len, own)])[:-1]
    seq, at, rules, first = grammar.compress(ids, starts)
    assert max(left_pairs(seq, at).values()) < grammar.LEAST
    flat, ends = grammar.expansions(rules, first)
    assert (grammar.expand(seq, first, flat, ends) == ids).all()
    assert sum(len(grammar.narrow(x)) for x in (seq, rules.ravel(), np.diff(ends))) < 0.75 * 2 * len(ids)


def test_grammar_of_one_id_in_many_rows(spark):
    """Rows of one doc_id are in one order, whatever partitions they come in, and starts go on from row to row."""
    rows = [(7 if k % 2 else None, f"text {k % 5} of {k}") for k in range(60)]
    runs = [sorted(map(tuple, grammar.round_trip(spark.createDataFrame(rows, "doc_id long, text string").repartition(n), path("byte_bpe_50k.json")).collect()), key=lambda r: r[1]) for n in (1, 7)]
    assert runs[0] == runs[1] and len(runs[0]) == 60
    assert [r[1] for r in runs[0]] == [0, *itertools.accumulate(r[2] for r in runs[0][:-1])]
    assert [r[0] for r in runs[0]] == [None] * 30 + [7] * 30


def test_sketches(docs):
    rows = sorted(((r.doc_id, r.text) for r in docs.collect()), reverse=True)
    got = {r.doc_id: r for r in sketches.versions(docs).collect()}
    prints = {}
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        own, new, nxt = (set(sketches.digests([x.encode()])[0].tolist()) for x in (t, edited, after))
        like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert r.near_edited == pytest.approx(like(own, new)) and r.near_next == pytest.approx(like(own, nxt))
        assert (r.only_own, r.only_edited) == (len(own - new), len(new - own))
        assert prints.setdefault(t, r.fingerprint) == r.fingerprint
        # the returned strings are enough: each gives back its own digests, two of them their likeness
        assert set(sketches.read(r.fingerprint)[1].tolist()) == own
        assert sketches.alike(r.fingerprint, r.edited_fingerprint) == r.near_edited
        assert sketches.alike(r.fingerprint, got[rows[(k + 1) % len(rows)][0]].fingerprint) == r.near_next
    assert len(set(prints.values())) == len(prints)


def test_cells_grow_with_the_difference():
    r = np.random.default_rng(6)
    keys = r.integers(0, 1 << 63, 4000, dtype=np.uint64) * np.uint64(2)
    at = lambda n: np.array([0, n])
    a = np.sort(keys[:2000])
    s, *own = sketches.fingerprints(a, at(2000))
    assert set(own[0].tolist()) == set(a.tolist())
    last = 0
    for d in (0, 1, 4, 20, 100, 500, 2000):
        b = np.sort(keys[d : 2000 + d])
        t, *other = sketches.fingerprints(b, at(2000))
        like, plus, minus, cells = sketches.likeness(s, t, tuple(own), tuple(other))
        assert (plus[0], minus[0]) == (d, d) and like[0] == pytest.approx((2000 - d) / (2000 + d))
        assert last <= cells[0] <= max(6, 16 * d) or (cells[0] == 0 and d > 1000)
        last = cells[0] or last
    half = s.folded(np.array([0]), s.power - 1)
    whole = sketches.Sketches(s.power - 1)
    whole.add(a, np.zeros(2000, np.int64), np.ones(2000, np.int32))
    assert all((getattr(half, c) == getattr(whole, c)).all() for c in ("count", "keys", "check"))


def test_sentencepieces(docs):
    sentencepiece = pytest.importorskip("sentencepiece")
    pb = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    model = pb.ModelProto()
    model.ParseFromString(open(path("piece_bpe_32k.model"), "rb").read())
    model.trainer_spec.model_type = 1  # the library's unigram lattice over the same pieces
    library = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
    e = sentencepieces.Encoder(path("piece_bpe_32k.model"))
    texts = [t[:70].rsplit(" ", 1)[0] for r in docs.limit(60).collect() for t in r.text.split("\n")[:2]] + ["汉字 梦 y", "a\tb", "①é x\u0302 \U0001f600 z"]
    for t in filter(str.strip, texts):
        raw = f" {t}\n".encode()
        ids = e.encode(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0].tolist()
        best = library.nbest_encode_as_ids(t, 4)
        total = lambda x: sum(library.get_score(i) for i in x)
        assert e.pieces.decode(np.array(ids)) == t.encode()
        if not any(map(library.is_byte, ids)):  # the library scores an unknown character, not its bytes
            assert total(ids) == max(map(total, best))
    encoded = sentencepieces.encode(docs, path("piece_bpe_32k.model"))
    assert encoded.where("not round_trip").count() == 0
    back = {r.doc_id: r.text for r in sentencepieces.decode(encoded, path("piece_bpe_32k.model")).collect()}
    assert back == {r.doc_id: r.text for r in docs.collect()}


def brute_sequences(sizes, capacity):
    best = len(sizes)

    def place(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(sizes):
            best = len(rooms)
            return
        for r in sorted(set(rooms)):
            if r >= sizes[k]:
                left = list(rooms)
                left.remove(r)
                place(k + 1, [*left, r - sizes[k]])
        place(k + 1, [*rooms, capacity - sizes[k]])

    sizes = sorted(sizes, reverse=True)
    place(0, [])
    return best


def test_reduction_loses_nothing():
    rng, tally = np.random.default_rng(5), collections.Counter()
    for _ in range(250):
        sizes = rng.integers(rng.integers(1, 8), 21, 9).tolist()
        own = {}
        fixed, left = packing.reduction(dict(collections.Counter(sizes)), 20, own)
        tally.update(own)
        rest = [x for x, n in left.items() for _ in range(n)]
        assert sorted(rest + [x for items, n in fixed for _ in range(n) for x in items]) == sorted(sizes)
        assert all(sum(items) <= 20 for items, _ in fixed) and sum(own.values()) == len(sizes) - len(rest)
        assert sum(n for _, n in fixed) + (brute_sequences(rest, 20) if rest else 0) == brute_sequences(sizes, 20)
        assert not any(packing.dominating(left, sorted(left), x, 20) for x in left)  # nothing is left to fix
    print("pieces fixed by rule:", dict(tally))
    assert set(tally) == {"full", "exact", "alone", "one", "one of two", "two"}


def plain_best_fit(sizes, capacity):
    rooms = []
    for x in sorted(sizes, reverse=True):
        fits = [(r, i) for i, r in enumerate(rooms) if r >= x]
        if fits:
            rooms[min(fits)[1]] -= x
        else:
            rooms.append(capacity - x)
    return sorted(rooms)


def test_best_fit_piece_by_piece():
    rng = np.random.default_rng(6)
    for _ in range(200):
        capacity = int(rng.integers(10, 60))
        sizes = rng.integers(1, capacity + 1, int(rng.integers(1, 80))).tolist()
        patterns = packing.best_fit(dict(collections.Counter(sizes)), capacity)
        assert collections.Counter(x for items, n in patterns for _ in range(n) for x in items) == collections.Counter(sizes)
        assert sorted(capacity - sum(items) for items, n in patterns for _ in range(n)) == plain_best_fit(sizes, capacity)


def test_packing(docs):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path("word_bpe_49k.json"))
    rows = packing.pack(docs, path("word_bpe_49k.json")).collect()
    text = {r.doc_id: r.text for r in docs.collect()}
    own = {i: [*whole.encode(t, add_special_tokens=False).ids, 1] for i, t in text.items()}
    assert collections.Counter(r.doc_id for r in rows) == {i: -(-len(x) // 4096) for i, x in own.items()}
    at = collections.defaultdict(int)
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        ids = own[r.doc_id][r.start : r.start + r.length]
        assert r.start == 4096 * r.piece and r.length == min(4096, len(own[r.doc_id]) - r.start) and r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        assert r.offset == at[r.sequence_id]
        at[r.sequence_id] += r.length
    assert max(at.values()) <= 4096 and len(at) <= -(-sum(at.values()) // 4096) + 1


def test_quality_by_plain_rules(docs, labels):
    """base_failed from words alone, kept from the trees walked node by node over plain statistics."""
    forest = quality_rules.fit(docs, labels)
    kinds = docstats.features()
    plain = {r.doc_id: r for r in docstats.statistics(docs).select("doc_id", *(c.alias(k) for k, (c, _) in kinds.items())).collect()}
    text = {r.doc_id: r.text for r in docs.collect()}
    rows = quality_rules.quality(docs, labels).collect()
    assert {r.kept for r in rows} == {r.base_failed for r in rows} == {True, False}
    for r in rows:
        w = WORD.findall(text[r.doc_id])
        grams = collections.Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        twice = {k + d for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for d in range(3)}
        failed = len(w) < 50 or 100 * len(twice) > 50 * len(w)
        row = [plain[r.doc_id][k] for k in kinds]
        margin = forest.base + sum(v[walk(forest, t, row)] for t, v in enumerate(forest.value))
        p = 1 / (1 + math.exp(-margin))
        assert r.base_failed == failed and r.quality_score == pytest.approx(p) and r.kept == (not failed and p >= quality_rules.KEEP_FROM)


def test_pipeline(spark, sf, docs, labels):
    import corpus_pipeline

    want = docs
    toxic = {r.doc_id for r in toxicity.score(want, labels).where("predicted = 1").collect()}
    want = want.where(~F.col("doc_id").isin(toxic))
    poor = {r.doc_id for r in quality_rules.quality(want, labels).where("not kept").collect()}
    rows = [(r.doc_id, r.text) for r in want.where(~F.col("doc_id").isin(poor)).collect()]
    best = components(sets(rows), 80)
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf).collect()} == {i for i in best if best[i] == i}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality_rules", "minhash", "packing"]


def test_pipeline_on_odd_rows(spark, sf, docs, tmp_path):
    """Null ids, repeated rows, one id with several texts, a pair at 0.82, extra columns, and empty tables."""
    import corpus_pipeline

    kept = {x.doc_id for x in corpus_pipeline.run(spark, sf).select("doc_id").collect()}
    good = next(r.text for r in docs.orderBy("doc_id").collect() if r.doc_id in kept and len(r.text.split()) > 400)
    words = good.split()
    for edits in range(1, 99):
        near = " ".join(f"changed{i}" if i % (len(words) // edits) == 7 and i // (len(words) // edits) < edits else w for i, w in enumerate(words))
        both = sets([(0, good), (1, near)])
        likeness = len(both[0] & both[1]) / len(both[0] | both[1])
        if likeness < 0.845:
            break
    assert 0.8 <= likeness < 0.85
    rows = [(1, good), (1, good), (2, None), (3, ""), (None, good), (None, None), (4, near), (5, good + " x " * 3), (1, "too few words")]
    rows = [(i, t, "en", "s", 0, "extra", 1.0) for i, t in rows]
    folder = tmp_path / "in"
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, part string, score double").write.parquet(str(folder / "documents.parquet"))
    spark.read.parquet(f"{sf}/labels.parquet").limit(0).write.parquet(str(folder / "labels.parquet"))
    table = spark.read.parquet(str(folder / "documents.parquet"))
    got = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        table = stage(spark, table, str(folder))
        assert table.columns == corpus_pipeline.COLUMNS
        got[name] = collections.Counter((r.doc_id, r.text) for r in table.collect())
    assert got["toxicity"] == collections.Counter((i, t) for i, t, *_ in rows)  # no labels: nothing is toxic
    assert set(got["quality_rules"]) == {(1, good), (None, good), (4, near), (5, good + " x " * 3)} and got["quality_rules"][1, good] == 2
    assert got["minhash"] == {(1, good): 2, (None, good): 1}  # a row repeated with its id is one document; a null id is in no group
    out = corpus_pipeline.run(spark, str(folder)).collect()
    assert collections.Counter(r.doc_id for r in out) == {1: 2, None: 1}
    spark.read.parquet(str(folder / "documents.parquet")).limit(0).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    spark.read.parquet(f"{sf}/labels.parquet").limit(0).write.parquet(str(tmp_path / "none" / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).collect() == []


def test_one_toxic_row_of_an_id(spark, larger):
    """Only the toxic row of an id goes, and a toxic row without an id goes too."""
    import corpus_pipeline

    docs, labels = larger
    scored = {r.doc_id: r.predicted for r in toxicity.score(docs, labels).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    bad, fine = next(i for i in texts if scored[i]), next(i for i in texts if not scored[i])
    more = spark.createDataFrame([(fine, texts[bad], "en", "s", 0), (None, texts[bad], "en", "s", 0), (None, texts[fine], "en", "s", 0)], DOCS)
    left = collections.Counter((r.doc_id, r.text) for r in corpus_pipeline.without_toxic(spark, docs.unionByName(more), "/root/testdata/sf0.1").where(F.col("doc_id").isNull() | (F.col("doc_id") == fine)).collect())
    assert left == {(fine, texts[fine]): 1, (None, texts[fine]): 1}


def test_long_runs():
    """Runs without a space: a reading of 120,000 characters ends, and paths are the same whichever stretches are probed together."""
    model = np.log(np.random.default_rng(3).dirichlet(np.ones(28), (28, 28)))
    restore = toxicity.restorer(model)
    run = "h4t" * 40_000
    assert set(restore(run)) <= set("hat") and len(restore(run)) >= 2 * 40_000
    slow = {n: sentencepieces.Encoder(path("piece_bpe_32k.model")).pieces.best(np.frombuffer(("▁" + "banana" * n).encode("utf-32-le"), np.uint32).astype(np.uint64)[None])[0] for n in (3, 300)}
    kept, sentencepieces.STRETCH = sentencepieces.STRETCH, 7
    try:
        for n, ids in slow.items():
            assert sentencepieces.Encoder(path("piece_bpe_32k.model")).pieces.best(np.frombuffer(("▁" + "banana" * n).encode("utf-32-le"), np.uint32).astype(np.uint64)[None])[0] == ids
    finally:
        sentencepieces.STRETCH = kept
