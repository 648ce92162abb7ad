import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from dossier.llm import periods as P
from dossier.llm import queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(ws, length, exponent):
    """Each period in turn: stretches in which words that far apart are equal, and no smaller period fits."""
    n, out = len(ws), set()
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and ws[j] == ws[j + q]:
                j += 1
            size = j + q - i
            if j > i and size >= length and size >= exponent * q and not any(all(ws[k] == ws[k + p] for k in range(i, i + size - p)) for p in range(1, q)):
                out.add((i, size, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(ws, found):
    gone = {k for a, size, q in found for k in range(a + q, a + size)}
    return " ".join(w for k, w in enumerate(ws) if k not in gone)


def texts(r, n):
    for _ in range(n):
        w = [chr(97 + x) for x in r.integers(0, int(r.integers(1, 4)), int(r.integers(0, 60)))]
        if len(w) > 2 and r.random() < 0.6:
            a, p = int(r.integers(0, len(w))), int(r.integers(1, 7))
            w = [x if i < a else w[min(a + (i - a) % p, len(w) - 1)] for i, x in enumerate(w)]
        yield w


@pytest.mark.parametrize("group", [1, 8, 1 << 15])
@pytest.mark.parametrize(("length", "exponent"), [(6, 4), (2, 2), (5, 2.5), (6, 3)])
def test_runs_and_collapsed_texts(monkeypatch, group, length, exponent):
    monkeypatch.setattr(P, "GROUP", group)
    docs = list(texts(np.random.default_rng(group + length), 250))
    data = np.frombuffer("".join(" ".join(d) + "\n" for d in docs).encode(), np.uint8)
    at = np.r_[0, np.cumsum([len(" ".join(d)) + 1 for d in docs])]
    begin, end, first, start, span, q = P.found(data, at, length, exponent)
    text, ends = P.collapsed(data, begin, end, first, start, span, q)
    doc = np.searchsorted(first, start, "right") - 1
    assert len(start) > 20
    for d, w in enumerate(docs):
        own = [(int(a - first[d]), int(b), int(c)) for a, b, c in zip(start[doc == d], span[doc == d], q[doc == d], strict=True)]
        assert own == brute(w, length, exponent)
        assert text[ends[d] : ends[d + 1]].tobytes().decode() == collapsed(w, own)


def test_extensions():
    r = np.random.default_rng(4)
    for _ in range(40):
        s = [*r.integers(1, int(r.integers(2, 5)), int(r.integers(1, 70))).tolist(), 0]
        i, j = r.integers(0, len(s), (2, 200))
        i, j = i[i != j], j[i != j]
        lce = P.Extensions(s)
        for a, b, k in zip(i.tolist(), j.tolist(), lce(i, j).tolist(), strict=True):
            assert s[a : a + k] == s[b : b + k] and s[a + k : a + k + 1] != s[b + k : b + k + 1]
        up, down = lce.ranks(1)
        assert up.tolist() == [sorted(range(len(s)), key=lambda x: s[x:]).index(x) for x in range(len(s))]
        turned = [-x if x else -9 for x in s]
        assert down.tolist() == [sorted(range(len(s)), key=lambda x: turned[x:]).index(x) for x in range(len(s))]


ODD = [(1, None, "a"), (2, "", "b"), (3, " \t\n ", None), (4, "ha " * 9, "c"), (4, "ha " * 9, "c"), (None, "x y " * 5, "d"), (5, "é\x0bé é\ré é\x0cé\té", "e"), (6, "one two three", "f"), (7, "\x1ca \x1ca \x1ca \x1ca \x1ca \x1ca", "g")]


def test_odd_rows(spark):
    df = spark.createDataFrame(ODD, "doc_id long, text string, runs string")
    got = P.periodic(df)
    rows = sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got.collect()), key=str)
    want = []
    for i, t, _ in ODD:
        ws = WORD.findall(t or "")
        f = brute(ws, 6, 4)
        want.append((i, len(ws), f, collapsed(ws, f)))
    assert rows == sorted(want, key=str)
    assert P.periodic(df.limit(0)).collect() == []
    with pytest.raises(ValueError, match="twice"):
        P.periodic(df, exponent=1.5)


def test_long_text(spark):
    """Two million characters: one word throughout, and a long period."""
    long = " ".join(f"w{k % 40000}" for k in range(200000))
    got = {r.doc_id: r for r in P.periodic(spark.createDataFrame([(1, "a " * 1_000_000), (2, long)], "doc_id long, text string")).collect()}
    assert [tuple(x) for x in got[1].runs] == [(0, 1_000_000, 1)] and got[1].collapsed == "a"
    assert [tuple(x) for x in got[2].runs] == [(0, 200000, 40000)] and got[2].n_words == 200000


def test_query(spark, sf):
    """Edited texts, digests and the greatest run of each row of a whole table, against a plain program."""
    got = {r.doc_id: r for r in queries.op11_periodic_runs(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect()
    assert len(got) == len(docs)
    found = 0
    for d in docs:
        ws, h = WORD.findall(d.text), zlib.crc32(str(d.doc_id).encode())
        n, g = len(ws), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            ws = [w if i < a else ws[a + (i - a) % p] for i, w in enumerate(ws)]
        f = brute(ws, 6, 4) if len(ws) < 400 else [(int(a), int(b), int(c)) for a, b, c in zip(*slow(ws), strict=True)]
        found += len(f)
        top = min(f, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=None)
        want = (len(f), *(top or (None,) * 3), 1000 * top[1] // top[2] if top else None)
        r = got[d.doc_id]
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli) == want
        assert r.runs_sha256 == hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in f).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapsed(ws, f).encode()).hexdigest()
    assert found > 5


def slow(ws):
    """brute() with numpy for long texts: equal neighbours at each distance."""
    number = np.unique(np.array(ws, object).astype(str), return_inverse=True)[1]
    out = []
    for q in range(1, len(ws) // 4 + 1):
        same = np.r_[False, number[q:] == number[:-q], False].astype(np.int8)
        edge = np.diff(same)
        for i, j in zip(np.flatnonzero(edge > 0).tolist(), np.flatnonzero(edge < 0).tolist(), strict=True):
            size = j + q - i
            if size >= max(6, 4 * q) and not any((number[i : i + size - p] == number[i + p : i + size]).all() for p in range(1, q)):
                out.append((i, size, q))
    out.sort(key=lambda r: (r[0], r[2]))
    return tuple(np.array([r[k] for r in out], np.int64) for k in range(3))
