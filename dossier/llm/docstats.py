"""Exact statistics of whole texts, a batch at a time: words, symbols, repeated lines and word windows, letter cases. Nulls count as empty texts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.llm import buffers as B
from dossier.llm.common import frugal, lines

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_upper", "n_letters", "n_digits", "n_shouts", "n_stops", "n_short", "n_long"]


def _table(chars: str | bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars.encode() if isinstance(chars, str) else chars)] = True
    return out


SYMBOLS, UPPER, DIGITS = _table("#*$%&|<>"), _table(bytes(range(65, 91))), _table("0123456789")
LETTERS = UPPER | _table(bytes(range(97, 123))) | _table(bytes(range(0xC3, 0xF5)))
#: Bytes that begin a character of a word.
IN_WORDS = ~B.SPACES & ~_table(bytes(range(0x80, 0xC0)))
SHOUT, STOP = _table("!"), _table(".")


def counts(data: np.ndarray, at: np.ndarray, repeat: int = 3) -> dict[str, np.ndarray]:
    """COUNTS for each text of data, which ends in a newline."""
    n = len(at) - 1
    inside = lambda marks: np.diff(np.r_[0, np.cumsum(marks, dtype=np.int64)][at])
    begin, end = B.word_bounds(data)
    first = np.searchsorted(begin, at)
    per = lambda marks: np.diff(np.r_[0, np.cumsum(marks, dtype=np.int64)][first])
    doc = np.repeat(np.arange(n, dtype=np.uint64), np.diff(first))
    apart = B.mix(doc + np.uint64(1))
    words = B.hashed_runs(data, begin, end)
    own = words ^ apart
    twice = np.zeros(len(words), bool)
    if len(words) >= repeat:
        grams = B.combine(words, repeat) ^ apart[: len(words) - repeat + 1]
        fits = np.flatnonzero(doc[: len(grams)] == doc[repeat - 1 :])
        again = fits[B.repeated(grams[fits])]
        for k in range(repeat):
            twice[again + k] = True
    stop = np.flatnonzero(data == 10)
    start = np.r_[0, stop[:-1] + 1] if len(stop) else stop
    worded = np.searchsorted(begin, stop) > np.searchsorted(begin, start)
    start, stop = start[worded], stop[worded]
    line_first = np.searchsorted(start, at)
    line_doc = np.repeat(np.arange(n, dtype=np.uint64), np.diff(line_first))
    seen = B.later(B.hashed_runs(data, start, stop) ^ B.mix(line_doc + np.uint64(1)))
    chars = np.r_[0, np.cumsum(IN_WORDS[data], dtype=np.int64)]
    size = chars[end] - chars[begin]
    return {
        "n_words": np.diff(first), "word_chars": inside(IN_WORDS[data]), "n_symbols": inside(SYMBOLS[data]), "n_dup_lines": np.diff(np.r_[0, np.cumsum(seen)][line_first]),
        "n_repeat_words": per(twice), "n_lines": np.diff(line_first), "n_distinct": np.diff(first) - per(B.later(own)), "n_upper": inside(UPPER[data]), "n_letters": inside(LETTERS[data]), "n_digits": inside(DIGITS[data]),
        "n_shouts": inside(SHOUT[data]), "n_stops": per(STOP[data[end - 1]]), "n_short": per(size <= 3), "n_long": per(size >= 12),
    }


def _run(carried: list[str]):
    def run(batches):
        for batch in batches:
            data, at = B.column(batch["text"])
            for i, j in B.pieces(at):
                found = counts(data[at[i] : at[j]], at[i : j + 1] - at[i])
                yield pa.RecordBatch.from_arrays([*(batch[c].slice(i, j - i) for c in carried), *(pa.array(found[c].astype(np.int64)) for c in COUNTS)], names=[*carried, *COUNTS])

    return run


def statistics(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns to carry and COUNTS of each row of docs."""
    rows = lines(docs, *carry)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.drop("text").schema)
    return rows.mapInArrow(frugal(_run(["doc_id", *carry])), f"{kinds}, " + ", ".join(f"{c} long" for c in COUNTS))


def _per(a: str, b: str) -> Column:
    return F.col(a) / F.greatest(F.col(b), F.lit(1))


#: What the models see: shares, so that a long text is no other kind of text than a short one. The sign says which way quality may go with it (0: either).
FEATURES: dict[str, tuple[Column, int]] = {}


def features() -> dict[str, tuple[Column, int]]:
    if not FEATURES:
        FEATURES.update(
            words=(F.log1p(F.col("n_words").cast("double")), 0), word_length=(_per("word_chars", "n_words"), 0), symbols=(_per("n_symbols", "n_words"), -1), dup_lines=(_per("n_dup_lines", "n_lines"), -1),
            repeats=(_per("n_repeat_words", "n_words"), -1), distinct=(_per("n_distinct", "n_words"), 0), upper=(_per("n_upper", "n_letters"), -1), digits=(_per("n_digits", "word_chars"), 0), shouts=(_per("n_shouts", "n_words"), -1),
            stops=(_per("n_stops", "n_words"), 0), short=(_per("n_short", "n_words"), 0), long=(_per("n_long", "n_words"), 0), lines=(_per("n_lines", "n_words"), 0),
        )
    return FEATURES
