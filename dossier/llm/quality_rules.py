"""Quality rules: boosted trees over document statistics, monotonic in the chosen ones, score whole texts as flat numpy arrays.

Learnt from at most SAMPLE labelled documents of each quality (their ids by a hash, crc32 of the id modulo 4 not 2); statistics are those of all words.
A text fails the base rules with fewer than 50 words or with over half of its words in repeated 3-word windows. Nulls and empty texts fail; a text of any length is
read whole; repeated rows, and texts of equal statistics, get the same answer each; without labels of both kinds only the base rules decide; an empty table gives
an empty one; other columns are ignored, but for those that a caller asks to be carried.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.llm.common import labelled, prepare, remainder
from dossier.llm.docstats import features, statistics
from dossier.llm.trees import Forest, boosted

#: Labelled documents of each class that a model is fitted to, at most.
SAMPLE = 8000
#: A document goes when the trees give good quality less than this.
KEEP_FROM = 0.4


def sample(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Features and quality of the learning rows."""
    rows = labelled(docs, labels, "quality", remainder(4) != 2, bound)
    kinds = features()
    stats = statistics_with_label(rows).select("label", *(c.alias(k) for k, (c, _) in kinds.items())).toPandas()
    return stats[list(kinds)].to_numpy(float).reshape(-1, len(kinds)), stats["label"].to_numpy(float)


def statistics_with_label(rows: DataFrame) -> DataFrame:
    """The label travels as the id."""
    return statistics(rows.select(F.col("label").alias("doc_id"), "text")).withColumnRenamed("doc_id", "label")


def fit(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> Forest | None:
    x, y = sample(docs, labels, bound)
    if len(set(y)) < 2:
        return None
    order = np.lexsort((*x.T, y))  # the same forest whichever way the rows come
    return boosted(x[order], y[order], np.array([s for _, s in features().values()]))


def _score(forest: Forest | None, names: list[str]):
    def run(batches):
        for b in batches:
            x = np.stack([b[k].to_numpy() for k in names], 1)
            p = forest.probability(x) if forest else np.ones(len(x))
            yield b.drop_columns(names).append_column("quality_score", pa.array(p))

    return run


def quality(docs: DataFrame, labels: DataFrame, keep_from: float = KEEP_FROM, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the counts, base_failed, kept, quality_score and the columns to carry of each row."""
    prepare(docs.sparkSession)
    kinds = features()
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    stats = statistics(docs, carry).select("doc_id", *carry, *base, *(c.alias(f"f_{k}") for k, (c, _) in kinds.items()))
    names = [f"f_{k}" for k in kinds]
    shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stats.drop(*names).schema)
    scored = stats.mapInArrow(_score(fit(docs, labels), names), f"{shape}, quality_score double")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return scored.select("doc_id", *base, failed.alias("base_failed"), (~failed & (F.col("quality_score") >= keep_from)).alias("kept"), "quality_score", *carry)
