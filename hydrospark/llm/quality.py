"""Quality classifier: histogram gradient-boosted trees over document statistics.

Tasks turn each text into STATISTICS, plain numbers; they alone are the inputs. The trees are fitted to a
bounded sample (about ``MOST_ROWS`` labelled rows, those with low hashes of their ids): statistics are cut into
BINS quantile bins, and each level of a tree sums gradients by node, statistic and bin to find its splits. The
fitted trees are four flat arrays, so that a task sends a batch of rows down all trees with array indexing.

Defined cases: a null text is an empty one and gets a score like any other; rows without a quality label are
not learned from, rows with several labels count once for each; without any labelled row all scores are
0.5; equal texts get equal scores.
"""

from __future__ import annotations

import dataclasses
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from hydrospark.llm.common import about, fold, small_batches, tidy, whole_text
from hydrospark.plans.scratch import written

MOST_ROWS = 20_000
BINS = 64
TREES, DEPTH, RATE, LEAST_ROWS, RIDGE = 80, 4, 0.15, 10, 1.0

STATISTICS = [
    "log_bytes", "log_words", "word_length", "upper", "digits", "blanks", "lines_per_word", "non_ascii", "punctuation", "symbols", "bars", "ends", "entropy",
    "distinct_words", "top_word", "repeated_next", "distinct_pairs", "repeated_lines", "distinct_lines", "short_words", "long_words", "longest_word", "symbol_words", "upper_words", "digit_words",
]
_SYMBOLS = np.frombuffer(b"#$%&*@^~<>{}[]\\/_=+`", np.uint8)
_ENDS = np.frombuffer(b".!?", np.uint8)
_POINTS = np.frombuffer(b".,;:!?'\"()-", np.uint8)


def statistics(text: str) -> list[float]:
    """STATISTICS of one text; of an empty one all are 0."""
    raw = text.encode()
    if not raw:
        return [0.0] * len(STATISTICS)
    n = len(raw)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    p = counts[counts > 0] / n
    words = text.split()
    m = max(1, len(words))
    sizes = np.array([len(w) for w in words] or [0])
    seen = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    distinct_lines = set(lines)
    ends = [w[-1] for w in words]
    return [
        np.log1p(n), np.log1p(len(words)), sizes.mean(), counts[65:91].sum() / n, counts[48:58].sum() / n, counts[32] / n, counts[10] / m, counts[128:].sum() / n,
        counts[_POINTS].sum() / n, counts[_SYMBOLS].sum() / n, counts[124] / m, counts[_ENDS].sum() / m, float(-(p * np.log2(p)).sum()),
        len(seen) / m, max(seen.values(), default=0) / m, sum(a == b for a, b in zip(words, words[1:])) / m, len(set(zip(words, words[1:]))) / m, 1 - len(distinct_lines) / max(1, len(lines)), float(np.log1p(len(distinct_lines))),
        (sizes <= 2).mean(), (sizes >= 10).mean(), np.log1p(sizes.max()), sum(not x.isalnum() and x not in ".,;:!?" for x in ends) / m, sum(w.isupper() for w in words) / m, sum(w[0].isdigit() for w in words) / m,
    ]


def with_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, x array<float>) of each row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = np.array([statistics(t) for t in batch.column(1).to_pylist()], np.float32).reshape(-1)
            bounds = np.arange(0, len(flat) + 1, len(STATISTICS), dtype=np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat))], ["doc_id", "x"])

    return docs.select("doc_id", whole_text().alias("text")).mapInArrow(tidy(work), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, x array<float>")


@dataclasses.dataclass
class Trees:
    """All nodes of all trees, tree after tree, level by level: node i of a tree has children 2i + 1 and 2i + 2."""

    statistic: np.ndarray  # (trees, inner nodes)
    cut: np.ndarray  # go right if the statistic is above it
    leaf: np.ndarray  # (trees, leaves)
    start: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of ``x``."""
        rows = np.arange(len(x))
        total = np.full(len(x), self.start)
        for statistic, cut, leaf in zip(self.statistic, self.cut, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, statistic[node]] > cut[node])
            total += leaf[node - (2**DEPTH - 1)]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray) -> Trees:
    """Boosted trees with logistic loss; ties of gain go to the first statistic and bin."""
    n_stats, inner, leaves = len(STATISTICS), 2**DEPTH - 1, 2**DEPTH
    none = Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)), 0.0)
    if not len(y):
        return none
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    none.start = float(np.log(share / (1 - share)))
    if y.min() == y.max():
        return none
    cuts = [np.unique(np.quantile(x[:, k], np.arange(1, BINS) / BINS)) for k in range(n_stats)]
    binned = np.stack([np.searchsorted(c, x[:, k], side="left") for k, c in enumerate(cuts)], axis=1)
    place = binned + np.arange(n_stats) * BINS
    total = np.full(len(y), none.start)
    statistic, cut, leaf = [], [], []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-total))
        grad, hess = p - y, p * (1 - p)
        tree_s, tree_c = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(len(y), np.int64)  # within its level
        for level in range(DEPTH):
            width = 2**level
            at = (node[:, None] * (n_stats * BINS) + place).ravel()
            g, h, n = (np.bincount(at, w, width * n_stats * BINS).reshape(width, n_stats, BINS) for w in (np.repeat(grad, n_stats), np.repeat(hess, n_stats), None))
            gl, hl, nl = g.cumsum(2), h.cumsum(2), n.cumsum(2)
            gt, ht, nt = gl[:, :1, -1:], hl[:, :1, -1:], nl[:, :1, -1:]
            gain = gl**2 / (hl + RIDGE) + (gt - gl) ** 2 / (ht - hl + RIDGE) - gt**2 / (ht + RIDGE)
            gain = np.where((nl >= LEAST_ROWS) & (nt - nl >= LEAST_ROWS), gain, 0.0)
            best = gain.reshape(width, -1).argmax(1)
            s, b = best // BINS, best % BINS
            real = gain.reshape(width, -1).max(1) > 1e-6
            for k in np.flatnonzero(real):
                tree_s[width - 1 + k], tree_c[width - 1 + k] = s[k], cuts[s[k]][b[k]]
            right = real[node] & (binned[np.arange(len(y)), s[node]] > b[node])
            node = 2 * node + right
        g, h = np.bincount(node, grad, leaves), np.bincount(node, hess, leaves)
        value = -RATE * g / (h + RIDGE)
        total += value[node]
        statistic.append(tree_s)
        cut.append(tree_c)
        leaf.append(value)
    return Trees(np.array(statistic), np.array(cut), np.array(leaf), none.start)


def learn(stats: DataFrame, labels: DataFrame, label: str = "quality", most_rows: int = MOST_ROWS) -> Trees:
    """Trees from about ``most_rows`` labelled rows of ``stats`` (doc_id, x), or all if there are no more; only they reach the driver."""
    rows = labels.select(F.col("doc_id").alias("l_id"), F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1))
    rows = about(rows, "l_id", rows.count(), most_rows)
    sample = stats.join(rows, F.col("doc_id") == F.col("l_id")).select("doc_id", "x", "y").toPandas()
    x = np.array(sample["x"].tolist(), np.float32).astype(float) if len(sample) else np.zeros((0, len(STATISTICS)))
    # in one order whatever the tasks were, as sums of floats depend on it
    order = np.lexsort((*x.T, sample["y"], sample["doc_id"])) if len(sample) else np.zeros(0, int)
    return fit(x[order], sample["y"].to_numpy(float)[order])


def score(stats: DataFrame, trees: Trees) -> DataFrame:
    """``stats`` (doc_id, x) to (doc_id, score)."""
    shared = stats.sparkSession.sparkContext.broadcast(trees)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = np.array(pdf["x"].tolist(), np.float32).astype(float).reshape(len(pdf), len(STATISTICS))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "score": shared.value.scores(x)})

    return stats.mapInPandas(work, f"doc_id {stats.schema['doc_id'].dataType.simpleString()}, score double")


def score_quality(docs: DataFrame, labels: DataFrame, held_out: int = 2, folds: int = 4, threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row; labels of fold ``held_out`` are not learned from."""
    with small_batches(docs.sparkSession):
        stats = written(with_statistics(docs), "quality-statistics")
    trees = learn(stats, labels.where(fold("doc_id", folds) != held_out))
    found = score(stats, trees)
    return found.select("doc_id", (fold("doc_id", folds) == held_out).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
