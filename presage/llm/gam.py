"""A generalised additive model with pairwise interactions that scores the quality of texts.

Each feature of a text is cut into bins at quantiles of the training rows. Boosting goes
round the features in a cycle: a tree of at most four leaves is fitted to the gradient
over one feature's bins and added to that feature's lookup table. Then the pairs with the
largest gain left in the residual get tables of two features in the same way. A score is
the logistic of the sum of a table value for each feature and pair, added bin by bin for
whole batches.

The model is fitted on at most ``TRAIN_ROWS`` labelled rows, drawn by a hash of doc_id
when there are more; features are the text's alone. Every text is scored whole.

Defined results: a null text is empty and gets the score of all-zero features; labels
without doc_id or quality teach nothing; without labels of both kinds the score is the
share of label 1 (0.5 without any); a null doc_id is scored and not held out; repeated
rows get equal rows; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presage.llm.cascade import Stats
from presage.llm.common import small_batches

TRAIN_ROWS = 20_000
BINS, PAIR_BINS, PAIRS = 64, 12, 6
ROUNDS, PAIR_ROUNDS, RATE, RIDGE = 120, 40, 0.15, 2.0

FEATURES = (
    "log_words", "word_length", "symbols", "dup_lines", "repeat_words", "upper", "digits", "marks",
    "stops", "distinct", "log_lines", "line_words", "not_ascii", "longest",
)


def features(text: str | None) -> list[float]:
    s = Stats(text)
    words, chars, lines = max(s.n_words, 1), max(len(s.text), 1), max(s.n_lines, 1)
    return [
        np.log1p(s.n_words), s.word_chars / words, s.n_symbols / words, s.n_dup_lines / lines, s.n_repeat_words / words,
        s.n_upper / max(s.n_upper + s.n_lower, 1), s._count(b"0123456789") / chars, s.n_marks / words,
        s._count(b".,;:") / words, len(set(s.words)) / words, np.log1p(s.n_lines), s.n_words / lines,
        (len(s.data) - len(s.text)) / chars, np.log1p(max(map(len, s.words), default=0)),
    ]


def _tree(g: np.ndarray, h: np.ndarray, leaves: int = 4) -> np.ndarray:
    """Values of a shallow tree over ordered bins, from sums of gradients and curvatures."""
    cg, ch = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])

    def worth(a, b):
        return (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + RIDGE)

    parts = [(0, len(g))]
    while len(parts) < leaves:
        best = None
        for k, (a, b) in enumerate(parts):
            if b - a > 1:
                cuts = np.arange(a + 1, b)
                gain = worth(a, cuts) + worth(cuts, b) - worth(a, b)
                at = int(np.argmax(gain))
                if best is None or gain[at] > best[0]:
                    best = (gain[at], k, int(cuts[at]))
        if best is None or best[0] <= 1e-9:
            break
        _, k, cut = best
        a, b = parts[k]
        parts[k : k + 1] = [(a, cut), (cut, b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + RIDGE)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Four leaves over two features: one cut of the first, then one cut of the second on either side."""
    best = None
    for cut in range(1, g.shape[0]):
        out = np.empty_like(g)
        gain = 0.0
        for rows in (slice(None, cut), slice(cut, None)):
            sg, sh = g[rows].sum(axis=0), h[rows].sum(axis=0)
            values = _tree(sg, sh, 2)
            out[rows] = values
            gain += float((values * sg).sum())
        if best is None or gain > best[0]:
            best = (gain, out)
    return best[1] if best else np.zeros_like(g)


@dataclass
class Model:
    edges: list[np.ndarray]
    pair_edges: list[np.ndarray]
    intercept: float
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for k, table in enumerate(self.tables):
            total += table[np.searchsorted(self.edges[k], x[:, k], "right")]
        coarse = {k: np.searchsorted(self.pair_edges[k], x[:, k], "right") for pair in self.pairs for k in pair[:2]}
        for i, j, table in self.pairs:
            total += table[coarse[i], coarse[j]]
        return 1.0 / (1.0 + np.exp(-np.clip(total, -35, 35)))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.arange(1, bins) / bins, method="inverted_cdf")) if len(x) else np.empty(0)


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    share = float(y.mean()) if len(y) else 0.5
    n_features = x.shape[1]
    edges, pair_edges = [_edges(x[:, k], BINS) for k in range(n_features)], [_edges(x[:, k], PAIR_BINS) for k in range(n_features)]
    limited = min(max(share, 1e-4), 1 - 1e-4)
    model = Model(edges, pair_edges, float(np.log(limited / (1 - limited))))
    if not 0 < share < 1:
        return model
    bins = [np.searchsorted(edges[k], x[:, k], "right") for k in range(n_features)]
    model.tables = [np.zeros(len(e) + 1) for e in edges]
    total = np.full(len(y), model.intercept)

    def slopes():
        p = 1.0 / (1.0 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for k in range(n_features):
            g, h = slopes()
            size = len(model.tables[k])
            step = RATE * _tree(np.bincount(bins[k], g, size), np.bincount(bins[k], h, size))
            model.tables[k] += step
            total += step[bins[k]]

    coarse = [np.searchsorted(pair_edges[k], x[:, k], "right") for k in range(n_features)]

    def grid(i, j, values):
        shape = (len(pair_edges[i]) + 1, len(pair_edges[j]) + 1)
        return np.bincount(coarse[i] * shape[1] + coarse[j], values, shape[0] * shape[1]).reshape(shape)

    g, h = slopes()
    gains = []
    for i, j in combinations(range(n_features), 2):
        gg, hh = grid(i, j, g), grid(i, j, h)
        gains.append((float((_pair_tree(gg, hh) * gg).sum()), i, j))
    best = sorted(gains, reverse=True)[:PAIRS]
    model.pairs = [(i, j, np.zeros((len(pair_edges[i]) + 1, len(pair_edges[j]) + 1))) for _, i, j in best]
    for _ in range(PAIR_ROUNDS):
        for i, j, table in model.pairs:
            g, h = slopes()
            step = RATE * _pair_tree(grid(i, j, g), grid(i, j, h))
            table += step
            total += step[coarse[i], coarse[j]]
    return model


def remainder(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5))


def featured(docs: DataFrame, *carried: str) -> DataFrame:
    """``carried`` columns (long) and features array<double> of each text."""
    small_batches(docs.sparkSession)

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carried), pa.array(rows, pa.list_(pa.float64()))], [*carried, "features"])

    return docs.select(*(F.col(c).cast("long").alias(c) for c in carried), "text").mapInArrow(
        compute, "".join(f"{c} long, " for c in carried) + "features array<double>")


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, seed: int = 23) -> Model:
    """Fit on labelled documents outside the held-out fifth. The sample is ``rows`` at most and so may be broadcast."""
    usable = labels.where(remainder(F.col("doc_id")) != 0).where("quality is not null").select("doc_id", F.col("quality").cast("long").alias("y"))
    n = usable.count()
    if n > rows:
        limit = int(0.95 * rows / n * (1 << 40))
        usable = usable.where(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 40)) < limit)
    drawn = F.broadcast(usable.limit(rows).withColumnRenamed("doc_id", "labelled"))
    texts = docs.select("doc_id", "text").join(drawn, F.col("doc_id") == F.col("labelled"))
    got = featured(texts, "doc_id", "y").toArrow().sort_by([("doc_id", "ascending"), ("y", "ascending")])
    x = np.array(got.column("features").to_pylist(), float).reshape(-1, len(FEATURES))
    return fit(x, got.column("y").to_numpy().astype(float))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score: a row for each document."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t) for t in batch.column(1).to_pylist()], float).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
