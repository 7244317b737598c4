"""Quality classifier: a generalised additive model with pairwise interactions, boosted cyclically, scored by adding up bins.

Each feature is cut into quantile bins. Rounds of boosting visit one feature after the other and add a shallow tree (two cuts of its bins) fitted to
the gradient, so that each feature ends as a lookup table over its bins. The pairs whose residual gain on a coarse grid is largest are then boosted the
same way, with one cut on each axis, into tables over two features' bins. A score is the logistic function of the sum of looked-up values.

Features are counts of the text as a whole, made by built-in functions; a bounded sample of labelled documents is learnt from by its features alone, so
texts of any length take part and none reaches the driver. Rows of a class that the sample holds fewer of weigh more, so its size doesn't move the scores.

Nulls and empties: a null text counts as empty, whose ratios are 0, and gets the score of those bins. Repeated rows score alike; of rows that share an
id with a label, the one with the least features is learnt from. An empty table gives an empty result. Other columns pass through, but one named
`score` is replaced. Without labels of both classes the score is the share of label 1 (0.5 without labels).
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Sample, boxed, labelled_rows, unboxed, words
from .quality_rules import measures

FEATURES = ("log_words", "word_length", "symbols", "exclaims", "stop_words", "alphabetic", "upper", "stutter", "repeats", "distinct_words", "dup_lines", "words_a_line")


def text_features(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs as a struct _row, and a double column `_f_<name>` for each of FEATURES."""
    body = F.col("_row").getField(text)
    rows = docs.select(boxed(docs)).withColumn("_ws", words(body))
    m = measures(body)
    per_word = lambda c: F.coalesce(F.try_divide(m[c].cast("double"), m["n_words"].cast("double")), F.lit(0.0))
    per_char = lambda c: F.coalesce(F.try_divide(m[c].cast("double"), m["word_chars"].cast("double")), F.lit(0.0))
    made: dict[str, Column] = {
        "log_words": F.log1p(m["n_words"].cast("double")),
        "word_length": per_word("word_chars"),
        "symbols": per_word("n_symbols"),
        "exclaims": per_word("n_exclaim"),
        "stop_words": per_word("n_stop_words"),
        "alphabetic": per_char("n_alpha"),
        "upper": per_char("n_upper"),
        "stutter": per_word("n_stutter"),
        "repeats": per_word("n_repeat_words"),
        "distinct_words": F.coalesce(F.try_divide(F.size(F.array_distinct("_ws")).cast("double"), F.size("_ws").cast("double")), F.lit(0.0)),
        "dup_lines": F.coalesce(F.try_divide(m["n_dup_lines"].cast("double"), m["n_lines"].cast("double")), F.lit(0.0)),
        "words_a_line": F.log1p(F.coalesce(F.try_divide(m["n_words"].cast("double"), m["n_lines"].cast("double")), F.lit(0.0))),
    }
    return rows.select("_row", *(made[f].alias(f"_f_{f}") for f in FEATURES))


@dataclass
class Gam:
    """edges: cuts of each feature. single: a table a feature. pairs: (i, j, table over coarse bins). coarse: the coarse bin of each bin."""

    start: float
    edges: list[np.ndarray] = field(default_factory=list)
    single: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        bins = [np.searchsorted(e, x[:, i], side="right") for i, e in enumerate(self.edges)]
        for b, t in zip(bins, self.single):
            total += t[b]
        for i, j, t in self.pairs:
            total += t[self.coarse[i][bins[i]], self.coarse[j][bins[j]]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def two_cuts(g: np.ndarray, h: np.ndarray, ridge: float, least: float) -> np.ndarray:
    """Newton values over the bins of a tree with up to three leaves: the best cut, then the best cut of either side."""

    def cut(a: int, b: int) -> tuple[float, int]:
        gs, hs = np.cumsum(g[a:b]), np.cumsum(h[a:b])
        left, right = hs[:-1], hs[-1] - hs[:-1]
        gain = gs[:-1] ** 2 / (left + ridge) + (gs[-1] - gs[:-1]) ** 2 / (right + ridge) - gs[-1] ** 2 / (hs[-1] + ridge)
        gain[(left < least) | (right < least)] = -1
        return (float(gain.max()), a + 1 + int(gain.argmax())) if len(gain) else (-1.0, a)

    ends = [0, len(g)]
    for _ in range(2):
        found = max((cut(a, b) for a, b in zip(ends, ends[1:])), default=(-1.0, 0))
        if found[0] <= 0:
            break
        ends = sorted({*ends, found[1]})
    out = np.zeros(len(g))
    for a, b in zip(ends, ends[1:]):
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + ridge)
    return out


def cross_cut(g: np.ndarray, h: np.ndarray, ridge: float, least: float) -> tuple[float, np.ndarray]:
    """Gain and values of the best split of a grid into four by a cut on each axis."""
    gs, hs = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    best = (-1.0, np.zeros_like(g))
    for i in range(g.shape[0] - 1):
        for j in range(g.shape[1] - 1):
            parts = [(gs[i, j], hs[i, j]), (gs[i, -1] - gs[i, j], hs[i, -1] - hs[i, j]), (gs[-1, j] - gs[i, j], hs[-1, j] - hs[i, j])]
            parts.append((gs[-1, -1] - sum(p[0] for p in parts), hs[-1, -1] - sum(p[1] for p in parts)))
            gain = sum(a * a / (b + ridge) for a, b in parts) - gs[-1, -1] ** 2 / (hs[-1, -1] + ridge)
            if gain > best[0] and min(b for _, b in parts) >= least:
                out = np.empty_like(g)
                for (a, b), rows, cols in zip(parts, (slice(i + 1), slice(i + 1), slice(i + 1, None), slice(i + 1, None)), (slice(j + 1), slice(j + 1, None), slice(j + 1), slice(j + 1, None))):
                    out[rows, cols] = a / (b + ridge)
                best = (float(gain), out)
    return best


def train(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, bins: int = 32, coarse: int = 8, rounds: int = 120, pair_rounds: int = 40, pairs: int = 6, rate: float = 0.1, ridge: float = 2.0, least: float = 1.0) -> Gam:
    """weight: how much each row counts, 1 by default."""
    if len(y) == 0 or y.min() == y.max():
        share = np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99)
        return Gam(float(np.log(share / (1 - share))))
    w = np.ones(len(y)) if weight is None else weight / weight.mean()
    share = (w * y).mean()
    gam = Gam(float(np.log(share / (1 - share))))
    for i in range(x.shape[1]):
        e = np.unique(np.quantile(x[:, i], np.linspace(0, 1, bins + 1)[1:-1]))
        gam.edges.append(e)
        gam.single.append(np.zeros(len(e) + 1))
        gam.coarse.append(np.arange(len(e) + 1) * coarse // (len(e) + 1))
    b = [np.searchsorted(e, x[:, i], side="right") for i, e in enumerate(gam.edges)]
    total = np.full(len(y), gam.start)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return w * (y - p), w * p * (1 - p)

    for _ in range(rounds):
        for i, t in enumerate(gam.single):
            g, h = slopes()
            step = rate * two_cuts(np.bincount(b[i], g, len(t)), np.bincount(b[i], h, len(t)), ridge, least)
            t += step
            total += step[b[i]]
    grids = {(i, j): gam.coarse[i][b[i]] * coarse + gam.coarse[j][b[j]] for i in range(len(b)) for j in range(i)}

    def grid(c: np.ndarray, v: np.ndarray) -> np.ndarray:
        return np.bincount(c, v, coarse * coarse).reshape(coarse, coarse)

    g, h = slopes()
    gains = sorted(((cross_cut(grid(c, g), grid(c, h), ridge, least)[0], k) for k, c in grids.items()), reverse=True)[:pairs]
    chosen = [(k, np.zeros((coarse, coarse))) for gain, k in gains if gain > 0]
    for _ in range(pair_rounds):
        for k, t in chosen:
            g, h = slopes()
            step = rate * cross_cut(grid(grids[k], g), grid(grids[k], h), ridge, least)[1]
            t += step
            total += step.ravel()[grids[k]]
    gam.pairs = [(i, j, t) for (i, j), t in chosen]
    return gam


def fitted(docs: DataFrame, labels: DataFrame, how: Sample = Sample(6000), key: str = "doc_id", text: str = "text") -> Gam:
    """The model of docs' labelled sample: executors make the features, the driver gets one row of them for each of at most how.rows documents."""
    names = [f"_f_{f}" for f in FEATURES]
    rows = labelled_rows(docs, labels, "quality", how, key, text).repartition(docs.sparkSession.sparkContext.defaultParallelism)
    one = text_features(rows, "_text").groupBy("_row._id").agg(F.min(F.struct(*names, "_row._y", "_row._weight")).alias("_f"))
    learnt = one.orderBy("_id").select("_f.*").toPandas()
    return train(learnt[names].to_numpy(float).reshape(-1, len(names)), learnt["_y"].to_numpy(float), learnt["_weight"].to_numpy(float))


def scored(docs: DataFrame, labels: DataFrame, how: Sample = Sample(6000), key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with score (in place of a column of that name), learnt from labels.quality of at most how.rows documents that aren't held out."""
    gam = fitted(docs, labels, how, key, text)
    names = [f"_f_{f}" for f in FEATURES]

    @F.pandas_udf("double")
    def score(*features: pd.Series) -> pd.Series:
        return pd.Series(gam.score(np.column_stack([f.to_numpy(float) for f in features])))

    return text_features(docs, text).withColumn("_score", score(*names)).select(*unboxed(docs.columns, score=F.col("_score")))
