"""Toxicity: a linear-chain conditional random field over two states marks toxic words; its marginals give scores and offsets.

Only documents carry labels, so training tokens are labelled through them: in a toxic document, words with a feature that is much more frequent in
toxic than in other documents, and needed to tell them, are toxic, all others and all words of other documents are not. Emissions come from features of a word (the
word, its ends, its shape); transitions are learned with them by maximising the conditional likelihood. A document's score is a
logistic function of the sum of its words' squared marginals, so that hardly toxic words don't add up over a long text, and of the surest one, fitted on the same documents.

A bounded sample of labelled documents is learnt from, in one task; their texts are taken whole. Near copies
share the weight of one document. Rows of a class that the sample holds fewer of weigh more, so the sample's size doesn't move the scores.

A text is scored whole. With two states the forward and backward messages are ratios, so a step of the recursion is a few array operations over all
texts of a batch. Nulls and empties: no words, so the score is that of a text without a toxic word. Repeated rows score alike; of rows that share an
id with a label, the one with the least hash of the text is learnt from. An empty table gives an empty result. Other columns pass through, but one of
the result's name (`toxicity`, or as given) is replaced. Without labels of both classes every score is 0.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Sample, labelled_rows, stored

WORD = re.compile(r"\S+")


def stripped(word: str) -> str:
    return word.lower().strip(".,;:!?\"'()[]{}*#-_&%$|<>")


def features(word: str) -> tuple[str, ...]:
    """The word without case and outer punctuation, how it begins and ends, and, last, its shape."""
    bare = stripped(word)
    return f"w={bare}", f"p3={bare[:3]}", f"p4={bare[:4]}", f"p5={bare[:5]}", f"s4={bare[-4:]}", f"f={min(len(bare), 12)}{word[:1].isupper():d}{word.isupper():d}{any(c.isdigit() for c in word):d}"


@dataclass
class Chain:
    """weights: of the features, for the toxic state against the other; bias; moves[i][j]: log weight from state i to j; calibration: of the score."""

    weights: dict[str, float]
    bias: float
    moves: np.ndarray
    calibration: np.ndarray

    def emission(self, word: str) -> float:
        return sum(self.weights.get(f, 0.0) for f in features(word)) + self.bias


def marginals(emissions: np.ndarray, lengths: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """P(toxic) of each word of texts that stand one after the other, with the forward and backward ratios.

    Texts are put in order of length, so that the ones still going at a step are the first.
    """
    n = len(lengths)
    order = np.argsort(-lengths, kind="stable")
    starts = (np.cumsum(lengths) - lengths)[order]
    sizes = lengths[order]
    m = np.exp(moves)
    e = np.exp(np.clip(emissions, -40, 40))
    ahead, back = np.empty(len(e)), np.ones(len(e))
    longest = int(sizes[0]) if n else 0
    alive = np.searchsorted(-sizes, -np.arange(longest), side="left")
    r = None
    for t in range(longest):
        at = starts[: alive[t]] + t
        r = e[at] if t == 0 else e[at] * (m[0, 1] + r[: alive[t]] * m[1, 1]) / (m[0, 0] + r[: alive[t]] * m[1, 0])
        ahead[at] = r
    # backward, each text aligned at its end
    ends = starts + sizes - 1
    b = np.ones(n)
    for t in range(1, longest):
        k = alive[t]
        at = ends[:k] - t
        x = e[at + 1] * b[:k]
        b = (m[1, 0] + m[1, 1] * x) / (m[0, 0] + m[0, 1] * x)
        back[at] = b
    odds = ahead * back
    return odds / (1 + odds), ahead, back


def copy_weights(texts: list[list[str]], labels: list[int], hashes: int = 16, agree: int = 11) -> np.ndarray:
    """1 / the number of near copies of one label, for each text: copies are no evidence of their own.

    A text is a copy of the first one of its label with which it shares `agree` of its `hashes` minima of word triples, about 70% of the triples.
    """
    buckets: dict[tuple, list[int]] = {}
    first = np.arange(len(texts))
    for t, (ws, y) in enumerate(zip(texts, labels)):
        triples = np.array([zlib.crc32(" ".join(ws[i : i + 3]).encode("utf-8", "surrogatepass")) for i in range(max(1, len(ws) - 2))], dtype=np.uint64)
        keys = [(y, i, int(((triples * np.uint64(2 * i + 3) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).min())) for i in range(hashes)]
        met = [m for k in keys for m in buckets.get(k, ())]
        if met:
            others, times = np.unique(met, return_counts=True)
            if times.max() >= agree:
                first[t] = others[int(np.argmax(times >= agree))]
                continue
        for k in keys:
            buckets.setdefault(k, []).append(t)
    return 1 / np.bincount(first, minlength=len(texts))[first]


def toxic_features(texts: list[np.ndarray], labels: np.ndarray, weights: np.ndarray, n_features: int, least_share: float = 0.01, ratio: float = 20.0, evidence: float = 20.0, cover: int = 6) -> np.ndarray:
    """Which features tell toxic texts, found by sequential covering. texts: the distinct features of each. weights: how much evidence each text is.

    The one of most evidence (log-likelihood ratio) is taken, time after time; a toxic text that holds `cover` taken ones is explained and counts no
    more, so that words which merely accompany them aren't taken. A feature's share of toxic texts must be `ratio` times that of others and
    at least least_share, as labels are noisy and rare features prove nothing.
    """
    def counts(y: int) -> np.ndarray:
        mine = [(f, w) for f, w, label in zip(texts, weights, labels) if label == y]
        return np.bincount(np.concatenate([f for f, _ in mine]), np.repeat([w for _, w in mine], [len(f) for f, _ in mine]), n_features) if mine else np.zeros(n_features)

    toxic = [f for f, y in zip(texts, labels) if y]
    worth = weights[labels > 0]
    c, k = counts(0), counts(1)
    n0, n1 = max(1.0, weights[labels == 0].sum()), max(1.0, worth.sum())
    least = max(3.0, least_share * n1)
    names = np.flatnonzero((k >= least) & ((k + 0.5) / n1 >= ratio * (c + 0.5) / n0))
    place = np.full(n_features, -1)
    place[names] = np.arange(len(names))
    held = [p[p >= 0] for p in (place[f] for f in toxic)]
    holders: list[list[int]] = [[] for _ in names]
    for t, fs in enumerate(held):
        for f in fs.tolist():
            holders[f].append(t)
    k, c = k[names], c[names]
    covered, taken = np.zeros(len(toxic), int), np.zeros(len(names), bool)
    while not taken.all():
        both = (k + c) / (n0 + n1)
        with np.errstate(divide="ignore", invalid="ignore"):
            ll = 2 * (k * np.log(k / (n1 * both)) + np.where(c > 0, c * np.log(c / (n0 * both)), 0))
        ll[taken | (k < least) | ((k + 0.5) / n1 < ratio * (c + 0.5) / n0) | ~np.isfinite(ll)] = -1
        if ll.max() < evidence:
            break
        best = int(ll.argmax())
        taken[best] = True
        for t in holders[best]:
            covered[t] += 1
            if covered[t] == cover:
                k[held[t]] = np.maximum(k[held[t]] - worth[t], 0)
    out = np.zeros(n_features, bool)
    out[names[taken]] = True
    return out


def train(sample: list[tuple[list[str], int, float]], epochs: int = 30, rate: float = 0.5, decay: float = 1e-6) -> Chain | None:
    """Adagrad on the conditional log-likelihood of the token labels. sample: words, label, weight. None without both classes."""
    sample = [s for s in sample if s[0]]
    if len({s[1] for s in sample}) < 2:
        return None
    evidence = copy_weights([s[0] for s in sample], [s[1] for s in sample])
    weight = evidence * np.array([s[2] for s in sample])
    weight /= weight.mean()
    vocabulary: dict[str, int] = {}
    words = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in s[0]], dtype=np.int32) for s in sample]
    toxic_text = np.array([s[1] for s in sample], dtype=float)
    lengths = np.array([len(w) for w in words])
    names: dict[str, int] = {}
    table = np.empty((len(vocabulary), len(features(""))), dtype=np.int32)
    for n, w in enumerate(vocabulary):
        table[n] = [names.setdefault(f, len(names)) for f in features(w)]
    vocabulary.clear()
    distinct = [np.unique(w) for w in words]
    by_text = [np.unique(table[w, :-1]) for w in distinct]
    marked = toxic_features(by_text, toxic_text, evidence, len(names))[table[:, :-1]].any(axis=1)
    ids = np.concatenate(words)
    y = (marked[ids] & np.repeat(toxic_text > 0, lengths)).astype(float)
    # a feature counts if it stands in two texts; others share a place whose weight stays 0
    texts_with = np.bincount(np.concatenate([np.unique(table[w]) for w in distinct]), minlength=len(names))
    known = np.zeros(len(names), np.int32)
    known[texts_with > 1] = np.arange(1, 1 + int((texts_with > 1).sum()))
    table = known[table]
    size = int(known.max()) + 1
    inner = np.ones(len(y), bool)
    inner[np.cumsum(lengths) - lengths] = False  # words with one before them
    at = np.flatnonzero(inner)
    worth = np.repeat(weight, lengths)
    weights, bias, moves = np.zeros(size), -2.0, np.zeros((2, 2))
    seen_w, seen_b, seen_m = np.full(size, 1e-8), 1e-8, np.full((2, 2), 1e-8)
    observed = np.zeros((2, 2))
    observed += np.bincount(2 * y[at - 1].astype(int) + y[at].astype(int), worth[at], 4).reshape(2, 2)
    for _ in range(epochs):
        e = (weights[table].sum(axis=1) + bias)[ids]
        p, ahead, back = marginals(e, lengths, moves)
        error = worth * (y - p)
        by_word = np.bincount(ids, weights=error, minlength=len(table))
        grad = np.bincount(table.ravel(), weights=np.repeat(by_word, table.shape[1]), minlength=size) - decay * weights
        # expected moves: forward state, move, emission, backward state, normalised for each pair of neighbours
        x = np.exp(np.clip(e[at], -40, 40)) * back[at]
        m = np.exp(moves)
        r = ahead[at - 1]
        z = worth[at] / (m[0, 0] + m[0, 1] * x + r * (m[1, 0] + m[1, 1] * x))
        expected = m * np.array([[z.sum(), (x * z).sum()], [(r * z).sum(), (r * x * z).sum()]])
        grad_m, grad_b = observed - expected, error.sum()
        seen_w += grad**2
        seen_b += grad_b**2
        seen_m += grad_m**2
        grad[0] = 0
        weights += rate * grad / np.sqrt(seen_w)
        bias += rate * grad_b / np.sqrt(seen_b)
        moves += rate * grad_m / np.sqrt(seen_m)
        moves -= moves[0, 0]  # ratios alone count
    p = marginals((weights[table].sum(axis=1) + bias)[ids], lengths, moves)[0]
    return Chain({f: float(weights[known[i]]) for f, i in names.items() if known[i] and weights[known[i]]}, float(bias), moves, calibrate(summary(p, lengths), toxic_text, weight))


def summary(p: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """For each text 1, the logarithm of 1 + the sum of squared marginals, and the surest word's marginal."""
    out = np.zeros((len(lengths), 3))
    out[:, 0] = 1
    full = np.flatnonzero(lengths)
    if len(full):
        starts = (np.cumsum(lengths) - lengths)[full]
        out[full, 1] = np.log1p(np.add.reduceat(p * p, starts))
        out[full, 2] = np.maximum.reduceat(p, starts)
    return out


def calibrate(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.05, rounds: int = 30) -> np.ndarray:
    """Logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += np.linalg.solve((x.T * (weight * q * (1 - q))) @ x + ridge * np.eye(len(w)), x.T @ (weight * (y - q)) - ridge * w)
    return w


class Emissions(dict):
    """Emissions of words, kept for words seen lately."""

    def __init__(self, chain: Chain):
        self.chain = chain

    def __missing__(self, word: str) -> float:
        if len(self) > 200_000:
            self.clear()
        self[word] = out = self.chain.emission(word)
        return out


def score_texts(texts: list[str | None], chain: Chain, known: Emissions, least: float = 0.5, words: int = 1_000_000) -> tuple[np.ndarray, list[list[tuple[int, int, float]]]]:
    """Scores, and spans (start, end, marginal) of the words that are toxic with probability least or more. words: about how many are held at a time."""
    scores = np.empty(len(texts))
    spans: list[list[tuple[int, int, float]]] = [[] for _ in texts]
    # texts of like length together, so that few words take part in the many steps of the longest
    chunk: list[int] = []
    parts: list[np.ndarray] = []
    order = sorted(range(len(texts)), key=lambda i: len(texts[i] or ""))
    for n, i in enumerate(order):
        chunk.append(i)
        parts.append(np.fromiter(map(known.__getitem__, (texts[i] or "").split()), float))
        if n + 1 < len(order) and len(chunk) * len(parts[-1]) < words:
            continue
        lengths = np.array([len(e) for e in parts], dtype=int)
        p = marginals(np.concatenate(parts), lengths, chain.moves)[0]
        scores[chunk] = 1 / (1 + np.exp(-np.clip(summary(p, lengths) @ chain.calibration, -30, 30)))
        starts = np.cumsum(lengths) - lengths
        hits = np.flatnonzero(p >= least)
        # a text without words starts where the next one does
        owner = np.searchsorted(starts + lengths, hits, side="right")
        for t in np.unique(owner):
            mine = {int(h - starts[t]): float(p[h]) for h in hits[owner == t]}
            spans[chunk[t]] = [(m.start(), m.end(), mine[k]) for k, m in enumerate(WORD.finditer(texts[chunk[t]])) if k in mine]
        chunk, parts = [], []
    return scores, spans


def fitted(docs: DataFrame, labels: DataFrame, how: Sample = Sample(4000), key: str = "doc_id", text: str = "text") -> Chain | None:
    """The model of docs' labelled sample, fitted by one task, which holds how.rows texts at most."""
    rows = labelled_rows(docs, labels, "toxic", how, key, text)
    one = rows.groupBy("_id", "_y", "_weight").agg(F.min(F.struct(F.xxhash64("_text"), "_text"))["_text"].alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample = sorted((r["_id"], r["_y"], r["_weight"], r["_text"] or "") for batch in batches for r in batch.to_pylist())
        chain = train([(text.split(), y, weight) for _, y, weight, text in sample])
        if chain:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(vars(chain))], pa.binary())], ["model"])

    found = stored(one.repartition(1).mapInArrow(run, "model binary")).head()
    return Chain(**pickle.loads(bytes(found[0]))) if found else None


def scored(docs: DataFrame, labels: DataFrame, how: Sample = Sample(4000), key: str = "doc_id", text: str = "text", result: str = "toxicity") -> DataFrame:
    """docs with a column of the name `result`, a struct of score (0 to 1) and spans (start, end, p)."""
    chain = fitted(docs, labels, how, key, text)
    known = Emissions(chain) if chain else None

    @F.pandas_udf("score double, spans array<struct<start:int,end:int,p:double>>")
    def apply(texts: pd.Series) -> pd.DataFrame:
        if chain is None:
            return pd.DataFrame({"score": np.zeros(len(texts)), "spans": [[]] * len(texts)})
        scores, spans = score_texts(texts.tolist(), chain, known)
        return pd.DataFrame({"score": scores, "spans": [[{"start": a, "end": b, "p": p} for a, b, p in s] for s in spans]})

    return docs.withColumn(result, apply(F.col(text)))
