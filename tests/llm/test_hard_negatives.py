"""Hard negatives against all scores, and bounds that never drop a pair."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skymatch.llm import hard_negatives as hn
from skymatch.llm.queries import op12_hard_negatives


def plain(rows, how=hn.Mining(), anchors=50):
    """Sorted results of (id, label, whole vector) rows by looking at all pairs."""
    rows = [(i, la, v) for i, la, v in rows if la is not None and v is not None]
    width = max((len(v) for _, _, v in rows), default=0)
    rows = [(i, la, list(v) + [0] * (width - len(v))) for i, la, v in rows]
    out = []
    for at, (a, label, v) in enumerate(rows):
        if a is None or a % anchors:
            continue
        scores = [(-sum(x * y for x, y in zip(v, w)), i is None, i or 0, i, la) for k, (i, la, w) in enumerate(rows) if k != at]
        scores.sort(key=lambda t: t[:3])
        for p in [t for t in scores if t[4] == label][: how.positives]:
            inside = [t for t in scores if t[4] != label and how.low * -p[0] <= 100 * -t[0] <= how.high * -p[0]]
            out += [(a, p[3], rank, t[3], -p[0], -t[0]) for rank, t in enumerate(inside[: how.negatives], 1)]
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in df.collect()), key=repr)


def mined(spark, rows, how=hn.Mining(), parts=3):
    df = spark.createDataFrame(rows, "vec_id long, label long, v array<long>").withColumns({"uid": F.lit("clash"), "anchor": F.lit(1), "slot": F.lit(2)}).repartition(parts)
    return got(hn.mine(df, F.col("vec_id") % 50 == 0, how))


def clustered(seed, n, width, scale=40):
    r = np.random.default_rng(seed)
    centres = r.normal(0, scale, (6, width))
    return [(i, int(r.integers(0, 5)), np.floor(centres[r.integers(0, 6)] + r.normal(0, scale / 3, width)).astype(int).tolist()) for i in range(n)]


@pytest.mark.parametrize("width", [1, 3, 24])
def test_all_pairs(spark, width):
    rows = clustered(width, 700, width)
    assert mined(spark, rows) == plain(rows)


def test_ties_repeats_nulls_and_lengths(spark):
    rows = clustered(9, 300, 4, 2) + [(None, 1, [3, 3, 3, 3])] * 3 + [(50, 1, [3, 3, 3, 3])] * 2 + [(i, i % 3, [5, 1]) for i in range(400, 520)]
    rows += [(600, None, [1, 1, 1, 1]), (650, 1, None), (700, 1, []), (750, 2, [0, 0, 0, 0])]
    want = plain(rows)
    assert mined(spark, rows) == want and mined(spark, rows, parts=1) == want


def test_large_numbers(spark):
    rows = [(i, i % 2, [(2**30 - i) * k // 60, (-(2**29) + 7 * i) * k // 60, 2**28 + i]) for i in range(0, 300, 5) for k in [17 + i % 43]]
    assert mined(spark, rows) == plain(rows) and mined(spark, rows)


def test_chunks_tiles_and_batches(spark, monkeypatch):
    rows = clustered(3, 900, 8)
    want = plain(rows)
    monkeypatch.setattr(hn, "CHUNK", 700)
    assert mined(spark, rows) == want


def test_other_limits(spark):
    rows, how = clustered(4, 400, 6), hn.Mining(positives=2, negatives=7, low=10, high=99)
    assert mined(spark, rows, how) == plain(rows, how)


def test_empty(spark):
    assert mined(spark, []) == [] and mined(spark, [(1, 1, [1, 2])]) == [] and mined(spark, [(50, 1, [1, 2])]) == []


def test_which_vectors_take_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [([0.5, -0.001],), ([nan, 1.0],), ([inf, 1.0],), ([-inf],), ([None, 1.0],), (None,), ([],), ([1e30, 0.0],), ([float(2**22), 0.0],)]
    out = [r[0] for r in spark.createDataFrame(rows, "e array<double>").select(hn.scaled(F.col("e"))).collect()]
    assert out == [[128, -1], None, None, None, None, None, [], None, [2**30, 0]]


@pytest.mark.parametrize("seed", range(4))
def test_bounds_keep_what_counts(seed):
    """No pair within the limits is dropped, and bounds drop most of what lies outside where energy is uneven."""
    import pyarrow as pa

    r = np.random.default_rng(seed)
    width = [5, 16, 64, 33][seed]
    energy = 1000.0 * 0.8 ** np.arange(width)
    v = np.floor(r.normal(0, 1, (400, width)) * energy).astype(np.int64)
    turn = np.linalg.qr(r.normal(0, 1, (width, width)))[0] if seed % 2 else np.eye(width)
    x = v @ turn
    square = np.concatenate([np.cumsum((x * x)[:, ::-1], 1)[:, ::-1], np.zeros((400, 1))], 1)
    slack = np.sqrt((width + 32) * 2.0**-23)
    bounds = np.concatenate([np.sqrt(square[:, hn.steps(width)]), slack * np.sqrt(square[:, :1])], 1) * (1 + 2.0**-20)
    pack = lambda a, t: pa.array([y.tobytes() for y in a.astype(t)])
    t = pa.table({"uid": range(400), "id": range(400), "label": [0] * 400, "v": pack(v, "<i4"), "r": pack(x, "<f4"), "bounds": pack(bounds, "<f4")})
    rows = hn.Rows(t, width)
    i, j = np.arange(400), np.arange(0, 400, 7)
    exact = v @ v[j].T
    floor, ceiling = np.sort(exact, 0)[-9], np.sort(exact, 0)[-4]
    a, b, score = hn.survivors(rows, i, rows, j, floor, ceiling)
    assert (score == exact[a, np.searchsorted(j, b)]).all()
    kept = set(zip(a.tolist(), b.tolist()))
    need = {(int(p), int(j[q])) for p, q in zip(*np.nonzero((exact >= floor) & (exact <= ceiling)))}
    assert need <= kept and len(kept) < exact.size / 8
    a, b, score = hn.survivors(rows, i, rows, j, np.full(len(j), -(2**62)), np.full(len(j), np.inf), best=5)
    top = {(int(p), int(j[q])) for p, q in zip(*np.nonzero(exact >= np.sort(exact, 0)[-5]))}
    assert top <= set(zip(a.tolist(), b.tolist()))


def test_shares_are_exact():
    s = np.array([0, 1, 7, 99, 100, 101, 2**62 - 1, -1, -7, -100, -(2**62)], np.int64)
    for p in (50, 95, 10, 99):
        assert hn.share(s, p, False).tolist() == [math.floor(int(x) * p / 100) if abs(int(x)) < 2**40 else int(x) * p // 100 for x in s]
        assert hn.share(s, p, True).tolist() == [-(-int(x) * p // 100) for x in s]


def test_corpus(spark, sf):
    rows = []
    for i, label, e in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "label", "embedding").collect():
        if label is not None and e is not None and all(x is not None and math.isfinite(x) for x in e):
            rows.append((i, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * x) for x in e]))
    assert got(op12_hard_negatives(spark, sf)) == plain(rows)
