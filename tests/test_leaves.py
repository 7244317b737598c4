"""Blocks searched by their leaves: the rows of brute force for a small part of its pairs."""

import time

import numpy as np
import pytest

from skymatch.operators import knn, leaves
from skymatch.operators.kdindex import KdIndex
from skymatch.operators.knn import Search
from skymatch.operators.scaling import Prior, best_scales, beyond_reach, within_reach
from skymatch.sources import scratch


def objects(r, n, bands, digits=1):
    f = r.normal(0, 1, (n, bands)).round(digits)
    return np.stack([f, 0.01 + 0.05 * np.abs(f)], axis=2)


@pytest.mark.parametrize("metric", ["chi2", "euclidean"])
@pytest.mark.parametrize("odd", ["plain", "crowd", "no errors", "infinite errors"])
def test_leaves_are_exact(metric, odd):
    r = np.random.default_rng(3)
    o, t, ids = objects(r, 3000, 4), objects(r, 300, 4), r.permutation(3000)
    if odd == "crowd":
        o[:2000] = o[0]
        t[:50] = o[0]
    if odd == "no errors":
        o[::2, :, 1] = t[::2, :, 1] = 0
    if odd == "infinite errors":
        o[::7, 1] = t[::3, 2] = (0.0, np.inf)
    for k in (1, 5, 200, 4000):
        at, d = leaves.Leaves(o, ids, metric).nearest(t, k)
        every = knn.distances(t, o, metric)
        want = knn.best(every, ids, k)
        assert (at == want).all() and (d == np.take_along_axis(every, want, axis=1)).all()


def test_few_pairs_are_compared(monkeypatch):
    r = np.random.default_rng(4)
    o, t = objects(r, 40_000, 3, 4), objects(r, 4_000, 3, 4)
    pairs, plain = [], leaves.distances
    monkeypatch.setattr(leaves, "distances", lambda t, o, *how: pairs.append(len(t) * len(o)) or plain(t, o, *how))
    monkeypatch.setattr(knn, "distances", leaves.distances)
    s = Search(5)
    b = knn._search_batch([np.arange(len(t)), t], (np.arange(len(o)), o), s, knn.leaves_of(np.arange(len(o)), o, s))
    assert b.num_rows == 5 * len(t) and sum(pairs) < len(t) * len(o) / 20


def frame(spark, key, ids, x):
    bands = range(x.shape[1])
    return spark.createDataFrame([(int(i), *map(float, v.ravel())) for i, v in zip(ids, x)], f"{key} long, " + ", ".join(f"f_b{b} double, e_b{b} double" for b in bands))


@pytest.mark.parametrize("search", [Search(7), Search(7, "euclidean"), Search(3, method="combined", batch=30)])
def test_cells_of_a_large_reference(spark, search):
    """A crowd fills many blocks, and a target meets few of the others."""
    r = np.random.default_rng(5)
    o, t, bands = objects(r, 3000, 3, 2), objects(r, 200, 3, 2), ["b0", "b1", "b2"]
    o[:900], t[:20] = o[0], o[0]
    t[20, 0] = (0.0, np.inf)
    refs, targets = frame(spark, "ref_id", r.permutation(3000), o), frame(spark, "target_id", range(200), t)
    row = lambda x: [tuple(v) for v in x.orderBy("target_id", "rank").collect()]
    out = knn.by_blocks(targets, refs, bands, search, block_bytes=100 * 48)
    assert "_cell" in out._jdf.queryExecution().toString() or search.method == "combined"
    got, want = row(out), row(knn.by_join(targets, refs, bands, search))
    assert [g[:3] for g in got] == [w[:3] for w in want] and np.allclose([g[3] for g in got], [w[3] for w in want], rtol=1e-12)


def test_looks_return_little(spark, tmp_path):
    """What is beyond the k-th neighbour of the tree's sample isn't returned, so that a query stores and moves little more than k rows a target."""
    r = np.random.default_rng(6)
    o, t, bands, k = objects(r, 8000, 4, 3), objects(r, 100, 4, 3), ["b0", "b1", "b2", "b3"], 30
    KdIndex.fit(frame(spark, "ref_id", range(8000), o), bands, str(tmp_path), 64)
    index, targets = KdIndex.open(spark, str(tmp_path)), frame(spark, "target_id", range(100), t)
    index.nearest(targets, k)
    kept = [spark.read.parquet(p) for p in scratch.FOLDERS[-3:]]
    first = next(x for x in kept if "distance" in x.columns)
    more = index.looked_through(next(x for x in kept[::-1] if "tids" in x.columns), k)
    assert k * 100 <= first.count() + more.count() <= 2 * k * 100
    got = index.query(targets, Search(k, method="kdtree")).orderBy("target_id", "rank").collect()
    want = knn.best(knn.distances(t, o, "euclidean"), np.arange(8000), k)
    assert [x.ref_id for x in got] == want.ravel().tolist()


@pytest.mark.parametrize("prior", ["uniform", "tophat 0.5 2"])
def test_few_scales_are_solved(monkeypatch, prior):
    """Only objects that may come as near as the k best so far have their scales solved, and the rows are those of all scales."""
    r = np.random.default_rng(7)
    t, ids = objects(r, 40, 6, 3), r.permutation(20_000)
    o = np.concatenate([objects(r, 16_000, 6, 3), np.repeat(t, 100, axis=0)])[r.permutation(20_000)]  # crowds around the targets
    o[:, :, 0] += r.normal(0, 0.02, (20_000, 6))
    o[100], o[200] = o[300], (0.0, np.inf)
    s, pairs, plain = Search(10, prior=Prior.parse(prior)), [], knn.solved
    monkeypatch.setattr(knn, "solved", lambda f, *how: pairs.append(len(f[0])) or plain(f, *how))
    got = knn.best_of_block(t, o, ids, s)
    scale = best_scales(t, o, s.prior)
    d = knn.distances(t, o, "chi2", scale)
    at = knn.best(d, ids, 10)
    assert (got[0] == ids[at]).all() and (got[1] == np.take_along_axis(d, at, axis=1)).all() and (got[2] == np.take_along_axis(scale, at, axis=1)).all()
    assert 0 < sum(pairs) < 0.5 * len(t) * len(o)


def test_join_solves_few_scales_in_time(spark, monkeypatch):
    """The join gives the rows of the blocks, also for odd objects, and 600,000 pairs of it take seconds in several tasks: as a fold they took minutes in one."""
    r = np.random.default_rng(11)
    t, o = objects(r, 300, 6, 3), objects(r, 2000, 6, 3)
    t[3, 1, 1], o[5, :, 0], o[6, 2, 1] = np.inf, 0, np.inf
    bands = [f"b{i}" for i in range(6)]
    frame = lambda x, key: spark.createDataFrame([(i, *row.ravel().tolist()) for i, row in enumerate(x)], f"{key} long, " + ", ".join(f"{c}_{b} double" for b in bands for c in "fe")).coalesce(1)
    monkeypatch.setattr(knn, "LOOK", 500)
    begin = time.time()
    for prior in ("uniform", "tophat 0.5 2"):
        one, other = (sorted(map(tuple, knn.neighbors(frame(t, "target_id"), frame(o, "ref_id"), bands, Search(5, prior=Prior.parse(prior)), plan).collect())) for plan in ("join", "blocks"))
        assert len(one) == 1500 and [x[:3] for x in one] == [x[:3] for x in other]
        assert np.allclose([x[3:] for x in one], [x[3:] for x in other], rtol=1e-9)
    assert time.time() - begin < 60


def test_reach_of_pairs():
    """Limits of each pair leave out what they leave out target by target; none leaves nothing out."""
    r = np.random.default_rng(12)
    t, o = objects(r, 20, 4, 3), objects(r, 300, 4, 3)
    f, e, limit = [o[:, b, 0] for b in range(4)], [o[:, b, 1] for b in range(4)], r.uniform(0.5, 20, 20)
    limit[4] = np.nan
    want = [i * 300 + at for i in range(20) for at in within_reach(f, e, t[i, :, 0], t[i, :, 1], limit[i], Prior())]
    pairs = [[np.tile(x, 20) for x in side] for side in (f, e)] + [[np.repeat(t[:, b, j], 300) for b in range(4)] for j in range(2)]
    assert within_reach(*pairs, np.repeat(limit, 300), Prior()).tolist() == want and 300 < len(want) < 3000


def odd_objects(r, n, bands):
    """Objects of all sizes, with bands without errors, with infinite errors and without flux."""
    o = objects(r, n, bands, 3)
    o[:, :, 0] += r.normal(0, 0.02, (n, bands))
    o *= 10.0 ** r.integers(-3, 4, n)[:, None, None]
    o[::7, 1] = (0.0, np.inf)
    o[1::11, 0, 1], o[2::13, :, 1], o[3::29, :, 0], o[4::31, 2, 0] = np.inf, 0, 0, 0
    return o


def test_join_leaves_out_far_pairs_only(spark):
    """Neither bound leaves out a pair that its best scale brings within the limit, and both leave out most others."""
    r = np.random.default_rng(13)
    t, o, bands = odd_objects(r, 60, 6), odd_objects(r, 900, 6), [f"b{i}" for i in range(6)]
    o[:60] = 3 * t
    d = knn.distances(t, o, "chi2", best_scales(t, o, Prior()))
    limit = np.nanquantile(d, 0.02, axis=1)
    limit[5] = np.inf
    pairs = [[np.tile(o[:, b, j], 60) for b in range(6)] for j in range(2)] + [[np.repeat(t[:, b, j], 900) for b in range(6)] for j in range(2)]
    far = beyond_reach(*pairs, np.repeat(limit, 900)).reshape(60, 900)
    assert not (far & (d <= limit[:, None])).any() and far.mean() > 0.7
    near = frame(spark, "target_id", range(60), t).join(spark.createDataFrame([(i, float(x)) for i, x in enumerate(limit)], "target_id long, _limit double"), "target_id")
    refs = knn._side(frame(spark, "ref_id", range(900), o), "ref_id", bands, "n_")
    kept = np.zeros((60, 900), bool)
    for x in knn._near_pairs(knn._packed(near, bands), knn._packed(refs, bands, "n_"), bands, 4).collect():
        kept[x.target_id, x.ref_id] = True
    assert not (~kept & (d <= limit[:, None])).any() and kept[5].all() and kept.mean() < 0.5


@pytest.mark.parametrize("block_bytes", [knn.BLOCK_BYTES, 1 << 10])
def test_scaled_join_of_odd_objects(spark, monkeypatch, block_bytes):
    """The join gives the rows of the blocks for odd objects, a crowd of equal ones, and a reference that is too large to be sent."""
    r = np.random.default_rng(14)
    t, o, bands = odd_objects(r, 50, 7), odd_objects(r, 1500, 7), [f"b{i}" for i in range(7)]
    o[200:700], t[:5] = o[200], o[200]
    ids = r.permutation(1500)
    refs, targets = frame(spark, "ref_id", ids, o), frame(spark, "target_id", range(50), t)
    want = sorted(map(tuple, knn.neighbors(targets, refs, bands, Search(4, prior=Prior()), "blocks").collect()))
    for name, value in (("FIRST_LOOK", 100), ("LOOK", 400), ("BLOCK_BYTES", block_bytes)):
        monkeypatch.setattr(knn, name, value)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = knn.neighbors(targets, refs, bands, Search(4, prior=Prior()), "join")
        assert ("CartesianProduct" in out._jdf.queryExecution().toString()) == (block_bytes == 1 << 10)
        got = sorted(map(tuple, out.collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert [x[:3] for x in got] == [x[:3] for x in want] and np.allclose([x[3:] for x in got], [x[3:] for x in want], rtol=1e-12, equal_nan=True)
