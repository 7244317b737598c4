"""Distances, weights and selectors that users add."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skymatch.functions import photometry
from skymatch.functions.photometry import register_metric
from skymatch.operators import knn, weights
from skymatch.operators.kdindex import KdIndex
from skymatch.operators.knn import Search
from skymatch.plans import config
from skymatch.plans.config import Config

METRICS = {
    "manhattan": (lambda x, f, e, g, s: x.abs(f - g), None, lambda f, e, g, s: np.abs(f - g).sum()),
    "own_chi": (lambda x, f, e, g, s: x.divide((f - g) * (f - g), e * e + s * s, 0.0), lambda x, d: x.sqrt(d), lambda f, e, g, s: np.sqrt(((f - g) ** 2 / (e**2 + s**2)).sum())),
    "capped": (lambda x, f, e, g, s: x.where(x.abs(f - g) < 1.0, (f - g) * (f - g), 1.0), None, lambda f, e, g, s: np.where(np.abs(f - g) < 1, (f - g) ** 2, 1).sum()),
}


@pytest.fixture
def registered():
    for n, (term, finish, _) in METRICS.items():
        register_metric(n, term, finish)
    yield
    for n in METRICS:
        del photometry.METRICS[n], photometry.DISTANCES[n]


def tables(spark):
    r = np.random.default_rng(8)
    t = [(i, *map(float, r.normal(0, 1, 2)), *map(float, r.uniform(0.2, 1, 2))) for i in range(25)]
    n = [(i, *map(float, r.normal(0, 1, 2)), *map(float, r.uniform(0.2, 1, 2))) for i in range(90)]
    make = lambda rows, key: spark.createDataFrame(rows, f"{key} long, f_a double, f_b double, e_a double, e_b double")
    return t, n, make(t, "target_id"), make(n, "ref_id")


@pytest.mark.parametrize("name", METRICS)
def test_metrics_in_all_plans(spark, tmp_path, registered, name):
    """One formula serves the nested loop, blocks, the combined search and the kept index."""
    t, n, targets, refs = tables(spark)
    plain = METRICS[name][2]
    arrays = lambda row: (np.array(row[1:3]), np.array(row[3:5]))

    def want(k, batch=None):
        out = []
        for x in t:
            g, s = arrays(x)
            d = [(plain(*arrays(y), g, s), y[0], ((arrays(y)[0] - g) ** 2).sum()) for y in n]
            if batch:
                d = sorted(d, key=lambda v: (v[2], v[1]))[:batch]
            out += [(x[0], i, v[1], pytest.approx(v[0])) for i, v in enumerate(sorted(d)[:k], 1)]
        return out

    got = lambda df: [tuple(r)[:4] for r in df.orderBy("target_id", "rank").collect()]
    for plan in ("join", "blocks"):
        assert got(knn.neighbors(targets, refs, ["a", "b"], Search(6, name), plan)) == want(6)
    combined = Search(3, name, "combined", batch=20)
    for plan in ("join", "blocks"):
        assert got(knn.neighbors(targets, refs, ["a", "b"], combined, plan)) == want(3, 20)
    assert got(KdIndex.fit(refs, ["a", "b"], str(tmp_path / "i"), 10).query(targets, combined)) == want(3, 20)
    assert got(knn.by_blocks(targets, refs, ["a", "b"], Search(6, name), block_bytes=1000)) == want(6)


def test_what_isnt_registered(spark, registered):
    _, _, targets, refs = tables(spark)
    with pytest.raises(ValueError):
        Search(3, "unheard_of")
    with pytest.raises(ValueError):
        register_metric("chi2", None)
    with pytest.raises(ValueError):
        knn.neighbors(targets, refs, ["a", "b"], Search(3), "unheard_of")


def test_weights_selectors_and_methods_of_users(spark, registered, monkeypatch):
    _, _, targets, refs = tables(spark)
    monkeypatch.setitem(weights.METHODS, "rank", lambda bands: 1.0 / F.col("rank"))
    monkeypatch.setitem(knn.PLANS, "first", lambda t, r, bands, search: knn.by_join(t, r.where("ref_id < 40"), bands, search))
    monkeypatch.setitem(config.METHODS, "Manhattan", ("brute", "manhattan"))
    c = Config.parse({"reference_sample_phot_filters": ["a", "b"], "neighbor_method": "Manhattan", "neighbors_no": 4, "weight_method": "Rank"})
    found = knn.neighbors(targets, refs, ["a", "b"], c.search, "first")
    assert found.agg(F.max("ref_id")).first()[0] < 40 and found.count() == 100
    pairs = weights.weighted(knn.with_photometry(found, targets, refs, ["a", "b"]), ["a", "b"], c.weight_method)
    assert {(r["rank"], r["weight"]) for r in pairs.collect()} == {(i, 1.0 / i) for i in range(1, 5)}
