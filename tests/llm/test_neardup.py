"""Near-dedup against all pairs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skymatch.llm import neardup
from skymatch.llm.neardup import NearDup

from .helpers import brute_groups


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("fp", "kept", "_version", "_id", "_v", "_rank", "_row", "id", "component")})


def families(seed, n=8, members=40):
    """Texts of several origins, with edits that put many pairs close to the threshold, and chains."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7)))
    rows, i = [], 0
    common = [word() for _ in range(60)]
    for f in range(n):
        origin = [word() for _ in range(r.randint(60, 160))]
        if f % 2:
            origin = common + origin
        last = origin
        for _ in range(members):
            t = list(last if f % 3 == 0 else origin)
            for _ in range(r.randint(0, 4)):
                t[r.randrange(len(t))] = word()
            last = t
            rows.append((i, " ".join(t)))
            i += 1
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("how", [NearDup(shingle=3, percent=85), NearDup(), NearDup(shingle=1, percent=90)])
@pytest.mark.parametrize("seed", [0, 1])
def test_families(spark, how, seed):
    rows = families(seed)
    out = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in neardup.groups(frame(spark, rows), how).collect()}
    assert out == brute_groups(rows, how.shingle, how.percent)


def test_corpus(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    for how in (NearDup(shingle=3, percent=85), NearDup()):
        out = neardup.groups(docs, how).collect()
        want = brute_groups(rows, how.shingle, how.percent)
        assert {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in out} == want
        assert all(x["kept"] == (x["doc_id"] == x["component_id"]) for x in out)
        kept = neardup.one_of_each(docs, how)
        assert kept.columns == docs.columns
        assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for _, c in want.values()})


def test_edges(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(5, None), (6, ""), (7, " \t"), (8, "One two"), (9, "one TWO"), (10, "one two three"), (11, long), (12, long + " x"), (12, long + " x"), (None, long), (None, "alone in the world"), (13, "É x y"), (14, "é x y")]
    out = neardup.groups(frame(spark, rows), NearDup(shingle=3, percent=85)).collect()
    got = {(x["doc_id"], x["n_shingles"]): (x["component_id"], x["kept"]) for x in out}
    assert len(out) == len(rows)
    assert got[(5, 0)] == (5, True) and got[(6, 0)] == (6, True)
    assert got[(8, 1)] == (8, True) and got[(9, 1)] == (8, False) and got[(10, 1)] == (10, True)
    assert got[(11, 29_998)] == (11, True) and got[(12, 29_999)] == (11, False) and got[(None, 29_998)] == (11, False)
    assert got[(None, 2)] == (None, True) and got[(14, 1)] == (14, True)
    kept = neardup.one_of_each(frame(spark, rows), NearDup(shingle=3, percent=85)).collect()
    assert sorted(str(x["doc_id"]) for x in kept) == sorted(map(str, [5, 6, 7, 8, 10, 11, None, 13, 14]))
    twice = neardup.one_of_each(frame(spark, [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f")]))
    assert [x["doc_id"] for x in twice.collect()] == [1]
    assert neardup.groups(frame(spark, rows).limit(0)).count() == 0


def test_looks_keep_what_reaches_the_threshold():
    """Binomial chance that a pair at the threshold is pruned is far below the miss probability's order for each look."""
    how = NearDup(shingle=3, percent=85)
    r = np.random.default_rng(0)
    for t in (how.percent / 100, how.around):
        hits = r.random((20_000, how.hashes)) < t
        for n, m in how.looks(t):
            assert (hits[:, :n].sum(1) >= m).all()
        assert how.looks(t)[-1][0] == how.hashes


def test_blocks_agree(spark):
    """The comparison beside a leader finds the same links in blocks of any size."""
    rows = families(3, n=2, members=60)
    how = NearDup(shingle=3, percent=85)
    whole = brute_groups(rows, 3, 85)
    real = neardup.beside_leader
    try:
        neardup.beside_leader = lambda near, how: real(near, how, block=7, elements=500)
        out = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in neardup.groups(frame(spark, rows), how).collect()}
    finally:
        neardup.beside_leader = real
    assert out == whole


def test_null_ids_meet_by_their_texts(spark):
    """Rows without an id are no key of their own: classes find their texts without a square join."""
    r = random.Random(4)
    rows = [(None, " ".join(r.choice("abcdefghij") + str(r.randrange(50)) for _ in range(30))) for _ in range(2000)]
    rows += [(None, t + " more") for _, t in rows[:300]] + rows[:100]
    wanted = spark.createDataFrame(rows, "doc_id long, text string")
    prints = neardup.fingerprints(wanted, NearDup(), "doc_id", "text").where("fp IS NOT NULL").select("id", "version", "fp").distinct()
    texts = wanted.select(F.lit(neardup.LAST).alias("id"), F.xxhash64("text").alias("version"), "text")
    assert texts.join(prints, ["id", "version"]).count() == len(rows)
    out = neardup.groups(wanted, NearDup()).collect()
    assert len(out) == len(rows) and len({x["component"] for x in out}) == 2000
    kept = neardup.one_of_each(wanted, NearDup())
    assert kept.count() == 2000


def test_rows_that_differ_in_other_columns_only(spark):
    """The same one stays, whatever the layout."""
    rows = [(1, "a b c d e f", x) for x in "qwertz"] + [(2, "g h i j k l", "z"), (None, "m n o p q r", "y"), (None, "m n o p q r", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, other string")
    one, other = (sorted(map(str, neardup.one_of_each(df.repartition(n, "other")).collect())) for n in (1, 5))
    assert one == other and len(one) == 3


def test_two_bands_of_large_buckets(spark):
    """Large families far from a chance leader are joined all the same."""
    rows = families(6, n=3, members=50)
    for how in (NearDup(shingle=3, percent=85), NearDup()):
        out = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in neardup.groups(frame(spark, rows), how).collect()}
        assert out == brute_groups(rows, how.shingle, how.percent)


@pytest.mark.parametrize("how", [NearDup(shingle=3, percent=85), NearDup()])
def test_miss_probability(how):
    """By arithmetic and by simulated pairs at the threshold: fewer than two bands agree about as rarely as stated; one band less would not do."""
    p = (how.percent / 100) ** how.rows
    miss = lambda n: (1 - p) ** n + n * p * (1 - p) ** (n - 1)
    assert miss(how.bands) <= how.miss < miss(how.bands - 1)
    r, few = np.random.default_rng(2), np.zeros(6)
    for _ in range(40):
        agree = (r.random((5_000, how.bands, how.rows)) < how.percent / 100).all(axis=2).sum(axis=1)
        few += np.bincount(np.minimum(agree, 5), minlength=6)
    want = [200_000 * math.comb(how.bands, k) * p**k * (1 - p) ** (how.bands - k) for k in range(5)]
    assert few[:2].sum() <= 2 and abs(few[:5].sum() - sum(want)) < 5 * sum(want) ** 0.5
