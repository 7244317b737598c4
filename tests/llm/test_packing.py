"""Packing: exact places, plans by counts, and ids as the tokenizer gives them."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from skymatch.llm import packing
from skymatch.llm.common import stored
from skymatch.llm.settings import TOKENIZER


def place_check(rows, capacity):
    """Sequences are gapless from 0, and none is longer than capacity."""
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


@pytest.mark.parametrize("seed", range(6))
def test_plans_use_up_all_counts(seed):
    r = np.random.default_rng(seed)
    capacity = [16, 64, 64, 256, 2048, 2048][seed]
    counts = np.zeros(capacity + 1, np.int64)
    sizes = r.integers(1, capacity + 1, 3000) if seed % 2 else np.minimum(capacity, r.geometric(4 / capacity, 3000))
    np.add.at(counts, sizes, 1)
    counts[capacity] += 10**12  # counts may be large
    plan = packing.plan_bins(counts, capacity)
    used = np.zeros_like(counts)
    for times, lengths in plan:
        assert times > 0 and sum(lengths) <= capacity
        for n in lengths:
            used[n] += times
    assert (used == counts).all()
    bins = sum(t for t, _ in plan)
    least = -(-int((counts * np.arange(capacity + 1)).sum()) // capacity)
    first_fit = 10**12 + ffd(sizes.tolist(), capacity)
    assert least <= bins <= max(first_fit, int(1.02 * least))
    assert len(plan) <= 3 * capacity


def ffd(sizes, capacity):
    gaps = []
    for n in sorted(sizes, reverse=True):
        for i, g in enumerate(gaps):
            if g >= n:
                gaps[i] -= n
                break
        else:
            gaps.append(capacity - n)
    return len(gaps)


def test_two_replace_one():
    """10 + 6 leaves 4 of 20 unused; 10 + 5 + 5 fills it."""
    counts = np.zeros(21, np.int64)
    counts[[10, 6]] = 1
    counts[5] = 2
    assert sorted(map(sorted, (p for _, p in packing.plan_bins(counts, 20)))) == [[5, 5, 10], [6]]


def test_cut():
    assert packing.cut(1, 4) == [(0, 1)] and packing.cut(4, 4) == [(0, 4)] and packing.cut(5, 4) == [(0, 1), (1, 4)] and packing.cut(8, 4) == [(0, 4), (4, 4)]


TEXTS = [None, "", "a", "hello world " * 30, "<|endoftext|> in <|endoftext|>", " \n\n\t  x", "ééé 你好 👍🏽 ​", "x" * 5000, "spam " * 4000, "1234567890" * 300, "\r\n" * 500, " " * 3000, "don't we'll I'M"]


def test_ids_and_places(spark):
    from tokenizers import Tokenizer

    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3]), (None, "no id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("length", F.lit(7)).withColumn("piece", F.lit("clash"))
    out = packing.pack_documents(df, **TOKENIZER, with_ids=True).collect()
    place_check(out, 2048)
    plain = Tokenizer.from_file(TOKENIZER["tokenizer_path"])
    want = Counter()
    for i, t in rows:
        ids = plain.encode(t or "", add_special_tokens=False).ids + [0]
        assert len(ids) > 2048 or len(packing.cut(len(ids), 2048)) == 1
        for n, (s, k) in enumerate(packing.cut(len(ids), 2048)):
            want[(i, n, s, k, zlib.crc32(np.array(ids[s : s + k], "<u4").tobytes()), tuple(ids[s : s + k]))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"], tuple(r["ids"])) for r in out) == want
    assert packing.pack_documents(df.limit(0), **TOKENIZER).count() == 0


def test_many_equal_lengths(spark):
    """A length that most pieces have is dealt over all buckets."""
    r = random.Random(0)
    rows = [(i, 0, 0, 64 if i % 3 else r.randint(1, 64), 0) for i in range(5000)]
    df = stored(spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long"))
    out = packing.pack(df, 64, rows_a_bucket=40).collect()
    assert len(out) == len(rows) and {(x["doc_id"], x["length"]) for x in out} == {(x[0], x[3]) for x in rows}
    n = place_check(out, 64)
    assert n <= 1.02 * ffd([x[3] for x in rows], 64)


def test_null_ids_are_dealt_apart(spark):
    """Rows of one id, equal or not, don't share a bucket by it."""
    cut = stored(packing.pieces(spark.createDataFrame([(None, "the same text")] * 3000, "doc_id long, text string"), **TOKENIZER))
    n = len({r["b"] for r in cut.select((F.xxhash64("doc_id", "piece", "_salt") % 64).alias("b")).collect()})
    assert n > 60
    out = packing.pack(cut, 2048).collect()
    assert "_salt" not in out[0].asDict() and len(out) == 3000
    place_check(out, 2048)


def test_corpus(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = packing.pack_documents(docs, **TOKENIZER).collect()
    n = place_check(out, 2048)
    total = sum(x["length"] for x in out)
    assert n <= -(-total // 2048) * 1.1 + 1
    assert {x["doc_id"] for x in out} == {r[0] for r in docs.select("doc_id").collect()}
