"""Best-fit decreasing windows: patterns as piece by piece, ids as the tokenizer gives them, exact places."""

import bisect
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from skymatch.llm import window_packing
from skymatch.llm.settings import WORD_TOKENIZER
from tests.llm.test_packing import TEXTS, place_check

AWKWARD = [
    *TEXTS, "It's HERS; they'LL we'Ve DON'T o'clock 'Tis", "naïve café ÀÉÎ straße ŁÓDŹ İstanbul ΣΑΣ ǅ", "é ä ẛ̣ ﬁ", "x\x01y \x02 z\x00", "a b c　d\x0be\x0cf\x85g\x1ch", "<|ENDOFTEXT|> <|startoftext|>x<|endoftext|>",
    "123 4,567.89 ½ ² ٣", "你好，世界 こんにちは мир العربية", "😀😀 a👍🏽b", "!!!??? --- ... @#$%^&*()", "a" * 300 + " " + "b1" * 200, "--\tfoo\r\n\r\nBar_baz", "﻿bom ​zero",
]


def piece_by_piece(sizes, capacity):
    """What is in each window after best-fit decreasing, one piece at a time."""
    rooms, fills = [], []
    for n in sorted(sizes, reverse=True):
        i = bisect.bisect_left(rooms, (n, -1))
        if i < len(rooms):
            room, w = rooms.pop(i)
        else:
            room, w = capacity, len(fills)
            fills.append(0)
        fills[w] += n
        bisect.insort(rooms, (room - n, w))
    return Counter(fills)


@pytest.mark.parametrize("capacity", [1, 2, 7, 16, 100, 2048])
def test_plan(capacity):
    r = np.random.default_rng(capacity)
    for _ in range(25):
        sizes = r.integers(1, capacity + 1, r.integers(0, 1500)) if r.random() < 0.5 else np.minimum(capacity, r.geometric(3 / (capacity + 2), 800))
        counts = np.bincount(sizes, minlength=capacity + 1)
        used, fills = np.zeros_like(counts), Counter()
        plan = window_packing.plan_windows(counts, capacity)
        for times, lengths in plan:
            fills[sum(lengths)] += times
            np.add.at(used, lengths, times)
        assert (used[1:] == counts[1:]).all() and fills == piece_by_piece(sizes.tolist(), capacity)


def test_plan_of_huge_counts():
    """The plan depends on how many lengths there are, not on how many pieces."""
    counts = np.full(2049, 10**12, np.int64)
    plan = window_packing.plan_windows(counts, 2048)
    assert len(plan) < 4 * 2048
    assert sum(t * sum(x) for t, x in plan) == sum(n * 10**12 for n in range(2049))


def test_segment_tree():
    r, rooms, tree = np.random.default_rng(5), Counter(), window_packing.OpenWindows(50)
    for _ in range(2000):
        room = int(r.integers(0, 51))
        n = 1 if r.random() < 0.5 else -min(1, rooms[room])
        rooms[room] += n
        tree.add(room, n)
        want = int(r.integers(0, 51))
        assert tree.tightest(want) == min((x for x in rooms if x >= want and rooms[x]), default=None)


def test_ids_are_the_tokenizers():
    encode = window_packing.WordEncoder(**WORD_TOKENIZER)
    assert encode.fast
    for text in [t or "" for t in AWKWARD] * 2:
        assert encode(text).tolist() == encode.plain.encode(text, add_special_tokens=False).ids, text


def test_ids_are_the_tokenizers_on_the_corpus(spark, sf):
    encode = window_packing.WordEncoder(**WORD_TOKENIZER)
    for (text,) in spark.read.parquet(f"{sf}/documents.parquet").select(F.coalesce("text", F.lit(""))).collect():
        assert encode(text).tolist() == encode.plain.encode(text, add_special_tokens=False).ids


def test_other_files_go_the_plain_way(tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    t = Tokenizer(models.WordLevel({"a": 0, "b": 1, "?": 2}, unk_token="?"))
    t.pre_tokenizer = pre_tokenizers.Whitespace()
    t.save(str(tmp_path / "t.json"))
    encode = window_packing.WordEncoder(str(tmp_path / "t.json"))
    assert encode.fast is None and encode("b a c").tolist() == [1, 0, 2]


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(window_packing, "REMEMBERED", 100)
    encode = window_packing.WordEncoder(**WORD_TOKENIZER)
    for i in range(50):
        text = f"word{i} other{i * 7}"
        assert encode(text).tolist() == encode.plain.encode(text, add_special_tokens=False).ids
        assert encode.size < 200


def test_pieces_and_places(spark):
    from tokenizers import Tokenizer

    rows = [(i, t) for i, t in enumerate(AWKWARD)] + [(3, AWKWARD[3]), (3, AWKWARD[3]), (None, "no id"), (None, "no id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("length", F.lit(7)).withColumn("piece", F.lit("clash")).withColumn("doc_tokens", F.lit(1)).withColumn("_salt", F.lit("x"))
    out = window_packing.pack_windows(df, **WORD_TOKENIZER, with_ids=True).collect()
    place_check(out, 2048)
    plain, want = Tokenizer.from_file(WORD_TOKENIZER["tokenizer_path"]), Counter()
    for i, t in rows:
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 1]
        for s in range(0, len(ids), 2048):
            x = ids[s : s + 2048]
            want[(i, s, len(x), zlib.crc32(np.array(x, "<u4").tobytes()), len(ids), tuple(x))] += 1
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"], tuple(r["ids"])) for r in out) == want
    assert len({r["sequence_id"] for r in out}) == sum(piece_by_piece([r["length"] for r in out], 2048).values())
    assert window_packing.pack_windows(df.limit(0), **WORD_TOKENIZER).count() == 0


def test_corpus(spark, sf):
    from skymatch.llm.queries import op13_window_packing

    out = op13_window_packing(spark, sf).collect()
    n = place_check(out, 2048)
    total = sum(r["length"] for r in out)
    assert n <= -(-total // 2048) + 1
    docs = {}
    for r in out:
        docs.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["doc_tokens"]))
    assert set(docs) == {x[0] for x in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").collect()}
    for cuts in docs.values():
        at = 0
        for start, length, tokens in sorted(cuts):
            assert start == at and (length == 2048 or start + length == tokens)
            at += length
        assert at == cuts[0][2]
