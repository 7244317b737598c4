"""The trie of conversation prefixes against a plain one."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from skymatch.llm import prefix_trie
from skymatch.llm.queries import op11_prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def rebuild(rows):
    """conv_id -> its rebuilt turns (role, text)."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(t)] for c, t in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def plain(convs):
    """The nodes of conv_id -> turns, found by looking at every prefix of every conversation."""
    members, children = defaultdict(list), defaultdict(set)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
            if d:
                children[tuple(turns[: d - 1])].add(tuple(turns[:d]))
    leaves, saved = {}, {}
    for k in sorted(members, key=len, reverse=True):
        kids = children[k]
        leaves[k] = sum(leaves[x] for x in kids) if kids else 1
        saved[k] = sum(saved[x] for x in kids) + (len(members[k]) - 1) * (len(k[-1][1]) if k else 0)
    out = []
    for k, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(convs[c]) == len(k))))
        out.append((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(children[k]), leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    columns = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def through(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("depth", F.lit("clash")).withColumn("part", F.lit(1)).repartition(3)
    conv = F.col("conv_id")
    return got(prefix_trie.trie(*prefix_trie.spliced(prefix_trie.numbered(df), conv - conv % 100, F.crc32(conv.cast("string").cast("binary")) % 6, 5)))


def random_rows(seed):
    r = random.Random(seed)
    words = ["", "a", "b", "cd", "é😀", None, "x" * 70 + "1", "x" * 70 + "2"]
    rows = []
    for c in r.sample(range(-250, 450), 160):
        rows += [(c, r.choice([t, t, t, None, 3]), r.choice(["user", "assistant", None]), r.choice(words[: r.choice([2, 4, 8])])) for t in range(r.choice([1, 2, 4, 9]))]
    rows += [(None, 1, "user", "of no conversation"), (7, None, None, None), (7, None, None, None)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", range(2))
def test_nulls_ties_and_repeats(spark, seed):
    rows = random_rows(seed)
    assert through(spark, rows) == plain(rebuild(rows))


def test_groups_in_parts(spark, monkeypatch):
    """Conversations, paths and lists of members longer than a part."""
    monkeypatch.setattr(prefix_trie, "PART", 3)
    rows = random_rows(5) + [(1000 + i, t, "user", f"t{t % 5}") for i in (0, 1, 2, 250, 251) for t in range(20 + i % 3)] + [(2000, None, "user", "again")] * 25
    assert through(spark, rows) == plain(rebuild(rows))


def test_comb(spark):
    """A spine that a conversation leaves at each depth, and conversations that each lengthen another: few rounds, though the trie is deep."""
    rows = [(100 * c, t, "user", f"{'spine' if t < c else 'off'}") for c in range(60) for t in range(c + 1)] + [(100 * (c + 500), t, "user", "same") for c in range(60) for t in range(c + 1)]
    rounds, stored = [], prefix_trie.stored
    prefix_trie.stored, keep = lambda df: (rounds.append("waiting" in df.columns), stored(df))[1], prefix_trie.stored
    try:
        assert through(spark, rows) == plain(rebuild(rows))
    finally:
        prefix_trie.stored = keep
    assert sum(rounds) <= 8


def test_empty_and_turnless(spark):
    assert through(spark, []) == []
    turnless = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6)
    rows = [(turnless, 1, "user", "gone")]
    assert through(spark, rows) == plain(rebuild(rows)) and len(through(spark, rows)) == 1


def test_corpus(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(op11_prefix_trie(spark, sf)) == plain(rebuild(rows))


def test_members_are_hashed_as_they_pass():
    import pyarrow as pa

    rows = [(0, 1, 1, "1,2"), (0, 1, 1, "3"), (1, 1, 1, "4"), (1, 1, 2, "5"), (1, 1, 2, "6")]
    for size in (1, 2, 5):
        batches = [pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*rows[i : i + size])], ["depth", "k1", "k2", "ids"]) for i in range(0, 5, size)]
        out = [tuple(r.values()) for b in prefix_trie.hashed(iter(batches)) for r in b.to_pylist()]
        assert out == [(*k, hashlib.sha256(t).hexdigest()) for k, t in (((0, 1, 1), b"1,2,3"), ((1, 1, 1), b"4"), ((1, 1, 2), b"5,6"))]
    assert list(prefix_trie.hashed(iter([]))) == []
