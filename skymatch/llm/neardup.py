"""MinHash near-dedup with sequential Bayesian verification.

1. Each text becomes its set of distinct word shingles (64-bit hashes), a 128-bit fingerprint of the set and a MinHash signature. Texts with equal
   sets are one class, so copies cost nothing beyond this.
2. Signatures are cut into bands; classes that share a band are candidates. There are as many bands as a chosen miss probability asks for, where sharing a
   single one counts as a miss, since step 4 asks for two.
3. In each bucket all members are held against its leader, the member of the smallest id. A pair's signatures are compared batch by batch. With a
   uniform prior, m matches in n give the posterior Beta(m + 1, n - m + 1) of the similarity; a pair whose posterior chance to reach a bound
   falls below the miss probability is pruned. Survivors are verified on full sets, which also tells how each differs from the leader.
4. Members that aren't linked with a leader near them are held against the others of its surroundings, in blocks, by these differences.
   Members far from the leader are paired within their buckets, but for those near its core, which can't be linked with them, where they share
   a second band, too, whatever the bucket's size. The same pruning
   at the threshold and the same exact check follow. So every pair of two buckets is compared or known to be connected or out of reach.
5. Components come from rounds of minimum labels and pointer jumping over stored tables; nothing about documents reaches the driver.

Nulls and empties: a text without words has an empty set and is linked with nothing. Fewer words than a shingle: the whole sequence is one
shingle. A null id is greater than others and stays null. Repeated rows share a class; all rows with its smallest id are kept, since the rule
is doc_id = component_id. Other columns are ignored by groups and pass through one_of_each, whatever their names. Texts are used whole. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, boxed, row_hash, stored, unboxed

U64 = np.uint64
LAST = 2**63 - 1


@dataclass(frozen=True)
class NearDup:
    """Texts link if 100 * intersection >= percent * union. core: percent of similarity with a leader. rows: hashes a band. miss: chance at the threshold that fewer than two bands agree. prune: chance of a wrong pruning at each look. batch: hashes between looks."""

    shingle: int = 5
    percent: int = 80
    rows: int = 6
    miss: float = 1e-6
    prune: float = 1e-9
    batch: int = 20
    seed: int = 7
    core: int = 75

    @property
    def bands(self) -> int:
        p, n = (self.percent / 100) ** self.rows, 2
        while (1 - p) ** n + n * p * (1 - p) ** (n - 1) > self.miss:
            n += 1
        return n

    @property
    def hashes(self) -> int:
        return self.bands * self.rows

    @property
    def around(self) -> float:
        """Whatever is linked with a member of a leader's core has at least this similarity with the leader: 1 - similarity is a metric."""
        return (self.core + self.percent) / 100 - 1

    def looks(self, t: float) -> list[tuple[int, int]]:
        """(n, m): with fewer than m matches in the first n hashes it can be ruled out that the similarity is t or more."""
        out = []
        for n in [*range(self.batch, self.hashes, self.batch), self.hashes]:
            # P(similarity >= t) under Beta(m + 1, n - m + 1) is P(Binomial(n + 1, t) <= m)
            tail, m = 0.0, -1
            while tail < self.prune:
                m += 1
                tail += math.exp(math.lgamma(n + 2) - math.lgamma(m + 1) - math.lgamma(n + 2 - m) + m * math.log(t) + (n + 1 - m) * math.log(1 - t))
            out.append((n, m))
        return out


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose bits all depend on all bits."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class WordHashes(dict):
    """64-bit hashes of words, kept for words seen lately."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = out = xxhash.xxh64_intdigest(word)
        return out


def shingle_set(text: str | None, size: int, known: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text; A-Z are lower-cased, and words are what ASCII white space separates."""
    ws = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not ws:
        return np.empty(0, U64)
    h = np.fromiter(map(known.__getitem__, ws), dtype=U64, count=len(ws))
    k = min(size, len(h))
    out = np.full(len(h) - k + 1, k, dtype=U64)
    for i in range(k):
        out = mixed(out ^ h[i : len(h) - k + 1 + i])
    return np.unique(out)


def coefficients(how: NearDup) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(how.seed)
    return (r.integers(1, 2**31, how.hashes, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None], r.integers(0, 2**32, how.hashes, dtype=np.uint32)[:, None]


def signature(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (shingles >> U64(32)).astype(np.uint32)
    out = (x[:1024] * a + b).min(axis=1)
    for i in range(1024, len(x), 1024):
        np.minimum(out, (x[i : i + 1024] * a + b).min(axis=1), out=out)
    return out


def band_hashes(signatures: np.ndarray, how: NearDup) -> np.ndarray:
    """int64[rows, bands]: a hash of each band's number and minima."""
    s = signatures.reshape(len(signatures), how.bands, how.rows).astype(U64)
    out = np.broadcast_to(np.arange(how.bands, dtype=U64), s.shape[:2]).copy()
    for i in range(how.rows):
        out = mixed(out * U64(0x9E3779B97F4A7C15) + s[:, :, i] + U64(1))
    return out.view(np.int64)


def fingerprints(docs: DataFrame, how: NearDup, key: str, text: str) -> DataFrame:
    """id, version (a hash of the text), n_shingles, fp, sig, bands for each row of docs; the last three are null for empty sets."""
    schema = "id long, version long, n_shingles long, fp binary, sig binary, bands array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, (a, b) = WordHashes(), coefficients(how)
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                sizes, fps, sigs = [], [], []
                for t in part.column(2).to_pylist():
                    s = shingle_set(t, how.shingle, known)
                    sizes.append(len(s))
                    fps.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                    sigs.append(signature(s, a, b) if len(s) else None)
                full = [x for x in sigs if x is not None]
                bands = iter(band_hashes(np.array(full), how) if full else ())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(sizes, pa.int64()), pa.array(fps, pa.binary()), pa.array([x if x is None else x.tobytes() for x in sigs], pa.binary()), pa.array([x if x is None else next(bands) for x in sigs], pa.list_(pa.int64()))],
                    ["id", "version", "n_shingles", "fp", "sig", "bands"],
                )

    return docs.select(F.coalesce(F.col(key).cast("long"), F.lit(LAST)).alias("id"), F.xxhash64(F.col(text)).alias("version"), F.col(text).alias("text")).mapInArrow(run, schema)


def full_sets(docs: DataFrame, wanted: DataFrame, how: NearDup, key: str, text: str) -> DataFrame:
    """wanted: id, version, fp. fp, shingles (little-endian 64-bit hashes), a row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                rows = [(fp, s.tobytes()) for fp, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()) if len(s := shingle_set(t, how.shingle, known)) and xxhash.xxh3_128_digest(s.tobytes()) == fp]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.binary()) for i in range(2)], ["fp", "shingles"])

    texts = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(LAST)).alias("id"), F.xxhash64(F.col(text)).alias("version"), F.col(text).alias("text"))
    found = texts.join(wanted, ["id", "version"]).select("fp", "text").mapInArrow(run, "fp binary, shingles binary")
    return found


def likely(pairs: DataFrame, classes: DataFrame, how: NearDup, threshold: float) -> DataFrame:
    """pairs (with columns a, b) and passed: false where a look prunes the pair, that is where similarity can't be taken to reach threshold."""
    looks = how.looks(threshold)

    @F.pandas_udf("boolean")
    def passes(x: pd.Series, y: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=bool)
        s, t = (np.frombuffer(b"".join(v), np.uint32).reshape(len(v), how.hashes) for v in (x, y))
        alive, matches, at = np.arange(len(s)), np.zeros(len(s), int), 0
        for n, m in looks:
            matches = matches + (s[alive, at:n] == t[alive, at:n]).sum(axis=1)
            on = matches >= m
            alive, matches, at = alive[on], matches[on], n
        out = np.zeros(len(s), bool)
        out[alive] = True
        return pd.Series(out)

    left = classes.select(F.col("fp").alias("a"), F.col("sig").alias("_x"))
    right = classes.select(F.col("fp").alias("b"), F.col("sig").alias("_y"))
    return pairs.join(left, "a").join(right, "b").withColumn("passed", passes("_x", "_y")).select("a", "b", "passed")


def compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) with n_a (size of a's set), lost, added (sizes of a - b and b - a) and diff (the elements of both differences)."""

    @F.pandas_udf("n_a long, lost long, added long, diff binary")
    def diff(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        rows = []
        for s, t in zip(x, y):
            s, t = np.frombuffer(s, U64), np.frombuffer(t, U64)
            d = np.setxor1d(s, t, assume_unique=True)
            both = (len(s) + len(t) - len(d)) // 2
            rows.append((len(s), len(s) - both, len(t) - both, d.tobytes()))
        return pd.DataFrame(rows, columns=["n_a", "lost", "added", "diff"])

    left, right = (sets.select(F.col("fp").alias(k), F.col("shingles").alias(v)) for k, v in (("a", "_x"), ("b", "_y")))
    return pairs.join(left, "a").join(right, "b").select("a", "b", diff("_x", "_y").alias("_d")).select("a", "b", "_d.*")


def reaches(percent: int) -> Column:
    """Whether a row of compared() is as similar as that."""
    both, union = F.col("n_a") - F.col("lost"), F.col("n_a") + F.col("added")
    return 100 * both >= percent * union


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pd.DataFrame]:
    """The groups of rows that are sorted by keys."""
    rest: list[pd.DataFrame] = []
    for batch in batches:
        df = batch.to_pandas()
        if not len(df):
            continue
        ids = list(zip(*(df[k] for k in keys)))
        cuts = [0, *(i for i in range(1, len(ids)) if ids[i] != ids[i - 1]), len(ids)]
        for i, j in zip(cuts, cuts[1:]):
            part = df.iloc[i:j]
            if rest and tuple(rest[0][k].iloc[0] for k in keys) != ids[i]:
                yield pd.concat(rest)
                rest = []
            rest.append(part)
    if rest:
        yield pd.concat(rest)


def forest(n: int, pairs: np.ndarray) -> list[tuple[int, int]]:
    """Those of pairs that connect what the ones before left apart."""
    up, out = list(range(n)), []

    def top(i: int) -> int:
        while up[i] != i:
            up[i] = i = up[up[i]]
        return i

    for i, j in pairs.tolist():
        if (x := top(i)) != (y := top(j)):
            up[x] = y
            out.append((i, j))
    return out


def beside_leader(near: DataFrame, how: NearDup, block: int = 256, elements: int = 200_000) -> DataFrame:
    """Links between members of a leader's surroundings of which one at least isn't linked with the leader itself.

    near: rows of compared(), a being the leader. Sets are known by how they differ from the leader's, so an overlap follows from the sizes and the
    common differences. Members are dealt into blocks of bounded size and blocks are held against each other; of the links in
    a pair of blocks a spanning forest is returned, which has the same components.
    """
    rows = near.withColumn("_open", ~reaches(how.percent))
    size = rows.groupBy("a").agg(F.count("*").alias("_n"), F.sum(F.length("diff") / 8).alias("_e"), F.sum(F.col("_open").cast("int")).alias("_u")).where("_u > 0 AND _n > 1")
    size = size.withColumn("_blocks", F.ceil(F.greatest(F.col("_n") / block, F.col("_e") / elements)).cast("int"))
    size = size.withColumn("_ublocks", F.ceil(F.col("_blocks") * F.col("_u") / F.col("_n")).cast("int"))
    # stored: else the join stands in one stage with the aggregation, and a hot leader's partition can't be split
    rows = rows.join(stored(size.select("a", "_blocks", "_ublocks")), "a")
    spot = F.pmod(F.xxhash64("b"), F.lit(2**31))
    mine = rows.where("_open").withColumn("_i", (spot % F.col("_ublocks")).cast("int")).withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).withColumn("_side", F.lit(0))
    other = rows.withColumn("_j", (spot % F.col("_blocks")).cast("int")).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_ublocks") - 1))).withColumn("_side", F.lit(1))
    keys = ["a", "_i", "_j"]
    dealt = mine.select(*keys, "_side", "b", "n_a", "lost", "added", "diff").unionByName(other.select(*keys, "_side", "b", "n_a", "lost", "added", "diff"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in sorted_groups(batches, keys):
            side = g["_side"].to_numpy()
            u, v = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            if not len(u) or not len(v):
                continue
            diffs = [np.frombuffer(x, U64) for x in g["diff"]]
            flat, who = np.concatenate(diffs), np.repeat(np.arange(len(diffs)), [len(x) for x in diffs])
            _, element, times = np.unique(flat, return_inverse=True, return_counts=True)
            shared = times[element] > 1
            element, who = np.unique(element[shared], return_inverse=True)[1], who[shared]
            common = np.zeros((len(u), len(v)), np.float32)
            order = np.argsort(element, kind="stable")
            element, who = element[order], who[order]
            n = int(element[-1]) + 1 if len(element) else 0
            for at in range(0, n, 8192):
                i, j = np.searchsorted(element, (at, at + 8192))
                m = np.zeros((len(diffs), min(8192, n - at)), np.float32)
                m[who[i:j], element[i:j] - at] = 1
                common += m[u] @ m[v].T
            base, lost, added = (g[c].to_numpy() for c in ("n_a", "lost", "added"))
            sizes = base - lost + added
            both = base[0] - lost[u][:, None] - lost[v][None, :] + common.astype(np.int64)
            union = sizes[u][:, None] + sizes[v][None, :] - both
            x, y = np.nonzero(100 * both >= how.percent * union)
            names = g["b"].tolist()
            ids = {b: i for i, b in enumerate(dict.fromkeys(names))}
            pairs = np.array([(ids[names[u[i]]], ids[names[v[j]]]) for i, j in zip(x, y)], dtype=int).reshape(-1, 2)
            names = list(ids)
            found = forest(len(names), pairs)
            yield pa.RecordBatch.from_arrays([pa.array([names[f[i]] for f in found], pa.binary()) for i in range(2)], ["a", "b"])

    return dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a binary, b binary")


def components(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """edges: a, b (stored). ids: fp, id. fp, root (struct of the smallest id and its fp), for each fp in edges."""
    both = stored(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    ends = both.select(F.col("a").alias("fp")).distinct()
    own = F.struct("id", "fp")
    labels = stored(ends.join(ids.select("fp", "id"), "fp").select("fp", own.alias("root")))
    while True:
        near = both.join(labels.withColumnRenamed("fp", "b"), "b").groupBy("a").agg(F.min("root").alias("_near"))
        hooked = labels.join(near, labels["fp"] == near["a"]).select("fp", "root", F.least("root", "_near").alias("_new"))
        hooked = stored(hooked)
        up = hooked.select(F.col("fp").alias("_fp"), F.col("_new").alias("_up"))
        jumped = hooked.join(up, F.col("_new.fp") == F.col("_fp")).select("fp", F.least("_new", "_up").alias("root"), (F.col("root") != F.least("_new", "_up")).alias("_moved"))
        jumped = stored(jumped)
        labels = jumped.select("fp", "root")
        if jumped.where("_moved").isEmpty():
            return labels


def loose_pairs(loose: DataFrame, banded: DataFrame) -> DataFrame:
    """loose: band, fp, _far. Pairs (a, b) of a band's members of which one is far from its leader, and which share another band: linked ones do, but for the miss probability."""
    dealt = loose.join(banded.withColumnRenamed("band", "_other"), "fp").where("_other != band")
    left = dealt.where("_far").select("band", "_other", F.col("fp").alias("a"))
    right = dealt.select("band", "_other", F.col("fp").alias("b"), "_far")
    pairs = left.join(right, ["band", "_other"]).where((F.col("a") < F.col("b")) | ~F.col("_far") & (F.col("a") != F.col("b")))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def groups(docs: DataFrame, how: NearDup = NearDup(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, version (a hash of the text), n_shingles, component_id, component (a key of it, null for empty sets), kept, a row for each row of docs."""
    slim = stored(fingerprints(docs, how, key, text))
    classes = stored(slim.where("fp IS NOT NULL").groupBy("fp").agg(F.min(F.struct("id", "version")).alias("_rep"), F.first("sig").alias("sig"), F.first("bands").alias("bands")).select("fp", "_rep.*", "sig", "bands"))
    ids = classes.select("fp", "id", "version")
    banded = classes.select("id", "fp", F.explode("bands").alias("band"))
    led = banded.groupBy("band").agg(F.min(F.struct("id", "fp")).alias("leader"), F.count("*").alias("_n")).where("_n > 1").select("band", F.col("leader.fp").alias("leader"))
    members = stored(banded.join(led, "band").where("fp != leader").select("band", "leader", "fp"))
    star = stored(likely(members.select(F.col("leader").alias("a"), F.col("fp").alias("b")).distinct(), classes, how, how.around))

    def sets_for(pairs: DataFrame) -> DataFrame:
        ends = pairs.select(F.col("a").alias("fp")).unionByName(pairs.select(F.col("b").alias("fp"))).distinct()
        return stored(full_sets(docs, ids.join(ends, "fp"), how, key, text).dropDuplicates(["fp"]))

    close = star.where("passed").select("a", "b")
    near = stored(compared(close, sets_for(close)))
    edges = near.where(reaches(how.percent)).select("a", "b").unionByName(beside_leader(near, how))
    # pairs of a bucket of which one is far from the leader; the other isn't near its core, as links are short
    far = star.where("NOT passed").select(F.col("a").alias("leader"), F.col("b").alias("fp"), F.lit(True).alias("_far"))
    shell = near.where(~reaches(how.core)).select(F.col("a").alias("leader"), F.col("b").alias("fp"), F.lit(False).alias("_far"))
    loose = stored(members.join(far.unionByName(shell), ["leader", "fp"]).select("band", "fp", "_far"))
    across = loose_pairs(loose, banded.select("fp", "band"))
    across = stored(likely(across, classes, how, how.percent / 100).where("passed").select("a", "b"))
    edges = edges.unionByName(compared(across, sets_for(across)).where(reaches(how.percent)).select("a", "b"))
    roots = components(edges, ids)
    # stored, so that the join below can split the rows of a class of many copies
    final = stored(ids.drop("version").join(roots, "fp", "left").select(F.col("fp").alias("_fp"), F.coalesce("root.id", "id").alias("_root"), F.coalesce("root.fp", "fp").alias("component")))
    out = slim.select("id", "version", "n_shingles", "fp").join(final, F.col("fp") == F.col("_fp"), "left")
    known = lambda c: F.when(c != LAST, c)
    out = out.select(known(F.col("id")).alias("doc_id"), "version", "n_shingles", known(F.coalesce("_root", "id")).alias("component_id"), "component")
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def one_of_each(docs: DataFrame, how: NearDup = NearDup(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without all but one document of each group: the one of smallest id, and of repeated rows one. Empty documents stay."""
    has_words = F.coalesce(F.col(text).rlike(f"[^{SPACE}]"), F.lit(False))
    found = groups(docs, how, key, text).where("kept AND component IS NOT NULL")
    keep = found.groupBy("component").agg(F.min(F.struct("doc_id", "version")).alias("_c")).select(F.col("_c.doc_id").alias("_id"), F.col("_c.version").alias("_v"))
    of = F.col("_row").getField
    rows = docs.where(has_words).select(boxed(docs), row_hash(docs, text).alias("_hash")).withColumn("_version", F.xxhash64(of(text)))
    rows = rows.join(keep, of(key).cast("long").eqNullSafe(F.col("_id")) & (F.col("_version") == F.col("_v")))
    # rows that share id and text: the one of least hash, which is chosen before the shuffle, too
    rows = rows.withColumn("_rank", F.row_number().over(Window.partitionBy("_id", "_v").orderBy("_hash"))).where("_rank = 1")
    return rows.select(*unboxed(docs.columns)).unionByName(docs.where(~has_words))
