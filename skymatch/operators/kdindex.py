"""A kd-tree over reference objects that is built once and kept, for exact nearest neighbours by fluxes alone.

`KdIndex.fit` stores the tree and the packed leaves in a folder; `KdIndex.open` loads the tree, and `query` reads the leaves, so that a second query reads no
reference table. The tree's cuts are medians of a bounded sample; every object is then dealt to a leaf by them, and nodes know the true bounds and number of what they hold.

What bounds the k-th neighbour of a target in that sample, which the tree keeps, bounds it among all objects; farther objects are returned by no look. A target goes down the tree twice. The first time it follows the cuts, up to the smallest subtree around it that holds k objects, and looks through that one, which bounds how far its k-th neighbour
can be. The second time it goes down all branches whose bounds come as near as that. Leaves are cut into blocks of leaf_rows objects or so, by hashes, so that a crowd of
equal objects, which no cut can part, is many blocks. Targets meet blocks by an equality join, in tiles that each task makes of its own rows, at most TILE targets each: neither side has a row that grows
with the number of targets or of objects in a leaf, and a hot leaf's tiles can be split between tasks. The driver holds the tree alone: two numbers a band and node, at most 2 * MOST_LEAVES nodes.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import MissingData, WrongFormat
from ..functions.photometry import DISTANCES
from ..sources.scratch import folder, stored
from .knn import Search, _side, best, distances, ranked, tile_rows, together
from .leaves import Leaves

SAMPLE, MOST_LEAVES, TILE = 65_536, 16_384, 4096


@dataclass
class Tree:
    """Inner node i cuts `band[i]` at `cut[i]` (what is below goes to 2 i + 1, the rest to 2 i + 2); leaves follow the inner nodes. low, high[nodes, bands]: bounds of what each node holds; size: how many; blocks[leaves]: into how many blocks a leaf is cut. sample[objects, bands]: what the cuts are from."""

    depth: int
    band: np.ndarray
    cut: np.ndarray
    low: np.ndarray
    high: np.ndarray
    size: np.ndarray
    blocks: np.ndarray
    sample: np.ndarray | None = None

    @classmethod
    def split(cls, sample: np.ndarray, depth: int) -> Tree:
        """Cuts at medians of the band that spreads most, from a sample [objects, bands]."""
        inner = (1 << depth) - 1
        band, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        parts = {0: np.arange(len(sample))}
        for i in range(inner):
            at = parts.pop(i)
            if len(at):
                x = sample[at]
                band[i] = int(np.argmax(np.quantile(x, 0.9, axis=0) - np.quantile(x, 0.1, axis=0)))
                cut[i] = np.median(x[:, band[i]])
            below = sample[at, band[i]] < cut[i]
            parts[2 * i + 1], parts[2 * i + 2] = at[below], at[~below]
        none = np.zeros((2 * inner + 1, sample.shape[1]))
        return cls(depth, band, cut, none + np.inf, none - np.inf, np.zeros(2 * inner + 1, np.int64), np.ones(inner + 1, np.int64), sample)

    @property
    def inner(self) -> int:
        return len(self.band)

    def filled(self, held: list[tuple[int, int, list[float], list[float]]], leaf_rows: int) -> None:
        """Takes (leaf, number, lows, highs), and hands bounds and numbers up the tree."""
        for leaf, n, low, high in held:
            self.size[self.inner + leaf], self.low[self.inner + leaf], self.high[self.inner + leaf] = n, low, high
        self.blocks = np.maximum(1, -(-self.size[self.inner :] // max(1, leaf_rows)))
        for i in range(self.inner - 1, -1, -1):
            a, b = 2 * i + 1, 2 * i + 2
            self.size[i] = self.size[a] + self.size[b]
            self.low[i], self.high[i] = np.minimum(self.low[a], self.low[b]), np.maximum(self.high[a], self.high[b])

    def leaf(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each of x[objects, bands]."""
        i = np.zeros(len(x), np.int64)
        for _ in range(self.depth):
            i = 2 * i + 1 + ~(x[np.arange(len(x)), self.band[i]] < self.cut[i])
        return i - self.inner

    def around(self, x: np.ndarray, k: int) -> np.ndarray:
        """The smallest subtree with k objects that each of x[objects, bands] falls into; the whole tree if it holds fewer."""
        i = self.leaf(x) + self.inner
        while (few := (self.size[i] < k) & (i > 0)).any():
            i[few] = (i[few] - 1) // 2
        return i

    def below(self, row: np.ndarray, node: np.ndarray, x: np.ndarray | None = None, limit: np.ndarray | None = None, but: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of all leaves with objects below the nodes of rows; with a limit, of those that come as near x[row] as that, by squared distance, and don't lie below but[row]."""
        found = []
        while len(row):
            keep = self.size[node] > 0
            if limit is not None:
                gap = np.maximum(np.maximum(self.low[node] - x[row], x[row] - self.high[node]), 0)
                with np.errstate(invalid="ignore"):
                    keep &= (gap * gap).sum(axis=1) <= limit[row]
                keep &= node != but[row]
            row, node = row[keep], node[keep]
            done = node >= self.inner
            found.append((row[done], node[done] - self.inner))
            row, node = row[~done], node[~done]
            row, node = np.concatenate([row, row]), np.concatenate([2 * node + 1, 2 * node + 2])
        return tuple(np.concatenate([f[j] for f in found]) if found else np.zeros(0, np.int64) for j in range(2))

    def dumped(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, depth=self.depth, **{n: getattr(self, n) for n in ("band", "cut", "low", "high", "size", "blocks")}, **({} if self.sample is None else {"sample": self.sample}))
        return out.getvalue()

    @classmethod
    def loaded(cls, data: bytes) -> Tree:
        with np.load(io.BytesIO(data)) as x:
            return cls(int(x["depth"]), *(x[n] for n in ("band", "cut", "low", "high", "size", "blocks")), x["sample"] if "sample" in x else None)


def _matrix(batch: pa.RecordBatch, first: int, columns: int) -> np.ndarray:
    return np.column_stack([batch.column(first + i).to_numpy(zero_copy_only=False) for i in range(columns)]).astype(float).reshape(batch.num_rows, columns)


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    flat = np.concatenate([p.ravel() for p in parts]) if parts else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([p.size for p in parts])]), pa.int32()), pa.array(flat, kind))


@dataclass
class KdIndex:
    """A stored index. path holds `tree` and `leaves`: leaf, block, ids, values (fluxes and errors of the bands, one object after another)."""

    spark: SparkSession
    path: str
    bands: list[str]
    tree: Tree

    @classmethod
    def fit(cls, refs: DataFrame, bands: list[str], path: str, leaf_rows: int = 2048) -> KdIndex:
        """Builds and stores it; refs is read once."""
        spark = refs.sparkSession
        side = stored(_side(refs, "ref_id", bands))
        leaves = min(MOST_LEAVES, max(1, side.count() // max(1, leaf_rows)))
        sample = side.select(*(f"f_{b}" for b in bands), F.xxhash64("ref_id").alias("_o")).orderBy("_o", *(f"f_{b}" for b in bands)).limit(SAMPLE).drop("_o").toPandas().to_numpy(float).reshape(-1, len(bands))
        tree = Tree.split(sample, int(np.ceil(np.log2(leaves))))

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    yield b.append_column("_leaf", pa.array(tree.leaf(_matrix(b, 2, 2 * len(bands))[:, ::2]), pa.int64()))

        columns = ", ".join(f"{x}_{b} double" for b in bands for x in ("f", "e"))
        dealt = stored(side.select("ref_id", F.xxhash64("ref_id").alias("_h"), *side.columns[1:]).mapInArrow(deal, f"ref_id long, _h long, {columns}, _leaf long"))
        bounds = [f(f"f_{b}").alias(f"{k}_{b}") for b in bands for k, f in (("low", F.min), ("high", F.max))]
        rows = dealt.groupBy("_leaf").agg(F.count("*").alias("n"), *bounds).collect()  # a row a leaf
        tree.filled([(r["_leaf"], r["n"], [r[f"low_{b}"] for b in bands], [r[f"high_{b}"] for b in bands]) for r in rows], leaf_rows)
        blocks = tree.blocks

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                leaf, h = (b.column(n).to_numpy(zero_copy_only=False) for n in ("_leaf", "_h"))
                yield b.append_column("_block", pa.array(h % blocks[leaf], pa.int64()))

        values = F.array(*(F.col(f"{x}_{b}") for b in bands for x in ("f", "e")))
        packed = dealt.mapInArrow(cut, f"ref_id long, _h long, {columns}, _leaf long, _block long").groupBy("_leaf", "_block")
        packed.agg(F.collect_list("ref_id").alias("ids"), F.flatten(F.collect_list(values)).alias("values")).write.mode("overwrite").parquet(f"{path}/leaves")  # leaf_rows or so a block
        spark.createDataFrame([(list(bands), bytearray(tree.dumped()))], "bands array<string>, tree binary").coalesce(1).write.mode("overwrite").parquet(f"{path}/tree")
        return cls(spark, path, list(bands), tree)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> KdIndex:
        row = spark.read.parquet(f"{path}/tree").head()
        if row is None:
            raise MissingData(f"there is no index at {path}")
        return cls(spark, path, list(row["bands"]), Tree.loaded(bytes(row["tree"])))

    def leaves(self) -> DataFrame:
        return self.spark.read.schema("_leaf long, _block long, ids array<long>, values array<double>").parquet(f"{self.path}/leaves")

    def limited(self, targets: DataFrame, k: int) -> DataFrame:
        """target_id, fluxes, _limit: the squared distance of the k-th neighbour in the tree's sample, which that among all objects can't exceed. A few small files give few tasks, so targets are dealt anew."""
        names, sample = [f"f_{b}" for b in self.bands], self.tree.sample

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            near = None
            for b in together(batches, tile_rows(Search(k))):
                x = _matrix(b, 1, len(names))
                limit = np.full(len(x), np.inf)
                if sample is not None and len(sample) >= k and np.isfinite(x).all() and np.isfinite(sample).all():
                    near = near or Leaves(np.stack([sample, np.zeros_like(sample)], axis=2), np.arange(len(sample)), "euclidean")
                    limit = near.kth(np.stack([x, np.zeros_like(x)], axis=2), k) ** 2
                yield b.append_column("_limit", pa.array(limit))

        tasks = 2 * self.spark.sparkContext.defaultParallelism
        side = targets.select(F.col("target_id").cast("long"), *names).repartition(tasks, "target_id")
        return side.mapInArrow(run, f"target_id long, {', '.join(f'{n} double' for n in names)}, _limit double")

    def tiles(self, targets: DataFrame, k: int, limit: str | None = None) -> DataFrame:
        """_leaf, _block, tids, tvalues, limits: targets (ids and fluxes, and the column _limit, if there is one) for each block that they look through: without a limit those of the smallest subtree that holds k objects, with one, a column of squared distances, all others that come as near."""
        names, tree = [f"f_{b}" for b in self.bands], self.tree
        known = limit or ("_limit" if "_limit" in targets.columns else None)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in together(batches, TILE):
                for at in range(0, b.num_rows, TILE):
                    part = b.slice(at, TILE)
                    far = np.full(part.num_rows, np.inf)
                    if known:
                        far = part.column(len(names) + 1).to_numpy(zero_copy_only=False)
                        far = np.where(np.isnan(far), np.inf, far) * (1 + 1e-9) + 1e-300  # roundings lose no tie
                    tid, x = part.column(0).to_numpy(zero_copy_only=False), _matrix(part, 1, len(names))
                    near, rows = tree.around(x, k), np.arange(len(x))
                    if limit:
                        row, leaf = tree.below(rows, np.zeros(len(x), np.int64), x, far, near)
                    else:
                        row, leaf = tree.below(rows, near)
                    order = np.argsort(leaf, kind="stable")
                    row, leaf = row[order], leaf[order]
                    groups = [(int(leaf[g[0]]), row[g]) for g in np.split(np.arange(len(leaf)), np.flatnonzero(np.diff(leaf)) + 1) if len(g)]
                    for leaf_, of in groups:
                        n = int(tree.blocks[leaf_])
                        for first in range(0, n, 16):  # a crowd's blocks, some at a time
                            some = range(first, min(n, first + 16))
                            arrays = [pa.array([leaf_] * len(some), pa.int64()), pa.array(some, pa.int64()), _lists([tid[of]] * len(some), pa.int64()), _lists([x[of]] * len(some), pa.float64()), _lists([far[of]] * len(some), pa.float64())]
                            yield pa.RecordBatch.from_arrays(arrays, ["_leaf", "_block", "tids", "tvalues", "limits"])

        return targets.select("target_id", *names, *([known] if known else [])).mapInArrow(run, "_leaf long, _block long, tids array<long>, tvalues array<double>, limits array<double>")

    def looked_through(self, tiles: DataFrame, k: int) -> DataFrame:
        """target_id, ref_id, distance, values: of the k best of each block for each target that looks through it, those within its limit."""
        bands = len(self.bands)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in range(b.num_rows):
                    tid, t, far, ids, r = (b.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("tids", "tvalues", "limits", "ids", "values"))
                    t, r = t.reshape(len(tid), bands), r.reshape(len(ids), bands, 2)
                    step = max(1, 200_000 // len(ids))
                    for at in range(0, len(tid), step):
                        d = distances(t[at : at + step, :, None], r, "euclidean")
                        near = best(d, ids, k)
                        value = np.take_along_axis(d, near, axis=1)
                        row, column = np.nonzero(~(value * value > far[at : at + step, None]))
                        own = near[row, column]
                        lists = pa.ListArray.from_arrays(pa.array(2 * bands * np.arange(len(own) + 1), pa.int32()), pa.array(r[own].ravel(), pa.float64()))
                        yield pa.RecordBatch.from_arrays([pa.array(tid[at + row]), pa.array(ids[own]), pa.array(value[row, column]), lists], ["target_id", "ref_id", "distance", "values"])

        return tiles.join(self.leaves(), ["_leaf", "_block"]).select("tids", "tvalues", "limits", "ids", "values").mapInArrow(run, "target_id long, ref_id long, distance double, values array<double>")

    def nearest(self, targets: DataFrame, k: int) -> DataFrame:
        """target_id, rank, ref_id, distance, values of the k nearest by fluxes. targets is read once."""
        side = stored(self.limited(_side(targets, "target_id", self.bands), k))
        first = stored(self.looked_through(stored(self.tiles(side, k)), k))
        reach = ranked(first, k).groupBy("target_id").agg(F.when(F.count("*") >= k, F.max("distance")).alias("_far"))
        reach = side.join(reach, "target_id", "left").withColumn("_reach", F.least(F.coalesce(F.col("_far") * F.col("_far"), F.lit(float("inf"))), "_limit")).drop("_far", "_limit")
        more = self.looked_through(stored(self.tiles(reach, k, "_reach")), k)
        return ranked(first.unionByName(more), k)

    def query(self, targets: DataFrame, search: Search) -> DataFrame:
        """target_id, rank, ref_id, distance, scale for the methods kdtree and combined."""
        if search.method == "brute" or search.prior:
            raise WrongFormat("the index knows distances by fluxes alone")
        if search.method == "kdtree":
            return self.nearest(targets, search.k).select("target_id", "rank", "ref_id", "distance", F.lit(1.0).alias("scale"))
        near = self.nearest(targets, search.batch).select("target_id", "ref_id", *(F.col("values")[2 * i + j].alias(f"n_{x}_{b}") for i, b in enumerate(self.bands) for j, x in enumerate("fe")))
        pairs = near.join(_side(targets, "target_id", self.bands), "target_id").withColumn("distance", DISTANCES[search.distance](self.bands)).withColumn("scale", F.lit(1.0))
        return ranked(pairs, search.k).select("target_id", "rank", "ref_id", "distance", "scale")


def by_index(targets: DataFrame, refs: DataFrame, bands: list[str], search: Search) -> DataFrame:
    """As KdIndex.query, by an index that is built for it."""
    return KdIndex.fit(refs, bands, folder(refs.sparkSession), search.leaf_rows).query(targets, search)


def pairs_compared(index: KdIndex, targets: DataFrame, k: int) -> int:
    """How many pairs a query compares in all."""
    side = _side(targets, "target_id", index.bands)
    first = stored(index.tiles(side, k))
    reach = ranked(index.looked_through(first, k), k).groupBy("target_id").agg(F.max("distance").alias("_far"))
    more = index.tiles(side.join(reach, "target_id").withColumn("_reach", F.col("_far") * F.col("_far")).drop("_far"), k, "_reach")
    held = index.leaves().select("_leaf", "_block", F.size("ids").alias("n"))
    return first.unionByName(more).join(held, ["_leaf", "_block"]).agg(F.sum(F.size("tids").cast("long") * F.col("n"))).first()[0]
