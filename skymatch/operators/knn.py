"""Nearest neighbours: for each target the k most similar reference objects.

`neighbors` gives target_id, rank, ref_id, distance and scale in long form; ties go to the smaller ref_id. Three plans give the same rows:

* `join`: targets beside the reference in a nested loop, ranked by a window. Spark ranks within partitions before it shuffles, so k rows a target and
  partition move at most. No Python, but for free scales.
* `blocks`: the reference is packed into blocks of bounded size, targets pass by them in Arrow batches, and each block returns its k best a target. With one block this is a
  broadcast of a checked size, without any shuffle; with more, the blocks' bests are ranked by the same window. It also serves streams.
* `index` (KD-tree and Combined only): a kd-tree, see kdindex. Targets meet only leaves that can hold a neighbour.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, StructField, StructType

from ..functions.photometry import DISTANCES, METRICS, Metric
from ..sources.scratch import stored
from .leaves import Leaves, best, distances
from .scaling import Prior, best_scales, beyond_reach, chi2_of_pairs, may_come_near, solved, with_units, within_reach

#: Bytes of fluxes and errors in a block of reference objects.
BLOCK_BYTES = 32 << 20
#: Pairs from which packed blocks pay.
MANY_PAIRS = 20_000_000
#: Objects from which a block is searched by its leaves, and targets that a task takes together (fewer, if each has many neighbours).
LARGE_BLOCK, TILE = 1024, 1 << 17
#: Objects of the samples by which a join limits the pairs whose scales it solves, and bands by which it does so.
FIRST_LOOK, LOOK, TESTED = 256, 4096, 6


@dataclass(frozen=True)
class Search:
    """method: brute, kdtree (Euclidean, errors ignored, exact), or combined (the k best by distance among the `batch` nearest by fluxes). leaf_rows: objects in a leaf of the index, about. prior: lets a reference object's flux scale freely (brute only)."""

    k: int
    distance: str = "chi2"
    method: str = "brute"
    batch: int = 2000
    prior: Prior | None = None
    max_iter: int = 20
    rtol: float = 1e-8
    leaf_rows: int = 2048
    custom: Metric | None = field(default=None, repr=False)  # what `distance` names, if a user has registered it; it goes with the search to the tasks

    def __post_init__(self) -> None:
        if self.custom is None:
            object.__setattr__(self, "custom", METRICS.get(self.distance))
        if self.method not in ("brute", "kdtree", "combined") or self.distance not in DISTANCES and self.custom is None:
            raise ValueError(f"{self.method} with {self.distance} isn't known")
        if self.prior and self.method != "brute":
            raise ValueError("a free scale needs brute force")
        if self.method == "combined" and self.batch < self.k:
            raise ValueError("the batch must hold k neighbours")
        if self.k < 1:
            raise ValueError("k must be positive")

    @property
    def metric(self) -> str:
        return "euclidean" if self.method == "kdtree" else self.distance


def ranked(pairs: DataFrame, k: int, by: str = "distance", rank: str = "rank") -> DataFrame:
    order = Window.partitionBy("target_id").orderBy(by, "ref_id")
    return pairs.withColumn(rank, F.row_number().over(order)).where(F.col(rank) <= k)


def _side(df: DataFrame, key: str, bands: list[str], prefix: str = "") -> DataFrame:
    return df.select(key, *(F.col(f"{x}_{b}").cast("double").alias(f"{prefix}{x}_{b}") for b in bands for x in ("f", "e")))


def by_join(targets: DataFrame, refs: DataFrame, bands: list[str], search: Search) -> DataFrame:
    if search.prior and not search.prior.fixed:
        return _scaled_join(targets, refs, bands, search)
    pairs = _side(targets, "target_id", bands).crossJoin(_side(refs, "ref_id", bands, "n_")).withColumn("scale", F.lit(float(search.prior.low) if search.prior else 1.0))
    factor = F.col("scale") if search.prior else None
    if search.method == "combined":
        pairs = ranked(pairs.withColumn("_near", DISTANCES["euclidean"](bands)), search.batch, "_near", "_r")
    pairs = pairs.withColumn("distance", DISTANCES[search.metric](bands, scale=factor))
    return ranked(pairs.select("target_id", "ref_id", "distance", "scale"), search.k).select("target_id", "rank", "ref_id", "distance", "scale")


def _scaled_join(targets: DataFrame, refs: DataFrame, bands: list[str], search: Search) -> DataFrame:
    """by_join for free scales, which are solved for Arrow batches of pairs, as folds in the JVM aren't compiled."""
    names = [[f"{x}_{b}" for b in bands] for x in ("n_f", "n_e", "f", "e")]
    tasks = 2 * targets.sparkSession.sparkContext.defaultParallelism
    near, all_ = _side(targets, "target_id", bands), _side(refs, "ref_id", bands, "n_")
    if search.metric == "chi2" and not search.custom:
        return _limited_join(near, all_, bands, search, tasks)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                values = [[b.column(c).to_numpy(zero_copy_only=False).astype(float, copy=False) for c in side] for side in names]
                yield b.append_column("scale", pa.array(solved(*values, search.prior, search.max_iter, search.rtol)))

    pairs = near.repartition(tasks, "target_id").crossJoin(all_)
    out = pairs.mapInArrow(solve, StructType([*pairs.schema.fields, StructField("scale", DoubleType())])).withColumn("distance", DISTANCES[search.metric](bands, scale=F.col("scale")))
    return ranked(out.select("target_id", "ref_id", "distance", "scale"), search.k).select("target_id", "rank", "ref_id", "distance", "scale")


def _packed(df: DataFrame, bands: list[str], prefix: str = "") -> DataFrame:
    """Fluxes and errors also as the bytes of one array: a join that writes many columns is too long to be compiled, and lists are slow to send."""
    names = [f"{prefix}{x}_{b}" for x in "fe" for b in bands]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = np.column_stack([b.column(c).to_numpy(zero_copy_only=False) for c in names]).astype(float)
            yield b.append_column(f"{prefix}values", pa.array([r.tobytes() for r in rows], pa.binary()))

    return stored(df.mapInArrow(pack, StructType([*df.schema.fields, StructField(f"{prefix}values", BinaryType())])))


def _near_pairs(near: DataFrame, some: DataFrame, bands: list[str], tasks: int) -> DataFrame:
    """Pairs of packed sides of which some scale may bring the object as near as _limit. Units are made before targets are dealt, so that the join's loop is short."""
    tested = bands[:TESTED]
    side = lambda df, prefix: with_units(df, tested, prefix).drop(*(f"{prefix}{x}_{b}" for x in "fe" for b in bands))
    near = side(near, "").withColumn("_wide", F.col("_limit") * (1 + 1e-6) + 1e-9)  # roundings lose nothing
    pairs = near.repartition(tasks, "target_id").join(side(some, "n_"), may_come_near(tested, F.col("_wide")))
    return pairs.select("target_id", "ref_id", "_limit", "n_values", "values")


def _limited_join(near: DataFrame, all_: DataFrame, bands: list[str], search: Search, tasks: int) -> DataFrame:
    """Under chi2 the k-th neighbours in bounded samples of the reference limit how far a target's can be, and only pairs that some scale may bring as near are joined and have theirs solved."""
    width, none = pa.binary(16 * len(bands)), F.lit(float("inf"))
    schema = StructType([near.schema["target_id"], all_.schema["ref_id"], StructField("distance", DoubleType()), StructField("scale", DoubleType())])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            values = [x for c in ("n_values", "values") for x in np.split(np.ascontiguousarray(np.frombuffer(b.column(c).cast(width).buffers()[1]).reshape(b.num_rows, -1).T), 2)]
            limit, at = b.column("_limit").to_numpy(), np.arange(b.num_rows)
            if (limit < np.inf).any():
                for reach in (lambda *x: np.flatnonzero(~beyond_reach(*x)), lambda *x: within_reach(*x, search.prior)):
                    kept = reach(*values, limit)
                    values, limit, at = [[x[kept] for x in side] for side in values], limit[kept], at[kept]
            scale = solved(*values, search.prior, search.max_iter, search.rtol)
            distance = chi2_of_pairs(*values, scale)
            kept = np.flatnonzero(~(limit < np.inf) | (distance <= limit * (1 + 1e-6) + 1e-9))
            own = b.select(["target_id", "ref_id"]).take(pa.array(at[kept]))
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(distance[kept]), pa.array(scale[kept])], schema.names)

    def bests(near: DataFrame, some: DataFrame) -> DataFrame:
        return ranked(_near_pairs(near, some, bands, tasks).mapInArrow(solve, schema), search.k).select("target_id", "rank", "ref_id", "distance", "scale")

    copies = Window.partitionBy(*all_.columns[1:]).orderBy("ref_id")  # of equal objects none but the first k can be neighbours
    near, all_ = _packed(near, bands), _packed(all_.withColumn("_copy", F.row_number().over(copies)).where(F.col("_copy") <= search.k).drop("_copy"), bands, "n_")
    n, limited = all_.count(), near.withColumn("_limit", none)
    for size in (min(FIRST_LOOK, LOOK), LOOK):
        if 2 * size < n:
            sample = all_.withColumn("_o", F.xxhash64("ref_id")).orderBy("_o", "ref_id").limit(size).drop("_o")
            limits = bests(limited, F.broadcast(sample)).where((F.col("rank") == search.k) & (F.col("distance") < float("inf")))
            limits = stored(limits.select(F.col("target_id").alias("_id"), F.col("distance").alias("_limit")))
            limited = near.join(limits, F.col("target_id") == F.col("_id"), "left").drop("_id").withColumn("_limit", F.coalesce("_limit", none))
    row = 8 * (4 + 2 * len(bands) + 2 * min(TESTED, len(bands)))
    return bests(limited, F.broadcast(all_) if n * row <= BLOCK_BYTES else all_)


def leaves_fit(ids: np.ndarray, r: np.ndarray, search: Search) -> bool:
    return (search.method == "combined" or search.metric in ("euclidean", "chi2")) and not search.prior and len(ids) >= LARGE_BLOCK and Leaves.fit_for(r)


def leaves_of(ids: np.ndarray, r: np.ndarray, search: Search) -> Leaves | None:
    """A block's leaves, where it is large enough and bounds hold for the search: fixed scales, and a distance that is known here."""
    return Leaves(r, ids, "euclidean" if search.method == "combined" else search.metric) if leaves_fit(ids, r, search) else None


def best_scaled(t: np.ndarray, r: np.ndarray, ids: np.ndarray, search: Search) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """best_of_block for free scales under chi2: some targets at a time, the k-th best so far limits which further objects are solved."""
    f, e = ([np.ascontiguousarray(r[:, b, j]) for b in range(r.shape[1])] for j in range(2))
    k = min(search.k, len(ids))
    out = np.empty((len(t), k), np.int64), np.empty((len(t), k)), np.empty((len(t), k))
    cuts = [0, *(min(len(ids), c) for c in (512, 4096)), *range(4096 + 16_384, len(ids), 16_384), len(ids)]
    for first in range(0, len(t), 32):
        some = range(first, min(len(t), first + 32))
        held = {i: (np.zeros(0, np.int64), np.zeros(0), np.zeros(0)) for i in some}
        for a, b in zip(cuts, cuts[1:]):
            new = []
            for i in some:
                limit = held[i][1][-1] if len(held[i][1]) == search.k else np.inf
                new.append(np.arange(a, b) if not limit < np.inf else a + within_reach([x[a:b] for x in f], [x[a:b] for x in e], t[i, :, 0], t[i, :, 1], limit, search.prior))
            at, own = np.concatenate(new), np.repeat(np.arange(first, some.stop), [len(n) for n in new])
            if not len(at):
                continue
            scales = solved([x[at] for x in f], [x[at] for x in e], *([t[own, x, j] for x in range(t.shape[1])] for j in range(2)), search.prior, search.max_iter, search.rtol)
            ends = np.cumsum([len(n) for n in new])
            for i, n, s in zip(some, new, np.split(scales, ends[:-1])):
                if len(n):
                    all_ = [np.concatenate(x) for x in zip(held[i], (n, distances(t[i : i + 1], r[n], "chi2", s[None])[0], s))]
                    order = np.lexsort((ids[all_[0]], all_[1]))[:k]
                    held[i] = tuple(x[order] for x in all_)
        for i in some:
            out[0][i], out[1][i], out[2][i] = ids[held[i][0]], *held[i][1:]
    return out


def best_of_block(t: np.ndarray, r: np.ndarray, ids: np.ndarray, search: Search, leaves: Leaves | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, distances and scales [targets, k]."""
    if leaves and search.method != "combined":
        at, d = leaves.nearest(t, search.k)
        return ids[at], d, np.ones(at.shape)
    if search.method == "combined":
        near = leaves.nearest(t, search.batch)[0] if leaves else best(distances(t, r, "euclidean"), ids, search.batch)
        out = [best_of_block(t[i : i + 1], r[n], ids[n], Search(search.k, search.distance, custom=search.custom)) for i, n in enumerate(near)]
        return tuple(np.concatenate([o[j] for o in out]) for j in range(3))
    if search.prior and not search.prior.fixed and search.metric == "chi2" and not (search.custom and search.method == "brute"):
        return best_scaled(t, r, ids, search)
    scale = best_scales(t, r, search.prior, search.max_iter, search.rtol) if search.prior else None
    d = search.custom.arrays(t, r, scale) if search.custom and search.method == "brute" else distances(t, r, search.metric, scale)
    at = best(d, ids, search.k)
    rows = np.arange(len(t))[:, None]
    return ids[at], d[rows, at], scale[rows, at] if scale is not None else np.ones(at.shape)


def _search_batch(targets: list, objects: tuple[np.ndarray, np.ndarray], search: Search, leaves: Leaves | None = None) -> pa.RecordBatch:
    ids, r = objects
    tid, t = targets
    leaves = leaves if leaves and leaves.fit_for(t) else None
    step = len(tid) if leaves or search.prior and not search.prior.fixed and search.metric == "chi2" else max(1, min(len(tid) or 1, 200_000 // max(1, len(ids))))  # a block stays in the cache
    parts = [best_of_block(t[i : i + step], r, ids, search, leaves) for i in range(0, len(tid), max(1, step))] if len(ids) else []
    if not parts:
        found = [np.empty((0, 1))] * 3
        tid = tid[:0]
    else:
        found = [np.concatenate([p[j] for p in parts]) for j in range(3)]
    k = found[0].shape[1]
    return pa.RecordBatch.from_arrays(
        [pa.array(np.repeat(tid, k)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(tid))), pa.array(found[0].ravel().astype(np.int64)), pa.array(found[1].ravel().astype(float)), pa.array(found[2].ravel().astype(float))],
        ["target_id", "rank", "ref_id", "distance", "scale"],
    )


RESULT = "target_id long, rank int, ref_id long, distance double, scale double"


def tile_rows(search: Search) -> int:
    return max(1024, min(TILE, 4_000_000 // max(search.k, search.batch if search.method == "combined" else 0)))


def together(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches as fewer ones of so many rows or a little more, none of them empty."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(h.num_rows for h in held) >= rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []
    if any(h.num_rows for h in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def beside_arrays(targets: DataFrame, ids: np.ndarray, values: np.ndarray, bands: list[str], search: Search) -> DataFrame:
    """Targets, also of a stream, against a reference that is held in arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaves = None
        for b in together(batches, tile_rows(search)):
            leaves = leaves or leaves_of(ids, values, search)
            t = np.column_stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(1, b.num_columns)]).astype(float).reshape(b.num_rows, len(bands), 2)
            yield _search_batch([b.column(0).to_numpy(zero_copy_only=False), t], (ids, values), search, leaves)

    return _side(targets, "target_id", bands).mapInArrow(run, RESULT)


def as_arrays(refs: DataFrame, bands: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """ids, values[objects, bands, 2] of a reference whose size has been checked."""
    pdf = _side(refs, "ref_id", bands).orderBy("ref_id").toPandas()
    return pdf["ref_id"].to_numpy(np.int64), pdf.drop(columns="ref_id").to_numpy(float).reshape(len(pdf), len(bands), 2)


def dealt(targets: DataFrame, values: np.ndarray, bands: list[str], partitions: int) -> DataFrame:
    """Targets in tasks by where they lie, near ones one after another, by cuts of a reference's values[objects, bands, 2]. A crowd of equal targets is parted by a hash."""
    from .kdindex import SAMPLE, Tree

    tree = Tree.split(values[:: -(-len(values) // SAMPLE), :, 0], 8)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                f = np.column_stack([b.column(1 + 2 * i).to_numpy(zero_copy_only=False) for i in range(len(bands))]).astype(float)
                yield b.append_column("_cell", pa.array(tree.leaf(f), pa.int64()))

    side = _side(targets, "target_id", bands)
    schema = "target_id long, " + ", ".join(f"{c} double" for c in side.columns[1:]) + ", _cell long"
    out = side.withColumn("target_id", F.col("target_id").cast("long")).mapInArrow(cells, schema).withColumn("_hash", F.xxhash64("target_id"))
    return out.repartitionByRange(partitions, "_cell", "_hash").sortWithinPartitions("_cell").drop("_cell", "_hash")


def by_blocks(targets: DataFrame, refs: DataFrame, bands: list[str], search: Search, block_bytes: int = BLOCK_BYTES, partitions: int | None = None) -> DataFrame:
    """partitions: how many tasks a reference of one block has at least, as a few small files give few."""
    size = 16 * len(bands)
    odd = [~F.coalesce(F.abs(F.col(f"f_{b}")) < float("inf"), F.lit(False)) | F.coalesce(F.isnan(f"e_{b}"), F.lit(True)) for b in bands]
    n, bad = _side(refs, "ref_id", bands).agg(F.count("*"), F.count_if(reduce(or_, odd))).first()
    tasks = 2 * targets.sparkSession.sparkContext.defaultParallelism
    if n * size <= block_bytes:  # proven small: sent to all executors
        ids, values = as_arrays(refs, bands)
        if leaves_fit(ids, values, search):
            targets = dealt(targets, values, bands, partitions or tasks)
        elif partitions or search.prior:
            targets = targets.repartition(partitions or tasks, "target_id")
        return beside_arrays(targets, ids, values, bands, search)
    if search.method == "combined":  # the batch nearest of all blocks are only known together
        return _second_look(by_blocks(targets, refs, bands, Search(search.batch, "euclidean"), block_bytes), targets, refs, bands, search)
    if not search.prior and search.metric in ("euclidean", "chi2") and not bad:
        return _by_cells(targets, refs, bands, search, n, block_bytes, tasks)
    blocks = -(-n * size // block_bytes)
    values = F.array(*(F.col(f"{x}_{b}") for b in bands for x in ("f", "e")))
    packed = _side(refs, "ref_id", bands).groupBy(F.pmod(F.xxhash64("ref_id"), F.lit(blocks)).alias("_block")).agg(F.collect_list("ref_id").alias("ids"), F.flatten(F.collect_list(values)).alias("values"))
    tile = max(1024, block_bytes // size // 8)
    some = _side(targets, "target_id", bands).groupBy(F.pmod(F.xxhash64("target_id"), F.lit(max(targets.count() // tile, -(-tasks // blocks)))).alias("_tile")).agg(F.collect_list("target_id").alias("tids"), F.flatten(F.collect_list(values)).alias("tvalues"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                tid, t, ids, r = (b.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("tids", "tvalues", "ids", "values"))
                t, r = t.reshape(len(tid), len(bands), 2), r.reshape(len(ids), len(bands), 2)
                leaves = leaves_of(ids, r, search)
                for at in range(0, len(tid), tile_rows(search)):
                    yield _search_batch([tid[at : at + tile_rows(search)], t[at : at + tile_rows(search)]], (ids, r), search, leaves)

    bests = some.crossJoin(packed).select("tids", "tvalues", "ids", "values").mapInArrow(run, RESULT)
    return ranked(bests.drop("rank"), search.k).select("target_id", "rank", "ref_id", "distance", "scale")


def _by_cells(targets: DataFrame, refs: DataFrame, bands: list[str], search: Search, n: int, block_bytes: int, tasks: int) -> DataFrame:
    """As by_blocks, for a reference of many blocks that bounds hold for: blocks are cells of a kd-tree (a crowded one is several, by hashes), in the order of their leaves. The k-th neighbour in a bounded
    sample of the reference limits how far a target's can be, so that it meets only the cells that come as near."""
    from .kdindex import SAMPLE, Tree, _lists

    blocks = -(-n * 16 * len(bands) // block_bytes)
    most = block_bytes // (16 * len(bands))
    side = _side(refs, "ref_id", bands)
    columns = ", ".join(f"{c} double" for c in side.columns[1:])
    sample = side.withColumn("_o", F.xxhash64("ref_id")).orderBy("_o", "ref_id").limit(SAMPLE).drop("_o").toPandas()
    sids, svalues = sample["ref_id"].to_numpy(np.int64), sample.drop(columns="ref_id").to_numpy(float).reshape(-1, len(bands), 2)
    tree = Tree.split(svalues[..., 0], int(np.ceil(np.log2(min(4096, 4 * max(tasks, blocks))))))

    def values_of(b: pa.RecordBatch, first: int) -> np.ndarray:
        return np.column_stack([b.column(first + i).to_numpy(zero_copy_only=False) for i in range(2 * len(bands))]).astype(float).reshape(b.num_rows, len(bands), 2)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield b.append_column("_cell", pa.array(tree.leaf(values_of(b, 1)[..., 0]), pa.int64()))

    cells = stored(side.withColumn("ref_id", F.col("ref_id").cast("long")).mapInArrow(deal, f"ref_id long, {columns}, _cell long"))
    ends = [f(F.abs(F.col(c)) if c[0] == "e" else F.col(c)).alias(f"{c}_{f.__name__}") for b in bands for f, c in ((F.min, f"f_{b}"), (F.max, f"f_{b}"), (F.max, f"e_{b}"))]
    held = cells.groupBy("_cell").agg(F.count("*").alias("n"), *ends).collect()  # a row a cell
    low, high, error = (np.array([[r[f"{x}_{b}_{f}"] for b in bands] for r in held]) for x, f in (("f", "min"), ("f", "max"), ("e", "max")))
    numbers, parts = np.array([r["_cell"] for r in held]), np.array([-(-r["n"] // most) for r in held])
    cut = F.element_at(F.create_map(*(F.lit(int(x)) for r in zip(numbers, parts) for x in r)), F.col("_cell")) if (parts > 1).any() else F.lit(1)
    values = F.array(*(F.col(f"{x}_{b}") for b in bands for x in ("f", "e")))
    packed = cells.withColumn("_block", F.pmod(F.xxhash64("ref_id"), cut)).groupBy("_cell", "_block").agg(F.collect_list("ref_id").alias("ids"), F.flatten(F.collect_list(values)).alias("values"))
    several = max(tasks, blocks)

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                ids, r = (b.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("ids", "values"))
                leaves = Leaves(r.reshape(len(ids), len(bands), 2), ids, search.metric)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), b.column(1).slice(i, 1), _lists([leaves.ids], pa.int64()), _lists([leaves.values], pa.float64())], ["_cell", "_block", "ids", "values"])

    packed = packed.repartition(several, "_cell", "_block").mapInArrow(order, "_cell long, _block long, ids array<long>, values array<double>")

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = Leaves(svalues, sids, search.metric)
        for b in together(batches, tile_rows(search)):
            tid, t = b.column(0).to_numpy(zero_copy_only=False), values_of(b, 1)
            limit = np.full(len(tid), np.inf)
            if len(sids) >= search.k and near.fit_for(t):
                limit = near.nearest(t, search.k)[1][:, -1]
                limit = (limit * limit if search.metric == "euclidean" else limit) * (1 + 1e-9) + 1e-300  # roundings lose no tie
                limit[np.isnan(limit)] = np.inf
            for c in range(len(numbers)):
                far = near.gap(low[c], high[c], error[c], t[..., 0], t[..., 0], t[..., 1])
                at = np.flatnonzero(~(far > limit))
                for first in range(0, len(at), 16_384):
                    of, m = at[first : first + 16_384], int(parts[c])
                    for part in range(m):
                        yield pa.RecordBatch.from_arrays([pa.array([numbers[c]], pa.int64()), pa.array([part], pa.int64()), _lists([tid[of]], pa.int64()), _lists([t[of]], pa.float64())], ["_cell", "_block", "tids", "tvalues"])

    some = _side(targets, "target_id", bands).repartition(tasks, "target_id").mapInArrow(tiles, "_cell long, _block long, tids array<long>, tvalues array<double>").repartition(several, "_cell", "_block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                tid, t, ids, r = (b.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("tids", "tvalues", "ids", "values"))
                t, r = t.reshape(len(tid), len(bands), 2), r.reshape(len(ids), len(bands), 2)
                leaves = Leaves(r, ids, search.metric, ordered=True)
                for at in range(0, len(tid), tile_rows(search)):
                    yield _search_batch([tid[at : at + tile_rows(search)], t[at : at + tile_rows(search)]], (ids, r), search, leaves)

    bests = some.join(packed, ["_cell", "_block"]).select("tids", "tvalues", "ids", "values").mapInArrow(run, RESULT)
    return ranked(bests.drop("rank"), search.k).select("target_id", "rank", "ref_id", "distance", "scale")


def _second_look(near: DataFrame, targets: DataFrame, refs: DataFrame, bands: list[str], search: Search) -> DataFrame:
    """The k best by distance among the batch nearest by fluxes."""
    pairs = near.select("target_id", "ref_id").join(_side(targets, "target_id", bands), "target_id").join(_side(refs, "ref_id", bands, "n_"), "ref_id")
    pairs = pairs.withColumn("distance", DISTANCES[search.distance](bands)).withColumn("scale", F.lit(1.0))
    return ranked(pairs, search.k).select("target_id", "rank", "ref_id", "distance", "scale")


def by_index(targets: DataFrame, refs: DataFrame, bands: list[str], search: Search) -> DataFrame:
    from .kdindex import by_index as nearest

    if search.method == "brute":
        raise ValueError("the index knows distances by fluxes alone")
    return nearest(targets, refs, bands, search)


def pairs(targets: DataFrame, refs: DataFrame) -> int:
    """How many there are, by one job."""
    n = {r["_side"]: r["count"] for r in targets.select(F.lit(0).alias("_side")).unionByName(refs.select(F.lit(1).alias("_side"))).groupBy("_side").count().collect()}
    return n.get(0, 0) * n.get(1, 0)


#: name -> selector (targets, refs, bands, search) of target_id, rank, ref_id, distance, scale; users add their own.
PLANS: dict[str, Callable[[DataFrame, DataFrame, list[str], Search], DataFrame]] = {"join": by_join, "blocks": by_blocks, "index": by_index}


def neighbors(targets: DataFrame, refs: DataFrame, bands: list[str], search: Search, plan: str = "auto", partitions: int | None = None) -> DataFrame:
    """target_id, rank (from 1), ref_id, distance, scale. Fewer than k objects give fewer neighbours. partitions: deals targets anew first, as a few small files give few tasks."""
    if plan == "auto":
        fitted = search.prior is not None and not search.prior.fixed
        plan = "blocks" if fitted or pairs(targets, refs) >= MANY_PAIRS else "join"
        if plan == "blocks" and search.method != "brute":
            plan = "index"
    if plan not in PLANS:
        raise ValueError(f"the plan {plan!r} isn't known")
    if partitions and PLANS[plan] is by_blocks:
        return by_blocks(targets, refs, bands, search, partitions=partitions)
    return PLANS[plan](targets.repartition(partitions, "target_id") if partitions else targets, refs, bands, search)


def with_photometry(found: DataFrame, targets: DataFrame, refs: DataFrame, bands: list[str], scaled: bool = True) -> DataFrame:
    """Neighbours beside their targets' columns and their own fluxes and errors (n_f_*, n_e_*), scaled."""
    extra = [c for c in refs.columns if c != "ref_id" and c not in {f"{x}_{b}" for b in bands for x in "fe"}]
    own = refs.select("ref_id", *(F.col(f"{x}_{b}").alias(f"n_{x}_{b}") for b in bands for x in "fe"), *(F.col(c).alias(f"ref_{c}") for c in extra))
    out = found.join(own, "ref_id").join(targets, "target_id")
    if scaled:
        out = out.withColumns({f"n_{x}_{b}": F.col(f"n_{x}_{b}") * F.col("scale") for b in bands for x in "fe"})
    return out
