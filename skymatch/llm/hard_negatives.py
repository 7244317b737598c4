"""Hard negatives of anchor vectors: rows of another label that score just below a positive, found exactly after early discards.

A score is the inner product of two integer vectors. Vectors are turned by an orthogonal matrix whose leading directions hold most of their energy (the eigenvectors of
the sum of x xᵀ over all rows), and products are accumulated over the leading components. What the remaining components can add is at most the product of the two
residual norms; a slack in proportion to the two norms covers all rounding. A pair goes as soon as these bounds rule it out; those left are scored by integer products, so results don't hang on the rotation.

Anchors come in chunks of at most CHUNK bytes, the only data that is sent to all tasks; each task holds its rows, batch by batch, against a chunk's tiles. For each chunk there are
four looks: at a sixteenth of the rows, which gives each anchor a floor that a row must reach, then at all rows, first for positives, then for negatives. With the floors a task returns about
as many rows as belong to its share, however many tasks there are. Work grows as anchors times rows; memory and what passes through the driver at once are bounded by a chunk.

Rows take part if label and vector aren't null, all components are finite, and the squared norm is below 2^62, so that every score is a long. Shorter vectors count as padded with
zeros. Rows that share an id are rows of their own, null ids included, which come last among equal scores and are never anchors of the query. Equal rows score alike and go by id, then in any fixed order. Empty tables, and tables without anchors, give empty
results. Other columns are ignored, so their names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch_dir, stored

#: Bytes of anchors that are sent to the tasks at once.
CHUNK = 1 << 25
#: Rows of a batch, and anchors of a tile: their product is the size of a task's largest array.
ROWS, TILE = 4096, 1024
#: Pairs that are gathered at once.
PAIRS = 1 << 17
#: One of so many rows is in the first look.
SAMPLE = 16
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


@dataclass(frozen=True)
class Mining:
    """positives of an anchor, negatives of a positive, and the percentages of a positive's score that a negative's must lie between."""

    positives: int = 5
    negatives: int = 3
    low: int = 50
    high: int = 95


def scaled(vector: Column, factor: int = 256) -> Column:
    """floor(factor * x) of each component, null where a vector can't take part."""
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    norm = F.aggregate(vector, F.lit(0.0), lambda s, x: s + F.pow(F.floor(x.cast("double") * factor).cast("double"), F.lit(2.0)))
    return F.when(whole, F.when(norm < 2.0**62, F.transform(vector, lambda x: F.floor(x.cast("double") * factor).cast("long"))))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a column of lists, padded with zeros."""
    flat, at = column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
    out = np.zeros((len(column), width), np.int64)
    rows = np.repeat(np.arange(len(column)), np.diff(at))
    out[rows, np.arange(len(flat)) - at[rows]] = flat
    return out


def fixed(column: pa.Array, dtype: str, width: int) -> np.ndarray:
    """Rows of a column of equally long binary values."""
    return np.array([np.frombuffer(x, dtype) for x in column.to_pylist()], dtype).reshape(len(column), width)


def directions(rows: DataFrame, width: int) -> np.ndarray:
    """Orthogonal, by falling energy of all rows: width² numbers come to the driver, summed by tasks and then by line."""

    def energy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for b in batches:
            x = matrix(b.column(0), width).astype(float)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array([t.tobytes() for t in total])], ["line", "sums"])

    def summed(key: tuple, lines: pa.Table) -> pa.Table:
        return pa.table({"line": [key[0].as_py()], "sums": [sum(np.frombuffer(x) for x in lines["sums"].to_pylist()).tobytes()]}, schema=pa.schema([("line", pa.int32()), ("sums", pa.binary())]))

    total = np.zeros((width, width))
    for r in rows.select("v").mapInArrow(energy, "line int, sums binary").groupBy("line").applyInArrow(summed, "line int, sums binary").collect():
        total[r["line"]] = np.frombuffer(r["sums"])
    return np.ascontiguousarray(np.linalg.eigh((total + total.T) / 2)[1][:, ::-1])


def steps(width: int) -> list[int]:
    """How many leading components the products have had when pairs are judged."""
    return sorted({max(1, width // 4), max(1, width // 2), width})


def turned(rows: DataFrame, width: int) -> DataFrame:
    """uid, id, label, anchor, and as bytes v (int32), r (its turned components, float32) and bounds (float32: what is left after each of steps, then the norm with the slack)."""
    turn, at = directions(rows, width), steps(width)
    # float32 sums of `width` products, the rounding of r and of sums of bounds: each below 2^-23 of the product of the norms
    slack = np.sqrt((width + 32) * 2.0**-23)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = matrix(b.column(4), width)
            r = v @ turn
            square = np.concatenate([np.cumsum((r * r)[:, ::-1], 1)[:, ::-1], np.zeros((len(r), 1))], 1)
            bounds = np.concatenate([np.sqrt(square[:, at]), slack * np.sqrt(square[:, :1])], 1) * (1 + 2.0**-20)
            arrays = ([y.tobytes() for y in z] for z in (v.astype("<i4"), r.astype("<f4"), bounds.astype("<f4")))
            yield pa.RecordBatch.from_arrays([*b.columns[:4], *(pa.array(x, pa.binary()) for x in arrays)], ["uid", "id", "label", "anchor", "v", "r", "bounds"])

    return rows.select("uid", "id", "label", "anchor", "v").mapInArrow(run, "uid long, id long, label long, anchor boolean, v binary, r binary, bounds binary")


class Rows:
    """Some rows as arrays."""

    def __init__(self, b: pa.RecordBatch | pa.Table, width: int):
        column = {n: b[n].combine_chunks() if isinstance(b[n], pa.ChunkedArray) else b[n] for n in b.schema.names}
        self.uid, self.label = (column[n].to_numpy(zero_copy_only=False) for n in ("uid", "label"))
        self.known = column["id"].is_valid().to_numpy(zero_copy_only=False)
        self.id = column["id"].fill_null(2**63 - 1).to_numpy(zero_copy_only=False)
        self.v, self.r, self.bounds = fixed(column["v"], "<i4", width), fixed(column["r"], "<f4", width), fixed(column["bounds"], "<f4", len(steps(width)) + 1)


def below(x: np.ndarray) -> np.ndarray:
    """float32 values that aren't above x."""
    return np.nextafter(np.asarray(x, np.float64).astype(np.float32), np.float32(-np.inf))


def above(x: np.ndarray) -> np.ndarray:
    return np.nextafter(np.asarray(x, np.float64).astype(np.float32), np.float32(np.inf))


def survivors(a: Rows, i: np.ndarray, b: Rows, j: np.ndarray, floor: np.ndarray, ceiling: np.ndarray, best: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (row, anchor) of rows i and anchors j whose score may lie within floor and ceiling of the anchor, and their exact scores.

    With best, only pairs that may be among an anchor's `best` highest: as many rows as that surely score what the floor then is.
    """
    width = a.r.shape[1]
    r, q, e, g = a.r[i], b.r[j], a.bounds[i], b.bounds[j]
    low, high = below(floor), above(ceiling)
    score, done, pairs = None, 0, None
    for k, upto in enumerate(steps(width)):
        if pairs is None:
            part = r[:, done:upto] @ q[:, done:upto].T
            score = part if score is None else score + part
            rest = e[:, [k, -1]] @ g[:, [k, -1]].T
            if best and len(i) > best:
                low = np.maximum(low, below(np.partition(score - rest, len(i) - best, axis=0)[len(i) - best]))
            alive = (score + rest >= low) & (score - rest <= high)
            if upto == width or np.count_nonzero(alive) < alive.size // 4:
                pairs = np.nonzero(alive)
                score = score[pairs]
        else:
            x, y = pairs
            alive = np.zeros(len(x), bool)
            for s in range(0, len(x), PAIRS):
                t = slice(s, s + PAIRS)
                score[t] += np.einsum("ij,ij->i", r[x[t], done:upto], q[y[t], done:upto])
                rest = e[x[t], k] * g[y[t], k] + e[x[t], -1] * g[y[t], -1]
                alive[t] = (score[t] + rest >= low[y[t]]) & (score[t] - rest <= high[y[t]])
            pairs, score = (x[alive], y[alive]), score[alive]
        done = upto
    x, y = i[pairs[0]], j[pairs[1]]
    exact = np.zeros(len(x), np.int64)
    for s in range(0, len(x), PAIRS):
        exact[s : s + PAIRS] = np.einsum("ij,ij->i", a.v[x[s : s + PAIRS]].astype(np.int64), b.v[y[s : s + PAIRS]].astype(np.int64))
    return x, y, exact


class Best:
    """The `most` highest scores of each slot so far: (slot, score, id, known, uid), ties to the smaller id."""

    def __init__(self, slots: int, most: int, floor: np.ndarray):
        self.most, self.floor = most, floor.copy()
        self.rows = [np.zeros(0, np.int64)] * 3 + [np.zeros(0, bool), np.zeros(0, np.int64)]

    def add(self, *new: np.ndarray) -> None:
        if not len(new[0]):
            return
        slot, score, id_, known, uid = (np.concatenate(x) for x in zip(self.rows, new))
        order = np.lexsort((uid, id_, ~known, -score, slot))
        slot = slot[order]
        rank = np.arange(len(slot)) - np.searchsorted(slot, slot)
        order, full = order[rank < self.most], rank == self.most - 1
        self.rows = [x[order] for x in (np.concatenate([self.rows[0], new[0]]), score, id_, known, uid)]
        ends = np.concatenate([self.rows[0][:0], slot[full]])
        score = self.rows[1]
        at = np.searchsorted(self.rows[0], ends, side="right") - 1
        self.floor[ends] = np.maximum(self.floor[ends], score[at])

    def batches(self) -> Iterator[pa.RecordBatch]:
        slot, score, id_, known, uid = self.rows
        for s in range(0, len(slot), 10_000):
            t = slice(s, s + 10_000)
            yield pa.RecordBatch.from_arrays([pa.array(slot[t]), pa.array(score[t]), pa.array(id_[t], mask=~known[t]), pa.array(uid[t])], ["slot", "score", "id", "uid"])


def classes(label: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(label, kind="stable")
    cuts = np.flatnonzero(np.diff(label[order])) + 1
    for part in np.split(order, cuts):
        if len(part):
            yield label[part[0]], part


def look(rows: DataFrame, sent, width: int, most: int) -> DataFrame:
    """slot, rank, score, id, uid: the best rows of each slot. sent: a broadcast (anchors, floors by slot, ceilings by slot or None).

    Without ceilings a slot is an anchor and rows of its label count. With them, each anchor has as many slots as floors are for it, and rows of other labels count that lie within a slot's limits.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, floor, ceiling = sent.value
        n = len(anchors.uid)
        each = len(floor) // n
        best = Best(len(floor), most, floor)
        tiles = [(c, tile[s : s + TILE]) for c, tile in classes(anchors.label) for s in range(0, len(tile), TILE)]
        for big in batches:
            for at in range(0, big.num_rows, ROWS):
                b = Rows(big.slice(at, ROWS), width)
                for c, j in tiles:
                    i = np.flatnonzero((b.label == c) if ceiling is None else (b.label != c))
                    if not len(i):
                        continue
                    if ceiling is None:
                        x, y, score = survivors(b, i, anchors, j, best.floor[j], np.full(len(j), np.inf), most + 1)  # one of them may be the anchor itself
                        keep = (b.uid[x] != anchors.uid[y]) & (score >= best.floor[y])
                        x, y, score = x[keep], y[keep], score[keep]
                        best.add(y, score, b.id[x], b.known[x], b.uid[x])
                        continue
                    slots = j[:, None] * each + np.arange(each)
                    x, y, score = survivors(b, i, anchors, j, best.floor[slots].min(1), ceiling[slots].max(1))
                    for k in range(each):
                        slot = y * each + k
                        keep = (score >= best.floor[slot]) & (score <= ceiling[slot])
                        best.add(slot[keep], score[keep], b.id[x[keep]], b.known[x[keep]], b.uid[x[keep]])
        yield from best.batches()

    found = rows.select("uid", "id", "label", "v", "r", "bounds").mapInArrow(run, "slot long, score long, id long, uid long")
    order = Window.partitionBy("slot").orderBy(F.desc("score"), F.col("id").asc_nulls_last(), "uid")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select("slot", "rank", "score", "id", "uid")


def share(score: np.ndarray, percent: int, up: bool) -> np.ndarray:
    """percent of whole scores, rounded up or down, without overflow."""
    whole, rest = np.divmod(score, 100)
    return whole * percent + (-(-percent * rest // 100) if up else percent * rest // 100)


def mine(vectors: DataFrame, anchor: Column, how: Mining = Mining(), id: str = "vec_id", vector: str = "v", label: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of all anchors, which the condition `anchor` picks. vector: an array of whole numbers, as from scaled."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), F.col(vector).alias("v"))
    rows = rows.where(F.col("label").isNotNull() & F.col("v").isNotNull())
    facts = rows.agg(F.max(F.size("v")).alias("width"), F.count_if("anchor").alias("anchors")).first()
    if not facts["anchors"]:
        return spark.createDataFrame([], RESULT)
    width = max(1, facts["width"])
    rows = stored(turned(rows.withColumn("uid", F.monotonically_increasing_id()), width))
    chunks = -(-facts["anchors"] * (8 * width + 64) // CHUNK)
    anchors = stored(rows.where("anchor").withColumn("chunk", F.pmod(F.xxhash64("uid"), F.lit(chunks))))
    some = rows.where(F.pmod(F.xxhash64("uid", F.lit(7)), F.lit(SAMPLE)) == 0)
    path = scratch_dir(spark)
    spark.createDataFrame([], RESULT).write.parquet(path)
    for c in range(chunks):
        here = Rows(anchors.where(F.col("chunk") == c).toArrow(), width)
        n = len(here.uid)
        if not n:
            continue
        lowest = np.iinfo(np.int64).min
        floor = np.full(n, lowest)

        def full(found: DataFrame, most: int, floor: np.ndarray) -> np.ndarray:
            """Floors of the slots of which `most` rows were found."""
            out = floor.copy()
            for r in found.where(F.col("rank") == most).select("slot", "score").collect():  # at most the slots of a chunk
                out[r["slot"]] = r["score"]
            return out

        def seen(rows: DataFrame, floor: np.ndarray, ceiling: np.ndarray | None, most: int) -> DataFrame:
            return look(rows, spark.sparkContext.broadcast((here, floor, ceiling)), width, most)

        floor = full(seen(some, floor, None, how.positives), how.positives, floor)
        positives = seen(rows, floor, None, how.positives).toPandas()  # at most how.positives rows an anchor of the chunk
        if not len(positives):
            continue
        slot = positives["slot"].to_numpy() * how.positives + positives["rank"].to_numpy() - 1
        floor, ceiling = np.full(n * how.positives, np.iinfo(np.int64).max), np.full(n * how.positives, lowest)  # slots without a positive take nothing
        score = positives["score"].to_numpy()
        floor[slot], ceiling[slot] = share(score, how.low, True), share(score, how.high, False)
        floor = full(seen(some, floor, ceiling, how.negatives), how.negatives, floor)
        named = pd.DataFrame({"slot": slot, "anchor_id": pd.array(here.id[positives["slot"]], "Int64"), "positive_id": positives["id"].astype("Int64"), "positive_score": score})
        named.loc[~here.known[positives["slot"]], "anchor_id"] = pd.NA
        names = spark.createDataFrame(pa.Table.from_pandas(named, preserve_index=False))
        found = seen(rows, floor, ceiling, how.negatives).select("slot", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
        found.join(names, "slot").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").write.mode("append").parquet(path)
    return spark.read.schema(RESULT).parquet(path)
