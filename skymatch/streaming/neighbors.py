"""Neighbours of a stream of targets against a static reference, without state: by arrays of a checked size, or, for a reference of any size, by a kept index whose leaves each micro-batch meets in an equality join."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.kdindex import KdIndex
from ..operators.knn import BLOCK_BYTES, Search, as_arrays, beside_arrays, by_blocks
from ..sources import scratch


def stream_neighbors(targets: DataFrame, refs: DataFrame, bands: list[str], search: Search) -> DataFrame:
    """A streaming DataFrame of target_id, rank, ref_id, distance, scale, for append mode."""
    if refs.count() * 16 * len(bands) > BLOCK_BYTES:
        raise ValueError("this reference is too large for a stream; use write_neighbors or write_indexed_neighbors")
    return beside_arrays(targets, *as_arrays(refs, bands), bands, search)


def write_neighbors(targets: DataFrame, refs: DataFrame, bands: list[str], search: Search, path: str, checkpoint: str):
    """Starts a query that appends neighbours to Parquet, a batch after the other, with a reference of any size."""

    def each(batch: DataFrame, number: int) -> None:
        by_blocks(batch, refs, bands, search).write.mode("overwrite").parquet(f"{path}/batch={number}")  # a batch that is repeated replaces itself

    return targets.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).start()


def write_indexed_neighbors(targets: DataFrame, index: KdIndex, search: Search, path: str, checkpoint: str, **trigger):
    """As write_neighbors (trigger: as in DataStreamWriter.trigger), for the methods kdtree and combined: a batch looks twice through leaves of a stored index, so that it reads no reference table and pairs only what bounds allow. What a batch stores on its way is deleted after it."""

    def each(batch: DataFrame, number: int) -> None:
        before = len(scratch.FOLDERS)
        index.query(scratch.stored(batch), search).write.mode("overwrite").parquet(f"{path}/batch={number}")
        scratch.release(batch.sparkSession, before)

    rows = targets.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (rows.trigger(**trigger) if trigger else rows).start()
