"""Best-fit packing of token pieces into sequences: best-two-fit on the counts of lengths.

A piece is known by its length alone while bins are planned, so the plan works on how many pieces have each length: at most `capacity` numbers,
whatever the corpus. A bin is filled greedily, the largest length that fits first. Then its smallest piece gives way to two unpacked pieces
if these fill the gap that it leaves more tightly. The bin is repeated as often as its lengths last, so each pattern uses a length up and
there are few patterns. Pieces then take the places of their length by rank; ranks come from counts by (bucket, length), so no task holds
all pieces of a length.

Nulls: a null text is empty and becomes the end token alone. Repeated rows are packed as often as they occur. Empty tables give empty results.
Other columns of the documents are ignored, so their names can't clash.
"""

from __future__ import annotations

import logging
import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

END = 0


class Encoder:
    """Token ids of a vocabulary file. The same vocabulary as ranks, if given, encodes faster; texts with a special token's string, and any that it fails on, go the plain way."""

    def __init__(self, tokenizer_path: str, ranks_path: str | None = None, pattern: str | None = None):
        from tokenizers import Tokenizer

        self.plain = Tokenizer.from_file(tokenizer_path)
        self.special = [t.content for t in self.plain.get_added_tokens_decoder().values()]
        self.fast, self.failed = None, 0
        if ranks_path:
            import base64

            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def __call__(self, text: str) -> list[int]:
        if self.fast is not None and not any(s in text for s in self.special):
            try:
                return self.fast(text)
            except BaseException as e:  # a panic of the native library isn't an Exception
                if isinstance(e, KeyboardInterrupt | SystemExit):
                    raise
                self.failed += 1
                logging.getLogger(__name__).warning("text %d of this task that the ranks can't encode goes the plain way: %r", self.failed, e)
        return self.plain.encode(text, add_special_tokens=False).ids


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; only the first may be shorter than capacity if n is above it."""
    first = n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pieces(docs: DataFrame, tokenizer_path: str, ranks_path: str | None = None, pattern: str | None = None, capacity: int = 2048, with_ids: bool = False, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, doc_tokens, _salt (a number that deals rows of one id apart) and, with_ids, ids: a row for each piece of each row of docs."""
    return cut_documents(docs, lambda: Encoder(tokenizer_path, ranks_path, pattern), END, lambda n: cut(n, capacity), with_ids, key, text)


def cut_documents(docs: DataFrame, encoder: Callable[[], Callable[[str], Sequence[int]]], end: int, cuts: Callable[[int], list[tuple[int, int]]], with_ids: bool = False, key: str = "doc_id", text: str = "text") -> DataFrame:
    """As pieces, for an encoder that each task makes, an end token, and a rule that gives (start, length) of the pieces of n tokens."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, doc_tokens long, _salt int" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, salt = encoder(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                rows = []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    salt = (salt + 1) % 2**30
                    ids = np.append(np.asarray(encode(text or ""), "<u4"), np.uint32(end)).astype("<u4", copy=False)
                    rows += [(doc_id, i, s, n, zlib.crc32(x := ids[s : s + n].tobytes()), len(ids), salt, *([np.frombuffer(x, "<u4").astype("i4")] if with_ids else [])) for i, (s, n) in enumerate(cuts(len(ids)))]
                cols = list(zip(*rows))
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int32())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "doc_tokens", "_salt", "ids"]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types)], names[: len(cols)])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


def plan_bins(counts: np.ndarray, capacity: int) -> list[tuple[int, list[int]]]:
    """counts[n]: pieces of length n. Patterns (times, lengths) that use up all counts; lengths of a pattern sum to capacity at most."""
    left = np.array(counts, dtype=np.int64)
    left[0] = 0
    out = []
    sizes = np.arange(capacity + 1)

    def below(avail: np.ndarray) -> np.ndarray:
        """For each x the largest available length of at most x, else 0."""
        return np.maximum.accumulate(np.where(avail > 0, sizes, 0))

    while left.any():
        best, bin_, gap, avail = below(left), [], capacity, left.copy()
        while gap and (n := int(best[gap])):
            bin_.append(n)
            avail[n] -= 1
            gap -= n
            if not avail[n]:
                best = below(avail)
        if gap and len(bin_) > 1:
            room, small = gap + bin_[-1], bin_[-1]
            first = np.flatnonzero(avail[: room + 1])
            # the partner of a first length is the largest that still fits beside it; a length used twice must be there twice
            second = best[np.maximum(room - first, 0)]
            same = (second == first) & (avail[first] < 2)
            if same.any():
                lower = np.array([int(below(np.where(sizes == a, 0, avail))[room - a]) for a in first[same]])
                second[same] = lower
            total = np.where((second > 0) & (first > 0), first + second, 0)
            if len(total) and total.max() > small:
                i = int(total.argmax())
                bin_[-1:] = sorted((int(first[i]), int(second[i])), reverse=True)
        need = np.bincount(bin_, minlength=capacity + 1)
        used = need > 0
        times = int((left[used] // need[used]).min())
        left -= times * need
        out.append((times, bin_))
    return out


def places(plan: list[tuple[int, list[int]]]) -> dict[int, np.ndarray]:
    """For each length, rows (first rank, first sequence, offset, times) ordered by rank."""
    out: dict[int, list] = {}
    taken: dict[int, int] = {}
    sequence = 0
    for times, lengths in plan:
        offset = 0
        for n in lengths:
            out.setdefault(n, []).append((taken.get(n, 0), sequence, offset, times))
            taken[n] = taken.get(n, 0) + times
            offset += n
        sequence += times
    return {n: np.array(x, dtype=np.int64) for n, x in out.items()}


def pack(cut_pieces: DataFrame, capacity: int = 2048, rows_a_bucket: int = 20_000, plan: Callable[[np.ndarray, int], list[tuple[int, list[int]]]] = plan_bins) -> DataFrame:
    """cut_pieces (as from pieces) with sequence_id and offset, by the patterns that plan makes of the counts of lengths. They are read several times, so they should be stored. Ranks within a length go by buckets, of which there are more the more pieces there are."""
    buckets = max(64, -(-cut_pieces.count() // rows_a_bucket))
    own = ["doc_id", "piece", *(c for c in ("_salt",) if c in cut_pieces.columns)]
    rows = cut_pieces.withColumn("_bucket", F.pmod(F.xxhash64(*own), F.lit(buckets)))
    counts = rows.groupBy("_bucket", "length").agg(F.count("*").alias("_n"))
    below = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.withColumn("_base", F.coalesce(F.sum("_n").over(below), F.lit(0))).select(F.col("_bucket").alias("_b"), F.col("length").alias("_l"), "_base")
    total = np.zeros(capacity + 1, dtype=np.int64)
    for n, k in rows.groupBy("length").count().collect():  # at most `capacity` rows
        total[n] = k
    table = places(plan(total, capacity))
    inside = Window.partitionBy("_bucket", "length").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = rows.withColumn("_rank", F.row_number().over(inside) - 1)
    ranked = ranked.join(base, (F.col("_bucket") == F.col("_b")) & (F.col("length") == F.col("_l"))).withColumn("_rank", F.col("_rank") + F.col("_base"))

    @F.pandas_udf("sequence_id long, offset long")
    def placed(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        out = np.zeros((len(length), 2), dtype=np.int64)
        n, r = length.to_numpy(), rank.to_numpy()
        for x in np.unique(n):
            at, slots = np.flatnonzero(n == x), table[int(x)]
            i = np.searchsorted(slots[:, 0], r[at], side="right") - 1
            out[at, 0] = slots[i, 1] + r[at] - slots[i, 0]
            out[at, 1] = slots[i, 2]
        return pd.DataFrame({"sequence_id": out[:, 0], "offset": out[:, 1]})

    return ranked.withColumn("_place", placed("length", "_rank")).select(*cut_pieces.columns, "_place.sequence_id", "_place.offset").drop("_salt")


def pack_documents(docs: DataFrame, tokenizer_path: str, ranks_path: str | None = None, pattern: str | None = None, capacity: int = 2048, with_ids: bool = False) -> DataFrame:
    return pack(stored(pieces(docs, tokenizer_path, ranks_path, pattern, capacity, with_ids)), capacity)
