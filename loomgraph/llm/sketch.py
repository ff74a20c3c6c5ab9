"""Fixed-size bit sketches of hashed keys: built in each partition, merged shard by shard, then broadcast.

Their size is a parameter and never grows with the data, which bounds what is sent. An overfull sketch lets
more keys through; every use is followed by an exact step.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.words import U, mix
from loomgraph.llm.worker import tidy

SHARD_BITS = 1 << 20


def cells(keys: np.ndarray, row: int, log2_cells: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix(keys + U(0x632BE59BD9B4E019) * U(row + 1)) >> U(64 - log2_cells)).astype(np.int64)


class Planes:
    """Which cells were met, and which of them at least twice."""

    def __init__(self, log2_cells: int):
        self.once = np.zeros((1 << log2_cells) // 8, np.uint8)
        self.twice = np.zeros_like(self.once)

    def add(self, cell: np.ndarray) -> None:
        cell = np.sort(cell)
        again = cell[1:][cell[1:] == cell[:-1]]
        first = cell[np.concatenate([[True], cell[1:] != cell[:-1]])] if len(cell) else cell
        met = (self.once[first >> 3] >> (first & 7).astype(np.uint8)) & 1
        for plane, at in ((self.twice, np.concatenate([again, first[met == 1]])), (self.once, first)):
            at = np.unique(at)
            if len(at):
                byte = at >> 3
                begin = np.flatnonzero(np.concatenate([[True], byte[1:] != byte[:-1]]))
                plane[byte[begin]] |= np.bitwise_or.reduceat(np.left_shift(1, at & 7).astype(np.uint8), begin)

    def shards(self, row: int):
        step = min(SHARD_BITS // 8, len(self.once))
        for i in range(0, len(self.once), step):
            once, twice = self.once[i : i + step], self.twice[i : i + step]
            if once.any():
                yield row, i // step, zlib.compress(once, 1), zlib.compress(twice, 1)


def _merge(batches):
    """Rows of one shard follow one another."""
    at, once, twice = None, None, None

    def out():
        return pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int32()), pa.array([at[1]], pa.int32()), pa.array([zlib.compress(once, 1)], pa.binary()), pa.array([zlib.compress(twice, 1)], pa.binary())], ["row", "shard", "once", "twice"])

    for b in batches:
        for r, s, x, y in zip(*(b.column(c).to_pylist() for c in ("row", "shard", "once", "twice")), strict=True):
            x, y = (np.frombuffer(zlib.decompress(v), np.uint8) for v in (x, y))
            if at != (r, s):
                if at:
                    yield out()
                at, once, twice = (r, s), x.copy(), y.copy()
            else:
                twice |= y | (once & x)
                once |= x
    if at:
        yield out()


def planes_schema() -> str:
    return "row int, shard int, once binary, twice binary"


def merged(parts: DataFrame, plane: str, rows: int, log2_cells: int) -> np.ndarray:
    """rows x bytes: one plane of the merged sketch. At most rows * 2**log2_cells bits reach the driver."""
    both = parts.repartition("row", "shard").sortWithinPartitions("row", "shard").mapInArrow(tidy(_merge), planes_schema())
    out = np.zeros((rows, (1 << log2_cells) // 8), np.uint8)
    step = min(SHARD_BITS // 8, out.shape[1])
    for r, s, bits in both.select("row", "shard", plane).toLocalIterator():
        out[r, s * step : (s + 1) * step] = np.frombuffer(zlib.decompress(bits), np.uint8)
    return out


def partition_planes(batches, keys, rows: int, log2_cells: int):
    """The sketch of one partition; keys(batch) gives arrays of hashes. Only one row's planes are held while
    its shards are written."""
    planes = [Planes(log2_cells) for _ in range(rows)]
    for b in batches:
        for h in keys(b):
            for r in range(rows):
                planes[r].add(cells(h, r, log2_cells))
    for r in range(rows):
        for found in planes[r].shards(r):
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(found, (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["row", "shard", "once", "twice"])


@dataclass
class Member:
    """Which keys a set may hold: never a false no."""

    bits: Broadcast
    log2_cells: int

    def holds(self, keys: np.ndarray) -> np.ndarray:
        return self.holds_unsigned(np.ascontiguousarray(keys.astype(np.int64)).view(np.uint64))

    def holds_unsigned(self, h: np.ndarray) -> np.ndarray:
        ok = np.ones(len(h), bool)
        for r, plane in enumerate(self.bits.value):
            at = cells(h, r, self.log2_cells)
            ok &= ((plane[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool)
        return ok


def member_filter(keys: DataFrame, log2_cells: int = 25, rows: int = 2) -> Member:
    """Of the first column of keys, integers. Size: rows * 2**log2_cells bits."""
    col = keys.columns[0]
    source = keys.select(F.col(col).cast("long").alias("k")).where("k is not null")
    parts = source.mapInArrow(
        tidy(lambda batches: partition_planes(batches, lambda b: [b.column("k").to_numpy().view(np.uint64)], rows, log2_cells)), planes_schema()
    )
    return Member(keys.sparkSession.sparkContext.broadcast(merged(parts, "once", rows, log2_cells)), log2_cells)
