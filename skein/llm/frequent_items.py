"""Most frequent values of a column in bounded memory, by a majority-vote sketch."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEPTH = 4
WIDTH = 4096
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)


def cells_of(hashes: np.ndarray, row: int, width: int) -> np.ndarray:
    """Cell of each 64-bit hash in a row of the sketch; width is a power of two."""
    with np.errstate(over="ignore"):
        x = hashes.view(np.uint64) * _MIX[row]
        x ^= x >> np.uint64(29)
        x *= _MIX[(row + 3) % len(_MIX)]
    return (x >> np.uint64(64 - int(width).bit_length() + 1)).astype(np.int64)


@dataclass
class VoteSketch:
    """Cells [row, column]: total of all counts, candidate (a hash), surplus of votes for the candidate.

    In each cell: count(candidate) >= surplus, count(candidate) <= (total + surplus) / 2, and any other value's count
    <= (total - surplus) / 2. Adding and merging keep these, in any order.
    """

    total: np.ndarray
    candidate: np.ndarray
    surplus: np.ndarray

    @staticmethod
    def empty(depth: int = DEPTH, width: int = WIDTH) -> "VoteSketch":
        return VoteSketch(*(np.zeros((depth, width), np.int64) for _ in range(3)))

    def add(self, hashes: np.ndarray, counts: np.ndarray) -> None:
        """Adds distinct hashes with their counts. Within a cell the largest count wins against the sum of the others."""
        depth, width = self.total.shape
        for row in range(depth):
            cell = cells_of(hashes, row, width)
            order = np.lexsort((hashes, counts, cell))
            c = cell[order]
            last = np.flatnonzero(np.append(c[1:] != c[:-1], True))
            sums = np.bincount(cell, counts, width).astype(np.int64)
            best = order[last]
            at = cell[best]
            self._merge(row, at, sums[at], hashes[best], np.maximum(2 * counts[best] - sums[at], 0))

    def _merge(self, row: int, at: np.ndarray, total: np.ndarray, candidate: np.ndarray, surplus: np.ndarray) -> None:
        self.total[row, at] += total
        mine, held = self.surplus[row, at], self.candidate[row, at]
        same = held == candidate
        wins = ~same & ((surplus > mine) | ((surplus == mine) & (candidate > held)))
        self.surplus[row, at] = np.where(same, mine + surplus, np.abs(mine - surplus))
        self.candidate[row, at] = np.where(wins, candidate, held)

    def merge(self, row: np.ndarray, cell: np.ndarray, total: np.ndarray, candidate: np.ndarray, surplus: np.ndarray) -> None:
        """Adds cells of another sketch, each (row, cell) at most once."""
        for r in range(self.total.shape[0]):
            pick = row == r
            self._merge(r, cell[pick], total[pick], candidate[pick], surplus[pick])


_CELLS = "part int, row int, cell int, total long, candidate long, surplus long"


def _cells(sketch: VoteSketch, part: int) -> pa.RecordBatch:
    row, cell = np.nonzero(sketch.total)
    at = (row, cell)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(row), part), pa.int32()), pa.array(row, pa.int32()), pa.array(cell, pa.int32()), pa.array(sketch.total[at]), pa.array(sketch.candidate[at]), pa.array(sketch.surplus[at])],
        ["part", "row", "cell", "total", "candidate", "surplus"],
    )


def _build(depth: int, width: int, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = VoteSketch.empty(depth, width)
        part = 0
        for batch in batches:
            h = batch.column(0).to_numpy()
            if len(h):
                part = int(batch.column(1)[0].as_py())
                sketch.add(*np.unique(h, return_counts=True))
        yield _cells(sketch, part % parts)

    return run


def _fold(depth: int, width: int):
    def run(table: pa.Table) -> pa.Table:
        sketch = VoteSketch.empty(depth, width)
        part = table.column("part")[0].as_py()
        columns = [table.column(n).to_numpy() for n in ("row", "cell", "total", "candidate", "surplus")]
        # Sketches arrive interleaved: the n-th occurrence of a cell belongs to the n-th round.
        key = columns[0].astype(np.int64) * width + columns[1]
        order = np.argsort(key, kind="stable")
        k = key[order]
        start = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
        nth = np.arange(len(k)) - np.repeat(start, np.diff(np.append(start, len(k))))
        for n in range(int(nth.max()) + 1):
            pick = order[nth == n]
            sketch.merge(*(c[pick] for c in columns))
        return pa.Table.from_batches([_cells(sketch, part)])

    return run


def vote_sketch(df: DataFrame, column: str, depth: int = DEPTH, width: int = WIDTH, fan_in: int = 64) -> VoteSketch:
    """Sketch of a string column. Null and '' are left out. Every task sends depth x width cells at most; they are
    merged in groups of `fan_in` sketches by the cluster and the rest, again at most fan_in sketches, on the driver."""
    values = df.where(F.col(f"`{column}`").isNotNull() & (F.col(f"`{column}`") != "")).select(F.xxhash64(f"`{column}`").alias("h"), F.spark_partition_id().alias("p"))
    tasks = max(1, df.rdd.getNumPartitions())
    parts = max(1, -(-tasks // fan_in))
    cells = values.mapInArrow(_build(depth, width, parts), _CELLS)
    while parts > 1:
        cells = cells.groupBy("part").applyInArrow(_fold(depth, width), _CELLS)
        parts = -(-parts // fan_in)
        cells = cells.withColumn("part", F.col("part") % parts)
    if tasks > 1:
        cells = cells.groupBy("part").applyInArrow(_fold(depth, width), _CELLS)
    got = cells.toArrow()
    sketch = VoteSketch.empty(depth, width)
    if got.num_rows:
        sketch.merge(*(got.column(n).to_numpy() for n in ("row", "cell", "total", "candidate", "surplus")))
    return sketch


def bounds(sketch: VoteSketch) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Candidate hashes with lower and upper bounds of their counts, and an upper bound for every other value."""
    depth, width = sketch.total.shape
    found = np.unique(sketch.candidate[sketch.surplus > 0])
    lower, upper = np.zeros(len(found), np.int64), np.full(len(found), np.iinfo(np.int64).max)
    for row in range(depth):
        at = cells_of(found, row, width)
        held = sketch.candidate[row, at] == found
        t, s = sketch.total[row, at], sketch.surplus[row, at]
        lower = np.maximum(lower, np.where(held, s, 0))
        upper = np.minimum(upper, np.where(held, t + s, t - s) // 2)
    others = int(((sketch.total - sketch.surplus) // 2).max(axis=1).min())
    return found, lower, upper, others


def most_frequent(df: DataFrame, column: str, k: int = 20, depth: int = DEPTH, width: int = WIDTH, max_width: int = 1 << 18) -> DataFrame:
    """The k most frequent values of a string column: item_value, n, lower, upper.

    The vote sketch yields candidates with bounds; those that can be among the k first are counted exactly in a second
    scan (at most depth x width of them, and far fewer in practice). If a value that is no candidate could still have
    as many occurrences as the k-th (its upper bound says so), the sketch is widened and built again, up to max_width
    cells a row. Beyond that (no value stands out, as in a flat column) all values are counted, spread over the cluster; the
    result is exact in either case. Values as spelled; null and '' are left out; ties go
    to the lesser value; fewer than k distinct values give all of them; an empty table gives no rows.
    """
    value = F.col(f"`{column}`")
    spark = df.sparkSession
    while True:
        sketch = vote_sketch(df, column, depth, width)
        hashes, lower, upper, others = bounds(sketch)
        floor = int(np.sort(lower)[-k]) if len(lower) >= k else 0
        keep = upper >= floor
        table = spark.createDataFrame([(int(h), int(a), int(b)) for h, a, b in zip(hashes[keep], lower[keep], upper[keep])], "h long, lower long, upper long")
        # At most depth x width rows of three numbers.
        exact = df.where(value.isNotNull() & (value != "")).select(value.alias("item_value"), F.xxhash64(value).alias("h")).join(F.broadcast(table), "h")
        counted = exact.groupBy("item_value", "lower", "upper").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "item_value").limit(k).collect()
        least = counted[-1]["n"] if len(counted) == k else 0
        if least > others or int(sketch.total[0].sum()) == 0 or others == 0:
            return spark.createDataFrame([(r["item_value"], r["n"], r["lower"], r["upper"]) for r in counted], "item_value string, n long, lower long, upper long")
        if width >= max_width:
            every = df.where(value.isNotNull() & (value != "")).groupBy(value.alias("item_value")).agg(F.count(F.lit(1)).alias("n"))
            return every.orderBy(F.desc("n"), "item_value").limit(k).select("item_value", "n", F.col("n").alias("lower"), F.col("n").alias("upper"))
        width *= 4
