"""Running values over the order of keys, without gathering all rows in one task.

A window without partitions moves a whole table to one task. Here rows are dealt out in ranges of the key, each range
is processed alone, and what one range passes on to the next is a row per range.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import materialized

_RANGE = "__range"


def in_ranges(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with the number of the key range that holds them; written once, as sampled bounds may differ between runs."""
    dealt = df.repartitionByRange(*keys).withColumn(_RANGE, F.spark_partition_id())
    return materialized(dealt, "ranges")


def with_running(df: DataFrame, keys: list[str], number: str, sums: dict[str, str], ties: Sequence[str] = ()) -> DataFrame:
    """`df` with the row number by keys (from 1) and running totals: sums maps a new column to the one it adds up.

    Rows of equal keys are numbered by `ties` and all have the total that includes them, as SQL's running sums do.
    """
    dealt = in_ranges(df, keys)
    totals = dealt.groupBy(_RANGE).agg(F.count("*").alias(number), *[F.sum(c).alias(s) for s, c in sums.items()])
    before = Window.orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    bases = totals.select(_RANGE, *[F.coalesce(F.sum(c).over(before), zero).alias(f"__{c}") for c in (number, *sums)])
    ordered = Window.partitionBy(_RANGE).orderBy(*keys, *ties)
    here = Window.partitionBy(_RANGE).orderBy(*keys).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    own = dealt.withColumn(number, F.row_number().over(ordered)).withColumns({s: F.sum(c).over(here) for s, c in sums.items()})
    out = own.join(F.broadcast(bases), _RANGE)  # one row per range
    return out.select(*df.columns, *[(F.col(c) + F.col(f"__{c}")).cast("long").alias(c) for c in (number, *sums)])


def with_previous(df: DataFrame, keys: list[str], column: str, name: str) -> DataFrame:
    """`df` with the value of `column` in the row before, by keys."""
    dealt = in_ranges(df, keys)
    ends = dealt.groupBy(_RANGE).agg(F.max_by(F.struct(F.col(column).alias("v")), F.struct(*keys)).alias("last"))
    bases = ends.select(_RANGE, F.lag("last").over(Window.orderBy(_RANGE)).alias("__last"))
    here = Window.partitionBy(_RANGE).orderBy(*keys)
    own = dealt.withColumns({"__first": F.row_number().over(here) == 1, name: F.lag(column).over(here)})
    out = own.join(F.broadcast(bases), _RANGE)
    return out.select(*df.columns, F.when(F.col("__first"), F.col("__last")["v"]).otherwise(F.col(name)).alias(name))


def _exits(size: str, limit: int):
    """For one range: how full the last chunk is at its end, by how full the open chunk is at its start.

    Entries that close their first chunk at the same row leave alike, so this is a step function. A row per range: the
    entries from which each step holds (descending), the fills at the end and the chunks closed, as packed 64-bit numbers
    without steps that equal the one before, and the bytes of the range if an entry may close nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, number = [], None
        for b in batches:
            if b.num_rows:
                number = b[_RANGE][0].as_py()
                sizes.append(b[size].to_numpy(zero_copy_only=False).astype(np.int64))
        if number is None:
            return
        total = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
        n = len(total) - 1
        # a chunk that starts after row i closes at row after[i]; rows that leave after one more chunk are a run before them
        after = np.searchsorted(total, total[:-1] + limit, side="left")
        fill, closed = np.append(total[n] - total[:-1], 0), np.zeros(n + 1, np.int64)
        high = int(np.searchsorted(after, n, side="right"))  # from here on nothing closes
        while high > 0:
            low = int(np.searchsorted(after, high, side="left"))
            to = after[low:high]
            fill[low:high], closed[low:high] = fill[to], closed[to] + 1
            high = low
        # an entry of e closes its first chunk at the first row with total >= limit - e
        first = int(np.searchsorted(total, limit, side="left"))
        rows = np.arange(1, min(first, n) + 1)
        entry, leaves, count = np.maximum(limit - total[rows], 0), fill[rows], closed[rows] + 1
        keep = np.append((leaves[:-1] != leaves[1:]) | (count[:-1] != count[1:]), True)  # the lowest entry of equal steps
        packed = [[x[keep].astype("<i8").tobytes()] for x in (entry, leaves, count)]
        rest = int(total[n]) if first > n else None
        yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), *[pa.array(p, pa.binary()) for p in packed], pa.array([rest], pa.int64())], names=["r", "entries", "fills", "closed", "rest"])

    return run


def _cut(size: str, limit: int, entries: dict[int, tuple[int, int]], names: list[str]):
    """The chunk number of each row of a range, given the fill and the chunk number at its start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fill = number = None
        for b in batches:
            if not b.num_rows:
                continue
            if fill is None:
                fill, number = entries[b[_RANGE][0].as_py()]
            out = np.empty(b.num_rows, np.int64)
            total = np.cumsum(b[size].to_numpy(zero_copy_only=False).astype(np.int64))
            i, done = 0, 0
            while i < len(total):
                j = int(np.searchsorted(total, done + limit - fill, side="left"))
                out[i : j + 1] = number
                if j >= len(total):
                    fill += int(total[-1]) - done
                    break
                i, done, fill, number = j + 1, int(total[j]), 0, number + 1
            yield pa.RecordBatch.from_arrays([*(b[c] for c in names), pa.array(out)], names=[*names, "chunk"])

    return run


def greedy_chunks(df: DataFrame, keys: list[str], size: str, limit: int) -> DataFrame:
    """`df` with a chunk number: in key order a chunk is closed by the row that brings it to `limit` or more.

    Where a chunk ends depends on all before it. Each range of keys tells how it would go on from every state in which
    it can be entered; the driver holds the table of one range at a time and keeps a state per range, and the ranges then
    cut their rows. A range's table has at most a step for each row of its first `limit` bytes, 24 bytes each.
    """
    dealt = in_ranges(df, keys).repartitionById(_parts(df), _RANGE).sortWithinPartitions(*keys)
    tables = dealt.select(_RANGE, size).mapInArrow(_exits(size, limit), "r int, entries binary, fills binary, closed binary, rest long").orderBy("r").toLocalIterator()
    entries: dict[int, tuple[int, int]] = {}
    fill = number = 0
    for row in tables:
        entries[row.r] = (fill, number)
        steps, leaves, closed = (np.frombuffer(x, "<i8") for x in (row.entries, row.fills, row.closed))
        at = int(np.searchsorted(-steps, -fill, side="left"))  # the highest step at or below the entry
        if at < len(steps):
            fill, number = int(leaves[at]), number + int(closed[at])
        else:
            fill += row.rest
    names = df.columns
    schema = df.select(*names).withColumn("chunk", F.lit(0).cast("long")).schema
    return dealt.select(_RANGE, *names).mapInArrow(_cut(size, limit, entries, names), schema)


def _parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def boundaries(value: str, previous: str) -> Column:
    """Whether a row's value differs from the row's before; the first row has none."""
    return F.coalesce(F.col(value) != F.col(previous), F.lit(False))
