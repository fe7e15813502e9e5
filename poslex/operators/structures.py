"""Structure ranges (num, beg, end): containment, and the next start or end from a position.

Ranges are half-open; numbers follow the order of the ranges' ends. The default is what the lookups mean: every
structure can be found, and of ranges that hold a position the shortest wins. ``compat`` gives the closed forms of
the classic search instead, in which the last structure is never found and an empty one right after a position is.

Positions and keys meet in one range shuffle, each partition of which is read once in order; what it lacks from those
before is a row for each partition. Nothing is compared with all of the other side.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._numbering import PLACES, carried, ranged, with_offsets

def _filled(width: int):
    """Rows asked for, with the last key (and its columns) that came before in the partition; and the partition's last key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry: list[int | None] = [None] * width
        part = None
        for batch in batches:
            asked, at = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, batch.num_columns - 1))
            part = int(at[0]) // PLACES if len(at) else part
            last = np.maximum.accumulate(np.where(asked, -1, np.arange(len(asked))))
            want = np.flatnonzero(asked)
            from_carry, source = last[want] < 0, pa.array(np.maximum(last[want], 0))
            columns = []
            for i in range(width):
                own = batch.column(3 + i)
                columns.append(pc.if_else(pa.array(from_carry), pa.scalar(carry[i], pa.int64()), own.take(source)))
                if len(last) and last[-1] >= 0:
                    carry[i] = own[int(last[-1])].as_py()
            n = len(want)
            yield pa.RecordBatch.from_arrays([batch.column(1).take(pa.array(want)), *columns, pa.array(np.full(n, part or 0)), pa.array(np.zeros(n, np.bool_))], names)
        if part is not None:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), *(pa.array([x], pa.int64()) for x in carry), pa.array([part]), pa.array([True])], names)

    names = ["pos", *(f"c{i}" for i in range(width)), "_part", "_edge"]
    return run


def _nearest(positions: DataFrame, keys: DataFrame, ahead: bool = True) -> DataFrame:
    """pos and the row of keys (key, ..., all BIGINT) with the least key at or after it, or, without ``ahead``, the greatest at or before it.

    Keys are distinct; columns are null where there is none. Positions and keys go through one range shuffle, in which
    each position finds the key last seen; where a partition has none yet it is the last one of those before.
    """
    names = keys.columns
    width = len(names)
    sign = -1 if ahead else 1
    asked = positions.select("pos").distinct().select((F.col("pos") * sign).alias("o"), "pos", F.lit(True).alias("asked"), *(F.lit(None).cast("long").alias(f"c{i}") for i in range(width)))
    events = asked.unionByName(keys.select((F.col("key") * sign).alias("o"), F.lit(None).cast("long").alias("pos"), F.lit(False).alias("asked"), *(F.col(c).cast("long").alias(f"c{i}") for i, c in enumerate(names))))
    columns = ", ".join(f"c{i} long" for i in range(width))
    found, edges = carried(events, ["o", "asked"], _filled(width), f"pos long, {columns}", "nearest")
    before: list[tuple] = []
    row: tuple = (None,) * width
    for e in edges:
        before.append((e["_part"], *row))
        row = tuple(e[f"c{i}"] for i in range(width)) if e["c0"] is not None else row
    out = with_offsets(found, "_part", before, ", ".join(f"b{i} long" for i in range(width)))
    return out.select("pos", *(F.when(F.col("c0").isNull(), F.col(f"b{i}")).otherwise(F.col(f"c{i}")).alias(c) for i, c in enumerate(names)))


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The partition's first start, its greatest end, and whether two of its ranges overlap."""
    first, most, crossed, part = None, None, False, None
    for batch in batches:
        beg, end, at = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        if not len(beg):
            continue
        part, first = int(at[0]) // PLACES, int(beg[0]) if first is None else first
        reach = np.maximum.accumulate(np.r_[beg[0] if most is None else most, end])
        crossed |= bool((beg < reach[:-1]).any())
        most = int(reach[-1])
    if part is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (part, first, most, crossed)], ["part", "first", "most", "crossed"])


def disjoint(ranges: DataFrame) -> bool:
    """Whether no position is in two of the ranges."""
    own = ranged(ranges.where("beg < end").select("beg", "end"), ["beg", "end"]).withColumn("at", F.monotonically_increasing_id())
    reach = None
    # a row for each partition
    for r in sorted(own.mapInArrow(_overlaps, "part long, first long, most long, crossed boolean").collect()):
        if r["crossed"] or reach is not None and r["first"] < reach:
            return False
        reach = r["most"] if reach is None else max(reach, r["most"])
    return True


def containing(positions: DataFrame, ranges: DataFrame) -> DataFrame:
    """pos, num: the shortest range that holds each position (the later of equally long ones), null if none does."""
    own = ranges.where("beg < end").select("num", "beg", "end")
    if disjoint(own):
        found = _nearest(positions, own.select(F.col("beg").alias("key"), "num", "end"), ahead=False)
        return found.select("pos", F.when(F.col("pos") < F.col("end"), F.col("num")).alias("num"))
    # ranges of up to 2 ** level positions touch two blocks of that size at most, so few of a level are in a block
    own = own.withColumn("level", F.length(F.bin(F.col("end") - F.col("beg") - 1)))
    own = own.select("num", "beg", "end", "level", F.explode(F.array_distinct(F.array(F.expr("shiftright(beg, level)"), F.expr("shiftright(end - 1, level)")))).alias("b"))
    # 63 levels at most
    levels = own.select("level").distinct()
    asked = positions.select("pos").distinct().crossJoin(F.broadcast(levels)).withColumn("b", F.expr("shiftright(pos, level)"))
    held = asked.join(own, ["level", "b"]).where("pos >= beg AND pos < end")
    best = held.groupBy("pos").agg(F.min(F.struct((F.col("end") - F.col("beg")).alias("n"), (-F.col("num")).alias("m"))).alias("x")).select("pos", (-F.col("x.m")).alias("num"))
    return positions.select("pos").distinct().join(best, "pos", "left")


def _searched(ranges: DataFrame, compat: bool) -> DataFrame:
    """The ranges that a search can find."""
    if not compat:
        return ranges
    return ranges.crossJoin(F.broadcast(ranges.agg(F.max("num").alias("_last")))).where("num < _last").drop("_last")


def next_start(positions: DataFrame, ranges: DataFrame, compat: bool = False) -> DataFrame:
    """pos, beg: the least start at or after each position."""
    return _nearest(positions, _searched(ranges, compat).select(F.col("beg").alias("key")).distinct()).select("pos", F.col("key").alias("beg"))


def by_end(positions: DataFrame, ranges: DataFrame, compat: bool = False) -> DataFrame:
    """pos, num, beg: of the ranges that end at the position the last, else the first that ends after it."""
    ends = _searched(ranges, compat).groupBy(F.col("end").alias("key")).agg(F.min(F.struct("num", "beg")).alias("low"), F.max(F.struct("num", "beg")).alias("high"))
    found = _nearest(positions, ends.select("key", F.col("low.num").alias("low"), F.col("low.beg").alias("low_beg"), F.col("high.num").alias("high"), F.col("high.beg").alias("high_beg")))
    here = F.col("key") == F.col("pos")
    return found.select("pos", F.when(here, F.col("high")).otherwise(F.col("low")).alias("num"), F.when(here, F.col("high_beg")).otherwise(F.col("low_beg")).alias("beg"))


def number_at(positions: DataFrame, ranges: DataFrame, compat: bool = False) -> DataFrame:
    """pos, num: the structure at each position."""
    if not compat:
        return containing(positions, ranges)
    after = positions.select("pos").distinct().select((F.col("pos") + 1).alias("pos"))
    found = by_end(after, ranges, True).select((F.col("pos") - 1).alias("pos"), F.col("num").alias("i"), F.col("beg").alias("b"))
    end = ranges.select(F.col("num").alias("i"), F.col("end").alias("e"))
    before = ranges.select(F.col("num").alias("j"), F.col("beg").alias("b_before"))
    found = found.withColumn("j", F.when(F.col("i") > 0, F.col("i") - 1)).join(end, "i", "left").join(before, "j", "left")
    number: Column = F.when(F.col("b") <= F.col("pos"), F.col("i")).when((F.col("b") == F.col("e")) & (F.col("b") == F.col("pos") + 1), F.col("i"))
    return found.select("pos", number.when(F.col("b_before") == F.col("pos"), F.col("j")).alias("num"))


def next_start_sum(positions: DataFrame, ranges: DataFrame, compat: bool = False) -> DataFrame:
    """total: the sum of the next starts over every second position; positions without one add nothing."""
    even = positions.where("pos % 2 = 0")
    return next_start(even, ranges, compat).agg(F.coalesce(F.sum("beg"), F.lit(0)).cast("long").alias("total"))


def lengths(ranges: DataFrame) -> DataFrame:
    """num, beg, end, length."""
    return ranges.select("num", "beg", "end", (F.col("end") - F.col("beg")).alias("length"))
