"""Global order without a global window: dense numbers and running sums over range partitions.

Rows are range-partitioned, sorted and written once, with their place in their partition. What a partition needs to know
of those before it is one row for each partition, put together on the driver: as many rows as shuffle partitions,
whatever the size of the data.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import written

#: monotonically_increasing_id is the partition's number times this, and the row's place in it.
PLACES = 1 << 33


def ranged(df: DataFrame, order: list[str | Column]) -> DataFrame:
    """df range-partitioned and sorted within partitions."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(parts, *order).sortWithinPartitions(*order)


def with_offsets(rows: DataFrame, part: str, offsets: list[tuple], schema: str) -> DataFrame:
    """Each row with its partition's row of offsets, one for each partition."""
    table = rows.sparkSession.createDataFrame(offsets, f"{part} long, {schema}")
    return rows.join(F.broadcast(table), part)


def numbered(df: DataFrame, order: list[str], name: str, by: list[str] | None = None) -> DataFrame:
    """df with ``name``: its number from 0 in ``order``, which must be total; with ``by``, among the rows equal in it, of few distinct values."""
    rows = ranged(df, [*(by or []), *order]).withColumn("_at", F.monotonically_increasing_id())
    rows = written(rows, "ranged").withColumn("_part", F.expr(f"_at DIV {PLACES}"))
    counts = sorted(rows.groupBy("_part").count().collect())
    base, total = [], 0
    for part, n in counts:
        base.append((part, total))
        total += n
    out = with_offsets(rows, "_part", base, "_base long").withColumn(name, F.col("_base") + F.col("_at") % PLACES)
    if by:
        keys = [f"_by{i}" for i in range(len(by))]
        first = out.groupBy(*(F.col(c).alias(k) for c, k in zip(by, keys, strict=True))).agg(F.min(name).alias("_first"))
        same = [F.col(c).eqNullSafe(F.col(k)) for c, k in zip(by, keys, strict=True)]
        out = out.join(first, same).withColumn(name, F.col(name) - F.col("_first")).drop("_first", *keys)
    return out.drop("_part", "_at", "_base")


def running_sum(df: DataFrame, order: list[str], value: Column, name: str) -> DataFrame:
    """df with ``name``: the sum of ``value`` over all rows before this one in ``order``, which must be total."""
    return running_sums(df, order, {name: value})


def running_sums(df: DataFrame, order: list[str], values: dict[str, Column]) -> DataFrame:
    """df with a column for each of ``values``: its sum over all rows before this one in ``order``, which must be total."""
    own = [f"_value{i}" for i in range(len(values))]
    kept = df.select("*", *(F.coalesce(v.cast("long"), F.lit(0)).alias(c) for c, v in zip(own, values.values(), strict=True)))
    kept = ranged(kept, order).withColumn("_at", F.monotonically_increasing_id())
    schema = T.StructType(kept.schema.fields + [T.StructField(f"_inner{i}", T.LongType()) for i in range(len(own))])
    rows = written(kept.mapInArrow(_summed(own), schema), "ranged").withColumn("_part", F.expr(f"_at DIV {PLACES}"))
    base, total = [], [0] * len(own)
    for part, *sums in sorted(rows.groupBy("_part").agg(*(F.sum(c) for c in own)).collect()):
        base.append((part, *total))
        total = [a + b for a, b in zip(total, sums, strict=True)]
    out = with_offsets(rows, "_part", base, ", ".join(f"_base{i} long" for i in range(len(own))))
    return out.select(*(F.col(f"`{c}`") for c in df.columns), *((F.col(f"_base{i}") + F.col(f"_inner{i}")).alias(c) for i, c in enumerate(values)))


def _summed(values: list[str]):
    """Adds for each of the value columns its sum over the rows before in the partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * len(values)
        for batch in batches:
            more = []
            for i, c in enumerate(values):
                value = batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False)
                sums = np.cumsum(value, dtype=np.int64)
                more.append(pa.array(total[i] + sums - value))
                total[i] += int(sums[-1]) if len(sums) else 0
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, *(f"_inner{i}" for i in range(len(values)))])

    return run


def carried(rows: DataFrame, order: list[str | Column], fill: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, name: str) -> tuple[DataFrame, list]:
    """What ``fill`` gives over the rows in ``order``, and one row that it gives for each partition.

    ``fill`` sees the rows of a partition in order, with ``_at`` behind their columns, and gives rows of ``schema``;
    the row that stands for the partition, for those after it, has a true ``_edge``.
    """
    out = ranged(rows, order).withColumn("_at", F.monotonically_increasing_id()).mapInArrow(fill, f"{schema}, _part long, _edge boolean")
    out = written(out, name)
    edges = sorted(out.where("_edge").collect(), key=lambda r: r["_part"])
    return out.where("NOT _edge").drop("_edge"), edges
