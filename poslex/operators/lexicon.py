"""Lexicons, frequencies and id columns of an attribute; inverted index; derived attributes.

A column is a DataFrame (pos, value): one value for each position. Its lexicon numbers distinct values from 0 in the
order of their first position and has their rank in byte order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._numbering import PLACES, carried, numbered, with_offsets


def frequencies(column: DataFrame) -> DataFrame:
    """value, frq, first_pos. One shuffle of partial counts."""
    return column.groupBy("value").agg(F.count("*").alias("frq"), F.min("pos").alias("first_pos"))


def lexicon(column: DataFrame) -> DataFrame:
    """id, value, first_pos, frq."""
    return numbered(frequencies(column), ["first_pos"], "id").select("id", "value", "first_pos", "frq")


def ranked(lex: DataFrame) -> DataFrame:
    """The lexicon with sort_rank: the place of each value in the order of its bytes."""
    return numbered(lex, ["value"], "sort_rank")


def id_of(lex: DataFrame, value: str) -> DataFrame:
    """string to id: one row, or none if the value isn't there (whichever side of the others it would stand on)."""
    return lex.where(F.col("value") == value).select("id", "value")


def ids_of(lex: DataFrame, values: DataFrame) -> DataFrame:
    """value, id for each value asked for, with a null id for those that the lexicon lacks."""
    return values.select("value").distinct().join(lex.select("value", "id"), "value", "left")


def value_of(lex: DataFrame, number: int) -> DataFrame:
    """id to string."""
    return lex.where(F.col("id") == number).select("id", "value")


def encoded(column: DataFrame, lex: DataFrame) -> DataFrame:
    """pos, id, value: the column with ids. Spark broadcasts a small lexicon and shuffles by value else."""
    return column.join(lex.select("id", "value"), "value").select("pos", "id", "value")


def decoded(ids: DataFrame, lex: DataFrame) -> DataFrame:
    """The rows of ids with their values."""
    return ids.join(lex.select("id", "value"), "id")


def at(ids: DataFrame, positions: DataFrame) -> DataFrame:
    """Point reads: the rows of a column at the positions asked for."""
    return ids.join(positions.select("pos").distinct(), "pos", "left_semi")


def from_position(ids: DataFrame, first: int, end: int | None = None) -> DataFrame:
    """Range read from a position to the end, or to another position."""
    ids = ids.where(F.col("pos") >= first)
    return ids if end is None else ids.where(F.col("pos") < end)


def size(column: DataFrame) -> DataFrame:
    return column.agg(F.count("*").alias("size"))


def postings(ids: DataFrame) -> DataFrame:
    """The inverted index as a flat table (id, pos), range-partitioned by id and sorted: no list of a frequent id is ever one row."""
    return ids.select("id", "pos").repartitionByRange("id", "pos").sortWithinPartitions("id", "pos")


def positions_of(index: DataFrame, number: int) -> DataFrame:
    return index.where(F.col("id") == number).select("pos")


def positions_of_word(index: DataFrame, lex: DataFrame, value: str) -> DataFrame:
    """pos: where a value stands; the id is looked up and joined, one row at most."""
    return index.join(F.broadcast(id_of(lex, value).select("id")), "id", "left_semi").select("pos")


def _differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, pos and the position before on the list (null for the partition's first row); the partition's last row."""
    last = part = None
    for batch in batches:
        if not batch.num_rows:
            continue
        number, pos, at = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        part = int(at[0]) // PLACES
        before = np.r_[0, pos[:-1]]
        before[np.r_[True, number[1:] != number[:-1]]] = -1
        known = np.ones(len(pos), np.bool_)
        if last is None:
            known[0] = False
        elif last[0] == number[0]:
            before[0] = last[1]
        last = int(number[-1]), int(pos[-1])
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(before, mask=~known), pa.array(np.full(len(pos), part)), pa.array(np.zeros(len(pos), np.bool_))], _STEPS)
    if part is not None:
        yield pa.RecordBatch.from_arrays([pa.array([last[0]]), pa.array([last[1]]), pa.nulls(1, pa.int64()), pa.array([part]), pa.array([True])], _STEPS)


_STEPS = ["id", "pos", "before", "_part", "_edge"]


def gaps(ids: DataFrame) -> DataFrame:
    """id, pos and gap: its distance from the position before on the id's list, the first from -1.

    Lists aren't gathered: rows are range-partitioned by id and position, and a partition's first row meets the last one before it.
    """
    rows, edges = carried(ids.select("id", "pos"), ["id", "pos"], _differences, "id long, pos long, before long", "gaps")
    ends = [(None, None), *((e["id"], e["pos"]) for e in edges)]
    rows = with_offsets(rows, "_part", [(e["_part"], *end) for e, end in zip(edges, ends, strict=False)], "last_id long, last_pos long")
    before = F.coalesce("before", F.when(F.col("last_id") == F.col("id"), F.col("last_pos")), F.lit(-1))
    return rows.select("id", "pos", (F.col("pos") - before).alias("gap"))


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, ord and the sum of the id's gaps so far in the partition; the partition's last row."""
    last = part = None
    total = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        number, gap, at = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 2, 3))
        part, sums = int(at[0]) // PLACES, np.cumsum(gap)
        new = np.r_[last != number[0], number[1:] != number[:-1]]
        first = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
        run = sums - np.where((first == 0) & ~new[0], -total, (sums - gap)[first])
        last, total = int(number[-1]), int(run[-1])
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(run), pa.array(np.full(len(run), part)), pa.array(np.zeros(len(run), np.bool_))], _RUNS)
    if part is not None:
        yield pa.RecordBatch.from_arrays([pa.array([last]), pa.nulls(1, pa.int64()), pa.array([total]), pa.array([part]), pa.array([True])], _RUNS)


_RUNS = ["id", "ord", "run", "_part", "_edge"]


def from_gaps(gapped: DataFrame) -> DataFrame:
    """The inverse of gaps for (id, ord, gap): id, ord, pos."""
    rows, edges = carried(gapped.select("id", "ord", "gap"), ["id", "ord"], _sums, "id long, ord long, run long", "sums")
    before, end = [], (None, 0)
    for e in edges:
        before.append((e["_part"], *end))
        end = e["id"], e["run"] + (end[1] if e["id"] == end[0] else 0)
    rows = with_offsets(rows, "_part", before, "last_id long, last_sum long")
    return rows.select("id", "ord", (F.col("run") + F.when(F.col("last_id") == F.col("id"), F.col("last_sum")).otherwise(0) - 1).alias("pos"))


def derived(lex: DataFrame, function: Column) -> tuple[DataFrame, DataFrame]:
    """A dynamic attribute: its lexicon (id, value) and its map (src_id, dyn_id).

    Derived values are numbered by the first source id that gives them. ``function`` is a Column of ``value``.
    """
    pairs = lex.select(F.col("id").alias("src_id"), function.alias("value"))
    own = numbered(pairs.groupBy("value").agg(F.min("src_id").alias("first")), ["first"], "id").select("id", "value")
    return own, pairs.join(own, "value").select("src_id", F.col("id").alias("dyn_id"))


def derived_ids(ids: DataFrame, mapping: DataFrame) -> DataFrame:
    """pos, dyn_id: a derived attribute's column."""
    return ids.join(mapping, F.col("id") == F.col("src_id")).select("pos", "dyn_id")


def derived_frequencies(lex: DataFrame, mapping: DataFrame) -> DataFrame:
    """dyn_id, frq: sums of the source frequencies."""
    return mapping.join(lex.select(F.col("id").alias("src_id"), "frq"), "src_id").groupBy("dyn_id").agg(F.sum("frq").alias("frq"))


def frequency(lex: DataFrame, kind: str = "frq", external: DataFrame | None = None) -> DataFrame:
    """id, frq: computed for "frq", else from an external table (kind, id, freq), whose kinds end in ":l"."""
    if kind == "frq":
        return lex.select("id", "frq")
    if external is None or not kind.endswith(":l"):
        raise ValueError(f"no frequency of kind {kind!r}")
    return lex.select("id").join(external.where(F.col("kind") == kind), "id").select("id", F.col("freq").alias("frq"))


_TURNS = np.array([[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]])
_SINES = np.floor(np.abs(np.sin(np.arange(1, 65))) * 2**32).astype(np.uint32)


def _message(pos: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The text pos:number of each row (neither is negative), from the left of 56 bytes, and its length."""
    out, at, row = np.zeros((len(pos), 56), np.uint8), np.zeros(len(pos), np.int64), np.arange(len(pos))
    for i, value in enumerate((pos, number)):
        if i:
            out[row, at] = ord(":")
            at = at + 1
        digits = np.searchsorted(10 ** np.arange(1, 19), value, "right") + 1
        for k in range(int(digits.max(initial=0))):
            has = digits > k
            value, digit = np.divmod(value, 10)
            out[row[has], (at + digits - 1 - k)[has]] = digit[has] + 48
        at = at + digits
    return out, at


def _md5(message: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The first 8 bytes of the MD5 digests of texts of less than 56 bytes, as numbers."""
    message[np.arange(len(size)), size] = 128
    m = [np.ascontiguousarray(x) for x in message.view("<u4").T] + [(size * 8).astype(np.uint32), np.zeros(len(size), np.uint32)]
    first = [np.full(len(size), x, np.uint32) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
    a, b, c, d = first
    for i in range(64):
        if i < 16:
            f, g = (b & c) | (~b & d), i
        elif i < 32:
            f, g = (d & b) | (~d & c), (5 * i + 1) % 16
        elif i < 48:
            f, g = b ^ c ^ d, (3 * i + 5) % 16
        else:
            f, g = c ^ (b | ~d), 7 * i % 16
        f = f + a + m[g] + _SINES[i]
        turn = np.uint32(_TURNS[i // 16, i % 4])
        a, d, c, b = d, c, b, b + ((f << turn) | (f >> (np.uint32(32) - turn)))
    return (np.stack([a + first[0], b + first[1]], 1).astype("<u4").view(">u8")[:, 0]).astype(np.uint64)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each batch of (pos, id), the first 60 bits of the rows' digests, combined."""
    for batch in batches:
        digest = _md5(*_message(*(batch.column(i).to_numpy() for i in range(2))))
        yield pa.RecordBatch.from_arrays([pa.array([np.bitwise_xor.reduce(digest >> np.uint64(4)).astype(np.int64)], pa.int64())], ["x"])


def fingerprint(ids: DataFrame) -> DataFrame:
    """One number for a whole column: the first 60 bits of a digest of each (pos, id), combined in any order."""
    return ids.select("pos", "id").mapInArrow(_digests, "x long").agg(F.bit_xor("x").alias("fingerprint"))
