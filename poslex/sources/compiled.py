"""Collections in the classic compiled format, read as tables.

Columns of ids are Elias delta codes with a seek table; tasks read ranges of them by byte, and decode the segments of a
range side by side in numpy, one code of each at a step. Lexicons, maps and ranges are fixed-width arrays. Nothing
but headers is read on the driver. Paths may be URIs of any file system that pyarrow knows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import lexicon as lx

U = np.uint64
#: Positions or ids that are decoded at a time.
CHUNK = 1 << 20
_INDEX, _DENSE = b"\xa3finDR", b"\xa8finDR"


class BadIndexHeader(ValueError):
    """The file isn't an inverted index."""


def _file(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


def exists(path: str) -> bool:
    system, at = _file(path)
    return system.get_file_info(at).type == fs.FileType.File


def size(path: str) -> int:
    system, at = _file(path)
    info = system.get_file_info(at)
    if info.type != fs.FileType.File:
        raise FileNotFoundError(path)
    return info.size


def _read(path: str, start: int, n: int) -> bytes:
    system, at = _file(path)
    with system.open_input_file(at) as f:
        return f.read_at(max(0, min(n, f.size() - start)), start)


def _array(path: str, kind: str, first: int, n: int, header: int = 0) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.frombuffer(_read(path, header + first * width, n * width), kind)


# ---- codes ------------------------------------------------------------------------------------------------------
class Bits:
    """Codes in a stretch of bytes, at many places at once. Bits count from the lowest of each byte."""

    def __init__(self, data: bytes):
        padded = np.frombuffer(data + b"\0" * 24, np.uint8)
        self.last = len(data) + 8
        self.words = np.lib.stride_tricks.sliding_window_view(padded, 8)
        self.bytes = padded

    def _window(self, at: np.ndarray) -> np.ndarray:
        byte, shift = np.minimum(at >> 3, self.last), (at & 7).astype(U)
        low = np.ascontiguousarray(self.words[byte]).view("<u8").ravel() >> shift
        high = self.bytes[byte + 8].astype(U) << (U(63) - shift) << U(1)
        return low | high

    @staticmethod
    def _zeros(x: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return np.minimum(np.bitwise_count((x & (~x + U(1))) - U(1)), 31).astype(U)

    def gamma(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values, and where the next codes begin."""
        x = self._window(at)
        n = self._zeros(x)
        one = U(1) << n
        return (x >> (n + U(1))) & (one - U(1)) | one, at + (2 * n + U(1)).astype(np.int64)

    def delta(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = self._window(at)
        n = self._zeros(x)
        one = U(1) << n
        x = x >> (n + U(1))
        width = np.minimum((x & (one - U(1)) | one) - U(1), U(63))
        top = U(1) << width
        return (x >> n) & (top - U(1)) | top, at + (2 * n + U(1) + width).astype(np.int64)


class Codes:
    """The same codes one after another, from one place of a file on."""

    def __init__(self, path: str, block: int = 1 << 16):
        self.path, self.block, self.end, self.held, self.data = path, block, size(path), None, b""
        self.at = 0

    def _window(self) -> int:
        byte = self.at >> 3
        if self.held is None or not self.held <= byte <= self.held + self.block - 16:
            self.held, self.data = byte, _read(self.path, byte, self.block)
        return int.from_bytes(self.data[byte - self.held : byte - self.held + 10], "little") >> (self.at & 7)

    def gamma(self) -> int:
        x = self._window()
        if not x:
            raise ValueError(f"no code at bit {self.at} of {self.path}")
        n = (x & -x).bit_length() - 1
        self.at += 2 * n + 1
        return (x >> (n + 1)) & ((1 << n) - 1) | 1 << n

    def delta(self) -> int:
        width = self.gamma() - 1
        x = self._window()
        self.at += width
        return x & ((1 << width) - 1) | 1 << width

    def bit(self) -> bool:
        x = self._window()
        self.at += 1
        return bool(x & 1)


def _header(path: str, byte: int, n: int) -> list[int]:
    codes = Codes(path, 128)
    codes.at = 8 * byte
    return [codes.delta() for _ in range(n)]


def _steps(bits: Bits, at: np.ndarray, n: int) -> np.ndarray:
    """n delta codes from each place, as rows."""
    out = np.empty((len(at), n), U)
    for i in range(n):
        out[:, i], at = bits.delta(at)
    return out


# ---- tables -----------------------------------------------------------------------------------------------------
def _chunked(spark: SparkSession, n: int, chunk: int, make: Callable[[int, int], pa.RecordBatch], schema: str) -> DataFrame:
    """What ``make`` gives for the ranges of 0 .. n, a task for each few of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column(0).to_pylist():
                yield make(i * chunk, min(n, (i + 1) * chunk))

    chunks = -(-n // chunk)
    return spark.range(0, chunks, 1, max(1, min(chunks, 10_000))).mapInArrow(run, schema)


def _batch(names: str, *columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names.split())


def kind_of(base: str) -> str:
    """How a column is stored, by the files that it has."""
    return "giga" if exists(f"{base}.text.off") else "delta" if exists(f"{base}.text.seg") else "int"


def column(spark: SparkSession, base: str, kind: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """pos, id of a compiled column."""
    kind, text = kind or kind_of(base), f"{base}.text"
    if kind == "int":
        n = size(text) // 4 - 4
        return _chunked(spark, n, chunk, lambda a, b: _batch("pos id", np.arange(a, b), _array(text, "<u4", a, b - a, 16)), "pos long, id long")
    segment, n = (x - 1 for x in _header(text, 16, 2))
    if kind == "giga":
        segment = 64
    chunk = max(1, chunk // (16 * segment)) * 16 * segment

    def make(a: int, b: int) -> pa.RecordBatch:
        first, last = a // segment, -(-b // segment)
        if kind == "giga":
            # bits within blocks of 16 segments, whose bases count 2 KiB
            bits = _array(f"{base}.text.off", "<u2", first, last - first + 1).astype(np.int64)
            blocks = _array(f"{base}.text.seg", "<u4", first // 16, last // 16 - first // 16 + 1).astype(np.int64)
            seek = blocks[np.arange(first, first + len(bits)) // 16 - first // 16] * 2048 * 8 + bits
        else:
            seek = _array(f"{base}.text.seg", "<u4", first, last - first + 1).astype(np.int64)
        own = seek[: last - first]
        begin, end = int(own[0]) >> 3, (int(seek[-1]) >> 3) + 1 if len(seek) > last - first else size(text)
        bits = Bits(_read(text, begin, end - begin))
        ids = _steps(bits, own - 8 * begin, segment).ravel()[: b - a] - U(1)
        return _batch("pos id", np.arange(a, b), ids)

    return _chunked(spark, n, chunk, make, "pos long, id long")


def lexicon(spark: SparkSession, base: str, chunk: int = CHUNK) -> DataFrame:
    """id, value, sort_rank of a compiled lexicon."""
    lex, n = f"{base}.lex", size(f"{base}.lex.idx") // 4

    def strings(a: int, b: int) -> pa.RecordBatch:
        at = _array(f"{lex}.idx", "<u4", a, b - a + 1).astype(np.int64)
        end = int(at[b - a]) if len(at) > b - a else size(lex)
        data = _read(lex, int(at[0]), end - int(at[0]))
        values = [data[s : e if (e := data.find(b"\0", s)) >= 0 else None].decode("utf-8") for s in (at[: b - a] - at[0]).tolist()]
        return pa.RecordBatch.from_arrays([pa.array(np.arange(a, b)), pa.array(values, pa.string())], ["id", "value"])

    words = _chunked(spark, n, chunk, strings, "id long, value string")
    ranks = _chunked(spark, n, chunk, lambda a, b: _batch("id sort_rank", _array(f"{lex}.srt", "<u4", a, b - a), np.arange(a, b)), "id long, sort_rank long")
    return words.join(ranks, "id")


def index(spark: SparkSession, base: str, chunk: int = 1 << 14) -> DataFrame:
    """id, pos of a compiled inverted index, plain or dense. Frequent ids' lists are decoded each by itself."""
    rev = f"{base}.rev"
    magic = _read(rev, 0, 6)
    if magic not in (_INDEX, _DENSE):
        raise BadIndexHeader(rev)
    dense = magic == _DENSE
    n = size(f"{base}.lex.idx") // 4 if dense else size(f"{rev}.cnt") // 4
    times = 1 if dense or not _array(f"{rev}.idx", "<u4", 0, 1)[:1].any() else _header(rev, 6, 1)[0] - 1

    def places(a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Byte and count of the lists of ids a .. b."""
        if not dense:
            return _array(f"{rev}.idx", "<u4", a, b - a).astype(np.int64) * times, _array(f"{rev}.cnt", "<u4", a, b - a).astype(np.int64)
        blocks = _array(f"{rev}.idx0", "<u4", a // 64, -(-b // 64) - a // 64 + 1).astype(np.int64)
        own = blocks[: -(-b // 64) - a // 64]
        bits, at = Bits(_read(f"{rev}.idx1", int(own[0]), (int(blocks[-1]) if len(blocks) > len(own) else size(f"{rev}.idx1")) - int(own[0]))), 8 * (own - own[0])
        byte, count, last = np.zeros((len(own), 64), np.int64), np.zeros((len(own), 64), np.int64), np.zeros(len(own), np.int64)
        for i in range(64):
            step, at = bits.delta(at)
            last = last + step.astype(np.int64)
            some, at = bits.gamma(at)
            byte[:, i], count[:, i] = last, some.astype(np.int64) - 1
        return byte.ravel()[: b - a], count.ravel()[: b - a]

    def make(a: int, b: int) -> pa.RecordBatch:
        byte, count = places(a, b)
        some = np.flatnonzero(count)
        if not len(some):
            return _batch("id pos", *np.zeros((2, 0), np.int64))
        begin = int(byte[some].min())
        # a list ends where the next one begins; of the last one each code takes 80 bits at most
        end = min(size(rev), int(byte[some].max()) + 10 * int(count[some[np.argmax(byte[some])]]) + 16)
        bits, at, order = Bits(_read(rev, begin, end - begin)), 8 * (byte[some] - begin), np.argsort(-count[some], kind="stable")
        some, at = some[order], at[order]
        left, last = count[some], np.full(len(some), -1, np.int64)
        ids, out, step = [], [], 0
        while len(some):
            gap, at = bits.delta(at)
            last = last + gap.astype(np.int64)
            ids.append(some + a)
            out.append(last)
            step += 1
            live = int(np.searchsorted(-left, -step, "left"))
            some, at, last, left = some[:live], at[:live], last[:live], left[:live]
        return _batch("id pos", np.concatenate(ids), np.concatenate(out))

    return _chunked(spark, n, -(-chunk // 64) * 64, make, "id long, pos long")


def ranges(spark: SparkSession, base: str, wide: bool = False, chunk: int = CHUNK) -> DataFrame:
    """num, beg, end of a compiled structure."""
    kind, n = ("<u8", size(f"{base}.rng") // 16) if wide else ("<u4", size(f"{base}.rng") // 8)

    def make(a: int, b: int) -> pa.RecordBatch:
        both = _array(f"{base}.rng", kind, 2 * a, 2 * (b - a)).reshape(-1, 2)
        return _batch("num beg end", np.arange(a, b), both[:, 0], both[:, 1])

    return _chunked(spark, n, chunk, make, "num long, beg long, end long")


def mapping(spark: SparkSession, base: str, chunk: int = CHUNK) -> DataFrame:
    """src_id, dyn_id of a derived attribute."""
    path = f"{base}.lex.ridx"
    return _chunked(spark, size(path) // 4, chunk, lambda a, b: _batch("src_id dyn_id", np.arange(a, b), _array(path, "<u4", a, b - a)), "src_id long, dyn_id long")


def frequencies(spark: SparkSession, path: str, chunk: int = CHUNK) -> DataFrame:
    """id, freq of an external frequency file."""
    return _chunked(spark, size(path) // 8, chunk, lambda a, b: _batch("id freq", np.arange(a, b), _array(path, "<u8", a, b - a)), "id long, freq long")


def attribute(spark: SparkSession, base: str, kind: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Column (pos, id) and lexicon (id, value, first_pos, frq, sort_rank)."""
    ids = column(spark, base, kind)
    counts = ids.groupBy("id").agg(F.min("pos").alias("first_pos"), F.count("*").alias("frq"))
    lex = lexicon(spark, base).join(counts, "id", "left").select("id", "value", "first_pos", F.coalesce("frq", F.lit(0)).alias("frq"), "sort_rank")
    return ids, lex


# ---- word sketches ----------------------------------------------------------------------------------------------
class _Levels:
    """The three levels of a sketch and its occurrences, as far as their headers tell."""

    def __init__(self, base: str):
        self.base = base
        one, two = (Codes(f"{base}.map{i}.com") for i in (0, 2))
        one.at = two.at = 16 * 8
        version = 4 + _read(f"{base}.map0.com", 10, 1)[0]
        one.delta(), two.delta()
        self.final = one.delta() - (version > 4)
        self.lcm, self.adjusted = two.bit(), two.bit()
        self.least, self.norm = np.float32(-10), np.float32(4096) / np.float32(30)
        if self.adjusted:
            bits, most = two.delta(), two.delta()
            self.least = np.float32(-(two.delta() - 1))
            self.norm = np.float32(1 << bits) / (np.float32(most) - self.least)
        self.extra = two.bit() if version > 5 else False
        times = _header(f"{base}.rev", 16, 1)[0]
        self.close, self.times = times == 2, 1 if times == 2 else times

    @staticmethod
    def _record(codes: Codes, index: int, number: int, adjusted: bool = False) -> tuple[int, int]:
        add = codes.delta()
        if add > 1:
            return index + add - adjusted, number + codes.delta()
        index = codes.delta()
        return index, codes.delta() - 1

    def heads(self, begin: int, end: int) -> Iterator[tuple]:
        """head_id, where its relations are, how many, frq; from records between two bits."""
        codes, index, number = Codes(f"{self.base}.map0.com"), 0, 0
        codes.at = begin
        while number < self.final and codes.at < end:
            index, number = self._record(codes, index, number)
            yield number, index, codes.delta(), codes.delta()

    def below(self, codes: Codes, at: int, n: int, last: bool) -> Iterator[tuple]:
        """id, index, cnt, rnk, frq, lcm of the n records of a relation or collocate level."""
        index = number = 0
        codes.at = at
        for _ in range(n):
            index, number = self._record(codes, index, number, last and self.adjusted)
            cnt, rank, frq, lcm = codes.delta(), float(np.float32(codes.delta()) / self.norm + self.least), codes.delta(), [-1]
            if last and self.lcm:
                lcm = [codes.delta() - 1 for _ in range(codes.gamma() - 1)]
            if last and self.extra:
                for _ in range(codes.gamma() - 1):
                    codes.delta()
            yield number, index, cnt, rank, frq, lcm

    def places(self, codes: Codes, index: int, n: int) -> tuple[list[int], list[int | None]]:
        codes.at, at, where, off = 8 * index * self.times, 0, [], []
        for _ in range(n):
            at += codes.delta() - self.close
            c = codes.gamma()
            if c > 1 and codes.gamma() != 1:
                raise ValueError(f"broken offset in {codes.path}")
            where.append(at)
            off.append(None if c == 1 else -(c // 2) if c % 2 else c // 2)
        return where, off


_ENTRY = "head_id long, rel_id long, coll_id long, rel_ord long, ord long, cnt long, frq long, rnk float, lcm array<int>, places array<long>, offs array<int>"


def sketch(spark: SparkSession, base: str) -> tuple[DataFrame, DataFrame]:
    """Entries (head_id, rel_id, coll_id, rel_ord, ord, cnt, frq, rnk, lcm) and occurrences (head_id, rel_id, coll_id, pos, coll_off).

    ``rel_ord`` and ``ord`` are the stored order of a head's relations and of a relation's collocates.
    """
    seeks = np.unique(_array(f"{base}.map0.idx", "<u4", 0, size(f"{base}.map0.idx") // 4).astype(np.int64))
    ends = [*seeks[1:].tolist(), 1 << 62]
    spans = spark.createDataFrame(list(zip(seeks.tolist(), ends, strict=True)), "begin long, end long").repartition(max(1, min(len(seeks), 1000)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level, two, three, rev = _Levels(base), Codes(f"{base}.map1.com"), Codes(f"{base}.map2.com"), Codes(f"{base}.rev")
        schema = pa.schema([*((c, pa.int64()) for c in ("head_id", "rel_id", "coll_id", "rel_ord", "ord", "cnt", "frq")), ("rnk", pa.float32()), ("lcm", pa.list_(pa.int32())), ("places", pa.list_(pa.int64())), ("offs", pa.list_(pa.int32()))])
        for batch in batches:
            for begin, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for head, index_one, n, _ in level.heads(begin, end):
                    rows = []
                    for i, (rel, index_two, m, _, _, _) in enumerate(level.below(two, index_one, n, False)):
                        for j, (coll, index_three, cnt, rank, frq, lcm) in enumerate(level.below(three, index_two, m, True)):
                            rows.append((head, rel, coll, i, j, cnt, frq, rank, lcm, *level.places(rev, index_three, cnt)))
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    rows = spans.mapInArrow(run, _ENTRY)
    both = F.explode(F.arrays_zip("places", "offs")).alias("x")
    return rows.drop("places", "offs"), rows.select("head_id", "rel_id", "coll_id", both).select("head_id", "rel_id", "coll_id", F.col("x.places").alias("pos"), F.col("x.offs").alias("coll_off"))


def check_index(spark: SparkSession, base: str, kind: str | None = None) -> bool:
    """Whether a compiled inverted index holds just what its column does."""
    own, stored = lx.postings(column(spark, base, kind)), index(spark, base)
    return own.exceptAll(stored).isEmpty() and stored.exceptAll(own).isEmpty()
