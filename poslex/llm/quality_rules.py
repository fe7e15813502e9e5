"""Quality rules: an isolation forest on rule statistics of documents.

Each document gets a row of rule statistics (``STATISTICS``) over its whole text. A forest of random splits is grown
on a bounded, hash-ordered sample of labelled rows; a document's score is 2 ** (-mean path length / expected length),
high for documents that few splits isolate. The threshold is calibrated on the same labelled rows: the lowest score
at which at most ``good_loss`` of the rows labelled good are rejected. Statistics and scores cover all documents.

Edge cases: a text without tokens (null, empty or white space only) is rejected with score 1. Labels that are null,
or whose doc_id is null, are left out; of repeated labels the lowest holds. Without labels of good rows nothing but
texts without tokens is rejected. Repeated rows are scored alike. Other columns are carried along untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _vec
from ._vec import U

STATISTICS = ("symbols", "upper", "word_length", "punctuated", "single", "same_as_last", "top_token", "repeated_runs", "shouted")
_RUN = 4
#: Shares of a text's tokens are taken as if it had so many more, so that a short text isn't extreme by a word or two.
_FEW = 10


def _table(chars: str) -> np.ndarray:
    out = np.zeros(256, np.bool_)
    out[list(chars.encode("ascii"))] = True
    return out


_SYMBOL = _table("#$%&*<>{}[]|\\^~=+_@!")
_UPPER = _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_ALPHA = _table("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") | (np.arange(256) >= 128)
_MARK = _table(".,;:!?\"')")
_INNER = (np.arange(256) & 0xC0) == 0x80


def statistics(column: pa.Array) -> np.ndarray:
    """One row of STATISTICS for each text, NaN where it has no token."""
    out = np.full((len(column), len(STATISTICS)), np.nan, np.float32)
    for at, to in _vec.chunks(column):
        raw, off = _vec.buffers(column[at:to])
        out[at:to] = _chunk(raw, off)
    return out


def _chunk(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    rows = len(off) - 1
    start, end, row = _vec.tokens(raw, off)
    n = np.bincount(row, minlength=rows).astype(np.float64)

    def total(mask: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(mask) + 1, np.int64)
        np.cumsum(mask, out=sums[1:])
        return (sums[off[1:]] - sums[off[:-1]]).astype(np.float64)

    each = lambda mask: np.bincount(row[mask], minlength=rows)
    h = _vec.span_hash(raw, start, end)
    with np.errstate(over="ignore"):
        alpha, upper, length = total(_ALPHA[raw]), total(_UPPER[raw]), np.bincount(row, weights=end - start, minlength=rows)
        chars = length - total(_INNER[raw])
        # runs of _RUN tokens and single tokens that occurred before in the same text
        same_row = row[_RUN - 1 :] == row[: len(row) - _RUN + 1] if len(row) >= _RUN else np.zeros(0, np.bool_)
        run = np.zeros(len(same_row), U)
        for i in range(_RUN if len(same_row) else 0):
            run = run * U(0x9E3779B97F4A7C15) + h[i : i + len(same_row)]
        runs = each_row = row[: len(same_row)][same_row]
        repeated = np.bincount(_repeats(runs, _vec.mix(run[same_row]))[0], minlength=rows)
        top = np.zeros(rows)
        who, size = _repeats(row, h)[1]
        np.maximum.at(top, who, size)
        last = raw[end - 1] if len(end) else np.zeros(0, np.uint8)
        stats = [
            total(_SYMBOL[raw]) / (chars + 5 * _FEW), upper / (alpha + 5 * _FEW), (chars + 5 * _FEW) / (n + _FEW),
            each(_MARK[last]) / (n + _FEW), each((end - start == 1) & ~_ALPHA[last]) / (n + _FEW),
            each(np.r_[False, (h[1:] == h[:-1]) & (row[1:] == row[:-1])] if len(h) else np.zeros(0, np.bool_)) / (n + _FEW), (top - 1) / (n + _FEW),
            repeated / (np.bincount(each_row, minlength=rows) + _FEW), each(_SYMBOL[last] & (end - start > 1)) / (n + _FEW),
        ]
    out = np.stack(stats, 1)
    out[n == 0] = np.nan
    return out.astype(np.float32)


def _repeats(row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """Rows of the values that occurred before in their row; row and count of each distinct value."""
    if not len(row):
        z = np.zeros(0, np.int64)
        return z, (z, z)
    base = int(row[0])
    bits = max(1, int(row[-1] - base).bit_length())
    key = ((row - base).astype(U) << U(64 - bits)) | (h >> U(bits))
    key.sort()
    new = np.r_[True, key[1:] != key[:-1]]
    at = np.flatnonzero(new)
    who = (key >> U(64 - bits)).astype(np.int64) + base
    return who[~new], (who[at], np.diff(np.r_[at, len(key)]))


@dataclass(frozen=True)
class Forest:
    """Trees in heap order: the children of node i are 2i + 1 and 2i + 2; a feature of -1 marks a leaf."""

    feature: np.ndarray
    split: np.ndarray
    path: np.ndarray
    norm: float
    threshold: float

    def score(self, x: np.ndarray) -> np.ndarray:
        out, good = np.ones(len(x)), ~np.isnan(x[:, 0])
        x = np.ascontiguousarray(x[good])
        total, rows = np.zeros(len(x)), np.arange(len(x))
        for feature, split, path in zip(self.feature, self.split, self.path, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(int(np.log2(len(feature) + 1)) - 1):
                f = feature[node]
                node = np.where(f >= 0, 2 * node + 1 + (x[rows, np.maximum(f, 0)] >= split[node]), node)
            total += path[node]
        out[good] = 2.0 ** (-total / len(self.feature) / self.norm)
        return out


def _expected(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search in a binary tree of n leaves."""
    n = np.asarray(n, np.float64)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def grow(x: np.ndarray, trees: int, size: int, seed: int) -> Forest:
    rng = np.random.default_rng(seed)
    size = min(size, len(x))
    depth = max(1, int(np.ceil(np.log2(max(2, size)))))
    nodes = 2 ** (depth + 1) - 1
    feature, split, path = np.full((trees, nodes), -1, np.int64), np.zeros((trees, nodes)), np.zeros((trees, nodes))
    for t in range(trees):
        todo = [(0, 0, x[rng.choice(len(x), size, replace=False)])]
        while todo:
            node, d, own = todo.pop()
            low, high = (own.min(0), own.max(0)) if len(own) else (np.zeros(x.shape[1]),) * 2
            wide = np.flatnonzero(high > low)
            if d == depth or len(own) < 2 or not len(wide):
                path[t, node] = d + _expected(len(own))
                continue
            f = rng.choice(wide)
            feature[t, node], split[t, node] = f, rng.uniform(low[f], high[f])
            right = own[:, f] >= split[t, node]
            todo += [(2 * node + 1, d + 1, own[~right]), (2 * node + 2, d + 1, own[right])]
    return Forest(feature, split, path, float(max(_expected(size), 1e-9)), np.inf)


def fit(docs: DataFrame, labels: DataFrame, sample: int = 20_000, trees: int = 200, size: int = 64, good_loss: float = 0.005, seed: int = 7) -> Forest:
    """A calibrated forest from at most ``sample`` labelled rows, taken in the order of a hash of doc_id; of documents that share one a single row."""
    known = labels.select(F.col("doc_id").alias("id"), F.col("quality").alias("q")).dropna().groupBy("id").agg(F.min("q").alias("q"))
    known = F.broadcast(known.orderBy(F.xxhash64("id"), "id").limit(sample))
    rows = docs.select(F.col("doc_id").alias("id"), "text").join(known, "id").select("id", "text", "q")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = statistics(_vec.texts(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(x), pa.list_(pa.float32())), batch.column(2).cast(pa.int32())], ["id", "x", "q"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    got = rows.mapInArrow(run, f"id {kind}, x array<float>, q int").groupBy("id").agg(F.min(F.struct("x", "q")).alias("row")).select("row.x", "row.q").toArrow()
    if not got.num_rows:
        return grow(np.zeros((2, len(STATISTICS)), np.float32), 1, 2, seed)
    x, q = np.array(got["x"].to_pylist(), np.float32), got["q"].to_numpy()
    order = np.lexsort([*x.T, q])
    x, q = x[order], q[order]
    full = ~np.isnan(x[:, 0])
    return calibrated(grow(x[full], trees, size, seed), x[full], q[full], good_loss) if full.any() else grow(x * 0, 1, 2, seed)


def calibrated(forest: Forest, x: np.ndarray, q: np.ndarray, good_loss: float) -> Forest:
    good = np.sort(forest.score(x[q > 0]))
    threshold = good[min(len(good) - 1, int(np.ceil(len(good) * (1 - good_loss))))] if len(good) else np.inf
    return Forest(forest.feature, forest.split, forest.path, forest.norm, float(threshold))


def keep_good(docs: DataFrame, forest: Forest, with_score: bool = False) -> DataFrame:
    """The documents whose score is at most the threshold, in their own columns (and ``score``)."""
    spark, names = docs.sparkSession, docs.columns
    model = spark.sparkContext.broadcast(forest)
    text = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = statistics(_vec.texts(batch.column(text)))
            score = model.value.score(x)
            keep = (score <= model.value.threshold) & ~np.isnan(x[:, 0])
            out = batch.filter(pa.array(keep))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(score[keep])], [*(f"c{i}" for i in range(len(names))), "score"]) if with_score else out

    if not with_score:
        return docs.mapInArrow(run, docs.schema)
    plain = docs.toDF(*(f"c{i}" for i in range(len(names))))
    out = plain.mapInArrow(run, plain.withColumn("score", F.lit(0.0)).schema)
    return out.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(names)), "score")


def query(spark, sf_dir: str) -> DataFrame:
    """The documents that are kept, with their scores."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    forest = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return keep_good(docs, forest, with_score=True).select("doc_id", F.round("score", 6).alias("score"))
