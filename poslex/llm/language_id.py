"""Language ID: averaged hashed subword embeddings under a linear softmax.

A text's subwords are the byte n-grams (3 and 4 bytes) of its lower-cased form, hashed into a fixed number of
buckets; its vector is the mean of their embeddings, its class scores a linear map of that. Embeddings and map are
trained by stochastic gradient descent in numpy on a bounded, hash-ordered sample of documents with a language tag.
A part of the sample is held out: it sets the temperature of the softmax and the least probability at which at least
``precision`` of the accepted rows are right; rows below are rejected. Since averaging and the map are linear, each
bucket's class scores are folded into one table for scoring, which covers the whole text of every document.

Edge cases: a text of fewer than 3 bytes (null, empty) is rejected with probability 0. Rows with a null tag or text
don't train. Without any tagged row everything is rejected. Repeated rows come out alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _vec

BITS = 15
GRAMS = (3, 4)
_MUL = {3: np.uint32(0x9E3779B1), 4: np.uint32(0x85EBCA6B)}


@dataclass(frozen=True)
class Model:
    langs: tuple[str, ...]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    least: float

    def probabilities(self, column: pa.Array) -> np.ndarray:
        """A row of class probabilities for each text (lower-cased by the caller), NaN where it has no subword."""
        out = np.full((len(column), len(self.langs)), np.nan)
        for at, to in _vec.chunks(column, 1 << 20):
            raw, off = _vec.buffers(column[at:to])
            sums, n = np.zeros((to - at, len(self.langs))), np.zeros(to - at)
            for bucket, first, last in _subwords(raw, off):
                n += last - first
                for c in range(len(self.langs)):
                    run = np.zeros(len(bucket) + 1)
                    np.cumsum(self.table[c][bucket], out=run[1:], dtype=np.float64)
                    sums[:, c] += run[last] - run[first]
            with np.errstate(invalid="ignore", divide="ignore"):
                out[at:to] = _softmax((sums / n[:, None] + self.bias) / self.temperature)
        return out


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _subwords(raw: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: the bucket of the n-gram at each byte, and where each row's n-grams begin and end."""
    wide = np.where(raw <= 32, 32, raw).astype(np.uint32)
    for n in GRAMS:
        size = max(0, len(raw) - n + 1)
        code = np.zeros(size, np.uint32)
        for i in range(n):
            code |= wide[i : i + size] << np.uint32(8 * i)
        with np.errstate(over="ignore"):
            code *= _MUL[n]
        code ^= code >> np.uint32(15)
        with np.errstate(over="ignore"):
            code *= np.uint32(0x2C1B3C6D)
        first = np.minimum(off[:-1], size)
        yield code >> np.uint32(32 - BITS), first, np.minimum(np.maximum(first, off[1:] - n + 1), size)


def _bags(column: pa.Array) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Distinct buckets and their shares, for each text."""
    ids, shares = [], []
    for i in range(len(column)):
        raw, off = _vec.buffers(column[i : i + 1])
        count = sum(np.bincount(b[f[0] : t[0]], minlength=1 << BITS) for b, f, t in _subwords(raw, off))
        hit = np.flatnonzero(count)
        ids.append(hit)
        shares.append((count[hit] / max(1, count.sum())).astype(np.float32))
    return ids, shares


def train(texts: pa.Array, tags: list[str], width: int = 16, epochs: int = 6, rate: float = 4.0, held_out: float = 0.25, precision: float = 0.995, seed: int = 3) -> Model:
    """Fits embeddings and map on part of the rows and calibrates on the rest."""
    langs = tuple(sorted(set(tags)))
    if not langs:
        return Model(("",), np.zeros((1, 1 << BITS), np.float32), np.zeros(1), 1.0, np.inf)
    rng = np.random.default_rng(seed)
    y = np.array([langs.index(t) for t in tags])
    ids, shares = _bags(texts)
    order = rng.permutation(len(y))
    cut = int(len(y) * (1 - held_out)) or len(y)
    fit, held = order[:cut], order[cut:]
    e = (rng.standard_normal((1 << BITS, width)) * 0.3).astype(np.float32)
    w, b = (rng.standard_normal((width, len(langs))) * 0.3).astype(np.float32), np.zeros(len(langs), np.float32)
    steps = max(1, epochs * len(fit))
    for step in range(steps):
        if step % len(fit) == 0:
            fit = rng.permutation(fit)
        i = fit[step % len(fit)]
        if not len(ids[i]):
            continue
        lr = rate * (1 - step / steps)
        x = shares[i] @ e[ids[i]]
        g = _softmax((x @ w + b)[None])[0]
        g[y[i]] -= 1
        back = w @ g
        w -= np.float32(lr) * np.outer(x, g)
        b -= np.float32(lr * 0.1) * g
        # the gradient of an embedding is its share of back; shares are small, so the step is scaled up alike for all
        e[ids[i]] -= np.float32(lr) * 20 * np.outer(shares[i], back)
    table = np.ascontiguousarray((e @ w).T)
    model = Model(langs, table, b.astype(np.float64), 1.0, 0.0)
    test = held if len(held) else fit
    p = np.nan_to_num(model.probabilities(texts.take(pa.array(test))), nan=1 / len(langs))
    z = np.log(np.maximum(p, 1e-12))
    grid = np.exp(np.linspace(-3, 3, 61))
    loss = [-np.log(np.maximum(_softmax(z / t)[np.arange(len(test)), y[test]], 1e-12)).mean() for t in grid]
    temperature = float(grid[int(np.argmin(loss))])
    p = _softmax(z / temperature)
    top, right = p.max(1), p.argmax(1) == y[test]
    down = np.argsort(-top, kind="stable")
    share = np.cumsum(right[down]) / np.arange(1, len(down) + 1)
    fine = np.flatnonzero(share >= precision)
    # beyond the least confident accepted row: half-way to what chance would give
    least = (top[down[fine[-1]]] + 1 / len(langs)) / 2 if len(fine) and fine[-1] == len(down) - 1 else top[down[fine[-1]]] if len(fine) else 1.0
    return Model(langs, table, b.astype(np.float64), temperature, float(least))


def fit(docs: DataFrame, sample: int = 3_000, **options) -> Model:
    """A model from at most ``sample`` tagged documents, taken in the order of a hash of doc_id and text; of equal ones a single row."""
    tagged = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", "lang")
    ids = tagged.select(F.xxhash64("doc_id", "text").alias("h")).distinct().orderBy("h").limit(sample)
    rows = tagged.withColumn("h", F.xxhash64("doc_id", "text")).join(F.broadcast(ids), "h", "left_semi")
    rows = rows.groupBy("h").agg(F.min(F.struct("lang", "text")).alias("row")).select("row.text", "row.lang").toArrow().sort_by([("lang", "ascending"), ("text", "ascending")])
    return train(_vec.texts(rows["text"], lower=True), rows["lang"].to_pylist(), **options)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang (null if rejected), probability, rejected for every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = shared.value
            p = np.nan_to_num(m.probabilities(_vec.texts(batch.column(1), lower=True)))
            best, top = p.argmax(1), p.max(1)
            out = (top < m.least) | (top == 0)
            lang = pa.array([None if o else m.langs[i] for i, o in zip(best, out, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), lang, pa.array(top), pa.array(out)], ["doc_id", "lang", "probability", "rejected"])

    id_type = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, lang string, probability double, rejected boolean")


def query(spark, sf_dir: str) -> DataFrame:
    """Language, probability and rejection of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return identify(docs, fit(docs)).withColumn("probability", F.round("probability", 6))
