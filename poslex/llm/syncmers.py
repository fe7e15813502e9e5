"""Document fingerprints from closed syncmers.

A text is its sequence of Unicode code points, unchanged. A k-mer is selected if the least hash among its inner s-mers
is that of its first or its last one (ties count), so whether it is selected depends on nothing outside it: a
passage that two documents share gives the same anchors in both, wherever it stands. Every run of 2k - s - 1 code
points holds one anchor at least, about 2 / (k - s + 1) of all positions are selected. An s-mer's hash is multilinear
modulo 2**31 - 1, so that SQL can state it; an anchor's hash adds two such numbers over the whole k-mer.

Edge cases: a text shorter than k (null and empty included) has no anchors and comes out with empty lists, as may one
shorter than 2k - s - 1. With ``whole`` such a text, unless it is empty, has one anchor: place 0 and a hash of the
whole text. Long texts are fingerprinted whole. Rows are independent: repeated rows come out alike, with whatever
doc_id they have.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _vec
from ._run import materialise

#: Runs of 39 code points hold an anchor; the shortest passages looked for have about 80.
K, S = 24, 8
PRIME = 2**31 - 1
#: Factors of the s-mer hash, of the two halves of the k-mer hash.
_rng = np.random.default_rng(77)
INNER = _rng.integers(1, PRIME, S)
OUTER = _rng.integers(1, PRIME, (2, K))
#: Of the two halves of a whole text's hash; the first is the length's.
WHOLE = _rng.integers(1, PRIME, (2, 2 * K - S))
_CHARS = 1 << 19


def anchors(code: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, place in the row and hash of each anchor, for the code points of rows behind one another."""
    width, n = K - S + 1, len(code) - S + 1
    if n < width:
        z = np.zeros(0, np.int64)
        return z, z, z
    code = code.astype(np.int64)
    h = np.zeros(n, np.int64)
    for j in range(S):
        # S products of under 2**31 * 2**21 each stay below 2**63
        h += code[j : j + n] * INNER[j]
    h %= PRIME
    # the least over each window of width values, from block-wise running minima
    pad = np.full(-n % width, PRIME, np.int64)
    block = np.r_[h, pad].reshape(-1, width)
    ahead = np.minimum.accumulate(block, axis=1).ravel()
    back = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    m = n - width + 1
    least = np.minimum(back[:m], ahead[width - 1 : width - 1 + m])
    at = np.flatnonzero((h[:m] == least) | (h[width - 1 : width - 1 + m] == least))
    row = np.searchsorted(off, at, "right") - 1
    inside = at + K <= off[row + 1]
    at, row = at[inside], row[inside]
    out = np.zeros((2, len(at)), np.int64)
    for j in range(K):
        c = code[at + j]
        for half in range(2):
            # at most K * 2**52 < 2**59
            out[half] += c * OUTER[half, j]
    return row, at - off[row], (out[0] % PRIME) * (2**31) + out[1] % PRIME


def whole_texts(code: np.ndarray, off: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Hashes of the whole texts of rows that have no anchor, so fewer than 2K - S - 1 code points."""
    size = off[row + 1] - off[row]
    out = size * WHOLE[:, :1]
    for j in range(int(size.max(initial=0))):
        own = np.flatnonzero(size > j)
        out[:, own] += code[off[row[own]] + j].astype(np.int64) * WHOLE[:, j + 1 : j + 2]
    return (out[0] % PRIME) * (2**31) + out[1] % PRIME


def _run(whole: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = _vec.texts(batch.column(1))
            for at, to in _vec.chunks(column, _CHARS):
                part = column[at:to]
                raw, off = _vec.buffers(part)
                head = np.r_[0, np.cumsum((raw & 0xC0) != 0x80)]
                code = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le", "surrogatepass"), np.uint32)
                off = head[off]
                row, place, h = anchors(code, off)
                if whole:
                    bare = np.setdiff1d(np.flatnonzero(np.diff(off)), row)
                    row, place, h = np.r_[row, bare], np.r_[place, np.zeros(len(bare), np.int64)], np.r_[h, whole_texts(code, off, bare)]
                    order = np.argsort(row, kind="stable")
                    row, place, h = row[order], place[order], h[order]
                ends = pa.array(np.searchsorted(row, np.arange(to - at + 1)).astype(np.int32))
                lists = (pa.ListArray.from_arrays(ends, pa.array(x)) for x in (place.astype(np.int32), h))
                yield pa.RecordBatch.from_arrays([batch.column(0)[at:to], *lists], ["doc_id", "places", "hashes"])

    return run


def fingerprints(docs: DataFrame, whole: bool = False) -> DataFrame:
    """doc_id, places and hashes of its anchors, in order, for every document. No shuffle."""
    return docs.select("doc_id", "text").mapInArrow(_run(whole), f"doc_id {dict(docs.dtypes)['doc_id']}, places array<int>, hashes array<long>")


def shared_anchors(left: DataFrame, right: DataFrame) -> DataFrame:
    """Positional matches of two sets of fingerprints: doc_a, doc_b, shift, anchors, first, last.

    One row for each pair of documents and each shift (place in b less place in a) under which anchors agree.
    """
    side = lambda df, x: df.select(F.col("doc_id").alias(f"doc_{x}"), F.explode(F.arrays_zip("places", "hashes")).alias("z")).select(f"doc_{x}", F.col("z.places").alias(f"place_{x}"), F.col("z.hashes").alias("hash"))
    both = side(left, "a").join(side(right, "b"), "hash").withColumn("shift", F.col("place_b") - F.col("place_a"))
    return both.groupBy("doc_a", "doc_b", "shift").agg(F.count("*").alias("anchors"), F.min("place_a").alias("first"), F.max("place_a").alias("last"))


def passages(docs: DataFrame) -> DataFrame:
    """Positional matches of all rows without their pairs: doc_id, passage, first, last, anchors, occurrences, row.

    A passage is a longest chain of anchors that always come together, at the same distances; it is named by the hash of
    its first one. Any two of its occurrences match with the shift first less first, and these are all that
    shared_anchors finds. Every anchor that is there more than once is in one passage, so the rows are fewer than the
    anchors, however many copies of one there are. ``row`` tells apart rows that share a doc_id.
    """
    rows = materialise(fingerprints(docs, whole=True).where(F.size("places") > 0).withColumn("row", F.monotonically_increasing_id()), "prints")
    none = lambda kind: F.array(F.lit(None).cast(kind))
    before = lambda c, kind: F.concat(none(kind), F.slice(c, 1, F.size(c) - 1)).alias(f"{c}_before")
    after = lambda c, kind: F.concat(F.slice(c, 2, F.size(c)), none(kind)).alias(f"{c}_after")
    kinds = (("places", "int"), ("hashes", "long"))
    near = rows.select("places", "hashes", *(f(*x) for f in (before, after) for x in kinds))
    near = near.select(F.explode(F.arrays_zip(*near.columns)).alias("z")).select(
        F.col("z.hashes").alias("hash"),
        F.col("z.hashes_before").alias("other"),
        F.when(F.col("z.hashes_before").isNotNull(), F.xxhash64("z.hashes_before", F.col("z.places") - F.col("z.places_before"))).alias("left"),
        F.when(F.col("z.hashes_after").isNotNull(), F.xxhash64("z.hashes_after", F.col("z.places_after") - F.col("z.places"))).alias("right"),
    )
    count = [F.count("*").alias("n"), F.min("other").alias("other")] + [f(c).alias(f"{c}_{k}") for c in ("left", "right") for k, f in (("n", F.count), ("min", F.min), ("max", F.max))]
    one = lambda c: ((F.col(f"{c}_n") == F.col("n")) & (F.col(f"{c}_min") == F.col(f"{c}_max"))).alias(f"one_{c}")
    found = materialise(near.groupBy("hash").agg(*count).where("n > 1").select("hash", "n", "other", one("left"), one("right")), "repeated")
    # an anchor goes on with a passage if it always comes after the same one, and that one always before it
    on = found.where("one_left").select("hash", "other").join(found.where("one_right").select(F.col("hash").alias("other")), "other").select("hash", F.lit(0).alias("starts"))
    found = found.select("hash", "n").join(on, "hash", "left").select("hash", "n", F.coalesce("starts", F.lit(1)).alias("starts"))
    at = rows.select("row", "doc_id", F.explode(F.arrays_zip("places", "hashes")).alias("z")).select("row", "doc_id", F.col("z.places").alias("place"), F.col("z.hashes").alias("hash"))
    at = at.join(found, "hash").withColumn("number", F.sum("starts").over(Window.partitionBy("row").orderBy("place")))
    ends = (F.min_by("hash", "place").alias("passage"), F.min("place").alias("first"), F.max("place").alias("last"), F.count("*").alias("anchors"), F.first("n").alias("occurrences"))
    return at.groupBy("row", "number").agg(F.first("doc_id").alias("doc_id"), *ends).select("doc_id", "passage", "first", "last", "anchors", "occurrences", "row")


def passages_query(spark, sf_dir: str) -> DataFrame:
    """The passages that all documents share, or repeat."""
    return passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def query(spark, sf_dir: str) -> DataFrame:
    """The fingerprints of all documents."""
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def oracle() -> str:
    inner = " + ".join(f"coalesce(lead(c, {j}) OVER w, 0) * {f}" for j, f in enumerate(INNER))
    outer = [" + ".join(f"c[i + {j}] * {f}" for j, f in enumerate(row)) for row in OUTER]
    return f"""
WITH cp AS (
  SELECT doc_id, generate_subscripts(s, 1) - 1 AS place, unicode(unnest(s))::BIGINT AS c
  FROM (SELECT doc_id, string_split(text, '') AS s FROM documents WHERE length(text) >= {K})
), inn AS (
  SELECT doc_id, place, c, ({inner}) % {PRIME} AS h, count(*) OVER (PARTITION BY doc_id) AS n FROM cp WINDOW w AS (PARTITION BY doc_id ORDER BY place)
), win AS (
  SELECT doc_id, place, n, h, min(h) OVER v AS least, lead(h, {K - S}) OVER u AS h_last FROM inn
  WINDOW v AS (PARTITION BY doc_id ORDER BY place ROWS BETWEEN CURRENT ROW AND {K - S} FOLLOWING), u AS (PARTITION BY doc_id ORDER BY place)
), chosen AS (SELECT doc_id, place FROM win WHERE place + {K} <= n AND (h = least OR h_last = least)),
codes AS (SELECT doc_id, list(c ORDER BY place) AS c FROM cp GROUP BY doc_id),
hashed AS (
  SELECT doc_id, place, (({outer[0]}) % {PRIME}) * 2147483648 + ({outer[1]}) % {PRIME} AS h
  FROM (SELECT doc_id, place, place + 1 AS i, c FROM chosen JOIN codes USING (doc_id))
), lists AS (SELECT doc_id, list(place::INTEGER ORDER BY place) AS places, list(h ORDER BY place) AS hashes FROM hashed GROUP BY doc_id)
SELECT doc_id, coalesce(places, []::INTEGER[]) AS places, coalesce(hashes, []::BIGINT[]) AS hashes FROM documents LEFT JOIN lists USING (doc_id)
"""
