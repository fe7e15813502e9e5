"""MinHash near-dedup by a signature-coordinate inverted join.

A document's shingles are its runs of ``WORDS`` lower-cased tokens (all its tokens, if it has fewer); its signature
has ``K`` coordinates, each the least of an independent hash over all shingles. Two documents match if at least
``matches`` coordinates agree. Equal signatures are one group at once and only one of them goes on.

Each signature is posted under its coordinate-value pairs, rarest first: agreement in ``matches`` of K coordinates
means that a pair shares at least MORE of the first K - matches + MORE posted, so only that prefix is posted. Lists
are merged per bucket of coordinate-value pairs; a candidate whose agreements so far and coordinates left can't reach
the threshold is skipped; all coordinates are counted for the rest. No list, partner count or group size is capped.

Groups are the connected components of the matches. So that a large group doesn't need all pairs of its members, they
are found in two rounds: first each list's least member with the others (many of a group meet here), then all pairs
of members that the first round left in different components. Skipped pairs are within one component already.

Edge cases: a document without tokens (null, empty or white space only) has no signature and is never a duplicate.
Documents are named by doc_id, of any type that has an order; where rows share a doc_id (or have none) their text's
hash tells them apart, and rows equal in both are exact copies of each other: ``duplicates`` gives such a name, with
the number of its copies, even where it is the one that is kept. Of a group the row with the least (doc_id, hash of text) stays, a null
doc_id comes last.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _run, _vec
from ._vec import U

WORDS = 3
K = 64
MATCHES = 26
MORE = 5
BUCKETS = 1 << 20

_rng = np.random.default_rng(20)
_FACTORS = (_rng.integers(0, 2**63, K).astype(U) << U(1)) | U(1)
_STEP = U(0x9E3779B97F4A7C15)


def signatures(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows that have a signature, and those signatures (uint32), for lower-cased texts."""
    who, out = [np.zeros(0, np.int64)], [np.zeros((0, K), np.uint32)]
    for at, to in _vec.chunks(column, 1 << 20):
        raw, off = _vec.buffers(column[at:to])
        start, end, row = _vec.tokens(raw, off)
        if not len(start):
            continue
        h = _vec.span_hash(raw, start, end)
        begin = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        size = np.diff(np.r_[begin, len(row)])
        place = np.arange(len(row)) - np.repeat(begin, size)
        left = np.repeat(size, size) - place
        shingle = np.zeros(len(h), U)
        with np.errstate(over="ignore"):
            for i in range(WORDS):
                # beyond the end of a short text nothing is added
                shingle += np.where(left > i, np.r_[h[i:], np.zeros(min(i, len(h)), U)], U(0)) * U(int(_STEP) ** i % 2**64)
            good = (left >= WORDS) | (place == 0)
            shingle = _vec.mix(shingle[good])
            size = np.maximum(1, size - WORDS + 1)
            begin, sig = np.cumsum(size) - size, np.empty((len(size), K), np.uint32)
            for k in range(K):
                sig[:, k] = _vec.mix(np.minimum.reduceat(shingle * _FACTORS[k], begin)).astype(np.uint32)
        who.append(at + row[np.flatnonzero(place == 0)])
        out.append(sig)
    return np.concatenate(who), np.concatenate(out)


def _elements(sig: np.ndarray) -> np.ndarray:
    """A hash of each coordinate-value pair."""
    return _vec.mix((np.arange(K, dtype=U) << U(32)) | sig.astype(U))


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        who, sig = signatures(_vec.texts(batch.column(2), lower=True))
        with np.errstate(over="ignore"):
            mixed = _elements(sig)
            one, two = mixed.sum(1, dtype=U).view(np.int64), _vec.mix(mixed, 5).sum(1, dtype=U).view(np.int64)
        take = pa.array(who)
        yield pa.RecordBatch.from_arrays([*(batch.column(i).take(take) for i in (0, 1)), pa.array(one), pa.array(two), pa.array([x.tobytes() for x in sig], pa.binary())], ["doc", "th", "one", "two", "sig"])


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, K)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        total += np.bincount((_elements(_matrix(batch.column(0))) >> U(44)).ravel().astype(np.int64), minlength=BUCKETS)
    hit = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(hit.astype(np.int32)), pa.array(total[hit])], ["bucket", "n"])


def _posts(rank, matches: int, buckets: int):
    """Blocks of (element, component, name, place in the prefix) by a bucket of the element."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            name, part = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            e = _elements(_matrix(batch.column(2)))
            order = np.argsort((rank.value[(e >> U(44)).astype(np.int64)].astype(U) << U(44)) | (e & U((1 << 44) - 1)), axis=1)[:, : K - matches + MORE]
            e, width = np.take_along_axis(e, order, 1).ravel(), order.shape[1]
            columns = (e, np.repeat(part, width), np.repeat(name, width), np.tile(np.arange(width, dtype=np.uint8), len(name)))
            bucket = (e % U(buckets)).astype(np.int64)
            by = np.argsort(bucket, kind="stable")
            bucket, columns = bucket[by], [x[by] for x in columns]
            at = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            ends = [*at[1:], len(bucket)]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[at].astype(np.int32)), *(pa.array([x[a:b].tobytes() for a, b in zip(at, ends, strict=True)], pa.binary()) for x in columns)], ["bucket", "e", "part", "name", "place"])

    return run


def _merged(stars: bool, block: int = 1 << 20):
    """Pairs of names on the lists of this task, with the later of their places in the prefixes.

    With ``stars`` those of a list's first entry and another, else all pairs of different components.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [tuple(b.column(i).to_pylist() for i in range(1, 5)) for b in batches]
        if not parts:
            return
        e, part, name, place = (np.frombuffer(b"".join(x for p in parts for x in p[i]), kind) for i, kind in enumerate((np.uint64, np.int64, np.int64, np.uint8)))
        order = np.lexsort((name, part, e))
        e, part, name, place = e[order], part[order], name[order], place[order]
        new = np.r_[True, e[1:] != e[:-1]]
        last = np.searchsorted(e, e, "right")
        if stars:
            low, last = np.arange(len(e)) + 1, np.where(new, last, 0)
        else:
            other = np.flatnonzero(np.r_[new[1:] | (part[1:] != part[:-1]), True]) + 1
            low = other[np.searchsorted(other, np.arange(len(e)), "right")]
        count = np.maximum(0, last - low)
        ends, at = np.cumsum(count), 0
        while at < len(e):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + block, "right")))
            size = count[at:to]
            a = np.repeat(np.arange(at, to), size)
            b = np.repeat(low[at:to] - (np.cumsum(size) - size), size) + np.arange(len(a))
            at = to
            if len(a):
                x, y = name[a], name[b]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array(np.maximum(place[a], place[b]).astype(np.int32))], ["a", "b", "place"])

    return run


def _agreeing(matches: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            n = (_matrix(batch.column(2)) == _matrix(batch.column(3))).sum(1).astype(np.int32)
            ok = np.flatnonzero(n >= matches)
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(ok)) for c in batch.columns[:2]), pa.array(n[ok])], ["a", "b", "matches"])

    return run


def named(docs: DataFrame) -> DataFrame:
    """doc (the doc_id), th (hash of the text), text."""
    return docs.select(F.col("doc_id").alias("doc"), F.xxhash64("text").alias("th"), F.col("text").cast("string").alias("text"))


def _row(*more: str) -> Column:
    """What orders rows: doc_id, null last, then the hash of the text."""
    return F.struct(F.col("doc").isNull().alias("none"), "doc", "th", *more)


def signature_groups(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with their group of equal signatures (doc, th, group) and the groups (group, sig, and their first row)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = _run.materialise(named(docs).mapInArrow(_signed, f"doc {kind}, th long, one long, two long, sig binary"), "signatures")
    firsts = rows.groupBy("one", "two").agg(F.min(_row("sig")).alias("first"))
    groups = _run.materialise(firsts.select("one", "two", F.monotonically_increasing_id().alias("group"), "first.doc", "first.th", "first.sig"), "groups")
    return rows.select("doc", "th", "one", "two"), groups


def _rarity(groups: DataFrame):
    counts = groups.select("sig").mapInArrow(_counted, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(BUCKETS, np.int64)
    total[counts["bucket"].to_numpy()] = counts["n"].to_numpy()
    order = np.empty(BUCKETS, np.uint32)
    order[np.argsort(total, kind="stable")] = np.arange(BUCKETS, dtype=np.uint32)
    return groups.sparkSession.sparkContext.broadcast(order)


def matching_pairs(groups: DataFrame, rank, matches: int = MATCHES, stars: bool = False) -> DataFrame:
    """Pairs (a, b) of groups in different parts that agree in at least ``matches`` coordinates, and in how many.

    With ``stars`` only some pairs, a number in proportion to the groups.
    """
    buckets = 4 * int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    posts = groups.select("group", "part", "sig").mapInArrow(_posts(rank, matches, buckets), "bucket int, e binary, part binary, name binary, place binary").repartition("bucket")
    found = posts.mapInArrow(_merged(stars), "a long, b long, place int").groupBy("a", "b").agg(F.count("*").alias("n"), F.max("place").alias("place"))
    # agreements in the prefix, and all coordinates after the later of the last places; stars only see some agreements
    found = found.where(f"n >= {MORE}" if stars else f"n + {K - 1} - place >= {matches}").select("a", "b")
    side = lambda x: groups.select(F.col("group").alias(x), F.col("sig").alias(f"sig_{x}"))
    both = found.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sig_a", "sig_b")
    return _run.materialise(both.mapInArrow(_agreeing(matches), "a long, b long, matches int"), "pairs")


def linked(groups: DataFrame, matches: int = MATCHES) -> DataFrame:
    """name, least: the component of each group that matches another."""
    rank = _rarity(groups)
    some = matching_pairs(groups.withColumn("part", F.lit(0).cast("long")), rank, matches, stars=True)
    parts = components(some).select(F.col("name").alias("group"), "least")
    parted = _run.materialise(groups.join(parts, "group", "left").select("group", F.coalesce("least", "group").alias("part"), "sig"), "parted")
    return components(some.select("a", "b").union(matching_pairs(parted, rank, matches).select("a", "b")))


def components(pairs: DataFrame) -> DataFrame:
    """name, least: the least name in the connected component of each name in pairs (a, b).

    Alternating large-star and small-star steps; each keeps the components, and they end as stars in a number of
    rounds that grows with the logarithm of a component's size.
    """
    edges = _run.materialise(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "edges")
    while True:
        both = edges.union(edges.select("v", "u")).toDF("u", "v")
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u != v").distinct()
        new = _run.materialise(small, "edges")
        # a forest of stars: every u has one v and no v is a u
        many = new.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").select("u").union(new.select("v").distinct().join(new.select(F.col("u").alias("v")), "v", "left_semi"))
        done = many.isEmpty()
        _run.drop(edges)
        edges = new
        if done:
            return edges.select(F.col("u").alias("name"), F.col("v").alias("least"))


def duplicates(docs: DataFrame, matches: int = MATCHES) -> DataFrame:
    """Every row that is not the first of its group: doc, th, and the first row's keep_doc, keep_th.

    Of rows equal in doc_id and text all share a name; such a name is given with copies > 1.
    """
    rows, groups = signature_groups(docs)
    first = _row().alias("first")
    # name the component by its least row, not by its least group
    member = groups.select("one", "two", "group", first).join(linked(groups, matches), F.col("group") == F.col("name"), "left").select("one", "two", F.coalesce("least", "group").alias("least"), "first")
    keep = member.groupBy("least").agg(F.min("first").alias("keep"))
    member = member.join(keep, "least").select("one", "two", "keep")
    found = rows.groupBy("one", "two", "doc", "th").agg(F.count("*").alias("copies")).join(member, ["one", "two"])
    return found.select("doc", "th", "copies", F.col("keep.doc").alias("keep_doc"), F.col("keep.th").alias("keep_th")).where("NOT doc <=> keep_doc OR th != keep_th OR copies > 1")


def one_of_each(docs: DataFrame, matches: int = MATCHES) -> DataFrame:
    """The documents, in their own columns, of which only the first row of each group stays."""
    gone = _run.materialise(duplicates(docs, matches), "duplicates")
    own = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("doc"), F.xxhash64("text").alias("th"))
    gone = gone.select(F.col("doc").alias("own_doc"), F.col("th").alias("own_th"), F.expr("doc <=> keep_doc AND th = keep_th").alias("first"))
    marked = own.join(gone, F.col("doc").eqNullSafe(F.col("own_doc")) & (F.col("th") == F.col("own_th")), "left")
    single = marked.where("first IS NULL").select("row")
    # rows equal in doc_id and text: one of those that are first
    again = marked.where("first").groupBy("doc", "th").agg(F.first("row").alias("row")).select("row")
    return single.union(again).select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    """Every document that is a near copy of another: doc_id, kept_doc_id of the one kept for its group, and which rows these are.

    A row for each name (doc_id, text_hash) with the copies that bear it; if it is the kept one's name, one of these stays.
    A null doc_id comes out as null.
    """
    gone = duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return gone.select(F.col("doc").alias("doc_id"), F.col("keep_doc").alias("kept_doc_id"), F.col("th").alias("text_hash"), F.col("keep_th").alias("kept_text_hash"), "copies")
