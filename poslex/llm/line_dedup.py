"""Line dedup: exact set-similarity join of lines.

A line is a text between line feeds; its set is that of its lower-cased tokens (see ``_vec``; token identity is a
48-bit hash, a set's identity over 100 bits). A line is removed if an *earlier* line has a set with Jaccard
similarity of at least the threshold, whether or not that line is itself removed. Lines are ordered by (doc_id, line
number); a null doc_id comes last (as does 2**63 - 1, which is read alike); documents that share a doc_id are ordered by
a hash of their text. Ids that aren't integers are numbered in their order first.

Method: count tokens over all lines into a table of fixed size, order each line's tokens by rarity, post the prefix
of each distinct set, pair postings of a token under length, positional and bitmap filters, and verify on whole sets.
Equal sets meet by their identity and only their first line is posted. A line needs one match only, so n near copies of
a line don't come out as their n * n / 2 pairs: from each token's postings a line gets the earlier one whose bitmap is nearest,
and only lines with further candidates that none of these matches are paired with all of them. Records travel through a shuffle as column
blocks, one for each task and bucket; a task holds the blocks of one bucket in memory, and there are buckets in proportion to the tokens. The whole sets of lines in
candidate pairs are read from the texts: up to MOST_NAMES lines by a broadcast bitmap of their names that is sized by
their count, so that few others are read with them, beyond that by joins on names and on documents.

Edge cases: a line without tokens is never removed and never a match. A null text comes out null, an empty one empty.
Rows equal in doc_id and text are one document to the order and come out alike. A document that loses all lines comes
out with an empty text and ``n_removed`` > 0. Columns other than doc_id and text are carried along untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators._numbering import numbered
from . import _run, _vec
from ._vec import U

BUCKETS = 1 << 20
#: Tokens of the input to a bucket of lines or of postings, the blocks of which one task holds in memory.
BUCKET_TOKENS = 1 << 22
#: Lines in candidate pairs up to which a bitmap is broadcast: SPARSE bits for each, 16 MiB at most.
MOST_NAMES = 1 << 22
SPARSE = 32
#: Bits of a bitmap of lines that are left open or of their tokens; where it is too small, more is paired, never less.
MOST_BITS = 1 << 27
#: Size from which sets are posted with a bitmap of 256 bits; one of 64 bits tells nothing of large sets.
WIDE = 100
_GROUP = 1 << 15

ORACLE = """
WITH lines AS (
  SELECT doc_id, i - 1 AS line, list_distinct(list_filter(string_split_regex(lower(l), '[\\t-\\r ]+'), lambda x: x <> '')) AS s
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)
), sets AS (
  SELECT list_sort(s) AS s, min((doc_id, line)) AS f, count(*) AS c, row_number() OVER (ORDER BY min((doc_id, line))) AS id
  FROM lines WHERE len(s) > 0 GROUP BY list_sort(s)
), tok AS (SELECT id, len(s) AS n, unnest(s) AS w FROM sets),
frq AS (SELECT w, count(*) AS c FROM tok GROUP BY w),
ranked AS (
  SELECT id, n, w, row_number() OVER (PARTITION BY id ORDER BY c, w) AS r FROM tok JOIN frq USING (w)
), pre AS (SELECT id, n, w FROM ranked WHERE r <= n - ceil({p} * n / 100.0) + 1),
cand AS (
  SELECT DISTINCT a.id AS a, b.id AS b FROM pre a JOIN pre b ON a.w = b.w AND a.id < b.id
  AND 100 * least(a.n, b.n) >= {p} * greatest(a.n, b.n)
), bad AS (
  SELECT DISTINCT y.id FROM cand JOIN sets x ON x.id = a JOIN sets y ON y.id = b
  WHERE (100 + {p}) * len(list_intersect(x.s, y.s)) >= {p} * (len(x.s) + len(y.s))
), gone AS (
  SELECT l.doc_id, l.line FROM lines l JOIN sets ON sets.s = list_sort(l.s) LEFT JOIN bad ON bad.id = sets.id
  WHERE bad.id IS NOT NULL OR (l.doc_id, l.line) <> sets.f
), per AS (SELECT doc_id, list(line) AS g FROM gone GROUP BY doc_id)
SELECT doc_id,
  CASE WHEN g IS NULL THEN text ELSE array_to_string(list_filter(string_split(text, chr(10)), lambda x, i: NOT list_contains(g, i - 1)), chr(10)) END AS text,
  coalesce(len(g), 0)::BIGINT AS n_removed
FROM documents LEFT JOIN per USING (doc_id)
"""


def _lines(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each chunk: its first row, the bytes, the offsets of its lines, and the row of each line."""
    for at, to in _vec.chunks(column):
        raw, off = _vec.buffers(column[at:to])
        feeds = np.flatnonzero(raw == 10) + 1
        inner = feeds[~np.isin(feeds, off)] if len(feeds) else feeds
        line_off = np.sort(np.concatenate([off, inner]))
        yield at, raw, line_off, off


def _sets(raw: np.ndarray, line_off: np.ndarray, rank: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Lines with tokens: index, start in the token array, size; and the tokens, distinct and by rarity within a line."""
    start, end, line = _vec.tokens(raw, line_off)
    if not len(start):
        return
    h = _vec.span_hash(raw, start, end)
    new = np.r_[True, line[1:] != line[:-1]]
    dense, index = np.cumsum(new) - 1, line[new]
    for low in range(0, len(index), _GROUP):
        a, b = np.searchsorted(dense, [low, low + _GROUP])
        key = ((dense[a:b] - low).astype(U) << U(48)) | (rank[(h[a:b] >> U(44)).astype(np.int64)].astype(U) << U(28)) | (h[a:b] & U((1 << 28) - 1))
        key.sort()
        key = key[np.r_[True, key[1:] != key[:-1]]]
        row = (key >> U(48)).astype(np.int64)
        begin = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        size = np.diff(np.r_[begin, len(key)])
        yield index[low : low + _GROUP], begin, size, _vec.mix(key & U((1 << 48) - 1))


def _identity(begin: np.ndarray, tok: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A sum that identifies the set, and its bitmap: bit b is set if an odd number of tokens fall on b."""
    with np.errstate(over="ignore"):
        ident = np.add.reduceat(_vec.mix(tok, 1), begin)
    return ident.view(np.int64), np.bitwise_xor.reduceat(U(1) << (tok >> U(58)), begin).view(np.int64)


def _words(begin: np.ndarray, tok: np.ndarray, words: range) -> list[np.ndarray]:
    """The given ones of the 4 words of a bitmap of 256 bits; all 4 together, by exclusive or, are that of 64 bits."""
    bit, word = U(1) << (tok >> U(58)), (tok >> U(56)) & U(3)
    return [np.bitwise_xor.reduceat(np.where(word == w, bit, U(0)), begin).view(np.int64) for w in words]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        column = _vec.texts(batch.column(0), lower=True)
        for at, to in _vec.chunks(column):
            raw, off = _vec.buffers(column[at:to])
            start, end, _ = _vec.tokens(raw, off)
            total += np.bincount((_vec.span_hash(raw, start, end) >> U(44)).astype(np.int64), minlength=BUCKETS)
    hit = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(hit.astype(np.int32)), pa.array(total[hit])], ["bucket", "n"])


def _ranks(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Rank of each bucket by count, over all texts, as large for any input; and the number of tokens."""
    counts = docs.select("text").mapInArrow(_counted, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(BUCKETS, np.int64)
    total[counts["bucket"].to_numpy()] = counts["n"].to_numpy()
    rank = np.empty(BUCKETS, np.uint32)
    rank[np.argsort(total, kind="stable")] = np.arange(BUCKETS, dtype=np.uint32)
    return rank, int(total.sum())


def _blob(*columns: np.ndarray) -> bytes:
    return b"".join(np.ascontiguousarray(c).tobytes() for c in columns)


def _columns(blobs: list[bytes], kinds: str) -> list[np.ndarray]:
    """The columns of blocks that _blob made, each as long as the others, put together."""
    width, parts = sum(np.dtype(k).itemsize for k in kinds.split()), [[] for _ in kinds.split()]
    for blob in blobs:
        n, at = len(blob) // width, 0
        for part, kind in zip(parts, kinds.split(), strict=True):
            part.append(np.frombuffer(blob, kind, n, at))
            at += n * np.dtype(kind).itemsize
    return [np.concatenate(x) if x else np.zeros(0, k) for x, k in zip(parts, kinds.split(), strict=True)]


def _kept(n: np.ndarray, percent: int) -> np.ndarray:
    """Size of the prefix of a set of n tokens."""
    return n - (percent * n + 99) // 100 + 1


def _place(doc: np.ndarray, th: np.ndarray, line: np.ndarray) -> np.ndarray:
    """A 64-bit name of a line, from where it is."""
    with np.errstate(over="ignore"):
        return _vec.mix(_vec.mix(doc.view(U) ^ (th.view(U) * U(0x9E3779B97F4A7C15)), 2) + line.astype(U), 3)


def _blocks(bucket: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    order = np.argsort(bucket, kind="stable")
    columns, bucket = [c[order] for c in columns], bucket[order]
    at = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else []
    for a, b in zip(at, [*at[1:], len(bucket)], strict=True):
        yield int(bucket[a]), [c[a:b] for c in columns]


_LINE = "i8 i8 i8 i8 i4 i4"
_FIRST = "i8 i8 i4 u8 u4"
_POST = "u8 u8 u4 u4 u4 i8"
_WORDS = "u8 u8 u8"


def _prefixes(rank, percent: int, buckets: int):
    """Blocks of lines with tokens, by a bucket of their sets' identity: _LINE columns, the prefixes behind one another, words of wide bitmaps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, th = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            column, rows = _vec.texts(batch.column(2), lower=True), []
            for at, raw, line_off, off in _lines(column):
                first_line = np.searchsorted(line_off, off, "right") - 1
                for index, begin, size, tok in _sets(raw, line_off, rank.value):
                    row = np.searchsorted(off, line_off[index], "right") - 1
                    ident, bits = _identity(begin, tok)
                    spot = np.arange(len(tok)) - np.repeat(begin, size)
                    keep = _kept(size, percent)
                    rows.append((ident, bits, doc[at + row], th[at + row], (index - first_line[row]).astype(np.int32), size.astype(np.int32), (tok[spot < np.repeat(keep, size)] & U(0xFFFFFFFF)).astype(np.uint32), np.stack(_words(begin, tok, range(1, 4)), 1)[size >= WIDE]))
            if not rows:
                continue
            *fixed, prefix, wide = (np.concatenate(x) for x in zip(*rows, strict=True))
            keep = _kept(fixed[5].astype(np.int64), percent)
            start = np.cumsum(keep) - keep
            out = [(b, _blob(*c), _blob(_ragged(prefix, start[i], keep[i])), _blob(*_wide_of(wide, fixed[5], i))) for b, (i, *c) in _blocks((fixed[0].view(U) % U(buckets)).astype(np.int64), np.arange(len(keep)), *fixed)]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), *(pa.array([x[k] for x in out], pa.binary()) for k in (1, 2, 3))], ["bucket", "fixed", "prefix", "wide"])

    return run


def _wide_of(wide: np.ndarray, n: np.ndarray, which: np.ndarray) -> list[np.ndarray]:
    """Columns of the rows of ``wide``, which only sets of n >= WIDE tokens have, for those of ``which``."""
    large = n >= WIDE
    return list(wide[(np.cumsum(large) - 1)[which[large[which]]]].T)


def _ragged(values: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """values[s : s + n] for each start and size, behind one another."""
    return values[np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]


def _firsts(percent: int):
    """Of each set its first line, with the prefix (kind 0), and the places of the others (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fixed, prefix, wide = [], [], []
        for batch in batches:
            fixed += batch.column(1).to_pylist()
            prefix += batch.column(2).to_pylist()
            wide += batch.column(3).to_pylist()
        if not fixed:
            return
        ident, bits, doc, th, line, n = _columns(fixed, _LINE)
        values = _columns(prefix, "u4")[0]
        keep = _kept(n.astype(np.int64), percent)
        start = np.cumsum(keep) - keep
        sizes, words = n, np.stack(_columns(wide, _WORDS), 1)
        del fixed, prefix, wide
        order = np.lexsort((line, th, doc, n, bits, ident))
        ident, bits, doc, th, line, n = (x[order] for x in (ident, bits, doc, th, line, n))
        head = np.r_[True, (ident[1:] != ident[:-1]) | (bits[1:] != bits[:-1]) | (n[1:] != n[:-1])]
        own = np.flatnonzero(head)[np.cumsum(head) - 1]
        dup = (doc != doc[own]) | (th != th[own]) | (line != line[own])
        h = np.flatnonzero(head)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([0, 1], pa.int32()),
                pa.array([_blob(doc[h], th[h], line[h], bits[h], n[h]), _blob(doc[dup], th[dup], line[dup])], pa.binary()),
                pa.array([_blob(_ragged(values, start[order[h]], keep[order[h]])), b""], pa.binary()),
                pa.array([_blob(*_wide_of(words, sizes, order[h])), b""], pa.binary()),
            ],
            ["kind", "fixed", "prefix", "wide"],
        )

    return run


def _posts(percent: int, buckets: int, tokens=None):
    """Blocks of postings, by a bucket of their token; ``tokens``: only of those that this bitmap has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for fixed, prefix, wide in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                doc, th, line, bits, n = _columns([fixed], _FIRST)
                words = np.stack(_columns([wide], _WORDS), 1)
                name = _place(doc, th, line)
                token, keep = np.frombuffer(prefix, np.uint32), _kept(n.astype(np.int64), percent)
                rest = (np.repeat(n + (np.cumsum(keep) - keep), keep) - np.arange(len(token))).astype(np.uint32)
                own = np.repeat(np.arange(len(n)), keep)
                if tokens is not None:
                    hit = _has(tokens.value, token.astype(U))
                    token, rest, own = token[hit], rest[hit], own[hit]
                out = [
                    (b, _blob(name[i], bits[i], t, n[i], r, doc[i]), _blob(*_wide_of(words, n, i)))
                    for b, (i, t, r) in _blocks((token % np.uint32(buckets)).astype(np.int64), own, token, rest)
                ]
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), *(pa.array([x[k] for x in out], pa.binary()) for k in (1, 2))], ["bucket", "block", "wide"])

    return run


def _has(bitmap: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Whether the bitmap has the lowest bits of each value."""
    low = value & U(len(bitmap) * 64 - 1)
    return (bitmap[(low >> U(6)).astype(np.int64)] >> (low & U(63)) & U(1)).astype(np.bool_)


def _passing(percent: int, blobs: list[bytes], wide: list[bytes], block: int) -> Iterator[tuple]:
    """First the postings' names and documents, then indices of pairs that share a token and pass the filters, and the share of their tokens, in 1000ths, by which their bitmaps are apart at least."""
    p = percent
    name, bits, token, n, rest, doc = _columns(blobs, _POST)
    words = np.stack(_columns(wide, _WORDS), 1)
    blobs.clear(), wide.clear()  # they would be in memory twice
    key = (token.astype(U) << U(32)) | n
    order = np.argsort(key)
    large = (n >= WIDE)[order]
    at_words = (np.cumsum(n >= WIDE) - 1)[order]
    key, name, bits, doc, n, rest = key[order], name[order], bits[order], doc[order], n[order].astype(np.int64), rest[order].astype(np.int64)
    yield name, doc
    # partners have as many tokens or more; distinct sets of equal size need room for one token apart
    low = np.where((100 + p) * (n - 1) >= 2 * p * n, np.arange(len(n)) + 1, np.searchsorted(key, key, "right"))
    # and no more than the length filter and the place of the token leave
    most = np.maximum(0, np.minimum(100 * n // p, (100 + p) * rest // p - n))
    high = np.searchsorted(key, (key >> U(32) << U(32)) | most.astype(U), "right")
    count = np.maximum(0, high - low)
    ends = np.cumsum(count)
    at = 0
    while at < len(n):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + block, "right")))
        size = count[at:to]
        a = np.repeat(np.arange(at, to), size)
        b = np.repeat(low[at:to] - (np.cumsum(size) - size), size) + np.arange(len(a))
        at = to
        ok = (100 + p) * rest[b] >= p * (n[a] + n[b])
        a, b = a[ok], b[ok]
        both = n[a] + n[b]
        apart = np.bitwise_count(bits[a] ^ bits[b]).astype(np.int64)
        ok = (100 + p) * (both - apart) >= 2 * p * both
        a, b, both, apart = a[ok], b[ok], both[ok], apart[ok]
        i = np.flatnonzero(large[a] & large[b])
        if len(i):
            x, y = words[at_words[a[i]]], words[at_words[b[i]]]
            differ = x ^ y
            first = bits[a[i]] ^ bits[b[i]] ^ differ[:, 0] ^ differ[:, 1] ^ differ[:, 2]
            apart[i] = np.bitwise_count(differ).sum(1, dtype=np.int64) + np.bitwise_count(first)
            ok = (100 + p) * (both - apart) >= 2 * p * both
            a, b, both, apart = a[ok], b[ok], both[ok], apart[ok]
        yield a, b, 1000 * apart // both


def _directed(doc: np.ndarray, a: np.ndarray, b: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs as earlier, later, apart; both ways within a document id."""
    one, two = doc[a] <= doc[b], doc[b] <= doc[a]
    return np.r_[a[one], b[two]], np.r_[b[one], a[two]], np.r_[apart[one], apart[two]]


def _paired(percent: int, lines=None, block: int = 1 << 20):
    """Pairs of sets that share a prefix token and pass the filters; a pair may come more than once.

    Of each token, every line with the earlier one whose bitmap is nearest; and with itself if it is in any pair, where
    ``more`` tells that it has further earlier ones. With ``lines``, a bitmap of names, all pairs with these as the later one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs, wide = [], []
        for batch in batches:
            blobs += batch.column(1).to_pylist()
            wide += batch.column(2).to_pylist()
        if not blobs:
            return
        found = _passing(percent, blobs, wide, block)
        name, doc = next(found)
        if lines is not None:
            open_line = _has(lines.value, name)
            for a, b, apart in found:
                early, late, _ = _directed(doc, a, b, apart)
                ok = open_line[late]
                if ok.any():
                    yield _pairs(name[early[ok]], name[late[ok]])
            return
        none = U(2**64 - 1)
        best, partners, touched = np.full(len(name), none, U), np.zeros(len(name), np.int64), np.zeros(len(name), np.bool_)
        for a, b, apart in found:
            touched[a] = touched[b] = True
            early, late, apart = _directed(doc, a, b, apart)
            # equally near ones by name, so that most tokens choose the same one
            np.minimum.at(best, late, (apart.astype(U) << U(54)) | (name[early] >> U(42) << U(32)) | early.astype(U))
            np.add.at(partners, late, 1)
        late = np.flatnonzero(best != none)
        if touched.any():
            yield _pairs(name[(best[late] & U(0xFFFFFFFF)).astype(np.int64)], name[late])
            yield _pairs(name[touched], name[touched], partners[touched] > 1)

    return run


def _pairs(x: np.ndarray, y: np.ndarray, more: np.ndarray | None = None) -> pa.RecordBatch:
    x, y = x.view(np.int64), y.view(np.int64)
    pair = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y), np.zeros(len(x), np.int64) if more is None else more], 1), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1]), pa.array(pair[:, 2] > 0)], ["a", "b", "more"])


def _chosen(rank, choose):
    """The whole sets of the lines that ``choose`` tells of (batch, rows, line numbers, names), with bitmaps of 256 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, th = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            column = _vec.texts(batch.column(2), lower=True)
            for at, raw, line_off, off in _lines(column):
                first_line = np.searchsorted(line_off, off, "right") - 1
                # empty texts at the end of a chunk have no row of their own here, nor any token
                row = np.minimum(np.searchsorted(off, line_off[:-1], "right") - 1, len(off) - 2)
                line = (np.arange(len(row)) - first_line[row]).astype(np.int32)
                name = _place(doc[at + row], th[at + row], line)
                hit = np.flatnonzero(choose(batch, at + row, line, name))
                if not len(hit):
                    continue
                size = line_off[hit + 1] - line_off[hit]
                own = _ragged(raw, line_off[hit], size)
                for index, begin, n, tok in _sets(own, np.r_[0, np.cumsum(size)], rank.value):
                    i, wide = hit[index], _words(begin, tok, range(4))
                    tokens = pa.ListArray.from_arrays(pa.array(np.r_[begin, len(tok)].astype(np.int32)), pa.array(tok.view(np.int64)))
                    columns = (name[i].view(np.int64), n.astype(np.int32), doc[at + row[i]], th[at + row[i]], line[i], *wide)
                    yield pa.RecordBatch.from_arrays([*map(pa.array, columns), tokens], ["name", "n", "doc", "th", "line", "w0", "w1", "w2", "w3", "tokens"])

    return run


def _by_bitmap(marks):
    return lambda batch, row, line, name: _has(marks.value, name)


def _by_list(batch, row, line, name) -> np.ndarray:
    """The lines whose numbers stand in the fourth column."""
    lists = batch.column(3)
    sizes, values = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy()
    own = (np.repeat(np.arange(len(sizes)), sizes).astype(U) << U(32)) | values.astype(U)
    return np.isin((row.astype(U) << U(32)) | line.astype(U), own)


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        doc, th, line, _, _ = _columns(batch.column(0).to_pylist(), _FIRST)
        yield pa.RecordBatch.from_arrays([pa.array(_place(doc, th, line).view(np.int64)), pa.array(doc), pa.array(th), pa.array(line)], ["name", "doc", "th", "line"])


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        doc, th, line = _columns(batch.column(0).to_pylist(), "i8 i8 i4")
        yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(th), pa.array(line)], ["doc", "th", "line"])


def _masks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Line numbers as an array that holds true at each of them."""
    for batch in batches:
        masks = []
        for lines in batch.column(2):
            at = lines.values.to_numpy()
            mask = np.zeros(int(at.max()) + 1, np.bool_)
            mask[at] = True
            masks.append(mask)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(x) for x in batch.column(2)], pa.int64()), pa.array(masks, pa.list_(pa.bool_()))], ["doc", "th", "n_gone", "gone"])


def _bits(n: int, most: int | None = None) -> int:
    """Size of a bitmap of n names."""
    bits = 1 << max(16, (SPARSE * n - 1).bit_length())
    return min(bits, most or bits)


def _marked(ids: DataFrame, bits: int) -> np.ndarray:
    """A bitmap with the lowest bits of the names."""
    low = ids.select(F.col("name").bitwiseAND(F.lit(bits - 1)).alias("h")).select(F.expr("shiftright(h, 6)").cast("int").alias("w"), F.expr("shiftleft(1L, cast(h % 64 as int))").alias("m"))
    found = low.groupBy("w").agg(F.bit_or("m").alias("m")).toArrow()
    bitmap = np.zeros(bits // 64, U)
    bitmap[found["w"].to_numpy()] = found["m"].to_numpy().view(U)
    return bitmap


def _whole(base: DataFrame, sets: DataFrame, pairs: DataFrame, rank, most: int) -> DataFrame:
    """The whole sets of the lines in pairs, and maybe of some others; each name once."""
    names = _run.materialise(pairs.select(F.explode(F.array("a", "b")).alias("name")).distinct(), "names")
    n, schema = names.count(), "name long, n int, doc long, th long, line int, w0 long, w1 long, w2 long, w3 long, tokens array<long>"
    if n <= most:
        marks = base.sparkSession.sparkContext.broadcast(_marked(names, _bits(n)))
        out = base.mapInArrow(_chosen(rank, _by_bitmap(marks)), schema)
    else:
        firsts = sets.where("kind = 0").select("fixed").mapInArrow(_named, "name long, doc long, th long, line int")
        lists = firsts.join(names, "name", "left_semi").groupBy("doc", "th").agg(F.collect_list("line").alias("lines"))
        out = base.join(lists, ["doc", "th"]).select("doc", "th", "text", "lines").mapInArrow(_chosen(rank, _by_list), schema)
    # rows equal in doc_id and text have lines of the same names
    return _run.materialise(out.dropDuplicates(["name"]), "whole")


def _gone(base: DataFrame, percent: int, most: int) -> DataFrame:
    """doc, th, n_gone and a mask of the lines to remove, for each document that has any."""
    spark, p = base.sparkSession, percent
    rank, tokens = _ranks(base)
    # a task holds its bucket in memory, so buckets are as many as the tokens ask for, and aren't put together to fewer
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-tokens // BUCKET_TOKENS))
    rank = spark.sparkContext.broadcast(rank)
    base = base.select("doc", "th", "text")
    blocks = base.mapInArrow(_prefixes(rank, p, buckets), "bucket int, fixed binary, prefix binary, wide binary").repartitionById(buckets, F.col("bucket"))
    sets = _run.materialise(blocks.mapInArrow(_firsts(p), "kind int, fixed binary, prefix binary, wide binary"), "sets")

    def paired(tokens=None, lines=None) -> DataFrame:
        posts = sets.where("kind = 0").select("fixed", "prefix", "wide").mapInArrow(_posts(p, buckets, tokens), "bucket int, block binary, wide binary").repartitionById(buckets, F.col("bucket"))
        return _run.materialise(posts.mapInArrow(_paired(p, lines), "a long, b long, more boolean").distinct(), "pairs")

    pairs = paired()
    whole = _whole(base, sets, pairs, rank, most)

    def side(x: str, *columns: str) -> DataFrame:
        place = F.struct("doc", "th", "line").alias("place")
        return whole.select("name", "n", place, "w0", "w1", "w2", "w3", "tokens").select(F.col("name").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in columns))

    def verified(x: DataFrame) -> DataFrame:
        both = x.join(side("a", "n", "tokens"), "a").join(side("b", "n", "tokens"), "b")
        return both.where(f"{100 + p}L * size(array_intersect(tokens_a, tokens_b)) >= {p}L * (n_a + n_b)").select("b", "late").distinct()

    def matched(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """b and late of the later lines of pairs that match: those that match the nearest candidate, and others."""
        light = ("n", "place", "w0", "w1", "w2", "w3")
        apart = " + ".join(f"bit_count(w{i}_a ^ w{i}_b)" for i in range(4))
        near = pairs.where("a != b").join(side("a", *light), "a").join(side("b", *light), "b").withColumn("apart", F.expr(apart))
        near = near.where(f"place_a != place_b AND {100 + p}L * (n_a + n_b - apart) >= {2 * p}L * (n_a + n_b)")
        swap = F.col("place_a") > F.col("place_b")
        columns = (("a", "b", "a"), ("b", "a", "b"), ("place_a", "place_b", "early"), ("place_b", "place_a", "late"))
        near = _run.materialise(near.select(F.expr("apart / (n_a + n_b)").alias("apart"), *(F.when(swap, F.col(y)).otherwise(F.col(x)).alias(z) for x, y, z in columns)), "near")
        best = near.groupBy("b").agg(F.min(F.struct("apart", "early", "a", "late")).alias("best")).select("b", "best.a", "best.late")
        found = _run.materialise(verified(best), "found")
        more = near.select("a", "b", "late").join(found.select("b"), "b", "left_anti")
        more = _run.materialise(verified(more), "found")
        _run.drop(near)
        return found, more

    made = [sets, pairs, whole, *(bad := [*matched(pairs)])]
    settled = bad[0].union(bad[1]).select(F.col("b").alias("name"))
    left = _run.materialise(pairs.where("a = b AND more").select(F.col("a").alias("name")).join(settled, "name", "left_anti"), "open")
    made.append(left)
    if (n := left.count()) > 0:
        prefix = whole.join(left, "name").select(F.explode(F.expr(f"slice(tokens, 1, n - cast(ceil({p} * n / 100) as int) + 1)")).alias("name"))
        prefix = _run.materialise(prefix.select(F.col("name").bitwiseAND(F.lit(0xFFFFFFFF)).alias("name")).distinct(), "tokens")
        marks = [spark.sparkContext.broadcast(_marked(x, _bits(k, MOST_BITS))) for x, k in ((prefix, prefix.count()), (left, n))]
        again = paired(*marks)
        made += [prefix, again, *(rest := matched(again))]
        bad += rest
    other = sets.where("kind = 1").select("fixed").mapInArrow(_places, "doc long, th long, line int")
    for x in bad:
        other = other.union(x.select("late.*"))
    gone = other.groupBy("doc", "th").agg(F.collect_set("line").alias("lines"))
    gone = _run.materialise(gone.mapInArrow(_masks, "doc long, th long, n_gone long, gone array<boolean>"), "gone")
    _run.drop(*made)
    return gone


def dedup_lines(docs: DataFrame, percent: int = 80, most: int = MOST_NAMES) -> DataFrame:
    """The documents with later matching lines removed: doc_id, text, n_removed, and their other columns in a struct, rest.

    ``percent``: least Jaccard similarity of a match, in percent. ``most``: lines in candidate pairs up to which a bitmap is broadcast.
    """
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.struct(*(F.col(f"`{c}`") for c in rest)).alias("rest") if rest else F.lit(None).cast("string").alias("rest"))
    if isinstance(docs.schema["doc_id"].dataType, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
        rows = rows.withColumn("doc", F.col("doc_id").cast("long"))
    else:
        ids = numbered(docs.select("doc_id").where("doc_id IS NOT NULL").distinct(), ["doc_id"], "doc")
        rows = rows.join(ids, "doc_id", "left")
    base = rows.withColumn("doc", F.coalesce("doc", F.lit(2**63 - 1))).withColumn("th", F.xxhash64("text"))
    out = base.join(_gone(base, percent, most), ["doc", "th"], "left")
    left = F.array_join(F.filter(F.split("text", "\n", -1), lambda _, i: ~F.coalesce(F.get("gone", i), F.lit(False))), "\n")
    return out.select(
        "doc_id", F.when(F.col("gone").isNull(), F.col("text")).otherwise(left).alias("text"),
        F.coalesce("n_gone", F.lit(0)).cast("long").alias("n_removed"), "rest",
    )


def query(spark, sf_dir: str) -> DataFrame:
    """The documents table, line-deduplicated at Jaccard 0.8."""
    return dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).select("doc_id", "text", "n_removed")


def oracle() -> str:
    return ORACLE.format(p=80)
