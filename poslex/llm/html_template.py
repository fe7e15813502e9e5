"""HTML extraction by template deduction from equivalence classes of tokens.

Pages of one host are taken to share a template. A page is a sequence of tokens: its tags, and the words of its text,
each told apart by the path of open elements it stands under. The occurrence vector of a token holds its count on
each page of the host; tokens with the same vector are an equivalence class. A class is a candidate if its tokens are
on at least ``support`` of the host's pages (and on LEAST_PAGES) and it has at least ``size`` tokens. It is valid if its tokens come in one
order on every page, in whole rounds, and if it nests: each round of it stands within one gap between neighbouring
tokens of any other class, or the other way round. Valid classes make up the template; what stands between its
tokens are the slots, and their texts are extracted.

The steps over all pages: (1) tokens that are on the share of pages in some task's part of a host, which any token
that is on that share of all must be; (2) the sequence of these tokens on each page; counts, classes and their
validity follow from the sequences; (3) extraction. The templates are broadcast if all their tokens are few, and else
joined by host, pages of large hosts under several keys.

Two pages are too few to tell a template's words from words that both texts happen to have, so in extraction a host of
two pages has a template of tags alone: nothing of its text is lost, but navigation comes out, in slots of its own.

Edge cases: a page without a host in its url (null included) belongs to the host ''. A null or empty page, or one
without any words, has no slots. Broken markup is read leniently: unclosed elements end with the one around them,
stray end tags stand for themselves. Comments, and the content of script and style, are left out. Repeated pages
count as often as they are there. A host whose classes are all invalid (or too small) has no template: the whole text
of each page is one slot. So it is for a host of one page.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _run, _vec
from ._vec import U

SUPPORT = 0.5
SIZE = 3
#: A class needs this many pages whatever the share.
LEAST_PAGES = 3
#: For hosts of this many pages, extraction takes classes of tags that are on all of them.
FEW_PAGES = 2
#: A table with more tokens than these (8 bytes each) is joined without a broadcast.
BROADCAST_TOKENS = 2_000_000
#: There, hosts with more than one of so many pages (so fewer hosts than that) have their pages spread over SALTS keys.
HOT = 1000
SALTS = 64

_TAG = re.compile(rb"<!--.*?(?:-->|\Z)|<!(?:[^<>]*)>|<(script|style)\b[^<>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-z][\w:-]*)[^<>]*>", re.S | re.I)
_VOID = frozenset((b"area", b"base", b"br", b"col", b"embed", b"hr", b"img", b"input", b"link", b"meta", b"source", b"track", b"wbr"))
_hash = xxhash.xxh64_intdigest
_ALONE = frozenset((b"p", b"li", b"tr", b"td", b"th", b"option", b"dt", b"dd"))
_BLOCK = re.compile(r"</?(?:p|div|li|ul|ol|h[1-6]|tr|table|section|article|header|footer|nav|title|blockquote|pre|dt|dd)\b[^<>]*>|<br\b[^<>]*>", re.I)
_ANY = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style)\b[^<>]*>.*?(?:</\1\s*>|\Z)|<!?/?[a-zA-Z][^<>]*>", re.S | re.I)


def _tags(raw: bytes, paths: dict[int, str], begin: list[int], end: list[int], token: list[int], path: list[int], base: int) -> None:
    """Appends the begin, end and token of each tag of one page, and the path that holds after it."""
    stack: list[tuple[bytes, int]] = [(b"", 0)]
    paths.setdefault(0, "")
    for m in _TAG.finditer(raw):
        name, own = m[3], 0
        if name is None:
            if m[1] is not None:
                own = _hash(m[1].lower(), stack[-1][1])
        else:
            name = name.lower()
            if m[2]:
                at = len(stack) - 1
                while at and stack[at][0] != name:
                    at -= 1
                if at:
                    own = _hash(b"/", stack[at][1])
                    del stack[at:]
                else:
                    own = _hash(b"/" + name, stack[-1][1])
            else:
                if name in _ALONE and stack[-1][0] == name:
                    stack.pop()
                parent = stack[-1][1]
                own = _hash(name, parent)
                if name not in _VOID and raw[m.end() - 2] != 47:
                    stack.append((name, own))
                    if own not in paths:
                        paths[own] = (paths[parent] + "/" if parent else "") + name.decode("ascii", "replace")
        a, b = m.span()
        begin.append(base + a)
        end.append(base + b)
        token.append(own)
        path.append(stack[-1][1])


def sequence(column: pa.Array, paths: dict[int, str]) -> tuple[np.ndarray, ...]:
    """Page, begin, end, token, path and whether it is a word, of every token of the pages, in order. Tokens of tags are even, of words odd."""
    raw, off = _vec.buffers(column)
    data = raw.tobytes()
    begin, end, token, path = [], [], [], []
    for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
        _tags(data[a:b], paths, begin, end, token, path, a)
    begin, end = np.array(begin, np.int64), np.array(end, np.int64)
    token, path = np.array(token, U), np.array(path, U)
    cover = np.zeros(len(raw) + 1, np.int8)
    np.add.at(cover, begin, 1)
    np.subtract.at(cover, end, 1)
    blank = np.where(np.cumsum(cover[:-1]) > 0, np.uint8(32), raw)
    w_begin, w_end, w_page = _vec.tokens(blank, off)
    tag = np.searchsorted(begin, w_begin, "right") - 1
    page = np.searchsorted(off, begin, "right") - 1
    near = (tag >= 0) & (page[np.maximum(tag, 0)] == w_page) if len(begin) else np.zeros(len(w_begin), np.bool_)
    w_path = np.where(near, path[np.maximum(tag, 0)], U(0)) if len(begin) else np.zeros(len(w_begin), U)
    w_token = _vec.mix(_vec.span_hash(blank, w_begin, w_end) ^ w_path)
    real = token != 0
    out = [np.concatenate(x) for x in ((page[real], w_page), (begin[real], w_begin), (end[real], w_end), (token[real] & ~U(1), w_token | U(1)), (path[real], w_path))]
    word = np.r_[np.zeros(int(real.sum()), np.bool_), np.ones(len(w_begin), np.bool_)]
    order = np.argsort(out[1], kind="stable")
    return (*(x[order] for x in out), word[order])


def _named(owner: np.ndarray, token: np.ndarray) -> np.ndarray:
    """One 64-bit name for each pair of an owner's number and a token."""
    return _vec.mix(token) + owner.astype(U) * U(0x9E3779B97F4A7C15)


def _distinct(page: np.ndarray, token: np.ndarray) -> np.ndarray:
    """The places of the first of equal tokens on a page, in no order."""
    name = _named(page, token)
    order = np.argsort(name)
    name = name[order]
    return order[np.r_[True, name[1:] != name[:-1]]] if len(name) else order


def _candidates(support: float):
    """host, token, n: tokens on the share of the host's pages that this task has; a row without a token has the number of these pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hosts: dict[str, int] = {}
        pages, seen = [], []
        for batch in batches:
            number = np.array([hosts.setdefault(h, len(hosts)) for h in batch.column(0).to_pylist()], np.int64)
            pages.append(number)
            column = _vec.texts(batch.column(1))
            for at, to in _vec.chunks(column):
                page, _, _, token, _, _ = sequence(column[at:to], {})
                first = _distinct(page, token)
                seen.append((number[at:to][page[first]], token[first]))
        if not hosts or not seen:
            return
        total = np.bincount(np.concatenate(pages), minlength=len(hosts))
        host, token = (np.concatenate(x) for x in zip(*seen, strict=True))
        _, first, count = np.unique(_named(host, token), return_index=True, return_counts=True)
        host, token = host[first], token[first]
        ok = count >= support * total[host]
        names = pa.array(list(hosts)).take(pa.array(host[ok]))
        yield pa.RecordBatch.from_arrays([names, pa.array(token[ok].view(np.int64)), pa.nulls(len(names), pa.int64())], ["host", "token", "n"])
        yield pa.RecordBatch.from_arrays([pa.array(list(hosts)), pa.nulls(len(hosts), pa.int64()), pa.array(total)], ["host", "token", "n"])

    return run


def _member(page: np.ndarray, token: np.ndarray, wanted: list[np.ndarray]) -> np.ndarray:
    """Whether each token is among its page's wanted ones."""
    sizes = np.array([len(x) for x in wanted])
    if not len(token) or not sizes.sum():
        return np.zeros(len(token), np.bool_)
    key = np.sort(_named(np.repeat(np.arange(len(wanted)), sizes), np.concatenate(wanted).view(U)))
    own = _named(page, token)
    return key[np.minimum(np.searchsorted(key, own), len(key) - 1)] == own


def _sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """host, page and the candidates on it in order."""
    for batch in batches:
        column, lists = _vec.texts(batch.column(2)), batch.column(3)
        for at, to in _vec.chunks(column):
            page, _, _, token, _, _ = sequence(column[at:to], {})
            wanted = [x.values.to_numpy() if x.is_valid else np.zeros(0, np.int64) for x in lists[at:to]]
            hit = _member(page, token, wanted)
            ends = np.searchsorted(page[hit], np.arange(to - at + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0)[at:to], batch.column(1)[at:to], pa.ListArray.from_arrays(pa.array(ends), pa.array(token[hit].view(np.int64)))], ["host", "page", "tokens"])


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """host, token, pages, and the fingerprint of the occurrence vector in two halves: this task's share of the sums."""
    total: dict[tuple[str, int], list[int]] = defaultdict(lambda: [0, 0, 0])
    for batch in batches:
        hosts, keys = batch.column(0).to_pylist(), batch.column(1).to_numpy(zero_copy_only=False)
        for host, key, tokens in zip(hosts, keys, batch.column(2), strict=True):
            each, count = np.unique(tokens.values.to_numpy(), return_counts=True)
            parts = _vec.mix(_vec.mix(np.full(1, key, np.int64).view(U)) + count.astype(U), 9)
            for t, p in zip(each.tolist(), parts.tolist(), strict=True):
                have = total[host, t]
                have[0] += 1
                have[1] += p >> 32
                have[2] += p & 0xFFFFFFFF
    if total:
        sums = np.array(list(total.values()), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in total]), pa.array([k[1] for k in total], pa.int64()), *(pa.array(sums[:, i]) for i in range(3))], ["host", "token", "pages", "high", "low"])


def check_page(tokens: np.ndarray, classes: dict[int, np.ndarray]) -> tuple[dict[int, tuple], set[tuple[int, int]]]:
    """Of each class on the page the order of its tokens (() if it isn't in whole rounds of one order); pairs that don't nest."""
    orders, places = {}, {}
    for name, own in classes.items():
        at = np.flatnonzero(np.isin(tokens, own))
        if not len(at):
            continue
        n = len(own)
        rounds = tokens[at].reshape(-1, n) if len(at) % n == 0 else None
        if rounds is None or (rounds != rounds[0]).any() or len(np.unique(rounds[0])) != n:
            orders[name] = ()
            continue
        orders[name], places[name] = tuple(rounds[0].tolist()), at.reshape(-1, n)

    def within(a: np.ndarray, b: np.ndarray) -> bool:
        """Every round of a stands in one gap of b."""
        flat = b.ravel()
        return bool((np.searchsorted(flat, a[:, 0]) == np.searchsorted(flat, a[:, -1])).all())

    names = sorted(places)
    bad = {(x, y) for i, x in enumerate(names) for y in names[i + 1 :] if not within(places[x], places[y]) and not within(places[y], places[x])}
    return orders, bad


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """host, class, other, order: orders found (other is null), and classes that cross."""
    found: set[tuple] = set()
    known: dict[str, dict[int, np.ndarray]] = {}
    for batch in batches:
        for host, tokens, classes in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
            if host not in known:
                if len(known) > 1000:
                    known.clear()
                known[host] = {c["print"]: np.array(c["tokens"], np.int64) for c in classes.as_py()}
            orders, bad = check_page(tokens.values.to_numpy(), known[host])
            found |= {(host, k, None, v) for k, v in orders.items()} | {(host, a, b, None) for a, b in bad}
    rows = list(found)
    yield pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), pa.array([None if r[3] is None else list(r[3]) for r in rows], pa.list_(pa.int64()))],
        ["host", "print", "other", "order"],
    )


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    paths: dict[int, str] = {}
    for batch in batches:
        column, lists = _vec.texts(batch.column(2)), batch.column(3)
        for at, to in _vec.chunks(column):
            part = column[at:to]
            raw, off = _vec.buffers(part)
            page, begin, end, token, path, word = sequence(part, paths)
            if len(paths) > 100_000:
                paths = {}
            hit = _member(page, token, [x.values.to_numpy() if x.is_valid else np.zeros(0, np.int64) for x in lists[at:to]])
            # words that aren't of the template; a slot ends with a template token or with the page
            free = np.flatnonzero(word & ~hit)
            if not len(free):
                continue
            group = np.cumsum(hit)[free]
            first = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]) | (page[free][1:] != page[free][:-1])])
            last = np.r_[first[1:], len(free)] - 1
            data, own = raw.tobytes(), page[free[first]]
            texts = [_clean(data[a:b]) for a, b in zip(begin[free[first]].tolist(), end[free[last]].tolist(), strict=True)]
            order = np.arange(len(first)) - np.searchsorted(own, own)
            names = [paths.get(p, "") for p in path[free[first]].tolist()]
            take = pa.array(at + own)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(order.astype(np.int32)), pa.array(names, pa.string()), pa.array(texts, pa.string())], ["page_id", "host", "slot", "path", "text"])


def _clean(raw: bytes) -> str:
    text = raw.decode("utf-8", "replace")
    if "<" in text:
        text = _ANY.sub(" ", _BLOCK.sub("\n", text))
        text = re.sub(r"[ \t]*\n\s*", "\n", text)
    return html.unescape(re.sub(r"[ \t\r\f\v]+", " ", text)).strip()


def with_host(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), "^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return pages.select("page_id", host.alias("host"), F.xxhash64("page_id", "url", "html").alias("page"), F.col("html").cast("string").alias("html"))


def _joined(pages: DataFrame, table: DataFrame, tokens: Column) -> DataFrame:
    """The pages with their host's row of the table, null where there is none. ``tokens``: how many a row of the table holds."""
    if (table.agg(F.sum(tokens)).first()[0] or 0) <= BROADCAST_TOKENS:
        return pages.join(F.broadcast(table), "host", "left")
    counts = pages.groupBy("host").agg(F.count("*").alias("n"))
    hot = counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("all")))).where(f"n * {HOT} > all").select("host", F.lit(True).alias("hot"))
    salt = F.when(F.col("hot"), F.monotonically_increasing_id() % SALTS).otherwise(0)
    salts = F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))
    spread = pages.join(F.broadcast(hot), "host", "left").withColumn("salt", salt.cast("int")).drop("hot")
    return spread.join(table.join(F.broadcast(hot), "host", "left").withColumn("salt", salts).drop("hot"), ["host", "salt"], "left").drop("salt")


def classes(pages: DataFrame, support: float = SUPPORT, size: int = SIZE, few: int = 0) -> DataFrame:
    """host, print, pages, tokens (in their order): the valid equivalence classes of each host.

    Those of hosts with ``few`` pages are of tags only, and need no more pages than these.
    """
    found = pages.select("host", "html").mapInArrow(_candidates(support), "host string, token long, n long")
    found = found.groupBy("host").agg(F.collect_set("token").alias("wanted"), F.sum("n").alias("n"))
    found = found.select("host", F.when(F.col("n") == few, F.filter("wanted", lambda x: x % 2 == 0)).otherwise(F.col("wanted")).alias("wanted"))
    found = _run.materialise(found.where(F.size("wanted") > 0), "candidates")
    seq = _joined(pages.select("host", "page", "html"), found, F.size("wanted")).select("host", "page", "html", "wanted").mapInArrow(_sequences, "host string, page long, tokens array<long>")
    seq = _run.materialise(seq, "sequences")
    all_pages = seq.groupBy("host").agg(F.count("*").alias("n"))
    vectors = seq.mapInArrow(_vectors, "host string, token long, pages long, high long, low long").groupBy("host", "token").agg(*(F.sum(c).alias(c) for c in ("pages", "high", "low")))
    groups = vectors.groupBy("host", "pages", "high", "low").agg(F.collect_list("token").alias("tokens")).where(F.size("tokens") >= size)
    groups = groups.join(all_pages, "host").where((F.col("pages") >= F.col("n") * support) & (F.col("pages") >= F.when(F.col("n") == few, few).otherwise(LEAST_PAGES)))
    groups = _run.materialise(groups.select("host", F.xxhash64("pages", "high", "low").alias("print"), "pages", "tokens"), "classes")
    by_host = groups.groupBy("host").agg(F.collect_list(F.struct("print", "tokens")).alias("classes"))
    told = _joined(seq.select("host", "tokens"), by_host, F.size(F.flatten("classes.tokens"))).where("classes IS NOT NULL").select("host", "tokens", "classes")
    told = _run.materialise(told.mapInArrow(_checked, "host string, print long, other long, order array<long>").distinct(), "checked")
    orders = told.where("other IS NULL").groupBy("host", "print").agg(F.count("*").alias("k"), F.first("order").alias("order")).where("k = 1 AND size(order) > 0")
    valid = orders.join(groups, ["host", "print"]).select("host", "print", "pages", F.col("order").alias("tokens"), F.struct((F.size("order") * F.col("pages")).alias("weight"), "print").alias("w"))
    # of two classes that cross the lighter one goes
    cross = told.where("other IS NOT NULL").select("host", F.explode(F.array(F.struct(F.col("print").alias("x"), F.col("other").alias("y")), F.struct(F.col("other").alias("x"), F.col("print").alias("y")))).alias("z")).select("host", "z.*")
    weights = valid.select("host", "print", "w")
    lighter = cross.join(weights.toDF("host", "x", "w_x"), ["host", "x"]).join(weights.toDF("host", "y", "w_y"), ["host", "y"]).where("w_x < w_y")
    return valid.drop("w").join(lighter.select("host", F.col("x").alias("print")).distinct(), ["host", "print"], "left_anti")


def extract(pages: DataFrame, support: float = SUPPORT, size: int = SIZE) -> DataFrame:
    """page_id, host, slot (its number on the page), path and text of every slot."""
    page_type = dict(pages.dtypes)["page_id"]
    rows = with_host(pages)
    template = classes(rows, support, size, FEW_PAGES).groupBy("host").agg(F.flatten(F.collect_list("tokens")).alias("wanted"))
    template = _run.materialise(template, "templates")
    out = _joined(rows.select("page_id", "host", "html"), template, F.size("wanted")).select("page_id", "host", "html", "wanted")
    return out.mapInArrow(_extracted, f"page_id {page_type}, host string, slot int, path string, text string")


def query(spark, sf_dir: str) -> DataFrame:
    """The slots of all pages."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
