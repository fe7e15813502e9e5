"""Vertical text: one token a line with tab-separated annotations, structures as tags on lines of their own.

Lines have a global order from the file's path, the block of it and the row in that block, and are numbered where they
are scanned. Everything else is relational: tags are told from tokens by patterns, and end tags meet their starts in
stretches of the text side by side, then what is left over in longer ones. Text itself is never shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import trimmed
from ..operators._numbering import PLACES, numbered, ranged, running_sums
from ..operators._shared import written
from .config import Config

SAME_PLACE = "structure opened multiple times on same position"
NOT_OPEN = "closing non opened structure"
MISMATCH = "mismatched closing structure"
UNTERMINATED = "unterminated structure tags"
#: Messages of each kind that are listed; all are counted.
LISTED = 100


#: A table of segments with more rows is joined without a broadcast.
BROADCAST_SEGMENTS = 1_000_000
_PACKED = (".gz", ".bz2", ".zst", ".lz4", ".snappy", ".deflate")


class Lines:
    """Lines in a global order that is that of file paths, blocks of a file, and rows in a block.

    No line is moved to be numbered: a scan gives the rows of a block one after another, so a row's number is that of
    the rows scanned before it in its task, less those before its block there, plus those of all earlier blocks. What
    is counted for each block is a small table, made by one pass. A filter before the counting column counts what
    passes it, so that tokens and tags get their numbers in the same way. Scans must be split alike each time, so the
    session's least number of splits is fixed when it isn't set, and a split that isn't found is an error.
    """

    def __init__(self, rows: DataFrame, line: str | None = None):
        """``rows``: value, _file, _block (and _size, for text files), straight from a scan; ``line`` names a column with given numbers."""
        spark = rows.sparkSession
        if spark.conf.get("spark.sql.files.minPartitionNum", None) is None:
            spark.conf.set("spark.sql.files.minPartitionNum", str(spark.sparkContext.defaultParallelism))
        self.given = line is not None
        keyed = rows.withColumn("_segment", F.xxhash64("_file", "_block")).withColumn("_m", F.monotonically_increasing_id())
        self.rows = keyed.withColumnRenamed(line, "line") if line else keyed
        if "_size" in rows.columns:
            self._keep_marks()

    @classmethod
    def of_files(cls, spark: SparkSession, path: str) -> Lines:
        """The lines of text files, split at line feeds. Invalid UTF-8 is an error; a byte order mark stays, but in compressed files."""
        raw = spark.read.option("lineSep", "\n").text(path)
        valid = F.when(F.expr("is_valid_utf8(value)"), F.col("value")).otherwise(F.raise_error(F.lit("invalid UTF-8 in vertical text")).cast("string"))
        return cls(raw.select(valid.alias("value"), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.col("_metadata.file_size").alias("_size")))

    @classmethod
    def of_rows(cls, rows: DataFrame, order: list[str], items: Column) -> Lines:
        """The items of all rows, in the order of the rows, which are put in order and written once, before they become lines."""
        kept = _scanned(written(ranged(rows, order), "ordered"))
        return cls(kept.select(F.explode(items).alias("value"), "_file", "_block"))

    @classmethod
    def of_table(cls, lines: DataFrame) -> Lines:
        """The rows of (line, value), which are put in order and written once; their numbers stay."""
        return cls(_scanned(written(ranged(lines.select("line", "value"), ["line"]), "ordered")), "line")

    def _keep_marks(self) -> None:
        """Puts back byte order marks, which the scan drops: files with one have three bytes more than their lines make up."""
        sizes = self.rows.groupBy("_file", "_block").agg(F.sum(F.octet_length("value") + 1).alias("n"), F.min("_m").alias("_first"), F.max("_size").alias("size"))
        sizes = written(sizes, "sizes")
        packed = F.lit(False)
        for end in _PACKED:
            packed = packed | F.col("_file").endswith(end)
        marked = sizes.where(~packed).groupBy("_file").agg(F.sum("n").alias("n"), F.max("size").alias("size"), F.min(F.when(F.col("_block") == 0, F.col("_first"))).alias("_first"))
        # the last line may have no line feed
        marked = written(marked.where("n - size IN (-3, -2)").select("_file", "_first"), "marked")
        many = marked.count()
        if many > BROADCAST_SEGMENTS:
            raise ValueError("too many files with a byte order mark")
        if many:
            first = F.coalesce((F.col("_block") == 0) & (F.col("_m") == F.col("_first")), F.lit(False))
            value = F.when(first, F.concat(F.lit("\ufeff"), F.col("value"))).otherwise(F.col("value"))
            self.rows = self.rows.join(F.broadcast(marked), "_file", "left").withColumn("value", value).drop("_first")

    def segments(self, rows: DataFrame | None = None, clean: Column | None = None, token: Column | None = None) -> DataFrame:
        """_segment, _task; the lines and tokens before it (base_line, base_pos); and of lines, clean lines, tokens and tags those before it in its task."""
        clean, token = (F.lit(True) if c is None else c for c in (clean, token))
        count = lambda c: F.sum(c.cast("long"))
        per = (self.rows if rows is None else rows).groupBy("_segment", "_file", "_block").agg(F.min("_m").alias("first"), F.count("*").alias("lines"), count(clean).alias("clean"), count(clean & token).alias("tokens"))
        per = per.select("*", F.expr(f"first DIV {PLACES}").alias("_task"), (F.col("clean") - F.col("tokens")).alias("tags"))
        earlier = W.partitionBy("_task").orderBy("first").rowsBetween(W.unboundedPreceding, -1)
        per = per.select("_segment", "_file", "_block", "_task", "lines", "tokens", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_off") for c in ("lines", "clean", "tokens", "tags")))
        per = running_sums(per, ["_file", "_block"], {"base_line": F.col("lines"), "base_pos": F.col("tokens")})
        return written(per.drop("_file", "_block", "lines", "tokens"), "segments")

    def placed(self, rows: DataFrame, segments: DataFrame, *columns: Column) -> DataFrame:
        """The columns of rows made of this object's, which may use those of their segment and ``place`` (of one of the counting columns)."""
        small = F.broadcast(segments) if segments.count() <= BROADCAST_SEGMENTS else segments
        joined = rows.join(small, "_segment", "left")
        same = F.when(F.col("_task") == F.expr(f"_m DIV {PLACES}"), F.lit(0)).otherwise(F.raise_error(F.lit("text was split in another way when its lines were counted")).cast("int"))
        line = F.col("line") if self.given else F.col("base_line") + F.col("_m") % PLACES - F.col("lines_off") + 1
        return joined.withColumn("line", line + same).select(*columns)

    def numbered(self) -> DataFrame:
        """line (from 1), value."""
        return self.placed(self.rows, self.segments(), F.col("line"), F.col("value"))


def _scanned(table: DataFrame) -> DataFrame:
    return table.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """line (from 1), value: the lines of text files, in the order of path and place."""
    return Lines.of_files(spark, path).numbered()


def raw_tokens(lines: Lines) -> DataFrame:
    """pos, value: every line is a token as it stands, but for its line end; tags and blank lines too."""
    return lines.numbered().select((F.col("line") - 1).alias("pos"), F.regexp_replace("value", "\\r$", "").alias("value"))


#: Of a trimmed line: whether it is read at all.
READ = "value != '' AND NOT startswith(value, '#')"


def clean(lines: DataFrame) -> DataFrame:
    """Lines without white space at their ends; blank and # lines go."""
    return settled(lines.select("line", trimmed(F.col("value")).alias("value"))).where(READ)


def settled(rows: DataFrame) -> DataFrame:
    """The rows, each column of which is worked out once.

    Spark moves a filter below the columns that it names and works these out anew in it, once for each mention; it moves none below a counter.
    """
    return rows.withColumn("_once", F.monotonically_increasing_id()).where("_once >= 0").drop("_once")


_BLANK = "\\s\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"


def _bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """What ``then`` makes of a value that is worked out once, however often it is used."""
    return F.transform(F.array(value), then)[0]


def _read_tag(inner: Column) -> Column:
    """kind, name and rest of what stands between < and >."""
    end, own_end = inner.startswith("/"), inner.endswith("/")
    body = F.when(end, trimmed(F.substring(inner, F.lit(2), F.length(inner)))).when(own_end, trimmed(F.substring(inner, F.lit(1), F.length(inner) - 1))).otherwise(inner)

    def named(body: Column, name: Column) -> Column:
        kind = F.when(name.isNull(), F.lit(None)).when(end, "end").when(own_end, "empty").otherwise("start")
        rest = F.when(~end, trimmed(F.substring(body, F.length(name) + 1, F.length(body))))
        return F.struct(kind.alias("kind"), name.alias("name"), rest.alias("rest"))

    return _bound(body, lambda b: _bound(F.when(b != "", F.regexp_extract(b, f"^[^{_BLANK}]+", 0)), lambda name: named(b, name)))


def tags(lines: DataFrame) -> DataFrame:
    """The lines with kind ('start', 'end', 'empty', or null for none), name and rest (the text of the attributes)."""
    value = F.col("value")
    inner = trimmed(F.expr("substring(value, 2, length(value) - 2)"))
    out = lines.withColumn("_tag", F.when(value.startswith("<") & value.endswith(">") & (F.length("value") >= 2), _bound(inner, _read_tag)))
    return out.select(*lines.columns, F.col("_tag.kind").alias("kind"), F.col("_tag.name").alias("name"), F.col("_tag.rest").alias("rest"))


def parse_attributes(text: str) -> dict[str, str]:
    """k="v", k='v' and k=v; the last of equal keys holds; ends at a key without = or a quote that isn't closed."""
    out: dict[str, str] = {}
    at, n = 0, len(text)

    def skip(i: int) -> int:
        while i < n and text[i].isspace():
            i += 1
        return i

    while (at := skip(at)) < n:
        end = at
        while end < n and text[end] != "=" and not text[end].isspace():
            end += 1
        key, at = text[at:end], skip(end)
        if end == n or at == n or text[at] != "=":
            break
        at = skip(at + 1)
        if at < n and text[at] in "\"'":
            close = text.find(text[at], at + 1)
            if close < 0:
                break
            out[key], at = text[at + 1 : close], close + 1
        else:
            end = at
            while end < n and not text[end].isspace():
                end += 1
            out[key], at = text[at:end], end
    return out


@F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
def _attributes(rest: pd.Series) -> pd.Series:
    return rest.map(lambda x: parse_attributes(x) if x is not None else {})


#: Attributes that are all of the form k="v", one blank apart or more, are read in the JVM.
_PLAIN = "^(?:[^\\s=\"']+=\"[^\"]*\"(?:\\s+|$))*$"
_PAIR = "[^\\s=\"']+=\"[^\"]*\""


def attributes(tagged: DataFrame) -> DataFrame:
    """The rows with attrs, a map of the attributes in rest; only rests that aren't plain, or repeat a key, go to Python."""
    key = lambda x: F.substring_index(x, "=", 1)
    pair = lambda x: F.struct(key(x).alias("key"), F.substring(x, F.length(key(x)) + 3, F.length(x) - F.length(key(x)) - 3).alias("value"))
    found = F.regexp_extract_all(F.coalesce("rest", F.lit("")), F.lit(_PAIR), F.lit(0))
    out = settled(tagged).withColumn("_pairs", F.when(F.coalesce(F.col("rest").rlike(_PLAIN), F.lit(True)), F.transform(found, pair)))
    out = out.withColumn("_plain", F.coalesce(F.size(F.array_distinct("_pairs.key")) == F.size("_pairs"), F.lit(False)))
    odd = _attributes(F.when(~F.col("_plain"), F.col("rest")))
    return settled(out.withColumn("attrs", F.when(F.col("_plain"), F.map_from_entries("_pairs")).otherwise(odd)).drop("_pairs", "_plain"))


def _replay(line: list[int], start: list[bool], name: list[int], alone: bool) -> Iterator[tuple[int, int | None, str | None]]:
    """The events of a stretch one after another: ends with the start that they close or with what is wrong, and what is left open.

    Unless the stretch stands ``alone``, an end that meets no start of the stretch is left open, too, for what came before it.
    """
    stack: list[tuple[int, int]] = []
    for at, opens, own in zip(line, start, name, strict=True):
        if opens:
            stack.append((own, at))
        elif not stack:
            yield at, None, NOT_OPEN if alone else None
        elif stack[-1][0] != own:
            yield at, None, MISMATCH
        else:
            yield at, stack.pop()[1], None
    for _, at in stack:
        yield at, None, UNTERMINATED if alone else None


def _stretch(alone: bool):
    """line, start_line, problem of the events that a partition settles; those that it can't have neither."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        events = pa.Table.from_batches(list(batches), schema=_EVENTS)
        if not events.num_rows:
            return
        line, start = (events.column(i).to_numpy() for i in (0, 1))
        codes = events.column(2).combine_chunks().dictionary_encode()
        name = codes.indices.to_numpy(zero_copy_only=False)
        depth = np.cumsum(np.where(start, 1, -1))
        # on the level of an end stands right before it the start that it closes, if names agree everywhere
        level = np.where(start, depth, depth + 1)
        order = np.argsort(level, kind="stable")
        one, two = order[:-1], order[1:]
        pair = (level[one] == level[two]) & start[one] & ~start[two]
        if (name[one] == name[two])[pair].all():
            closer, opener = two[pair], one[pair]
            rest = np.ones(len(line), np.bool_)
            rest[closer] = rest[opener] = False
            out = [pa.array(np.r_[line[closer], line[rest]]), pa.array(np.r_[line[opener], line[rest]], mask=np.r_[np.zeros(len(closer), np.bool_), np.ones(int(rest.sum()), np.bool_)])]
            said = np.where(start[rest], UNTERMINATED, NOT_OPEN) if alone else np.full(int(rest.sum()), None)
            problem = pa.array([*[None] * len(closer), *said.tolist()], pa.string())
        else:
            rows = list(_replay(line.tolist(), start.tolist(), name.tolist(), alone))
            out = [pa.array([r[i] for r in rows], pa.int64()) for i in (0, 1)]
            problem = pa.array([r[2] for r in rows], pa.string())
        yield pa.RecordBatch.from_arrays([*out, problem], ["line", "start_line", "problem"])

    return run


_EVENTS = pa.schema([("line", pa.int64()), ("opens", pa.bool_()), ("name", pa.string())])
#: Events that one task settles; more are settled in stretches first, and what is left over in longer ones.
SETTLED_AT_ONCE = 1_000_000


def matched(events: DataFrame, at_once: int = SETTLED_AT_ONCE) -> DataFrame:
    """line, start_line, problem of end tags, and of starts that stay open, for events (line, opens, name).

    Stretches of the text settle what opens and closes within them, side by side. What is left over are starts and
    ends of stretches that hold no more than a part of them; removing the others doesn't change what these meet. They
    are settled in the same way in longer stretches, and at last in one.
    """
    spark, done = events.sparkSession, []
    parts, left = int(spark.conf.get("spark.sql.shuffle.partitions")), events.select("line", "opens", "name")
    parts = 1 if left.count() <= at_once else parts
    while True:
        alone = parts == 1
        placed = left.repartition(1).sortWithinPartitions("line") if alone else left.repartitionByRange(parts, "line").sortWithinPartitions("line")
        out = written(placed.mapInArrow(_stretch(alone), "line long, start_line long, problem string"), "stretches")
        if alone:
            break
        open_ = out.where("start_line IS NULL AND problem IS NULL")
        done.append(out.where("start_line IS NOT NULL OR problem IS NOT NULL"))
        left = written(left.join(open_.select("line"), "line", "left_semi"), "left")
        parts = 1 if left.count() <= at_once else max(1, parts // 16)
    for x in done:
        out = out.unionByName(x)
    return out


class Parsed:
    """What a vertical text holds: tokens, structures by name, diagnostics. Each is worked out when it is first asked for."""

    def __init__(self, lines: Lines, config: Config):
        self.lines, self.config = lines, config

    @cached_property
    def _tagged(self) -> DataFrame:
        """The lines, trimmed, with kind, name and rest, and whether they are tags of declared structures."""
        known = list(self.config.structures())
        rows = settled(self.lines.rows.withColumn("value", trimmed(F.col("value"))))
        # most lines are told to be tokens by their first character
        tag = F.coalesce(F.col("value").startswith("<") & F.col("name").isin(known), F.lit(False)) if known else F.lit(False)
        return tags(rows).withColumn("tag", tag)

    @cached_property
    def _segments(self) -> DataFrame:
        return self.lines.segments(self._tagged, F.expr(READ), ~F.col("tag"))

    @property
    def tokens(self) -> DataFrame:
        """pos, line and the attributes."""
        fields = F.split("value", "\t", -1)
        rows = self._tagged.where(READ).where("NOT tag").withColumn("_k", F.monotonically_increasing_id())
        pos = F.col("base_pos") + F.col("_k") % PLACES - F.col("tokens_off")
        columns = [F.coalesce(F.get(fields, F.lit(i)), F.lit(d)).alias(a) for i, (a, d) in enumerate(self.config.positional())]
        return self.lines.placed(rows, self._segments, pos.alias("pos"), F.col("line"), *columns)

    @cached_property
    def _marks(self) -> DataFrame:
        """line, kind, name, pos and attrs of the tags; pos is that of the next token."""
        rows = self._tagged.where(READ).withColumn("_c", F.monotonically_increasing_id()).where("tag").withColumn("_r", F.monotonically_increasing_id())
        pos = F.col("base_pos") + (F.col("_c") % PLACES - F.col("clean_off")) - (F.col("_r") % PLACES - F.col("tags_off"))
        rows = self.lines.placed(rows, self._segments, F.col("line"), F.col("kind"), F.col("name"), pos.alias("pos"), F.col("rest"))
        return written(attributes(rows).drop("rest"), "marks")

    @cached_property
    def _ends(self) -> DataFrame:
        return matched(self._marks.where("kind != 'empty'").select("line", (F.col("kind") == "start").alias("opens"), "name"))

    @cached_property
    def _ranges(self) -> DataFrame:
        marks = self._marks
        starts = marks.where("kind = 'start'").select(F.col("line").alias("start_line"), F.col("pos").alias("beg"), "attrs")
        closes = marks.where("kind = 'end'").select("line", "name", F.col("pos").alias("end"))
        ranges = self._ends.where("start_line IS NOT NULL").join(closes, "line").join(starts, "start_line").select("name", "beg", "end", F.lit(0).alias("late"), "line", "attrs")
        # an empty one stands if it is the last start of its name at the position
        last = marks.where("kind != 'end'").groupBy("name", "pos").agg(F.max("line").alias("line"))
        empty = marks.where("kind = 'empty'").join(last, ["name", "pos", "line"])
        ranges = ranges.unionByName(empty.select("name", F.col("pos").alias("beg"), F.col("pos").alias("end"), F.lit(1).alias("late"), "line", "attrs"))
        return numbered(ranges, ["end", "late", "line"], "num", by=["name"])

    def structure(self, name: str) -> DataFrame:
        """num, beg, end and the structure's attributes."""
        own = self._ranges.where(F.col("name") == name)
        return own.select("num", "beg", "end", *(F.coalesce(F.col("attrs")[a], F.lit(d)).alias(a) for a, d in self.config.structures()[name]))

    def ranges(self) -> DataFrame:
        """name, num, beg, end of all structures."""
        return self._ranges.select("name", "num", "beg", "end")

    @property
    def problems(self) -> DataFrame:
        """kind, line, name, n."""
        marks, one = self._marks, F.lit(1).cast("long").alias("n")
        opened = marks.where("kind != 'end'").select("name", "pos", "line")
        again = opened.join(opened.groupBy("name", "pos").agg(F.min("line").alias("first")), ["name", "pos"]).where("line > first")
        wrong = self._ends.where(F.col("problem").isin(NOT_OPEN, MISMATCH)).join(marks.select("line", "name"), "line").select(F.col("problem").alias("kind"), "line", "name", one)
        left = self._ends.where(F.col("problem") == UNTERMINATED).agg(F.count("*").alias("n"), F.max("line").alias("line")).where("n > 0")
        problems = again.select(F.lit(SAME_PLACE).alias("kind"), "line", "name", one).unionByName(wrong)
        # one message for all that are left open
        return problems.unionByName(left.select(F.lit(UNTERMINATED).alias("kind"), "line", F.lit(None).cast("string").alias("name"), one))

    def summary(self) -> DataFrame:
        """kind, n: how many problems of each kind there are."""
        return self.problems.groupBy("kind").agg(F.sum("n").alias("n"))

    def messages(self) -> DataFrame:
        """kind, line, message: the first of each kind. Tasks keep as many of each before they meet."""
        place = F.row_number().over(W.partitionBy("kind").orderBy("line"))
        return self.problems.withColumn("_k", place).where(F.col("_k") <= LISTED).select("kind", "line", F.concat_ws(" ", "kind", F.concat(F.lit("("), "name", F.lit(")"))).alias("message"))


def parse(lines: Lines | DataFrame, config: Config) -> Parsed:
    """Tokens, structures and problems of a vertical text, given as Lines or as a table (line, value).

    A tag whose name isn't a declared structure is a token. Ranges are numbered by name in the order they are written:
    a range at its end tag, an empty one when the next token comes or the text ends. Of several empty ones at a
    position the last stands, if no start of that name follows at the position.
    """
    return Parsed(lines if isinstance(lines, Lines) else Lines.of_table(lines), config)
