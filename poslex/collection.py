"""Collections on disk: vertical text is encoded once into Parquet tables, and attributes and structures are opened from them.

Tables stand in the folder that the configuration names, one set for each attribute ``a`` or structure attribute
``s.a``: ``a.lex`` (id, value, first_pos, frq, sort_rank), ``a.text`` (pos, id), ``a.rev`` (id, pos; sorted by id, so
that a lookup of an id reads the row groups that may hold it), for derived attributes ``a.map`` (src_id, dyn_id), for
external frequencies ``a.<ext>`` (id, freq); ``s.rng`` (num, beg, end) for each structure; ``problems`` of the encoding.
For attributes of structures ``pos`` is the number of the structure.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import lexicon as lx
from .operators import structures as st
from .operators.sketch import Sketch
from .sources import compiled, vertical
from .sources.config import AttributeNotFound, Config


def _scalar(df: DataFrame):
    row = df.first()
    return None if row is None else row[0]


@dataclass(frozen=True)
class Attribute:
    """A column over positions (or over structure numbers), its lexicon and its inverted index."""

    name: str
    ids: DataFrame
    lex: DataFrame
    index: DataFrame
    external: Callable[[str], DataFrame]

    def id2str(self, number: int) -> str | None:
        return _scalar(lx.value_of(self.lex, number).select("value"))

    def str2id(self, value: str) -> int | None:
        """None for a value that isn't there, wherever it would stand."""
        return _scalar(lx.id_of(self.lex, value).select("id"))

    def id_range(self) -> int:
        return self.lex.count()

    def size(self) -> int:
        return self.ids.count()

    def get(self, pos: int) -> int | None:
        return _scalar(self.ids.where(F.col("pos") == pos).select("id"))

    def iter_ids(self, first: int = 0, end: int | None = None) -> DataFrame:
        """pos, id in the order of pos."""
        return lx.from_position(self.ids, first, end).orderBy("pos")

    def values(self, first: int = 0, end: int | None = None) -> DataFrame:
        """pos, id, value in the order of pos."""
        return lx.decoded(lx.from_position(self.ids, first, end), self.lex).select("pos", "id", "value").orderBy("pos")

    def id2poss(self, number: int) -> DataFrame:
        """pos in ascending order."""
        return lx.positions_of(self.index, number).orderBy("pos")

    def frq(self, number: int) -> int:
        """How often an id occurs; 0 for one that there isn't."""
        return lx.positions_of(self.index, number).count()

    def get_freq(self, kind: str = "frq") -> DataFrame:
        """id, frq: counted for "frq", else from the table of an external frequency, whose kind ends in ":l"."""
        if kind == "frq":
            return self.lex.select("id", "frq")
        if not kind.endswith(":l"):
            raise ValueError(f"no frequency of kind {kind!r}")
        return self.external(kind[:-2]).select("id", F.col("freq").alias("frq"))


@dataclass(frozen=True)
class Structure:
    """Ranges of positions. ``compat`` is that of ``operators.structures``."""

    name: str
    ranges: DataFrame

    def __len__(self) -> int:
        return self.ranges.count()

    def beg_at(self, num: int) -> int | None:
        return _scalar(self.ranges.where(F.col("num") == num).select("beg"))

    def end_at(self, num: int) -> int | None:
        return _scalar(self.ranges.where(F.col("num") == num).select("end"))

    def num_at_pos(self, positions: DataFrame, compat: bool = False) -> DataFrame:
        return st.number_at(positions, self.ranges, compat)

    def find_beg(self, positions: DataFrame, compat: bool = False) -> DataFrame:
        return st.next_start(positions, self.ranges, compat)

    def find_end(self, positions: DataFrame, compat: bool = False) -> DataFrame:
        return st.by_end(positions, self.ranges, compat)


class Collection:
    """An encoded collection."""

    def __init__(self, spark: SparkSession, config: Config):
        self.spark, self.config = spark, config

    @classmethod
    def open(cls, spark: SparkSession, name: str) -> Collection:
        """By the path of a configuration, or by its name in the registry."""
        return cls(spark, Config.open(name))

    def get_conf(self, key: str) -> str | None:
        return self.config.get(key)

    def _read(self, table: str) -> DataFrame:
        return self.spark.read.parquet(self.config.path + table)

    def attribute(self, name: str) -> Attribute:
        """A positional attribute ``a`` or one of a structure ``s.a``; derived ones read their source through the map."""
        source = self.config.source_of(name)
        external = lambda ext: self._read(f"{name}.{ext}")
        if source is None:
            self.config.reader(name)
            return Attribute(name, self._read(f"{name}.text"), self._read(f"{name}.lex"), self._read(f"{name}.rev"), external)
        base, pairs = self.attribute(source), self._read(f"{name}.map")
        frq = lx.derived_frequencies(base.lex, pairs).withColumnRenamed("dyn_id", "id")
        ids = lx.derived_ids(base.ids, pairs).withColumnRenamed("dyn_id", "id")
        index = base.index.join(pairs, F.col("id") == F.col("src_id")).select(F.col("dyn_id").alias("id"), "pos")
        return Attribute(name, ids, self._read(f"{name}.lex").join(frq, "id", "left"), index, external)

    def structure(self, name: str) -> Structure:
        self.config.wide(name)
        return Structure(name, self._read(f"{name}.rng"))

    def struct_text(self, structure: str, attribute: str) -> DataFrame:
        """pos, id: the ids of a structure's attribute by structure number, whatever the configuration says of it."""
        return self._read(f"{structure}.{attribute}.text")

    def problems(self) -> DataFrame:
        return self._read("problems")

    def derive(self, name: str, function: Column) -> None:
        """Writes the lexicon and the map of a derived attribute; ``function`` is a Column of ``value``."""
        source = self.config.source_of(name)
        if source is None:
            raise AttributeNotFound(f"{name} isn't derived")
        own, pairs = lx.derived(self._read(f"{source}.lex"), function)
        _write(own, f"{self.config.path}{name}.lex")
        _write(pairs, f"{self.config.path}{name}.map")

    def add_frequency(self, name: str, kind: str, values: DataFrame) -> None:
        """Writes an external frequency (id, freq)."""
        _write(values.select("id", F.col("freq").cast("long").alias("freq")), f"{self.config.path}{name}.{kind}")

    def sketch(self) -> Sketch:
        """The word sketches at WSBASE. Their table of extra collocates may be empty, but must be there."""
        base = self.config.get("WSBASE")
        read = self.spark.read.parquet
        extra = read(f"{base}.coll")
        return Sketch(read(f"{base}.entries"), read(f"{base}.pos"), self.attribute(self.config.get("WSATTR")).lex, read(f"{base}.rel"), None if extra.isEmpty() else extra)

    def write_sketch(self, sketch: Sketch) -> None:
        base = self.config.get("WSBASE")
        _write(sketch.entries.repartitionByRange("head_id").sortWithinPartitions("head_id", "rel_id", "ord"), f"{base}.entries")
        _write(sketch.occurrences.repartitionByRange("head_id").sortWithinPartitions("head_id", "rel_id", "coll_id", "pos"), f"{base}.pos")
        _write(sketch.relations, f"{base}.rel")
        _write(sketch.relations.where("false") if sketch.extra is None else sketch.extra, f"{base}.coll")


def _write(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def _write_column(spark: SparkSession, column: DataFrame, path: str) -> None:
    """The tables of one attribute's column (pos, value)."""
    _write(lx.ranked(lx.lexicon(column)), f"{path}.lex")
    lex = spark.read.parquet(f"{path}.lex")
    _write(lx.encoded(column, lex).select("pos", "id").repartitionByRange("pos").sortWithinPartitions("pos"), f"{path}.text")


def encode(spark: SparkSession, config: Config, text: str | DataFrame) -> Collection:
    """Encodes vertical text (a path, or lines as (line, value)) into the collection's folder, without inverted indexes."""
    lines = vertical.Lines.of_files(spark, text) if isinstance(text, str) else text
    parsed = vertical.parse(lines, config)
    for name, _ in config.positional():
        _write_column(spark, parsed.tokens.select("pos", F.col(name).alias("value")), config.path + name)
    for name, attributes in config.structures().items():
        rows = parsed.structure(name)
        _write(rows.select("num", "beg", "end"), f"{config.path}{name}.rng")
        for a, _ in attributes:
            _write_column(spark, rows.select(F.col("num").alias("pos"), F.col(a).alias("value")), f"{config.path}{name}.{a}")
    _write(parsed.problems, f"{config.path}problems")
    return Collection(spark, config)


def index(collection: Collection, name: str) -> None:
    """Writes the inverted index of an encoded attribute ``a`` or ``s.a``."""
    path = collection.config.path + name
    _write(lx.postings(collection.spark.read.parquet(f"{path}.text")), f"{path}.rev")


def build(spark: SparkSession, config: Config, text: str | DataFrame) -> Collection:
    """Encodes and indexes every attribute."""
    out = encode(spark, config, text)
    for name in [n for n, _ in config.positional()] + [f"{s}.{a}" for s, own in config.structures().items() for a, _ in own]:
        index(out, name)
    return out


def convert(spark: SparkSession, config: Config, path: str, frequencies: tuple[str, ...] = ("docf", "arf", "aldf")) -> Collection:
    """Makes a collection in the folder ``path`` of the compiled files that the configuration names.

    Lexicons, ids, ranges, derived attributes, external frequencies of the kinds given and word sketches are read from
    the files; inverted indexes are made anew.
    """
    source, out = config.path, Collection(spark, replace(config, path=path.rstrip("/") + "/"))
    target = out.config.path

    def column(name: str, kind: str) -> None:
        ids, lex = compiled.attribute(spark, source + name, kind)
        _write(ids.repartitionByRange("pos").sortWithinPartitions("pos"), f"{target}{name}.text")
        _write(lex, f"{target}{name}.lex")
        index(out, name)
        for ext in frequencies:
            if compiled.exists(f"{source}{name}.{ext}"):
                _write(compiled.frequencies(spark, f"{source}{name}.{ext}"), f"{target}{name}.{ext}")

    for name in config.tree.attributes:
        if config.source_of(name) is None:
            column(name, config.reader(name))
        else:
            _write(compiled.lexicon(spark, source + name).select("id", "value"), f"{target}{name}.lex")
            _write(compiled.mapping(spark, source + name), f"{target}{name}.map")
    for name, attributes in config.structures().items():
        _write(compiled.ranges(spark, source + name, config.wide(name)), f"{target}{name}.rng")
        for a, _ in attributes:
            if config.source_of(f"{name}.{a}") is None:
                # attributes of structures are stored as plain numbers, whatever their type says
                column(f"{name}.{a}", "int")
    base = config.get("WSBASE")
    if compiled.exists(f"{base}.map0.com"):
        entries, places = compiled.sketch(spark, base)
        words = lambda x: compiled.lexicon(spark, x).select("id", "value")
        extra = words(f"{base}.coll") if compiled.size(f"{base}.coll.lex") else None
        own = replace(out.config, tree=replace(config.tree, values={**config.tree.values, "WSBASE": f"{target}{config.get('WSATTR')}-ws"}))
        out = Collection(spark, own)
        out.write_sketch(Sketch(entries, places, out.attribute(config.get("WSATTR")).lex, words(base), extra))
    return out
