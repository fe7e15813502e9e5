"""Word sketches: head, relation, collocate, occurrence, as four flat tables.

sketch(head_id, rel_id, coll_id, ord, cnt, rnk, lcm, and rel_ord if relations have an order of their own), sketch_pos(head_id, rel_id, coll_id, pos, coll_off), and the
lexicons of relations and of collocates outside the attribute's own lexicon. ``ord`` keeps the stored order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import log_dice


@dataclass(frozen=True)
class Sketch:
    entries: DataFrame
    occurrences: DataFrame
    words: DataFrame
    relations: DataFrame
    extra: DataFrame | None = None

    def collocates(self) -> DataFrame:
        """coll_id, coll: both lexicons as one; ids of the extra one follow those of the main one."""
        main = self.words.select(F.col("id").alias("coll_id"), F.col("value").alias("coll"))
        if self.extra is None:
            return main
        size = self.words.agg(F.count("*").alias("n"))
        return main.unionByName(self.extra.crossJoin(F.broadcast(size)).select((F.col("id") + F.col("n")).alias("coll_id"), F.col("value").alias("coll")))

    def collocate_id(self, value: str) -> DataFrame:
        """string to collocate id; no row if neither lexicon has it."""
        found = self.collocates().where(F.col("coll") == value)
        return found.groupBy("coll").agg(F.min("coll_id").alias("coll_id"))

    def collocate_ids(self, values: DataFrame) -> DataFrame:
        """coll, coll_id for each value of (coll); the main lexicon comes first, null if neither has it."""
        found = values.select("coll").distinct().join(self.collocates(), "coll", "left")
        return found.groupBy("coll").agg(F.min("coll_id").alias("coll_id"))

    def named(self, entries: DataFrame | None = None) -> DataFrame:
        """The entries with the words of head, relation and collocate."""
        rows = self.entries if entries is None else entries
        heads = self.words.select(F.col("id").alias("head_id"), F.col("value").alias("head"))
        rels = self.relations.select(F.col("id").alias("rel_id"), F.col("value").alias("rel"))
        return rows.join(rels, "rel_id").join(heads, "head_id").join(self.collocates(), "coll_id")

    def _dumped(self, head: str | None) -> tuple[DataFrame, list[str]]:
        """The named entries of one head or all, and what they are ordered by."""
        rows = self.entries
        if head is not None:
            rows = rows.join(F.broadcast(self.words.where(F.col("value") == head).select(F.col("id").alias("head_id"))), "head_id", "left_semi")
        return self.named(rows), ["head_id", "rel_ord" if "rel_ord" in rows.columns else "rel_id", "ord"]

    def dump(self, head: str | None = None) -> DataFrame:
        """head, rel, coll, cnt, rnk, lcm, in stored order for one head or all. An unknown head gives no rows."""
        rows, order = self._dumped(head)
        return rows.orderBy(*order).select("head_id", "rel_id", "ord", "head", "rel", "coll", "cnt", "rnk", "lcm")

    def table(self, head: str | None = None) -> DataFrame:
        """head, rel, coll, cnt, rnk, lcm of one head or all, lcm as its words, in stored order."""
        rows, order = self._dumped(head)
        rows = rows.join(self.matches_text(), ["head_id", "rel_id", "coll_id"])
        return rows.orderBy(*order).select("head", "rel", "coll", "cnt", "rnk", F.col("lcm_text").alias("lcm"))

    def write_tsv(self, path: str, head: str | None = None) -> None:
        """The table as tab-separated text, in order over the files."""
        rows = self.table(head)
        rows.select(F.concat_ws("\t", *(F.col(c).cast("string") for c in rows.columns)).alias("value")).write.mode("overwrite").text(path)

    def positions(self, head_id: int | None = None) -> DataFrame:
        """head_id, rel_id, coll_id, pos, coll_off."""
        return self.occurrences if head_id is None else self.occurrences.where(F.col("head_id") == head_id)

    def position_counts(self) -> DataFrame:
        """head_id, rel_id, coll_id, n: how many occurrences each entry has."""
        return self.occurrences.groupBy("head_id", "rel_id", "coll_id").agg(F.count("*").alias("n"))

    def matches_text(self) -> DataFrame:
        """head_id, rel_id, coll_id, lcm_text: the words of the longest commonest match; its last id isn't shown."""
        shown = F.expr("slice(lcm, 1, greatest(size(lcm) - 1, 0))")
        rows = self.entries.select("head_id", "rel_id", "coll_id", F.posexplode(shown).alias("k", "id"))
        said = rows.join(self.words.select("id", "value"), "id").groupBy("head_id", "rel_id", "coll_id").agg(F.array_sort(F.collect_list(F.struct("k", "value"))).alias("w"))
        said = said.select("head_id", "rel_id", "coll_id", F.array_join(F.col("w.value"), " ").alias("lcm_text"))
        return self.entries.select("head_id", "rel_id", "coll_id").join(said, ["head_id", "rel_id", "coll_id"], "left").select("head_id", "rel_id", "coll_id", F.coalesce("lcm_text", F.lit("")).alias("lcm_text"))


def neighbours(ids: DataFrame, ranges: DataFrame, lex: DataFrame, relations: DataFrame) -> Sketch:
    """A sketch of direct neighbours within a range: relation 0 is the next word, 1 the one before. Made for tests."""
    ends = ranges.select((F.col("end") - 1).alias("pos")).where("pos >= 0").distinct()
    one = ids.select("pos", F.col("id").alias("x")).join(ends, "pos", "left_anti")
    two = ids.select((F.col("pos") - 1).alias("pos"), F.col("id").alias("y"))
    pairs = one.join(two, "pos").select("pos", "x", "y")
    places = F.array(
        F.struct(F.col("x").alias("head_id"), F.lit(0).cast("long").alias("rel_id"), F.col("y").alias("coll_id"), F.col("pos").alias("pos"), F.lit(1).alias("coll_off")),
        F.struct(F.col("y").alias("head_id"), F.lit(1).cast("long").alias("rel_id"), F.col("x").alias("coll_id"), (F.col("pos") + 1).alias("pos"), F.lit(-1).alias("coll_off")),
    )
    occurrences = pairs.select(F.explode(places).alias("p")).select("p.*")
    entries = occurrences.groupBy("head_id", "rel_id", "coll_id").agg(F.count("*").alias("cnt"))
    frq = lambda x: lex.select(F.col("id").alias(x), F.col("frq").alias(f"f_{x}"))
    entries = entries.join(frq("head_id"), "head_id").join(frq("coll_id"), "coll_id")
    lcm = F.when(F.col("rel_id") == 0, F.array("head_id", "coll_id", F.lit(-1))).otherwise(F.array("coll_id", "head_id", F.lit(-1)))
    entries = entries.select("head_id", "rel_id", "coll_id", F.col("coll_id").alias("ord"), "cnt", log_dice(F.col("cnt"), F.col("f_head_id"), F.col("f_coll_id")).alias("rnk"), lcm.alias("lcm"))
    return Sketch(entries, occurrences, lex, relations)
