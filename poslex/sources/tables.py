"""Collections made from relational tables: tokens with positions, structure ranges, and vertical text of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import words
from ..operators._numbering import numbered, running_sum
from ..operators.chunks import Chunks
from .vertical import Lines

#: All columns, as shorter keys have ties.
LINE_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _placed(rows: DataFrame, order: list[str], items: Column) -> DataFrame:
    """order, beg, end: the numbers of each row's items when those of all rows stand behind one another. order must be unique."""
    n = F.coalesce(F.greatest(F.size(items), F.lit(0)), F.lit(0)).cast("long")
    own = rows.select(*order, n.alias("n"))
    return running_sum(own, order, F.col("n"), "beg").select(*order, "beg", (F.col("beg") + F.col("n")).alias("end"))


def laid_out(rows: DataFrame, order: list[str], items: Column) -> DataFrame:
    """pos, value: the items of all rows, numbered in the order of the rows and their place in the array."""
    at = rows.join(_placed(rows, order, items).drop("end"), order)
    return at.select("beg", F.posexplode(items).alias("k", "value")).select((F.col("beg") + F.col("k")).alias("pos"), "value")


def doc_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """num, beg, end, doc_id, lang, source of each document, in the order of doc_id."""
    rows = table(spark, sf_dir, "documents")
    out = rows.select("doc_id", "lang", "source").join(_placed(rows, ["doc_id"], words(F.col("text"))), "doc_id")
    return numbered(out, ["doc_id"], "num").select("num", "beg", "end", "doc_id", "lang", "source")


def doc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pos, value: the words of all documents."""
    return laid_out(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"], words(F.col("text")))


def doc_chunks(spark: SparkSession, sf_dir: str) -> Chunks:
    """The same words in chunks, for their ids."""
    return Chunks(table(spark, sf_dir, "documents"), ["doc_id"])


def text_lines(spark: SparkSession, sf_dir: str) -> Lines:
    """The lines of all documents as they are."""
    return Lines.of_rows(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"], F.split("text", "\n", -1))


def doc_lines(spark: SparkSession, sf_dir: str) -> Lines:
    """Vertical text of the documents.

    Each is a <doc> with an <s> for each line of its text and a token line (word, lower-cased word) for each word;
    before it stand two <pb/>, the second with its doc_id.
    """
    rows = table(spark, sf_dir, "documents")
    token = lambda w: F.concat(w, F.lit("\t"), F.lower(w))
    sentence = lambda x: F.concat(F.array(F.lit("<s>")), F.transform(words(x), token), F.array(F.lit("</s>")))
    head = F.array(F.lit("<pb/>"), F.format_string('<pb n="%s"/>', F.col("doc_id").cast("string")), F.format_string('<doc lang="%s" source=\'%s\'>', "lang", "source"))
    items = F.concat(head, F.flatten(F.transform(F.split("text", "\n", -1), sentence)), F.array(F.lit("</doc>")))
    return Lines.of_rows(rows.select("doc_id", "lang", "source", "text"), ["doc_id"], items)


def page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """line, value: the pages' tags and the texts between them, a line each."""
    rows = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("html", "[\\r\\n]+", " ").alias("html"))
    return Lines.of_rows(rows, ["page_id"], F.regexp_extract_all("html", F.lit("<[^<>]*>|[^<>]+"), F.lit(0))).numbered()


def talk(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Ranges of turns (num, beg, end, role, conv_id) and of the conversations around them (num, beg, end, conv_id)."""
    rows = table(spark, sf_dir, "conversations")
    turns = rows.select("conv_id", "turn", "role").join(_placed(rows, ["conv_id", "turn"], words(F.col("text"))), ["conv_id", "turn"])
    turns = numbered(turns, ["conv_id", "turn"], "num").select("num", "beg", "end", "role", "conv_id")
    convs = turns.groupBy("conv_id").agg(F.min("beg").alias("beg"), F.max("end").alias("end"))
    return turns, numbered(convs, ["conv_id"], "num").select("num", "beg", "end", "conv_id")


def talk_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pos, value: the words of all conversations."""
    return laid_out(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), ["conv_id", "turn"], words(F.col("text")))


def talk_lines(spark: SparkSession, sf_dir: str, broken: bool = False) -> Lines:
    """Vertical text of the conversations, <conv> around <turn role="...">, a word a line.

    ``broken`` puts a </turn> before and after each <conv>, and a <conv> that isn't closed at the end.
    """
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = W.partitionBy("conv_id")
    rows = rows.withColumn("first", F.col("turn") == F.min("turn").over(own)).withColumn("last", F.col("turn") == F.max("turn").over(own))
    end = rows.agg(F.max(F.struct("conv_id", "turn")).alias("m"))
    rows = rows.crossJoin(F.broadcast(end)).withColumn("final", F.struct("conv_id", "turn") == F.col("m")).drop("m")
    none = F.array().cast("array<string>")
    opening = F.when(F.col("first"), F.array(*(F.lit(x) for x in (["</turn>", "<conv>", "</turn>"] if broken else ["<conv>"])))).otherwise(none)
    closing = F.when(F.col("last") & F.col("final"), F.array(*(F.lit(x) for x in (["</conv>", "<conv>"] if broken else ["</conv>"])))).when(F.col("last"), F.array(F.lit("</conv>"))).otherwise(none)
    items = F.concat(opening, F.array(F.format_string('<turn role="%s">', "role")), words(F.col("text")), F.array(F.lit("</turn>")), closing)
    return Lines.of_rows(rows.select("conv_id", "turn", items.alias("items")), ["conv_id", "turn"], F.col("items"))


def order_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pos, l_orderkey and the attributes of each line item."""
    rows = numbered(table(spark, sf_dir, "lineitem"), LINE_ORDER, "pos")
    return rows.select("pos", "l_orderkey", "l_returnflag", "l_linestatus", F.col("l_linenumber").cast("string").alias("l_linenumber"))


def order_ranges(tokens: DataFrame) -> DataFrame:
    """num, beg, end, l_orderkey of each order."""
    rows = tokens.groupBy("l_orderkey").agg(F.min("pos").alias("beg"), (F.max("pos") + 1).alias("end"))
    return numbered(rows, ["l_orderkey"], "num").select("num", "beg", "end", "l_orderkey")


def clicks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """pos, value, user_id of events by user and time; num, beg, end, user_id of the users."""
    rows = numbered(table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type"), ["user_id", "ts", "event_id"], "pos")
    tokens = rows.select("pos", F.col("event_type").alias("value"), "user_id")
    users = tokens.groupBy("user_id").agg(F.min("pos").alias("beg"), (F.max("pos") + 1).alias("end"))
    return tokens, numbered(users, ["user_id"], "num").select("num", "beg", "end", "user_id")
