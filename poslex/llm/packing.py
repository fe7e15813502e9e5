"""Harmonic packing of documents into bins of a fixed number of tokens.

A document's tokens (maximal runs outside ASCII white space) are cut into pieces: as many full ones of ``capacity``
as fit, and the rest. A piece of n tokens is of class floor(capacity / n), at most ``classes``: class k holds pieces
of at most capacity / k tokens, so any k of them fit a bin. Each bin takes the next k pieces of its class, in the
order of doc_id and place, without looking at others. Documents are spread over shards by a hash of doc_id (of the text where it is null), about
``shard_docs`` to each; a shard's classes are packed by themselves, so workers need nothing from one another, and at
most one bin of each class and shard stays unfilled.

Edge cases: a document without tokens (null, empty, white space only) has no piece. Rows of one doc_id are in one shard,
as doc_id is taken to be a key; copies of a text under other doc_ids are spread. Rows with equal or null doc_ids
are ordered by their text's hash; repeated rows are packed each, in any order among themselves. An empty table gives
no bins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .mixing import token_count, token_slice

CAPACITY = 2048
CLASSES = 64
SHARD_DOCS = 50_000


def pack(docs: DataFrame, capacity: int = CAPACITY, classes: int = CLASSES, shard_docs: int = SHARD_DOCS, with_text: bool = False) -> DataFrame:
    """shard, class, bin, slot, doc_id, start, n_tokens (and the piece's text) for each piece.

    A bin is named by shard, class and bin; slots count from 0; start is the piece's first token in its document.
    """
    shards = max(1, -(-docs.count() // shard_docs))
    number = F.conv(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.col("text"))).substr(1, 8), 16, 10).cast("long")
    rows = docs.select("doc_id", (number % shards).alias("shard"), F.xxhash64("text").alias("th"), token_count(F.col("text")).alias("n")).where("n > 0")
    start = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(capacity).cast("long"))).alias("start")
    piece = F.least(F.lit(capacity).cast("long"), F.col("n") - F.col("start"))
    rows = rows.select("doc_id", "shard", "th", "n", start)
    rows = rows.select("doc_id", "shard", "th", "n", "start", piece.alias("n_tokens"), F.least(F.lit(classes), F.floor(F.lit(capacity) / piece)).cast("long").alias("class"))
    place = F.row_number().over(W.partitionBy("shard", "class").orderBy("doc_id", "th", "start")).cast("long") - 1
    rows = rows.withColumn("place", place)
    out = ["shard", "class", F.expr("place DIV class").alias("bin"), F.expr("place % class").alias("slot"), "doc_id", "start", "n_tokens"]
    if not with_text:
        return rows.select(*out)
    # pieces are placed without their texts, which meet them by document afterwards; rows equal in both are one text
    texts = docs.select(F.col("doc_id").alias("own_id"), F.xxhash64("text").alias("own_th"), "text").groupBy("own_id", "own_th").agg(F.first("text").alias("text"))
    rows = rows.join(texts, F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("th") == F.col("own_th")))
    text = F.when(F.col("n") <= capacity, F.col("text")).otherwise(token_slice(F.col("text"), F.col("start"), F.col("n_tokens")))
    return rows.select(*out, text.alias("text"))


def query(spark, sf_dir: str) -> DataFrame:
    """The packing of all documents."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def oracle() -> str:
    return f"""
WITH r AS (
  SELECT doc_id, len(regexp_extract_all(text, '[^\\t-\\r ]+'))::BIGINT AS n,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, text)), 1, 8))::BIGINT % (SELECT greatest(1, ceil(count(*) / {SHARD_DOCS}.0))::BIGINT FROM documents) AS shard
  FROM documents
), p AS (
  SELECT doc_id, shard, n, unnest(range(0, n, {CAPACITY})) AS start FROM r WHERE n > 0
), q AS (
  SELECT doc_id, shard, start, least({CAPACITY}, n - start) AS n_tokens, least({CLASSES}, {CAPACITY} // least({CAPACITY}, n - start)) AS class FROM p
), o AS (
  SELECT *, row_number() OVER (PARTITION BY shard, class ORDER BY doc_id, start) - 1 AS place FROM q
)
SELECT shard, class::BIGINT AS class, place // class AS bin, place % class AS slot, doc_id, start, n_tokens FROM o
"""
