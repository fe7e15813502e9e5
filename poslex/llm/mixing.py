"""Mixing sources to target weights.

Every row gets a random key, a hash of a seed and its doc_id. Rows are range-sorted by source and key, token counts
are summed up to each row (sums of the sorted partitions first, then within them), and each source is cut at its
exact budget: its weight's share of the total budget, rounded down. A source with fewer tokens than its budget is
repeated for as many whole epochs as fit, then once more up to the cut. A token is a maximal run outside ASCII white
space. Only keys and counts are sorted; the texts meet one row of numbers for each source.

The row at the cut takes only the tokens left (``take`` < ``n_tokens``), so the sum of ``take`` over a source is its
budget to the token. Edge cases: rows of a source that share a key (equal or null doc_ids) stand in the order of
their text's hash. Rows equal in doc_id and text are one step of as many tokens as all of them have; if the cut falls
into such a step its rows are numbered in the order they are read, and taken one after another up to the budget. A null source is a source of its own, of the default weight. A
source without any token gives no rows and has no part in the weights, as no repetition of it can fill a budget; in
others a row without tokens comes with take 0 where it stands before the cut. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators._numbering import numbered
from . import _run

#: Target weights of production; sources that aren't named have the weight 1.
WEIGHTS = {"src0": 3.0, "src1": 2.0, "src2": 2.0, "src3": 0.5}
SEED = "mix-1"
#: Sources beyond this number are joined without a broadcast.
BROADCAST_SOURCES = 100_000
_TOKEN = "[^\\t-\\r ]+"


def token_count(text: Column) -> Column:
    """Tokens of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(_TOKEN)), F.lit(0)).cast("long")


def token_slice(text: Column, start: Column, n: Column) -> Column:
    """The n tokens of a text from the start-th (from 0), each with the white space after it."""
    parts = F.regexp_extract_all(text, F.lit(_TOKEN + "[\\t-\\r ]*"), F.lit(0))
    return F.array_join(F.slice(parts, (start + 1).cast("int"), n.cast("int")), "")


def _place(seed: str) -> list[Column]:
    source = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("-"))
    key = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).substr(1, 16)
    return [source.alias("s"), key.alias("key"), F.xxhash64("text").alias("th")]


def cuts(docs: DataFrame, weights: Mapping[str, float] = WEIGHTS, total: int | None = None, seed: str = SEED) -> DataFrame:
    """A row for each source (s): its tokens, budget, whole epochs, the tokens left for the last one, and the last
    row that gets any of them (cut_key, cut_th) with the tokens before it. ``total`` is all tokens by default."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["s", "key", "th"]
    rows = docs.select(*_place(seed), token_count(F.col("text")).alias("n"))
    steps = rows.groupBy(*order).agg(F.sum("n").alias("n"), F.count("*").alias("copies"))
    ranged = _run.materialise(steps.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "ranged")
    sums = ranged.groupBy("s", "part").agg(F.sum("n").alias("n"))
    earlier = W.partitionBy("s").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select("s", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"), F.sum("n").over(W.partitionBy("s")).alias("tokens"))
    sums = _run.materialise(sums, "sums")
    weight = F.lit(1.0)
    for name, value in weights.items():
        weight = F.when(F.col("s") == f"={name}", float(value)).otherwise(weight)
    sources = sums.groupBy("s").agg(F.max("tokens").alias("tokens")).where("tokens > 0").withColumn("weight", weight)
    whole = sources.agg(F.sum("tokens").alias("all_tokens"), F.sum("weight").alias("all_weight"))
    budget = F.floor((F.lit(int(total)) if total is not None else F.col("all_tokens")) * F.col("weight") / F.col("all_weight"))
    sources = sources.crossJoin(F.broadcast(whole)).select("s", "tokens", budget.alias("budget"))
    sources = sources.select("s", "tokens", "budget", F.expr("budget DIV tokens").alias("epochs"), F.expr("budget % tokens").alias("left"))
    inside = W.partitionBy("s", "part").orderBy("key", "th").rowsBetween(W.unboundedPreceding, -1)
    before = ranged.join(sums.select("s", "part", "base"), ["s", "part"]).withColumn("before", F.col("base") + F.coalesce(F.sum("n").over(inside), F.lit(0)))
    last = before.join(sources.select("s", "left"), "s").where("before < left").groupBy("s").agg(F.max(F.struct("key", "th", "before", "copies")).alias("cut"))
    return _run.materialise(sources.join(last, "s", "left").select("s", "tokens", "budget", "epochs", "left", "cut"), "cuts")


def mix(docs: DataFrame, weights: Mapping[str, float] = WEIGHTS, total: int | None = None, seed: str = SEED) -> DataFrame:
    """row (the document's own columns, as a struct), epoch, n_tokens and take, for each time a document is used."""
    plan = cuts(docs, weights, total, seed)
    if plan.count() <= BROADCAST_SOURCES:
        plan = F.broadcast(plan)
    rows = docs.select(F.struct("*").alias("row"), *_place(seed), token_count(F.col("text")).alias("n_tokens")).join(plan, "s")
    at = F.struct("key", "th")
    cut = F.struct(F.col("cut.key").alias("key"), F.col("cut.th").alias("th"))
    copy = F.lit(0).cast("long")
    if plan.where("cut.copies > 1").isEmpty():
        rows = rows.withColumn("copy", copy)
    else:
        tie = F.coalesce((at == cut) & (F.col("cut.copies") > 1), F.lit(False))
        tied = numbered(rows.where(tie).withColumn("read", F.monotonically_increasing_id()), ["read"], "copy", by=["s"]).drop("read")
        rows = rows.where(~tie).withColumn("copy", copy).unionByName(tied)
    spare = F.col("left") - F.col("cut.before") - F.col("copy") * F.col("n_tokens")
    part = F.when(F.col("cut").isNull() | (at > cut), F.lit(None)).when(at < cut, F.col("n_tokens")).when(spare > 0, F.least("n_tokens", spare))
    rows = rows.withColumn("part", part).withColumn("times", F.col("epochs") + F.col("part").isNotNull().cast("long")).where("times > 0")
    rows = rows.withColumn("epoch", F.explode(F.sequence(F.lit(1).cast("long"), "times")))
    return rows.select("row", "epoch", "n_tokens", F.when(F.col("epoch") > F.col("epochs"), F.col("part")).otherwise(F.col("n_tokens")).alias("take"))


def query(spark, sf_dir: str) -> DataFrame:
    """The mixture of the documents under the production weights, as large as the corpus."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mix(docs).select("row.doc_id", "row.source", "epoch", "n_tokens", "take")


def oracle() -> str:
    weight = " ".join(f"WHEN source = '{k}' THEN {v}" for k, v in WEIGHTS.items())
    return f"""
WITH r AS (
  SELECT doc_id, source, substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 16) AS k, len(regexp_extract_all(text, '[^\\t-\\r ]+'))::BIGINT AS n FROM documents
), s AS (
  SELECT source, sum(n)::BIGINT AS tokens, CASE {weight} ELSE 1.0 END::DOUBLE AS w FROM r GROUP BY source HAVING sum(n) > 0
), b AS (
  SELECT source, tokens, floor((SELECT sum(tokens) FROM s)::DOUBLE * w / (SELECT sum(w) FROM s))::BIGINT AS budget FROM s
), c AS (
  SELECT doc_id, source, n, coalesce(sum(n) OVER (PARTITION BY source ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM r
), e AS (
  SELECT doc_id, c.source, n, before, budget // tokens AS epochs, budget % tokens AS rest,
    unnest(range(1, budget // tokens + 1 + (before < budget % tokens)::INTEGER)) AS epoch
  FROM c JOIN b ON c.source IS NOT DISTINCT FROM b.source
)
SELECT doc_id, source, epoch::BIGINT AS epoch, n AS n_tokens, CASE WHEN epoch <= epochs THEN n ELSE least(n, rest - before) END AS take FROM e
"""
