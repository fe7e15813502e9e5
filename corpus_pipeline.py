"""The corpus pipeline: documents in, packed bins out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; a stage's rows are written as Parquet and read again as
the next one's docs. All but the last return the columns of documents; ``n_chars`` follows a text that was changed.
Edge cases are those of the operators; extra columns of documents are carried along up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from poslex.llm import _run, line_dedup, minhash_dedup, mixing, packing, quality_rules


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.keep_good(docs, quality_rules.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that match an earlier one go, and documents of which no token is left."""
    out = line_dedup.dedup_lines(docs)
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    out = out.where((F.col("n_removed") == 0) | F.col("text").rlike("[^\\t-\\r ]"))
    changed = F.col("n_removed") > 0
    columns = [
        F.when(changed, F.char_length("text")).otherwise(F.col("rest.n_chars")).cast(docs.schema[c].dataType).alias(c) if c == "n_chars"
        else F.col(f"rest.`{c}`").alias(c) if c in rest else F.col(c)
        for c in docs.columns
    ]
    return out.select(*columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return minhash_dedup.one_of_each(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights; a document at a cut is cut to the tokens left, a repeated one comes again."""
    out = mixing.mix(docs)
    cut = (F.col("take") < F.col("n_tokens")) & (F.col("take") >= 0)
    text = F.when(cut, mixing.token_slice(F.col("row.text"), F.lit(0), F.col("take"))).otherwise(F.col("row.text"))
    columns = [
        text.alias(c) if c == "text" else F.when(cut, F.char_length(text)).otherwise(F.col("row.n_chars")).cast(docs.schema[c].dataType).alias(c) if c == "n_chars"
        else F.col(f"row.`{c}`").alias(c)
        for c in docs.columns
    ]
    return out.where((F.col("take") > 0) | (F.col("n_tokens") == 0)).select(*columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in bins, with their texts."""
    return packing.pack(docs, with_text=True)


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("MinHash near-dedup", near_duplicates),
    ("mixing sources to target weights", mixture),
    ("packing", packed),
]

#: The isolation forest can't be stated in SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to the documents table. What a stage wrote on its way goes when its rows are written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        kept: list[DataFrame] = []
        with _run.only_kept(spark, kept):
            docs = _run.materialise(stage(spark, docs, sf_dir), name.split()[0].lower())
            kept.append(docs)
        _run.drop(*before)
        before = kept
    return STAGES[-1][1](spark, docs, sf_dir)
