"""Token ids in ORC.

Texts are encoded with a public byte-level BPE vocabulary (a parameter) and written to ORC: ids are stored in stripes
with integer run-length encoding, each stripe has row indexes (least and greatest values every ``stride`` rows) and
Bloom filters on doc_id. Rows are sorted by doc_id within each file, so stripes of a file hold ranges of ids. Readers
take stripes in parallel, and a filter on doc_id prunes stripes and row groups by metadata alone.

Encoding is that of the vocabulary on the whole text. Only runs of LONG white-space characters and more, on which its
pattern search would run out of stack, are cut out: the pattern always takes them, but for a last one before other
text, as one piece, so that they are encoded as such a piece.

Edge cases: a null text has null ids and n_tokens null; an empty one has no ids. Rows are independent: repeated rows
and null or equal doc_ids are kept as they are. Special tokens are never produced. Long texts are encoded whole.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _run

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'(?:s|t|re|ve|m|ll|d)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
STRIPE_BYTES = 16 << 20
STRIDE = 1000
#: Rows after which the writer looks whether a stripe is full; by default it is 5000, whatever their size.
LOOK = 100
#: White-space characters in a row from which on a run is encoded by itself.
LONG = 1000
_BLANKS = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]{%d,}" % LONG)


class Encoder:
    """Encodes texts with the vocabulary in a file."""

    def __init__(self, vocabulary: str):
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding("ids", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._plain, self._piece = self.bpe._core_bpe.encode_ordinary, self.bpe._core_bpe.encode_single_piece

    def ids(self, text: str) -> list[int]:
        if len(text) < LONG or not _BLANKS.search(text):
            return self._plain(text)
        out, at = [], 0
        for m in _BLANKS.finditer(text):
            end = m.end() - (m.end() < len(text))
            out += self._plain(text[at : m.start()])
            out += self._piece(text[m.start() : end].encode())
            at = end
        return out + self._plain(text[at:])

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (null as empty) behind one another, and how many each has."""
        ids, sizes = array("i"), []
        for scalar in column:
            own = self.ids(scalar.as_py() or "")
            ids.extend(own)
            sizes.append(len(own))
        return np.array(ids, np.int32), np.array(sizes, np.int64)


_encoders: dict[str, Encoder] = {}


def encoded(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens, tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoders.setdefault(vocabulary, None) or Encoder(vocabulary)
        _encoders[vocabulary] = encoder
        for batch in batches:
            null = np.array(batch.column(1).is_null())
            ids, size = encoder.encode(batch.column(1))
            offsets = pa.array(np.r_[0, np.cumsum(size)].astype(np.int32))
            lists = pa.ListArray.from_arrays(offsets, pa.array(ids), mask=pa.array(null))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size.astype(np.int32), mask=null), lists], ["doc_id", "n_tokens", "tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_tokens int, tokens array<int>")


def write(docs: DataFrame, path: str, vocabulary: str = VOCABULARY, stripe_bytes: int = STRIPE_BYTES, stride: int = STRIDE) -> None:
    """Encodes and writes without a shuffle; files are as many as the input's partitions."""
    ordered = docs.select("doc_id", "text").sortWithinPartitions("doc_id")
    out = encoded(ordered, vocabulary).write.option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01")
    out.option("orc.stripe.size", str(stripe_bytes)).option("orc.row.index.stride", str(stride)).option("orc.rows.between.memory.checks", str(LOOK)).option("compression", "zstd").mode("overwrite").orc(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.orc(path)


def lookup(spark: SparkSession, path: str, ids: list[int]) -> DataFrame:
    """The rows of some documents; stripes and row groups without them aren't read."""
    return read(spark, path).where(F.col("doc_id").isin(ids))


def decoder(vocabulary: str = VOCABULARY):
    """A function from ids to their text."""
    return Encoder(vocabulary).bpe.decode


def query(spark, sf_dir: str) -> DataFrame:
    """All documents, written as token ids and read again from the stripes."""
    path = _run.new_path(spark, "token-ids")
    write(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return read(spark, path)
