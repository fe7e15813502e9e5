"""The pipeline against a chain of brute-force stages."""

import re

import numpy as np
import pyarrow as pa
import xxhash
from test_dedup import brute_groups, brute_lines
from test_rows import brute_mix, path_length

import corpus_pipeline
from poslex.llm import _vec, mixing, packing, quality_rules

DIR = "/root/testdata/sf0.001"
TOKEN = re.compile(r"[^\t-\r ]+[\t-\r ]*")


def brute_pack(rows):
    pieces = []
    for doc, text in rows:
        tokens = TOKEN.findall(text)
        th = int(np.uint64(xxhash.xxh64_intdigest(text.encode(), seed=42)).view(np.int64))
        for start in range(0, len(tokens), packing.CAPACITY):
            own = tokens[start : start + packing.CAPACITY]
            piece = text if len(tokens) <= packing.CAPACITY else "".join(own)
            pieces.append((min(packing.CLASSES, packing.CAPACITY // len(own)), doc, th, start, len(own), piece))
    out, seen = [], {}
    for kind, doc, _, start, n, piece in sorted(pieces):
        place = seen[kind] = seen.get(kind, -1) + 1
        out.append((0, kind, place // kind, place % kind, doc, start, n, piece))
    return sorted(out)


def test_stages_brute_force(spark):
    docs, labels = spark.read.parquet(f"{DIR}/documents.parquet"), spark.read.parquet(f"{DIR}/labels.parquet")
    forest = quality_rules.fit(docs, labels)
    rows = [(r["doc_id"], r["source"], r["text"]) for r in docs.collect()]
    x = quality_rules.statistics(_vec.texts(pa.array([t for _, _, t in rows])))
    score = [2 ** (-np.mean([path_length(forest, t, own) for t in range(len(forest.feature))]) / forest.norm) for own in x]
    rows = [r for r, s in zip(rows, score, strict=True) if s <= forest.threshold]
    left = {k[0]: t for k, t in brute_lines([(d, t) for d, _, t in rows]).items()}
    rows = [(d, s, left[d]) for d, s, _ in rows if left[d].split()]
    first = brute_groups([(d, t) for d, _, t in rows])
    rows = [r for r in rows if first[r[0]] == r[0]]
    text = {d: t for d, _, t in rows}
    mixed = [(d, "".join(TOKEN.findall(text[d])[:take]) if take < n else text[d]) for d, _, _, n, take in brute_mix(rows, mixing.WEIGHTS)]
    got = sorted(tuple(r) for r in corpus_pipeline.run(spark, DIR).collect())
    assert got == brute_pack(mixed)


def test_nothing_is_left(spark):
    """After clean_up no table of the run is in the shared folder."""
    from pathlib import Path

    from poslex.llm import _run

    _run.clean_up(spark)
    folder = Path(_run.shared_dir(spark).removeprefix("file://"))
    before = {p.name for p in folder.iterdir()}
    assert corpus_pipeline.run(spark, DIR).count() and {p.name for p in folder.iterdir()} > before
    _run.clean_up(spark)
    assert {p.name for p in folder.iterdir()} == before


def test_stages_take_repeated_rows(spark):
    """Repeated rows go through every stage; of these the near-dedup keeps one."""
    rows = [(1, "plain words that stand here and some more of them", "en", "src0", 49)] * 40 + [(2, "other words in another document of this test", "en", "src1", 44)] * 3
    data = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        data = stage(spark, data, DIR)
        if name == "MinHash near-dedup":
            assert sorted(r["doc_id"] for r in data.collect()) == [1, 2]
    assert corpus_pipeline.STAGES[-1][1](spark, data, DIR).count() >= 2


def test_stage_columns(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").where("doc_id < 40")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DIR)
        assert out.dtypes == docs.dtypes
        if "n_chars" in out.columns:
            assert out.where("n_chars != char_length(text)").count() == docs.where("n_chars != char_length(text)").count()


def test_stages_take_nulls_and_other_columns(spark):
    rows = [(1, None, None, None, None, "a"), (2, "", "en", "src0", 0, None), (None, "plain words that stand here", None, "src0", 27, "b"), (4, "plain words that stand here", "en", None, 27, "c"), (4, "plain words that stand here", "en", None, 27, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row string")
    for data in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            data = stage(spark, data, DIR)
            assert data.columns == docs.columns
        corpus_pipeline.STAGES[-1][1](spark, data, DIR).collect()
