import hashlib
import random

import numpy as np

from poslex.operators import chunks, lexicon


def test_ids_by_chunks(spark, monkeypatch):
    """Words of texts in chunks get the ids that one dictionary of all would give; no text runs into the next, none is lost."""
    monkeypatch.setattr(chunks, "CHUNK_BYTES", 40)
    rng = random.Random(3)
    texts = [None, "", " \t\r\n", "one", "two ", " x  y", "Σ é 語", *(" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 40))) for _ in range(60))]
    got = chunks.Chunks(spark.createDataFrame(list(enumerate(texts)), "k long, text string"), ["k"])
    words = [w for t in texts for w in (t or "").replace("\t", " ").replace("\r", " ").replace("\n", " ").split(" ") if w]
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    want = [(i, number[w], w) for i, w in enumerate(words)]
    assert sorted(map(tuple, got.ids().collect())) == want
    assert sorted(map(tuple, got.ids(value=False).collect())) == [x[:2] for x in want]
    lex = sorted(map(tuple, got.lexicon.collect()))
    assert lex == [(i, w, words.index(w), words.count(w)) for w, i in number.items()]
    # a word goes through a shuffle once for each chunk
    assert got.ids(value=False)._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 2


def test_digests():
    rng = np.random.default_rng(1)
    pos, number = (np.r_[0, 9, 10, 10**18, 2**62, rng.integers(0, 10 ** rng.integers(1, 19, 300))] for _ in range(2))
    want = [int(hashlib.md5(f"{p}:{n}".encode()).hexdigest()[:16], 16) for p, n in zip(pos, number, strict=True)]
    assert lexicon._md5(*lexicon._message(pos, number)).tolist() == want
