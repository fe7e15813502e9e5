"""Operators that treat each row by itself, or rows in order: mixing, packing, syncmers, token ids, language, quality, spans."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pyarrow.orc
import pytest

from poslex.llm import _vec, language_id, mixing, packing, pii, quality_rules, syncmers, token_orc

SCHEMA = "doc_id long, text string"
ODD = [(1, None), (2, ""), (3, " \t\n"), (None, "a b"), (5, "long " * 30_000), (6, "same words here"), (6, "same words here"), (7, "é ü 日本 \U0001f600")]


# ---- mixing -----------------------------------------------------------------------------------------------------
def brute_mix(rows, weights, total=None):
    key = lambda d: hashlib.md5(f"{mixing.SEED}:{'' if d is None else d}".encode()).hexdigest()[:16]
    n = lambda t: len(re.findall(r"[^\t-\r ]+", t or ""))
    sources = {}
    for d, s, t in rows:
        sources.setdefault(s, []).append((key(d), d, n(t)))
    sources = {s: sorted(x) for s, x in sources.items() if sum(y[2] for y in x)}
    everything = sum(y[2] for x in sources.values() for y in x) if total is None else total
    weight = {s: weights.get(s, 1.0) for s in sources}
    out = []
    for s, own in sources.items():
        left, epoch = int(everything * weight[s] / sum(weight.values())), 1
        while left > 0:
            for _, d, size in own:
                if left <= 0:
                    break
                out.append((d, s, epoch, size, min(size, left)))
                left -= size
            epoch += 1
    return sorted(out, key=repr)


@pytest.mark.parametrize("total", [None, 37, 4000])
def test_mix_brute_force(spark, total):
    rng = random.Random(1)
    rows = [(i, rng.choice(["x", "y", "z", None]), " ".join("w" * rng.randint(1, 30))) for i in range(80)]
    weights = {"x": 3.0, "y": 0.5}
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = mixing.mix(docs, weights, total).select("row.doc_id", "row.source", "epoch", "n_tokens", "take").collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_mix(rows, weights, total)
    taken = {}
    for r in got:
        taken[r["source"]] = taken.get(r["source"], 0) + r["take"]
    plan = {r["s"]: r["budget"] for r in mixing.cuts(docs, weights, total).collect()}
    assert taken == {None if s == "-" else s[1:]: b for s, b in plan.items()}


def test_mix_cases(spark):
    docs = spark.createDataFrame([(*r, s) for r, s in zip(ODD, [None, "a", "a", "a", "b", "b", "b", "b"], strict=True)], SCHEMA + ", source string")
    got = mixing.mix(docs).collect()
    assert {r["row"]["source"] for r in got} == {"a", "b"}
    assert sum(r["take"] for r in got) == sum(r["budget"] for r in mixing.cuts(docs).collect())
    assert mixing.mix(docs.limit(0)).collect() == []


@pytest.mark.parametrize("total", [0, 1, 8, 24, 25, 26, 63, 1000])
def test_mix_repeated_rows(spark, total):
    """Rows equal in all columns are taken one after another, to the token."""
    rows = [(1, "x", "one two three four five", "extra")] * 5 + [(None, "y", "a b c", "extra")] * 7 + [(3, "y", "d e", None)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, take string")
    got = mixing.mix(docs, {}, total).collect()
    plan = {r["s"][1:]: r["budget"] for r in mixing.cuts(docs, {}, total).collect()}
    for source, budget in plan.items():
        own = [r for r in got if r["row"]["source"] == source]
        assert sum(r["take"] for r in own) == budget
        assert sum(r["take"] < r["n_tokens"] for r in own) <= 1 and all(r["take"] > 0 for r in own)


# ---- packing ----------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("capacity", [7, 64])
def test_packing(spark, capacity):
    rng = random.Random(2)
    rows = [(i, " ".join(f"t{i}x{j}" for j in range(rng.choice([0, 1, 2, 3, 5, 8, 40, 200])))) for i in range(150)]
    got = packing.pack(spark.createDataFrame(rows, SCHEMA), capacity, 8, shard_docs=60, with_text=True).collect()
    bins, pieces = {}, {}
    for r in got:
        bins.setdefault((r["shard"], r["class"], r["bin"]), []).append(r)
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["text"]))
    for (_, kind, _), own in bins.items():
        assert sum(r["n_tokens"] for r in own) <= capacity and len(own) <= kind
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
        assert all(r["n_tokens"] * kind <= capacity and (kind == 8 or r["n_tokens"] * (kind + 1) > capacity) for r in own)
    # one bin of each class and shard at most isn't full
    assert all(sum(len(o) < k[1] for k, o in bins.items() if k[:2] == c) <= 1 for c in {k[:2] for k in bins})
    for doc, text in rows:
        assert " ".join(" ".join(t.split()) for _, t in sorted(pieces.get(doc, []))) == text


def test_packing_cases(spark):
    got = packing.pack(spark.createDataFrame(ODD, SCHEMA)).collect()
    total = {}
    for r in got:
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["n_tokens"]
    assert total == {None: 2, 5: 30_000, 6: 6, 7: 3}
    told = packing.pack(spark.createDataFrame(ODD * 3, SCHEMA), with_text=True).collect()
    assert len(told) == 3 * len(got) and all(len(re.findall(r"[^\t-\r ]+", r["text"])) == r["n_tokens"] for r in told)
    assert packing.pack(spark.createDataFrame([], SCHEMA), with_text=True).collect() == []
    assert packing.pack(spark.createDataFrame([], SCHEMA)).collect() == []


# ---- syncmers ---------------------------------------------------------------------------------------------------
def brute_anchors(text):
    code, k, s = [ord(c) for c in text], syncmers.K, syncmers.S
    h = [sum(c * int(f) for c, f in zip(code[i : i + s], syncmers.INNER, strict=True)) % syncmers.PRIME for i in range(len(code) - s + 1)]
    out = []
    for i in range(len(code) - k + 1):
        inner = h[i : i + k - s + 1]
        if min(inner) in (inner[0], inner[-1]):
            a, b = (sum(c * int(f) for c, f in zip(code[i : i + k], row, strict=True)) % syncmers.PRIME for row in syncmers.OUTER)
            out.append((i, a * 2**31 + b))
    return out


def test_syncmers_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, "".join(rng.choice("abcé日 \U0001f600") for _ in range(rng.randint(0, 400)))) for i in range(25)]
    got = {r["doc_id"]: list(zip(r["places"], r["hashes"], strict=True)) for r in syncmers.fingerprints(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {d: brute_anchors(t) for d, t in rows}


def test_syncmers_context_free(spark):
    rng = random.Random(5)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(500))
    a, b = "x" * 37 + passage + "yy", "other text " * 9 + passage
    prints = syncmers.fingerprints(spark.createDataFrame([(1, a), (2, b)], SCHEMA))
    rows = syncmers.shared_anchors(prints.where("doc_id = 1"), prints.where("doc_id = 2")).collect()
    inside = [p for p, _ in brute_anchors(passage)]
    best = max(rows, key=lambda r: r["anchors"])
    assert best["shift"] == 99 - 37 and best["anchors"] >= len(inside) > 2
    got = {(r["doc_id"], r["text"] is None): 0 for r in spark.createDataFrame(ODD, SCHEMA).collect()}
    assert len(syncmers.fingerprints(spark.createDataFrame(ODD, SCHEMA)).collect()) == len(ODD) and got
    assert syncmers.fingerprints(spark.createDataFrame([], SCHEMA)).collect() == []


def test_syncmers_short_passages(spark):
    """A run of 2k - s - 1 code points always has an anchor, and that is well below the shortest benchmark passage."""
    k, s = syncmers.K, syncmers.S
    assert 2 * k - s - 1 <= 51
    rng = random.Random(9)
    passages = ["".join(rng.choice("abcdefgh ") for _ in range(81)) for _ in range(60)]
    docs = spark.createDataFrame([(i, "left " * i + p + " right" * i) for i, p in enumerate(passages)], SCHEMA)
    items = spark.createDataFrame(list(enumerate(passages)), SCHEMA)
    rows = syncmers.shared_anchors(syncmers.fingerprints(items), syncmers.fingerprints(docs)).collect()
    assert {(r["doc_a"], r["shift"]) for r in rows if r["doc_a"] == r["doc_b"]} >= {(i, 5 * i) for i in range(60)}


def test_syncmers_whole_texts(spark):
    rng = random.Random(10)
    texts = ["".join(rng.choice("abcé日 \U0001f600") for _ in range(n)) for n in range(1, 2 * syncmers.K) for _ in range(4)]
    rows = list(enumerate([*texts, "a", "a\0", "short", "short", "", None]))
    got = {r["doc_id"]: list(zip(r["places"], r["hashes"], strict=True)) for r in syncmers.fingerprints(spark.createDataFrame(rows, SCHEMA), whole=True).collect()}
    bare = [(d, t) for d, t in rows if t and not brute_anchors(t)]
    assert any(len(t) >= syncmers.K for _, t in bare)
    for d, t in rows:
        assert got[d] == brute_anchors(t) if t and brute_anchors(t) else len(got[d]) == bool(t)
    assert {got[d][0][0] for d, _ in bare} == {0}
    assert len({got[d][0][1] for d, _ in bare}) == len({t for _, t in bare})
    assert all((got[a] == got[b]) == (x == y) for a, x in bare for b, y in bare)


def test_passages_against_pairs(spark, tmp_path):
    """The pairs of occurrences of passages are the positional matches of all pairs of rows, whatever the copies."""
    rng = random.Random(11)
    parts = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randint(30, 150))) for _ in range(8)]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 4))) for _ in range(40)] + ["x" * 60, "y" + "x" * 50, "short", "short", "", None] + [parts[0] * 3] * 5
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    prints = syncmers.fingerprints(docs, whole=True)
    want = {(r["doc_a"], r["doc_b"], r["shift"]): (r["anchors"], r["first"], r["last"]) for r in syncmers.shared_anchors(prints, prints).where("doc_a != doc_b OR shift != 0").collect()}
    groups, got = {}, {}
    from poslex.llm import registry

    for r in registry.queries()["op7_passages"](spark, str(tmp_path)).collect():
        groups.setdefault(r["passage"], []).append(r)
    for own in groups.values():
        assert {r["occurrences"] for r in own} == {len(own)} and len(own) > 1 and len({(r["anchors"], r["last"] - r["first"]) for r in own}) == 1
        for a in own:
            for b in own:
                if (k := (a["doc_id"], b["doc_id"], b["first"] - a["first"])) and a is not b:
                    n, low, high = got.get(k, (0, 2**31, -1))
                    got[k] = (n + a["anchors"], min(low, a["first"]), max(high, a["last"]))
    assert got == want and max(map(len, groups.values())) > 20
    same = [(6, "same words here, and more of them than one anchor spans"), (6, "same words here, and more of them than one anchor spans"), (None, "short"), (None, "short")]
    assert len({r["row"] for r in syncmers.passages(spark.createDataFrame(same, SCHEMA)).collect()}) == 4
    assert syncmers.passages(spark.createDataFrame([], SCHEMA)).collect() == []


# ---- token ids --------------------------------------------------------------------------------------------------
def test_token_round_trip(spark, tmp_path):
    rng = random.Random(6)
    rows = [(i, "".join(rng.choice(["word", " ", "  ", "\n", "don't", "42", "é", "日本", " ", "!?", "\t", "A"]) for _ in range(rng.randint(0, 200)))) for i in range(120)]
    path = str(tmp_path / "ids")
    token_orc.write(spark.createDataFrame(rows + ODD, SCHEMA), path)
    decode, bpe = token_orc.decoder(), token_orc.Encoder(token_orc.VOCABULARY).bpe
    got = token_orc.read(spark, path).collect()
    assert sorted(repr((r["doc_id"], None if r["tokens"] is None else decode(r["tokens"]))) for r in got) == sorted(repr(r) for r in rows + ODD)
    text = {d: t for d, t in rows}
    for r in token_orc.lookup(spark, path, [3, 77, 5000]).collect():
        assert r["doc_id"] in (3, 77, 1, 2, 5, 6, 7) and (r["doc_id"] != 77 or list(r["tokens"]) == bpe.encode_ordinary(text[77]))
        assert r["tokens"] is None or r["n_tokens"] == len(r["tokens"])
    files = [str(p) for p in (tmp_path / "ids").glob("*.orc")]
    assert sum(pyarrow.orc.ORCFile(f).nrows for f in files) == len(rows + ODD)


def test_token_ids_are_the_vocabulary_s(spark, tmp_path):
    """Every row's ids are those of the vocabulary on its whole text, at every kind of white space and border."""
    bpe = token_orc.Encoder(token_orc.VOCABULARY).bpe
    rng = random.Random(13)
    bits = ["word", "Don't", "it's", " ", "  ", "\n", "\n\n ", "\t", "\x0b", "\x0c", "\r\n", "\x1c", "\x85", "\u00a0", "\u1680", "\u2003", "\u2028", "\u3000", "é", "e\u0301", "日本語", "\U0001f600", "42", "3.14", "!?", "...", "_", "<|endoftext|>", "'s", "A"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    texts += [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows = list(enumerate(texts))
    token_orc.write(spark.createDataFrame(rows, SCHEMA), str(tmp_path / "ids"))
    got = {r["doc_id"]: list(r["tokens"]) for r in token_orc.read(spark, str(tmp_path / "ids")).collect()}
    assert got == {i: bpe.encode_ordinary(t) for i, t in rows}
    # runs of white space so long that the vocabulary's own search fails; shorter ones tell what is right
    encoder, decode = token_orc.Encoder(token_orc.VOCABULARY), token_orc.decoder()
    for n in (token_orc.LONG, token_orc.LONG + 1, 3 * token_orc.LONG):
        for text in (" " * n, "a" + " " * n + "b", "\n" * n + "x" + "\t" * n, "don't" + " \n" * n + "'s", "1" + "\u3000" * n + "\u00a0", "." + " " * n + "\x1c."):
            assert encoder.ids(text) == bpe.encode_ordinary(text), (n, text[:3])
    huge = "a" + " " * 1_000_000 + "b" + "\n" * 1_000_000
    assert decode(encoder.ids(huge)) == huge
    empty = str(tmp_path / "none")
    token_orc.write(spark.createDataFrame([], SCHEMA), empty)
    assert token_orc.read(spark, empty).collect() == []


def test_token_stripes(spark, tmp_path):
    path = str(tmp_path / "ids")
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(map(str, rng.integers(0, 10**9, 400)))) for i in range(3000)]
    token_orc.write(spark.createDataFrame(rows, SCHEMA).coalesce(1), path, stripe_bytes=1 << 20)
    (file,) = (tmp_path / "ids").glob("*.orc")
    assert pyarrow.orc.ORCFile(str(file)).nstripes > 1
    plan = token_orc.lookup(spark, path, [5])._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,5)]" in plan or "In(doc_id, [5])" in plan
    assert token_orc.lookup(spark, path, [5]).count() == 1
    # what the file itself says: row indexes and Bloom filters on doc_id in every stripe, and a run-length encoding
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(str(file)), jvm.org.apache.orc.OrcFile.readerOptions(conf))
    assert reader.getRowIndexStride() == token_orc.STRIDE and reader.getSchema().getFieldNames()[0] == "doc_id"
    found = reader.rows()
    seen = 0
    for i in range(reader.getStripes().size()):
        footer = found.readStripeFooter(reader.getStripes().get(i))
        kinds = {(s.getColumn(), s.getKind().toString()) for s in footer.getStreamsList()}
        assert {(1, "ROW_INDEX"), (1, "BLOOM_FILTER_UTF8")} <= kinds
        assert footer.getColumns(1).getKind().toString() == "DIRECT_V2"
        seen += reader.getStripes().get(i).getNumberOfRows()
    assert seen == 3000


# ---- language ---------------------------------------------------------------------------------------------------
def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    known, asked = docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1")
    model = language_id.fit(known)
    tag = {r["doc_id"]: r["lang"] for r in asked.select("doc_id", "lang").collect()}
    got = language_id.identify(asked, model).collect()
    assert len(got) == len(tag)
    accepted = [r for r in got if not r["rejected"]]
    assert len(accepted) >= 0.9 * len(got)
    assert sum(r["lang"] == tag[r["doc_id"]] for r in accepted) >= 0.98 * len(accepted)


def test_language_brute_force():
    model = language_id.train(pa.array(["the cat the dog", "der hund und", "the end", "und der die"], pa.large_string()), ["en", "de", "en", "de"], epochs=20)
    texts = pa.array(["the dog", "ab", "", "die katze und der hund"], pa.large_string())
    got = model.probabilities(texts)
    assert np.isnan(got[[1, 2]]).all()
    ids, shares = language_id._bags(texts)
    for i in (0, 3):
        z = (model.table[:, ids[i]] @ shares[i] + model.bias) / model.temperature
        assert np.allclose(got[i], np.exp(z) / np.exp(z).sum(), atol=1e-4)


def test_language_cases(spark):
    docs = spark.createDataFrame([(*r, None) for r in ODD], SCHEMA + ", lang string")
    got = language_id.identify(docs, language_id.fit(docs)).collect()
    assert len(got) == len(ODD) and all(r["rejected"] and r["lang"] is None for r in got)


def plain_buckets(text):
    """Bucket of every n-gram of bytes of a lower-cased text, white space and control bytes read as blanks."""
    raw = bytes(32 if b <= 32 else b for b in text.lower().encode())
    out = []
    for n, factor in ((3, 0x9E3779B1), (4, 0x85EBCA6B)):
        for i in range(len(raw) - n + 1):
            code = (int.from_bytes(raw[i : i + n], "little") * factor) & 0xFFFFFFFF
            code = ((code ^ (code >> 15)) * 0x2C1B3C6D) & 0xFFFFFFFF
            out.append(code >> (32 - language_id.BITS))
    return out


def test_language_odd_rows(spark):
    """Null, empty, very long, repeated and untagged rows meet a trained model."""
    tagged = [(i, t, g) for i, (t, g) in enumerate([("the cat and the dog on the mat", "en"), ("der hund und die katze", "de")] * 30)]
    docs = spark.createDataFrame(tagged + [(*r, "en" if i % 2 else None) for i, r in enumerate(ODD)] + [tagged[0]] * 500, SCHEMA + ", lang string")
    model = language_id.fit(docs, sample=40)
    assert model.langs == ("de", "en")
    odd = spark.createDataFrame(ODD + [(9, "die katze und der hund"), (9, "die katze und der hund")], SCHEMA)
    got = language_id.identify(odd, model).collect()
    assert len(got) == len(ODD) + 2
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    assert all(by[i][0]["rejected"] and by[i][0]["lang"] is None for i in (1, 2))
    assert len(by[9]) == 2 and by[9][0] == by[9][1] and by[6][0] == by[6][1]
    for r in got:
        t = dict(ODD + [(9, "die katze und der hund")])[r["doc_id"]]
        if t and (own := plain_buckets(t)):
            z = (np.array([model.table[c][own].astype(np.float64).mean() for c in range(2)]) + model.bias) / model.temperature
            assert abs(r["probability"] - (np.exp(z - z.max()) / np.exp(z - z.max()).sum()).max()) < 1e-6
    assert language_id.identify(odd.limit(0), model).collect() == []


# ---- quality ----------------------------------------------------------------------------------------------------
def path_length(forest, t, x):
    node = 0
    while forest.feature[t][node] >= 0:
        node = 2 * node + 1 + int(x[forest.feature[t][node]] >= forest.split[t][node])
    return forest.path[t][node]


def test_forest_brute_force():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((300, 3)).astype(np.float32)
    x[:5] += 8
    forest = quality_rules.grow(x, 60, 64, 1)
    score = forest.score(x)
    assert np.allclose(score, [2 ** (-np.mean([path_length(forest, t, r) for t in range(60)]) / forest.norm) for r in x])
    assert score[:5].min() > np.quantile(score[5:], 0.98)
    labels = np.ones(300, np.int64)
    labels[:5] = 0
    cut = quality_rules.calibrated(forest, x, labels, 0.01)
    assert (score[5:] > cut.threshold).mean() <= 0.01


def plain_statistics(text):
    """The nine statistics of a text from their names, one token after another."""
    tokens = [t for t in re.split("[\t-\r ]+", text or "") if t]
    n, few = len(tokens), 10
    if not n:
        return None
    symbol, mark = set("#$%&*<>{}[]|\\^~=+_@!"), set(".,;:!?\"')")
    letter = lambda b: chr(b).isalpha() if b < 128 else True
    raw = text.encode()
    chars = sum(len(t) for t in tokens)
    runs = [tuple(tokens[i : i + 4]) for i in range(n - 3)]
    return [
        sum(chr(b) in symbol for b in raw) / (chars + 5 * few),
        sum(65 <= b <= 90 for b in raw) / (sum(map(letter, raw)) + 5 * few),
        (chars + 5 * few) / (n + few),
        sum(t[-1] in mark for t in tokens) / (n + few),
        sum(len(t.encode()) == 1 and not t.isalpha() for t in tokens) / (n + few),
        sum(a == b for a, b in zip(tokens, tokens[1:])) / (n + few),
        (max(tokens.count(t) for t in set(tokens)) - 1) / (n + few),
        (len(runs) - len(set(runs))) / (len(runs) + few),
        sum(t[-1] in symbol and len(t.encode()) > 1 for t in tokens) / (n + few),
    ]


def test_statistics_brute_force():
    rng = random.Random(14)
    bits = ["word", "WORD", "a", "$", "!", "x!", "same", "same", "é", "日本", "end.", "1", "<b>", "\u00a0"]
    texts = [rng.choice(["", " "]).join(rng.choice(bits) + rng.choice([" ", "\n", "  "]) for _ in range(rng.randint(0, 60))) for _ in range(80)] + ["", None, " ", "one", "ab " * 3000]
    got = quality_rules.statistics(_vec.texts(pa.array(texts)))
    for t, row in zip(texts, got, strict=True):
        want = plain_statistics(t)
        assert np.isnan(row).all() if want is None else np.allclose(row, want, rtol=1e-5), t


def test_samples_hold_their_bound(spark, monkeypatch):
    """A document that is there many times comes to the driver once."""
    rows = [(1, "the same text again", "en")] * 400 + [(2, "ein anderer text hier", "de")] * 400
    docs = spark.createDataFrame(rows, SCHEMA + ", lang string")
    seen = []
    monkeypatch.setattr(quality_rules, "grow", lambda x, *a: seen.append(len(x)) or 1 / 0)
    with pytest.raises(ZeroDivisionError):
        quality_rules.fit(docs, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int"))
    monkeypatch.setattr(language_id, "train", lambda texts, tags, **o: seen.append(len(tags)))
    language_id.fit(docs)
    assert seen == [2, 2]


def test_quality_held_out(spark):
    """Forest and threshold from half of the labels, judged on the other half."""
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    forest = quality_rules.fit(docs, labels.where("doc_id % 2 = 0"))
    kept = {r["doc_id"] for r in quality_rules.keep_good(docs, forest).select("doc_id").collect()}
    rest = labels.where("doc_id % 2 = 1").select("doc_id", "quality").collect()
    good, bad = ([r["doc_id"] for r in rest if r["quality"] == q] for q in (1, 0))
    assert sum(x in kept for x in good) >= 0.97 * len(good)
    assert sum(x not in kept for x in bad) >= 0.6 * len(bad)


def test_quality_cases(spark):
    docs = spark.createDataFrame([(*r, 1.5) for r in ODD], SCHEMA + ", score double")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    forest = quality_rules.fit(docs, none)
    kept = quality_rules.keep_good(docs, forest)
    assert kept.columns == docs.columns
    assert sorted(repr(r["doc_id"]) for r in kept.collect()) == ["5", "6", "6", "7", "None"]
    labels = spark.createDataFrame([(5, 1), (5, 0), (None, 1), (6, None)], "doc_id long, quality int")
    quality_rules.keep_good(docs, quality_rules.fit(docs, labels)).collect()
    assert quality_rules.keep_good(docs.limit(0), forest).collect() == []
    together = quality_rules.statistics(_vec.texts(pa.array([t for _, t in ODD], pa.string())))
    for i, (_, t) in enumerate(ODD):
        assert np.array_equal(quality_rules.statistics(_vec.texts(pa.array([t], pa.string())))[0], together[i], equal_nan=True)


# ---- personal data ----------------------------------------------------------------------------------------------
def test_spans(spark):
    filler = "Plain words stand here and there. " * 3
    true = ["mail jane.doe@example.org", "call +1 (743) 555-3824", "card 4111 1111 1111 1111", "ssn 123-45-6789", "host 192.168.7.44", "iban DE89 3704 0044 0532 0130 00", "key sk-abcDEF123456ghiJKL789"]
    rows = [(i, f"{filler}{true[i % len(true)]} and so on. {filler}") for i in range(70)] + [(100 + i, filler + f"version {i}.2.1 of {i} parts, page {i}") for i in range(70)]
    got = pii.spans(spark.createDataFrame(rows, SCHEMA)).collect()
    text = dict(rows)
    assert {r["doc_id"] for r in got} == set(range(70))
    for r in got:
        assert text[r["doc_id"]][r["first"] : r["last"]] in true[r["doc_id"] % len(true)]
        assert r["probability"] >= pii.LEAST
    assert len(got) == 70


def test_span_places_brute_force():
    """Candidates found around hot words are those that the pattern finds in the whole text."""
    rng = random.Random(9)
    bits = ["word", "naïve", "a@b.org", "192.168.0.1", "+44 20 7946 0958", "123-45-6789", "x=1", "(see", "12", "日本"]
    texts = [" ".join(rng.choice(bits) + " filler filler filler filler filler filler filler filler filler" for _ in range(rng.randint(0, 30))) for _ in range(40)]
    got = [(r, a, b) for r, a, b, _ in pii.candidates(_vec.texts(pa.array(texts)))]
    assert got == [(i, m.start(), m.end()) for i, t in enumerate(texts) for m in pii._CANDIDATE.finditer(t)]


@pytest.mark.parametrize("bit", ["a%20", "0a1b2c3d", "1.", "a@", "x" * 64 + "@" + "b" * 100, "1234-", "a=1"])
def test_unbroken_tokens(bit):
    """A megabyte without white space takes time in proportion to its length."""
    import time

    took = []
    for size in (1 << 17, 1 << 20):
        text = pa.array([(bit * size)[:size]], pa.large_string())
        began = time.process_time()
        list(pii.candidates(text))
        took.append(time.process_time() - began)
    assert took[1] < 6 and took[1] < 24 * max(took[0], 0.02)


@pytest.mark.parametrize(
    ("kind", "span", "before", "after", "want"),
    [
        ("email", "jane@example.org", "mail ", " now", (1, 1, 1, 1, 1, 1)), ("email", "a..b@x.zz", "x/", "/", (1, 2, 2, 0, 0, 2)), ("ip", "300.1.1.1", "", "", (2, 2, 2, 0, 0, 1)),
        ("ip", "127.0.0.1", "version ", ".", (1, 1, 2, 2, 0, 1)), ("card", "4111 1111 1111 1111", "visa ", "", (1, 1, 1, 1, 2, 1)), ("card", "4111 1111 1111 1112", "order ", "", (1, 2, 1, 2, 0, 1)),
        ("iban", "DE89 3704 0044 0532 0130 00", "iban: ", ".", (1, 1, 0, 1, 1, 1)), ("iban", "DE88 3704 0044 0532 0130 00", "", "", (1, 2, 0, 0, 1, 1)), ("ssn", "000-12-3456", "ssn ", "", (2, 0, 0, 1, 1, 1)),
        ("phone", "+44 20 7946 0958", "call ", ",", (1, 1, 1, 1, 1, 1)), ("secret", "sk-abcDEF123456ghiJKL789", "key=", "", (1, 1, 1, 1, 1, 1)),
    ],
)
def test_votes(kind, span, before, after, want):
    assert pii.votes(kind, span, before, after) == want


def test_em_recovers_reliabilities():
    rng = np.random.default_rng(3)
    n = 40_000
    truth = rng.random(n) < 0.3
    right = [0.95, 0.9, 0.85, 0.8, 0.75, 0.6]
    vote = np.stack([np.where(rng.random(n) < p, np.where(truth, 1, 2), np.where(truth, 2, 1)) for p in right], 1)
    each, count = np.unique(vote, axis=0, return_counts=True)
    p, table = pii.expectation_maximisation(np.zeros(len(each), np.int64), each, count.astype(float))
    assert np.allclose([table[j, 1, 1] for j in range(6)], right, atol=0.03)
    both = {tuple(e): q for e, q in zip(each.tolist(), p, strict=True)}
    assert np.mean([(both[tuple(v)] > 0.5) == t for v, t in zip(vote[:3000].tolist(), truth[:3000], strict=True)]) > 0.95


def test_span_cases(spark):
    assert pii.spans(spark.createDataFrame(ODD, SCHEMA)).collect() == []
    assert pii.spans(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(None, "mail a.b@example.com now"), (None, "mail a.b@example.com now"), (3, "x " * 50_000 + "mail c.d@example.com now")]
    got = pii.spans(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r["first"], r["last"]) for r in got) == [(5, 20), (5, 20), (100_005, 100_020)]
