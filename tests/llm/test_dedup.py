"""Line dedup and near-dedup against brute force."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from poslex.llm import _vec, line_dedup, minhash_dedup

SCHEMA = "doc_id long, text string"
WORDS = [f"w{i}" for i in range(60)]


def sets(text):
    return [frozenset(line.lower().split()) for line in text.split("\n")]


def brute_lines(rows, percent=80):
    """Of distinct (doc_id, text) the text that is left."""
    lines = []
    for doc, text in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0)):
        for i, s in enumerate(sets(text or "")):
            lines.append(((doc, text), i, s))
    gone = {
        (k, i)
        for n, (k, i, s) in enumerate(lines)
        if s and any(t and 100 * len(s & t) >= percent * len(s | t) for _, _, t in lines[:n])
    }
    return {(doc, text): None if text is None else "\n".join(x for i, x in enumerate(text.split("\n")) if ((doc, text), i) not in gone) for doc, text in set(rows)}


def corpus(seed, n=60):
    rng = random.Random(seed)
    pool = [rng.choices(WORDS, k=rng.randint(1, 14)) for _ in range(25)]
    rows = []
    for d in range(n):
        lines = []
        for _ in range(rng.randint(0, 6)):
            own = list(rng.choice(pool)) if rng.random() < 0.6 else rng.choices(WORDS, k=rng.randint(0, 14))
            if own and rng.random() < 0.5:
                own[rng.randrange(len(own))] = rng.choice(WORDS)
            lines.append(" ".join(x.upper() if rng.random() < 0.1 else x for x in own))
        rows.append((d, "\n".join(lines)))
    return rows


@pytest.mark.parametrize(("percent", "most"), [(50, 1 << 22), (80, 1 << 22), (80, 0), (100, 0)])
def test_lines_brute_force(spark, percent, most):
    """With the bitmap and, as for more lines than it may hold, with joins."""
    rows = corpus(percent)
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, SCHEMA), percent, most).collect()
    assert {(r["doc_id"]): r["text"] for r in got} == {k[0]: v for k, v in brute_lines(rows, percent).items()}


def families(seed, copies):
    """Near copies of a short, a middling and a long line; some match only few of the others."""
    rng = random.Random(seed)
    rows = []
    for size, most in ((12, 1), (40, 5), (130, 16)):
        base = [f"f{size}_{i}" for i in range(size)]
        for _ in range(copies):
            own = list(base)
            for i in rng.sample(range(size), rng.randint(0, most)):
                own[i] = f"n{rng.randrange(10**6)}"
            rows.append(" ".join(own))
    rng.shuffle(rows)
    return [(d // 2, line) for d, line in enumerate(rows)]


@pytest.mark.parametrize("bits", [1 << 27, 64])
def test_near_copies_are_not_paired_with_each_other(spark, monkeypatch, bits):
    """Candidates in proportion to the lines; and no match is lost, however small the bitmap of open lines."""
    rows, counts, written = families(5, 200), {}, line_dedup._run.materialise

    def counted(df, name):
        out = written(df, name)
        counts[name] = counts.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(line_dedup._run, "materialise", counted)
    monkeypatch.setattr(line_dedup, "MOST_BITS", bits)
    docs = spark.createDataFrame([(d, "\n".join(t for e, t in rows if e == d)) for d in sorted({d for d, _ in rows})], SCHEMA)
    got = {(r["doc_id"]): r["text"] for r in line_dedup.dedup_lines(docs).collect()}
    assert got == {k[0]: v for k, v in brute_lines([tuple(r) for r in docs.collect()]).items()}
    assert counts["open"] > 0
    if bits > 64:
        assert counts["near"] < 10 * len(rows) and counts["pairs"] < 20 * len(rows)


def test_line_cases(spark):
    long = " ".join(f"t{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, "a b c\n\n\t \na b c"), (None, "a b c\nx y"), (5, long), (6, long + "\nZ"), (7, "x Y"), (7, "x Y"), (8, "\n\n")]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert by[1]["text"] is None and by[2]["text"] == "" and by[8]["text"] == "\n\n"
    assert by[3]["text"] == "a b c\n\n\t " and by[3]["n_removed"] == 1
    assert by[None]["text"] == "" and by[None]["n_removed"] == 2
    assert by[5]["text"] == long and by[6]["text"] == "Z"
    assert [r["text"] for r in got if r["doc_id"] == 7] == ["x Y", "x Y"]
    assert line_dedup.dedup_lines(spark.createDataFrame([], SCHEMA)).collect() == []


def test_ids_of_other_types(spark):
    """Ids are ordered as their type is, and come out as they are; a null id is last, and null."""
    text, other = "one two three four five", "six seven eight nine ten"
    rows = [("b", text), ("a10", text + " more"), ("a9", other), (None, other + " and"), (None, text)]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    got = sorted(((r["doc_id"], r["text"], r["n_removed"]) for r in line_dedup.dedup_lines(docs).collect()), key=repr)
    assert got == sorted([("b", "", 1), ("a10", text + " more", 0), ("a9", other, 0), (None, "", 1), (None, "", 1)], key=repr)
    twins = [("b", text), ("a10", text.upper()), (None, text), (None, text.upper()), ("z", other)]
    got = minhash_dedup.duplicates(spark.createDataFrame(twins, "doc_id string, text string")).collect()
    assert {(r["doc"], r["keep_doc"]) for r in got} == {("b", "a10"), (None, "a10")} and len(got) == 3
    assert sorted((r["doc_id"] for r in minhash_dedup.one_of_each(spark.createDataFrame(twins, "doc_id string, text string")).collect())) == ["a10", "z"]


def test_repeated_rows_of_lines(spark):
    """One row, many times, among near copies of it: every repeat is treated alike."""
    a = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    rows = [(1, a)] * 50 + [(2, a + " more\nown line here")] * 50
    got = {(r["doc_id"], r["text"], r["n_removed"]) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, SCHEMA), 80).collect()}
    assert got == {(1, a, 0), (2, "own line here", 1)}


def test_line_other_columns(spark):
    docs = spark.createDataFrame([(1, "a", "p", 1), (2, "a", None, 2)], "doc_id long, text string, gone string, line int")
    got = {r["doc_id"]: (r["text"], r["rest"]["gone"], r["rest"]["line"]) for r in line_dedup.dedup_lines(docs).collect()}
    assert got == {1: ("a", "p", 1), 2: ("", None, 2)}


# ---- MinHash ----------------------------------------------------------------------------------------------------
def near_copies(seed, groups=12, size=6):
    rng = random.Random(seed)
    rows, doc = [], 0
    for _ in range(groups):
        base = [f"v{rng.randrange(5000)}" for _ in range(rng.randint(8, 120))]
        for _ in range(rng.randint(1, size)):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(own) // 25))):
                own[rng.randrange(len(own))] = f"v{rng.randrange(5000)}"
            rows.append((doc, " ".join(own)))
            doc += 1
    rng.shuffle(rows)
    return rows


MASK, STEP = 2**64 - 1, 0x9E3779B97F4A7C15


def mixed(h, seed=0):
    h = (h + seed * 0xD1342543DE82EF95 + 0x2545F4914F6CDD1D) & MASK
    h = ((h ^ (h >> 32)) * 0xD6E8FEB86659FD93) & MASK
    h = ((h ^ (h >> 29)) * 0xBF58476D1CE4E5B9) & MASK
    return h ^ (h >> 32)


def plain_signature(text):
    """The signature of a text from the definition, one token after another; None without tokens."""
    tokens = [t for t in re.split("[\t-\r ]+", text.lower()) if t]
    hashes = []
    for raw in (t.encode() for t in tokens):
        total = sum(b * pow(STEP, i, 2**64) for i, b in enumerate(raw)) & MASK
        hashes.append(mixed((total + (len(raw) << 56)) & MASK))
    n = minhash_dedup.WORDS
    runs = [hashes[i : i + n] for i in range(max(1, len(hashes) - n + 1))] if hashes else []
    shingles = {mixed(sum(h * pow(STEP, i, 2**64) for i, h in enumerate(run)) & MASK) for run in runs}
    return [mixed(min((x * int(f)) & MASK for x in shingles)) & 0xFFFFFFFF for f in minhash_dedup._FACTORS] if shingles else None


def test_signatures_from_their_definition():
    rng = random.Random(12)
    words = ["a", "B", "é", "日本", "word", "\u00a0x", "tail"]
    texts = ["".join(rng.choice(words) + rng.choice([" ", "\n", "\t ", "  "]) for _ in range(rng.randint(0, 12))) for _ in range(40)] + ["", " ", "one", "one two", "x" * 5000]
    who, sig = minhash_dedup.signatures(_vec.texts(pa.array(texts), lower=True))
    want = {i: s for i, t in enumerate(texts) if (s := plain_signature(t)) is not None}
    assert dict(zip(who.tolist(), sig.tolist(), strict=True)) == want


def brute_groups(rows, matches=minhash_dedup.MATCHES):
    """Least doc_id of each row's component under at least ``matches`` agreements."""
    plain = [plain_signature(t) for _, t in rows]
    who = np.array([i for i, s in enumerate(plain) if s is not None])
    sig = np.array([plain[i] for i in who])
    parent = {int(w): int(w) for w in who}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(who)):
        for j in np.flatnonzero((sig[i] == sig[:i]).sum(1) >= matches):
            parent[root(int(who[i]))] = root(int(who[j]))
    least = {}
    for w in who.tolist():
        least[root(w)] = min(least.get(root(w), 2**63), rows[w][0])
    return {rows[w][0]: least[root(w)] for w in who.tolist()}


def jaccard(a, b):
    shingles = lambda t: {tuple(t.split()[i : i + minhash_dedup.WORDS]) for i in range(max(1, len(t.split()) - minhash_dedup.WORDS + 1))}
    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y)


def test_groups_brute_force(spark):
    rows = near_copies(1)
    got = minhash_dedup.duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    want = {d: k for d, k in brute_groups(rows).items() if d != k}
    assert {r["doc"]: r["keep_doc"] for r in got} == want


def test_pairs_brute_force(spark):
    """All pairs above the threshold are found, and no others."""
    from pyspark.sql import functions as F

    rows = near_copies(2, groups=20)
    _, groups = minhash_dedup.signature_groups(spark.createDataFrame(rows, SCHEMA))
    own = groups.withColumn("part", F.col("group"))
    name = {r["group"]: r["doc"] for r in groups.collect()}
    found = {frozenset((name[r["a"]], name[r["b"]])): r["matches"] for r in minhash_dedup.matching_pairs(own, minhash_dedup._rarity(groups)).collect()}
    text = dict(rows)
    docs = sorted(name.values())
    _, sig = minhash_dedup.signatures(_vec.texts(pa.array([text[d] for d in docs], pa.string()), lower=True))
    want = {frozenset((docs[i], docs[j])): n for i in range(len(docs)) for j in range(i) if (n := int((sig[i] == sig[j]).sum())) >= minhash_dedup.MATCHES}
    assert found == want


def test_recall_against_jaccard(spark):
    rows = near_copies(3, groups=40)
    pairs = [(a, b) for i, (a, x) in enumerate(rows) for b, y in rows[:i] if jaccard(x, y) >= 0.6]
    group = brute_groups(rows)
    assert sum(group[a] == group[b] for a, b in pairs) >= 0.9 * len(pairs)
    far = [(a, b) for i, (a, x) in enumerate(rows) for b, y in rows[:i] if jaccard(x, y) < 0.1]
    assert not any(group[a] == group[b] for a, b in far)


def test_large_group(spark):
    """A group much larger than a signature, and a chain whose ends don't match."""
    base = [f"q{i}" for i in range(200)]
    rows = [(i, " ".join([*base, f"end{i}"])) for i in range(400)]
    chain = [(1000 + i, " ".join(f"c{j}" for j in range(12 * i, 12 * i + 120))) for i in range(25)]
    got = {r["doc"]: r["keep_doc"] for r in minhash_dedup.duplicates(spark.createDataFrame(rows + chain, SCHEMA)).collect()}
    assert got == {d: k for d, k in brute_groups(rows + chain).items() if d != k}
    assert sum(k == 0 for k in got.values()) == 399


def test_dedup_cases(spark):
    text = "one two three four five six seven"
    rows = [(1, None), (2, ""), (3, " \n"), (4, text), (None, text.upper()), (5, "tiny"), (6, "TINY"), (7, "x y"), (7, "x y"), (8, None)]
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, first int")
    kept = minhash_dedup.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == [1, 2, 3, 4, 5, 7, 8]
    empty = spark.createDataFrame([], SCHEMA)
    assert minhash_dedup.one_of_each(empty).collect() == []
    assert minhash_dedup.duplicates(empty).collect() == []


def test_query_rows_that_share_an_id(spark, tmp_path):
    """Repeated rows, rows that share a doc_id but not the text, and rows without a doc_id are duplicates like others."""
    long = " ".join(f"w{i}" for i in range(200))
    x, y, z = long, long.replace("w", "v"), long.replace("w", "u")
    rows = [(1, x), (1, x), (1, x), (2, y), (2, y + " end"), (None, z), (None, z + " end"), (4, "a b c d"), (None, "A b c d"), (5, "alone in here"), (None, "also alone")]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    hashes = {r["text"]: r["h"] for r in spark.createDataFrame(rows, SCHEMA).selectExpr("text", "xxhash64(text) AS h").collect()}
    text = {h: t for t, h in hashes.items()}
    got = sorted(((r["doc_id"], text[r["text_hash"]], r["kept_doc_id"], text[r["kept_text_hash"]], r["copies"]) for r in minhash_dedup.query(spark, str(tmp_path)).collect()), key=repr)
    first = lambda a, b: sorted((a, b), key=hashes.get)
    (y0, y1), (z0, z1) = first(y, y + " end"), first(z, z + " end")
    assert got == sorted([(1, x, 1, x, 3), (2, y1, 2, y0, 1), (None, z1, None, z0, 1), (None, "A b c d", 4, "a b c d", 1)], key=repr)


def test_components(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    got = {r["name"]: r["least"] for r in minhash_dedup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent if root(x) != x}


def test_buckets_of_lines_follow_the_tokens(spark, monkeypatch):
    """A task holds the lines of one bucket, which isn't put together with others, however few shuffle partitions there are."""
    made, own = {}, line_dedup._run.materialise

    def spy(df, name):
        out = own(df, name)
        made[name] = out.count()
        return out

    monkeypatch.setattr(line_dedup, "BUCKET_TOKENS", 50, raising=False)
    monkeypatch.setattr(line_dedup._run, "materialise", spy)
    rows = [(i, "\n".join(f"word{i} thing{j} more{i + j} text" for j in range(5)) + "\nthe same line for all") for i in range(60)]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r["n_removed"] for r in got) == [0] + [1] * 59
    assert made["sets"] >= 2 * 20
