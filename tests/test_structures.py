import random

from pyspark.sql import functions as F

from poslex.functions.text import adjusted_scale, collocate_offset, score
from poslex.operators import lexicon as lx
from poslex.operators import structures as st


def frames(spark, ranges, positions):
    return spark.createDataFrame([(p,) for p in positions], "pos long"), spark.createDataFrame([(i, b, e) for i, (b, e) in enumerate(ranges)], "num long, beg long, end long")


def answer(df, *columns):
    return {r["pos"]: r[columns[0]] if len(columns) == 1 else tuple(r[c] for c in columns) for r in df.collect()}


def closed_end(ranges, p):
    low = ranges[:-1]
    same = [i for i, (_, e) in enumerate(low) if e == p]
    after = [i for i, (_, e) in enumerate(low) if e > p]
    i = max(same) if same else min(after) if after else None
    return (None, None) if i is None else (i, low[i][0])


def closed_num(ranges, p):
    i, b = closed_end(ranges, p + 1)
    if i is None:
        return None
    if b <= p or ranges[i][0] == ranges[i][1] and b == p + 1:
        return i
    return i - 1 if i > 0 and ranges[i - 1][0] == p else None


def test_closed_forms(spark):
    rng = random.Random(3)
    for _ in range(2):
        cuts = sorted(rng.choices(range(30), k=14))
        ranges = list(zip(cuts[::2], cuts[1::2], strict=True))
        pos, own = frames(spark, ranges, range(32))
        own = own.cache()
        assert answer(st.next_start(pos, own, True), "beg") == {p: min((b for b, _ in ranges[:-1] if b >= p), default=None) for p in range(32)}
        assert answer(st.next_start(pos, own), "beg") == {p: min((b for b, _ in ranges if b >= p), default=None) for p in range(32)}
        assert answer(st.by_end(pos, own, True), "num", "beg") == {p: closed_end(ranges, p) for p in range(32)}
        assert answer(st.by_end(pos, own), "num", "beg") == {p: closed_end([*ranges, (99, 99)], p) for p in range(32)}
        assert answer(st.number_at(pos, own, True), "num") == {p: closed_num(ranges, p) for p in range(32)}


def test_containing(spark):
    rng = random.Random(4)
    for nested in (False, True):
        cuts = sorted(rng.sample(range(60), 12))
        ranges = [(a, a + rng.randint(1, 25)) for a in cuts] if nested else list(zip(cuts[::2], cuts[1::2], strict=True))
        pos, own = frames(spark, ranges, range(70))
        want = {p: min(((e - b, -i) for i, (b, e) in enumerate(ranges) if b <= p < e), default=None) for p in range(70)}
        assert st.disjoint(own) != nested
        assert answer(st.number_at(pos, own), "num") == {p: None if x is None else -x[1] for p, x in want.items()}


def test_none(spark):
    pos, own = frames(spark, [], [0, 3])
    for compat in (False, True):
        assert answer(st.number_at(pos, own, compat), "num") == {0: None, 3: None}
        assert answer(st.next_start(pos, own, compat), "beg") == {0: None, 3: None}
        assert answer(st.by_end(pos, own, compat), "num", "beg") == {0: (None, None), 3: (None, None)}
    pos, own = frames(spark, [(0, 2)], [0])
    assert answer(st.number_at(pos, own, True), "num") == {0: None}


def test_gaps(spark):
    """Also for an id whose list runs over several partitions."""
    rng = random.Random(8)
    rows = [(0 if rng.random() < 0.7 else rng.randint(1, 5), p) for p in range(300)]
    want, before = [], {}
    for i, p in rows:
        want.append((i, p, p - before.get(i, -1)))
        before[i] = p
    got = lx.gaps(spark.createDataFrame(rows, "id long, pos long"))
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    back = lx.from_gaps(got.withColumnRenamed("pos", "ord"))
    assert all(r["ord"] == r["pos"] for r in back.collect()) and back.count() == 300
    assert lx.gaps(spark.createDataFrame([], "id long, pos long")).collect() == []


def test_no_window_over_all_rows(spark):
    pos, own = frames(spark, [(0, 2), (3, 5)], range(9))
    for df in (st.next_start(pos, own), st.by_end(pos, own), st.number_at(pos, own), lx.gaps(own.select(F.col("num").alias("id"), F.col("beg").alias("pos"))), lx.lexicon(pos.select("pos", F.lit("x").alias("value")))):
        assert "Window" not in df._jdf.queryExecution().executedPlan().toString()


def test_tables_between_steps(spark):
    from pathlib import Path

    from poslex.operators import _shared

    folder = Path(_shared.shared_dir(spark).removeprefix("file://"))
    names = lambda: {p.name.split("-")[0] for p in folder.iterdir() if p.name.startswith("only")}
    kept = []
    with _shared.only_kept(spark, kept):
        _shared.written(spark.range(3), "only1")
        kept.append(_shared.written(spark.range(5), "only2"))
        assert names() == {"only1", "only2"}
    assert names() == {"only2"} and kept[0].count() == 5
    _shared.drop(kept[0])
    assert names() == set()


def test_codes(spark):
    rows = spark.createDataFrame([(c,) for c in (1, 2, 3, 4, 5)], "c long").select(collocate_offset(F.col("c")).alias("o")).collect()
    assert [r["o"] for r in rows] == [None, 1, -1, 2, -2]
    assert abs(spark.range(1).select(score(F.lit(1)).alias("s")).first()["s"] + 9.99268) < 1e-4
    assert adjusted_scale(5, 12, 20.0) == (-4.0, 4096 / 24)


def test_lexicon_properties(spark):
    rng = random.Random(6)
    words = [rng.choice(["b", "a", "", "é", "Z", "zz"]) for _ in range(200)]
    column = spark.createDataFrame(list(enumerate(words)), "pos long, value string")
    lex = lx.ranked(lx.lexicon(column)).cache()
    rows = lex.orderBy("id").collect()
    assert [r["value"] for r in rows] == list(dict.fromkeys(words))
    assert [r["value"] for r in sorted(rows, key=lambda r: r["sort_rank"])] == sorted(set(words), key=lambda w: w.encode())
    assert sum(r["frq"] for r in rows) == len(words)
    ids = lx.encoded(column, lex)
    assert {r["pos"]: r["value"] for r in lx.decoded(ids.drop("value"), lex).collect()} == dict(enumerate(words))
    index = lx.postings(ids)
    assert sorted(r["pos"] for r in index.collect()) == list(range(200))
    gapped = [(r["id"], r["pos"], r["gap"]) for r in lx.gaps(index).collect()]
    assert all(g > 0 for _, _, g in gapped)
    back = lx.from_gaps(spark.createDataFrame(gapped, "id long, ord long, gap long"))
    assert all(r["ord"] == r["pos"] for r in back.collect())
    one = lx.fingerprint(ids).first()[0]
    assert one == lx.fingerprint(ids.repartition(7)).first()[0]
    assert one != lx.fingerprint(ids.where("pos > 0")).first()[0]
