import pytest

from poslex import collection
from poslex.sources import config, vertical

TWO = 'PATH "."\nATTRIBUTE word\nATTRIBUTE tag\nSTRUCTURE s { ATTRIBUTE a\nATTRIBUTE b\nATTRIBUTE i }\nSTRUCTURE p\n'
THREE = 'PATH "."\nATTRIBUTE word\nATTRIBUTE mid\nATTRIBUTE tag\n'


def parsed(spark, lines, conf=TWO):
    rows = spark.createDataFrame(list(enumerate(lines, 1)), "line long, value string")
    return vertical.parse(rows, config.Config.of(conf))


def tokens(spark, lines, conf=TWO):
    out = parsed(spark, lines, conf).tokens.orderBy("pos").drop("pos", "line").collect()
    return [tuple(r) for r in out]


def ranges(got, name="s"):
    return [(r["num"], r["beg"], r["end"]) for r in got.structure(name).orderBy("num").collect()]


@pytest.mark.parametrize(
    ("line", "want"),
    [("a", [("a", "===NONE===")]), ("a\t", [("a", "===NONE===")]), ("\tNN", [("NN", "===NONE===")]), ("a\tb\tc", [("a", "b")]), ("", []), ("#x", []), ("  # y", []), ("<g/>", [("<g/>", "===NONE===")]), ("a\r", [("a", "===NONE===")]), (" a ", [("a", "===NONE===")])],
)
def test_token_lines(spark, line, want):
    assert tokens(spark, [line]) == want


def test_inner_empty_column(spark):
    assert tokens(spark, ["a\t\tc"], THREE) == [("a", "", "c")]


@pytest.mark.parametrize(
    ("lines", "s", "p"),
    [
        (["<s>", "a", "<p>", "b", "</s>", "</p>"], [], [(0, 1, 2)]),
        (["<s>", "a", "<s>", "b", "</s>", "c", "</s>"], [(0, 1, 2), (1, 0, 3)], []),
        (["a", "<s/>", "b"], [(0, 1, 1)], []),
        (["<s/>", "<s>", "a", "</s>"], [(0, 0, 1)], []),
        (["a", "<s/>"], [(0, 1, 1)], []),
        (["<s>", "</s>"], [(0, 0, 0)], []),
        (["<s>", "a", "<s/>", "</s>", "b"], [(0, 0, 1), (1, 1, 1)], []),
        (["  <s>  ", "a", "</s>"], [(0, 0, 1)], []),
        (["</s>"], [], []),
        ([], [], []),
    ],
)
def test_ranges(spark, lines, s, p):
    got = parsed(spark, lines)
    assert ranges(got) == s
    assert ranges(got, "p") == p


def test_last_empty_one_stands(spark):
    rows = parsed(spark, ["<s i=1/>", "<s i=2/>", "a"]).structure("s").collect()
    assert [(r["beg"], r["end"], r["i"]) for r in rows] == [(0, 0, "2")]


@pytest.mark.parametrize(
    ("text", "want"),
    [("""a="1" b='2' c=3 a="4" """, {"a": "4", "b": "2", "c": "3"}), ('a="1" x b="2"', {"a": "1"}), ('a = "1"  b= 2', {"a": "1", "b": "2"}), ('a="1', {}), ("", {}), ('a="x &amp; y"', {"a": "x &amp; y"})],
)
def test_attributes(spark, text, want):
    assert vertical.parse_attributes(text) == want
    rows = spark.createDataFrame([(1, text)], "line long, rest string")
    assert vertical.attributes(rows).first()["attrs"] == want


def sequential(lines, names):
    """A direct restatement of tag matching: ranges by name in the order they are written."""
    stack, pending, out, pos = [], {}, [], 0
    for kind, name in lines:
        if kind == "token":
            out += [(n, pos, pos) for n, _ in sorted(pending.items(), key=lambda x: x[1])]
            pending, pos = {}, pos + 1
        elif kind == "empty":
            pending.pop(name, None)
            pending[name] = len(pending) + len(out) * 1000
        elif kind == "start":
            pending.pop(name, None)
            stack.append((name, pos))
        elif stack and stack[-1][0] == name:
            out.append((name, stack.pop()[1], pos))
    out += [(n, pos, pos) for n in pending]
    return {n: [(b, e) for m, b, e in out if m == n] for n in names}


def test_random_tags(spark):
    import random

    rng = random.Random(5)
    for _ in range(4):
        events = [(rng.choice(["token", "start", "end", "empty"]), rng.choice("sp")) for _ in range(40)]
        shapes = {"token": "x", "start": "<{}>", "end": "</{}>", "empty": "<{}/>"}
        got = parsed(spark, [shapes[k].format(n) for k, n in events])
        want = sequential(events, "sp")
        for name in "sp":
            rows = got.structure(name).orderBy("num").collect()
            assert [(r["beg"], r["end"]) for r in rows] == want[name], events


def stack(events):
    """A direct restatement of the rules for ends: (line, start_line, problem)."""
    open_, out = [], []
    for line, opens, name in events:
        if opens:
            open_.append((line, name))
        elif open_ and open_[-1][1] == name:
            out.append((line, open_.pop()[0], None))
        else:
            out.append((line, None, vertical.MISMATCH if open_ else vertical.NOT_OPEN))
    return sorted(out + [(line, None, vertical.UNTERMINATED) for line, _ in open_])


@pytest.mark.parametrize("kind", ["random", "root", "stray", "nested"])
def test_stretches(spark, kind):
    """Tags matched in stretches of the text, whose results then meet, are those matched one after another."""
    import random

    rng = random.Random(kind)
    doc = lambda: [(True, "doc"), *[(o, "s") for _ in range(rng.randint(0, 5)) for o in (True, False)], (False, "doc")]
    events = {
        "random": [(rng.random() < 0.5, rng.choice("sp")) for _ in range(400)],
        "root": [(True, "root"), *[e for _ in range(80) for e in doc()], (False, "root")],
        "stray": [e for _ in range(60) for e in [*doc(), (False, "s")]] + [(True, "doc")],
        "nested": [(True, "ab"[i % 2]) for i in range(150)] + [(False, "ab"[(i + 1) % 2]) for i in range(150)],
    }[kind]
    rows = [(i, *e) for i, e in enumerate(events)]
    got = vertical.matched(spark.createDataFrame(rows, "line long, opens boolean, name string"), at_once=20).collect()
    assert sorted(tuple(r) for r in got) == stack(rows)


def test_no_shuffle_of_text(spark, tmp_path):
    """Files are numbered, and told into tokens and tags, without their lines going through a shuffle or a window."""
    (tmp_path / "a.vrt").write_text("".join(f"<s>\nw{i}\tx\n</s>\n" for i in range(200)))
    got = vertical.parse(vertical.Lines.of_files(spark, str(tmp_path)), config.Config.of(TWO))
    plan = got.tokens._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan.replace("BroadcastExchange", "") and "Window" not in plan and "Sort" not in plan
    assert got.tokens.count() == 200 and got.structure("s").count() == 200


def test_marks_and_splits(spark, tmp_path):
    """Byte order marks belong to the first token of a file; blocks of a file are numbered in order."""
    want = []
    for i, (mark, end) in enumerate([("\ufeff", "\n"), ("", ""), ("\ufeff", ""), ("", "\n")]):
        lines = [mark + "<s>"] + [f"line {i} {j}" for j in range(300)]
        (tmp_path / f"{i}.vrt").write_bytes(("\n".join(lines) + end).encode())
        want += lines
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        rows = vertical.read_lines(spark, str(tmp_path)).orderBy("line").collect()
        got = vertical.parse(vertical.Lines.of_files(spark, str(tmp_path)), config.Config.of(TWO)).tokens.orderBy("pos").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [(r["line"], r["value"]) for r in rows] == list(enumerate(want, 1))
    assert [(r["pos"], r["word"]) for r in got] == list(enumerate(x for x in want if x != "<s>"))


def test_problems(spark):
    got = parsed(spark, ["</s>", "<s>", "</p>", "<s>", "a"])
    assert {r["kind"]: r["n"] for r in got.summary().collect()} == {vertical.NOT_OPEN: 1, vertical.MISMATCH: 1, vertical.SAME_PLACE: 1, vertical.UNTERMINATED: 1}
    assert [r["line"] for r in got.messages().where(f"kind = '{vertical.MISMATCH}'").collect()] == [3]


def test_read_lines(spark, tmp_path):
    (tmp_path / "a.vrt").write_bytes("x\ry\n\né\n".encode())
    (tmp_path / "b.vrt").write_bytes(b"last")
    rows = vertical.read_lines(spark, str(tmp_path)).orderBy("line").collect()
    assert [(r["line"], r["value"]) for r in rows] == [(1, "x\ry"), (2, ""), (3, "é"), (4, "last")]
    (tmp_path / "c.vrt").write_bytes(b"\xff\xfe")
    with pytest.raises(Exception, match="invalid UTF-8"):
        vertical.read_lines(spark, str(tmp_path)).collect()


SMALL = 'PATH "./out"\nDEFAULTATTR word\nATTRIBUTE word {\n TYPE "MD_MD"\n}\nATTRIBUTE lc { DYNAMIC lower\nFROMATTR word }\nSTRUCTURE doc {\n TYPE "file64"\n ATTRIBUTE id {\n TYPE "MD_MI"\n }\n ATTRIBUTE n\n}\n'


def test_collection(spark, tmp_path):
    (tmp_path / "small").write_text(SMALL)
    (tmp_path / "in.vrt").write_text('<doc id="d1">\nhello\nworld\n</doc>\n<doc id="d2"/>\n<doc id="d3">\nagain\n</doc>\n')
    conf = config.Config.open(str(tmp_path / "small"))
    collection.build(spark, conf, str(tmp_path / "in.vrt"))
    c = collection.Collection.open(spark, str(tmp_path / "small"))
    word = c.attribute("word")
    assert [tuple(r) for r in word.values().collect()] == [(0, 0, "hello"), (1, 1, "world"), (2, 2, "again")]
    assert [r["id"] for r in word.lex.orderBy("sort_rank").collect()] == [2, 0, 1]
    assert (word.str2id("world"), word.str2id("aaa"), word.str2id("m"), word.str2id("zzz")) == (1, None, None, None)
    assert (word.id2str(2), word.id2str(7), word.get(1), word.get(9), word.id_range(), word.size(), word.frq(0), word.frq(9)) == ("again", None, 1, None, 3, 3, 1, 0)
    assert [r["pos"] for r in word.id2poss(2).collect()] == [2]
    assert [r["id"] for r in word.iter_ids(1).collect()] == [1, 2]
    doc = c.structure("doc")
    assert (len(doc), doc.beg_at(1), doc.end_at(0), doc.end_at(5)) == (2, 2, 2, None)
    asked = spark.range(4).toDF("pos")
    nums = lambda compat: [r["num"] for r in doc.num_at_pos(asked, compat).orderBy("pos").collect()]
    assert nums(False) == [0, 0, 1, None]
    assert nums(True) == [0, 0, None, None]
    begs = lambda compat: [r["beg"] for r in doc.find_beg(asked, compat).orderBy("pos").collect()]
    assert begs(False) == [0, 2, 2, None]
    assert begs(True) == [0, None, None, None]
    assert [(r["num"], r["beg"]) for r in doc.find_end(asked, True).orderBy("pos").collect()] == [(0, 0), (0, 0), (0, 0), (None, None)]
    with pytest.raises(config.AttributeNotFound):
        c.attribute("doc.id")
    assert [r["id"] for r in c.struct_text("doc", "id").orderBy("pos").collect()] == [0, 1]
    assert [tuple(r) for r in c.attribute("doc.n").values().collect()] == [(0, 0, "===NONE==="), (1, 0, "===NONE===")]
    assert [(r["kind"], r["line"]) for r in c.problems().collect()] == [(vertical.SAME_PLACE, 6)]
    from pyspark.sql import functions as F

    c.derive("lc", F.substring("value", 1, 1))
    lc = c.attribute("lc")
    assert lc.str2id("w") == 1 and lc.frq(1) == 1 and [r["id"] for r in lc.iter_ids().collect()] == [0, 1, 2]
    c.add_frequency("word", "docf", spark.createDataFrame([(0, 5)], "id long, freq long"))
    assert [tuple(r) for r in word.get_freq("docf:l").collect()] == [(0, 5)]
    with pytest.raises(ValueError):
        word.get_freq("docf")


def test_configuration(monkeypatch, tmp_path):
    (tmp_path / "c").write_text('PATH /data/x\nATTRIBUTE word\nATTRIBUTE lemma_lc\nATTRIBUTE lemma\nSEGMENTSIZE many\n')
    monkeypatch.setenv(config.REGISTRY_VARIABLE, f":{tmp_path}:")
    c = config.Config.open("c")
    assert (c.path, c.get("DEFAULTATTR"), c.get("WSATTR"), c.get("WSBASE"), c.segment_size()) == ("/data/x/", "word", "lemma_lc", "/data/x/lemma_lc-ws", 128)
    with pytest.raises(FileNotFoundError):
        config.Config.open("none")
    with pytest.raises(config.AttributeNotFound):
        c.attribute("no")
    with pytest.raises(config.AttributeNotFound):
        c.attribute("no.no")
    with pytest.raises(config.AttributeNotFound):
        config.Config.of("ATTRIBUTE word")


def test_lines_are_trimmed_once(spark, tmp_path):
    """The filters that tell tokens from tags use the trimmed line and don't trim it anew for each mention."""
    (tmp_path / "a.vrt").write_text("<s>\n a \n</s>\n")
    got = vertical.parse(vertical.Lines.of_files(spark, str(tmp_path)), config.Config.of(TWO))
    lines = spark.createDataFrame([(1, ' <s a="1"> ')], "line long, value string")
    tagged = vertical.attributes(vertical.tags(vertical.clean(lines))).selectExpr("explode(attrs)")
    for df in (got.tokens, tagged):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("trim(value#") <= 4, plan
    assert [r["word"] for r in got.tokens.collect()] == ["a"]
    assert [tuple(r) for r in tagged.collect()] == [("a", "1")]
