"""Compiled files, made here code by code, read as tables."""

import struct
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest

from poslex import __main__ as command
from poslex import collection
from poslex.sources import compiled, config


class Writer:
    """Bits from the lowest of each byte on."""

    def __init__(self):
        self.bits = []

    def gamma(self, v):
        n = v.bit_length() - 1
        self.bits += [0] * n + [1] + [v >> i & 1 for i in range(n)]

    def delta(self, v):
        n = v.bit_length()
        self.gamma(n)
        self.bits += [v >> i & 1 for i in range(n - 1)]

    def align(self, n=8):
        self.bits += [0] * (-len(self.bits) % n)

    def data(self):
        self.align()
        return np.packbits(np.array(self.bits, np.uint8), bitorder="little").tobytes()


def put(path, data):
    Path(path).write_bytes(data)


def numbers(values, kind="I"):
    return struct.pack(f"<{len(values)}{kind}", *values)


def put_lexicon(base, words):
    raw = [w.encode() + b"\0" for w in words]
    put(f"{base}.lex", b"".join(raw))
    put(f"{base}.lex.idx", numbers(np.cumsum([0, *map(len, raw[:-1])]).tolist() if raw else []))
    put(f"{base}.lex.srt", numbers(sorted(range(len(words)), key=lambda i: words[i].encode())))


def put_column(base, ids, kind, segment=8):
    if kind == "int":
        put(f"{base}.text", b"\0" * 16 + numbers(ids))
        return
    head, body, seek = Writer(), Writer(), []
    head.delta(segment + 1)
    head.delta(len(ids) + 1)
    start = (16 + len(head.data()) + 31) // 32 * 32
    if kind == "giga":
        start, segment = 2048, 64
    for i, v in enumerate(ids):
        if i % segment == 0:
            seek.append(start * 8 + len(body.bits))
        body.delta(v + 1)
    put(f"{base}.text", (b"\0" * 16 + head.data()).ljust(start, b"\0") + body.data())
    if kind == "delta":
        put(f"{base}.text.seg", numbers([*seek, start * 8 + len(body.bits)]))
    else:
        blocks = [s // (2048 * 8) for s in seek[::16]]
        put(f"{base}.text.seg", numbers(blocks))
        put(f"{base}.text.off", numbers([s - blocks[i // 16] * 2048 * 8 for i, s in enumerate(seek)], "H"))


def put_index(base, ids, dense):
    lists = [[p for p, i in enumerate(ids) if i == k] for k in range(max(ids, default=-1) + 1)]
    body, start, at = Writer(), 6, []
    if not dense:
        head = Writer()
        head.delta(2)
        start += len(head.data())
    for own in lists:
        body.align()
        at.append(start + len(body.bits) // 8)
        last = -1
        for p in own:
            body.delta(p - last)
            last = p
    put(f"{base}.rev", (compiled._DENSE if dense else compiled._INDEX + head.data()) + body.data())
    if not dense:
        put(f"{base}.rev.idx", numbers(at))
        put(f"{base}.rev.cnt", numbers([len(x) for x in lists]))
        return
    places, first = Writer(), []
    for k, own in enumerate(lists):
        if k % 64 == 0:
            if k:
                places.delta(1)
                places.gamma(1)
            places.align()
            first.append(len(places.bits) // 8)
            last = 0
        places.delta(at[k] - last)
        places.gamma(len(own) + 1)
        last = at[k]
    put(f"{base}.rev.idx1", places.data())
    put(f"{base}.rev.idx0", numbers([*first, len(places.data())]))


def test_codes():
    rng = np.random.default_rng(1)
    values = [int(v) for v in np.r_[rng.integers(1, 5, 300), rng.integers(1, 2**32, 300), 2 ** np.arange(40)]]
    for kind in ("gamma", "delta"):
        some = [v for v in values if kind == "delta" or v < 2**31]
        w, at = Writer(), []
        for v in some:
            at.append(len(w.bits))
            getattr(w, kind)(v)
        ends = [*at[1:], len(w.bits)]
        got, after = getattr(compiled.Bits(w.data()), kind)(np.array(at))
        assert got.tolist() == some and after.tolist() == ends


@pytest.mark.parametrize("kind", ["delta", "giga", "int"])
@pytest.mark.parametrize("n", [0, 1, 7, 8, 1500])
def test_columns(spark, tmp_path, kind, n):
    rng = np.random.default_rng(n)
    ids = (rng.integers(0, 2**20, n) >> rng.integers(0, 20, n)).tolist()
    put_column(f"{tmp_path}/a", ids, kind)
    assert compiled.kind_of(f"{tmp_path}/a") == kind
    got = compiled.column(spark, f"{tmp_path}/a", chunk=100).orderBy("pos").collect()
    assert [tuple(r) for r in got] == list(enumerate(ids))


@pytest.mark.parametrize("dense", [True, False])
def test_index(spark, tmp_path, dense):
    rng = np.random.default_rng(3)
    ids = np.r_[np.arange(150), rng.integers(0, 150, 300), np.zeros(400, np.int64)].tolist()
    put_lexicon(f"{tmp_path}/a", [f"w{i}" for i in range(150)])
    put_column(f"{tmp_path}/a", ids, "delta")
    put_index(f"{tmp_path}/a", ids, dense)
    got = compiled.index(spark, f"{tmp_path}/a", chunk=64).collect()
    assert sorted(tuple(r) for r in got) == sorted((i, p) for p, i in enumerate(ids))
    assert compiled.check_index(spark, f"{tmp_path}/a")
    put(f"{tmp_path}/b.rev", b"nothing")
    with pytest.raises(compiled.BadIndexHeader):
        compiled.index(spark, f"{tmp_path}/b")


CONF = 'PATH "{}"\nATTRIBUTE word\nATTRIBUTE lc {{ DYNAMIC lower\nFROMATTR word }}\nSTRUCTURE s {{ ATTRIBUTE n }}\nSTRUCTURE d {{ TYPE "file64" }}\n'


def put_sketch(base, heads, lcm=True):
    """heads: {head: {rel: {coll: [(pos, off)]}}}; levels from the last to the first."""
    two, three, rev = Writer(), Writer(), Writer()
    rev.delta(1)
    rev.delta(100)
    for w in (rev,):
        w.bits = [0] * 128 + w.bits
    three.bits = [0] * 128
    three.delta(5)
    three.bits += [int(lcm), 0]
    two.bits = [0] * 128
    two.delta(5)
    one = Writer()
    one.bits = [0] * 128
    one.delta(5)
    one.delta(max(heads, default=0) + 0)
    one.bits += [0] * (256 - len(one.bits))
    seek = []

    def sync(w, index, number):
        w.delta(1)
        w.delta(index)
        w.delta(number + 1)

    for head, rels in heads.items():
        here = []
        for rel, colls in rels.items():
            at = []
            for coll, places in colls.items():
                rev.align()
                at.append(len(rev.bits) // 8)
                last = 0
                for pos, off in places:
                    rev.delta(pos - last)
                    last = pos
                    rev.gamma(1 if off is None else 2 * off if off > 0 else 1 - 2 * off)
                    if off is not None:
                        rev.gamma(1)
            here.append(len(three.bits))
            for coll, own in zip(colls, at, strict=True):
                sync(three, own, coll)
                three.delta(len(colls[coll]))
                three.delta(1 + coll)
                three.delta(len(colls[coll]) + 3)
                if lcm:
                    three.gamma(3)
                    three.delta(head + 1)
                    three.delta(coll + 1)
        begin = len(two.bits)
        for rel, own in zip(rels, here, strict=True):
            sync(two, own, rel)
            two.delta(len(rels[rel]))
            two.delta(7)
            two.delta(9)
        while len(seek) <= head // 64:
            seek.append(len(one.bits))
        sync(one, begin, head)
        one.delta(len(rels))
        one.delta(11)
    for w, name in ((one, "map0.com"), (two, "map1.com"), (three, "map2.com"), (rev, "rev")):
        put(f"{base}.{name}", w.data())
    put(f"{base}.map0.idx", numbers(seek))


SKETCH = {0: {1: {1: [(3, 1), (9, None)], 2: [(5, -2)]}, 0: {2: [(1, 4)]}}, 2: {0: {0: [(8, -1), (20, 3), (21, None)]}}}


@pytest.fixture(scope="module")
def converted(spark, tmp_path_factory):
    old, new = tmp_path_factory.mktemp("old"), tmp_path_factory.mktemp("new")
    words, ids = ["The", "the", "b"], [0, 1, 2, 1, 0, 2, 2]
    (old / "conf").write_text(CONF.format(old))
    put_lexicon(old / "word", words)
    put_column(old / "word", ids, "delta", 2)
    put_lexicon(old / "lc", ["the", "b"])
    put(old / "lc.lex.ridx", numbers([0, 0, 1]))
    put(old / "word.docf", numbers([1, 2, 2], "Q"))
    put(old / "s.rng", numbers([0, 2, 2, 7]))
    put_lexicon(old / "s.n", ["x"])
    put_column(old / "s.n", [0, 0], "int")
    put(old / "d.rng", numbers([0, 7], "Q"))
    base = old / "word-ws"
    put_sketch(base, SKETCH)
    put_lexicon(base, ["next", "previous"])
    put_lexicon(f"{base}.coll", [])
    return old, collection.convert(spark, config.Config.open(str(old / "conf")), str(new))


def test_conversion(spark, converted):
    c = converted[1]
    word, lc = c.attribute("word"), c.attribute("lc")
    assert [r["value"] for r in word.values().collect()] == ["The", "the", "b", "the", "The", "b", "b"]
    assert [tuple(r) for r in word.lex.orderBy("id").select("id", "first_pos", "frq", "sort_rank").collect()] == [(0, 0, 2, 0), (1, 1, 2, 2), (2, 2, 3, 1)]
    assert [r["pos"] for r in word.id2poss(2).collect()] == [2, 5, 6]
    assert [r["id"] for r in lc.iter_ids().collect()] == [0, 0, 1, 0, 0, 1, 1] and lc.frq(0) == 4
    assert [tuple(r) for r in word.get_freq("docf:l").orderBy("id").collect()] == [(0, 1), (1, 2), (2, 2)]
    assert [tuple(r) for r in c.structure("s").ranges.orderBy("num").collect()] == [(0, 0, 2), (1, 2, 7)]
    assert [tuple(r) for r in c.structure("d").ranges.collect()] == [(0, 0, 7)]
    assert c.attribute("s.n").id2str(0) == "x"


def test_compiled_sketch(spark, converted):
    got = converted[1].sketch()
    assert got.extra is None
    rows = [(r["head_id"], r["rel_id"], r["coll_id"], r["pos"], r["coll_off"]) for r in got.positions().collect()]
    assert sorted(rows, key=repr) == sorted(((h, r, c, p, o) for h, rels in SKETCH.items() for r, colls in rels.items() for c, own in colls.items() for p, o in own), key=repr)
    dump = [(r["head"], r["rel"], r["coll"], r["cnt"], round(r["rnk"], 3), r["lcm"]) for r in got.dump().collect()]
    # relations and collocates in the order they are stored in
    assert [x[:4] for x in dump] == [("The", "previous", "the", 2), ("The", "previous", "b", 1), ("The", "next", "b", 1), ("b", "next", "The", 3)]
    assert dump[1][4:] == (round(3 / (4096 / 30) - 10, 3), [0, 2])


def test_missing_collocates(spark, converted, tmp_path):
    """A table of extra collocates may be empty; that it is missing is an error."""
    import shutil

    c = converted[1]
    base = c.config.get("WSBASE")
    shutil.move(f"{base}.coll", tmp_path / "away")
    try:
        with pytest.raises(Exception, match="PATH_NOT_FOUND"):
            c.sketch()
    finally:
        shutil.move(tmp_path / "away", f"{base}.coll")


def test_command_line(spark, converted, tmp_path, capsys):
    (tmp_path / "conf").write_text('PATH "./out"\nATTRIBUTE word\nSTRUCTURE s { ATTRIBUTE n }\n')
    (tmp_path / "in.vrt").write_text("<s n=1>\na\nb\n</s>\n</s>\na\n")
    conf = str(tmp_path / "conf")
    assert command.main(["encode", conf, str(tmp_path / "in.vrt")], spark) == 0
    assert "closing non opened structure: 1" in capsys.readouterr().err
    assert command.main(["index", conf], spark) == 0
    c = collection.Collection.open(spark, conf)
    assert [r["pos"] for r in c.attribute("word").id2poss(0).collect()] == [0, 2] and c.attribute("s.n").id2str(0) == "1"
    assert command.main(["raw", str(tmp_path / "in.vrt"), str(tmp_path / "raw")], spark) == 0
    assert [r["value"] for r in spark.read.parquet(f"{tmp_path}/raw/word.lex").orderBy("id").collect()] == ["<s n=1>", "a", "b", "</s>"]
    assert command.main(["nothing"]) == 2 and command.main(["dump", conf]) == 2
    old, new = converted
    base = new.config.get("WSBASE")
    (tmp_path / "dump").write_text((old / "conf").read_text().replace(str(old), new.config.path.rstrip("/")) + f'WSBASE "{base}"\n')
    assert command.main(["dump", str(tmp_path / "dump"), str(tmp_path / "tsv"), "b"], spark) == 0
    lines = [x for p in sorted((tmp_path / "tsv").glob("part-*")) for x in p.read_text().splitlines()]
    assert [x.split("\t")[:4] for x in lines] == [["b", "next", "The", "3"]] and lines[0].split("\t")[5] == "b"
    assert command.main(["dump", str(tmp_path / "dump"), str(tmp_path / "tsv"), "zzz"], spark) == 1
    said = subprocess.run([sys.executable, "-m", "poslex"], cwd=Path(__file__).parents[1], capture_output=True, text=True)
    assert said.returncode == 2 and "encode CONFIG" in said.stderr
