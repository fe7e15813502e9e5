import pytest

from poslex import collection
from poslex.operators.sketch import Sketch, neighbours
from poslex.sources import config

CONF = 'PATH "{}"\nATTRIBUTE word\nSTRUCTURE s\n'


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    """Words a b | a b c: neighbours within each s."""
    lines = ["<s>", "a", "b", "</s>", "<s>", "a", "b", "c", "</s>"]
    conf = config.Config.of(CONF.format(tmp_path_factory.mktemp("c")))
    c = collection.build(spark, conf, spark.createDataFrame(list(enumerate(lines, 1)), "line long, value string"))
    word = c.attribute("word")
    relations = spark.createDataFrame([(0, "next"), (1, "previous")], "id long, value string")
    sketch = neighbours(word.ids, c.structure("s").ranges, word.lex, relations)
    extra = spark.createDataFrame([(0, "z"), (1, "a")], "id long, value string")
    c.write_sketch(Sketch(sketch.entries, sketch.occurrences, word.lex, relations, extra))
    return c, c.sketch()


def test_dump(made):
    rows = [(r["head"], r["rel"], r["coll"], r["cnt"], round(r["rnk"], 4), r["lcm"]) for r in made[1].dump("b").collect()]
    assert rows == [("b", "next", "c", 1, 13.415, [1, 2, -1]), ("b", "previous", "a", 2, 14.0, [0, 1, -1])]
    assert made[1].dump("zzz").collect() == []
    assert made[1].dump().count() == 4


def test_positions(made):
    got = sorted((r["head_id"], r["rel_id"], r["coll_id"], r["pos"], r["coll_off"]) for r in made[1].positions().collect())
    assert got == [(0, 0, 1, 0, 1), (0, 0, 1, 2, 1), (1, 0, 2, 3, 1), (1, 1, 0, 1, -1), (1, 1, 0, 3, -1), (2, 1, 1, 4, -1)]
    assert {(r["head_id"], r["rel_id"]): r["n"] for r in made[1].position_counts().collect()} == {(0, 0): 2, (1, 0): 1, (1, 1): 2, (2, 1): 1}


def test_two_lexicons(made):
    sketch = made[1]
    assert {r["coll_id"]: r["coll"] for r in sketch.collocates().collect()} == {0: "a", 1: "b", 2: "c", 3: "z", 4: "a"}
    assert [r["coll_id"] for r in sketch.collocate_id("a").collect()] == [0]
    assert [r["coll_id"] for r in sketch.collocate_id("z").collect()] == [3]
    assert sketch.collocate_id("nothing").collect() == []


def test_longest_match_text(made):
    assert {(r["head_id"], r["rel_id"]): r["lcm_text"] for r in made[1].matches_text().collect()} == {(0, 0): "a b", (1, 0): "b c", (1, 1): "a b", (2, 1): "b c"}
