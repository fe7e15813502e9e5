"""Template deduction against a brute-force restatement, and on made sites."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest

from poslex.llm import html_template

SCHEMA = "page_id long, url string, html string"


def page(site, title, items, comment=""):
    rows = "".join(f"<li><b>Name</b> {x}</li>" for x in items)
    return f"<html><head><title>{title}</title></head><body><div class=h>Welcome to {site}</div><h1>{title}</h1><ul>{rows}</ul><p>Copyright {site} all rights reserved</p>{comment}</body></html>"


def site(name, n, seed, first=0):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(9))
    made = [(word(), [word() for _ in range(rng.randint(1, 4))]) for _ in range(n)]
    return [(first + i, f"https://{name}/p{i}", page(name, t, x, "<!-- note -->" * (i % 2))) for i, (t, x) in enumerate(made)], made


TAGS = re.compile(r"<!--.*?-->|<![^<>]*>|<(script|style)\b[^<>]*>.*?</\1\s*>|<(/?)([a-z]\w*)[^<>]*?(/?)>", re.S | re.I)
VOID = "area base br col embed hr img input link meta source track wbr".split()
ALONE = "p li tr td th option dt dd".split()


def plain_tokens(html):
    """(token, path, word or None) of a page, tokens told apart by what they are and the open elements around them."""
    out, open_, at = [], [], 0

    def text(part):
        out.extend((("word", w, *open_), tuple(open_), w) for w in re.split("[\t-\r ]+", part) if w)

    for m in TAGS.finditer(html):
        text(html[at : m.start()])
        at = m.end()
        name = (m[3] or "").lower()
        if m[1]:
            out.append((("whole", m[1].lower(), *open_), tuple(open_), None))
        elif m[2] and name in open_:
            while open_[-1] != name:
                open_.pop()
            out.append((("end", *open_), (), None))
            open_.pop()
        elif m[2]:
            out.append((("stray", name, *open_), tuple(open_), None))
        elif name:
            if name in ALONE and open_ and open_[-1] == name:
                open_.pop()
            out.append((("start", name, *open_), tuple(open_), None))
            if name not in VOID and not m[4]:
                open_.append(name)
    text(html[at:])
    return out


def rounds(tokens, own):
    """Order and places of a class on a page; None if its tokens don't come in whole rounds of one order."""
    at = [i for i, t in enumerate(tokens) if t in own]
    if len(at) % len(own):
        return None
    each = [at[i : i + len(own)] for i in range(0, len(at), len(own))]
    orders = {tuple(tokens[i] for i in r) for r in each}
    return (each, orders) if len(orders) <= 1 and all(len(set(o)) == len(own) for o in orders) else None


def plain_classes(pages, support=html_template.SUPPORT, size=html_template.SIZE):
    """The valid classes of a host's pages (lists of plain_tokens): {tokens: weight}."""
    n = len(pages)
    vectors = defaultdict(lambda: [0] * n)
    for i, page in enumerate(pages):
        for t, _, word in page:
            if n != html_template.FEW_PAGES or word is None:
                vectors[t][i] += 1
    groups = defaultdict(set)
    for t, v in vectors.items():
        groups[tuple(v)].add(t)
    least = max(support * n, n if n == html_template.FEW_PAGES else html_template.LEAST_PAGES)
    found = {}
    for v, own in groups.items():
        on = [i for i in range(n) if v[i]]
        got = {i: rounds([t for t, _, _ in pages[i]], own) for i in on}
        if len(own) >= size and len(on) >= least and all(got.values()) and len(set.union(*(g[1] for g in got.values()))) == 1:
            found[frozenset(own)] = (len(own) * len(on), {i: g[0] for i, g in got.items()})

    def nested(x, y):
        return all(len({sum(q < p for q in sum(y[i], [])) for p in r}) == 1 for i in x if i in y for r in x[i])

    lighter = set()
    for a, (wa, x) in found.items():
        for b, (wb, y) in found.items():
            both = [i for i in x if i in y]
            if wa < wb and not all(nested({i: x[i]}, {i: y[i]}) or nested({i: y[i]}, {i: x[i]}) for i in both):
                lighter.add(a)
    return {c for c in found if c not in lighter}, lighter


def plain_slots(rows):
    hosts = defaultdict(list)
    for page_id, url, html in rows:
        hosts[url.split("/")[2]].append((page_id, plain_tokens(html)))
    out, crossed = [], 0
    for host, pages in hosts.items():
        valid, lighter = plain_classes([p for _, p in pages])
        crossed += len(lighter)
        template = set().union(*valid)
        for page_id, tokens in pages:
            slots, fresh = [], True
            for t, path, word in tokens:
                if t in template:
                    fresh = True
                elif word is not None:
                    if fresh:
                        slots.append(("/".join(path), []))
                    slots[-1][1].append(word)
                    fresh = False
            out += [(page_id, host, i, path, tuple(words)) for i, (path, words) in enumerate(slots)]
    return sorted(out), crossed


def crossing(first):
    """Pages on which a class of words stands between the words of another, heavier one."""
    mixed = "<html><body><h1>a1 b1 a2 b2 a3 b3</h1><p>{0} {0}x<p>tail {0}y</body></html>"
    return [(first + i, f"https://x.org/{i}", mixed.format(f"u{i}")) for i in range(4)] + [(first + 9, "https://x.org/9", "<html><body><h1>a1 a2 a3</h1><p>v vx<p>tail vy</body></html>")]


@pytest.mark.parametrize("broadcast", [True, False])
def test_slots_brute_force(spark, monkeypatch, broadcast):
    """With templates broadcast, and joined as for more of them, pages of hot hosts under several keys."""
    if not broadcast:
        monkeypatch.setattr(html_template, "BROADCAST_TOKENS", 0)
        monkeypatch.setattr(html_template, "HOT", 3)
    rows = site("a.org", 9, 1)[0] + site("b.org", 5, 2, 100)[0] + site("c.org", 2, 3, 200)[0] + site("d.org", 1, 5, 300)[0] + crossing(400)
    rows += [(500 + i, f"https://e.org/{i}", f"<div><ul><li>k{i}<li>m<br/>n{i}</ul></p><script>x < y</script><style>s</style>Same foot{i} <!-- no --></div>") for i in range(6)]
    got = [(r["page_id"], r["host"], r["slot"], r["path"], tuple(r["text"].split())) for r in html_template.extract(spark.createDataFrame(rows, SCHEMA)).collect()]
    want, crossed = plain_slots(rows)
    assert sorted(got) == want and crossed == 1


def test_slots(spark):
    rows, made = site("a.org", 12, 4)
    got = defaultdict(list)
    for r in html_template.extract(spark.createDataFrame(rows, SCHEMA)).orderBy("page_id", "slot").collect():
        got[r["page_id"]].append((r["path"], r["text"]))
    for i, (title, items) in enumerate(made):
        texts = [t for _, t in got[i]]
        assert texts[:2] == [title, title]
        assert sorted(" ".join(texts[2:]).split()) == sorted(items)
        assert got[i][0][0] == "html/head/title"


def test_two_pages(spark):
    """A host of two pages has a template of tags; words that both pages have stay in the slots."""
    rows, made = site("a.org", 2, 7)
    rows += [(9, "https://b.org/", page("b.org", "alone", ["x"]))]
    got = defaultdict(list)
    for r in html_template.extract(spark.createDataFrame(rows, SCHEMA)).orderBy("page_id", "slot").collect():
        got[r["page_id"]].append((r["path"], r["text"]))
    for i, (title, items) in enumerate(made):
        texts = [t for _, t in got[i]]
        assert texts[:3] == [title, "Welcome to a.org", title]
        assert got[i][-1] == ("html/body/p", "Copyright a.org all rights reserved")
        assert " ".join(" ".join(texts[3:-1]).split()) == " ".join(f"Name {x}" for x in items)
    assert len(got[9]) == 1


def test_page_cases(spark):
    same = "<p>one two three"
    rows = [(1, None, None), (2, "", ""), (3, "https://x.org/a", "<div><p>un<b>closed"), (None, "https://x.org/b", "</div>stray & &amp; text <br/> more"), (5, "https://y.org", same), (5, "https://y.org", same), (7, "https://z.org/" + "l" * 9, "<p>" + "word " * 50_000)]
    got = html_template.extract(spark.createDataFrame([(*r, "k") for r in rows], SCHEMA + ", host string")).collect()
    by = defaultdict(list)
    for r in got:
        by[r["page_id"]].append((r["host"], r["text"]))
    assert 1 not in by and 2 not in by
    assert " ".join(t for _, t in by[3]).split() == ["unclosed"] or " ".join(t for _, t in by[3]).split() == ["un", "closed"]
    assert by[None][0][1].split() == ["stray", "&", "&", "text", "more"]
    assert by[5] == [("y.org", "one two three")] * 2
    assert len(by[7][0][1].split()) == 50_000
    assert html_template.extract(spark.createDataFrame([], SCHEMA)).collect() == []


def test_nesting():
    ids = lambda x: np.array([ord(c) for c in x], np.int64)
    classes = {0: ids("ab"), 1: ids("xyz")}
    assert html_template.check_page(ids("axyzb"), classes) == ({0: tuple(ids("ab")), 1: tuple(ids("xyz"))}, set())
    assert html_template.check_page(ids("xayzb"), classes)[1] == {(0, 1)}
    assert html_template.check_page(ids("abba"), classes)[0] == {0: ()}
    assert html_template.check_page(ids("abxyzxyz"), classes) == ({0: tuple(ids("ab")), 1: tuple(ids("xyz"))}, set())
