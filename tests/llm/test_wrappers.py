"""Wrapper induction: matching against the plain recursion, learned wrappers, deep and wide pages."""

import random
import time
from functools import lru_cache

import pytest

from sensorlake.llm import wrappers
from sensorlake.llm.wrappers import Outline, match, parse


def random_tree(rng, depth):
    if not depth:
        return ()
    labels = rng.sample(["div", "section", "ul", "table", "p", "h1"], rng.randint(0, 5))
    return tuple((label, random_tree(rng, depth - 1)) for label in labels)


def page_of(tree):
    out = ""
    for label, children in tree:
        inner = "x" + page_of(children) if label not in ("p", "h1") else "x"
        out += f"<{label}>{inner}</{label}>"
    return out


def plain_match(a, b):
    """Simple tree matching by the recursion over pairs of children."""

    @lru_cache(None)
    def size(x, y):
        m, n = len(x), len(y)
        best = [[0] * (n + 1) for _ in range(m + 1)]
        for i in range(m):
            for j in range(n):
                same = size(x[i][1], y[j][1]) if x[i][0] == y[j][0] else 0
                best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + same)
        return best[m][n] + 1

    return size(a, b)


def shape(slot):
    return tuple((c.label, shape(c)) for c in slot.children.values())


def test_matching_equals_the_recursion():
    rng = random.Random(1)
    reordered = 0
    for _ in range(400):
        a, b = (Outline(parse(page_of(random_tree(rng, 3)))) for _ in range(2))
        pairs = match(a, b)
        assert len(pairs) == plain_match(shape(a.slots[0]), shape(b.slots[0]))
        assert len(set(pairs.values())) == len(pairs)
        for y, x in pairs.items():
            assert a.slots[x].label == b.slots[y].label
            if y:
                assert pairs[b.slots[y].parent] == a.slots[x].parent
        common = set(a.slots[0].children) & set(b.slots[0].children)
        reordered += [c for c in a.slots[0].children if c in common] != [c for c in b.slots[0].children if c in common]
    assert reordered > 50


def test_packed_outlines_match_as_before():
    a = Outline(parse("<div class='b a'><p>x<p>y<ul><li>1</ul></div><footer>z</footer>"))
    again = Outline.unpacked(a.packed())
    assert [(s.label, s.tag, s.parent) for s in again.slots] == [(s.label, s.tag, s.parent) for s in a.slots]
    assert match(again, a) == {i: i for i in range(len(a.slots))}


def site(rng, i, names=True):
    """Menus, adverts and notices rotate among a few texts; the rest differs from page to page."""
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(140)]
    nav = "".join(f"<li><a href='/{k}'>menu {k}{i % 3}</a></li>" for k in range(4))
    kind = (lambda name: f" class='{name}'") if names else (lambda name: "")
    paragraphs = [" ".join(words[k : k + 20]) for k in range(0, 20 * rng.randint(3, 7), 20)]
    title = " ".join(words[:4])
    html = (
        f"<html><body><ul>{nav}</ul><div><span>special offer {i % 4}</span></div><section><h1>{title}</h1>"
        + "".join(f"<p>{t}" for t in paragraphs)
        + f"<table><tr><td>share this page</table></section><center{kind('x')}>imprint of the site, page {i % 5}</center></body></html>"
    )
    return html, "\n".join([title, *paragraphs])


def test_wrappers_are_learned_without_any_name(spark, monkeypatch):
    for name in ("SKIPPED", "SKIPPED_NAMES", "SKIPPED_ROLES", "DOUBTFUL_NAMES"):
        monkeypatch.setattr(wrappers, name, frozenset())
    rng = random.Random(2)
    made = [site(rng, i, False) for i in range(40)]
    outlines = [Outline(parse(html)) for html, _ in made]
    base = outlines[0]
    alike = base.hashes()
    votes = {}
    for page in outlines:
        own = page.hashes()
        for y, x in match(base, page).items():
            if own[y] or alike[x]:
                seen, equal, varying = votes.get(x, (0, 0, 0))
                same = own[y] == alike[x]
                votes[x] = (seen + 1, equal + same, varying + (0 if same else sum(map(len, page.slots[y].texts))))
    content, template = wrappers.induce(base, votes, wrappers.Settings())
    assert base.slots[content].tag == "section" and len(template) == 1
    for page, (_, want) in zip(outlines, made):
        assert wrappers.main_text(page, base, content, frozenset(template)) == want
        assert wrappers.main_text(page) != want


@pytest.mark.parametrize("settings", [wrappers.Settings(), wrappers.Settings(broadcast_chars=0, piece_pages=7)])
def test_learned_wrappers_change_pages(spark, settings):
    rng = random.Random(3)
    made = [site(rng, i) for i in range(30)]
    rows = [(i, f"http://h.org/{i}", html, "x") for i, (html, _) in enumerate(made)]
    few = [site(rng, i) for i in range(3)]
    rows += [(100 + i, f"http://few.org/{i}", html, "x") for i, (html, _) in enumerate(few)]
    rows += [(200, None, "<p>a</p>", None), (201, "http://h.org/", None, None), (202, "http://h.org/", "", None), (None, None, None, None)]
    frame = spark.createDataFrame([*rows, rows[0]], "page_id long, url string, html string, _host string")
    out = {}
    for r in wrappers.main_texts(frame.repartition(5), settings).collect():
        out.setdefault(r["page_id"], []).append(r["text"])
    assert sum(map(len, out.values())) == len(rows) + 1 and len(out[0]) == 2
    assert all(out[i][0] == want for i, (_, want) in enumerate(made))
    # Too few pages to learn from: everything visible stays.
    assert out[100][0].startswith("menu 00") and "share this page" in out[100][0]
    assert out[200] == ["a"] and out[201] == out[202] == out[None] == [""]


def test_doubtful_names_need_evidence():
    article = "<article><p>one</p><div class='share-buttons'><a href='#'>Post it</a></div><div class='related'>The related work is long.</div></article>"
    assert wrappers.main_text(Outline(parse(article))) == "one\nThe related work is long."
    assert wrappers.main_text(Outline(parse("<p>one</p><div class=notice>two</div>"))) == "one"
    inside = "<header>site</header><article><header><h1>t</h1></header><p>x</p><footer>by me</footer></article><footer>y</footer>"
    assert wrappers.main_text(Outline(parse(inside))) == "t\nx\nby me"


@pytest.mark.parametrize(
    "page",
    [
        "<div>" * 100_000 + "deep",
        "<b>" * 100_000 + "deep",
        "<b>" * 50_000 + "<h1>x</h1>" * 20_000,
        "</i>" * 50_000 + "<p>x" * 50_000,
        "".join(f"<h2>{i}</h2><p>{i}</p>" for i in range(50_000)),
        "".join(f"<div class=c{i}>{i}</div>" for i in range(50_000)),
        "<ul><li>" * 30_000,
        "<a " * 50_000,
        "<" * 100_000,
        "word " * 400_000,
    ],
    ids=["nested", "inline", "unclosed", "closers", "alternating", "classes", "lists", "cut", "brackets", "long"],
)
def test_huge_pages(page):
    begun = time.monotonic()
    outline = Outline(parse(page))
    other = Outline(parse(page + "<div>more</div>"))
    pairs = match(outline, other)
    assert len(pairs) >= len(outline.slots) - 1
    wrappers.induce(outline, {s.number: (20, 0, 5) for s in outline.slots}, wrappers.Settings())
    wrappers.main_text(other, outline, 0)
    Outline.unpacked(outline.packed())
    assert time.monotonic() - begun < 30


def test_reversed_orders_match_in_reasonable_time():
    a = Outline(parse("".join(f"<div class=c{i}>{i}</div>" for i in range(20_000))))
    b = Outline(parse("".join(f"<div class=c{i}>{i}</div>" for i in reversed(range(20_000)))))
    begun = time.monotonic()
    assert len(match(a, b)) == 2
    assert time.monotonic() - begun < 10
