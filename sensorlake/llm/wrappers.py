"""Main text of web pages by wrapper induction.

Pages of one host share a template. A page's elements are folded into a tree of slots: all children of
an element that look alike (name and classes) are one slot. Every page's tree is aligned with that of
one page of its host by simple tree matching, over all its blocks, and votes on that page's slots: how
often the slot was there, how often it was filled alike, and how much text varied. From the votes comes
the host's wrapper: constant slots are template, and the content is the innermost element that holds
most of the varying text; what varies elsewhere (rotating menus, adverts, notices) is small and outside.

What elements mean is used where the votes cannot tell: for hosts of few pages, for pages that have no
such element, for asides and reader comments inside the content, and to keep headings with their text.

Nothing recurses, and since the slots of an element have different labels, two trees are matched in
about linear time however deep or wide they are. Only outlines of one page per host (labels and text
hashes) and the wrappers are sent around, never the pages.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from sensorlake.llm.url_lists import host
from sensorlake.session import materialise

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(?:(>)|\Z|(?=[\"']))",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)")
SPACE = re.compile(r"[ \t\n\r\f\v]+")
# Element names of the markup language, by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset"
    " figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol"
    " optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCKS - frozenset("body caption html legend optgroup option summary tbody td tfoot th thead tr".split())
#: No text of a page in any case: markup, pictures and form controls.
NEVER = frozenset("head button select input label svg canvas object audio video".split()) | RAW
#: Boilerplate by meaning; a header or footer inside an article is its own.
SKIPPED = frozenset("nav header footer aside form menu dialog search".split())
SKIPPED_ROLES = frozenset(
    "navigation banner contentinfo complementary search form menu menubar dialog alertdialog alert"
    " toolbar".split()
)
#: Class and id words of boilerplate, wherever it stands.
SKIPPED_NAMES = frozenset(
    "ad ads advert adverts advertisement advertisements adbox sponsor sponsored navbar navigation nav menu"
    " breadcrumb breadcrumbs masthead footer sidebar comment comments commentlist respond disqus cookie"
    " cookies consent gdpr newsletter subscribe subscription signup login toolbar pagination pager".split()
)
#: Words that an article may use for itself: they count outside of it, or where most of the text is links.
DOUBTFUL_NAMES = frozenset(
    "banner promo promoted header aside widget related recommended recommendations notice notices"
    " notification popup modal overlay share sharing social skip".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
IMPLIED_END = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
    "th": {"td", "th"}, "option": {"option"},
}
SCOPES = frozenset("ul ol dl table select body html article section main div aside nav header footer".split())


@dataclass
class Node:
    tag: str
    names: tuple[str, ...] = ()
    hidden: bool = False
    #: Boilerplate by its role, or by a word that may also be an article's own.
    skipped: bool = False
    doubtful: bool = False
    children: list = field(default_factory=list)  # nodes and strings


class _Open:
    """The elements that are open, and how many of each name, so that a search for one that is not
    open costs nothing."""

    def __init__(self, root: Node):
        self.stack, self.count = [root], {}

    def push(self, node: Node) -> None:
        self.stack.append(node)
        self.count[node.tag] = self.count.get(node.tag, 0) + 1

    def close(self, tags: frozenset[str] | set[str], scopes: frozenset = frozenset()) -> bool:
        """Ends the innermost open element of ``tags`` that no scope shields, and all inside it."""
        if not any(self.count.get(tag) for tag in tags):
            return False
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag in tags:
                for node in self.stack[i:]:
                    self.count[node.tag] -= 1
                del self.stack[i:]
                return True
            if self.stack[i].tag in scopes:
                return False
        return False


def parse(text: str | None) -> Node:
    """Tree of a page; forgiving about unclosed, misnested and cut-off elements."""
    text = text or ""
    root = Node("#page")
    opened, at, n = _Open(root), 0, len(text)
    while at < n:
        inner = opened.stack[-1].children
        begin = text.find("<", at)
        if begin < 0:
            begin = n
        if begin > at:
            inner.append(text[at:begin])
        if begin == n:
            break
        m = TOKEN.match(text, begin)
        if not m:
            if text[begin + 1 : begin + 2] == "/" or begin + 1 == n:
                end = text.find(">", begin)
                at = n if end < 0 else end + 1
            else:
                inner.append("<")
                at = begin + 1
            continue
        at = max(m.end(), begin + 1)
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if not opened.close({tag}) and tag in ("p", "br"):
                inner.append(Node(tag))
            continue
        if not m[4]:  # cut off inside the tag
            break
        if tag in CLOSES_P:
            opened.close({"p"}, SCOPES)
        if tag in IMPLIED_END:
            opened.close(IMPLIED_END[tag], SCOPES - {tag})
        node = _node(tag, m[3])
        opened.stack[-1].children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(text, at)
            at = end.end() if end else n
        elif tag not in VOID:
            opened.push(node)
    return root


def _node(tag: str, attributes: str) -> Node:
    names: list[str] = []
    node = Node(tag, hidden=tag in NEVER, skipped=tag in SKIPPED)
    if attributes and ("=" in attributes or "hidden" in attributes):
        for key, value in ATTRIBUTE.findall(attributes):
            key, value = key.lower(), value.strip("\"'").lower()
            if key in ("class", "id"):
                names += value.split()
            elif key == "role":
                node.skipped |= value in SKIPPED_ROLES
            elif key == "aria-hidden":
                node.hidden |= value == "true"
            elif key == "style":
                node.hidden |= "display:none" in value.replace(" ", "")
        if "hidden" in attributes.lower():
            node.hidden |= bool(re.search(r"(?:^|\s)hidden(?:\s|$|=)", re.sub(r"\"[^\"]*\"|'[^']*'", "", attributes)))
        if tag not in ("html", "body", "article", "main"):
            words = {part for name in names for part in [name, *re.split(r"[-_]+", name)]}
            node.skipped |= not SKIPPED_NAMES.isdisjoint(words)
            node.doubtful = not DOUBTFUL_NAMES.isdisjoint(words)
    node.names = tuple(sorted(names))
    return node


@dataclass
class Slot:
    """All children of an element that look alike; a page's or a host's."""

    label: str
    tag: str
    number: int
    parent: int
    children: dict[str, Slot] = field(default_factory=dict)
    texts: list[str] = field(default_factory=list)


@dataclass
class Block:
    slot: int
    text: str
    #: Boilerplate by meaning, and so much of it that it counts inside an article too.
    skipped: bool
    #: Inside an article or main element.
    article: bool


class Outline:
    """A page's slots and its blocks in page order."""

    def __init__(self, root: Node | None = None):
        self.slots: list[Slot] = [Slot("#page", "#page", 0, -1)]
        self.blocks: list[Block] = []
        if root is not None:
            self._walk(root)

    def _child(self, slot: Slot, label: str, tag: str) -> Slot:
        found = slot.children.get(label)
        if found is None:
            found = Slot(label, tag, len(self.slots), slot.number)
            slot.children[label] = found
            self.slots.append(found)
        return found

    def _walk(self, root: Node) -> None:
        pieces: list[str] = []
        linked = [0, 0]  # characters in links, links that are open
        slot, skipped, doubt, article = self.slots[0], False, False, False

        def flush() -> None:
            if not pieces:
                return
            text = " ".join(SPACE.sub(" ", html.unescape("".join(pieces))).split())
            mostly_links = 2 * linked[0] > sum(map(len, pieces))
            pieces.clear()
            linked[0] = 0
            if text:
                slot.texts.append(text)
                self.blocks.append(Block(slot.number, text, skipped or (doubt and (mostly_links or not article)), article))

        # Each entry goes on with an element's children; what to restore afterwards stands beside it.
        stack = [(iter(root.children), None)]
        while stack:
            children, after = stack[-1]
            child = next(children, None)
            if child is None:
                stack.pop()
                if after == "link":
                    linked[1] -= 1
                elif after is not None:
                    flush()
                    slot, skipped, doubt, article = after
            elif isinstance(child, str):
                pieces.append(child)
                if linked[1]:
                    linked[0] += len(child)
            elif child.hidden:
                if child.tag in BLOCKS:
                    flush()
            elif child.tag == "br":
                pieces.append(" ")
            elif child.tag in BLOCKS or child.skipped:
                flush()
                stack.append((iter(child.children), (slot, skipped, doubt, article)))
                slot = self._child(slot, ".".join((child.tag, *child.names)), child.tag)
                # An article's own header and footer are not the page's.
                skipped |= child.skipped and not (article and child.tag in ("header", "footer"))
                doubt |= child.doubtful
                article |= child.tag in ("article", "main")
            else:
                if child.tag == "a":
                    linked[1] += 1
                stack.append((iter(child.children), "link" if child.tag == "a" else None))
        flush()

    def hashes(self) -> list[int]:
        """One for the texts of every slot, 0 without text."""
        return [xxhash.xxh64_intdigest("\n".join(s.texts)) >> 1 or 1 if s.texts else 0 for s in self.slots]

    def packed(self) -> str:
        return json.dumps([[s.parent, s.label, s.tag] for s in self.slots[1:]])

    @classmethod
    def unpacked(cls, text: str) -> Outline:
        out = cls()
        for parent, label, tag in json.loads(text):
            out._child(out.slots[parent], label, tag)
        return out


def match(a: Outline, b: Outline) -> dict[int, int]:
    """Simple tree matching: the largest common top part of two trees, as ``slot of b -> slot of a``.

    Labels of siblings differ, so a slot has one possible partner, and which children of a pair go
    together is the heaviest common subsequence of two orders of the same labels.
    """
    pairs = [(a.slots[0], b.slots[0])]
    inner: list[list[int]] = []
    for x, y in pairs:  # grows while it is read: parents before children
        common = [label for label in x.children if label in y.children]
        inner.append(list(range(len(pairs), len(pairs) + len(common))))
        pairs += [(x.children[label], y.children[label]) for label in common]
    size = [1] * len(pairs)
    for i in range(len(pairs) - 1, -1, -1):
        children = inner[i]
        places = [pairs[k][1].number for k in children]  # numbers rise in page order
        if any(p > q for p, q in zip(places, places[1:])):
            inner[i] = children = _heaviest_rise(children, places, size)
        size[i] += sum(size[k] for k in children)
    out, todo = {}, [0]
    while todo:
        i = todo.pop()
        out[pairs[i][1].number] = pairs[i][0].number
        todo += inner[i]
    return out


def _heaviest_rise(items: list[int], places: list[int], weight: list[int]) -> list[int]:
    """The items of the heaviest subsequence whose places rise; a tree of prefix maxima."""
    rank = {p: r for r, p in enumerate(sorted(places), 1)}
    best: list[tuple[int, int]] = [(0, -1)] * (len(items) + 1)
    before = []
    for at, (item, place) in enumerate(zip(items, places)):
        r, found = rank[place] - 1, (0, -1)
        while r > 0:
            found = max(found, best[r])
            r &= r - 1
        before.append(found[1])
        total, r = (found[0] + weight[item], at), rank[place]
        while r < len(best):
            best[r] = max(best[r], total)
            r += r & -r
    out, r, at = [], len(items), (0, -1)
    while r > 0:
        at = max(at, best[r])
        r &= r - 1
    k = at[1]
    while k >= 0:
        out.append(items[k])
        k = before[k]
    return out[::-1]


@dataclass(frozen=True)
class Settings:
    #: Pages of a host that vote at least.
    least_votes: int = 10
    #: A slot that this share of the pages fills alike is template.
    alike: float = 0.9
    #: The content's share of the varying text at least.
    majority: float = 0.5
    #: Characters of outlines and wrappers that are broadcast at most; more are joined by shuffle.
    broadcast_chars: int = 48_000_000
    #: Pages of a host that one shuffled piece has, about.
    piece_pages: int = 2_000


def induce(base: Outline, votes: dict[int, tuple[int, int, int]], s: Settings) -> tuple[int, list[int]] | None:
    """The slot that is the content and the slots that are template, from ``slot -> pages that had it,
    pages that filled it alike, characters of those that did not``. ``None`` without enough votes.

    From the page down, a child is entered while it holds most of all varying text, has blocks of its
    own and leaves no heading of its level behind; an article or main element is entered no further.
    """
    pages = max((v[0] for v in votes.values()), default=0)
    mass = [votes.get(slot.number, (0, 0, 0))[2] for slot in base.slots]
    for slot in reversed(base.slots[1:]):
        mass[slot.parent] += mass[slot.number]
    if pages < s.least_votes or not mass[0]:
        return None
    at = base.slots[0]
    while at.tag not in ("article", "main"):
        heir = max(at.children.values(), key=lambda c: mass[c.number], default=None)
        if heir is None or mass[heir.number] < s.majority * mass[0] or not heir.children:
            break
        if any(c.tag in HEADINGS for c in at.children.values()):
            break
        at = heir
    # A page of lists or bare paragraphs only: no element stands out.
    if at.number == 0:
        return None
    template = [k for k, (seen, equal, _) in votes.items() if seen >= s.least_votes and equal >= s.alike * seen]
    return at.number, sorted(template)


def main_text(page: Outline, base: Outline | None = None, content: int = -1, template: frozenset[int] = frozenset()) -> str:
    """The blocks of a page's content, by its host's wrapper where it has one and the page has the
    content's slot, else those of its article or main elements, else of the whole page."""
    if base is not None:
        of = match(base, page)
        inside, kept = [False] * len(page.slots), [True] * len(page.slots)
        for slot in page.slots:
            known = of.get(slot.number, -1)
            inside[slot.number] = known == content or (slot.parent >= 0 and inside[slot.parent])
            kept[slot.number] = known not in template
        if any(inside):
            return "\n".join(b.text for b in page.blocks if inside[b.slot] and kept[b.slot] and not b.skipped)
    blocks = [b for b in page.blocks if not b.skipped]
    if any(b.article for b in blocks):
        blocks = [b for b in blocks if b.article]
    return "\n".join(b.text for b in blocks)


# Spark


def _outlines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pages = [Outline(parse(text)) for text in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("_host"),
                pa.array([p.packed() for p in pages], pa.string()),
                pa.array([p.hashes() for p in pages], pa.list_(pa.int64())),
            ],
            names=["_host", "_outline", "_hashes"],
        )


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    votes: dict[tuple[str, int], list[int]] = {}
    known: dict[str, tuple[Outline, list[int]]] = {}
    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("_host", "_outline", "_hashes", "html"))
        for site, outline, hashes, page in zip(*columns):
            if page is None:
                continue
            base, alike = _kept(known, site, lambda: (Outline.unpacked(outline), hashes))
            other = Outline(parse(page))
            own = other.hashes()
            for y, x in match(base, other).items():
                if own[y] or alike[x]:
                    count = votes.setdefault((site, x), [0, 0, 0])
                    count[0] += 1
                    if own[y] == alike[x]:
                        count[1] += 1
                    else:
                        count[2] += sum(map(len, other.slots[y].texts))
        if len(votes) > 200_000:
            yield _vote_batch(votes)
            votes = {}
    yield _vote_batch(votes)


VOTES = pa.schema([("_host", pa.string()), *((n, pa.int64()) for n in ("slot", "seen", "equal", "varying"))])


def _vote_batch(votes: dict) -> pa.RecordBatch:
    rows = [(s, k, *v) for (s, k), v in votes.items()]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [()] * 5, VOTES)], schema=VOTES)


def _kept(known: dict, site: str, make):
    found = known.get(site)
    if found is None:
        if len(known) > 5_000:
            known.clear()
        found = known[site] = make()
    return found


def wrappers(pages: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``_host, _outline, _content, _template``: the wrapper of every host that has one.

    ``pages`` has ``page_id, _host, html``. The page that the others are aligned with is the longest one
    of the host (up to a bound; the smallest id of equal ones), so that it has most kinds of slots. All
    pages vote, itself too.
    """
    size = F.least(F.length("html"), F.lit(100_000))
    best = F.struct(size, -F.coalesce(F.col("page_id").cast("long"), F.lit(0)), F.col("html"))
    # One page per host and task is shuffled.
    longest = pages.filter("html IS NOT NULL").groupBy("_host").agg(F.max_by("html", best).alias("html"))
    outlines = materialise(
        longest.mapInArrow(_outlines, "_host string, _outline string, _hashes array<long>")
    )
    votes = _joined(pages, outlines, settings).mapInArrow(
        _votes, "_host string, slot long, seen long, equal long, varying long"
    )
    counted = votes.groupBy("_host", "slot").agg(*[F.sum(n).alias(n) for n in ("seen", "equal", "varying")])
    of_host = counted.groupBy("_host").agg(F.collect_list(F.struct("slot", "seen", "equal", "varying")).alias("_votes"))

    def induced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for site, outline, votes in zip(batch["_host"], batch["_outline"], batch["_votes"]):
                table = {v["slot"]: (v["seen"], v["equal"], v["varying"]) for v in votes}
                found = induce(Outline.unpacked(outline), table, settings)
                if found:
                    rows.append((site, outline, found[0], found[1]))
            yield pd.DataFrame(rows, columns=["_host", "_outline", "_content", "_template"])

    joined = outlines.select("_host", "_outline").join(of_host, "_host")
    return materialise(joined.mapInPandas(induced, "_host string, _outline string, _content long, _template array<long>"))


def _joined(pages: DataFrame, known: DataFrame, settings: Settings) -> DataFrame:
    """Every page with its host's row of ``known``: by broadcast where all rows are small, else by a
    shuffle in which a host of many pages is dealt to several pieces."""
    size = known.agg(F.coalesce(F.sum(F.length("_outline")), F.lit(0))).first()[0]
    if size <= settings.broadcast_chars:
        return pages.join(F.broadcast(known), "_host", "left")
    pieces = pages.groupBy("_host").agg(F.ceil(F.count(F.lit(1)) / settings.piece_pages).cast("int").alias("_pieces"))
    dealt = known.join(pieces, "_host").withColumn("_piece", F.explode(F.sequence(F.lit(0), F.col("_pieces") - 1)))
    # As many rows as hosts, a few numbers each.
    sized = pages.join(pieces, "_host").withColumn("_piece", F.pmod(F.xxhash64("html"), F.col("_pieces")).cast("int"))
    return sized.drop("_pieces").join(dealt.drop("_pieces"), ["_host", "_piece"], "left").drop("_piece")


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, tuple[Outline, int, frozenset]] = {}
    for batch in batches:
        texts = []
        columns = (batch.column(c).to_pylist() for c in ("_host", "html", "_outline", "_content", "_template"))
        for site, page, outline, content, template in zip(*columns):
            own = Outline(parse(page or ""))
            if outline is None:
                texts.append(main_text(own))
            else:
                wrapper = _kept(known, site, lambda: (Outline.unpacked(outline), content, frozenset(template)))
                texts.append(main_text(own, *wrapper))
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            names=["page_id", "url", "text", "n_chars"],
        )


def main_texts(pages: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row of ``pages``.

    ``text`` holds the article's blocks, one per line, white space inside a block as one space and
    character references decoded; it is empty for null or empty html and for pages without content.
    ``n_chars`` counts code points. Pages without a usable URL form one host. A host with few pages
    has no wrapper. Repeated rows are extracted each; columns other than ``page_id, url, html`` are
    ignored; without pages there are no rows.
    """
    kept = pages.select("page_id", "url", F.coalesce(host(F.col("url")), F.lit("")).alias("_host"), "html")
    found = _joined(kept, wrappers(kept, settings), settings)
    kind = pages.schema["page_id"].dataType.simpleString()
    return found.select("page_id", "url", "_host", "html", "_outline", "_content", "_template").mapInArrow(
        _extracted, f"page_id {kind}, url string, text string, n_chars long"
    )
