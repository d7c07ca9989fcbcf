"""Main text of HTML pages by tree scoring.

A page becomes a tree.  Every paragraph passes points for its length and its commas to the elements above it: all of
them to the nearest container, half to the next, less to those farther up.  A container's points are discounted by
the share of its text that stands in links.  The best container is the article; siblings with a good share of its
points and headings beside it are kept too.  Elements that are something else (menus, adverts, forms, comments and
the like) by their tag or role, or by what their class or id says, are taken out first.

Names are judged in context.  One that consists of nothing but such words (``share-buttons``) counts anywhere; one that
merely contains such a word (``sidebar-x7``) counts for containers outside of ``article`` and ``main`` that hold less
than half of the page's text; one that only repeats an element's own heading doesn't count, nor do names of headings.

Every step is linear in the length of a page, however deep or broken it is.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import column

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content isn't markup; only some of it is text, and none of it main text.
RAW = frozenset("script style title textarea noscript iframe xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li "
    "main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
#: Leaves of text: their points go to the element above them.
PARAGRAPH = frozenset("p pre li dd dt td th blockquote figcaption caption summary h1 h2 h3 h4 h5 h6 address".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A paragraph outside of these isn't ended by a block inside of them.
SCOPE = ("table", "td", "th", "caption", "button")
#: Start tags that end an open element of these kinds.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "body": ("head",)}
#: They hold what is open inside: an end tag or an implied end doesn't reach beyond them.
WALLS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",)}

JUNK_TAGS = frozenset("head nav aside footer form button select option input dialog menu svg math canvas object embed audio video template".split())
JUNK_ROLES = frozenset("navigation banner complementary contentinfo search form dialog alert alertdialog menu menubar toolbar".split())
ADVERTS = frozenset("ad ads advert adverts advertisement advertisements advertorial sponsor sponsored sponsors promo promos".split())
COMMENTS = frozenset("comment comments commentlist disqus reply replies respond".split())
#: Words that say what an element is whatever stands beside them ...
CHROME = ADVERTS | COMMENTS | frozenset(
    "banner banners cookie cookies gdpr sidebar sidebars nav navbar menu menus breadcrumb breadcrumbs pager pagination footer footnav masthead topbar toolbar newsletter subscribe signup login "
    "popup modal overlay widget widgets".split()
)
#: ... and words that do so only if nothing else stands beside them.
JUNK_WORDS = CHROME | frozenset("promotion consent notice notices alert alerts aside navigation header share sharing social related recommended subscription discussion hidden".split())
#: Words of layouts: beside others they add nothing.
FRAME = frozenset("site page global top main bar area block box container wrapper wrap inner outer sticky fixed left right bottom primary secondary".split())
FURNITURE = FRAME | frozenset(
    "list lists link links button buttons slot slots unit units section panel pane column col row item items group holder posts articles stories icons icon media text body content title meta author "
    "thread form count js desktop mobile toggle close open google gpt dfp taboola outbrain bottom footer posts".split()
)
GOOD_WORDS = frozenset("article body content entry main page post story text".split())
KEPT_TAGS = frozenset("html body article main".split())
#: A name that begins so says what stands in an element or beside it, not what the element is.
ABOUT = frozenset("has with without no is".split())

#: Elements above a paragraph that get points.
REACH = 8

_APART = " \t\n\r\f\v\"'"
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_STOP = re.compile(r""">|=\s*["']""")
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORD = re.compile(r"[^\W_]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_MEASURE = re.compile(r"\d+(?:x\d+)?")
_ZEROS = re.compile(r"&#([xX]?)0+(?=[0-9a-fA-F])")
_HUGE = re.compile(r"&#(?:[0-9]{8,}|[xX][0-9a-fA-F]{7,});?")


class _Node:
    __slots__ = ("children", "junk", "good", "kept", "links", "main", "names", "own", "parent", "score", "seen", "size", "tag")

    def __init__(self, tag: str, parent: _Node | None):
        self.tag, self.parent = tag, parent
        self.children: list[_Node | str] = []
        self.names: list[tuple[str, ...]] = []
        self.junk = self.good = self.kept = self.seen = False
        #: Inside of an article.
        self.main = parent is not None and (parent.main or parent.tag in ("article", "main"))
        self.score = 0.0
        #: Characters of text right inside, and with all below; those in links.
        self.own = self.size = self.links = 0


class _Tree:
    """The elements of a page in the order of their start tags, and those that are open."""

    def __init__(self) -> None:
        self.nodes = [_Node("#root", None)]
        self.open = self.nodes[:]
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    def last(self, tags: Iterable[str]) -> int:
        most = -1
        for tag in tags:
            if (places := self.places.get(tag)) and places[-1] > most:
                most = places[-1]
        return most

    def cut(self, place: int) -> None:
        while len(self.open) > place:
            node = self.open.pop()
            self.places[node.tag].pop()
            if node.tag in BLOCK:
                self.blocks.pop()

    def start(self, tag: str, attributes: str) -> None:
        if tag in ("html", "body") and self.places.get(tag):
            return
        if tag in BLOCK:
            if (places := self.places.get("p")) and places[-1] > self.last(SCOPE):
                self.cut(places[-1])
            if tag in HEADING and self.blocks and self.open[self.blocks[-1]].tag in HEADING:
                self.cut(self.blocks[-1])
            if tag in ENDS:
                wall = self.last(WALLS.get(tag, ()))
                first = [p[i] for t in ENDS[tag] if (p := self.places.get(t)) and (i := bisect_right(p, wall)) < len(p)]
                if first:
                    self.cut(min(first))
        node = _Node(tag, self.open[-1])
        _read(node, attributes)
        node.parent.children.append(node)
        self.nodes.append(node)
        # A slash that ends an unquoted value doesn't end an element.
        alone = attributes.endswith("/") and (len(attributes) == 1 or attributes[-2] in _APART)
        if tag not in VOID and (tag in BLOCK or not alone):
            self.places.setdefault(tag, []).append(len(self.open))
            if tag in BLOCK:
                self.blocks.append(len(self.open))
            self.open.append(node)

    def end(self, tag: str) -> None:
        place = self.last(HEADING if tag in HEADING else (tag,))
        # An inline end tag ends nothing beyond its block.
        wall = self.last(WALLS.get(tag, ())) if tag in BLOCK else self.blocks[-1] if self.blocks else -1
        if place > wall:
            self.cut(place)

    def text(self, text: str) -> None:
        if text:
            self.open[-1].children.append(text)
            self.open[-1].own += len(text)


def _read(node: _Node, attributes: str) -> None:
    """What tag and attributes say by themselves, and the names for ``_judge``."""
    node.junk = node.tag in JUNK_TAGS or node.tag == "header" and not node.main
    if not attributes or attributes.isspace():
        return
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values)
        if name in ("class", "id"):
            node.names += [tuple(_WORD.findall(_CAMEL.sub(" ", one).lower())) for one in value.split()]
        elif name == "role":
            node.junk |= value.strip().lower() in JUNK_ROLES
        elif name == "style":
            node.junk |= "display:none" in "".join(value.lower().split())
        elif name == "hidden" or name == "aria-hidden" and value.strip().lower() == "true":
            node.junk = True


def _tag_end(page: str, at: int) -> int:
    """The place of the ``>`` that ends a tag, not one in a quoted value; -1 if there is none."""
    while found := _STOP.search(page, at):
        if found[0] == ">":
            return found.start()
        close = page.find(found[0][-1], found.end())
        at = close + 1 if close >= 0 else found.end()
    return -1


def parse(page: str) -> list[_Node]:
    """The elements of a page, the root first and each before those inside of it.

    Unclosed, misplaced and unknown tags are borne as browsers bear them, in the main.  If a quote is never closed,
    tags from there on end at their first ``>``; a tag that never ends is dropped if nothing but text follows it, and
    is text if not.
    """
    tree = _Tree()
    begin = look = 0
    quotes = True
    while (at := page.find("<", look)) >= 0:
        mark = page[at + 1 : at + 2]
        if mark in ("!", "?"):
            comment = page.startswith("!--", at + 1)
            end = page.find("-->", at + 2) if comment else page.find(">", at + 2)
            tree.text(page[begin:at])
            begin = look = len(page) if end < 0 else end + (3 if comment else 1)
            continue
        name = _NAME.match(page, at + (2 if mark == "/" else 1))
        if not name:
            look = at + 1
            continue
        end = _tag_end(page, name.end()) if quotes else page.find(">", name.end())
        if end < 0 and quotes:
            quotes = False
            end = page.find(">", name.end())
        if end < 0:
            open_ = page.rfind("<")
            tree.text(page[begin : open_ if re.match("[/!?a-zA-Z]", page[open_ + 1 : open_ + 2]) else len(page)])
            return tree.nodes
        tree.text(page[begin:at])
        begin = look = end + 1
        tag = name[0].lower()
        if mark == "/":
            tree.end(tag)
        elif tag in RAW:
            close = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, begin)
            end = page.find(">", close.end()) if close else -1
            begin = look = end + 1 if end >= 0 else len(page)
        else:
            tree.start(tag, page[name.end() : end])
    tree.text(page[begin:])
    return tree.nodes


def _title(node: _Node) -> tuple[str, ...]:
    """The words of the heading that an element is, or begins with."""
    for _ in range(3):
        if node.tag in HEADING:
            return tuple(_WORD.findall("".join(c for c in node.children if isinstance(c, str)).lower()))
        first = next((c for c in node.children if not isinstance(c, str) or not c.isspace()), None)
        if first is None or isinstance(first, str):
            break
        node = first
    return ()


def _judge(nodes: list[_Node]) -> None:
    """Mark what class and id call junk, and what they call good."""
    for node in reversed(nodes):
        node.size += node.own
        if node.tag == "a":
            node.links = node.size
        if node.parent is not None:
            node.parent.size += node.size
            node.parent.links += node.links
    whole = nodes[0].size - nodes[0].links
    for node in nodes:
        for words in node.names or ():
            node.good |= not GOOD_WORDS.isdisjoint(words)
            if not node.junk and not JUNK_WORDS.isdisjoint(words) and words[0] not in ABOUT:
                node.junk = _is_junk(node, frozenset(words), words == _title(node), whole)
    for node in nodes:
        node.size = node.links = 0


def _is_junk(node: _Node, words: frozenset[str], own: bool, whole: int) -> bool:
    said = words & JUNK_WORDS
    if node.main:
        said -= {"header"}
    plain = all(w in (FRAME if "header" in said else FURNITURE) or _MEASURE.fullmatch(w) for w in words - said)
    if node.tag in HEADING:
        return plain and not said.isdisjoint(ADVERTS)
    if node.tag in KEPT_TAGS:
        return plain and not said.isdisjoint(ADVERTS | COMMENTS)
    if own and said.isdisjoint(ADVERTS | COMMENTS) and 2 * node.links < node.size:
        return False
    if plain and said:
        return True
    holds = 2 * (node.size - node.links) >= whole > 0 and said.isdisjoint(COMMENTS)
    return not node.main and node.tag not in PARAGRAPH and not said.isdisjoint(CHROME) and not holds


def _plain(text: str) -> str:
    """Character references decoded (numbers beyond Unicode as U+FFFD), white space as one space, trimmed."""
    if "&#" in text:
        text = _HUGE.sub("�", _ZEROS.sub(r"&#\1", text))
    return " ".join(html.unescape(text).split())


def _blocks(top: _Node) -> Iterator[tuple[_Node, str, int]]:
    """(block element, text, characters in links) of all runs of text under ``top`` that aren't in junk, in order."""
    parts: list[str] = []
    links = 0
    owner = top
    stack: list[tuple[_Node, int, _Node, bool]] = [(top, 0, top, False)]

    def flush() -> list[tuple[_Node, str, int]]:
        nonlocal links
        text = _plain("".join(parts))
        parts.clear()
        count, links = links, 0
        return [(owner, text, min(count, len(text)))] if text else []

    while stack:
        node, i, block, linked = stack.pop()
        children = node.children
        while i < len(children):
            child = children[i]
            i += 1
            if isinstance(child, str):
                parts.append(child)
                if linked:
                    links += len(child)
            elif child.tag == "br":
                parts.append(" ")
            elif not child.junk and (child.children or child.tag in BLOCK):
                stack.append((node, i, block, linked))
                if child.tag in BLOCK:
                    yield from flush()
                    owner = child
                    stack.append((child, 0, child, linked))
                else:
                    stack.append((child, 0, block, linked or child.tag == "a"))
                break
        else:
            if node.tag in BLOCK or node is top:
                yield from flush()
                owner = stack[-1][2] if stack else top


def points(text: str, links: int) -> float:
    """What a paragraph is worth: for itself, its commas and its length, less by the share of its links."""
    return (1 + text.count(",") + min(3, len(text) // 100)) * (1 - links / len(text)) / (5 if len(text) < 25 else 1)


def share(level: int) -> float:
    """The part of a paragraph's points that the ``level``-th container above it gets."""
    return 1 / (level if level < 3 else 3 * level)


_SHARES = [share(level) for level in range(1, REACH + 1)]


def extract(page: str | None) -> str:
    """The main text: blocks in page order joined by a line feed, white space inside a block as one space."""
    if not page:
        return ""
    nodes = parse(page)
    _judge(nodes)
    blocks = list(_blocks(nodes[0]))
    candidates: list[_Node] = []
    for owner, text, links in blocks:
        owner.size += len(text)
        owner.links += links
        up = owner.parent if owner.tag in PARAGRAPH else owner
        if owner.tag not in HEADING:
            worth = points(text, links)
            for part in _SHARES:
                if up.parent is None:
                    break
                up.score += worth * part
                up = up.parent
        while owner.parent is not None and not owner.seen:
            owner.seen = True
            if owner.tag not in PARAGRAPH:
                candidates.append(owner)
            owner = owner.parent
    for node in reversed(nodes[1:]):
        node.parent.size += node.size
        node.parent.links += node.links
    if not candidates:
        return "\n".join(text for _, text, _ in blocks)

    def final(node: _Node) -> float:
        bonus = 25 if node.tag in ("article", "main") else 5 if node.good else 0
        return (node.score + bonus) * (1 - node.links / node.size)

    best = up = max(candidates, key=final)
    while up is not None:
        if up.tag in ("article", "main") and up.size > up.links:
            best = up
            break
        up = up.parent
    least = max(10.0, 0.2 * final(best))
    best.kept = True
    if best.parent is not None:
        for child in best.parent.children:
            if isinstance(child, str) or child.junk or not child.size:
                continue
            density = child.links / child.size
            if best.tag in ("article", "main"):
                child.kept |= child.tag == best.tag and final(child) >= max(least, 35)
            else:
                child.kept |= child.tag in HEADING and density < 0.25 or child.score * (1 - density) >= least or child.tag == "p" and child.size > 80 and density < 0.25
    for node in nodes[1:]:
        node.kept |= node.parent.kept
    return "\n".join(text for owner, text, _ in blocks if owner.kept)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            part = batch.slice(at, 200)
            texts = [extract(x) for x in part["html"].to_pylist()]
            yield pa.record_batch([part["row"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["row", "text", "n_chars"])


def extract_text(pages: DataFrame, page: str = "html") -> DataFrame:
    """``pages`` without the column ``page`` and with ``text`` (string, never null) and ``n_chars`` (its code points).

    Null, empty and textless pages give an empty text; so do pages that are nothing but menus and the like.  Rows
    are independent: repeated rows give repeated results, an empty table none, and ties between containers go to the
    first.  Columns named ``text`` or ``n_chars`` are replaced, all others kept under any name.  No page is cut,
    however long, deep or broken: time and memory are linear in its length.
    """
    kept = [c for c in pages.columns if c not in (page, "text", "n_chars")]
    row = F.struct(*[column(c) for c in kept]) if kept else F.struct(F.lit(0).alias("_"))
    base = pages.select(row.alias("row"), column(page).alias("html"))
    schema = StructType([base.schema["row"], StructField("text", StringType()), StructField("n_chars", LongType())])
    found = base.mapInArrow(_extract, schema)
    return found.select(*[found["row"].getField(c).alias(c) for c in kept], "text", "n_chars")
