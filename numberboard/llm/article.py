"""Main text of web pages by tree scoring.

The html becomes a tree of elements with blocks of text. Every paragraph earns points for its length
and its commas, less the share of its letters that are links, and passes them to its ancestors: all of
them to its parent, half to the next, a quarter to the one after, and so on. That is one sum from the
leaves up, so it takes a page's length in time, however deep the tree. A container's score is its points,
more if its name says article and less if it says list or form, times the share of its text that is not
links. The best container is kept, or the whole ``article`` (else ``main``) around it, and those of its
siblings that look like parts of the same text.

Parts that are not text of the article are left out everywhere: menus, page headers, footers, asides,
forms, scripts and styles by element, role or name (class and id); lists and boxes that are nearly all links;
reader comments, adverts and notices by name. A form around more than half of the page's points is
the page itself and stays.

Each block is one line: character references decoded, every run of white space one space, trimmed.
A page is one row of its task: nothing is gathered, so copies of a page or pages of one host spread like others.

Defined cases: a null or empty html, and one without any text, gives an empty text. Plain text without
tags is one block. Unclosed, crossed and unknown tags and cut-off pages are read as far as they go. A tag cut
off at the end is no text. Repeated rows give a row each, an empty table none; a null id or url is kept. Pages of any length are read whole. Other columns are ignored.
"""

from __future__ import annotations

import html as references
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAGE_SCHEMA = "page_id long, url string, text string, n_chars long"

_WORDS = str.split
VOID = frozenset(_WORDS("area base br col embed hr img input link meta param source track wbr"))
RAW = frozenset(_WORDS("script style textarea title xmp iframe noembed noframes"))
BLOCKS = frozenset(
    _WORDS(
        "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure"
        " footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option optgroup p pre search section"
        " select summary table tbody td template tfoot th thead tr ul noscript button title"
    )
)
#: Elements whose own text is a paragraph that scores for the parent; text right inside any other scores for that element.
PARAGRAPHS = frozenset(_WORDS("p pre li dd dt td th figcaption caption summary address h1 h2 h3 h4 h5 h6"))
HEADINGS = frozenset(_WORDS("h1 h2 h3 h4 h5 h6"))
DROPPED = frozenset(
    _WORDS(
        "head title nav footer aside script style noscript template iframe object embed svg math canvas audio video menu search dialog"
        " select option optgroup textarea button input label fieldset legend datalist output progress meter noembed noframes"
    )
)
DROPPED_ROLES = frozenset(
    _WORDS("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar tablist")
)
#: A class or id that begins or ends in one of these words names something beside the article.
BESIDE = frozenset(
    _WORDS(
        "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion promoted banner"
        " nav navbar navigation menu menus breadcrumb breadcrumbs pager pagination toolbar toc sidebar sidebars aside rail"
        " footer cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription"
        " signup login share sharing social related recommended recommendations comment comments commentlist respond reply replies"
        " disqus discussion widget widgets form skip copyright"
    )
)
#: Beside the article only outside of one: inside it holds the title.
HEADER = frozenset(("header", "masthead"))
#: A name that begins so tells of a layout.
LAYOUT = frozenset(_WORDS("no not has with without is"))
#: A class or id that ends in one of these names the article, and outweighs BESIDE.
ARTICLE = frozenset(_WORDS("article content story post entry main body text prose hentry"))
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")

#: Elements whose start ends an open paragraph, and which open elements a start tag ends by itself.
ENDS_PARAGRAPH = BLOCKS - frozenset(_WORDS("option optgroup legend caption td th tr tbody thead tfoot summary title head html body button"))
IMPLIED = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "tbody": ("tr", "td", "th", "tbody", "thead"), "tfoot": ("tr", "td", "th", "tbody", "thead"), "option": ("option",), "body": ("head",),
}
#: An implied end doesn't reach beyond these.
WALLS = {
    "li": ("ul", "ol", "menu", "dir"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",),
    "tbody": ("table",), "tfoot": ("table",), "option": ("select",), "body": (),
}

TAG = re.compile(
    r"<(?:!--.*?(?:--!?>|\Z)|[!?][^>]*>"
    r"""|(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<more>(?:[^>"'=]++|=\s*(?:"[^"]*+"|'[^']*+')|["'=])*+)>)""",
    re.S,
)
TAG_BEGIN = re.compile(r"<[/!?A-Za-z]")
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
COMMA = re.compile("[,،、，]")
SENTENCE_END = (".", "!", "?", "。", "…", '."', ".”")

LENGTH_STEP = 100
MOST_FOR_LENGTH = 3.0
ARTICLE_BONUS = 25.0
LIST_MALUS = 3.0
LISTS = frozenset(_WORDS("ul ol dl li dd dt form address table tr td th"))
SIBLING_SHARE = 0.2
LONG_PARAGRAPH = 80
MOSTLY_LINKS = 0.8
MENU_LINKS = 3
#: Rows whose texts are handed back at once.
ROWS = 256
LINK_BOXES = frozenset(_WORDS("ul ol dl table div section"))


class Node:
    """A block element: its lines of text and block elements in page order, and what they pass up."""

    __slots__ = ("name", "parent", "children", "beside", "article", "earned", "points", "letters", "linked", "links", "score")

    def __init__(self, name: str, parent: Node | None, beside: bool = False, article: bool = False):
        self.name, self.parent, self.beside, self.article = name, parent, beside, article
        self.children: list[Node | str] = []
        self.earned = self.points = self.score = 0.0
        self.letters = self.linked = self.links = 0


def roles(attributes: str, inside: bool) -> tuple[bool, bool]:
    """Whether class, id and role say that an element stands beside the article, or that it is one."""
    beside = article = dropped = False
    for key, a, b, c in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), a or b or c
        if key == "role":
            dropped |= value.lower() in DROPPED_ROLES and not (inside and value.lower() == "banner")
            article |= value.lower() in ("main", "article")
        elif key in ("class", "id"):
            for word in value.split():
                parts = [p.lower() for p in NAME.findall(word)]
                if not parts or parts[0] in LAYOUT:
                    continue
                ends = {parts[0], parts[-1]}
                named = bool(ends & BESIDE) or (not inside and bool(ends & HEADER))
                beside |= named
                article |= parts[-1] in ARTICLE and not named
    return dropped or (beside and not article), article


class Page:
    """Reads tags and text of a page from left to right into a tree of block elements."""

    def __init__(self) -> None:
        self.root = Node("#page", None)
        self.nodes = [self.root]  # in page order
        self.stack: list[tuple[str, bool]] = [("#page", False)]  # open elements: name, whether it mutes inline text
        self.blocks: list[tuple[int, Node]] = [(0, self.root)]  # open block elements and their places
        self.where: dict[str, list[int]] = {}  # places of open elements by name
        self.muted = 0
        self.text: list[str] = []
        self.letters = self.linked = 0

    def place(self, *names: str) -> int:
        """Place of the innermost open element of these names, 0 if there is none."""
        return max((self.where[n][-1] for n in names if self.where.get(n)), default=0)

    def add(self, raw: str) -> None:
        if self.muted:
            return
        raw = references.unescape(raw) if "&" in raw else raw
        self.text.append(raw)
        size = len(raw.strip())
        self.letters += size
        if self.place("a"):
            self.linked += size

    def flush(self) -> None:
        """What was read since the last block edge is a line of the innermost block."""
        if self.text:
            line, node = " ".join("".join(self.text).split()), self.blocks[-1][1]
            if line:
                share = self.linked / self.letters if self.letters else 0.0
                node.children.append(line)
                node.letters += self.letters
                node.linked += self.linked
                if node.name not in HEADINGS:
                    worth = 1 + len(COMMA.findall(line)) + min(len(line) / LENGTH_STEP, MOST_FOR_LENGTH)
                    target = node.parent if node.name in PARAGRAPHS and node.parent else node
                    if not node.beside:
                        target.earned += worth * (1 - share)
            self.text.clear()
        self.letters = self.linked = 0

    def open(self, name: str, more: str) -> None:
        inside = bool(self.place("article", "main"))
        beside, article = roles(more, inside) if "=" in more else (False, False)
        beside &= name not in ("html", "body", "article", "main")
        beside |= name in DROPPED or (name == "header" and not inside)
        self.where.setdefault(name, []).append(len(self.stack))
        if name in BLOCKS:
            parent = self.blocks[-1][1]
            node = Node(name, parent, beside or self.muted > 0, article or name in ("article", "main"))
            parent.children.append(node)
            self.nodes.append(node)
            self.blocks.append((len(self.stack), node))
            beside = False
        elif name == "a":
            self.blocks[-1][1].links += 1
        self.stack.append((name, beside))
        self.muted += beside

    def close(self, place: int) -> None:
        """Close the element at this place and all inside it."""
        while len(self.stack) > place:
            name, muting = self.stack.pop()
            self.where[name].pop()
            self.muted -= muting
            if self.blocks[-1][0] == len(self.stack):
                self.blocks.pop()

    def start(self, name: str, more: str) -> None:
        if name in VOID and name not in BLOCKS:
            if name == "br":
                self.text.append(" ")
            return
        if name in BLOCKS:
            self.flush()
            if name in ENDS_PARAGRAPH and self.place("p") > self.place("button", "td", "th", "caption"):
                self.close(self.place("p"))
            if name in IMPLIED:
                wall = self.place(*WALLS[name])
                ended = [p for p in (self.place(e) for e in IMPLIED[name]) if p > wall]
                if ended:
                    self.close(min(ended))
        if name not in VOID:
            self.open(name, more)

    def end(self, name: str) -> None:
        place = self.place(name)
        if name in BLOCKS:
            self.flush()
            if place:
                self.close(place)
        elif place > self.blocks[-1][0]:  # an inline end tag doesn't end blocks around it
            self.close(place)


def parse(page: str) -> Page:
    tree, at, final = Page(), 0, page.rfind(">")
    while at < len(page):
        tag = page.find("<", at)
        if tag < 0 or tag > final:  # no tag ends from here on
            cut = TAG_BEGIN.search(page, at)
            tree.add(page[at : cut.start()] if cut else page[at:])
            break
        if tag > at:
            tree.add(page[at:tag])
        found = TAG.match(page, tag) if TAG_BEGIN.match(page, tag) else None
        if not found:
            tree.add("<")
            at = tag + 1
            continue
        at, name = found.end(), (found["name"] or "").lower()
        if not name:
            continue
        if found["end"]:
            tree.end(name)
        elif name in RAW:
            closing = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = closing.end() if closing else len(page)
        else:
            tree.start(name, found["more"])
    tree.flush()
    return tree


def pass_up(nodes: list[Node]) -> None:
    """Points, letters and links of every element with all it holds; what stands beside counts for nothing."""
    for node in nodes:
        node.points = node.earned
    for node in reversed(nodes[1:]):
        if not node.beside:
            node.parent.points += node.points / 2
            node.parent.letters += node.letters
            node.parent.linked += node.linked
            node.parent.links += node.links


def drop_forms(nodes: list[Node]) -> None:
    """Forms stand beside the article, unless more than half of all points are earned in one."""
    total = sum(n.earned for n in nodes)
    held = [0.0] * len(nodes)
    number = {id(n): k for k, n in enumerate(nodes)}
    for k in range(len(nodes) - 1, 0, -1):
        node = nodes[k]
        held[k] += node.earned
        if node.name == "form" and 2 * held[k] <= total:
            node.beside = True
        held[number[id(node.parent)]] += held[k]


def lines(kept: list[Node | str]) -> list[str]:
    """Text of these blocks in page order."""
    out, rest = [], kept[::-1]
    while rest:
        node = rest.pop()
        if isinstance(node, str):
            out.append(node)
        elif not node.beside:
            rest.extend(reversed(node.children))
    return out


def belongs(node: Node | str, best: Node) -> bool:
    """Whether a sibling of the best container is a part of the same text."""
    if isinstance(node, str):
        return len(node) >= LONG_PARAGRAPH
    if node is best or node.name == "h1":
        return True
    share = node.linked / node.letters if node.letters else 1.0
    if node.name == "p":
        last = node.children[-1] if node.children else ""
        return share < 0.25 if node.letters >= LONG_PARAGRAPH else share == 0 and str(last).endswith(SENTENCE_END)
    return best.score > 0 and node.score >= SIBLING_SHARE * best.score


def main_text(page: str | None) -> str:
    """The article of a page, a line for each block."""
    if not page:
        return ""
    tree = parse(page)
    nodes = tree.nodes
    if any(n.name == "form" for n in nodes):
        drop_forms(nodes)
    pass_up(nodes)
    for node in nodes[1:]:
        menu = node.name in LINK_BOXES and node.links >= MENU_LINKS and node.linked > MOSTLY_LINKS * node.letters
        node.beside |= node.parent.beside or (menu and not node.article)
    best = None
    for node in nodes:
        if not node.beside and node.letters:
            bonus = ARTICLE_BONUS if node.article else -LIST_MALUS if node.name in LISTS else 0.0
            node.score = (node.points + bonus) * (1 - min(node.linked / node.letters, 1.0))
            if best is None or node.score > best.score:
                best = node
    if best is None:
        return ""
    for name in ("article", "main"):
        around = best
        while around is not None and around.name != name:
            around = around.parent
        if around is not None:
            best = around
            break
    beside_it = best.parent.children if best.parent else [best]
    return "\n".join(lines([x for x in beside_it if belongs(x, best)]))


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                texts = [main_text(page.as_py()) for page in part.column("html")]
                sizes = pa.array([len(t) for t in texts], pa.int64())
                columns = [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), sizes]
                yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    whole = pages.select(F.col("page_id").cast("long").alias("page_id"), *(F.col(c).cast("string").alias(c) for c in ("url", "html")))
    return whole.mapInArrow(extract, PAGE_SCHEMA)
