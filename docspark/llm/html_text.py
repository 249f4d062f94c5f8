"""Main text of web pages by tag-path ratios.

A page becomes leaf texts, each with its root-to-leaf path of block tags.  Text
length and punctuation are added up per path; the ratios (length per node,
punctuation per node) are smoothed along the page, fused, and a threshold on
the fused score selects content paths, over all that is shown on the page.

Blocks on content paths are the article.  What the ratios can't tell is told by
the page's elements: content within <article> or <main> goes before the rest if
it is most of it; elements that by tag, role or class are menus, notices, comments and
the like are no article, nor are rows of equal siblings that each begin with a
short line, as reader comments do; and titles, list items, cells and loose
text in containers of content belong to it though their own ratios are low.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from docspark.llm.frames import add_columns

# HTML's own element classes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section search table ul".split())
#: An opening tag ends open elements of these kinds, up to the given containers.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select", "datalist"}),
    "body": ({"head"}, set()),
}
P_STOPS = {"button", "td", "th", "li", "div", "section", "article", "body"}
#: Elements whose text isn't shown as text of the page.
UNSHOWN = frozenset("head script style noscript template select option textarea input iframe noembed noframes object embed canvas svg audio video xmp".split())
#: Elements that are never article text, wherever they stand.
OUT = frozenset("nav footer aside form button dialog menu search".split())
#: Elements whose texts belong to the content around them, however short they are.
COMPANIONS = frozenset("h1 h2 h3 h4 h5 h6 hgroup header ul ol li dl dt dd table caption thead tbody tfoot tr td th figure figcaption blockquote pre".split())
#: Elements of which several equal ones beside each other can be reader comments.
REPEATED = frozenset("div section article li".split())
OUT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Containers, which class or id can name as something other than the article.
CONTAINERS = frozenset("div section ul ol dl table tbody tr td th header figure fieldset details center hgroup address".split())
#: Classes of what is not shown, on any element.
HIDDEN_NAMES = frozenset("hidden sr-only visually-hidden screen-reader-text print-only".split())
#: Names that are also titles of an article's sections: they count only where no path below is a content path.
SECTION_NAMES = frozenset("notice notices discussion reader reply replies respond promotion copyright legal consent".split())
#: What may stand beside the words of OUT_NAMES in a name that is all of them.
QUALIFIERS = frozenset("site page global top main bottom left right primary secondary inner outer header bar box list links section wrapper wrap container area block content item items group".split())
#: Words of class and id that name something other than the article.
OUT_NAMES = frozenset(
    """ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promoted promotion banner
    menu menubar nav navbar navigation breadcrumb breadcrumbs topbar toolbar sidebar sidenav aside widget widgets rail
    footer foot masthead siteheader pageheader siteinfo copyright legal colophon
    cookie cookies consent gdpr notice notices notification notifications alert alerts popup modal overlay paywall subscribe subscription newsletter signup login
    comment comments commentlist disqus respond replies reply reader discussion
    share sharing social related recommended recommendations recirc trending popular more-links tags taglist
    skip skiplink hidden sr-only visually-hidden print-only search searchbox pagination pager""".split()
)
ARTICLE_NAMES = frozenset("article articlebody article-body entry-content post-content post-body story story-body content-body main-content maincontent".split())
#: The middle dot and ASCII, Latin and CJK sentence marks.
PUNCTUATION = re.compile(r"[.,;:!?…。、，；：！？¿¡]")
TOKEN = re.compile(r"<!--.*?(?:-->|--!>|\Z)|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z](?:[^>\"']|\"[^\"]*\"|'[^']*')*>|</?[a-zA-Z][^>]*>|[^<]+|<", re.S)
NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+)))?")
#: HTML's white space and the other spaces of Unicode, as str.split() has them.
SPACE = re.compile(r"\s+")


@dataclass
class Node:
    tag: str
    up: Node | None
    #: Not shown, or no article text.
    unshown: bool = False
    out: bool = False
    kind: str = ""
    #: Out by a name that is also a section's title, unless there is content below.
    doubtful: bool = False
    #: The same number for equal root-to-leaf paths.
    path: int = 0
    depth: int = 0
    #: Characters of content below.
    weight: int = 0


@dataclass
class Block:
    node: Node
    text: str


def blocks_of(page: str) -> tuple[list[Block], list[Node]]:
    """The texts of a page in order, cut where a block element begins or ends, and all elements, parents first."""
    node = Node("#", None)
    nodes, paths = [node], {}
    opened: Counter[str] = Counter()
    found: list[Block] = []
    said: list[str] = []
    raw = ""

    def end_block() -> None:
        if said:
            text = SPACE.sub(" ", html.unescape("".join(said))).strip()
            if text:
                found.append(Block(node, text))
            said.clear()

    at, size, last = 0, len(page), page.rfind(">")
    while at < size:
        if raw:  # up to the end tag of a raw-text element
            stop = re.compile(rf"</{raw}[\s/>]", re.I).search(page, at)
            if stop is None:
                break
            at, raw = stop.start(), ""
        if at > last and page[at] == "<" and NAME.match(page, at):
            break  # the page ends within a tag
        token = TOKEN.match(page, at)
        said_now, at = token.group(), token.end()
        if said_now[0] != "<" or said_now == "<":
            if not node.unshown:
                said.append(said_now)
            continue
        name = NAME.match(said_now)
        if name is None or said_now[-1] != ">":
            continue  # a comment, a declaration, or a tag that is cut off
        tag = name[1].lower()
        if said_now[1] != "/":
            if tag in INLINE and not node.unshown:
                if not any(_is_out(tag, said_now[name.end() :])[:2]):
                    continue  # inline elements are part of their block
            if tag == "br":
                said.append(" ")
                continue
            if tag in VOID:
                if tag == "hr":
                    end_block()
                continue
            end_block()
            ends = [x for x in (({"p"}, P_STOPS) if tag in CLOSES_P else None, ENDS.get(tag)) if x]
            for kinds, stops in ends:
                if any(opened[x] for x in kinds):
                    parent = _up_to(node, kinds, stops)
                    while node is not parent:
                        opened[node.tag] -= 1
                        node = node.up
            attributes = said_now[name.end() :]
            unshown, out, doubtful = _is_out(tag, attributes)
            if tag == "header" and not out:
                out = not (opened["article"] or opened["main"])
            path = paths.setdefault((node.path, tag), len(paths) + 1)
            node = Node(tag, node, node.unshown or unshown, node.out or out, attributes.strip(" /"), doubtful, path, node.depth + 1)
            nodes.append(node)
            opened[tag] += 1
            if tag in RAW:
                raw = tag
        elif opened[tag]:
            end_block()
            while node.tag != tag:
                opened[node.tag] -= 1
                node = node.up
            opened[tag] -= 1
            node = node.up
        elif tag in ("br", "p"):
            end_block()
    end_block()
    return found, nodes


def _up_to(node: Node, kinds: set[str], stops: set[str]) -> Node:
    """The parent of the outermost open element of these kinds below the next container, else the node itself."""
    x, out = node, node
    while x.up is not None and x.tag not in stops:
        if x.tag in kinds:
            out = x.up
        x = x.up
    return out


def _attributes(said: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(said)}


def _parts(name: str) -> set[str]:
    """The words of a name: its parts at hyphens, underscores and capitals."""
    return {p.lower() for p in re.findall(r"[A-Z]?[a-z]+|[A-Z]+", name)}


def _says_out(name: str) -> tuple[bool, bool]:
    """Whether a whole name says that its element is no article text; and whether it does so for sure."""
    parts = _parts(name)
    words = {name.lower()} & OUT_NAMES or parts & OUT_NAMES
    if "header" in parts and parts & {"site", "page", "global", "top", "main"}:
        words = words | {"siteheader"}
    if not words or name.lower() not in OUT_NAMES and parts - OUT_NAMES - QUALIFIERS:
        return False, False
    return True, bool(words - SECTION_NAMES)


def _is_out(tag: str, said: str) -> tuple[bool, bool, bool]:
    """Whether an element isn't shown, whether it is no article text, and whether the latter is to be seen by the content below."""
    if tag in UNSHOWN:
        return True, True, False
    if tag in ("html", "body", "article", "main") or not said.strip(" />"):
        return False, tag in OUT, False
    found = _attributes(said)
    whole = f"{found.get('class', '')} {found.get('id', '')}".split()
    lower = {w.lower() for w in whole}
    unseen = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or lower & HIDDEN_NAMES
    if unseen or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", ""), re.I):
        return True, True, False
    if tag in OUT or found.get("role", "").lower() in OUT_ROLES:
        return False, True, False
    if tag not in CONTAINERS or lower & ARTICLE_NAMES:
        return False, False, False
    said_out = [_says_out(w) for w in whole]
    return False, any(sure for _, sure in said_out), any(out and not sure for out, sure in said_out)


def content_paths(blocks: list[Block], radius: int = 1, threshold: float = 0.25) -> np.ndarray:
    """Whether the tag path of each block is a content path.

    Length and punctuation per node of a path, each smoothed by a Gaussian over
    the blocks around, are multiplied; a path is content if the mean of its
    blocks is at least `threshold` times the mean over all characters of the page.
    """
    paths, at = np.unique([b.node.path for b in blocks], return_inverse=True)
    nodes = np.bincount(at, minlength=len(paths))
    size = np.array([len(b.text) for b in blocks], float)
    length = np.bincount(at, size, len(paths)) / nodes
    marks = np.bincount(at, [len(PUNCTUATION.findall(b.text)) for b in blocks], len(paths)) / nodes
    kernel = np.exp(-4.0 * (np.arange(-radius, radius + 1) / max(radius, 1)) ** 2)
    kernel /= kernel.sum()
    smooth = lambda x: np.convolve(np.pad(x, radius, "edge"), kernel, "valid")
    fused = np.log1p(smooth(length[at])) * np.log1p(0.35 + smooth(marks[at]))
    mean = np.bincount(at, fused, len(paths)) / nodes
    return (mean >= threshold * (fused * size).sum() / size.sum())[at]


def _repeated(blocks: list[Block], content: np.ndarray) -> set[int]:
    """Elements, by id(), in rows of equal siblings that each begin with a short line and hold no title, after the content that they are less than half of."""
    groups: dict[tuple, list[Node]] = {}
    first: dict[int, list[int]] = {}
    for i, b in enumerate(blocks):
        x = b.node
        while x.up is not None:
            held = first.setdefault(id(x), [])
            if not held and x.tag in REPEATED and x.kind:
                groups.setdefault((id(x.up), x.tag, x.kind), []).append(x)
            held.append(i)
            x = x.up
    found = set()
    titled = re.compile(r"h[1-6]")
    total = sum(len(b.text) for b, keep in zip(blocks, content, strict=True) if keep)
    for row in groups.values():
        held = [first[id(x)] for x in row]
        inside = [i for h in held for i in h]
        begins = [blocks[h[0]] for h in held]
        told = len(row) > 1 and all(len(h) > 1 and len(blocks[h[0]].text) <= 60 and blocks[h[0]].node is not blocks[h[1]].node for h in held)
        if told and not any(titled.fullmatch(blocks[i].node.tag) for i in inside) and content[: inside[0]].any():
            if not any(PUNCTUATION.search(b.text[-1]) for b in begins) and 2 * sum(len(blocks[i].text) for i in inside if content[i]) < total:
                found.update(id(x) for x in row)
    return found


def _above(node: Node, test) -> Node | None:
    """The nearest of an element and those around it that passes."""
    x: Node | None = node
    while x is not None and not test(x):
        x = x.up
    return x


def main_text(page: str | None) -> str:
    """The article of a page: blocks in page order, joined by blank lines; empty if there is none."""
    if not page:
        return ""
    blocks, nodes = blocks_of(page)
    if not blocks:
        return ""
    content = content_paths(blocks)
    may = np.array([not b.node.out for b in blocks])
    chosen = content & may
    if not chosen.any():  # all content is something else: the ratios of the rest among itself
        rest = np.flatnonzero(may)
        if not len(rest):
            return ""
        chosen[rest] = content_paths([blocks[i] for i in rest])
        if not chosen.any():
            return ""
    # Within <article> or <main>, the innermost, if most of the content is there.
    size = np.array([len(b.text) for b in blocks])
    for tag in ("article", "main"):
        inside = np.array([_above(b.node, lambda x, tag=tag: x.tag == tag) is not None for b in blocks])
        if 2 * size[chosen & inside].sum() >= size[chosen].sum():
            may &= inside
            chosen &= inside
            break
    rows = _repeated(blocks, chosen)
    if rows:
        comments = np.array([_above(b.node, lambda x: id(x) in rows) is not None for b in blocks])
        may &= ~comments
        chosen &= ~comments
    for b, keep in zip(blocks, chosen, strict=True):
        b.node.weight += len(b.text) * bool(keep)
    for node in reversed(nodes[1:]):
        node.up.weight += node.weight

    def belongs(b: Block) -> bool:
        """Whether a block that isn't on a content path stands among content: loose text of a container of content, or a title, item or cell in one."""
        if _above(b.node, lambda x: x.doubtful and not x.weight):
            return False
        around = _above(b.node, lambda x: x.tag not in COMPANIONS)
        return bool(b.node.weight) or around is not b.node and around is not None and bool(around.weight)

    return "\n\n".join(b.text for b, ok, keep in zip(blocks, may, chosen, strict=True) if keep or ok and belongs(b))


def extract(pages: DataFrame, html_column: str = "html", text: str = "text") -> DataFrame:
    """Adds the main text of each page and its n_chars (code points).

    Character references are decoded, white space inside a block is one space,
    blocks are joined by two line feeds.  A null or empty page, and one without
    any text outside menus and the like, gives an empty text; a page that ends
    within a tag loses that tag alone; repeated pages are extracted each; columns
    with these two names are replaced.
    """

    def make(part: pa.RecordBatch) -> list[pa.Array]:
        texts = [main_text(x) for x in part.column(part.schema.get_field_index(html_column)).to_pylist()]
        return [pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())]

    return add_columns(pages, html_column, f"`{text}` string, n_chars bigint", make)


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text", "n_chars")
