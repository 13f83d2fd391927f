"""HTML extraction by tree scoring.

Paragraphs pass points for their length and commas to their ancestors (all to the parent, half to the grandparent, a
quarter one further up and so on), discounted by link density. The best container, or the lowest ancestor that it
shares with other strong ones, and those of its siblings that read like prose are kept; a best container inside of an
article or main element stands for all of that element, and other such elements of a fifth of its score stay with it. Menus, headers, footers, sidebars, notices, adverts, forms,
scripts, styles and comments never count. Every step runs once over the nodes, up or down the tree.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: A quote only opens a value after an equals sign; anywhere else it is a character like others.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>=]|=\s*+(?:\"[^\"]*\"|'[^']*')?+)*+)>|<[!?][^>]*>", re.S)
ATTRIBUTE = re.compile(r"([^\s=/>]+)\s*+(?:=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?+")
#: Elements whose content is no article text, elements that don't part blocks, elements without content.
OUTSIDE = frozenset("head script style noscript template nav header footer aside form button select option textarea label input iframe object embed svg canvas dialog menu audio video map".split())
RAW = frozenset("script style textarea title noscript iframe xmp".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img "
    "button label select option textarea input svg canvas iframe object embed audio video map script style noscript template "
    "math mi mo mn ms mtext mrow mfrac msqrt mroot msub msup msubsup munder mover munderover".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = ("ul", "ol", "dl", "table")
#: Words in class and id that mark an element as no part of the article, and words that say nothing beside them.
UNLIKELY = re.compile(
    r"ads?|advert\w*|advertorial|sponsor\w*|promo\w*|banner|nav(?:s|bar|igation|list|links?)?|menu(?:s|bar|items?|list)?|breadcrumbs?|header|masthead|footer|foot|sidebar|side|aside|widget|related|recommend\w*|"
    r"comments?|commentlist|commenters?|replies|reply|respond|responses|reactions|discussions?|disqus|share|sharing|social|cookies?|consent|notice|alert|popup|modal|overlay|subscribe|newsletter|signup|login|pagination|pager|toolbar|legal|copyright|disclaimer|gdpr")
GENERIC = re.compile(
    r"\d*|[a-z]|box|bars?|lists?|wrap|wrapper|container|area|block|section|inner|outer|content|contents|items?|links?|posts?|articles?|stories|news|top|bottom|left|right|main|site|page|global|text|"
    r"unit|slot|form|buttons?|icons?|group|panel|row|column|col|strip|zone|holder|primary|secondary|media|tags?|thread|section|policy|info|placeholder|mobile|desktop|sticky|fixed|footer|the|js|ui|readers?|users?|visitors?|your|all|new|latest")
#: Words that say nothing of a part inside an article: sides of a layout, and what an article itself can be about.
OWN = frozenset("side foot header legal discussion discussions".split())
LAYOUT = ("has-", "with-", "no-", "without-", "is-")
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split())
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Node:
    """``block``: the nearest node, itself included, that parts blocks; ``blocks``: how many such lie up to here."""

    __slots__ = ("tag", "up", "outside", "block", "blocks", "points", "chars", "linked", "first")

    def __init__(self, tag: str, up: Node | None, outside: bool, inline: bool = False):
        self.tag, self.up, self.outside = tag, up, outside
        self.block = up.block if inline else self
        self.blocks = (up.blocks if up else 0) + (not inline)
        self.points, self.first = 0.0, 1 << 60  # number of its first block
        self.chars = self.linked = 0


def names_outside(value: str, in_article: bool = False) -> bool:
    """Whether a class or id names something outside of the article: its last word does, or one word does and the
    others say nothing. A longer name that only has such a word in it ("legal-analysis") is another thing. Inside an
    article the whole name must say so, by a word that an article's own parts don't use."""
    for name in value.lower().split():
        if name.startswith(LAYOUT):
            continue
        parts = re.split(r"[-_:]+", name)
        found = [bool(UNLIKELY.fullmatch(w)) for w in parts]
        whole = all(u or GENERIC.fullmatch(w) for u, w in zip(found, parts))
        if in_article:
            if whole and any(u and w not in OWN for u, w in zip(found, parts)):
                return True
        elif any(found) and (found[-1] or whole):
            return True
    return False


def unlikely(tag: str, attributes: str, in_article: bool) -> bool:
    """``in_article``: a header inside of an article is the article's own, and an id there, or one of a heading, is made
    of the text that it stands by."""
    if tag in OUTSIDE and not (tag == "header" and in_article):
        return True
    if not attributes or attributes.isspace():
        return False
    whole = tag in ("body", "html", "article", "main")
    for name, *values in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), next((v for v in values if v), "")
        if name in ("class", "id"):
            if whole and "comment" not in value.lower() or tag == "header" or name == "id" and (in_article and not whole or tag in HEADINGS):
                continue
            if names_outside(value, in_article):
                return True
        elif name == "role" and value.lower() in ROLES and not whole:
            return True
        elif name == "style" and HIDDEN.search(value) or name == "aria-hidden" and value.lower() == "true" or name == "hidden" and value.lower() != "until-found":
            return True
    return False


def blocks(page: str) -> tuple[list[Node], list[tuple[Node, str, int]]]:
    """The nodes, parents first, and (container, text, characters in links) of each block outside of what never
    counts, in page order."""
    root = Node("", None, False)
    nodes, stack, out, buf = [root], [root], [], []
    places: dict[str, list[int]] = {}
    length = linked = 0

    def flush() -> None:
        nonlocal length, linked
        if buf:
            text = " ".join("".join(buf).split())
            if text:
                out.append((stack[-1].block, text, min(linked, len(text))))
            buf.clear()
        length = linked = 0

    def say(piece: str) -> None:
        nonlocal linked
        if not stack[-1].outside:
            piece = html.unescape(piece)  # a tag ends a character reference
            buf.append(piece)
            if places.get("a"):
                linked += len(piece)

    def close(k: int) -> None:
        for n in stack[k:]:
            places[n.tag].pop()
        del stack[k:]

    def last(tags: tuple[str, ...]) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=-1)

    at, end, closed = 0, len(page), page.rfind(">")
    while at < end:
        m = TOKEN.search(page, at) if at <= closed or "<!--" in page[at:] else None
        if not m:
            say(page[at:])
            break
        if m.start() > at:
            say(page[at : m.start()])
        at = m.end()
        tag = m[2]
        if not tag:
            continue
        tag = tag.lower()
        drawn = bool(places.get("svg"))
        inline = tag in INLINE or drawn
        if m[1]:
            if not inline:
                flush()
            k = last((tag,))
            if k >= 0 and not (inline and stack[-1].blocks > stack[k].blocks):
                close(k)
            continue
        if tag == "br":
            say(" ")
            continue
        if not inline:
            flush()
            parent = stack[-1].block
            if parent.tag == "p" or parent.tag in HEADINGS and tag in HEADINGS:
                close(places[parent.tag][-1])
            elif tag in CLOSES:
                k = last(CLOSES[tag])
                if k > last(SCOPES):
                    close(k)
        if tag in VOID or m[3].endswith("/") and (tag == "svg" or drawn):
            continue
        outside = stack[-1].outside or unlikely(tag, m[3], bool(places.get("article")))
        if tag in RAW:
            shut = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = shut.end() if shut else end
            continue
        node = Node(tag, stack[-1], outside, inline)
        nodes.append(node)
        places.setdefault(tag, []).append(len(stack))
        stack.append(node)
    flush()
    return nodes, out


def shared(best: Node, nodes: list[Node], pool: list[Node], worth: Callable[[Node], float]) -> Node:
    """``best``, or where other containers compare with it that neither lie on its line nor in a sibling that is kept
    anyway, the lowest ancestor that has them all."""
    bar = max(10.0, 0.2 * worth(best))
    least = min(bar, worth(best) / 2)
    line = [best]
    while line[-1].up:
        line.append(line[-1].up)
    place = {n: i for i, n in enumerate(line)}
    branch: dict[Node, Node] = {}  # the ancestor, or the node itself, that hangs on the line
    for n in nodes:
        if n not in place:
            branch[n] = branch.get(n.up, n)
    top = 0
    for n in pool:
        if n in place or not worth(n) or worth(n) < least:
            continue
        at = place[branch[n].up]
        if at > 1 or at == 1 and worth(branch[n]) < bar:
            top = max(top, at)
    return line[top]


def extract(page: str | None) -> str:
    """The main text: blocks in page order joined by two line feeds; empty without any."""
    if not page:
        return ""
    nodes, found = blocks(page)
    if not found:
        return ""
    for i, (node, text, linked) in enumerate(found):
        node.first = min(node.first, i)
        node.chars += len(text)
        node.linked += linked
        if node.tag not in HEADINGS and len(text) >= 25:
            to = node.up if node.tag in ("p", "pre", "blockquote", "td", "li", "dd") and node.up else node
            to.points += (1 + text.count(",") + min(len(text) / 100, 3)) * (1 - linked / len(text))
    for n in reversed(nodes):  # children before parents
        if n.up:
            n.up.chars += n.chars
            n.up.linked += n.linked
            n.up.points += n.points / 2
            n.up.first = min(n.up.first, n.first)
    number = {n: i for i, n in enumerate(nodes)}
    own = {n for n, *_ in found if n.tag in ("p", "li", "td", "dd", "pre", *HEADINGS)}

    def worth(n: Node) -> float:
        return n.points * (1 - n.linked / max(n.chars, 1))

    held = [n for n in nodes if n.chars]
    named = [n for n in held if n.tag in ("article", "main")]
    pool = [n for n in held if n not in own and n.points] or named or [n for n in held if n not in own]
    best = max(pool, key=lambda n: (worth(n), -n.first, number[n])) if pool else found[0][0]
    climb = best.up
    while climb:  # the whole article, where its best part was found
        if climb.tag in ("article", "main"):
            best = climb
        climb = climb.up
    whole = best.tag in ("article", "main")
    inside, beside = {best}, {}
    if whole:  # a page can have several articles; what holds them is none
        inside.update(n for n in named if worth(n) >= 0.2 * worth(best))
    else:
        best = shared(best, nodes, pool, worth)
        inside = {best}
    bar = max(10.0, 0.2 * worth(best))
    for n in nodes:
        if n.up in inside:
            inside.add(n)
        elif n is not best and n.up is not None and n.up is best.up:
            beside[n] = n
        elif n.up in beside:
            beside[n] = beside[n.up]
    kept = []
    for node, text, linked in found:
        density = linked / len(text)
        if node in inside:
            fine = whole or density < 0.5 or node.tag in ("p", *HEADINGS)
        else:
            top = beside.get(node)
            fine = top is not None and density < 0.5 and (worth(top) >= bar or top.tag == "p" and density < 0.25 and (len(text) > 80 or density == 0 and text[-1:] in ".!?"))
        if fine:
            kept.append(text)
    return "\n\n".join(kept)


def extract_pages(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` with text and n_chars (code points) in place of the html. One pass of Arrow batches.

    Null and empty pages and pages without article text give an empty text. Nothing is cut off. Repeated rows give
    repeated results; an empty table an empty one. Input columns named text or n_chars are replaced. Time grows in
    proportion to a page's length, however long, deep or unbalanced it is. Of containers with equal scores the one that
    begins first is best, then the innermost.
    """
    rest = pages.drop("text", "n_chars") if html_col not in ("text", "n_chars") else pages
    keep = [c for c in rest.columns if c != html_col]
    rest = rest.select(*keep, html_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [extract(x) for x in b.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*keep, "text", "n_chars"])

    fields = "".join(f"`{c}` {rest.schema[c].dataType.simpleString()}, " for c in keep)
    return rest.mapInArrow(run, f"{fields}text string, n_chars long")


def query(spark, sf_dir: str) -> DataFrame:
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
