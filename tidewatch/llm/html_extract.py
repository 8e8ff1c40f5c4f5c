"""Main text of web pages by a minimum cut.

A page is read into text blocks with the elements around them. A classifier adds up evidence of the
elements' names and identifiers, of the block's words, links and sentences, and of its place in the page,
and gives each block a cost of calling it content and one of calling it boilerplate; these are the
capacities of its edges to the two terminals. Blocks that follow each other, and blocks that are near in the element tree, are
tied by smoothness edges. A maximum flow between the terminals leaves the cheapest labelling: the
blocks that the source still reaches are the page's content.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field
from html import unescape

from pyspark.sql import DataFrame

from .common import map_chunks

SCHEMA = "page_id long, url string, text string, n_chars long, n_blocks long, n_content long"

#: Element names by what they do to text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript iframe title textarea xmp noembed".split())
#: Elements whose content is no text of the page, and those whose content is not HTML.
HIDDEN = frozenset(["svg", "template"])
FOREIGN = frozenset(["svg", "math"])
#: HTML elements that end an open one of FOREIGN, unless one of ISLAND is nearer.
BREAKS_OUT = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var article section main".split())
ISLAND = frozenset("foreignobject desc annotation-xml mi mo mn ms mtext template".split())
INLINE = frozenset("svg math object template a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label map mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
#: An opening tag ends an open one of these, up to the nearest of the second set.
IMPLIED = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "option": (frozenset(["option"]), frozenset(["select", "datalist"])),
}
#: Evidence of boilerplate (positive) or content (negative) of an element by its name.
NAME_EVIDENCE = {
    "nav": 6.0, "footer": 6.0, "aside": 5.0, "form": 5.0, "menu": 4.0, "button": 6.0, "select": 6.0, "dialog": 5.0, "header": 2.5, "search": 6.0, "fieldset": 4.0,
    "article": -4.0, "main": -3.0, "p": -0.7, "pre": -1.0, "blockquote": -0.5, "h1": -1.5, "h2": -0.8, "h3": -0.8, "li": 0.4, "figcaption": -0.3, "table": 0.2, "address": 1.0,
}
#: Evidence by words in an element's class, id, role and label.
WORD_EVIDENCE = {
    **dict.fromkeys("nav navbar navigation navigational menu menubar menus footer foot breadcrumb breadcrumbs sidebar sidebars aside widget widgets complementary contentinfo pagination pager toolbar topbar masthead".split(), 5.0),
    **dict.fromkeys("ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promos promotion promoted banner".split(), 6.0),
    **dict.fromkeys("comment comments commentlist comentario comentarios kommentar kommentare commentaire commentaires reply replies respond disqus discussion reviews".split(), 6.0),
    **dict.fromkeys("cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login signin search form".split(), 5.0),
    **dict.fromkeys("share sharing social related recommended recommendations recirc trending popular outbrain taboola tags legal copyright disclaimer skip hidden".split(), 4.0),
    **dict.fromkeys("header".split(), 2.5),
    **dict.fromkeys("article content post entry story body main text maincontent articlebody".split(), -2.0),
}
#: Words that name a part's shape rather than its kind; they count only where an identifier has no other.
SHAPE_WORDS = frozenset("container wrapper wrap inner outer box block area section list item items panel group row col column slot unit zone holder placeholder module component card teaser button buttons left right top bottom content body text main page site widget title link links bar bereich abschnitt liste rubrique espace lista zona seccion".split())
#: How much the last word of an identifier, which names the thing, counts against each before it.
HEAD_WEIGHT = 2.0
#: What further identifiers of an element add to the strongest.
FURTHER = 0.3
#: Words of notices, forms and adverts in a block's own text, in the languages of the tables, and what a block that consists of them gets.
CUE_WORDS = frozenset(
    "copyright rights reserved cookie cookies privacy policy terms imprint subscribe newsletter advertisement sponsored login signup share tweet follow "
    "rechte vorbehalten datenschutz impressum agb werbung anzeige newsletter anmelden teilen "
    "droits réservés confidentialité mentions légales publicité abonnez partager connexion "
    "derechos reservados privacidad aviso legal publicidad suscríbete compartir".split()
)
CUE, CUE_SHARE = 3.0, 0.25
#: Weights of the classifier of a block's own text, and of short blocks in the first and last twentieth of a page.
BIAS, PER_LOG_WORD, PER_LINK, PER_SENTENCE = 0.3, -0.55, 3.0, -0.9
EDGE, EDGE_SHARE, EDGE_WORDS = 0.6, 0.05, 12
#: Capacities of the smoothness edges.
ADJACENT, SIBLING, COUSIN = 0.35, 0.6, 0.2

# A quote opens a value after "=" only; one that is never closed counts as a character.
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')|=)*+)>""", re.S)
_RAW_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}
_HIDDEN_END = re.compile(rf"</({'|'.join(sorted(HIDDEN))})(?=[\s/>])", re.I)
_ATTRIBUTE = re.compile(r"""(class|id|role|aria-label|hidden|style|itemprop)\b\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_WORD = re.compile(r"[a-z]+")
_CUE = re.compile(r"[^\W\d_]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_SENTENCE = re.compile(r"[.!?…。？！][\"'”’»)]*(?:\s|$)")


@dataclass(slots=True)
class Element:
    name: str
    parent: Element | None
    link: bool
    #: In an element whose content is not shown.
    hidden: bool
    #: The strongest evidence of boilerplate and of content here or above; the latter fades with distance.
    bad: float = 0.0
    good: float = 0.0


@dataclass(slots=True)
class Block:
    parent: Element
    parts: list[str] = field(default_factory=list)
    link_chars: int = 0
    chars: int = 0
    text: str = ""


def identifier_evidence(identifier: str) -> float:
    """Evidence of one class, id, role or label: the mean of its words', in which the last one weighs more.

    A known word among others that aren't known counts little, so `search-results-explained` is no search form.
    """
    words = _WORD.findall(_CAMEL.sub(" ", identifier).lower())
    words = [w for w in words if w not in SHAPE_WORDS] or words
    if not words:
        return 0.0
    weights = [1.0] * (len(words) - 1) + [HEAD_WEIGHT]
    return sum(k * WORD_EVIDENCE.get(w, 0.0) for k, w in zip(weights, words, strict=True)) / sum(weights)


def _evidence(name: str, attributes: str) -> float:
    value = NAME_EVIDENCE.get(name, 0.0)
    if attributes and len(attributes) > 3:
        found: list[float] = []
        for key, given in _ATTRIBUTE.findall(attributes):
            key, given = key.lower(), given.strip("\"'")
            if key == "hidden" or (key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", given, re.I)):
                value += 8.0
            elif key != "style":
                found += [identifier_evidence(x) for x in ([given] if key == "aria-label" else given.split())]
        strongest = max(found, key=abs, default=0.0)
        value += strongest + FURTHER * (sum(found) - strongest)
    return value


def read_blocks(html: str) -> list[Block]:
    """The page's text blocks in page order, with the element that each stands in."""
    top, blocks, block = Element("#root", None, False, False), [], None
    last_end: dict[str, int] | None = None
    opened: Counter = Counter()
    at, n, head = 0, len(html), False

    def text(piece: str) -> None:
        nonlocal block
        if not piece or head or top.hidden:
            return
        if block is None:
            if piece.isspace():
                return
            owner = top
            while owner.name in INLINE and owner.parent is not None:
                owner = owner.parent
            block = Block(owner)
            blocks.append(block)
        block.parts.append(piece)
        size = len(piece)
        block.chars += size
        if top.link:
            block.link_chars += size

    def pop(last: Element) -> None:
        """Ends all elements from the innermost to last."""
        nonlocal top
        while True:
            ended, top = top, top.parent
            opened[ended.name] -= 1
            if ended is last:
                return

    def close(names: frozenset, until: frozenset) -> None:
        """Ends the innermost open element of names, unless one of until is nearer."""
        if not any(opened[x] for x in names):
            return
        e = top
        while e.parent is not None and e.name not in until and e.name != "template":
            if e.name in names:
                pop(e)
                return
            e = e.parent

    while at < n:
        found = _TAG.search(html, at) if html.find(">", at) >= 0 else None
        if found is None:
            text(html[at:])
            break
        if found.start() > at:
            text(html[at : found.start()])
        at = found.end()
        name = found.group(2)
        if name is None:
            continue
        name = name.lower()
        if found.group(1):
            if name == "head":
                head = False
            if name not in INLINE and not opened["svg"] and not opened["math"] and not top.hidden:
                block = None
            if opened[name]:
                e = top
                while e.name != name:
                    e = e.parent
                pop(e)
            continue
        if name in BREAKS_OUT and (opened["svg"] or opened["math"]):
            close(FOREIGN, ISLAND)
        foreign = name in FOREIGN or opened["svg"] or opened["math"]
        if foreign and found.group(3).endswith("/"):
            continue
        if name in RAW:
            end = _RAW_END[name].search(html, at)
            at = end.end() if end else n
            continue
        if name == "head":
            head = True
            continue
        if name in ("html", "body"):
            head = False
            block = None
            continue
        if name == "br":
            text(" ")
            continue
        if name not in INLINE and not foreign:
            if not top.hidden:
                block = None
                if head and name not in VOID:
                    head = False
            if name in CLOSES_P:
                close(frozenset(["p"]), frozenset(["td", "th", "li", "div", "article", "section", "blockquote", "button", "table"]))
            if name in IMPLIED:
                close(*IMPLIED[name])
        if name in VOID or found.group(3).endswith("/") and name in ("path", "rect", "circle"):
            continue
        hidden = top.hidden
        if name in HIDDEN and not hidden:
            # One that is never closed hides nothing.
            if last_end is None:
                last_end = {m.group(1).lower(): m.start() for m in _HIDDEN_END.finditer(html)}
            hidden = last_end.get(name, -1) >= at
        value = _evidence(name, found.group(3))
        top = Element(name, top, top.link or name == "a", hidden, max(top.bad, value), min(0.95 * top.good, value, 0.0))
        opened[name] += 1
    for b in blocks:
        # Each text node for itself: a reference doesn't go on behind a tag.
        b.text = " ".join("".join(map(unescape, b.parts)).split())
    return [b for b in blocks if b.text]


def log_odds(block: Block, place: float = 0.5) -> float:
    """The classifier: log odds that a block is boilerplate, from its text, its place in the page (0 to 1) and what it stands in."""
    text = block.text
    words = text.count(" ") + 1
    value = BIAS + PER_LOG_WORD * math.log(words) + PER_LINK * min(1.0, block.link_chars / max(1, block.chars))
    sentence = words >= 4 and _SENTENCE.search(text)
    if sentence:
        value += PER_SENTENCE
    if words <= 40:
        # What a short block says: notices are full of their own words.
        cues = sum(w in CUE_WORDS for w in _CUE.findall(text.lower())) + 2 * ("©" in text)
        value += CUE * min(1.0, cues / words / CUE_SHARE)
    if words <= EDGE_WORDS and not sentence and min(place, 1 - place) < EDGE_SHARE:
        value += EDGE
    bad, good = block.parent.bad, block.parent.good
    # What marks boilerplate outweighs what marks content: notices and comments stand in articles too.
    return value + bad + (good if bad < 3 else 0.25 * good)


def minimum_cut(n: int, source: list[float], sink: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which of n nodes stay with the source. source and sink: terminal capacities; edges go both ways.

    Flow is first sent straight through each node. Then, in phases, nodes are numbered by their distance
    from what is left at the source, and all shortest ways to the sink are filled at once: a node that
    leads nowhere is not tried again in a phase.
    """
    merged: dict[tuple[int, int], float] = {}
    for a, b, c in edges:
        key = (a, b) if a < b else (b, a)
        merged[key] = merged.get(key, 0.0) + c
    head: list[list[int]] = [[] for _ in range(n)]
    to: list[int] = []
    room: list[float] = []
    for (a, b), c in merged.items():
        head[a].append(len(to))
        head[b].append(len(to) + 1)
        to += (b, a)
        room += (c, c)
    tiny = 1e-9
    left = [max(0.0, s - t) for s, t in zip(source, sink, strict=True)]
    take = [max(0.0, t - s) for s, t in zip(source, sink, strict=True)]
    while True:
        level = [-1] * n
        front = starts = [i for i in range(n) if left[i] > tiny]
        for i in front:
            level[i] = 0
        depth, found = 0, False
        while front and not found:
            depth += 1
            nearest = []
            for i in front:
                if take[i] > tiny:
                    found = True
                for e in head[i]:
                    j = to[e]
                    if level[j] < 0 and room[e] > tiny:
                        level[j] = depth
                        nearest.append(j)
            front = nearest
        if not found:
            return [k >= 0 for k in level]
        after = [0] * n  # the next edge to try, by node
        for start in starts:
            path: list[int] = []
            i = start
            while left[start] > tiny:
                if take[i] > tiny:
                    flow = min([left[start], take[i], *(room[e] for e in path)])
                    left[start] -= flow
                    take[i] -= flow
                    full = len(path)
                    for k, e in enumerate(path):
                        room[e] -= flow
                        room[e ^ 1] += flow
                        if room[e] <= tiny and k < full:
                            full = k
                    # Go on from before the first edge that is full.
                    if full < len(path):
                        i = to[path[full] ^ 1]
                        del path[full:]
                    continue
                edges_of, k = head[i], after[i]
                while k < len(edges_of) and not (room[edges_of[k]] > tiny and level[to[edges_of[k]]] == level[i] + 1):
                    k += 1
                after[i] = k
                if k < len(edges_of):
                    path.append(edges_of[k])
                    i = to[edges_of[k]]
                elif path:
                    i = to[path.pop() ^ 1]
                    after[i] += 1
                else:
                    break


def smoothness(blocks: list[Block]) -> list[tuple[int, int, float]]:
    """Edges of blocks in page order and of the nearest blocks of the same parent or grandparent."""
    edges = [(i - 1, i, ADJACENT) for i in range(1, len(blocks))]
    last: dict[int, int] = {}
    for i, b in enumerate(blocks):
        above = b.parent.parent or b.parent
        for e, weight in ((above, SIBLING), (above.parent or above, COUSIN)):
            if id(e) in last:
                edges.append((last[id(e)], i, weight))
            last[id(e)] = i
    return edges


def extract(html: str | None) -> tuple[str, int, int]:
    """Main text of a page, its blocks and its content blocks."""
    blocks = read_blocks(html or "")
    odds = [log_odds(b, (k + 0.5) / len(blocks)) for k, b in enumerate(blocks)]
    # Cutting a block from the source costs what calling it boilerplate loses, and the other way round.
    content = minimum_cut(len(blocks), [max(0.0, -v) for v in odds], [max(0.0, v) for v in odds], smoothness(blocks))
    kept = [b.text for b, keep in zip(blocks, content, strict=True) if keep]
    return "\n".join(kept), len(blocks), len(kept)


def extract_pages(pages: DataFrame) -> DataFrame:
    """Main text of every row of pages(page_id, url, html, ...).

    A null or empty html, or one without content, gives an empty text. Whole pages are read whatever
    their length; repeated rows give repeated results, and other columns are left out. An empty table
    gives no rows. A page's header is left out; the headline in an article's own <header> is kept.
    """

    def run(columns: dict[str, list]) -> dict[str, list]:
        found = [extract(h) for h in columns["html"]]
        return {
            "page_id": columns["page_id"], "url": columns["url"], "text": [f[0] for f in found],
            "n_chars": [len(f[0]) for f in found], "n_blocks": [f[1] for f in found], "n_content": [f[2] for f in found],
        }

    return map_chunks(pages.select("page_id", "url", "html"), run, SCHEMA, rows=256)
