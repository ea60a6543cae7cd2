"""One page for the site style tree: its elements, their places in the tree, and its blocks of text.

A small reader: one compiled pattern finds the tags, a stack knows what is open.
What a browser would close is closed (a paragraph by the next block, a list item
by the next), end tags without a start are passed over, what is open at the end
ends there. Places are hashes, so that pages of one host meet at them.
"""

from __future__ import annotations

import html as _html
import re
from dataclasses import dataclass, field
from hashlib import blake2b

# fixed values: kinds of elements
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
#: Elements that are never the text of an article.
NOISE = frozenset("nav footer aside form script style textarea title noscript iframe noembed noframes head template button select option dialog menu object svg canvas audio video map applet".split())
#: Words of class, id and role that name a menu, header, footer, sidebar, notice, advert, form or comments.
NOISE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense banner banners sponsor sponsored promo promotion nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager toc "
    "footer sidebar sidebars complementary contentinfo widget widgets related recommended recommendations notice notices cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription signup "
    "login share sharing social comment comments commentlist disqus replies reply respond search form masthead toolbar skip".split()
)
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre article main".split())
#: Elements within a block of text: they begin no block and are no branch of the tree.
SOFT = (INLINE | RAW | VOID | frozenset("button select option svg canvas object audio video map template".split())) - {"hr"}
#: Whole class names and ids of a page's header.
HEADERS = frozenset("header site-header page-header main-header top-header global-header topbar".split())
#: What an open element is closed by; a block closes a paragraph.
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot", "thead"}, "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"}, "option": {"option", "optgroup"}, "head": {"body"}}
SCOPES = frozenset("table ul ol dl select article section div body html main".split())

_TAG = re.compile(r"<(?:(?P<mark>!--|[!?])|(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|(?P<broken>/?[a-zA-Z][^>]*+)(?:>|\Z))")
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_WORD = re.compile(r"[a-z0-9]+")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I) for name in RAW}


def key_of(*parts: object) -> int:
    """63 bits for a place or a text."""
    return int.from_bytes(blake2b("\x00".join(map(str, parts)).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big") >> 1


@dataclass(slots=True)
class Element:
    """Its label (tag and class), whether it names itself noise or a header, the region that it opens, and its children."""

    tag: str
    label: str
    parent: int
    noise: bool = False
    header: bool = False
    mute: bool = False
    region: str = ""
    children: list[int] = field(default_factory=list)


def _element(tag: str, rest: str, parent: int, mute: bool) -> Element:
    own = {m[1].lower(): _html.unescape((m[2] or "").strip("\"'")) for m in _ATTRIBUTE.finditer(rest)} if rest and not rest.isspace() else {}
    classes = own.get("class", "").lower().split()
    new = Element(tag, ".".join([tag, *sorted(classes)]), parent, tag in NOISE or "hidden" in own or own.get("aria-hidden") == "true", tag == "header")
    if own:
        names = [*classes, *own.get("id", "").lower().split(), *own.get("role", "").lower().split()]
        if tag not in ("html", "body", "article", "main"):
            new.noise |= any(not NOISE_WORDS.isdisjoint(_WORD.findall(x)) for x in names)
        new.header |= not HEADERS.isdisjoint(names)
        new.noise |= tag == "article" and any("comment" in x for x in names)
    new.region = "article" if tag == "article" else "main" if tag == "main" or own.get("role") == "main" else ""
    new.mute = mute or (new.noise and tag in SOFT)
    return new


def read(page: str) -> tuple[list[Element], list[tuple[int, str]]]:
    """The elements in page order (0 is the page), and its blocks of text with the element of each."""
    elements = [Element("", "", -1)]
    blocks: list[tuple[int, str]] = []
    stack, run, at, size = [0], [], 0, len(page)

    def flush() -> None:
        text = " ".join(_html.unescape("".join(run)).split())
        run.clear()
        if text:
            blocks.append((next(k for k in reversed(stack) if elements[k].tag not in SOFT), text))

    while at < size:
        m = _TAG.search(page, at)
        if not elements[stack[-1]].mute:
            run.append(page[at : m.start() if m else size])
        if m is None:
            break
        at = m.end()
        if m["mark"]:
            ending = "-->" if m["mark"] == "!--" else ">"
            stop = page.find(ending, at - len(ending) + 1)
            at = size if stop < 0 else stop + len(ending)
            continue
        if m["broken"] is None:
            closing, tag, rest = m["close"], m["name"].lower(), m["rest"]
        else:  # a quote is open: the tag ends at the first >
            closing, (tag, _, rest) = m["broken"][0] == "/", m["broken"].lstrip("/").lower().partition(" ")
        if tag == "br":
            run.append(" ")
        if closing:
            depth = next((d for d in range(len(stack) - 1, 0, -1) if elements[stack[d]].tag == tag), 0)
            if depth:
                if any(elements[k].tag not in SOFT for k in stack[depth:]):
                    flush()
                del stack[depth:]
            continue
        if tag not in SOFT:
            flush()
            _implied(elements, stack, tag)
        elements[stack[-1]].children.append(len(elements))
        elements.append(_element(tag, rest, stack[-1], elements[stack[-1]].mute))
        if tag in RAW:
            stop = _RAW_END[tag].search(page, at)
            at = stop.end() if stop else size if tag in ("script", "style", "textarea", "title") else at
        elif tag not in VOID:
            stack.append(len(elements) - 1)
    flush()
    return elements, blocks


def _implied(elements: list[Element], stack: list[int], tag: str) -> None:
    """Closes what the start of a block closes."""
    for depth in range(len(stack) - 1, 0, -1):
        name = elements[stack[depth]].tag
        if name == "p":
            del stack[depth:]
        elif tag in CLOSED_BY.get(name, ()):
            del stack[depth:]
            break
        elif name in SCOPES or (name not in SOFT and name not in CLOSED_BY):
            break


def places(elements: list[Element], deepest: int = 64) -> tuple[list[int], list[tuple[int, int]]]:
    """For every element its place in the style tree (0 for one within a block), and its presentation: hash and number of branches.

    A presentation is the labels of the branches in order, a run of the same once.
    A place is the parent's place, its presentation, and where in it the element stands;
    what stands below `deepest` levels has the place of its ancestor there.
    """
    place, style, depth = [0] * len(elements), [(0, 0)] * len(elements), [0] * len(elements)
    place[0] = key_of("root")
    for k, e in enumerate(elements):
        branches = [c for c in e.children if elements[c].tag not in SOFT]
        shown = [elements[c].label for c in branches]
        shown = [x for x, before in zip(shown, [None, *shown]) if x != before]
        style[k] = (key_of(*shown), len(shown))
        before, position = None, -1
        for c in branches:
            label = elements[c].label
            position, before = position + (label != before), label
            depth[c] = depth[k] + 1
            place[c] = key_of(place[k], style[k][0], position, label) if depth[c] <= deepest else place[k]
    return place, style


def article(elements: list[Element], blocks: list[tuple[int, str]], place: list[int], low: frozenset[int], named: bool = True) -> list[str]:
    """The blocks of the page's main text, in page order.

    Branches at places of low importance go. Then what pages say of themselves is
    followed (unless not `named`): elements that are or name themselves noise go, an
    article or main part stands for the page, and prose in it stays, whatever other
    pages repeat.
    """
    count = len(elements)
    poor = [False] * count
    for k in range(1, count):
        poor[k] = poor[elements[k].parent] or place[k] in low
    if not named:
        return [t for k, t in blocks if not poor[k]]
    noise, region, prose = [False] * count, [""] * count, [False] * count
    opened: set[int] = set()
    openers = [k for k, e in enumerate(elements) if e.region and not (e.noise and e.region == "article")]
    for _ in range(2):
        for k in range(1, count):
            e, up = elements[k], elements[k].parent
            noise[k] = noise[up] or (k not in opened and (e.noise or (e.header and not region[up])))
            region[k] = "" if noise[k] else "article" if "article" in (e.region, region[up]) else e.region or region[up]
            prose[k] = bool(e.region) or (prose[up] and e.tag in PROSE)
        if not openers or any(region[k] for k in openers):
            break
        up = openers[0]  # all of them stand in noise: an element left open, or a form around the page
        while up > 0:
            opened.add(up)
            up = elements[up].parent
    found = {region[k] for k in openers}
    wanted = "article" if "article" in found else "main" if "main" in found else ""
    return [t for k, t in blocks if not noise[k] and region[k].startswith(wanted) and (not poor[k] or (wanted and prose[k]))]
