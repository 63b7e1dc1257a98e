"""Trees of HTML pages: block elements as inner nodes, runs of text as leaves."""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from dataclasses import dataclass, field

#: Element names by what they do to text.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template textarea select option button iframe svg math object canvas audio video title head".split())
RAW = frozenset("script style textarea title iframe noscript template svg math".split())
CLOSES = {
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]),
    "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"]), "body": frozenset(["head"]),
}
BARRIERS = frozenset("table ul ol dl div section article aside nav body html header footer main form".split())
#: Words in classes and ids that say what an element is for.
HINTS = (
    "nav menu header footer side sidebar aside ad ads advert advertisement sponsor promo banner cookie consent notice alert popup modal comment comments "
    "respond related recommend share social breadcrumb breadcrumbs tags login search subscribe newsletter copyright legal widget pagination pager meta "
    "article content main post entry story text body page wrapper container"
).split()
HINT = {h: k for k, h in enumerate(HINTS)}
TAGS = "html body div section article main nav header footer aside form ul ol li dl dt dd p h1 h2 h3 h4 h5 h6 table thead tbody tr td th blockquote pre figure figcaption address fieldset hr details summary other".split()
TAG = {t: k for k, t in enumerate(TAGS)}
LEAF = len(TAGS) + len(HINTS)
SIZES, LINKS, ENDS, UNDER = 7, 4, 3, len(TAGS)
OWN = LEAF + 1 + SIZES + LINKS + ENDS + UNDER
#: Elements that a node remembers to lie within, as it does the hints of all elements above.
WITHIN = {TAG[t]: k for k, t in enumerate("nav header footer aside form article main section blockquote ul table".split())}
FEATURES = OWN + len(WITHIN) + len(HINTS)
#: A form that holds one of these is the page's frame, as some servers write it, and no form to fill in.
FRAMED = frozenset("h1 article main".split())

_TOKEN = re.compile(r"""<(?:!--(?:.*?-->|.*\Z)|[!?][^>]*+>|(/?)([A-Za-z][^\s/>]*+)((?:[^>"']|"[^"]*+"|'[^']*+')*+)>)""", re.S)
_NAME = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)")
_MARK = re.compile("[>\"']")
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+")
_RAW_END = {t: re.compile(rf"</{t}\b", re.I) for t in RAW}


@dataclass
class Tree:
    """parent[k] < k for all but the root; leaves have a text, inner nodes None."""

    parent: list[int] = field(default_factory=list)
    text: list[str | None] = field(default_factory=list)
    features: list[tuple[int, ...]] = field(default_factory=list)

    def add(self, parent: int, text: str | None, features: tuple[int, ...]) -> int:
        self.parent.append(parent)
        self.text.append(text)
        self.features.append(features)
        return len(self.parent) - 1


_KNOWN: dict[tuple[str, str], tuple[int, ...]] = {}


def element_features(tag: str, attributes: str) -> tuple[int, ...]:
    """The tag, and the hints in class, id and role."""
    key = (tag, attributes)
    if key not in _KNOWN:
        if len(_KNOWN) > 20_000:
            _KNOWN.clear()
        words = {w.lower() for m in _NAMES.findall(attributes) for w in _WORDS.findall(m)}
        _KNOWN[key] = (TAG.get(tag, TAG["other"]), *sorted(len(TAGS) + HINT[w] for w in words if w in HINT))
    return _KNOWN[key]


def leaf_features(text: str, linked: int, tag: str) -> tuple[int, ...]:
    """Length, share of linked characters, ending, and the element right above."""
    size = min(SIZES - 1, len(text).bit_length() // 2 + (len(text) > 24))
    link = min(LINKS - 1, int(linked / len(text) * (LINKS - 1) + 0.5))
    end = 0 if text[-1] in ".!?…" else 1 if text[-1].isalnum() else 2
    base = LEAF + 1
    return LEAF, base + size, base + SIZES + link, base + SIZES + LINKS + end, base + SIZES + LINKS + ENDS + TAG.get(tag, TAG["other"])


def inherited(tree: Tree) -> None:
    """Give every node the hints and sectioning elements that it lies within."""
    above: list[frozenset[int]] = []
    known: dict[tuple, frozenset[int]] = {}
    for k, p in enumerate(tree.parent):
        if p < 0:
            above.append(frozenset())
            continue
        key = (above[p], tree.features[p])
        if key not in known:
            own = tree.features[p][: len(tree.features[p]) - len(above[p])]
            tag, *hints = own
            mine = {OWN + len(WITHIN) + h - len(TAGS) for h in hints} if tag != TAG["body"] else set()
            known[key] = above[p] | mine | ({OWN + WITHIN[tag]} if tag in WITHIN else set())
        above.append(known[key])
        tree.features[k] = (*tree.features[k], *above[k])


class _Tags:
    """Tags of a page by where they begin, as (end, whether an end tag, name, attributes); (end,) for what isn't one.

    A regular expression does as long as it finds a tag at every `<`. From the
    first one on that it doesn't, the ends come from a table of the page's `>` and
    quotes, which says for each where a tag ends that goes on there: at the first
    `>` outside of quotes, or, with a quote open, at the first of all.
    """

    def __init__(self, page: str):
        self.page, self.marks = page, None

    def _table(self) -> None:
        found = [(m.start(), m[0]) for m in _MARK.finditer(self.page)]
        self.marks = [p for p, _ in found]
        self.close: list[int | None] = [None] * (len(found) + 1)
        self.outside: list[int | None] = [None] * (len(found) + 1)
        last: dict[str, int] = {}
        for k in range(len(found) - 1, -1, -1):
            place, c = found[k]
            self.close[k] = place if c == ">" else self.close[k + 1]
            self.outside[k] = place if c == ">" else self.outside[last[c] + 1] if c in last else None
            last[c] = k

    def at(self, start: int) -> tuple | None:
        page = self.page
        if self.marks is None or page.startswith("<!--", start):
            if m := _TOKEN.match(page, start):
                return (m.end(),) if m.lastindex is None else (m.end(), m[1], m[2], m[3])
            self._table()
        first = bisect_left(self.marks, start)
        close = self.close[first]
        if close is None:
            return None
        if page[start + 1] in "!?":
            return (close + 1,)
        if (m := _NAME.match(page, start)) is None:
            return None
        end = self.outside[bisect_left(self.marks, m.end())]
        end = close if end is None else end
        return end + 1, m[1], m[2], page[m.end() : end]


def parse(page: str) -> Tree:
    """The page's tree; end tags may be missing, and quotes or comments open."""
    tree, tags = Tree(), _Tags(page)
    opened: dict[str, list[int]] = {}  # where in the stack an element is
    barriers: list[int] = []
    forms: list[int] = []  # open forms that hold nothing yet that shows a frame
    stack: list[tuple[str, int]] = [("html", tree.add(-1, None, element_features("html", "")))]
    run: list[str] = []
    anchors = linked = silent = 0

    def flush() -> None:
        nonlocal linked
        if run:
            text = " ".join("".join(run).split())
            if text:
                tag, node = stack[-1]
                tree.add(node, text, leaf_features(text, min(linked, len(text)), tag))
            run.clear()
        linked = 0

    def close(upto: int) -> None:
        nonlocal silent
        flush()
        for t, node in reversed(stack[upto:]):
            silent -= t in SILENT
            opened[t].pop()
            if t in BARRIERS:
                barriers.pop()
            if forms and forms[-1] == node:
                forms.pop()
        del stack[upto:]

    def open_at(names: frozenset, bounded: bool) -> int | None:
        """The innermost open element of these names, unless bounded and beyond a barrier."""
        k = max((opened[t][-1] for t in names if opened.get(t)), default=None)
        return None if k is None or bounded and barriers and barriers[-1] > k else k

    def say(piece: str) -> None:
        nonlocal linked
        if not silent and piece:
            piece = html.unescape(piece) if "&" in piece else piece
            run.append(piece)
            if anchors:
                linked += len(piece.strip())

    at = 0
    while True:
        start = page.find("<", at)
        if start < 0:
            say(page[at:])
            break
        found = tags.at(start)
        if found is None:
            say(page[at : start + 1])
            at = start + 1
            continue
        say(page[at:start])
        at = found[0]
        if len(found) == 1:
            continue
        ending, tag, attributes = found[1], found[2].lower(), found[3]
        if tag in INLINE:
            if tag == "a":
                anchors = 0 if ending else 1
            elif tag == "br" and not silent:
                run.append(" ")
            continue
        if ending:
            k = open_at(frozenset([tag]), False)
            if k is not None:
                close(k)
                anchors = 0
            else:
                flush()
            continue
        if tag == "html":
            continue
        if tag in CLOSES:
            if (k := open_at(CLOSES[tag], True)) is not None:
                close(k)
        elif tag not in SILENT and (k := open_at(frozenset(["p"]), True)) is not None:
            close(k)
        if tag in RAW and not attributes.endswith("/"):
            end = _RAW_END[tag].search(page, at)
            at = page.find(">", end.end()) + 1 if end else 0
            at = at or len(page)
            continue
        flush()
        if tag in VOID:
            continue
        anchors = 0
        silent += tag in SILENT
        if tag in FRAMED:
            for node in forms:
                tree.features[node] = (TAG["div"], *tree.features[node][1:])
            forms.clear()
        opened.setdefault(tag, []).append(len(stack))
        if tag in BARRIERS:
            barriers.append(len(stack))
        stack.append((tag, tree.add(stack[-1][1], None, element_features(tag, attributes))))
        if tag == "form":
            forms.append(stack[-1][1])
    close(1)
    inherited(tree)
    return tree
