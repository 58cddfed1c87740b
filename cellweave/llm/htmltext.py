"""HTML to blocks of text with a note on where each stood. No DOM: one pass over the tags with a stack."""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from dataclasses import dataclass, field

TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*')*+)>", re.S)
NAME = re.compile(r"</?([A-Za-z])")
NAME_END, SPECIAL = re.compile(r"[\s/>]"), re.compile(r"[>\"']")
#: Characters in which a tag's end is looked for directly.
NEAR = 4096
ATTRIBUTE = re.compile(r"([^\s=\"'>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
WORDS = re.compile(r"[^a-z0-9]+")

#: Elements by what they mean here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe xmp noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
ASIDE = frozenset("head nav aside footer form button select menu dialog svg canvas audio video object map datalist".split())
CLOSED_BY = {"p": frozenset("p"), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"])}
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
#: Words of class, id and role that mark what isn't the article, and what is.
NOISE = frozenset("ad ads adv advert adverts advertisement advertising adsense adslot banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus dropdown footer gdpr header login masthead menu modal nav navbar navigation navigator newsletter notice notification pager pagination popup promo promoted promotion related reply replies respond share sharing sidebar signup social sponsor sponsored subscribe subscription teaser toolbar topbar widget widgets".split())
#: First words of marks that say what an element has or is like, not what it is.
ABOUT = frozenset("has with no without is not js".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog alertdialog menu menubar toolbar".split())
CONTENT = frozenset(["articlebody", "articlecontent", "articletext", "entrycontent", "postcontent", "postbody", "storybody", "maincontent", "maintext", "bodytext", "content", "article", "post", "story"])


@dataclass
class Page:
    """blocks: text and depth of container: 3 in an article, 2 in main, 1 in a content element, 0 elsewhere."""

    blocks: list[tuple[str, int]] = field(default_factory=list)

    @property
    def level(self) -> int:
        return max((k for _, k in self.blocks), default=0)


def attributes(source: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(source)}


def standing(name: str, source: str, inside: int) -> int:
    """-1 for what isn't text of the article, else the container's rank (0: none)."""
    if name in ASIDE or name == "header" and not inside:
        return -1
    if not source or source.isspace():
        return 3 if name == "article" else 2 if name == "main" else 0
    found = attributes(source)
    role = found.get("role", "").lower()
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or role in NOISE_ROLES or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", "").lower()):
        return -1
    marks = [m for m in (found.get("class", "") + " " + found.get("id", "")).lower().split() if m]
    if name not in ("body", "html") and any(not NOISE.isdisjoint(w) for m in marks if (w := WORDS.split(m))[0] not in ABOUT):
        return -1
    if name == "article" or found.get("itemprop", "").lower() == "articlebody":
        return 3
    if name == "main" or role == "main" or "main" in marks:
        return 2
    return int(name in ("div", "section", "td") and any(WORDS.sub("", m) in CONTENT for m in marks))


class Marks:
    """Tags, comments and declarations of a page one after the other, in time that grows with the page, whatever is left open in it."""

    def __init__(self, source: str):
        self.source, self.end = source, len(source)
        self.last = source.rfind(">")
        self.name_end = -1
        self.places: list[int] | None = None

    def next(self, at: int) -> tuple[int, int, str, bool, str, str] | None:
        """Begin and end of the next mark from at on, name, whether it closes, its attributes, and the text of a CDATA section. A < that begins no mark is text."""
        source = self.source
        while (at := source.find("<", at)) >= 0:
            two = source[at + 1 : at + 2]
            if two in ("!", "?"):
                if source.startswith("<!--", at):
                    stop = source.find("-->", at + 4)
                    return at, self.end if stop < 0 else stop + 3, "", False, "", ""
                if source.startswith("<![CDATA[", at):
                    stop = source.find("]]>", at + 9)
                    return at, self.end if stop < 0 else stop + 3, "", False, "", source[at + 9 : self.end if stop < 0 else stop]
                stop = source.find(">", at + 2) if at < self.last else -1
                return at, self.end if stop < 0 else stop + 1, "", False, "", ""
            if at < self.last and (two == "/" or two.isalpha()):
                if m := TAG.match(source, at, at + NEAR):
                    return at, m.end(), m[2].lower(), bool(m[1]), m[3], ""
                if (m := NAME.match(source, at)) and (found := self._far(at, m.end())):
                    return found
            at += 1
        return None

    def _far(self, at: int, begin: int) -> tuple[int, int, str, bool, str, str] | None:
        """A tag whose end isn't near, or whose quotes are never closed: that one ends at the first >."""
        if self.name_end < begin:
            m = NAME_END.search(self.source, begin)
            self.name_end = m.start() if m else self.end
        if self.name_end > self.last:
            return None
        if self.places is None:
            self._index()
        k = bisect_left(self.places, self.name_end)
        stop = self.ends[k] if k < len(self.places) else -1
        if stop < 0:
            stop = self.plain[k]
        closes = self.source[at + 1] == "/"
        return at, stop + 1, self.source[at + 1 + closes : self.name_end].lower(), closes, self.source[self.name_end : stop], ""

    def _index(self) -> None:
        """Of each > and quote: where a tag ends that goes on there outside of quotes (-1: nowhere), and the next >."""
        self.places = [m.start() for m in SPECIAL.finditer(self.source, 0, self.last + 1)]
        n = len(self.places)
        self.ends, self.plain = [-1] * (n + 1), [-1] * (n + 1)
        later = {'"': n, "'": n}
        for i in range(n - 1, -1, -1):
            c = self.source[self.places[i]]
            if c == ">":
                self.ends[i] = self.plain[i] = self.places[i]
            else:
                self.plain[i] = self.plain[i + 1]
                self.ends[i] = self.ends[later[c] + 1] if later[c] < n else -1
                later[c] = i


class Open:
    """The open elements: name, standing, the container's rank before; and where each name is open."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, int, int]] = []
        self.where: dict[str, list[int]] = {}

    def push(self, name: str, own: int, rank: int) -> None:
        self.where.setdefault(name, []).append(len(self.stack))
        self.stack.append((name, own, rank))

    def pop(self) -> tuple[str, int, int]:
        found = self.stack.pop()
        self.where[found[0]].pop()
        return found

    def latest(self, names: frozenset[str]) -> int:
        return max((w[-1] for n in names if (w := self.where.get(n))), default=-1)


#: What an element that ends an open one doesn't look beyond.
PARTS_OF_PAGES, LISTS = frozenset(["table", "td", "th", "article", "section", "div", "body"]), frozenset(["ul", "ol", "dl", "table", "select"])
PARAGRAPH = frozenset("p")


def blocks(source: str) -> Page:
    """The visible blocks of a page in order, without what its marks set apart from the text."""
    page = Page()
    marks, opened = Marks(source), Open()
    hidden = 0
    rank = 0
    parts: list[str] = []

    def flush() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            parts.clear()
            if text:
                page.blocks.append((text, rank))

    def pop(to: int) -> None:
        nonlocal hidden, rank
        while len(opened.stack) > to:
            _, own, before = opened.pop()
            if own < 0:
                hidden -= 1
            rank = before

    def close(names: frozenset[str], stop: frozenset[str]) -> None:
        at = opened.latest(names)
        if at >= 0 and at > opened.latest(stop):
            pop(at)

    at, end = 0, len(source)
    while at < end:
        m = marks.next(at)
        if not m:
            if not hidden:
                parts.append(source[at:])
            break
        begin, stop, name, closes, rest, data = m
        if begin > at and not hidden:
            parts.append(source[at:begin])
        at = stop
        if not name:
            if not hidden and data:
                parts.append(html.escape(data))
            continue
        if closes:
            if name not in INLINE and not hidden:
                flush()
            if opened.where.get(name):
                pop(opened.where[name][-1])
            continue
        if name in RAW:
            over = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(source, at, marks.last + 1)
            at = over.end() if over else end
            continue
        if name == "br":
            if not hidden:
                parts.append(" ")
            continue
        if name not in INLINE and not hidden:
            flush()
        if name in VOID or rest.endswith("/") and name in ("svg", "path"):
            continue
        if name in CLOSES_P:
            close(PARAGRAPH, PARTS_OF_PAGES)
        elif name in CLOSED_BY:
            close(CLOSED_BY[name], LISTS)
        own = standing(name, rest, rank)
        opened.push(name, own, rank)
        if own < 0:
            hidden += 1
        else:
            rank = max(rank, own)
    if not hidden:
        flush()
    return page
