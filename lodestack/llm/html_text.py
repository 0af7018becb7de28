"""Main text of web pages: flat text blocks, described by their and their neighbours' words and links, judged by a decision tree.

A page is cut at block-level tags into flat blocks. Each block has its word count and link density, those of the block before
and after, and what encloses it: an article or main element (1), nothing of note (0), an element whose class or id merely
mentions a part of a page that is no article (-1), or one that is such a part by its element, role, hiding or whole class name
(-2). A decision tree grown from the small labelled table below keeps or drops a block.

A page of which this leaves next to nothing, and nothing of an article, is read again, leniently: forms around the page and names that also speak of a layout (a
sidebar on the right, a header) count for nothing there, so that words and links decide. What then is kept is taken if it is
several times as much; a page with no unmarked text at all is read more leniently still. If nothing is left, the page's unmarked blocks
that are no links are its text, however short.

The scanner reads a page once from left to right; what it looks ahead for and does not find (a closing quote, a closing
script) is not looked for again, so that a page takes time in proportion to its length whatever it holds.

Results: null or empty html gives an empty text; pages cut off anywhere are read as far as they go; text inside
script, style, template and other unrendered elements never counts; repeated rows give repeated results.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

import numpy as np
from pyspark.sql import DataFrame

from .common import computed

# Names of HTML elements by role.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
UNSEEN = frozenset("noscript template head select svg math object canvas audio video datalist".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BOILERPLATE = frozenset("nav header footer aside form menu dialog button fieldset".split()) | UNSEEN
ARTICLE = frozenset("article main".split())
ITEMS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"td", "th", "tr"}, "option": {"option"}}
CONTAINERS = frozenset("div section td th tr table ul ol dl li dt dd figure blockquote center body details summary".split()) | BOILERPLATE | ARTICLE
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
# Words of class and id names. PARTS name a part of a page that is no article; HOLDERS say only that something is a box, a list, or where
# it stands; OWN before "header" or "title" make it the article's own.
PARTS = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead banner footer copyright sidebar aside widget widgets ad ads adv advert adverts advertisement advertisements advertising adslot adsense adbox "
    "adunit dfp sponsor sponsored sponsors promo promos promotion promotions promoted cookie cookies gdpr ccpa consent notice notices newsletter newsletters subscribe subscription signup signin login share sharing sharebar social "
    "related recommended recommendations popular trending tags tagcloud pagination pager comment comments commentlist disqus reply replies respond response responses reactions popup modal overlay toolbar skip skiplink skiplinks paywall".split())
HOLDERS = frozenset("wrapper wrap container inner outer box area block list listing item items section group row col column bar left right top bottom site page global main primary secondary fixed sticky slot unit panel form button buttons icons icon links link posts articles stories reads news thread body text title heading count feed small large mobile desktop 1 2 3 4".split())
OWN = frozenset("entry post article story content section chapter card".split())
COMMENTS = frozenset("comment comments commentlist reply replies respond response responses".split())
#: PARTS that also name layouts or whole pages, which count for nothing where a page is read leniently; so do forms.
LAYOUT = frozenset("header masthead banner sidebar aside".split())
#: More of them, for pages without any unmarked text.
BOXES = LAYOUT | frozenset("social tags related".split())
SIDES = frozenset("left right top bottom both none".split())
#: A page with fewer kept words is read leniently, and what is found then is taken from so many times as many words.
FEW, TIMES = 25, 4
#: Names that speak of what an element has, lacks or allows, not of what it is.
ABOUT = re.compile(r"(?:^|[-_])(?:no|not|non|has|with|without|is|show|hide|enable|disable)[-_]|[-_](?:open|opened|closed|enabled|disabled|visible|active)$", re.I)
PIECES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
NONE_SHOWN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\s*(?:!\s*important\s*)?(?:;|$)", re.I)
NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
BETWEEN = re.compile(r"[\s/]*+")
ATTRIBUTE = re.compile(r"[^\s/>][^\s/>=]*+")
EQUALS = re.compile(r"\s*+=\s*+")
BARE = re.compile(r"[^\s>]*+")
SPACE = re.compile(r"\s+")
#: What an element announces; OUT is STRONG by element, role or hiding rather than by name, which not even an article inside of it can mend.
WEAK, STRONG, OUT = -1, -2, -3

#: The labelled table: words, link density, words before, link density before, words after, link density after,
#: what encloses the block (1 an article, 0 nothing of note, -1 something that mentions boilerplate, -2 boilerplate), keep.
LABELLED = (
    (6, 1.0, 0, 0.0, 8, 0.0, -2, 0), (1, 1.0, 0, 0.0, 1, 1.0, -2, 0), (1, 1.0, 1, 1.0, 1, 1.0, -2, 0), (1, 1.0, 1, 1.0, 12, 0.0, -2, 0),
    (9, 0.0, 1, 1.0, 7, 0.0, -2, 0), (14, 0.0, 6, 1.0, 60, 0.0, -2, 0), (12, 0.0, 80, 0.0, 0, 0.0, -2, 0), (30, 0.1, 40, 0.0, 0, 0.0, -2, 0),
    (45, 0.0, 50, 0.0, 40, 0.0, -2, 0), (90, 0.0, 120, 0.0, 60, 0.0, -2, 0), (3, 0.0, 20, 0.0, 35, 0.0, -2, 0), (200, 0.0, 10, 0.0, 20, 0.0, -2, 0),
    (7, 0.0, 12, 0.0, 45, 0.0, 1, 1), (1, 0.0, 60, 0.0, 80, 0.0, 1, 1), (2, 0.0, 3, 0.0, 12, 0.0, 1, 1), (55, 0.0, 8, 0.0, 30, 0.0, 1, 1),
    (120, 0.05, 60, 0.0, 90, 0.0, 1, 1), (4, 0.5, 80, 0.0, 20, 0.0, 1, 1), (10, 1.0, 60, 0.0, 40, 0.0, 1, 1), (300, 0.0, 0, 0.0, 0, 0.0, 1, 1), (1, 0.0, 0, 0.0, 0, 0.0, 1, 1),
    (2, 0.0, 50, 0.0, 3, 0.0, 1, 1), (70, 0.0, 9, 0.0, 1, 0.0, 1, 1), (4, 0.0, 4, 0.0, 2, 0.0, 1, 1), (20, 0.2, 30, 0.0, 4, 0.9, 1, 1), (40, 0.0, 70, 0.0, 5, 1.0, 1, 1), (3, 0.0, 2, 1.0, 2, 1.0, 1, 1), (12, 0.8, 30, 0.0, 2, 0.0, 1, 1),
    (60, 0.0, 6, 0.0, 70, 0.0, 0, 1), (80, 0.1, 60, 0.0, 9, 0.0, 0, 1), (25, 0.0, 50, 0.0, 40, 0.0, 0, 1), (35, 0.0, 3, 0.5, 60, 0.0, 0, 1), (18, 0.0, 40, 0.0, 30, 0.0, 0, 1),
    (8, 0.0, 2, 1.0, 60, 0.0, 0, 1), (5, 0.0, 45, 0.0, 55, 0.0, 0, 1), (150, 0.0, 0, 0.0, 0, 0.0, 0, 1), (6, 0.0, 30, 0.0, 25, 0.0, 0, 1), (20, 0.0, 0, 0.0, 0, 0.0, 0, 1), (22, 0.0, 3, 0.0, 0, 0.0, 0, 1), (4, 0.0, 0, 0.0, 30, 0.0, 0, 1), (5, 0.0, 0, 0.0, 90, 0.0, 0, 1),
    (3, 1.0, 2, 1.0, 4, 1.0, 0, 0), (2, 1.0, 0, 0.0, 3, 1.0, 0, 0), (20, 0.9, 10, 1.0, 15, 0.8, 0, 0), (5, 0.0, 2, 1.0, 3, 1.0, 0, 0),
    (4, 0.0, 3, 0.0, 2, 0.0, 0, 0), (9, 0.6, 40, 0.0, 3, 1.0, 0, 0), (12, 0.7, 60, 0.0, 0, 0.0, 0, 0), (3, 0.0, 0, 0.0, 4, 1.0, 0, 0), (40, 0.8, 60, 0.0, 50, 0.0, 0, 0),
    (60, 0.0, 6, 0.0, 70, 0.0, -1, 1), (80, 0.1, 60, 0.0, 9, 0.0, -1, 1), (24, 0.0, 0, 0.0, 0, 0.0, -1, 1), (150, 0.0, 0, 0.0, 0, 0.0, -1, 1), (30, 0.1, 40, 0.0, 0, 0.0, -1, 1), (6, 0.0, 0, 0.0, 60, 0.0, -1, 1), (25, 0.0, 4, 0.0, 40, 0.0, -1, 1),
    (5, 0.0, 0, 0.0, 3, 0.0, -1, 0), (9, 0.0, 1, 1.0, 7, 0.0, -1, 0), (12, 0.0, 80, 0.0, 0, 0.0, -1, 0), (3, 1.0, 2, 1.0, 4, 1.0, -1, 0), (40, 0.8, 60, 0.0, 50, 0.0, -1, 0), (12, 0.0, 30, 0.0, 5, 0.0, -1, 0), (6, 0.5, 20, 0.0, 8, 0.0, -1, 0),
)
FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "place")


def grow(rows: np.ndarray, labels: np.ndarray, depth: int = 8) -> tuple:
    """CART by Gini impurity: (keep,) or (feature, threshold, tree at or below, tree above)."""
    share = labels.mean()
    if depth == 0 or share in (0.0, 1.0):
        return (bool(share >= 0.5),)
    best = None
    for f in range(rows.shape[1]):
        values = np.unique(rows[:, f])
        for t in (values[1:] + values[:-1]) / 2:
            low = rows[:, f] <= t
            p, q = labels[low].mean(), labels[~low].mean()
            impurity = low.sum() * p * (1 - p) + (~low).sum() * q * (1 - q)
            if best is None or impurity < best[0] - 1e-12:
                best = (impurity, f, float(t), low)
    if best is None:
        return (bool(share >= 0.5),)
    _, f, t, low = best
    return (f, t, grow(rows[low], labels[low], depth - 1), grow(rows[~low], labels[~low], depth - 1))


def judge(tree: tuple, rows: np.ndarray) -> np.ndarray:
    if len(tree) == 1:
        return np.full(len(rows), tree[0])
    f, t, low, high = tree
    return np.where(rows[:, f] <= t, judge(low, rows), judge(high, rows))


def trained_tree() -> tuple:
    data = np.asarray(LABELLED, float)
    return grow(data[:, :-1], data[:, -1])


def named(token: str, lenient: frozenset[str] = frozenset()) -> int:
    """What one class or id says: STRONG where, boxes and positions aside, its last word names a part that is no article, WEAK where an earlier word does, else 0."""
    if ABOUT.search(token):
        return 0
    pieces = [p.lower() for p in PIECES.findall(token)]
    told = [p for p in pieces if p not in HOLDERS] or pieces
    if lenient:
        told = [p for p in told if p not in lenient]
    if not told or not any(p in PARTS for p in told):
        return 0
    if told[-1] == "header" and len(told) > 1 and told[-2] in OWN:
        return 0
    return STRONG if told[-1] in PARTS else WEAK


def place_of(name: str, attributes: dict[str, str], lenient: frozenset[str] = frozenset()) -> int:
    """What an element announces: 1 an article, 0 nothing, WEAK, STRONG or OUT."""
    if "hidden" in attributes or attributes.get("aria-hidden", "").strip().lower() == "true" or NONE_SHOWN.search(attributes.get("style", "")):
        return OUT
    role = attributes.get("role", "").strip().lower()
    if (role in ROLES and not (lenient and role == "form")) or (name in BOILERPLATE and not (lenient and name == "form")):
        return OUT
    if name == "body" or not attributes:
        return int(name in ARTICLE)
    tokens = f"{attributes.get('class', '')} {attributes.get('id', '')}".split()
    if name in ARTICLE:  # its names speak of the whole page, but that a comment is one
        return STRONG if any(t.lower().split("-")[0] in COMMENTS and not ABOUT.search(t) for t in tokens) else 1
    if len(tokens) > 1:  # beside another name, "sidebar-right" says where the sidebar stands that the content has
        tokens = [t for t in tokens if not (SIDES & {*(w := [p.lower() for p in PIECES.findall(t)])} and "sidebar" in w)]
    return min((named(t, lenient) for t in tokens), default=0)


class Scanner:
    """Reads tags from left to right; remembers what no longer occurs."""

    def __init__(self, html: str):
        self.html, self.gone = html, set()

    def find(self, what: str, at: int) -> int:
        if what in self.gone:
            return -1
        found = self.html.find(what, at)
        if found < 0:
            self.gone.add(what)
        return found

    def after_raw(self, name: str, at: int) -> int:
        """The end of the closing tag of an element whose content is no markup, or of the page."""
        m = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(self.html, at)
        end = self.find(">", m.end()) if m else -1
        return end + 1 if end >= 0 else len(self.html)

    def tag(self, at: int) -> tuple[str, dict[str, str], int]:
        """(name, attributes, position after the tag) of the tag whose name begins at ``at``; the position is beyond the page where the tag never ends."""
        html, end = self.html, len(self.html)
        m = NAME.match(html, at)
        name, at, attributes = m[0].lower(), m.end(), {}
        while True:
            at = BETWEEN.match(html, at).end()
            if at >= end:
                return name, attributes, end + 1
            if html[at] == ">":
                if html[at - 1] == "/":
                    attributes["/"] = ""
                return name, attributes, at + 1
            m = ATTRIBUTE.match(html, at)
            key, at, value = m[0].lower(), m.end(), ""
            if m := EQUALS.match(html, at):
                at = m.end()
                quote = html[at : at + 1]
                close = self.find(quote, at + 1) if quote in ('"', "'") else -1
                if close >= 0:
                    value, at = html[at + 1 : close], close + 1
                else:
                    m = BARE.match(html, at)
                    value, at = m[0].strip("\"'"), m.end()
            if len(attributes) < 64:
                attributes.setdefault(key, unescape(value) if "&" in value else value)


def blocks(html: str, lenient: frozenset[str] = frozenset()) -> list[tuple[str, int, float, int]]:
    """(text, words, link density, place) of each flat block, in page order."""
    found: list[tuple[str, int, float, int]] = []
    parts: list[str] = []
    linked: list[str] = []
    stack: list[tuple[str, int]] = []
    opened: Counter[str] = Counter()
    scanner, link, at, end = Scanner(html), False, 0, len(html)

    def flush() -> None:
        text = SPACE.sub(" ", "".join(parts)).strip()
        if text:
            words = len(text.split(" "))
            found.append((text, words, min(1.0, len(" ".join(linked).split()) / words), max(STRONG, stack[-1][1]) if stack else 0))
        parts.clear()
        linked.clear()

    def put(run: str) -> None:
        run = unescape(run) if "&" in run else run
        parts.append(run)
        if link:
            linked.append(run)

    def pop() -> str:
        name = stack.pop()[0]
        opened[name] -= 1
        return name

    def push(name: str, place: int) -> None:
        stack.append((name, place))
        opened[name] += 1

    while at < end:
        lt = scanner.find("<", at)
        if lt < 0:
            put(html[at:])
            break
        if lt > at:
            put(html[at:lt])
        mark = html[lt + 1 : lt + 2]
        if mark in ("!", "?"):
            comment = html.startswith("<!--", lt)
            close = scanner.find("-->" if comment else ">", lt + 2)
            at = end if close < 0 else close + (3 if comment else 1)
            continue
        closing = mark == "/"
        begin = lt + 1 + closing
        if not (html[begin : begin + 1].isascii() and html[begin : begin + 1].isalpha()):
            if closing:
                close = scanner.find(">", begin)
                at = end if close < 0 else close + 1
            else:
                put("<")
                at = lt + 1
            continue
        name, attributes, at = scanner.tag(begin)
        if at > end:
            break  # a tag that never ends holds no text
        if name in RAW:
            if not closing:
                at = scanner.after_raw(name, at)
            if name not in ("script", "style"):
                flush()
            continue
        if name == "a":
            link = not closing
        if name in INLINE:
            if name == "br":
                put(" ")
            elif name in VOID:
                continue
            elif closing:
                if opened[name] and stack[-1][0] in INLINE:
                    flush()
                    while stack and stack[-1][0] in INLINE and pop() != name:
                        pass
            elif (place := place_of(name, attributes, lenient) if attributes else 0) < 0 or opened[name]:
                # A marked inline element, or one inside of it by the same name: its end must not be taken for the outer one's.
                above = stack[-1][1] if stack else 0
                if place < 0:
                    flush()
                push(name, min(place, above) if place < 0 else above)
            continue
        flush()
        if closing:
            if opened[name]:
                while pop() != name:
                    pass
                link = link and name not in CONTAINERS
            continue
        if name in VOID:
            continue
        while stack and (stack[-1][0] == "p" or stack[-1][0] in INLINE and opened["p"]):
            pop()
        ends = ITEMS.get(name)
        if ends and stack and stack[-1][0] in ends:
            while stack and stack[-1][0] in ends:
                pop()
        place = place_of(name, attributes, lenient)
        if (name in CONTAINERS or place < 0) and not ("/" in attributes and name in UNSEEN):
            above = stack[-1][1] if stack else 0
            if above == OUT:
                inside = OUT
            elif above == STRONG:  # an article inside of what is only named so is judged by its words and links
                inside = 0 if place == 1 else min(place, STRONG)
            elif above == WEAK:
                inside = place if place == 1 or place < WEAK else WEAK
            elif above == 1:  # a heading group inside an article belongs to it
                inside = 1 if place >= 0 or name == "header" and min(map(named, attributes.get("class", "").split()), default=0) >= 0 else place
            else:
                inside = place
            push(name, inside)
    flush()
    return found


def _judged(got: list[tuple[str, int, float, int]], tree: tuple) -> list[tuple[str, int, float, int]]:
    """The blocks that the tree keeps."""
    if not got:
        return []
    words, links, place = (np.asarray([b[i] for b in got], float) for i in (1, 2, 3))
    before, after = (lambda x: np.concatenate([[0.0], x[:-1]])), (lambda x: np.concatenate([x[1:], [0.0]]))
    keep = judge(tree, np.column_stack([words, links, before(words), before(links), after(words), after(links), place]))
    return [b for b, ok in zip(got, keep) if ok]


def main_text(html: str | None, tree: tuple) -> str:
    """The kept blocks of a page, one a line."""
    got = blocks(html) if html else []
    kept = _judged(got, tree)
    words = sum(b[1] for b in kept)
    if words < FEW and not any(b[3] == 1 for b in kept) and any(b[3] < WEAK for b in got):
        unmarked = sum(b[1] for b in got if b[3] >= 0 and b[2] < 0.5)
        again = blocks(html, LAYOUT if unmarked else BOXES)
        more = _judged(again, tree)
        if sum(b[1] for b in more) > TIMES * max(words, unmarked):
            got, kept = again, more
    if not kept:
        kept = [b for b in got if b[3] >= 0 and b[2] < 0.5]
    return "\n".join(b[0] for b in kept)


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, text, n_chars of every page. Narrow: no shuffle, memory is one Arrow batch."""
    tree = trained_tree()

    def work(htmls: list) -> dict:
        texts = [main_text(h, tree) for h in htmls]
        return {"text": texts, "n_chars": [len(t) for t in texts]}

    return computed(pages, html_col, (id_col, url_col), {"text": "string", "n_chars": "bigint"}, lambda: work)
