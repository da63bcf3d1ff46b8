"""Main text of web pages by line-block distribution.

1. Strip markup: comments, scripts, styles, forms and other elements without prose go with their content, and so do
   elements that say they are menus, page headers or footers, sidebars, notices, adverts, sharing bars or reader comments,
   by tag, role or a whole class name or id (``sidebar``, ``left-sidebar``; not ``has-sidebar``). They end at their end
   tag, at that of an element around them, or where HTML implies the end. By role, class or id, none goes that holds the
   article or most of the unlinked text. What stays is cut into lines at block-level tags, one per block.
2. A line weighs its text without the text of links. Lines of an element that the page names its article (``article``,
   ``main``) weigh 1 at least, and no stretch goes over the border of such an element.
3. Weights are summed over windows of ``SPAN`` lines. Text lies between the points where the sum leaves zero and where it
   dives to zero again; it counts if the sum surges beyond ``SURGE`` in between, so headings and short paragraphs next to
   long ones stay. Naming an article moves that bar by the factor ``PRIOR``: down inside of it, up outside. All stretches
   that surge are taken, so an article in several elements is whole and a text beside teaser cards is found; if none
   surges, the heaviest. Lines between are kept whole, in page order.

Character references are decoded, white space inside a block becomes one space, blocks are joined by a line feed. A null or
empty page, or one without text, has the empty text. Pages are handled one by one, so equal pages give equal texts
and nothing is shuffled.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, functions as F

#: Lines in a window, and the characters that a window of a text exceeds.
SPAN, SURGE = 3, 86
#: How much easier a stretch surges in an element named as article than on other pages, and harder beside one.
PRIOR = 1.5
# Element names of HTML, and words sites use for what is not the article.
RAW = "script|style|textarea|title"
SKIPPED = "noscript|template|svg|math|iframe|object|select|button|audio|video|canvas"
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section summary "
    "table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ASIDE = frozenset("nav aside form menu dialog search footer header".split())
SKIPS = frozenset(SKIPPED.split("|"))
LOST = ASIDE | SKIPS
#: Page parts that may also stand inside an article and then belong to it.
FRAME = frozenset(("footer", "header"))
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
_WORDS = (
    "nav|navbar|navigation|menu|breadcrumbs?|side-?bar|masthead|banner|ads?|advert|advertisement|adsense|sponsor|sponsored|"
    "promo|promotion|cookies?|consent|gdpr|notice|alert|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|"
    "comments?|commentlist|replies|reply|respond|disqus|share|sharing|social|related|recommended|widget|pagination|pager|"
    "toolbar|skip-?link|copyright|disclaimer"
)
_FRAMES = "footer|header"
_PLACES = "site|main|top|bottom|left|right|primary|secondary|global|mobile|desktop"
_SHAPES = rf"{_PLACES}|\d+|area|block|box|bar|section|wrapper|wrap|container|inner|outer|list|links?|items?|buttons?|icons?|posts?|form"


def _names(words: str) -> re.Pattern[str]:
    """Class names made of the words, with places before and places or shapes after."""
    return re.compile(rf"(?<!\S)(?:(?:{_PLACES})[_-]+)*(?:{words})(?:[_-]+(?:{words}|{_SHAPES}))*(?!\S)", re.IGNORECASE)


#: Names of parts; of those that are no such part inside an article; of those that may be longer than the article.
NOISE, FRAMED, LONG = _names(_WORDS), _names(_FRAMES), _names("comments?|commentlist|replies|disqus|cookies?|consent|gdpr")
# Where HTML implies end tags: an element, what it ends when it begins, and inside of what the search stops.
CELLS = ("td", "th", "caption", "table")
ENDS_P = BLOCKS - frozenset("body caption dd dt frameset html legend li option tbody td tfoot th thead tr".split())
IMPLIED = (
    {tag: (("p",), CELLS) for tag in ENDS_P}
    | {"li": (("li",), ("ul", "ol", "menu", "dir", *CELLS)), "option": (("option",), ("select",))}
    | {tag: (("dd", "dt"), ("dl", *CELLS)) for tag in ("dd", "dt")}
    | {tag: (("td", "th"), ("tr", "table")) for tag in ("td", "th")}
    | {"tr": (("tr",), ("table",))}
    | {tag: (("tbody", "thead", "tfoot"), ("table",)) for tag in ("tbody", "thead", "tfoot")}
)
#: Elements whose end tags end whatever is open in them.
FAR = frozenset("a article main table caption tbody thead tfoot tr td th html body".split()) | SKIPS
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<(?P<raw>{RAW})(?=[\s/>])[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<[!?][^<>]*>"
    # a quoted value may have > and a < that begins no tag; a tag ends before the next one begins, so this takes linear time
    r"|<(?P<close>/)?(?P<tag>[a-zA-Z][^\s/<>]*)"
    r"(?P<attrs>(?:\"(?:[^\"<]|<(?![a-zA-Z/!]))*\"|'(?:[^'<]|<(?![a-zA-Z/!]))*'|[^<>\"'])*+|[^<>]*)>"
    r"|<[/!?a-zA-Z][^<>]*\Z",
    re.DOTALL | re.IGNORECASE,
)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")


class _Line:
    __slots__ = ("parts", "linked", "region")

    def __init__(self, region: int):
        self.parts: list[str] = []
        self.linked: list[str] = []
        self.region = region


def _plain(parts: list[str]) -> str:
    return " ".join(html.unescape("".join(parts)).split())


def _is_aside(tag: str, attrs: str, inside: bool) -> bool:
    """Whether an element says it is not the article's text."""
    return tag in LOST and not (inside and tag in FRAME) or bool(_says_aside(tag, attrs, inside))


def _says_aside(tag: str, attrs: str, inside: bool) -> str:
    """The attribute by which an element says so, if any: ``long`` for names of parts that may outgrow the article."""
    if not attrs or tag in ("html", "body", "article", "main") and "comment" not in attrs.lower():
        return ""
    for name, *values in ATTRIBUTE.findall(attrs):
        name, value = name.lower(), "".join(values)
        if name in ("class", "id") and (NOISE.search(value) or not inside and FRAMED.search(value)):
            return "long" if LONG.search(value) else name
        if name == "role" and value.lower() in ROLES:
            return name
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return name
        if name == "style" and re.search(r"display\s*:\s*none", value, re.IGNORECASE):
            return name
    return ""


class _Tree:
    """Where elements end and how much unlinked text they hold; tokens are known by number."""

    def __init__(self, page: str, tokens: list[re.Match[str]]):
        n = len(tokens)
        self.ends = [n] * n  # the token at which an element ends
        self.closed = [False] * n  # whether that is its own end tag
        self.text = [0] * (n + 1)  # unlinked text before a token
        self.articles: list[int] = []  # tokens at which articles and the like begin
        open_: list[tuple[int, str]] = []
        at_of: dict[str, list[int]] = {}  # places in ``open_`` by name
        blocks: list[int] = []
        unread = at = 0  # open elements whose text does not count

        def last(names: tuple[str, ...]) -> int:
            return max((at_of[x][-1] for x in names if at_of.get(x)), default=-1)

        def end(place: int, token: int) -> None:
            nonlocal unread
            while len(open_) > place:
                number, name = open_.pop()
                at_of[name].pop()
                if blocks and blocks[-1] == len(open_):
                    blocks.pop()
                unread -= name == "a" or name in SKIPS
                self.ends[number] = token

        for i, m in enumerate(tokens):
            more = 0 if unread or m.start() == at else len("".join(page[at : m.start()].split()))
            self.text[i] = (self.text[i - 1] if i else 0) + more
            at = m.end()
            if (tag := m["tag"]) is None:
                continue
            tag = tag.lower()
            if m["close"]:
                place = last((tag,))
                # text-level end tags do not reach over a block, those of blocks not out of a table's cell
                bound = -1 if tag in FAR else last(CELLS) if tag in BLOCKS else blocks[-1] if blocks else -1
                if place > bound:
                    self.closed[open_[place][0]] = True
                    end(place, i)
                continue
            if tag in IMPLIED:
                ended, bounds = IMPLIED[tag]
                if (place := last(ended)) > last(bounds):
                    end(place, i)
            elif tag == "a" and (place := last(("a",))) >= 0 and (not blocks or place > blocks[-1]):
                end(place, i)
            if tag in ("article", "main") and not _is_aside(tag, m["attrs"], False):
                self.articles.append(i)
            if tag not in VOID and not m["attrs"].endswith("/"):
                at_of.setdefault(tag, []).append(len(open_))
                if tag in BLOCKS:
                    blocks.append(len(open_))
                open_.append((i, tag))
                unread += tag == "a" or tag in SKIPS
        rest = 0 if unread else len("".join(page[at:].split()))
        self.text[n] = (self.text[n - 1] if n else 0) + rest

    def article_in(self, number: int) -> int | None:
        """The first article that begins in an element."""
        place = bisect_right(self.articles, number)
        return self.articles[place] if place < len(self.articles) and self.articles[place] < self.ends[number] else None

    def holds_most(self, number: int, long: bool = False) -> bool:
        """Most of the page's text; of an element that may be long, so much that no text is left."""
        held = self.text[self.ends[number]] - self.text[number]
        return 2 * held > self.text[-1] and not (long and self.text[-1] - held > SURGE)

    def stripped_to(self, number: int, tag: str, attrs: str, depth: int, nested: int) -> int | None:
        """The token where a stripped element ends; None if the element stays."""
        if tag in LOST and not (depth and tag in FRAME):
            if tag in ASIDE and (tag == "form" or not self.closed[number]) and self.holds_most(number):
                return None
            # a menu or header that was never closed ends where the article begins
            return self.ends[number] if (article := self.article_in(number)) is None else article
        said = _says_aside(tag, attrs, nested > 0 or depth > 0 and tag in FRAME)
        if not said or self.holds_most(number, said == "long"):
            return None
        return None if said != "long" and not nested and self.article_in(number) is not None else self.ends[number]


def _lines(page: str) -> list[_Line]:
    """Lines of the page outside of stripped parts; ``region`` numbers the article a line is in, 0 outside."""
    tokens = list(TOKEN.finditer(page))
    tree = _Tree(page, tokens)
    lines = [_Line(0)]
    region = regions = depth = links = 0  # depth: of articles open
    nested = 0  # of these, the ``article`` elements
    resume = at = 0  # token and place in the page where a stripped part has ended
    for i, m in enumerate(tokens):
        if i < resume:
            continue
        if m.start() > at:
            text = page[at : m.start()]
            lines[-1].parts.append(text)
            if links:
                lines[-1].linked.append(text)
        at = m.end()
        if (tag := m["tag"]) is None:
            continue
        tag, attrs = tag.lower(), m["attrs"]
        closing = bool(m["close"])
        if not closing and tag not in VOID and (stop := tree.stripped_to(i, tag, attrs, depth, nested)) is not None:
            if not attrs.endswith("/"):
                own = stop == tree.ends[i] and tree.closed[i]
                resume = stop + own
                at = len(page) if stop == len(tokens) else tokens[stop].end() if own else tokens[stop].start()
            if tag in BLOCKS:
                lines.append(_Line(region))
            continue
        if tag == "a":
            links = 0 if closing else 1
        elif tag == "br":
            lines[-1].parts.append(" ")
        elif tag in BLOCKS:
            if tag in ("article", "main"):
                if closing:
                    depth = max(0, depth - 1)
                else:
                    depth += 1
                    if depth == 1:
                        regions += 1
                region = regions if depth else 0
                if tag == "article":
                    nested = max(0, nested + (-1 if closing else 1))
            links = 0
            lines.append(_Line(region))
    if at < len(page):
        lines[-1].parts.append(page[at:])
    return lines


def main_text(page: str | None) -> str:
    """The article's text, one line per block."""
    lines = [(line, text) for line in _lines(page or "") if (text := _plain(line.parts))]
    weights = []
    for line, text in lines:
        weight = len(text) - len(_plain(line.linked))
        weights.append(max(weight, 1) if line.region else weight)
    regions = {line.region for line, _ in lines} - {0}
    if len(regions) == 1:
        # the one article a page names never loses to text beside it, however long; several may be teasers of others
        lines, weights = zip(*[(x, w) for x, w in zip(lines, weights) if x[0].region])
    named = bool(regions)
    runs: list[tuple[int, int]] = []  # from where the sum leaves zero to the last line before it is zero again
    surging: list[tuple[int, int]] = []
    at = 0
    for region, group in groupby(line.region for line, _ in lines):
        end = at + sum(1 for _ in group)
        bar = SURGE / PRIOR if region else SURGE * PRIOR if named else SURGE
        sums = [sum(weights[i : min(i + SPAN, end)]) for i in range(at, end)]
        for first, last in _stretches(weights[at:end], sums):
            runs.append((at + first, at + last))
            if max(sums[first:last]) > bar:
                surging.append(runs[-1])
        at = end
    # a line in an article counts a surge more, so the heaviest stretch is outside only if it outweighs that
    heaviest = sorted(runs, key=lambda run: -sum(weights[i] + (SURGE if lines[i][0].region else 0) for i in range(*run)))
    return "\n".join(text for start, end in surging or heaviest[:1] for _, text in lines[start:end])


def _stretches(weights: list[int], sums: list[int]) -> Iterator[tuple[int, int]]:
    start = None
    for i, weight in enumerate(weights):
        if start is None and weight:
            start = i
        elif start is not None and not weight and not sums[i]:
            yield start, i
            start = None
    if start is not None:
        yield start, max(i for i, weight in enumerate(weights) if weight) + 1


def extracted(page: Column) -> Column:
    """Main text of an HTML column."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in batches:
            yield pd.Series([main_text(p) for p in pages], dtype=object)

    return run(page)
