"""Main-text extraction from raw HTML by text-to-tag ratios.

The standard library's parser streams events; text between two block-level
tags is one line.  A line's ratio is its text length over its number of tags; ratios are
smoothed with a Gaussian over neighbouring lines, and lines at or above one standard
deviation of the smoothed ratios are content.  The content region is found from the whole page
downwards: as long as one section below holds most of the smoothed ratio (or the heading), and everything beside it has a
text-to-tag ratio of less than half of its own, the search goes on inside that section.  Only where ratios do not tell
(something beside comes near) tags do: a single line beside goes if the section has a heading and the line
has none, and article and main elements count as wholes.  Every line of the region is kept, short ones too, except
what lies in page furniture (navigation, headers, footers, asides, forms, adverts,
notices, comments, by element, role, class or id) and low lines that are nothing
but links, lie in no article or main element and stand before the first or after
the last content line.

A class, id or role only names furniture, as a form does: such a subtree (also an
article that is a reader's comment or lies in one, in an aside or in a footer) is
furniture unless it holds most of the page's content lines, found without the
elements that always are.  Reader comments have no vote unless there is nothing else,
and a subtree is not chosen over content lines of an article (or main element) that it lies outside of.
A page with no line left takes all lines that are furniture by name only.

Each page is handled inside its own row, in time linear in its length; nothing is shuffled.

Defined results: null and empty html give an empty text; a page without content lines keeps
all its lines outside page furniture; broken markup is read as far as browsers would,
never an error; repeated rows give equal rows; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidewatch.session import ship_package

SIGMA = 1.0
RADIUS = 2
_KERNEL = np.exp(-0.5 * (np.arange(-RADIUS, RADIUS + 1) / SIGMA) ** 2)

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset((
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 head header hr html iframe legend li main menu nav noscript ol optgroup option p pre script section "
    "select style summary table tbody td template textarea tfoot th thead title tr ul").split())
SECTION = frozenset("article aside body center details dialog div dl fieldset figure footer form header main nav ol section table td ul".split())
ARTICLE = frozenset(("article", "main"))
HEADINGS = ("h1", "h2")
# Beside the section that holds the text, ratios below this part of its own are low.
LOW = 0.5
# Elements that a start tag closes when their end tags were left out, and the elements it does not look beyond.
_ITEM = SECTION - {"div"} | {"blockquote", "button", "dir", "menu", "object", "select", "template"}
_CELL = frozenset(("table", "template"))
IMPLIED = {
    "li": (("li",), _ITEM), "dt": (("dt", "dd"), _ITEM), "dd": (("dt", "dd"), _ITEM),
    "option": (("option",), frozenset(("select", "datalist", "optgroup"))), "optgroup": (("option", "optgroup"), frozenset(("select",))),
    "td": (("td", "th"), _CELL | {"tr"}), "th": (("td", "th"), _CELL | {"tr"}), "tr": (("caption", "td", "th", "tr"), _CELL),
} | {t: (("caption", "td", "th", "tr", "tbody", "thead", "tfoot"), _CELL) for t in ("tbody", "thead", "tfoot")}
# Start tags that end a paragraph, and the elements a paragraph outside of which stays open.
_ENDS_P = frozenset((
    "address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li "
    "main menu nav ol p pre section summary table ul").split())
_P_SCOPE = frozenset("button caption object table td template th".split())
# Elements whose text is never article text.  A header counts only outside an article.
FURNITURE = frozenset((
    "aside button dialog footer head iframe input label menu nav noscript object option script select style svg template textarea").split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search status toolbar".split())
# Class and id words (split at spaces, dashes, underscores and case changes) that name furniture.
NAMES = frozenset((
    "ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs byline-share comment comments consent cookie cookies "
    "disclaimer discussion disqus feedback footer form gdpr header login masthead menu menus modal nav navbar navigation newsletter notice notices "
    "notification overlay pager pagination paywall popup promo promoted promotion recommended related reply replies respond responses search share "
    "sharing sidebar signup skip social sponsor sponsored subscribe subscription teaser toolbar topbar widget widgets").split())
# Words that name reader comments; an article so named is one comment.
COMMENTS = frozenset("comment comments discussion disqus replies reply respond response responses".split())
ONE_COMMENT = frozenset(("comment", "reply"))
# A name after one of these says what the element has or lacks, not what it is.
_ABOUT = frozenset(("has", "no", "with", "without"))
_WORDS = re.compile(r"[A-Z]?[a-z0-9]+|[A-Z]+")


class _Section:
    __slots__ = ("tag", "parent", "number", "rank")

    def __init__(self, tag: str, parent: "_Section | None", number: int):
        self.tag, self.parent, self.number = tag, parent, number
        # 2 inside an article, 1 inside main only.
        self.rank = max(parent.rank if parent else 0, 2 if tag == "article" else int(tag in ARTICLE))


class _Furniture:
    """A furniture subtree: ``sure`` if it or one around it always is, else by name only and released when it holds the text."""
    __slots__ = ("parent", "sure", "comments", "rank", "off", "votes", "own", "of_article", "holds_articles")

    def __init__(self, parent: "_Furniture | None", named: bool, comments: bool, rank: int, holds_articles: bool = False):
        self.parent, self.rank, self.holds_articles = parent, rank, holds_articles
        self.sure = not named or bool(parent and parent.sure)
        self.comments = comments or bool(parent and parent.comments)
        self.off = True
        self.votes, self.own = 0, [0, 0, 0]  # content lines inside; those of its own by rank
        self.of_article: "_Furniture | None" = None  # stands for the articles inside


class _Lines(HTMLParser):
    """Collects (text, tags, link characters, furniture, section) per line."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, _Furniture | None, _Section]] = []
        self.headings: set[int] = set()  # numbers of lines that are headings
        self.named: list[_Furniture] = []  # those by name only, outer ones first
        self.text: list[str] = []
        self.tags = self.linked = 0
        self.root = self.section = _Section("", None, 0)
        self.all = [self.root]  # sections, each after the one around it
        # Open elements: (tag, section before it, furniture before it).
        self.open: list[tuple[str, _Section, _Furniture | None]] = []
        # Places of open elements in the stack by tag, and of those that are sections.
        self.places: dict[str, list[int]] = {}
        self.sections: list[int] = []
        self.furniture: _Furniture | None = None
        self.links = 0

    def parse_marked_section(self, i, report=1):  # <![...: a comment, as in browsers
        return self.parse_bogus_comment(i)

    def end_line(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            if any(self.places.get(h) for h in HEADINGS):
                self.headings.add(len(self.lines))
            self.lines.append((text, max(self.tags, 1), self.linked, self.furniture, self.section))
            self.tags = 0
        self.text, self.linked = [], 0

    def handle_starttag(self, tag, attrs):
        if tag in BLOCK:
            self.end_line()
            self._close_implied(tag)
        self.tags += 1
        if tag in VOID:
            if tag == "br":
                self.text.append(" ")
            return
        if tag == "a":
            self.links = 1
        if tag not in BLOCK and tag not in FURNITURE and not attrs:
            return  # plain inline markup needs no place in the stack
        self.places.setdefault(tag, []).append(len(self.open))
        if tag in SECTION:
            self.sections.append(len(self.open))
        self.open.append((tag, self.section, self.furniture))
        if tag in ARTICLE:
            self.furniture = self._around_article()
        how = self._is_furniture(tag, attrs)
        if how:
            self._enter(how != "sure", how == "comments", tag in ("aside", "footer"))
        if tag in SECTION:
            self.section = _Section(tag, self.section, len(self.all))
            self.all.append(self.section)

    def _enter(self, named: bool, comments: bool, holds_articles: bool = False) -> None:
        self.furniture = _Furniture(self.furniture, named, comments, self.section.rank, holds_articles)
        if not self.furniture.sure:
            self.named.append(self.furniture)

    def _around_article(self) -> _Furniture | None:
        """An article in a named section, an aside or a footer is furniture by name only; it never belongs to an unclosed menu before it."""
        at = self.furniture
        if at is None or not at.sure:
            return at
        while at is not None and at.sure and not at.holds_articles:
            at = at.parent
        if at is None or not at.sure:
            return at
        if at.of_article is None:
            before, self.furniture = self.furniture, None
            self._enter(True, at.comments)
            at.of_article, self.furniture = self.furniture, before
        return at.of_article

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in BLOCK:
            self.end_line()
        self.tags += 1
        if tag == "a":
            self.links = 0
        i = self._last(tag)
        # A stray end tag does not close a section.
        if i >= 0 and (tag in SECTION or not self.sections or self.sections[-1] < i):
            self._close(i)

    def _last(self, tag) -> int:
        places = self.places.get(tag)
        return places[-1] if places else -1

    def _close(self, i: int) -> None:
        """Closes the open element at place ``i`` and those inside it."""
        _, self.section, self.furniture = self.open[i]
        while len(self.open) > i:
            tag = self.open.pop()[0]
            self.places[tag].pop()
            if tag in SECTION:
                self.sections.pop()

    def _close_implied(self, tag) -> None:
        if tag in _ENDS_P:
            i = self._last("p")
            if i >= 0 and i > max(map(self._last, _P_SCOPE)):
                self._close(i)
        if tag in IMPLIED:
            closed, beyond = IMPLIED[tag]
            least = max(map(self._last, beyond - set(closed)))
            i = min((x for x in map(self._last, closed) if x > least), default=-1)
            if i >= 0:
                self._close(i)

    def handle_data(self, data):
        self.text.append(data)
        if self.links:
            self.linked += len(data.strip())

    def _is_furniture(self, tag, attrs) -> str:
        """"sure", "named", "comments", or nothing."""
        if tag in FURNITURE:
            return "sure"
        if tag == "header":
            return "" if self.section.rank else "sure"
        if tag in ("html", "body", "main"):
            return ""
        found = "named" if tag == "form" else ""
        for name, value in attrs:
            if name in ("class", "id"):
                for one in (value or "").split():
                    words = [w.lower() for w in _WORDS.findall(one)]
                    words = [w for before, w in zip(["", *words], words) if before not in _ABOUT]
                    if tag == "article":
                        if not ONE_COMMENT.isdisjoint(words):
                            found = "comments"
                    elif not COMMENTS.isdisjoint(words):
                        found = "comments"
                    elif not found and not NAMES.isdisjoint(words):
                        found = "named"
            elif tag == "article":
                continue
            elif name == "role":
                if (value or "").lower() in ROLES:
                    found = found or "named"
            elif name == "hidden" or name == "aria-hidden" and value == "true":
                return "sure"
        return found


def smoothed(ratios: np.ndarray) -> np.ndarray:
    """Gaussian mean over neighbouring lines; the kernel is cut at the page's ends."""
    if len(ratios) == 0:
        return ratios
    full = np.convolve(ratios, _KERNEL)[RADIUS:RADIUS + len(ratios)]
    return full / np.convolve(np.ones(len(ratios)), _KERNEL)[RADIUS:RADIUS + len(ratios)]


def _region(sections: list[_Section], lines: list[tuple], headings: set[int], raw: np.ndarray, ratios: np.ndarray) -> int:
    """Number of the section that holds the text; one pass over the lines, one over the sections."""
    n = len(sections)
    # Of every section with all inside it: smoothed ratio, text, text times ratio, lines, headings; first those of its own lines.
    own = np.zeros((n, 5))
    for i, (text, _, _, furniture, section) in enumerate(lines):
        if not furniture:
            own[section.number] += (ratios[i], len(text), len(text) * raw[i], 1, i in headings)
    whole = own.copy()
    kids: list[list[int]] = [[] for _ in range(n)]
    for s in reversed(sections[1:]):
        whole[s.parent.number] += whole[s.number]
        if whole[s.number][3]:
            kids[s.parent.number].append(s.number)  # later ones first
    at = 0
    while kids[at]:
        best = max((k for k in reversed(kids[at]) if whole[k][3] > 1), key=lambda k: whole[k][0], default=None)
        if best is None or (2 * whole[best][0] <= whole[at][0] and not whole[best][4]):
            break
        mean = whole[best][2] / whole[best][1]
        beside = [(whole[k], k < best) for k in kids[at] if k != best] + ([(own[at], True)] if own[at][3] else [])
        if not all(_low(found, first, mean, whole[best]) for found, first in beside):
            break
        at = best
    return at


def _low(found: np.ndarray, first: bool, mean: float, best: np.ndarray) -> bool:
    """Whether what stands beside the best section is no text of the page."""
    _, text, weighted, n, heads = found
    if first and heads and not best[4]:
        return False  # a title over the text
    if weighted < LOW * mean * text:
        return True
    return n == 1 and not heads and best[4] > 0


def line_ratio(text: str, tags: int) -> float:
    return len(text) / tags


def _ratios(lines: list[tuple], furniture: list[bool]) -> tuple[np.ndarray, np.ndarray, float]:
    """Ratios of the lines, smoothed ratios and their bound."""
    raw = np.array([0.0 if f else line_ratio(text, tags) for (text, tags, *_), f in zip(lines, furniture)])
    ratios = smoothed(raw)
    return raw, ratios, ratios.std() if len(ratios) else 0.0


def _release(lines: list[tuple], named: list[_Furniture]) -> None:
    """Takes ``off`` from the named subtrees that hold most of the page's content lines."""
    sure = [f is not None and f.sure for _, _, _, f, _ in lines]
    _, ratios, bound = _ratios(lines, sure)
    content = [(f, section) for (_, _, _, f, section), s, ratio in zip(lines, sure, ratios) if not s and ratio >= bound]
    content = [x for x in content if not (x[0] and x[0].comments)] or content
    clear = [0, 0, 0]
    for f, section in content:
        (f.own if f else clear)[section.rank] += 1
    for at in reversed(named):
        at.votes += sum(at.own)
        if at.parent:
            at.parent.votes += at.votes
    for at in named:
        if not (at.parent and at.parent.off) and 2 * at.votes > len(content) and not any(clear[at.rank + 1:]):
            at.off = False
            clear = [x + y for x, y in zip(clear, at.own)]
    if not any(not s and not (f and f.off) for (_, _, _, f, _), s in zip(lines, sure)):
        for at in named:
            at.off = False


def extract(html: str | None) -> list[str]:
    """The lines of the main text, in page order."""
    parser = _Lines()
    parser.feed(html or "")
    parser.close()
    parser.end_line()
    if parser.named:
        _release(parser.lines, parser.named)
    lines = [(text, tags, linked, f is not None and f.off, section) for text, tags, linked, f, section in parser.lines]
    raw, ratios, bound = _ratios(lines, [line[3] for line in lines])
    region = parser.all[_region(parser.all, lines, parser.headings, raw, ratios)]
    # The whole article, not one part of it.
    at = region
    while at is not None:
        if at.tag in ARTICLE:
            region = at
        at = at.parent
    inside = np.zeros(len(parser.all), bool)
    for s in parser.all:
        inside[s.number] = s is region or (s.parent is not None and inside[s.parent.number])
    run = [i for i, (line, ratio) in enumerate(zip(lines, ratios)) if not line[3] and ratio >= bound]
    kept = []
    for i, ((text, _, linked, furniture, section), ratio) in enumerate(zip(lines, ratios)):
        outside = not section.rank and not (run and run[0] < i < run[-1])
        if furniture or (outside and ratio < bound and linked >= len(text.replace(" ", "")) > 0):
            continue
        if inside[section.number]:
            kept.append(text)
    return kept


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars."""
    ship_package(pages.sparkSession)
    fields = {f.name: f.dataType.simpleString() for f in pages.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = ["\n".join(extract(h.as_py())) for h in b.column("html")]
            yield pa.RecordBatch.from_arrays(
                [b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {fields['page_id']}, url {fields['url']}, text string, n_chars long")
