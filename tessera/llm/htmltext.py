"""Main text of web pages: text-to-tag ratios over a streaming parser's events.

The standard library's parser gives events; block-level tags part them into lines. A line
knows its text, how many tags it took, how much of its text is link text, and the element
that holds it. Lines inside elements that never hold article text (scripts, styles,
navigation, headers and footers of the page, asides, forms, and elements whose class, id or
role names a menu, advert, notice, comment section and the like) count as lines without
text. A form, or a name other than one of reader comments, is believed only where the density
agrees: not of an element that has most of the page's link-free text in several long lines,
as with pages inside one form, and no marked article beside it. Names of single paragraphs and
cells that could be an article's own (warning, legal) are not believed. The text-to-tag ratios, smoothed by a Gaussian, are split into two clusters at the
threshold between them; the runs of lines above it are the content regions. All of them are
main text, and so are all other lines that are not excluded in the elements around them:
the marked articles where these hold at least half of the regions' text, or else the
innermost container of all regions. So short paragraphs and headings stay. Of these lines,
those that are links and nothing else go where several links make a line, or several such
lines follow each other; so does a copyright line at either end. Comments and notices that
neither a tag nor a name tells apart from the article's paragraphs stay.

Cases: a null or empty page has an empty text; unclosed and stray tags are taken as
browsers do for paragraphs, list items and table cells; a page without any block is one
line; whole pages are read, whatever their length and however deep their elements, in time
that grows with the length, and nothing is cut; what opens a tag or comment that never ends
is text; an empty table gives no rows; repeated rows give
repeated results; other columns pass through, new ones replace those of their names.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tessera.plans.runtime import ship

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their text is never shown, or never prose.
HIDDEN = frozenset("script style noscript template head title svg math iframe object canvas select textarea button datalist audio video map".split())
#: Elements that hold the page's furniture.
FURNITURE = frozenset("nav footer aside menu dialog".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Opening one of these ends an open one of the named, up to the nearest element given last.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select", "datalist"}),
}
ENDS_PARAGRAPH = BLOCK - {"html", "body", "td", "th", "tr", "caption", "tbody", "thead", "tfoot", "summary"}
#: Words of a class, id or role that name furniture.
NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|nav\w*|menus?|breadcrumbs?|side-?bar\w*|foot(?:er|ers|nav)?|masthead|"
    r"site-?header|page-?header|cookies?|consent|gdpr|notices?|alerts?|popups?|modal|overlay|newsletter|subscri\w+|signup|sign-up|login|search\w*|"
    r"warning|disclaimer|legal|copyright|comments?|comment-?list|commentlist|responses?|replies|reply|disqus|discussion|share\w*|sharing|social\w*|related\w*|recommend\w*|pagination|pager|toolbar|widgets?|"
    r"tags?|tag-?list|skip-?link|toc|complementary|navigation|contentinfo|form|dialog)(?:$|[\s_-])",
    re.I,
)
#: These name furniture only outside an article, which may have a header of its own.
OUTER_NAMES = re.compile(r"(?:^|[\s_-])(?:header|top-?bar|logo|brand|bottom|languages?|account|cart)(?:$|[\s_-])", re.I)
ARTICLE = re.compile(r"(?:^|[\s_-])(?:article|articlebody|article-?body|post-?(?:content|body)|entry-?content|story|main|main-?content)(?:$|[\s_-])", re.I)
#: A class that begins so tells of something elsewhere on the page (has-sidebar, no-ads), or
#: files the article under any word (tag-politics, category-legal), except for lists of those.
ABOUT = ("has-", "with-", "without-", "no-", "is-", "js-", "show-", "hide-", "tag-", "category-", "cat-", "type-", "status-", "format-", "author-")
LISTS = frozenset("tag-list tag-links tag-cloud category-list category-links author-box author-bio".split())
#: Of a single paragraph or cell these may be the article's own.
SOFT = re.compile(r"(?:^|[\s_-])(?:warning|disclaimer|legal|notices?|alerts?|promo\w*|form|dialog|overlay|toc|related\w*|tags?)(?:$|[\s_-])", re.I)
SINGLE = frozenset("p span b i em strong li h1 h2 h3 h4 h5 h6 blockquote pre code td th tr dt dd figure figcaption caption".split())
#: Names of reader comments are believed at any density.
COMMENTS = re.compile(r"(?:^|[\s_-])(?:comments?|comment-?list|commentlist|responses?|replies|reply|disqus|discussion)(?:$|[\s_-])", re.I)
FORMS = frozenset("form fieldset".split())
#: An element of this share of the link-free text, in so many lines of so many characters, is
#: not furniture, whatever its tag or name.
MOST, LONG_LINES, LONG_CHARS = 0.6, 3, 60
#: Links in a line, and lines of one link each, from which they are a menu; and such lines' length.
MENU_LINKS, MENU_LINES, MENU_CHARS = 2, 3, 60
COPYRIGHT = re.compile(r"^\W*(?:©|\(c\)|copyright\b)[^\n]{0,200}$", re.I)
#: What can stand around a whole article; a cell only around blocks of its own.
CONTAINERS = frozenset("#page html body main article section div center td th".split())
SPACE = re.compile(r"\s+")


@dataclass
class Element:
    """``prose_root`` is the outermost element marked as an article that it is in or is,
    ``article`` the outermost <article>, ``in_main`` tells of an <article> or <main>.
    ``doubtful`` elements are furniture if their density agrees, ``tagged`` ones are <article>,
    <main> or of that role."""

    tag: str
    parent: Element | None
    excluded: bool
    hidden: bool
    prose: bool = False
    depth: int = 0
    prose_root: Element | None = None
    article: Element | None = None
    in_main: bool = False
    doubtful: bool = False
    tagged: bool = False


@dataclass
class Line:
    holder: Element
    parts: list[str] = field(default_factory=list)
    tags: int = 0
    link_chars: int = 0
    links: int = 0

    def text(self) -> str:
        return SPACE.sub(" ", "".join(self.parts)).strip()


class Lines(HTMLParser):
    """A page as lines, in page order."""

    def __init__(self, by_name: bool = True):
        super().__init__(convert_charrefs=True)
        self.by_name = by_name
        self.root = Element("#page", None, False, False)
        self.open, self.links = [self.root], 0
        self.elements = [self.root]  # parents before children
        self.places: dict[str, list[int]] = {}  # of a tag, its open elements' places
        self.lines: list[Line] = []
        self.line = Line(self.root)

    def _break(self) -> None:
        if self.line.parts or self.line.tags:
            self.lines.append(self.line)
        self.line = Line(self.open[-1])

    def _close_to(self, at: int) -> None:
        blocky = any(e.tag in BLOCK or e.hidden for e in self.open[at:])
        self.links -= sum(e.tag == "a" for e in self.open[at:])
        for e in self.open[at:]:
            self.places[e.tag].pop()
        del self.open[at:]
        if blocky:
            self._break()

    def _end_open(self, tags: set[str], stop: set[str]) -> None:
        """Close the open elements of these tags that stand above the last of those."""
        last = max((p[-1] for t in stop if (p := self.places.get(t))), default=0)
        found = [p[n] for t in tags if (p := self.places.get(t)) and (n := bisect_right(p, last)) < len(p)]
        if found:
            self._close_to(min(found))

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.line.tags += 1
        if tag == "br":
            self.line.parts.append(" ")
        if tag in VOID:
            if tag == "hr":
                self._break()
            return
        if tag in ENDS_PARAGRAPH:
            self._end_open({"p"}, {"td", "th", "button", "table", "article", "section", "div", "main", "blockquote", "body"} if tag == "p" else {"td", "th", "button"})
        if tag in ENDS:
            self._end_open(*ENDS[tag])
        up = self.open[-1]
        a = {k: v or "" for k, v in attrs}
        names = " ".join(x for x in f"{a.get('class', '')} {a.get('id', '')}".split() if not x.lower().startswith(ABOUT) or x.lower() in LISTS)
        prose = tag in ("article", "main") or a.get("role") == "main" or a.get("itemprop") == "articleBody" or bool(ARTICLE.search(names))
        furniture = tag in FURNITURE or tag == "header" and not up.in_main or "hidden" in a or a.get("aria-hidden") == "true"
        told = SOFT.sub(" ", SOFT.sub(" ", names)) if tag in SINGLE else names
        named = tag not in ("html", "body", "article", "main") and not (prose and tag != "div") and bool(NAMES.search(told) or NAMES.search(a.get("role", "")))
        named |= tag not in ("html", "body") and bool(OUTER_NAMES.search(names)) and up.prose_root is None
        named &= self.by_name
        hidden = up.hidden or tag in HIDDEN
        comments = named and bool(COMMENTS.search(names) or COMMENTS.search(a.get("role", "")))
        e = Element(tag, up, up.excluded or hidden or furniture or comments, hidden, prose, up.depth + 1)
        e.doubtful = tag in FORMS or named and not comments
        e.tagged = tag in ("article", "main") or a.get("role") == "main"
        e.prose_root = up.prose_root or (e if prose else None)
        e.article = up.article or (e if tag == "article" else None)
        e.in_main = up.in_main or tag in ("article", "main")
        self.places.setdefault(tag, []).append(len(self.open))
        self.open.append(e)
        self.elements.append(e)
        if tag in BLOCK or hidden:
            self._break()
            self.line.tags += 1
        self.links += tag == "a"
        self.line.links += tag == "a"

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in BLOCK and tag not in self.CDATA_CONTENT_ELEMENTS:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.line.tags += 1
        if p := self.places.get(tag):
            self._close_to(p[-1])

    def handle_data(self, data: str) -> None:
        if not self.open[-1].hidden:
            self.line.parts.append(data)
            if self.links:
                self.line.link_chars += len(data)

    def finish(self) -> list[Line]:
        self.close()
        self._break()
        return self.lines


def settle(elements: list[Element], lines: list[Line], texts: list[str]) -> None:
    """Exclude the doubtful elements whose density agrees with their tag or name, and all that
    is in them. ``elements`` has parents before children."""
    if not any(e.doubtful for e in elements):
        return
    chars: dict[int, float] = {}
    dense: dict[int, int] = {}
    tagged: dict[int, int] = {}
    for line, t in zip(lines, texts, strict=True):
        if not line.holder.excluded:
            free = max(0, len(t) - line.link_chars)
            chars[id(line.holder)] = chars.get(id(line.holder), 0.0) + free
            dense[id(line.holder)] = dense.get(id(line.holder), 0) + (free >= LONG_CHARS)
    for e in reversed(elements):
        if e.tagged and dense.get(id(e)):
            tagged[id(e)] = 1
        if e.parent is not None:
            for sums in (chars, dense, tagged):
                if id(e) in sums:
                    sums[id(e.parent)] = sums.get(id(e.parent), 0) + sums[id(e)]
    root = id(elements[0])
    for e in elements:
        if e.parent is not None and e.parent.excluded:
            e.excluded = True
        elif e.doubtful and not e.excluded:
            own = chars.get(id(e), 0.0) >= MOST * chars.get(root, 0.0) and dense.get(id(e), 0) >= LONG_LINES
            beside = tagged.get(root, 0) > tagged.get(id(e), 0) and e.prose_root is None
            e.excluded = not own or beside


def without_menus(kept: list[tuple[Line, str]]) -> list[str]:
    """Texts of the lines that are neither menus of links nor a copyright line at an end."""
    pure = [line.links > 0 and line.link_chars >= 0.8 * len(t) for line, t in kept]
    out, n = [], 0
    while n < len(kept):
        z = n
        while z < len(kept) and pure[z] and len(kept[z][1]) <= MENU_CHARS:
            z += 1
        if z - n >= MENU_LINES:
            n = z
            continue
        for k in range(n, max(z, n + 1)):
            if not (pure[k] and kept[k][0].links >= MENU_LINKS):
                out.append(kept[k][1])
        n = max(z, n + 1)
    for end in (-1, 0):
        if len(out) > 1 and COPYRIGHT.match(out[end]):
            del out[end]
    return out


def mended(html: str) -> str:
    """The page with what opens a tag or comment that never ends as text, so that the parser
    doesn't look for the end from each of them."""
    last = html.rfind(">")
    if "<" in html[last + 1 :]:
        html = html[: last + 1] + html[last + 1 :].replace("<", "&lt;")
    last = max(html.rfind("-->"), html.rfind("--!>"))
    if html.find("<!--", last + 1) >= 0:
        html = html[: last + 1] + html[last + 1 :].replace("<!--", "")
    return html.replace("<![", "<!x[")  # marked sections are comments up to the next >


def smooth(ratios: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    """Gaussian smoothing; the kernel is cut at the array's ends and renormalised."""
    reach = max(1, int(np.ceil(3 * sigma)))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    whole = np.convolve(ratios, kernel)[reach : reach + len(ratios)]
    return whole / np.convolve(np.ones(len(ratios)), kernel)[reach : reach + len(ratios)]


def threshold(ratios: np.ndarray) -> float:
    """Between two clusters: means of those above and below, halved, until it stays."""
    t = float(ratios.mean())
    for _ in range(100):
        high, low = ratios[ratios > t], ratios[ratios <= t]
        if not len(high) or not len(low):
            return t
        new = 0.5 * (high.mean() + low.mean())
        if abs(new - t) < 1e-9:
            break
        t = float(new)
    return t


def regions(lines: list[Line], texts: list[str]) -> np.ndarray:
    """Which lines stand in content regions."""
    own = np.array([0.0 if line.holder.excluded else max(0.0, len(t) - 2.0 * line.link_chars) / max(1, line.tags) for line, t in zip(lines, texts, strict=True)])
    if not own.any():
        return np.zeros(len(lines), dtype=bool)
    ratios = smooth(np.log1p(own))
    t = threshold(ratios)
    # A long line between tags alone is smoothed down, and is content all the same.
    return ((ratios > t) | (np.log1p(own) > t) | (ratios.max() - ratios.min() < 1e-9)) & (own > 0)


def _articles(elements: list[Element], lines: list[Line], texts: list[str], content: np.ndarray) -> list[Element]:
    """The elements around the content regions: of marked ones, the outermost (or articles
    in it that have all its regions), where they hold at least half of the regions' text; or
    else the innermost container of all regions."""
    weight: dict[int, float] = {}
    holders: set[int] = set()
    for line, t, c in zip(lines, texts, content, strict=True):
        if c:
            weight[id(line.holder)] = weight.get(id(line.holder), 0.0) + len(t)
            holders.add(id(line.holder))
    if not weight:
        return []
    total = sum(weight.values())
    for e in reversed(elements):  # children before parents
        if id(e) in weight and e.parent is not None:
            weight[id(e.parent)] = weight.get(id(e.parent), 0.0) + weight[id(e)]
    seen = [e for e in elements if id(e) in weight]
    outer = [e for e in seen if e.prose_root is e]
    if sum(weight[id(e)] for e in outer) >= 0.5 * total:
        own: dict[int, list[Element]] = {}
        for e in seen:
            if e.article is e and e.prose_root is not None:
                own.setdefault(id(e.prose_root), []).append(e)
        found = []
        for m in outer:
            parts = own.get(id(m), [])
            found += parts if sum(weight[id(e)] for e in parts) == weight[id(m)] else [m]
        return found
    around = max((e for e in seen if weight[id(e)] == total), key=lambda e: e.depth)
    while around.tag not in CONTAINERS or around.tag in ("td", "th") and id(around) in holders:
        around = around.parent
    return [around]


def main_text(html: str | None) -> str:
    """The page's article, blocks parted by an empty line."""
    if not html:
        return ""
    html = mended(html)
    for by_name in (True, False):  # names that would leave nothing are not believed
        parser = Lines(by_name)
        parser.feed(html)
        lines = parser.finish()
        texts = [line.text() for line in lines]
        settle(parser.elements, lines, texts)
        content = regions(lines, texts)
        kept_in = {id(e) for e in _articles(parser.elements, lines, texts, content)}
        if kept_in:
            break
    else:
        return ""
    for e in parser.elements:  # parents before children
        if e.parent is not None and id(e.parent) in kept_in:
            kept_in.add(id(e))
    kept = [(line, t) for line, t, c in zip(lines, texts, content, strict=True) if t and not line.holder.excluded and (c or id(line.holder) in kept_in)]
    return "\n\n".join(without_menus(kept))


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """In place of the html: ``text`` and ``n_chars``."""
    ship(pages.sparkSession)
    new = [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]
    fields = [f for f in pages.schema.fields if f.name not in (html, "text", "n_chars")]
    names = [f.name for f in fields]

    def run(batches):
        for batch in batches:
            for a in range(0, len(batch), 256):
                part = batch.slice(a, 256)
                texts = [main_text(h.as_py()) for h in part.column(html)]
                cols = [*(part.column(n) for n in names), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, [*names, "text", "n_chars"])

    return pages.mapInArrow(run, T.StructType([*fields, *new]))
