"""Main text of web pages from the events of the standard-library parser.

The events are cut into lines at block elements.  A line's text-to-tag ratio is its length
outside links by the tags since the line before; lines in menus, headers, footers, sidebars,
notices, adverts, forms, scripts, styles and reader comments, which their elements, roles or
class names tell, count as 0.  The ratios are smoothed with a Gaussian, and a threshold between
two clusters of them selects the content lines.  The smallest container that holds nearly all of
the content's text is the article; an ``article`` or ``main`` element around it decides where
several would do.  In an ``article`` or ``main`` all lines count but lists of links that no heading
introduces; in another container, runs of lines that are mostly links are left out, unless they
are paragraphs or headings.  A class name alone does not skip a block that holds the article.
"""

from __future__ import annotations

import re
from collections import Counter
from heapq import heappop, heappush
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Elements of HTML and words of class names, ids and roles.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
CONTAINERS = set("html body main article section div td center blockquote figure table tbody tr details".split())
SKIPPED = set("script style noscript template svg math head title nav footer aside form button select option textarea iframe object canvas audio video menu dialog label fieldset".split())
SKIPPED_WORDS = set(
    """ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner sidebar side nav navbar navigation
    menu breadcrumb breadcrumbs footer cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login social
    share sharing related recommended recommendations comment comments respond disqus reply replies widget toolbar pagination pager masthead skip contentinfo complementary search""".split()
)
# words of names that leave open what the part is: a name of these and skipped words is skipped
NEUTRAL_WORDS = set("area bar block blocks bottom box button buttons container content element form global group holder inner item items left link links list main module outer page panel post region right row section site slot top unit user wrap wrapper zone".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
TEXT_BLOCKS = HEADINGS | set("p blockquote figcaption pre dd".split())  # never skipped or left out for a name or for their links
MODIFIERS = set("has with without no not by open closed enabled disabled".split())  # a class name with one tells of another element
IN_HEAD = set("head title base link meta style script noscript template".split())
HEADER_WORDS = {"header", "topbar", "top"}
CLOSED_BY = {  # an open element (left) ends where one of these starts
    "p": BLOCKS - {"option", "optgroup"},
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "tr": {"tr", "tbody", "thead", "tfoot"},
    "td": {"td", "th", "tr"},
    "th": {"td", "th", "tr"},
    "option": {"option", "optgroup"},
}
BARRIERS = CONTAINERS - {"td", "tr", "tbody"} | {"ul", "ol", "dl", "table"}  # left-out end tags are not looked for beyond these
SIGMA, RADIUS = 1.0, 2
FAILED_SCANS = 20  # tags without an end that are looked through to the end of the page
_COMMENT_END = re.compile(r"--\s*>")
_TAG_NAME = re.compile(r"<([a-zA-Z][^\s/>]*)")
MOST_OF_TEXT = 0.85


class _Lines(HTMLParser):
    """Lines with their ratio, container and whether they lie in a skipped element."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.text: list[str] = []
        self.ratio: list[float] = []
        self.box: list[int] = []
        self.skip: list[int] = []
        self.title: list[bool] = []
        self.parent, self.kind = [0], ["#"]  # of containers
        self.links: list[int] = []  # characters of each line in links
        self.form: list[str] = []  # of each line: h in a heading, p in another block of text, li in an item
        self.open: list[tuple[str, int, int]] = []  # (element, skipped, container); skipped: -1, or the innermost region
        self.n_open: Counter[str] = Counter()  # elements in ``open`` by name
        self.marks: list[str] = []  # those of them that may be closed early, or stop the search for such
        self.n_inside = 0  # of them, article and main
        self.region = [0]  # the regions around each region, a block that only its class names skip; 0: none
        self.landmarks: list[tuple[int, bool]] = []  # region of each article, h1 and main, and whether it is a main
        self.buffer: list[str] = []
        self.hidden: list[str] = []  # text of skipped elements
        self.where: tuple[int, int, bool, str] | None = None  # region, container, h1 and form of the text in the buffer
        self.end_left = self.comment_left = 0  # how far from the end the last ``>`` and the last end of a comment lie
        self.failed = 0
        self.tags = 0
        self.linked = 0
        self.heading = False

    def read(self, html: str) -> None:
        """All events of a page.  Linear: what cannot end is not looked for again and again."""
        self.end_left = len(html) - html.rfind(">") if ">" in html else -1
        last = max((m.start() for m in _COMMENT_END.finditer(html)), default=-1)
        self.comment_left = len(html) - last if last >= 0 else -1
        self.feed(html)
        self.close()
        self.open.clear()
        self._flush()

    def _ends(self, i: int, left: int) -> bool:
        return 0 <= left <= len(self.rawdata) - i

    def _unclosed(self, i: int) -> int:
        """Markup that never ends goes, up to the next that begins."""
        k = self.rawdata.find("<", i + 1)
        return k if k >= 0 else len(self.rawdata)

    def parse_starttag(self, i: int) -> int:
        """A tag whose quotes don't close ends at the next ``>``."""
        if not self._ends(i, self.end_left):
            return self._unclosed(i)
        if self.failed < FAILED_SCANS:
            k = super().parse_starttag(i)
            if k >= 0:
                return k
            self.failed += 1
        tag = _TAG_NAME.match(self.rawdata, i).group(1).lower()
        self.handle_starttag(tag, [])
        if tag in self.CDATA_CONTENT_ELEMENTS:
            self.set_cdata_mode(tag)
        return self.rawdata.find(">", i) + 1

    def parse_endtag(self, i: int) -> int:
        return super().parse_endtag(i) if self._ends(i, self.end_left) else self._unclosed(i)

    def parse_comment(self, i: int, report: bool = True) -> int:
        if not self._ends(i + 4, self.comment_left):
            return self._unclosed(i)
        return super().parse_comment(i, report)

    def parse_pi(self, i: int) -> int:
        return super().parse_pi(i) if self._ends(i + 2, self.end_left) else self._unclosed(i)

    def parse_html_declaration(self, i: int) -> int:
        """Declarations and marked sections alike go up to the next ``>``."""
        k = self.rawdata.find(">", i + 2) if self._ends(i + 2, self.end_left) else -1
        return k + 1 if k >= 0 else self._unclosed(i)

    def _flush(self) -> None:
        """End the lines.  In a skipped element only its own ends: it may be part of an open one."""
        if self.buffer and not (self.open and self.open[-1][1] < 0):
            self._line(self.buffer, *(self.where or (0, 0, False, "")))
            self.buffer, self.where = [], None
        if self.hidden:
            self._line(self.hidden, -1, self.open[-1][2] if self.open else 0, False, "")
            self.hidden = []

    def _line(self, buffer: list[str], skipped: int, box: int, title: bool, form: str) -> None:
        line = " ".join("".join(buffer).split())
        if line:
            self.text.append(line)
            linked = min(self.linked, len(line))
            self.ratio.append((len(line) - linked) / max(self.tags, 1) if skipped >= 0 else 0.0)
            self.links.append(linked)
            self.box.append(box)
            self.skip.append(skipped)
            self.title.append(title)
            self.form.append(form)
            self.tags = self.linked = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag not in IN_HEAD:
            self._leave_head()
        if tag in BLOCKS:
            self._flush()
            while inner := self._inner(tag):
                self._close(inner)
            self._flush()
        self.tags += 1
        if tag in VOID:
            if tag in ("br", "hr"):
                self.buffer.append(" ")
            return
        _, skipped, box = self.open[-1] if self.open else ("", 0, 0)
        if skipped >= 0:
            if self._is_skipped(tag, attrs):
                skipped = -1
            elif self._is_named(tag, attrs):
                if tag in BLOCKS:
                    self.region.append(skipped)
                skipped = len(self.region) - 1 if tag in BLOCKS else -1
        if skipped >= 0 and (tag in ("article", "main", "h1") or ("role", "article") in attrs or ("role", "main") in attrs):
            self.landmarks.append((skipped, tag == "main" or ("role", "main") in attrs))
        if tag in CONTAINERS:
            self.parent.append(box)
            self.kind.append("article" if tag == "article" or ("role", "article") in attrs else "main" if tag == "main" or ("role", "main") in attrs else tag)
            box = len(self.kind) - 1
            self.n_inside += self.kind[box] in ("article", "main")
        self.open.append((tag, skipped, box))
        self.n_open[tag] += 1
        if tag in CLOSED_BY or tag in BARRIERS:
            self.marks.append(tag)
        if tag == "h1":
            self.heading = True

    def _inner(self, tag: str) -> str:
        """The innermost open element that ``tag`` could end, not looking past containers."""
        for name in reversed(self.marks):
            if tag in CLOSED_BY.get(name, ()):
                return name
            if name in BARRIERS:
                break
        return ""

    def _is_skipped(self, tag: str, attrs: list) -> bool:
        if tag in SKIPPED:
            return True
        if tag == "header" and not self._inside():
            return True
        if tag in ("html", "body"):
            return False
        for name, value in attrs:
            if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and value and re.search(r"display\s*:\s*none", value):
                return True
        return False

    def _form(self) -> str:
        if any(self.n_open[t] for t in HEADINGS):
            return "h"
        return "p" if any(self.n_open[t] for t in TEXT_BLOCKS) else "li" if self.n_open["li"] else ""

    def _inside(self) -> bool:
        return self.n_inside > 0

    def _is_named(self, tag: str, attrs: list) -> bool:
        """Whether a class name, id or role, but for neutral words, tells of a part to skip."""
        if tag in ("html", "body", "li") or tag in TEXT_BLOCKS:
            return False
        for name, value in attrs:
            if name in ("class", "id", "role") and value:
                for one in value.split():
                    words = set(re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", one).lower()))
                    telling = words - NEUTRAL_WORDS - HEADER_WORDS
                    if words & MODIFIERS or telling - SKIPPED_WORDS:
                        continue
                    if telling or words & HEADER_WORDS and not self._inside():
                        return True
        return False

    def _leave_head(self) -> None:
        """``</head>`` may be left out: what cannot be in a head ends it."""
        if self.open and self.open[-1][0] == "head":
            self._flush()
            self._close("head")

    def _close(self, tag: str) -> None:
        while self.open:
            name, _, box = self.open.pop()
            self.n_open[name] -= 1
            if name in CLOSED_BY or name in BARRIERS:
                self.marks.pop()
            if name in CONTAINERS:
                self.n_inside -= self.kind[box] in ("article", "main")
            if name == "h1":
                self.heading = False
            if name == tag:
                return

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self._flush()
        self.tags += 1
        if self.n_open[tag]:
            self._close(tag)
            if tag in BLOCKS:
                self._flush()

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_data(self, data: str) -> None:
        if data.strip():
            self._leave_head()
        name, skipped, box = self.open[-1] if self.open else ("", 0, 0)
        if skipped >= 0:
            if self.where is None and data.strip():
                self.where = (skipped, box, self.heading, self._form())
            self.buffer.append(data)
            if self.n_open["a"]:
                self.linked += len(" ".join(data.split()))
        elif data.strip() and name not in ("script", "style"):
            self.hidden.append(data)

    def unknown_decl(self, data: str) -> None:
        """Marked sections say nothing about the text."""


def smooth(ratio: np.ndarray) -> np.ndarray:
    """Gaussian smoothing over neighbouring lines."""
    k = np.exp(-0.5 * (np.arange(-RADIUS, RADIUS + 1) / SIGMA) ** 2)
    weight = np.convolve(np.ones(len(ratio)), k)[RADIUS : RADIUS + len(ratio)]
    return np.convolve(ratio, k)[RADIUS : RADIUS + len(ratio)] / weight


def threshold(values: np.ndarray) -> float:
    """The middle between two clusters of the values (2-means on one axis)."""
    low, high = float(values.min()), float(values.max())
    for _ in range(20):
        cut = (low + high) / 2
        a, b = values[values <= cut], values[values > cut]
        if not len(a) or not len(b) or (low, high) == (a.mean(), b.mean()):
            break
        low, high = float(a.mean()), float(b.mean())
    return (low + high) / 2


def released(page: _Lines, content: list[int]) -> np.ndarray:
    """By region, whether its lines count although its class names say skip.

    A region with a ``main`` does.  While no article, h1 or main lies open, so does the heaviest
    region in content text, if it holds one with content or has half of all content's text."""
    n = len(page.region)
    free = np.zeros(n, bool)
    free[0] = True
    if n == 1:
        return free
    weight, marks = np.zeros(n), np.zeros(n, np.int64)
    main = np.zeros(n, bool)
    for k in content:
        weight[page.skip[k]] += 0 if page.title[k] else len(page.text[k])
    for region, is_main in page.landmarks:
        marks[region] += 1
        main[region] |= is_main
    own = marks.copy()
    for k in range(n - 1, 0, -1):
        weight[page.region[k]] += weight[k]
        marks[page.region[k]] += marks[k]
        main[page.region[k]] |= main[k]
    free |= main
    if not own[free].any():
        inner: list[list[int]] = [[] for _ in range(n)]
        for k in range(1, n):
            inner[page.region[k]].append(k)
        fit: list[tuple[float, int]] = []
        fresh = [k for k in range(n) if free[k]]
        while True:
            for k in (c for f in fresh for c in inner[f]):
                if not free[k] and weight[k] > 0 and (marks[k] or 2 * weight[k] >= weight[0]):
                    heappush(fit, (-weight[k], k))
            if not fit:
                break
            fresh = [heappop(fit)[1]]
            free[fresh] = True
            if own[fresh[0]]:
                break
    for k in range(1, n):
        free[k] &= free[page.region[k]]
    return free


def main_text(html: str | None) -> str:
    """The article's blocks, joined by newlines; empty if there are none."""
    if not html:
        return ""
    page = _Lines()
    page.read(html)
    lines = [k for k, s in enumerate(page.skip) if s >= 0]
    if not lines:
        return ""
    if not any(page.ratio[k] for k in lines):  # nothing but links
        page.ratio = [float(len(t)) if s >= 0 else 0.0 for t, s in zip(page.text, page.skip, strict=True)]
    level = smooth(np.log1p(np.asarray(page.ratio)))
    cut = threshold(level)
    selected = (level >= cut) & (level > 0)
    free = released(page, [k for k in lines if selected[k]])
    open_lines = [k for k in lines if free[page.skip[k]]]
    content = [k for k in open_lines if selected[k]]
    if not content:
        return ""
    n = len(page.kind)
    weight, headings = np.zeros(n), np.zeros(n, np.int64)
    for k in content:
        weight[page.box[k]] += len(page.text[k])
    for k in open_lines:
        headings[page.box[k]] += page.title[k]
    children: list[list[int]] = [[] for _ in range(n)]
    for c in range(n - 1, 0, -1):
        weight[page.parent[c]] += weight[c]
        headings[page.parent[c]] += headings[c]
        children[page.parent[c]].append(c)
    box, article, whole = 0, None, None
    while True:
        if page.kind[box] == "article":
            article = box
        elif page.kind[box] == "main":
            whole = box
        best = max(children[box], key=lambda c: weight[c], default=None)
        if best is None or weight[best] < MOST_OF_TEXT * weight[0] or headings[best] < headings[box] and page.kind[best] not in ("article", "main"):
            break
        box = best
    box = article if article is not None else whole if whole is not None else box
    inside = np.zeros(n, bool)
    inside[box] = True
    for c in range(box + 1, n):
        inside[c] |= inside[page.parent[c]]
    own = [k for k in open_lines if inside[page.box[k]]]
    return "\n".join(page.text[k] for k, kept in zip(own, grow(page, own, selected, article is not None or whole is not None), strict=True) if kept)


def grow(page: _Lines, own: list[int], selected: np.ndarray, marked: bool) -> np.ndarray:
    """Which of a container's lines are in a content region.

    Selected lines, paragraphs and headings are, and runs of other lines that are not mostly links.
    In an article or main element (``marked``) only a list can be left out, and not behind a heading."""
    kept = selected[own].copy()
    if not kept.any():
        return kept
    form, length, links = [page.form[k] for k in own], [len(page.text[k]) for k in own], [page.links[k] for k in own]
    a = 0
    while a < len(own):
        if kept[a] or form[a] in ("h", "p") or marked and form[a] != "li":
            kept[a] = True
            a += 1
            continue
        b = a
        while b < len(own) and not kept[b] and (form[b] == "li" if marked else form[b] not in ("h", "p")):
            b += 1
        kept[a:b] = 2 * sum(links[a:b]) <= sum(length[a:b]) or marked and a > 0 and form[a - 1] == "h"
        a = b
    return kept


@F.pandas_udf(T.StringType())
def main_text_udf(html: pd.Series) -> pd.Series:
    return html.map(main_text, na_action=None)


def extract_text(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """Add ``text`` (string, never null) and ``n_chars`` (its code points) to ``pages``.

    A null or empty page, or one without text outside skipped elements, has an empty text.
    ``<br>`` is white space in a block.  A tag, comment or declaration that never ends goes, up to
    the next ``<``; a tag whose quotes don't close ends at the next ``>``.
    All rows come back with their columns; ones named like an added column are replaced."""
    kept = pages.drop(*(c for c in ("text", "n_chars") if c != html_col))
    return kept.withColumn("text", main_text_udf(F.col(html_col))).withColumn("n_chars", F.length("text").cast("long"))
