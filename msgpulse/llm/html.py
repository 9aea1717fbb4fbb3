"""Main text of raw web pages.

Method: the standard library's streaming parser gives events; text is gathered in lines, one for
each block element. A line's text-to-tag ratio is its characters over the tags met since the line
before. The ratios are smoothed with a Gaussian along the page and split in two clusters by a
threshold; a region of the page (an article, or else the lines that share a container) is content
when its best line is in the upper cluster. Elements that name themselves as something else (menus,
adverts, comments and the like) and forms to fill in give no lines, whatever their ratio, unless they hold the article or
most of the page's text. Inside a content region every line stays.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element and attribute names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINERS = frozenset("article body div main section td".split())
OUTSIDE = frozenset(
    "aside audio button canvas datalist dialog footer head iframe input label menu nav noscript object script select style "
    "svg template textarea title video".split()
)
OUTSIDE_NAMES = frozenset(
    "ad ads adsense advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus "
    "footer gdpr login masthead menu modal nav navbar navigation newsletter notice pagination popup promo related respond search "
    "share sharing sidebar signup site-header skip social sponsor sponsored subscribe toolbar widget".split()
)
#: Names that as the last part of a longer word say as much ("cookie-banner") and those that do not ("elementor-widget").
_VAGUE = frozenset("ad ads comment related respond search share skip social widget".split())
#: First parts that say what an element goes with, or is filed under, and not what it is.
_ABOUT = frozenset("category has hide is no page show tag with without".split())
#: Elements whose ids are anchors of headings and passages; in articles and the page's own element names say nothing.
_ANCHORS = frozenset("h1 h2 h3 h4 h5 h6".split())
_UNNAMED = frozenset("article body html main".split())
#: Characters up to which a form with controls is one to fill in.
_FORM_CHARS = 250
OUTSIDE_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog menu menubar navigation search".split())
#: A start tag closes an open element of its group.
_CLOSES = {"p": "p", "li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}
_CLOSES = {tag: frozenset(names.split()) for tag, names in _CLOSES.items()}
_NAME = re.compile(r"[^a-z0-9]+")
_SPACE = re.compile(r"\s+")


class Lines(HTMLParser):
    """Lines of a page as (text, tags since the last line, region), after ``close``.

    Whether an element that has a name, or a form, is outside is known only at the end of the page; until then
    every text carries the numbers of those it stands in.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int]] = []
        self.articles: set[int] = set()
        self._raw: list[tuple[list[tuple[str, tuple[int, ...]]], int, int]] = []
        self._stack: list[tuple[str, bool, int, tuple[int, ...], int]] = []  # (tag, outside, region, doubtful, articles)
        self._text: list[tuple[str, tuple[int, ...]]] = []
        self._tags = self._regions = 0
        self._forms: list[bool] = []  # of every doubtful element: whether it is a form without a name
        self._around: list[int] = []  # articles around it
        self._holds: set[int] = set()  # those with an article inside
        self._controls: set[int] = set()
        self._own_articles = 0  # articles in no named element

    def parse_marked_section(self, i, report=1):
        return self.parse_bogus_comment(i)

    def handle_starttag(self, tag, attrs):
        self._tags += 1
        if tag == "br":
            self._text.append((" ", ()))
            return
        doubtful, articles = self._stack[-1][3:] if self._stack else ((), 0)
        if tag in ("button", "select", "textarea") or (tag == "input" and ("type", "hidden") not in attrs):
            self._controls.update(doubtful)
        if tag in BLOCKS:
            self._end_line()
        if tag in VOID:
            return
        if tag in _CLOSES:
            self._close(_CLOSES[tag])
        outside, region, doubtful, articles = self._stack[-1][1:] if self._stack else (False, 0, (), 0)
        in_article = region in self.articles
        outside = outside or tag in OUTSIDE or (tag == "header" and not in_article) or bool(attrs and self._hidden(tag, attrs))
        named = bool(attrs) and self._named(tag, attrs)
        if (named or tag == "form") and not outside:
            doubtful = (*doubtful, len(self._forms))
            self._forms.append(not named)
            self._around.append(articles)
        if tag in ("article", "main") and not outside:
            self._holds.update(doubtful)
            if all(self._forms[k] for k in doubtful):
                self._own_articles += 1
                articles += 1
        if tag in CONTAINERS and not in_article:
            self._regions += 1
            region = self._regions
            if tag in ("article", "main"):
                self.articles.add(region)
        self._stack.append((tag, outside, region, doubtful, articles))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self._tags += 1
        if tag in BLOCKS:
            self._end_line()
        for at in range(len(self._stack) - 1, -1, -1):
            if self._stack[at][0] == tag:
                del self._stack[at:]
                return
            if self._stack[at][0] in ("article", "main", "body", "table") and tag not in ("article", "main", "body", "html", "table"):
                return

    def handle_data(self, data):
        if not (self._stack and self._stack[-1][1]):
            self._text.append((data, self._stack[-1][3] if self._stack else ()))

    def close(self):
        super().close()
        self._end_line()
        gone, tags = self._outside(), 0
        for texts, before, region in self._raw:
            tags += before
            text = "".join(text for text, doubtful in texts if gone.isdisjoint(doubtful)) if gone else "".join(text for text, _ in texts)
            text = _SPACE.sub(" ", text).strip()
            if text:
                self.lines.append((text, tags, region))
                tags = 0

    def _outside(self) -> set[int]:
        """The doubtful elements that are outside: none that holds the article, or most of the text where no article is beside it."""
        if not self._forms:
            return set()
        sizes, whole = [0] * len(self._forms), 0
        for texts, _, _ in self._raw:
            for text, doubtful in texts:
                size = len(_SPACE.sub(" ", text).strip())
                whole += size
                for k in doubtful:
                    sizes[k] += size
        gone = set()
        for k, form in enumerate(self._forms):
            beside = not form and self._own_articles > self._around[k]
            kept = not beside and (k in self._holds or 2 * sizes[k] > whole)
            if not kept and (not form or (k in self._controls and sizes[k] <= _FORM_CHARS)):
                gone.add(k)
        return gone

    def _close(self, names: frozenset[str]):
        for at in range(len(self._stack) - 1, -1, -1):
            name = self._stack[at][0]
            if name in names:
                del self._stack[at:]
                return
            if name in CONTAINERS or name in ("ul", "ol", "dl", "table", "blockquote"):
                return

    @staticmethod
    def _hidden(tag: str, attrs: list[tuple[str, str | None]]) -> bool:
        return tag not in ("html", "body") and any(
            key == "hidden"
            or (key == "style" and "display:none" in (value or "").replace(" ", "").lower())
            or (key == "aria-hidden" and value == "true")
            for key, value in attrs
        )

    @staticmethod
    def _named(tag: str, attrs: list[tuple[str, str | None]]) -> bool:
        if tag in _UNNAMED or tag in _ANCHORS:
            return False
        for key, value in attrs:
            if key in ("class", "id") and value:
                for word in value.lower().split():
                    if word in OUTSIDE_NAMES:
                        return True
                    parts = _NAME.split(word)
                    first, last = parts[0], parts[-1]
                    if last in OUTSIDE_NAMES and last not in _VAGUE and first not in _ABOUT:
                        return True
            elif key == "role" and value and value.lower() in OUTSIDE_ROLES:
                return True
        return False

    def _end_line(self):
        if self._text:
            self._raw.append((self._text, self._tags, self._stack[-1][2] if self._stack else 0))
            self._text = []
            self._tags = 0


def smoothed(ratios: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian smoothing that takes the ends as they are."""
    reach = max(1, int(3 * sigma))
    weights = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(ratios, weights, "same") / np.convolve(np.ones(len(ratios)), weights, "same") if len(ratios) > 2 * reach else ratios


def threshold(ratios: np.ndarray) -> float:
    """Border of two clusters, from the middle of the range by two-means steps."""
    border = (ratios.min() + ratios.max()) / 2
    for _ in range(20):
        low, high = ratios[ratios < border], ratios[ratios >= border]
        moved = (low.mean() + high.mean()) / 2 if len(low) and len(high) else border
        if moved == border:
            break
        border = moved
    return border


def main_text(html: str | None, sigma: float = 1.0) -> str:
    """Content lines joined by line feeds; an empty string if there are none."""
    if not html:
        return ""
    page = Lines()
    # A comment that never ends takes the rest of the page.
    page.feed(html + "-->" if html.rfind("<!--") > html.rfind("-->") else html)
    page.close()
    lines = [line for line in page.lines if line[2] in page.articles] or page.lines
    if not lines:
        return ""
    ratios = smoothed(np.array([len(text) / max(1, tags) for text, tags, _ in lines]), sigma)
    border = threshold(ratios)
    content = {region for (_, _, region), ratio in zip(lines, ratios) if ratio >= border}
    return "\n".join(text for text, _, region in lines if region in content)


def extracted(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` of every page.

    A missing or empty page has an empty text; missing ids and addresses stay missing; repeated rows
    give repeated results; further columns are left out; an empty table gives no rows. Broken markup
    is read as far as the parser goes.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                texts = [main_text(page.as_py()) for page in part.column(2)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())],
                    names=["page_id", "url", "text", "n_chars"],
                )

    rows = pages.select(
        F.col(id_column).cast("bigint").alias("page_id"), F.col(url_column).cast("string").alias("url"), F.col(html_column).alias("html")
    )
    return rows.mapInArrow(read, "page_id BIGINT, url STRING, text STRING, n_chars BIGINT")
