"""Main text of web pages by text-to-tag ratios.

The standard library's parser streams a page's events into lines, one for each block element's
run of text, with the number of tags that each has. A line's ratio is its characters over its
tags. The ratios are smoothed by a Gaussian along the page; a threshold between the two clusters
of smoothed ratios (two means) selects the lines of high ratio. What they select grows to the
element that holds them: the smallest element with all selected lines (of article and main elements
if one has them all; a main whole if it has articles besides). Its lines are kept, so that a short
paragraph of the article stays, except runs of three or more lines of the low cluster that are links only:
a menu without a menu's element, unless a heading stands right before them (a list of sources).

Lines within elements that are not content by their kind (menus, headers and footers of the page,
sidebars, scripts, styles and so on) or whose role says so never count; one of these that is never closed ends where a main or
article begins. Class and id are evidence only, weighed by word: containers (not paragraphs, headings or cells) with a
word that says side, and forms, are set aside together if the method, with them in, places half of the selected characters or less in all of
them; of words that together hold more, those with most say nothing. Words for readers' comments go unless next to nothing
else is left. Doubted containers apart from the only main or article of the page are set aside in any case; within it those
with a line of a high ratio of its own stay, if they have a heading or no word for adverts, other than comments.

An element holds a range of lines, and what is open is counted, so the work is linear in the page
however deep its elements lie.

Defined results: null and empty pages, and pages without a content line, give an empty text;
markup that ends early or is wrongly nested is read as far as it goes; repeated rows count each;
other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import steps

# Element names of HTML by what they do here.
SILENT = {"script", "style", "noscript", "template", "head", "svg", "math", "iframe", "object", "canvas", "datalist", "textarea"}
SIDE = {"nav", "footer", "aside", "button", "menu", "dialog", "audio", "video", "select"}
DOUBTED = {"form", "fieldset"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6", "legend", "summary"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "output", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img", "input"}
#: An open paragraph ends where one of these begins.
ENDS_PARAGRAPH = {"address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"}
SELF_CLOSING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SIDE_WORDS = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "copyright", "disqus", "footer", "gdpr", "hidden", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "pager", "pagination", "popup", "popular", "promo", "promoted", "recommended", "related", "replies", "respond", "share", "sharing", "sidebar", "signup", "skip", "social", "sponsor", "sponsored", "subscribe", "tags", "toolbar", "trending", "widget", "widgets"}
#: Words that begin like these are about readers' comments; after the others a word says what a page has or lacks.
COMMENT_WORDS, HAVING_WORDS = ("comment", "disqus", "replies", "respond"), {"no", "not", "without", "has", "have", "with"}
#: Of the words, those for adverts and the like, which a paragraph alone doesn't outweigh.
ADVERT_WORDS = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "consent", "gdpr", "newsletter", "promo", "promoted", "signup", "sponsor", "sponsored", "subscribe"}
SIDE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar"}
CONTENT = {"article", "main"}
#: Elements that don't end an open head; within the last four of them none does.
OF_HEAD = {"html", "head", "title", "meta", "link", "base", "script", "style", "noscript", "template"}
WITHIN_HEAD = {"script", "style", "noscript", "template"}

#: Text blocks, which a word in their class or id doesn't doubt.
BLOCKS = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "td", "th", "blockquote", "pre", "figure", "figcaption", "caption", "summary", "address"}

#: Standard deviation of the Gaussian, in lines; lines of links only that are a menu.
SIGMA, MENU_LINES = 1.5, 3
#: Selected characters beside readers' comments that are a text of their own, however long the comments are.
LEAST_BESIDE = 120
BLANK = re.compile(r"\s+")


def surely_side(attributes: dict[str, str]) -> bool:
    return "hidden" in attributes or attributes.get("aria-hidden") == "true" or attributes.get("role") in SIDE_ROLES


def side_words(tag: str, attributes: dict[str, str]) -> set[str]:
    """What makes a container doubtful: its kind, or words of its class and id."""
    if tag in DOUBTED:
        return {tag}
    if tag in {"html", "body", "article", "main"} or tag in BLOCKS:
        return set()
    found = set()
    for name in f"{attributes.get('class') or ''} {attributes.get('id') or ''}".split():
        for word in re.split(r"[^a-z0-9]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name).lower()):
            if word in HAVING_WORDS:
                break
            if word.startswith(COMMENT_WORDS):
                found.add(COMMENT_WORDS[0])
            elif word in SIDE_WORDS:
                found.add(word)
    return found


class Lines(HTMLParser):
    """Lines of a page, and its elements as ranges of them."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        # of lines: text, tags within, heading or not, characters in links, innermost content element
        self.found: list[tuple[str, int, bool, int, int]] = []
        # of elements, by number from 1 on: first line, end of lines, last number within, parent
        self.first, self.end, self.last, self.parent = [0], [0], [0], [0]
        self.content: list[int] = []
        self.sides: list[int] = []
        self.closed: set[int] = set()  # sides whose end was there
        self.doubted: dict[int, set[str]] = {}  # by number, what makes it so
        self.open: list[tuple[str, int, bool, bool]] = []  # tag, number, silent, side
        self.at: dict[str, list[int]] = {}  # places of each tag in `open`
        self.blocks: list[int] = []  # places of others than inline elements
        self.walls: list[int] = []  # and than paragraphs
        self.around: list[int] = []  # content elements that are open
        self.silent = self.links = 0
        self.text: list[str] = []
        self.tags = self.linked = 0

    def end_line(self) -> None:
        text = BLANK.sub(" ", "".join(self.text)).strip()
        if text:
            heading = bool(self.blocks) and self.open[self.blocks[-1]][0] in HEADINGS
            self.found.append((text, self.tags, heading, self.linked, self.around[-1] if self.around else 0))
            self.tags = 0
        self.text, self.linked = [], 0

    def close_from(self, at: int) -> None:
        if self.blocks and self.blocks[-1] >= at:
            self.end_line()
        while len(self.open) > at:
            tag, number, silent, _ = self.open.pop()
            self.end[number], self.last[number] = len(self.found), len(self.first) - 1
            self.silent -= silent
            self.links -= tag == "a"
            self.at[tag].pop()
            for places in (self.blocks, self.walls):
                if places and places[-1] == len(self.open):
                    places.pop()
            if self.around and self.around[-1] == number:
                self.around.pop()

    def lowest(self, tags) -> int:
        """The place in `open` of the innermost element of these tags, or -1."""
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=-1)

    def end_head(self) -> None:
        """An open head ends where something of the body begins."""
        at = self.at["head"][0] if self.at.get("head") else -1
        if at >= 0 and self.lowest(WITHIN_HEAD) < at:
            self.close_from(at)

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag not in OF_HEAD:
            self.end_head()
        self.tags += 1
        if tag == "br":
            self.text.append(" ")
        elif tag not in INLINE:
            self.end_line()
        if tag in VOID:
            return
        closing = {"p"} if tag in ENDS_PARAGRAPH else SELF_CLOSING.get(tag, ())
        at = self.lowest(closing)
        if at >= 0 and at >= (self.walls[-1] if self.walls else -1):
            self.close_from(at)
        number = len(self.first)
        self.first.append(len(self.found))
        self.end.append(-1)
        self.last.append(-1)
        self.parent.append(self.open[-1][1] if self.open else 0)
        attributes = {k: v or "" for k, v in attrs}
        # a header within an article is part of it, unlike the page's
        side = tag in SIDE or (tag == "header" and not self.around) or surely_side(attributes)
        if side:
            self.sides.append(number)
        elif words := side_words(tag, attributes):
            self.doubted[number] = words
        if tag in CONTENT:
            self.content.append(number)
            self.around.append(number)
        place = len(self.open)
        self.at.setdefault(tag, []).append(place)
        if tag not in INLINE:
            self.blocks.append(place)
            if tag != "p":
                self.walls.append(place)
        self.links += tag == "a"
        self.silent += tag in SILENT
        self.open.append((tag, number, tag in SILENT, side))

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        at = self.lowest((tag,))
        # a stray end of an inline element doesn't end the block around
        if at >= 0 and (tag not in INLINE or not self.blocks or at > self.blocks[-1]):
            if self.open[at][3]:
                self.closed.add(self.open[at][1])
            self.close_from(at)

    def handle_data(self, data: str) -> None:
        if self.open and self.open[-1][0] == "head" and data.strip():
            self.end_head()
        if not self.silent:
            self.text.append(data)
            if self.links:
                self.linked += len(BLANK.sub("", data))

    def close(self) -> None:
        super().close()
        self.end_line()
        self.close_from(0)
        self.end[0], self.last[0] = len(self.found), len(self.first) - 1

    def beside(self) -> np.ndarray:
        """Which lines are in elements that are side by their kind."""
        marks, content = np.zeros(len(self.found) + 1, int), np.array(self.content, int)
        for number in self.sides:
            end = self.end[number]
            if number not in self.closed:
                k = int(np.searchsorted(content, number))
                if k < len(content) and content[k] <= self.last[number]:
                    end = self.first[content[k]]
            marks[self.first[number]] += 1
            marks[end] -= 1
        return np.cumsum(marks)[: len(self.found)] > 0


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing, weights summing to 1 at the ends too."""
    reach = int(3 * sigma) + 1
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(np.pad(ratios, reach), kernel, "valid") / np.convolve(np.pad(np.ones(len(ratios)), reach), kernel, "valid")


def two_means(values: np.ndarray) -> float:
    """A threshold halfway between the means of two clusters; below all values if they don't differ."""
    low, high = values.min(), values.max()
    if high <= low:
        return low - 1
    for _ in range(32):
        cut = (low + high) / 2
        new = values[values <= cut].mean(), values[values > cut].mean()
        if new == (low, high):
            break
        low, high = new
    return (low + high) / 2


def selected(sizes: np.ndarray, tags: np.ndarray) -> np.ndarray:
    """Which lines have a high smoothed ratio; all if none differs."""
    smooth = smoothed(sizes / np.maximum(tags, 1))
    chosen = smooth > two_means(smooth)
    return chosen if chosen.any() else ~chosen


def menus(flags: np.ndarray, headings: np.ndarray, least: int = MENU_LINES) -> np.ndarray:
    """The flags that are in runs of `least` or more, but for runs right after a heading."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(int)))
    out = np.zeros(len(flags), bool)
    for lo, hi in edges.reshape(-1, 2):
        out[lo:hi] = hi - lo >= least and not (lo and headings[lo - 1])
    return out


def set_aside(page: Lines, first: np.ndarray, end: np.ndarray, sizes: np.ndarray, tags: np.ndarray, headings: np.ndarray) -> np.ndarray:
    """Which lines the doubted elements take away. first and end: of elements, in these lines."""
    n, last = len(sizes), page.last
    ratios = sizes / np.maximum(tags, 1)
    chosen = selected(sizes, tags)
    worth = np.where(chosen, sizes, 0)

    def covered(numbers) -> np.ndarray:
        numbers = np.array(list(numbers), int)
        marks = np.zeros(n + 1, int)
        np.add.at(marks, first[numbers], 1)
        np.add.at(marks, end[numbers], -1)
        return np.cumsum(marks)[:n] > 0

    words: dict[str, list[int]] = {}
    for number, found in page.doubted.items():
        for word in found:
            words.setdefault(word, []).append(number)
    every = covered(page.doubted)
    comments = words.pop(COMMENT_WORDS[0], [])
    if comments:
        out = covered(comments)
        # what is beside them by itself; next to nothing: then the word is about the whole page
        rest = sizes[~every][selected(sizes[~every], tags[~every])].sum() if not every.all() else 0
        if rest < LEAST_BESIDE and 20 * rest < sizes[out].sum():
            words[COMMENT_WORDS[0]], comments = comments, []
    within = worth * ~covered(comments)
    weight = {word: within[covered(numbers)].sum() for word, numbers in words.items()}
    order = sorted(words, key=lambda word: (weight[word], word))
    while order and 2 * within[covered(k for word in order for k in words[word])].sum() > within.sum():
        order.pop()
    aside = {k for word in order for k in words[word]}

    outermost: list[int] = []
    for number in page.content:
        if not outermost or number > last[outermost[-1]]:
            outermost.append(number)
    free = np.concatenate([[0], np.cumsum(~every)])
    clear = [k for k in outermost if free[end[k]] > free[first[k]]]
    if len(clear) == 1:
        lo, hi = first[clear[0]], end[clear[0]]
        titled, high = (np.concatenate([[0], np.cumsum(x)]) for x in (headings, chosen & ~headings & (ratios > two_means(smoothed(ratios)))))
        for k in page.doubted:
            if min(end[k], hi) <= max(first[k], lo):
                aside.add(k)
            elif lo <= first[k] and end[k] <= hi and high[end[k]] > high[first[k]] and (titled[end[k]] > titled[first[k]] or not page.doubted[k] & ADVERT_WORDS):
                aside.discard(k)
    return covered([*aside, *comments])


def main_text(html: str) -> str:
    """The blocks of the content region, joined by line feeds."""
    page = Lines()
    page.feed(html)
    page.close()
    found = page.found
    used = ~page.beside()
    titles = np.array([x[2] for x in found], bool)
    everything = np.array([len(x[0]) for x in found], float), np.array([x[1] for x in found], float)

    def of_lines(use: np.ndarray):
        """Sizes and tags of the lines in use, and the elements' ranges among them."""
        before = np.concatenate([[0], np.cumsum(use)])
        return *(x[use] for x in everything), before[page.first], before[page.end]

    if page.doubted and used.any():
        sizes, tags, first, end = of_lines(used)
        used[np.flatnonzero(used)[set_aside(page, first, end, sizes, tags, titles[used])]] = False
    if not used.any():
        return ""
    sizes, tags, first, end = of_lines(used)
    chosen = selected(sizes, tags)
    lines = [x for x, own in zip(found, used, strict=True) if own]
    at = np.flatnonzero(chosen)
    # elements are numbered as they open, so of those that hold all selected lines the last is the innermost
    enough = np.flatnonzero((first <= at[0]) & (end > at[-1]))
    marked = np.intersect1d(enough, page.content)
    region = int((marked if len(marked) else enough)[-1])
    # articles beside the region in the same main belong to it
    inner = np.array([x[4] for x in lines])
    outside = np.ones(len(lines), bool)
    outside[first[region] : end[region]] = False
    region = next((int(k) for k in marked[::-1] if (outside & (inner != k))[first[k] : end[k]].any()), region)
    if not len(marked):
        # a single block isn't a region: take what is around it
        while region and end[region] - first[region] <= 1 < len(lines):
            region = page.parent[region]
    menu = menus(~chosen & (np.array([x[3] for x in lines]) >= [len(x[0].replace(" ", "")) for x in lines]), titles[used])
    return "\n".join(lines[k][0] for k in range(first[region], end[region]) if not menu[k])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, part in steps(batch.column(2), 1 << 21):
                texts = [main_text(x) for x in part.to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns[:2], pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), F.coalesce(pages["html"].cast("string"), F.lit("")).alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
