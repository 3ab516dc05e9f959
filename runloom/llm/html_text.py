"""Main text of web pages by tag-path ratios."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runloom.llm.common import Rows

TEXTS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string())])

# Elements of the public HTML vocabulary, by what they mean for text.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt"
    " ruby s samp small span strike strong sub sup time tt u var wbr"
    " math mi mn mo ms mtext mrow msup msub msubsup mfrac msqrt mroot mover munder munderover mstyle semantics".split()
)
VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
RAW = frozenset("script style title textarea noscript iframe template svg annotation".split())
# Closed by the start of a sibling of the same kind.
SIBLINGS = {
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "tr": {"tr", "td", "th"},
    "td": {"td", "th"},
    "th": {"td", "th"},
    "option": {"option"},
}
SCOPES = frozenset("ul ol dl table div section article body".split())
# Elements nested deeper take the place of the innermost one, as in browsers.
DEPTH = 512

# Elements, roles and name parts of what surrounds an article.
AROUND = frozenset("nav aside footer button select menu dialog object canvas head".split())
AROUND_ROLES = frozenset(
    "navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar"
    " toolbar".split()
)
AROUND_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising advertorial sponsor sponsored promo"
    " promotion promoted banner sidebar sidenav aside nav navbar navigation menu menubar breadcrumb"
    " breadcrumbs footer cookie cookies consent gdpr notice notices notification alert popup modal"
    " overlay dialog paywall subscribe subscription newsletter signup login share sharing social"
    " related recommended recommendations pagination pager toolbar widget search searchform form"
    " skip masthead topbar disclaimer".split()
)
COMMENT_NAMES = frozenset("comment comments commentlist respond disqus replies reply".split())
HEADER_NAMES = frozenset("header head".split())
MAIN_NAMES = frozenset("article content main post entry story body text".split())
# Their names say what they hold (slugs, anchors), not where they stand.
UNNAMED = frozenset("h1 h2 h3 h4 h5 h6 p li dt dd pre blockquote td th tr figcaption".split())
# Their names say that a paragraph tells about the article.
META_NAMES = frozenset("meta byline author date dateline posted published credit credits tags".split())
# What a name of surroundings, a form or a name of readers' comments leaves of a score.
NAMED = {"": 1.0, "around": 0.5, "form": 0.1, "comments": 0.1}
# An element with this share of the page's text is no surroundings, whatever its name.
MOST = 0.5

# Inside a tag: what neither ends it nor begins a quoted value.
ORDINARY = re.compile(r"""[^<>"']+""")
NAME = re.compile(r"(/?)([a-zA-Z][^\s/<>]*)")
NAMES = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
PARTS = re.compile(r"[a-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？¿¡\"“”«»()]")

SMOOTH = np.array([1.0, 2.0, 4.0, 2.0, 1.0])
# A path is content if its fused ratio reaches this share of the page's mean by characters.
SHARE = 0.2
# Inside the content's element a path is only surroundings below this share.
INSIDE = 0.1
# Items, cells, captions and code are short by nature: what is in them does not have to score.
SHORT = frozenset("li dt dd td th caption figcaption pre blockquote".split())
# Blocks with more link text than this share are lists of links.
LINKS = 0.6


class Block:
    __slots__ = ("element", "path", "text", "linked", "heading")

    def __init__(self, element: int, path: int, text: str, linked: int, heading: bool):
        self.element, self.path, self.text = element, path, text
        self.linked, self.heading = linked, heading


class Page:
    """Blocks of text with their element and root-to-leaf path; linear in the page's length."""

    def __init__(self, source: str):
        self.parents, self.tags, self.named, self.marked = [-1], ["#root"], [""], [False]
        self.paths: dict[tuple[int, str], int] = {}
        self.blocks: list[Block] = []
        # Open elements: tag, element, path, why the element is left out.
        self.stack: list[tuple[str, int, int, str]] = [("#root", 0, -1, "")]
        self.pieces: list[str] = []
        self.links, self.linked = 0, 0
        self._read(source)

    def _read(self, source: str) -> None:
        """Go through the page once, from one ``<`` to the next; nothing is looked at twice."""
        at, end = 0, len(source)
        last = source.rfind(">")
        quotes = {mark: source.rfind(mark) for mark in "\"'"}
        while at < end:
            begin = source.find("<", at)
            comment = source.startswith("<!--", begin)
            if begin < 0 or begin > last and not comment:
                break  # no tag ends any more
            self._text(source[at:begin])
            if comment:
                closing = source.find("-->", begin + 4)
                at = closing + 3 if closing >= 0 else end
                continue
            name = NAME.match(source, begin + 1)
            if name is None:
                if source[begin + 1] in "!?/":
                    at = source.find(">", begin) + 1
                else:
                    self._text("<")
                    at = begin + 1
                continue
            at, closed, quoted = self._end_of_tag(source, name.end(), quotes)
            if not closed and not quoted:
                self._text(source[begin:at])  # a bare < before a letter
                continue
            attributes = source[name.end() : at - closed]
            tag = name[2].lower()
            if name[1]:
                self._close(tag)
            elif tag == "xmp":
                closing = re.compile("</xmp", re.I).search(source, at)
                self._open(tag, attributes)
                self._text(source[at : closing.start() if closing else end], False)
                at = closing.start() if closing else end
            elif tag in RAW:
                if not attributes.endswith("/"):
                    closing = re.compile(f"</{re.escape(tag)}(?=[\\s/>])", re.I).search(source, at)
                    after = source.find(">", closing.end()) if closing else -1
                    at = after + 1 if after >= 0 else end
            else:
                self._open(tag, attributes)
        self._text(source[at:end])
        self._end_block()

    @staticmethod
    def _end_of_tag(source: str, at: int, quotes: dict[str, int]) -> tuple[int, bool, bool]:
        """(where the tag ends, whether by ``>``, whether a quoted value came): else at the next ``<``."""
        end, quoted = len(source), False
        while at < end:
            mark = source[at]
            if mark == ">":
                return at + 1, True, quoted
            if mark == "<":
                return at, False, quoted
            if mark in quotes:
                # Only after = does a quote begin a value; the last quote of the page ends none.
                if quotes[mark] > at and _after_equals(source, at):
                    at, quoted = source.index(mark, at + 1) + 1, True
                else:
                    at += 1
            else:
                at = ORDINARY.match(source, at).end()
        return end, False, quoted

    def _text(self, raw: str, references: bool = True) -> None:
        if raw and not self.stack[-1][3]:
            if references and "&" in raw:
                raw = html.unescape(raw)
            self.pieces.append(raw)
            if self.links:
                self.linked += len(raw) - raw.count(" ")

    def _end_block(self) -> None:
        if self.pieces:
            text = " ".join("".join(self.pieces).split())
            if text:
                tag, element, path, _ = self.stack[-1]
                heading = len(tag) == 2 and tag[0] == "h" and tag[1] in "123456"
                self.blocks.append(Block(element, path, text, self.linked, heading))
            self.pieces = []
        self.linked = 0

    def _open(self, tag: str, attributes: str) -> None:
        if tag == "br":
            self.pieces.append(" ")
            return
        if tag in INLINE:
            self.links += tag == "a"
            return
        self._end_block()
        self.links = 0
        if tag in VOID:
            return
        while self.stack[-1][0] == "p":
            self.stack.pop()
        if tag in SIBLINGS:
            for k in range(len(self.stack) - 1, 0, -1):
                if self.stack[k][0] in SIBLINGS[tag]:
                    del self.stack[k:]
                    break
                if self.stack[k][0] in SCOPES:
                    break
        _, parent, above, why = self.stack[-1]
        names = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in NAMES.finditer(attributes)}
        own, named = self._left_out(tag, names, attributes)
        if tag in ("article", "main") and why == "around" and not own:
            why = ""  # an unclosed menu or advert does not swallow the article
        step = f"{tag}.{names.get('class', '')}"
        path = self.paths.setdefault((above, step), len(self.paths))
        self.parents.append(parent)
        self.tags.append(tag if names.get("role") != "main" else "main")
        self.named.append(named)
        # Most classes of a paragraph say how it looks (a lead, a question), not where it stands.
        about = names.get("class", "") + " " + names.get("id", "")
        self.marked.append(bool(_words(about) & META_NAMES if tag == "p" else about.strip()))
        if len(self.stack) > DEPTH:
            self.stack.pop()
        self.stack.append((tag, len(self.parents) - 1, path, why or own))

    def _left_out(self, tag: str, names: dict[str, str], attributes: str) -> tuple[str, str]:
        """Why the element is left out, and what its class and id say of it."""
        if tag == "head":
            return "around", ""
        if tag in ("html", "body"):
            return "", ""
        if tag == "form" and not HIDDEN.search(attributes):
            return "", "form"  # some pages are one form as a whole
        if not attributes and tag not in AROUND and tag != "header":
            return "", ""
        if tag in ("article", "main"):
            return "around" if HIDDEN.search(attributes) else "", ""
        if tag in ("aside", "footer"):
            return "beside", ""
        inside = any(t in ("article", "main") for t, *_ in self.stack)
        words = _words(names.get("class", "") + " " + names.get("id", ""))
        if tag == "header" and not inside and not words & MAIN_NAMES:
            return "around", ""
        if tag in AROUND or names.get("role", "").lower() in AROUND_ROLES or HIDDEN.search(attributes):
            return "around", ""
        if tag in UNNAMED:
            return "", ""
        if words & COMMENT_NAMES:
            slug = tag == "section" and not _words(names.get("class", "")) & COMMENT_NAMES
            return "", "around" if slug and len(words) > 1 else "comments"
        if inside and tag == "section" and words - AROUND_NAMES:
            return "", ""  # a chapter on social policy
        if words & AROUND_NAMES or (words & HEADER_NAMES and not inside and not words & MAIN_NAMES):
            return "", "around"
        return "", ""

    def _close(self, tag: str) -> None:
        if tag == "br":
            self.pieces.append(" ")
            return
        if tag in INLINE:
            self.links = max(0, self.links - (tag == "a"))
            return
        self._end_block()
        self.links = 0
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k][0] == tag:
                del self.stack[k:]
                break
            if tag == "p" or (tag == "li" and self.stack[k][0] in ("ul", "ol")):
                break  # an end tag without its start inside this list or block


def _after_equals(source: str, at: int) -> bool:
    while at and source[at - 1] in " \t\n\r\f":
        at -= 1
    return source[at - 1] == "="


def _words(names: str) -> set[str]:
    return set(PARTS.findall(CAMEL.sub(" ", names).lower()))


def _held(page: Page, weight: np.ndarray) -> np.ndarray:
    """The weight of the blocks in each element and below it."""
    held = np.zeros(len(page.parents))
    for block, w in zip(page.blocks, weight):
        held[block.element] += w
    for k in range(len(held) - 1, 0, -1):
        held[page.parents[k]] += held[k]
    return held


def name_weights(page: Page) -> tuple[np.ndarray, np.ndarray]:
    """What names leave of each block's score, and the outermost named element around it or 0.

    A name counts for all below it, but not if the element holds most of the page's text, which
    makes it a wrapper (``has-sidebar``, ``comments-open``); readers' comments may be longer than
    what they are about, so those are also weighed against the other text.
    """
    if not any(page.named):
        return np.ones(len(page.blocks)), np.zeros(len(page.blocks), np.int64)
    plain = np.array([max(len(b.text) - b.linked, 0) for b in page.blocks], float)

    def below(named: list[str]) -> np.ndarray:
        weight = np.ones(len(named))
        for k in range(1, len(named)):
            weight[k] = NAMED[named[k]] * weight[page.parents[k]]
        return weight

    of = np.array([b.element for b in page.blocks])
    held, named = _held(page, plain), list(page.named)
    clear = _held(page, np.where(below(named)[of] == 1, plain, 0))
    articles = [k for k, t in enumerate(page.tags) if t in ("article", "main")]
    for k in range(1, len(named)):
        if not named[k] or held[k] < MOST * held[0]:
            continue
        # No text below ``k`` is clear, so what is clear stands beside it.
        beside = max((clear[a] for a in articles), default=0.0)
        if named[k] == "comments":
            beside = clear[0]
        if beside < 0.1 * held[k]:
            named[k] = ""
    outer = np.zeros(len(named), np.int64)
    for k in range(1, len(named)):
        outer[k] = outer[page.parents[k]] or (k if named[k] else 0)
    return below(named)[of], outer[of]


def path_scores(blocks: list[Block], paths: int, links_count: bool = True) -> np.ndarray:
    """Fused and smoothed ratio of each block's path; links may count as text.

    Per path: characters and punctuation marks a block, and the share of text outside links.
    Their product, smoothed over neighbouring blocks in page order, is averaged per path again.
    """
    of = np.array([b.path for b in blocks]) + 1  # the text outside all elements has path -1
    chars = np.array([len(b.text) for b in blocks], float)
    marks = np.array([len(PUNCTUATION.findall(b.text)) for b in blocks], float)
    linked = np.minimum(np.array([b.linked for b in blocks], float), chars) * links_count

    def total(values: np.ndarray) -> np.ndarray:
        return np.bincount(of, values, minlength=paths + 1)

    count = np.maximum(np.bincount(of, minlength=paths + 1), 1)
    plain = 1 - total(linked) / np.maximum(total(chars), 1)
    raw = (total(chars) / count * (1 + total(marks) / count) * plain)[of]
    fused = np.sqrt(raw * _smooth(raw))
    return (total(fused) / count)[of]


def _smooth(values: np.ndarray) -> np.ndarray:
    edge = len(SMOOTH) // 2
    weight = np.convolve(np.ones(len(values)), SMOOTH)[edge : edge + len(values)]
    return np.convolve(values, SMOOTH)[edge : edge + len(values)] / weight


def _content_root(page: Page, weight: np.ndarray) -> int:
    """The element that holds the content: an article, a main element, or the lowest with most of it."""
    held = _held(page, weight)
    whole = held[0]
    inside = [False] * len(held)  # of another article
    several = []
    for k in range(1, len(held)):
        above = page.parents[k]
        inside[k] = inside[above] or page.tags[above] == "article"
        if page.tags[k] == "article" and not inside[k] and held[k] >= 0.1 * whole:
            several.append(k)
    if len(several) > 1:
        # Several articles of one main element belong together.
        lines = [_line(page, k) for k in several]
        common = max(set(lines[0]).intersection(*lines[1:]))
        if any(page.tags[k] == "main" for k in _line(page, common)):
            return common
    for tag in ("article", "main"):
        found = [k for k, t in enumerate(page.tags) if t == tag and held[k] >= 0.3 * whole]
        if found:
            return max(found, key=lambda k: (held[k], k))
    best = 0
    for k in range(1, len(held)):
        if held[k] >= 0.8 * whole:
            best = k
    return best


def _line(page: Page, element: int) -> list[int]:
    """The element and all around it."""
    line = []
    while element >= 0:
        line.append(element)
        element = page.parents[element]
    return line


def _inside(page: Page, root: int) -> np.ndarray:
    inside = np.zeros(len(page.parents), bool)
    inside[root] = True
    for k in range(root + 1, len(inside)):
        inside[k] = inside[page.parents[k]]
    return inside


def main_blocks(source: str) -> list[str]:
    page = Page(source)
    if not page.blocks:
        return []
    blocks = page.blocks
    names, outer = name_weights(page)
    scores = path_scores(blocks, len(page.paths)) * names
    chars = np.array([len(b.text) for b in blocks], float)
    linked = np.array([b.linked for b in blocks], float) > LINKS * chars
    # The mean is of what no name speaks against, else of all.
    clear = chars * (names == 1)
    mean = np.average(scores, weights=clear if clear.any() else chars)
    chosen = (scores >= np.where(names < 1, 2, 1) * SHARE * mean) & ~linked
    if not chosen.any():
        chosen = ~linked if not linked.all() else ~chosen
    root = _content_root(page, np.where(chosen, chars * names, 0))
    inside = _inside(page, root)
    here = np.array([inside[b.element] for b in blocks])
    links, texts = linked, path_scores(blocks, len(page.paths), False) * names
    if page.tags[root] in ("article", "main"):
        linked = _menus(page, here, linked, names, texts < SHARE * mean)
    # What a name calls surroundings has to score like content, as a whole; more so without an
    # element of the content's own.
    least = (1 if page.tags[root] not in ("#root", "html", "body") else 2) * SHARE * mean
    share = np.bincount(outer, scores * chars) >= least * np.bincount(outer, chars)
    linked = linked | (names < 1) & ~share[outer]
    linked |= here & ~links & _surroundings(page, root, chosen, texts < INSIDE * mean)
    if page.tags[root] not in ("#root", "html", "body"):
        keep = here & ~linked
    else:
        # Without an element of its own, content is what stands between the first and the last
        # chosen block, and a heading right before.
        places = np.flatnonzero(chosen & here)
        keep = np.zeros(len(blocks), bool)
        keep[places[0] : places[-1] + 1] = True
        first = places[0]
        while first and blocks[first - 1].heading and here[first - 1]:
            first -= 1
            keep[first] = True
        keep &= here & ~linked
    return [b.text for b, k in zip(blocks, keep) if k]


def _surroundings(page: Page, root: int, chosen: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Blocks of the root on a path that scores too low.

    The page sets such a path apart by a class or an id below the root. Plain elements, headings,
    items and cells stay, and so does a plain element beside content, however short.
    """
    apart = np.zeros(len(page.parents), bool)
    for k in range(root + 1, len(apart)):
        apart[k] = page.marked[k] or apart[page.parents[k]]
    of = np.array([b.element for b in page.blocks])
    parents, marked = np.array(page.parents), np.array(page.marked)
    beside = np.zeros(len(apart), bool)
    beside[parents[of[chosen]]] = True
    floor = np.array([b.heading or page.tags[b.element] in SHORT for b in page.blocks])
    floor |= ~marked[of] & beside[parents[of]]
    return apart[of] & ~floor & ~chosen & low


def _menus(page: Page, inside: np.ndarray, linked: np.ndarray, names: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Linked blocks of the article that are menus: what a name calls surroundings, or several on one
    path, all of them short, at the article's edge without a heading before them.

    A title, a paragraph, a reference or a list of references is text of the article.
    """
    of = np.array([b.path for b in page.blocks]) + 1
    count = np.bincount(of, inside, len(page.paths) + 1)
    links = np.bincount(of, inside & linked, len(page.paths) + 1)
    headings = np.array([b.heading for b in page.blocks])
    short = inside & linked & (links == count)[of] & low & ~headings
    places = np.flatnonzero(inside)
    edge = np.zeros(len(of), bool)
    listed = short & (count > 1)[of]
    for k in places:
        if not listed[k]:
            break
        edge[k] = True
    tail = []
    for k in places[::-1]:
        if not listed[k]:
            # The list belongs to the heading that it follows.
            if not headings[k]:
                edge[tail] = True
            break
        tail.append(k)
    return short & (edge | (names < 1))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = Rows(TEXTS)
    for batch in batches:
        for page_id, url, source in zip(*(batch.column(k).to_pylist() for k in range(3))):
            text = "\n\n".join(main_blocks(source or ""))
            yield from rows.add((page_id, url, text), len(text))
    yield from rows.flush()


def main_text(
    pages: DataFrame, page_id: str = "page_id", url: str = "url", source: str = "html"
) -> DataFrame:
    """(page_id, url, text): the main text of each page, in blocks joined by an empty line.

    Scripts, styles and what is marked as surroundings of an article by its element or role (menus,
    page headers, footers, asides, forms) take no part. A class or id that names surroundings (a
    sidebar, an advert, reader comments), or a form, lowers the score of what is below it, unless that is most
    of the page's text. For the blocks, characters and punctuation are summed per root-to-leaf tag
    path; the fused and smoothed ratio of the path decides whether its blocks are content, and
    content decides which element is the article. In there, blocks on a path that a class or id
    sets apart are left out if the ratio is low (a byline, a short note on the author); headings,
    items, cells and plain elements stay, as do links unless they are a menu. Character references are decoded, white space in a block becomes one
    space. A null, empty or text-free page has the text ``''``. Each row is handled alone, so
    repeated rows and null ids stay as they are; other columns are not read.
    """
    return pages.select(
        F.col(page_id).cast("long").alias("page_id"),
        F.col(url).cast("string").alias("url"),
        F.col(source).cast("string").alias("html"),
    ).mapInArrow(_extract, "page_id long, url string, text string")
