"""HTML extraction by the distribution of text over line blocks.

Markup is stripped to lines, one for each block of the page; elements that are never main text (menus, headers
and footers of the page, sidebars, adverts, notices, forms, scripts, styles, reader comments) leave gaps
without lines. The lengths of lines, without the text of links, are summed over sliding windows of lines. The text
surges where the sum rises over a threshold and dives where it falls below it again, and takes in the short lines on
both sides. Gaps and single lines of link text between two such stretches don't divide them; menus (several lines of
link text) do, unless both sides lie in the same container. The stretch that holds the most text is the main text.

Marked elements (article, main) choose among stretches and correct the edges of the one that is chosen: the stretch
with the most text inside marked elements comes first, and the outermost of them that has the most text in it ends
the stretch on both sides, so that lines beside the element go and lines of it that the windows missed stay. Of
several marked elements side by side one is the main text, the one with the most text in the stretch. A mark isn't
believed if its element has under a tenth of the text that a stretch has outside marked elements: it holds a headline,
which stays, or is one of several teasers, which go.

Scale: a scan without a shuffle; one page at a time, in time proportional to its length.

Defined cases: null html is empty; a page without text gives an empty string; a page whose only text is links gives
that of its largest marked element, if any; tags that aren't closed end with the page, and an element to leave out
that is never closed ends where the article, or (for p and li) the next block, begins; a '<' that begins no tag is
text; repeated rows give a row each; an empty table gives no rows.
"""

from __future__ import annotations

import html as html_
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

#: Lines of a window, and the characters a window must hold to belong to the main text.
WINDOW, THRESHOLD = 3, 60
#: A marked element is believed if it has so much of the text that a stretch has outside such elements.
BELIEVED = 0.1

#: Elements that begin and end a line.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead title tr ul".split())
#: Elements whose content isn't markup.
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
#: Elements without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that are never main text.
OUT = frozenset("head script style noscript template nav aside footer form button select option textarea title iframe object svg canvas dialog menu search noembed noframes xmp datalist".split())
_NAMES = "ad|ads|advert|adverts|advertisement|advertising|sponsor|sponsored|promo|cookie|cookies|consent|gdpr|notice|notices|alert|popup|modal|newsletter|subscribe|subscription|nav|navbar|navigation|menu|breadcrumb|breadcrumbs|sidebar|aside|widget|footer|header|masthead|comment|comments|respond|disqus|replies|share|sharing|social|related|recommended|toolbar|pagination|pager|login|signup|search|skip-link|banner"
#: Names of classes and ids that tell the same, alone or with the usual words around them.
_OUT_NAME = re.compile(rf"(?:site|page|main|top|global|reader|user|post|article|legal|left|right)?[-_]?(?:{_NAMES})(?:[-_](?:{_NAMES}|wrapper|container|box|bar|block|list|area|section|inner|links|menu|thread|form|item|text|message|top|bottom|left|right|\d+))*", re.I)
#: Names of the header of an article, which belongs to it; inside one other headers do too.
_OWN_HEADER = re.compile(r"(?:article|post|entry|story)[-_]?header(?:[-_]\w+)*", re.I)
_HEADER = re.compile(r"header(?:[-_]\w+)*", re.I)
_OUT_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
#: Elements that names of classes don't put out: they hold the page or the article.
_HOLDERS = frozenset("html body article main".split())
_EDGES = frozenset(("article", "main"))
#: Blocks that hold others; the rest of the blocks are parts of a text.
_CONTAINERS = frozenset("article center details div fieldset main section td th".split())

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """("text", data, ""), ("open", name, attributes) and ("close", name, "") in order; comments are left out."""
    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            yield "text", page[at:], ""
            return
        if lt > at:
            yield "text", page[at:lt], ""
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4) if not page.startswith(("<!-->", "<!--->"), lt) else page.find(">", lt) - 2
            at = n if end < 0 else end + 3
        elif page.startswith("<![CDATA[", lt):
            end = page.find("]]>", lt)
            at = n if end < 0 else end + 3
        elif page.startswith(("<!", "<?"), lt):
            end = page.find(">", lt)
            at = n if end < 0 else end + 1
        elif m := _TAG.match(page, lt) or _LOOSE.match(page, lt):
            at, name = m.end(), m[2].lower()
            if m[1]:
                yield "close", name, ""
                continue
            yield "open", name, m[3]
            if name in RAW and not m[3].rstrip().endswith("/"):
                close = re.compile(rf"</{re.escape(name)}(?=[\s/>]|$)", re.I).search(page, at)
                stop = close.start() if close else n
                if stop > at:
                    yield "text", page[at:stop], ""
                at = stop
        elif (after := page[lt + 1 : lt + 2]).isalpha() or after == "/":
            return  # a tag that the end of the page cuts off
        else:
            yield "text", "<", ""
            at = lt + 1


def _is_out(name: str, attributes: str, in_article: bool) -> bool:
    if name in OUT or name == "header" and not in_article:
        return True
    if name in _HOLDERS or not attributes:
        return name == "article" and bool(attributes) and any(re.fullmatch(r"(?:\w+-)?(?:comment|reply)(?:-\w+)?", x, re.I) for x in _values(attributes, ("class", "id")))
    if any(x.lower() in _OUT_ROLES for x in _values(attributes, ("role",))):
        return True
    own = lambda x: _OWN_HEADER.fullmatch(x) or in_article and _HEADER.fullmatch(x)
    return any(_OUT_NAME.fullmatch(x) and not own(x) for x in _values(attributes, ("class", "id")))


def _values(attributes: str, names: tuple[str, ...]) -> list[str]:
    return [x for m in _ATTRIBUTE.finditer(attributes) if m[1].lower() in names for x in html_.unescape(m[2] or m[3] or m[4] or "").split()]


class Lines:
    """Blocks of a page: their text, the length of it outside links, and the outermost article each is in (or 0).

    gap: whether elements were left out before a block. place: numbers of the block itself, of the container
    above it and of the innermost container it is in (0 is the page).
    """

    def __init__(self, page: str):
        self.text: list[str] = []
        self.free: list[int] = []
        self.article: list[int] = []
        self.gap: list[bool] = []
        self.place: list[tuple[int, int, int]] = []
        self._gap, self._at, self._numbers = False, (0, 0, 0), 0
        self._parts: list[str] = []
        self._linked, self._in, self._articles = 0, 0, 0
        every = list(tokens(page))
        closed = self._closed(every)
        # Open elements: name, number of the article or 0, place of text in it, links around and with it.
        stack: list[tuple[str, int, tuple[int, int, int], int]] = []
        depths: dict[str, list[int]] = {}  # of the open elements of each name
        out: list[tuple[str, int, bool]] = []  # elements to leave out: name, depth of the stack, ever closed
        links = 0
        for i, (kind, name, more) in enumerate(every):
            if kind == "text":
                if not out:
                    self._parts.append(name)
                    self._linked += len(name.strip()) if links else 0
                continue
            if name in BLOCKS:
                self._end(blank=bool(out))
            if kind == "open":
                while out and not out[-1][2] and (name in _EDGES or out[-1][0] in ("p", "li") and name in BLOCKS):
                    self._close(stack, depths, out.pop()[1])
                    links = stack[-1][3] if stack else 0
                    self._at = stack[-1][2] if stack else (0, 0, 0)
                if name == "br":
                    self._parts.append(" ")
                if name in VOID or more.rstrip().endswith("/") and name not in BLOCKS:
                    continue
                if _is_out(name, more, self._in > 0):
                    out.append((name, len(stack), closed[i]))
                elif name in _EDGES and not out and not self._in:
                    self._articles += 1
                    self._in = self._articles
                if name in BLOCKS and name not in ("html", "body"):
                    self._numbers += 1
                    self._at = self._numbers, self._at[2], self._numbers if name in _CONTAINERS else self._at[2]
                links += name == "a" and not out
                depths.setdefault(name, []).append(len(stack))
                stack.append((name, self._in, self._at, links))
            else:
                if not (at := depths.get(name)) or out and at[-1] < out[-1][1] and out[-1][2]:
                    continue  # closes nothing, or something around an element that is still to be closed
                self._close(stack, depths, at[-1])
                while out and out[-1][1] >= len(stack):
                    out.pop()
                _, self._in, self._at, links = stack[-1] if stack else ("", 0, (0, 0, 0), 0)
        self._end()

    @staticmethod
    def _close(stack: list, depths: dict[str, list[int]], at: int) -> None:
        """Close what is open from a depth on."""
        for name, *_ in stack[at:]:
            depths[name].pop()
        del stack[at:]

    @staticmethod
    def _closed(every) -> dict[int, bool]:
        """Whether each opening tag has a closing one."""
        open_: dict[str, list[int]] = {}
        found: dict[int, bool] = {}
        for i, (kind, name, _) in enumerate(every):
            if kind == "open":
                found[i] = False
                open_.setdefault(name, []).append(i)
            elif kind == "close" and open_.get(name):
                found[open_[name].pop()] = True
        return found

    def _end(self, blank: bool = False) -> None:
        text = " ".join(html_.unescape("".join(self._parts)).split())
        if text:
            self.text.append(text)
            self.free.append(max(0, len(text) - self._linked))
            self.article.append(self._in)
            self.gap.append(self._gap)
            self.place.append(self._at)
            self._gap = False
        self._gap |= blank
        self._parts, self._linked = [], 0

    def near(self, i: int, j: int) -> bool:
        """Whether blocks i and j are side by side in a container, or one is in the other."""
        return bool({*self.place[i][:2]} & {*self.place[j][:2]})

    def bridged(self, i: int, j: int) -> bool:
        """Whether the blocks between i and j, texts both, leave them in one stretch: no menu, or one in the same container."""
        menu = any(not self.free[k] and not self.free[k + 1] for k in range(i + 1, j - 1))
        return not menu or self.place[i][2] == self.place[j][2] != 0


def stretches(free: list[int], window: int = WINDOW, threshold: int = THRESHOLD, lines: Lines | None = None) -> list[tuple[int, int]]:
    """The stretches [surge, dive) of lines of a page, or that of the longest line if none surges.

    With lines, stretches that ``Lines.bridged`` joins are one; otherwise each line without free text ends one.
    """
    n = len(free)
    sums, total = [], sum(free[:window])
    for i in range(n):
        sums.append(total)
        total += (free[i + window] if i + window < n else 0) - free[i]

    def on(i: int, step: int) -> int | None:
        """The next line with free text, if a stretch goes on from line i to it although it is short."""
        j = i + step
        if lines and 0 <= j + step < n and 0 <= j < n and not free[j]:  # a single line of link text
            return j + step if free[j + step] and lines.near(i, j + step) else None
        if not 0 <= j < n or not free[j] or lines and lines.gap[max(i, j)] and not lines.near(i, j):
            return None
        return j

    found: list[tuple[int, int]] = []
    i = 0
    longest = max(range(n), key=lambda x: (free[x], -x), default=0)
    surges = any(f and s >= threshold for f, s in zip(free, sums))
    while i < n:
        if not (free[i] and sums[i] >= threshold if surges else i == longest and free[i]):
            i += 1
            continue
        a, b = i, i + 1
        while b < n and free[b] and sums[b] >= threshold:
            b += 1
        least = found[-1][1] if found else 0
        while (k := on(a, -1)) is not None and k >= least:  # short lines on both sides
            a = k
        while (k := on(b - 1, 1)) is not None:
            b = k + 1
        i = b
        if found and lines and lines.bridged(found[-1][1] - 1, a):
            a = found.pop()[0]
        found.append((a, b))
    return found


def believed(lines: Lines, found: list[tuple[int, int]]) -> list[int]:
    """Of each line the marked element it is in, or 0 where that one holds too little text to be the main one."""
    most = max((sum(f for f, x in zip(lines.free[a:b], lines.article[a:b]) if not x) for a, b in found), default=0)
    held = Counter()
    for a, f in zip(lines.article, lines.free):
        held[a] += f
    return [a if held[a] >= BELIEVED * most else 0 for a in lines.article]


def surge_and_dive(free: list[int], window: int = WINDOW, threshold: int = THRESHOLD, lines: Lines | None = None) -> tuple[int, int]:
    """The stretch that holds the most text, in believed marked elements first; (0, 0) if there is none."""
    found = stretches(free, window, threshold, lines)
    own = [f if a else 0 for f, a in zip(free, believed(lines, found))] if lines else free
    return max(found, key=lambda x: (sum(own[x[0] : x[1]]), sum(free[x[0] : x[1]]), -x[0]), default=(0, 0))


def main_text(page: str | None, window: int = WINDOW, threshold: int = THRESHOLD) -> str:
    """The main text of a page, a line for each block."""
    if not page:
        return ""
    lines = Lines(page)
    surge, dive = surge_and_dive(lines.free, window, threshold, lines)
    marked = believed(lines, [(surge, dive)])
    inside = range(surge, dive) if dive else range(len(lines.text))
    held: dict[int, tuple[int, int]] = {}  # by marked element: its text outside links in the stretch, and all of that
    for i in inside:
        if a := marked[i]:
            free, whole = held.get(a, (0, 0))
            held[a] = free + lines.free[i], whole + len(lines.text[i])
    if held:
        own = max(held, key=lambda a: (held[a], -a))
        return "\n".join(t for t, a in zip(lines.text, marked) if a == own)
    teasers = len({*lines.article[surge:dive]} - {0}) > 1
    return "\n".join(t for t, a in zip(lines.text[surge:dive], lines.article[surge:dive]) if not (a and teasers))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [main_text(h) for h in b["html"].to_pylist()]
        yield pa.RecordBatch.from_arrays([b["page_id"], b["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each row of pages."""
    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return slim.mapInArrow(shared.lean(_extract), "page_id long, url string, text string, n_chars long")
