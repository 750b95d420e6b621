"""HTML extraction by layout-aware rendering.

A tokenizer feeds a tree builder that implies missing tags (a new block ends an open paragraph, a list item ends the item
before it, a cell ends a cell, a row ends a row, the first content ends the head, end tags close what stands open inside)
and knows which elements are not shown: head, scripts, styles, templates, comments, ``hidden``, ``display:none``,
``visibility:hidden`` but for what is ``visible`` inside it, hidden inputs, the body of closed ``details``, the fallback of media and frames.
Of ``svg`` the ``text`` elements and foreign objects show, of ``math`` all but annotations, of ``object`` its fallback, as
nothing is loaded. The open elements render into boxes: blocks start on new lines, paragraphs, headings, lists and
tables are set off by a blank line, list items carry bullets or numbers and are indented, preformatted text keeps its
spaces, and table cells are padded to the width of their column.

A page is read once from front to back, and open elements are found by tag, not by walking the stack, so the time grows with the
page, however it is nested. A tag without its end ends the page, as in browsers.

Edge cases: a null page has null text; an empty one, or one that shows nothing, has empty text, and an empty table of pages an empty
result; very long pages are rendered whole; unclosed and mismatched tags, stray ``<`` and unknown entities are text or ignored as browsers
do; lists and tables nested deeper than ``DEPTH`` keep all their text but are indented and aligned no further, as the spaces alone
would grow with the square of the page; ``colspan`` above 1000 counts as 1000, as HTML has it; cells wider than ``WIDEST`` stand as they are and widen their
column to that at most; repeated rows are rendered alike; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterable, Iterator
from html import escape, unescape
from itertools import accumulate, zip_longest

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeloom.llm.textcore import map_batches
from lakeloom.plans.runtime import col

#: Nested list items and tables that get boxes of their own.
DEPTH = 100
#: Characters to which cells are padded at most.
WIDEST = 400

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = set("head script style template noscript title iframe audio video canvas datalist colgroup".split())
#: What may stand in a head: anything else ends it.
HEAD = set("base basefont bgsound html head link meta noframes noscript script style template title".split())
#: Elements of svg and math that are not shown; HTML elements that end both; elements in them that hold HTML.
FOREIGN_HIDDEN = {"svg": set("defs desc metadata title symbol clippath mask pattern marker lineargradient radialgradient filter script style".split()), "math": set("annotation annotation-xml mphantom".split())}
FOREIGN_HIDDEN["text"] = FOREIGN_HIDDEN["svg"]
ENDS_FOREIGN = set("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
HOLDS_HTML = {"foreignobject", "mi", "mo", "mn", "ms", "mtext"}
RAW = set("script style textarea title xmp iframe noembed noframes".split())
SPACED = set("p h1 h2 h3 h4 h5 h6 ul ol dl table pre blockquote figure hr form fieldset".split())
BLOCKS = SPACED | set("address article aside body center dd details dialog div dt figcaption footer header hgroup html legend li main menu nav optgroup option section summary caption tr td th thead tbody tfoot".split())
#: What a start tag ends if it stands open, and the elements beyond which it does not look.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}),
    "td": ({"td", "th", "caption"}, {"table", "tr"}),
    "th": ({"td", "th", "caption"}, {"table", "tr"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "body": ({"head"}, set()),
}
ENDS_P = BLOCKS - {"option", "optgroup", "html", "body", "tr", "td", "th", "thead", "tbody", "tfoot", "caption", "legend", "summary"} | {"summary"}
P_SCOPE = {"td", "th", "li", "table", "caption", "button", "div", "article", "section", "body"}
#: Elements in which white space alone is nothing.
STRUCTURE = {"table", "tr", "thead", "tbody", "tfoot", "ul", "ol", "select"}
#: An end tag does not close elements outside the cell or table it stands in.
WALLS = {"td", "th", "caption", "table"}

TAG_NAME = re.compile(r"[A-Za-z][^\s/>]*")
#: What stands before an attribute, its name, and the sign of a value.
ATTRIBUTE = re.compile(r"[\s/]*([^\s/>=][^\s/>=]*|=[^\s/>=]*)?(\s*=\s*)?")
UNQUOTED = re.compile(r"[^\s>]*")
UNDISPLAYED = re.compile(r"display\s*:\s*none", re.I)
VISIBILITY = re.compile(r"(?:^|;)\s*visibility\s*:\s*([a-z]+)", re.I)
SPACE = re.compile(r"[ \t\r\n\f]+")


class Box:
    """Lines under construction, and the text of the line that is open."""

    __slots__ = ("blank", "inline", "lines")

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.inline: list[str] = []
        self.blank = False

    def flush(self) -> None:
        if self.inline:
            text = SPACE.sub(" ", "".join(self.inline)).strip(" ")
            self.inline = []
            if text:
                self.add([text])

    def add(self, lines: list[str]) -> None:
        if self.blank and self.lines and self.lines[-1]:
            self.lines.append("")
        self.blank = False
        self.lines += lines

    def gap(self) -> None:
        self.flush()
        self.blank = True


class Element:
    __slots__ = ("box", "foreign", "hidden", "invisible", "number", "rows", "tag")

    def __init__(self, tag: str, hidden: bool, invisible: bool = False, foreign: str = "") -> None:
        #: ``hidden`` holds for all that is inside, ``invisible`` until an element is visible; ``foreign`` is svg, text (of svg) or math.
        self.tag, self.hidden, self.invisible, self.foreign = tag, hidden, invisible, foreign
        self.box: Box | None = None
        self.rows: list[list[tuple[list[str], int]]] | None = None
        self.number = 0


class Renderer:
    """Builds the stack of open elements and renders what they show."""

    def __init__(self) -> None:
        self.stack: list[Element] = []
        #: Places on the stack by tag, and of the elements with boxes of their own.
        self.places: defaultdict[str, list[int]] = defaultdict(list)
        self.boxed: list[int] = []
        self.boxes = [Box()]
        self.pre = self.nested = 0

    @property
    def hidden(self) -> bool:
        return bool(self.stack) and self.stack[-1].hidden

    @property
    def foreign(self) -> str:
        return self.stack[-1].foreign if self.stack else ""

    def text(self, raw: str) -> None:
        if self.stack and self.stack[-1].tag == "head" and raw.strip(" \t\r\n\f"):
            self.pop()
        if self.stack:
            inner = self.stack[-1]
            if inner.hidden or inner.invisible or inner.foreign == "svg" or (inner.tag == "details" and inner.number == 0) or (inner.tag in STRUCTURE and not raw.strip()):
                return
        body = unescape(raw) if "&" in raw else raw
        box = self.boxes[-1]
        if self.pre:
            first, *rest = body.replace("\r\n", "\n").split("\n")
            self.boxes[-1].inline.append(first)
            for line in rest:
                self.keep()
                box.inline.append(line)
        else:
            box.inline.append(body)

    def keep(self) -> None:
        """End a preformatted line as it is."""
        box = self.boxes[-1]
        line, box.inline = "".join(box.inline), []
        box.add([line.rstrip()])

    def nearest(self, tags: Iterable[str]) -> int:
        """The place of the innermost open element of ``tags``, or -1."""
        return max((p[-1] for t in tags if (p := self.places.get(t))), default=-1)

    def start(self, tag: str, values: dict[str, str], ended: bool = False) -> bool:
        """Whether the tag, which may have ended itself, leaves an element open."""
        if self.stack and self.stack[-1].tag == "head" and tag not in HEAD:
            self.pop()
        if tag in ENDS_FOREIGN:
            while self.foreign:
                self.pop()
        if tag in IMPLIED:
            closes, scope = IMPLIED[tag]
            self.close(closes, scope)
        if tag in ENDS_P:
            self.close({"p"}, P_SCOPE)
        hidden = self.hidden or tag in HIDDEN or "hidden" in values or bool(UNDISPLAYED.search(values.get("style", ""))) or (tag == "input" and values.get("type", "").lower() == "hidden")
        parent = self.stack[-1] if self.stack else None
        if parent is not None and parent.tag == "details" and parent.number == 0 and tag != "summary":
            hidden = True
        around = parent.foreign if parent is not None else ""
        foreign = "" if around and tag in HOLDS_HTML else tag if tag in ("svg", "math") else "text" if around == "svg" and tag == "text" else around
        invisible = parent is not None and parent.invisible
        if "style" in values or around or foreign:
            seen = VISIBILITY.findall(values.get("style", "")) or ([values["visibility"].strip()] if (around or foreign) and "visibility" in values else [])
            if seen and seen[-1].lower() in ("hidden", "collapse", "visible", "initial"):
                invisible = seen[-1].lower() in ("hidden", "collapse")
        if around:
            hidden = hidden or tag in FOREIGN_HIDDEN[around] or values.get("display", "").strip().lower() == "none"
        if (around or foreign) and ended:
            return False
        if tag in VOID:
            if not hidden:
                if tag == "br":
                    self.keep() if self.pre else self.line()
                elif tag == "hr":
                    self.boxes[-1].gap()
            return False
        element = Element(tag, hidden, invisible, foreign)
        self.places[tag].append(len(self.stack))
        self.stack.append(element)
        if hidden:
            return True
        if around == "svg" and tag in ("text", "foreignobject"):
            self.boxes[-1].flush()
        if tag in BLOCKS:
            self.boxes[-1].flush()
            if tag in SPACED and not (tag in ("ul", "ol") and self.places["li"]):
                self.boxes[-1].blank = True
        if tag == "details":
            element.number = int("open" in values)
        elif tag in ("pre", "textarea"):
            self.pre += 1
        elif tag == "ol":
            element.number = int(values["start"]) - 1 if re.fullmatch(r"-?\d{1,9}", values.get("start", "")) else 0
        elif tag == "li" and self.nested < DEPTH:
            self.open(element)
        elif tag == "table" and self.nested < DEPTH:
            element.rows = []
            self.nested += 1
        elif tag == "tr" and (table := self.table()) is not None:
            table.rows.append([])
        elif tag in ("td", "th", "caption") and (table := self.table()) is not None:
            if tag != "caption" and not table.rows:
                table.rows.append([])
            element.number = min(1000, int(values["colspan"])) if re.fullmatch(r"[1-9]\d{0,3}", values.get("colspan", "")) else 1
            self.open(element)
        return True

    def line(self) -> None:
        box = self.boxes[-1]
        had = bool(box.inline)
        box.flush()
        if not had and box.lines and box.lines[-1]:
            box.blank = True

    def open(self, element: Element) -> None:
        element.box = Box()
        self.boxed.append(len(self.stack) - 1)
        self.boxes.append(element.box)
        self.nested += element.tag == "li"

    def table(self) -> Element | None:
        """The innermost open table, if it aligns its cells and no cell or item inside it is open."""
        at = self.nearest(("table",))
        if at < 0 or (self.boxed and self.boxed[-1] > at):
            return None
        return self.stack[at] if self.stack[at].rows is not None else None

    def end(self, tag: str) -> None:
        if tag == "br":
            self.start("br", {})
        elif tag == "p" and not self.places["p"]:
            self.boxes[-1].gap()
        else:
            self.close({tag}, set() if tag in WALLS | {"tr", "tbody", "thead", "tfoot", "body", "html"} else WALLS)

    def close(self, tags: set[str], scope: set[str]) -> None:
        """Pop up to the element of ``tags`` that is innermost, or of several tags outermost, among those inside ``scope``."""
        inside = self.nearest(scope)
        if len(tags) == 1:
            at = self.nearest(tags)
        else:
            at = min((p[i] for t in tags if (p := self.places.get(t)) and (i := bisect_right(p, inside)) < len(p)), default=-1)
        if at > inside:
            while len(self.stack) > at:
                self.pop()

    def pop(self) -> None:
        element = self.stack.pop()
        self.places[element.tag].pop()
        if element.hidden:
            return
        tag = element.tag
        if tag == "foreignobject" or (tag == "text" and element.foreign):
            self.boxes[-1].flush()
        if tag in ("pre", "textarea"):
            if self.boxes[-1].inline:
                self.keep()
            self.pre -= 1
        if element.box is not None:
            box = self.boxes.pop()
            self.boxed.pop()
            box.flush()
            while box.lines and not box.lines[-1]:
                box.lines.pop()
            if tag == "li":
                self.nested -= 1
                self.item(box.lines)
            elif tag == "caption":
                self.boxes[-1].add(box.lines)
            else:
                self.stack[self.nearest(("table",))].rows[-1].append((box.lines, element.number))
        elif element.rows is not None:
            self.nested -= 1
            self.boxes[-1].flush()
            self.boxes[-1].add(aligned(element.rows))
        if tag in BLOCKS:
            self.boxes[-1].flush()
            if tag in SPACED and not (tag in ("ul", "ol") and self.places["li"]):
                self.boxes[-1].blank = True

    def item(self, lines: list[str]) -> None:
        at, mark = self.nearest(("ul", "ol", "menu")), "- "
        if at >= 0 and self.stack[at].tag == "ol":
            self.stack[at].number += 1
            mark = f"{self.stack[at].number}. "
        if lines:
            self.boxes[-1].flush()
            self.boxes[-1].add([mark + lines[0], *(" " * len(mark) + x if x else "" for x in lines[1:])])

    def done(self) -> str:
        while self.stack:
            self.pop()
        self.boxes[0].flush()
        lines = self.boxes[0].lines
        while lines and not lines[-1]:
            lines.pop()
        return "\n".join(lines).replace("\xa0", " ")


def aligned(rows: list[list[tuple[list[str], int]]]) -> list[str]:
    """Rows of (cell lines, columns taken) as lines, each cell padded to its column; columns in which no cell begins take no room."""
    begins = sorted({at for row in rows for at in accumulate((span for _, span in row[:-1]), initial=0)})
    places = []
    widths = [0] * len(begins)
    for row in rows:
        here, at = [], 0
        for lines, span in row:
            first, last = bisect_left(begins, at), bisect_left(begins, at + span)
            here.append((first, last))
            if last == first + 1:
                widths[first] = max(widths[first], min(WIDEST, max(map(len, lines), default=0)))
            at += span
        places.append(here)
    upto = [0, *accumulate(w + 2 for w in widths)]
    out = []
    for row, here in zip(rows, places, strict=True):
        rooms = [min(WIDEST, upto[last] - upto[first] - 2) for first, last in here]
        for parts in zip_longest(*(lines or [""] for lines, _ in row), fillvalue=""):
            line = "  ".join(p.ljust(w) for p, w in zip(parts, rooms, strict=True)).rstrip()
            if line:
                out.append(line)
    return out


def attributes(html: str, at: int) -> tuple[dict[str, str], bool, int]:
    """The attributes of a start tag from behind its name, whether it ends itself, and the place behind it; -1 if it has no end."""
    values: dict[str, str] = {}
    while True:
        m = ATTRIBUTE.match(html, at)
        at = m.end()
        if m[1] is None:
            if at >= len(html):
                return values, False, -1
            if html[at] == ">":
                return values, html[at - 1] == "/", at + 1
            continue
        value = ""
        if m[2] is not None and at < len(html):
            quote = html[at]
            if quote in "\"'":
                end = html.find(quote, at + 1)
                if end < 0:
                    return values, False, -1
                value, at = html[at + 1 : end], end + 1
            else:
                end = UNQUOTED.match(html, at).end()
                value, at = html[at:end], end
        values.setdefault(m[1].lower(), unescape(value) if "&" in value else value)


def render(html: str) -> str:
    """The visible text of a page."""
    page, at = Renderer(), 0
    while at < len(html):
        if html[at] != "<":
            end = html.find("<", at)
            end = len(html) if end < 0 else end
            page.text(html[at:end])
            at = end
            continue
        ends = html.startswith("</", at)
        if (name := TAG_NAME.match(html, at + 1 + ends)) is not None:
            tag = name[0].lower()
            values, ended, at = attributes(html, name.end())
            if at < 0:
                break
            if ends:
                page.end(tag)
                continue
            foreign, opened = page.foreign, page.start(tag, values, ended)
            if opened and tag in RAW and (not foreign or tag in ("script", "style")):
                close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(html, at)
                end = close.start() if close else len(html)
                page.text(html[at:end])
                at = end
        elif html.startswith("<!--", at):
            # Comments may also end at once, as <!--> and <!--->.
            end = html.find("-->", at + 2)
            at = len(html) if end < 0 else end + 3
        elif page.foreign and html.startswith("<![CDATA[", at):
            end = html.find("]]>", at)
            page.text(escape(html[at + 9 : len(html) if end < 0 else end]))
            at = len(html) if end < 0 else end + 3
        elif ends or html.startswith(("<!", "<?"), at):
            end = html.find(">", at)
            at = len(html) if end < 0 else end + 1
        else:
            page.text("<")
            at += 1
    return page.done()


def extract(pages: DataFrame, *, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """page_id and the text that each page shows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [None if x is None else render(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["page_id", "text"])

    schema = T.StructType([T.StructField("page_id", pages.schema[page_id].dataType), T.StructField("text", T.StringType())])
    return map_batches(pages.select(col(page_id), col(html)), run, schema)


def report(pages: DataFrame, **columns: str) -> DataFrame:
    """One row per page: page_id, n_chars, n_lines, text_sha256, text."""
    n_lines = F.when(F.coalesce(F.col("text"), F.lit("")) == "", F.lit(0)).otherwise(F.size(F.split("text", "\n", -1)))
    return extract(pages, **columns).select("page_id", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"), n_lines.cast("long").alias("n_lines"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), "text")
