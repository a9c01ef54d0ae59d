"""Pages taken apart by a stack of open tags: typed blocks with offsets, and lines of text, in one pass a page.

In HTML, tags that may stay open (p, li, table cells and rows, dt, dd, option) are closed by what can't stand in them; an end
tag closes the nearest open tag of its name, though never across a table; void tags hold nothing. Pages that begin as XML
are read as XML: any tag may close itself, names keep their case and prefix, CDATA is text, and nothing is implied.

A block is a run of text that no block-level tag interrupts: inline markup and a single line break stay inside, two breaks in
a row end it. A table, with all tables inside of it, is one block. A block is a title in h1 to h6, or where all of its
letters are bold. Scripts, styles, noscript, comments and the page's title belong to no block.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A tag with quotes is looked through up to this length, so that an open quote can't make a page's cost quadratic.
LONGEST_TAG = 4000
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<\?.*?(?:\?>|>|\Z)|<![^>]*(?:>|\Z)|<(?P<close>/?)(?P<name>[A-Za-z][^\s/>]*)", re.S)
_TAG_END = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
# The tags of HTML by kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
RAW = frozenset("script style noscript".split())
TITLES = frozenset("h1 h2 h3 h4 h5 h6".split())
BOLD = frozenset(("b", "strong"))
#: What a start tag closes, and the tags beyond which it doesn't look.
IMPLIED = {
    "li": ({"li", "p"}, {"ul", "ol"}), "dt": ({"dt", "dd", "p"}, {"dl"}), "dd": ({"dt", "dd", "p"}, {"dl"}), "option": ({"option"}, {"select"}),
    "td": ({"td", "th", "p"}, {"tr"}), "th": ({"td", "th", "p"}, {"tr"}), "tr": ({"tr", "td", "th", "p"}, set()), "tbody": ({"tr", "td", "th", "thead", "tbody", "tfoot"}, set()), "tfoot": ({"tr", "td", "th", "thead", "tbody"}, set()),
}
#: Open tags of a page; more are an error of the page, not of the query.
DEEPEST = 5000


class PageError(ValueError):
    """A page that can't be read."""


def is_xml(page: str) -> bool:
    start = page.lstrip()[:5].lower()
    return start == "<?xml" or start.startswith("<xml")


def events(page: str, xml: bool) -> Iterator[tuple[str, str]]:
    """(kind, value) of a page in order: text, open, close; implied ends included, dropped parts left out."""
    at, look, raw, open_tags, opened = 0, 0, None, [], Counter()

    def pop() -> tuple[str, str]:
        tag = open_tags.pop()
        opened[tag] -= 1
        return "close", tag

    def close(name: str, stop: str | None = None) -> Iterator[tuple[str, str]]:
        if opened[name]:
            for i in range(len(open_tags) - 1, -1, -1):
                if open_tags[i] == name:
                    while len(open_tags) > i:
                        yield pop()
                    return
                if open_tags[i] == stop:
                    return

    while m := _TOKEN.search(page, look):
        stop, own = m.end(), False
        if m["name"]:
            # Quotes may hold the end sign; where they don't close, the first sign ends the tag.
            quoted = _TAG_END.match(page, stop, stop + LONGEST_TAG)
            stop = quoted.end() if quoted else page.find(">", stop) + 1
            if not stop:  # no tag: text
                look = m.end()
                continue
            own = page[stop - 2] == "/"
        if raw is None and m.start() > at:
            yield "text", page[at : m.start()]
        at = look = stop
        if m["name"] is None:
            if m["cdata"] is not None and xml and raw is None:
                yield "text", m["cdata"].replace("&", "&amp;")
            continue
        name = m["name"] if xml else m["name"].lower()
        if raw is not None:
            if m["close"] and name.lower() == raw:
                raw = None
            continue
        if m["close"]:
            yield from close(name, None if xml or name == "table" else "table")
            continue
        if name.lower() in RAW:
            if not (xml and own):
                raw = name.lower()
                ended = re.compile(f"</{raw}", re.I).search(page, at)
                at = look = ended.start() if ended else len(page)
            continue
        if not xml:
            gone, limit = IMPLIED.get(name, ({"p"}, set()) if name in BLOCK else (set(), set()))
            while any(opened[g] for g in gone) and any(t in gone for t in _within(open_tags, limit)):
                yield pop()
        yield "open", name
        if name in VOID and not xml or (xml and own):
            yield "close", name
        else:
            open_tags.append(name)
            opened[name] += 1
            if len(open_tags) > DEEPEST:
                raise PageError("tags are nested too deeply")
    if raw is None and at < len(page):
        yield "text", page[at:]
    while open_tags:
        yield pop()


def _within(open_tags: list[str], limit: set[str]) -> Iterator[str]:
    """Open tags from the innermost up to the nearest table or limit."""
    for tag in reversed(open_tags):
        if tag == "table" or tag in limit:
            return
        yield tag


def plain(text: str) -> str:
    """Entities resolved, white space collapsed."""
    return " ".join(html.unescape(html.unescape(text)).split())


def blocks_and_lines(page: str) -> tuple[list[dict], list[str]]:
    """The blocks of a page (type, text, start in their text with blank lines between, depth, tables), and its text nodes' lines."""
    if "\x00" in page:
        raise PageError("not a text")
    xml, blocks, lines, seen = is_xml(page), [], [], set()
    run: list[str] = []
    letters = bold = heads = strong = depth = tables = held = breaks = title = cursor = 0

    def flush(kind: str) -> None:
        nonlocal letters, bold, cursor, held, breaks
        text = plain("".join(run))
        if text:
            cursor += 2 if blocks else 0
            kind = "title" if kind == "text" and (heads or letters and letters == bold) else kind
            blocks.append({"type": kind, "text": text, "start": cursor, "depth": depth, "tables": held})
            cursor += len(text)
        run.clear()
        letters = bold = held = breaks = 0

    for kind, value in events(page, xml):
        name = value.rpartition(":")[2].lower() if xml else value
        if kind == "text":
            for line in html.unescape(html.unescape(value)).splitlines():
                line = " ".join(line.split())
                if line and (len(line) >= 40 or line not in seen):
                    seen.add(line)
                    lines.append(line)
            if title:
                continue
            run.append(value)
            shown = len(value) - value.count(" ") - value.count("\n") if value.strip() else 0
            letters, bold = letters + shown, bold + (shown if strong else 0)
            breaks = breaks if not value.strip() else 0
        elif name == "title" and not tables:
            title += 1 if kind == "open" else -1
        elif name == "br":
            if kind == "open":
                run.append(" ")
                breaks += 1
                if breaks > 1 and not tables:
                    flush("text")
        elif name == "table":
            if kind == "open":
                if not tables:
                    flush("text")
                tables, held = tables + 1, held + 1
            else:
                tables -= 1
                if not tables:
                    flush("table")
                run.append(" ")
        elif name in BLOCK:
            if tables:
                run.append(" ")
            else:
                flush("text")
        if name in TITLES:
            heads += 1 if kind == "open" else -1
        elif name in BOLD:
            strong += 1 if kind == "open" else -1
        if name in BLOCK and kind != "text":
            depth += 1 if kind == "open" else -1
    flush("text")
    return blocks, lines


BLOCK_TYPE = "struct<type:string,text:string,start:int,depth:int,tables:int>"


def parsed(pages: DataFrame, *, key: str = "filing_id", html: str = "html") -> DataFrame:
    """key, blocks, full_text (the blocks' texts), clean_text (all lines, short repeated ones once), parse_warning.

    A page that can't be read has no blocks and the reason as its warning: the row fails, not the query. A null page is empty.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    source = pages.select(F.col(key).alias("key"), F.col(html).alias("html"))
    schema = f"key {source.schema['key'].dataType.simpleString()}, blocks array<{BLOCK_TYPE}>, full_text string, clean_text string, parse_warning string"
    shape = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                rows = []
                for page in part.column("html").to_pylist():
                    try:
                        found, lines = blocks_and_lines(page or "")
                        rows.append((found, "\n\n".join(b["text"] for b in found), "\n\n".join(lines), None))
                    except PageError as error:
                        rows.append(([], "", "", str(error)))
                columns = [part.column("key").cast(shape.field("key").type), *(pa.array(c, shape.field(i + 1).type) for i, c in enumerate(zip(*rows, strict=True)))]
                yield pa.RecordBatch.from_arrays(columns, schema=shape)

    return source.mapInArrow(run, schema).withColumnRenamed("key", key)
