"""The page parser against trees that are written as pages, with and without the tags that may stay open."""

import random
import re

import pytest
from pyspark.sql import functions as F

from filingforge.functions import markup
from filingforge.operators import blocks, sections

CLOSABLE = {"p", "li", "td", "tr"}
WORDS = ["alpha", "beta & co", "gamma < 3", "délta", "é 1", "x"]


def inline(r, depth=0):
    out = []
    for _ in range(r.randrange(1, 4)):
        kind = r.choice(["text", "text", "text", "b", "i", "span", "br"])
        if kind == "text" or depth > 2:
            out.append(r.choice(WORDS) + r.choice([" ", "", "\n  "]))
        else:
            out.append((kind, [] if kind == "br" else inline(r, depth + 1)))
    return out


def flow(r, depth=0):
    out = []
    for _ in range(r.randrange(1, 4)):
        kind = r.choice(["p", "p", "h2", "div", "ul", "table", "blockquote"] if depth < 3 else ["p", "h3"])
        if kind in ("p", "h2", "h3"):
            out.append((kind, inline(r)))
        elif kind == "ul":
            out.append((kind, [("li", inline(r)) for _ in range(r.randrange(1, 3))]))
        elif kind == "table":
            cell = lambda: ("td", flow(r, depth + 2) if r.random() < 0.4 else inline(r))
            out.append((kind, [("tr", [cell() for _ in range(r.randrange(1, 3))]) for _ in range(r.randrange(1, 3))]))
        else:
            out.append((kind, flow(r, depth + 1) if r.random() < 0.7 else inline(r)))
    return out


def written(nodes, xml, r, last=True):
    out = []
    for i, node in enumerate(nodes):
        if isinstance(node, str):
            out.append(node.replace("&", "&amp;").replace("<", "&lt;"))
            continue
        name, inner = node
        if name == "br":
            out.append("<br/>" if xml else r.choice(["<br>", "<br/>", "<BR class='a>b'>"]))
            continue
        followed = i + 1 < len(nodes) and isinstance(nodes[i + 1], tuple) and nodes[i + 1][0] in markup.BLOCK
        open_end = not xml and name in CLOSABLE and r.random() < 0.5 and (followed or i + 1 == len(nodes))
        out.append(f"<{name if xml or r.random() < 0.8 else name.upper()}{r.choice(['', ' id="a"', " title='1 > 0'"])}>{written(inner, xml, r)}{'' if open_end else f'</{name}>'}")
    return "".join(out)


def expected(nodes):
    """Blocks of a tree: (type, text, tables)."""
    blocks, run = [], []

    def flush(kind="text", tables=0):
        text = re.sub(r"\s+", " ", "".join(t for t, _, _ in run)).strip()
        if text:
            solid = [b for t, b, _ in run if t.strip()]
            title = kind == "text" and (any(h for t, _, h in run if t.strip()) or all(solid))
            blocks.append(("title" if title else kind, text, tables))
        run.clear()

    def text_of(node):
        if isinstance(node, str):
            return node
        return " " + "".join(map(text_of, node[1])) + " " if node[0] in markup.BLOCK or node[0] == "br" else "".join(map(text_of, node[1]))

    def count(node):
        return 0 if isinstance(node, str) else (node[0] == "table") + sum(map(count, node[1]))

    def walk(node, bold, head):
        if isinstance(node, str):
            run.append((node, bold, head))
            return
        name, inner = node
        if name == "table":
            flush()
            run.append((text_of(node), False, False))
            flush("table", count(node))
        elif name == "br":
            run.append((" ", bold, head))
        else:
            if name in markup.BLOCK:
                flush()
            for child in inner:
                walk(child, bold or name in ("b", "strong"), head or name in markup.TITLES)
            if name in markup.BLOCK:
                flush()

    def spread(nodes):
        for n in nodes:
            walk(n, False, False)
        flush()

    spread(nodes)
    # Two breaks in a row end a block; one is a space. Bold and heads are those of each part's own text.
    return blocks


def without_double_breaks(nodes):
    """The tree without a break that has no letter between it and the break before."""
    state = {"after": False}

    def keep(node):
        if isinstance(node, str):
            state["after"] = state["after"] and not node.strip()
            return node
        if node[0] == "br":
            if state["after"]:
                return None
            state["after"] = True
            return node
        if node[0] in markup.BLOCK:
            state["after"] = False
        inner = [k for k in map(keep, node[1]) if k is not None]
        if node[0] in markup.BLOCK:
            state["after"] = False
        return (node[0], inner)

    return [k for k in map(keep, nodes) if k is not None]


@pytest.mark.parametrize("xml", [False, True])
def test_like_the_tree(xml):
    nested = 0
    for seed in range(1500):
        r = random.Random(seed)
        tree = without_double_breaks(flow(r))
        body = written(tree, xml, r)
        page = f'<?xml version="1.0"?><html><body>{body}</body></html>' if xml else r.choice([f"<!DOCTYPE html><html><title>T</title><body>{body}", body])
        found, _ = markup.blocks_and_lines(page)
        want = [(k, t, n) for k, t, n in expected(tree)]
        assert [(b["type"], b["text"], b["tables"]) for b in found] == [w for w in want if w[1]], page
        full = "\n\n".join(b["text"] for b in found)
        assert all(full[b["start"] :].startswith(b["text"]) for b in found)
        nested += any(b["tables"] > 1 for b in found)
    assert nested > 50


def kinds(page):
    return [(b["type"], b["text"]) for b in markup.blocks_and_lines(page)[0]]


def test_odd_pages():
    assert kinds("<p>one <b>two</b> three<p>four") == [("text", "one two three"), ("text", "four")]
    assert kinds("<div><b>All bold</b> <br></div>tail") == [("title", "All bold"), ("text", "tail")]
    assert kinds("a<br> <br>b<br>c") == [("text", "a"), ("text", "b c")]
    assert kinds("<table><tr><td>1<td><table><tr><td>2</table>3<tr><td>4</table>after") == [("table", "1 2 3 4"), ("text", "after")]
    assert kinds("<p>a</div></span>b<script>var x = '<p>no</p>';</script>c<!-- <p>no --><style>p{}") == [("text", "abc")]
    assert kinds("a<script>if (a<b && c == 'it') d = \"</p>\"</SCRIPT >b<noscript>gone") == [("text", "ab")]
    assert kinds("x <3 and &amp;lt; &nbsp; y < z") == [("text", "x <3 and < y < z")]
    assert kinds("<?xml version='1.0'?><a><ix:nonNumeric x='1'/><p>In <ix:p>line</ix:p><![CDATA[ <raw> & ]]></p><br></br>z</a>") == [("text", "In"), ("text", "line"), ("text", "<raw> &"), ("text", "z")]
    assert kinds("<p title=\"open>text<p>more") == [("text", "text"), ("text", "more")] and kinds("") == kinds("<>") [:0] == []
    lines = markup.blocks_and_lines("<p>Nav</p><p>Nav <b>x</b></p><p>" + "long " * 10 + "</p><p>" + "long " * 10 + "</p>")[1]
    assert lines == ["Nav", "x", ("long " * 10).strip(), ("long " * 10).strip()]


def test_cost_grows_with_the_page():
    import time

    for page in ("<p a=\"" * 20_000, "<" * 200_000, "<b>" * 4000 + "x" * 100_000, "<td>" * 4000, "</p>" * 50_000):
        began = time.perf_counter()
        markup.blocks_and_lines(page)
        assert time.perf_counter() - began < 10
    with pytest.raises(markup.PageError):
        markup.blocks_and_lines("<div>" * (markup.DEEPEST + 1))


def test_a_broken_page_is_one_error_row(spark):
    good = "<h2>Item 1A. Risk Factors</h2><p>" + "risk " * 300 + "</p>"
    rows = [(1, good, "x"), (2, "<div>" * 6000, "x"), (3, "a\x00b", "x"), (4, None, "x"), (5, "", "x"), (None, good, "x")]
    pages = spark.createDataFrame(rows, "filing_id long, html string, blocks string").repartition(2)
    got = {(r.filing_id, r.section): r.parse_error for r in blocks.extract(pages, "10-K", errors=True).collect()}
    a1 = blocks.RISKS
    assert got == {(1, a1): None, (None, a1): None, (2, None): "tags are nested too deeply", (3, None): "not a text"}
    assert {r.filing_id for r in blocks.extract(pages, "10-K").collect()} == {1, None}


def test_extraction_reads_pages_once(spark, tmp_path):
    path = str(tmp_path / "pages")
    spark.createDataFrame([(i, f"<h2>Item 1A. Risk Factors</h2><p>{'risk ' * 300}</p>") for i in range(20)], "filing_id long, html string").write.parquet(path)
    out = blocks.extract(spark.read.parquet(path), "10-K")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Exchange" not in plan
    assert out.where(F.col("word_count") == 304).count() == 20


def test_last_resort_and_contents(spark):
    pages = spark.createDataFrame([(1, "<p>Item 1A risk here.</p>"), (2, "<p>Item 7. Management 12</p><p>" + "word " * 80 + "</p>")], "filing_id long, html string")
    got = {(r.filing_id, r.section): r for r in blocks.extract(pages, "10-K").collect()}
    assert got[1, blocks.RISKS].extraction_method == "last_resort" and "last_resort_extraction" in got[1, blocks.RISKS].warnings
    toc = lambda w, h: spark.range(1).select(sections.toc_like(F.lit(w), F.lit(h))).first()[0]
    assert toc("Item 7. Management ... 12", "item 7. management") and toc("7. x\t12", "7. management of") and toc("Item 1.05 9 ", "item 1.05")
    assert not toc("Item 7. Management 12", "item 7. management") and not toc("Item 3. Item 4. Item 5. text", "item 3. legal proceedings")
