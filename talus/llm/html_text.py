"""Operator 8: visible text of HTML pages, laid out as it is shown.

A tokenizer and a tree builder with implied tags (a block closes an open paragraph, an item its sibling, a cell its
neighbour, an unknown end tag nothing) give a tree; a renderer walks it. Hidden content (head, scripts, styles, templates,
comments, ``hidden`` attributes, ``display:none``, ``visibility:hidden``, ``aria-hidden``, hidden inputs) is left out.
Blocks stand on lines of their own, paragraphs, headings, lists and tables between blank lines, list items have a bullet
or number and an indent, table cells are padded to columns and reach over rows and columns by their spans, preformatted text keeps
its white space. Closed details show their summary, lists of choices the chosen one, buttons their text; what is made visible
again inside hidden content is shown. Style sheets of a page are not looked at.

Defined cases: null html gives an empty text; text without tags is one block; unclosed and crossed tags are closed by
their parents; a page of any length is rendered whole; tables nested more than ``NESTED_TABLES`` deep are laid out as blocks, and
elements deeper than ``MAX_DEPTH`` hold nothing, as in browsers: what follows stands beside them; other columns are not read unless named in
``keep``; repeated rows give the same text, and nothing is compared between rows; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talus.llm.common import map_texts

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes".split())
UNSEEN = frozenset("head script style title template noscript iframe object svg math datalist noembed noframes".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure fieldset".split())
BLOCKS = SPACED | frozenset(
    "html body address article aside center dd details dialog div dt fieldset figcaption footer form header hgroup hr li "
    "main menu nav section summary tr caption thead tbody tfoot".split()
)
#: A start tag closes these, if they are open inside the nearest of the second set.
_LIST, _TABLE = frozenset("ul ol menu".split()), frozenset(("table",))
CLOSES = {
    "li": ({"li"}, _LIST), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, _TABLE), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot"}, _TABLE), "tbody": ({"thead", "tbody", "tfoot"}, _TABLE),
    "tfoot": ({"thead", "tbody", "tfoot"}, _TABLE), "option": ({"option"}, {"select"}), "body": ({"head"}, set()),
}
P_CLOSERS = (BLOCKS - {"html", "body", "tr", "thead", "tbody", "tfoot", "caption"}) | {"body"}
#: What a table holds outside its cells; a start tag goes back to the nearest of its set, and anything else stands before the table.
CONTEXT = frozenset("table thead tbody tfoot tr colgroup".split())
BACK = {
    "caption": _TABLE, "colgroup": _TABLE, "thead": _TABLE, "tbody": _TABLE, "tfoot": _TABLE, "col": frozenset(("table", "colgroup")),
    "tr": CONTEXT - {"tr", "colgroup"}, "td": CONTEXT - {"colgroup"}, "th": CONTEXT - {"colgroup"},
}
INSIDE = frozenset(BACK) | frozenset("form script style template".split())
BUTTONS = frozenset("submit reset button".split())
#: An end tag does not reach past these.
SCOPES = frozenset(("table", "td", "th", "caption"))

#: A tag that never ends reaches to the end of the page, so the search never goes over text twice.
TOKEN = re.compile(
    r"<!--(?:.*?-->|.*)|<[!?][^>]*+(?:>|\Z)|"
    r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))*+)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=/\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"']+)))?")
NESTED_TABLES, MAX_DEPTH = 40, 512
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.I)
UNPAINTED, PAINTED = re.compile(r"visibility\s*:\s*hidden", re.I), re.compile(r"visibility\s*:\s*visible", re.I)
NOT_LAID_OUT = re.compile(r"display\s*:\s*none|visibility\s*:\s*collapse", re.I)
SPACE = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None):
        self.tag, self.attrs, self.children = tag, attrs or {}, []


def parse(html: str) -> Node:
    """The tree of a page: children are nodes and strings."""
    root = Node("")
    stack, at = [root], 0
    raw_end: re.Match | None
    while at < len(html):
        token = TOKEN.search(html, at)
        text = html[at : token.start() if token else len(html)]
        if text:
            text = unescape(text) if "&" in text else text
            if stack[-1].tag in CONTEXT and SPACE.sub("", text):
                before_table(stack, text)
            else:
                stack[-1].children.append(text)
        if not token:
            break
        at = token.end()
        if not token[2]:
            continue
        tag = token[2].lower()
        if token[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                if stack[k].tag in SCOPES and tag not in ("table", "tr", "tbody", "thead", "tfoot", "body", "html"):
                    break
            continue
        if tag in P_CLOSERS:
            close(stack, {"p"}, SCOPES)
        if tag in CLOSES:
            close(stack, *CLOSES[tag])
        if tag in BACK:
            back(stack, tag)
        elif tag == "table" and stack[-1].tag in CONTEXT:
            del stack[table_at(stack) :]
        attrs = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(token[3])} if token[3].strip(" /") else None
        node, loose = Node(tag, attrs), stack[-1].tag in CONTEXT
        if loose and tag not in INSIDE:
            before_table(stack, node)
        else:
            stack[-1].children.append(node)
        if loose and tag == "form":
            continue
        if tag in RAW:
            raw_end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
            inner = html[at : raw_end.start() if raw_end else len(html)]
            node.children.append(unescape(inner) if tag in ("textarea", "title") else inner)
            at = raw_end.end() if raw_end else len(html)
        elif tag not in VOID and not token[3].endswith("/") and len(stack) < MAX_DEPTH:
            stack.append(node)
    return root


def table_at(stack: list[Node]) -> int:
    """Where the innermost open table is, or 0."""
    return next((k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == "table"), 0)


def before_table(stack: list[Node], child: Node | str) -> None:
    """Content outside cells stands in front of its table, which is the last child of its parent while it is open."""
    k = table_at(stack)
    if k:
        stack[k - 1].children.insert(-1, child)
    else:
        stack[-1].children.append(child)


def back(stack: list[Node], tag: str) -> None:
    """Close what is open inside the table up to where ``tag`` belongs, and open the row that a cell implies."""
    for k in range(len(stack) - 1, 0, -1):
        if stack[k].tag in BACK[tag]:
            del stack[k + 1 :]
            if tag in ("td", "th") and stack[k].tag != "tr" and len(stack) < MAX_DEPTH:
                row = Node("tr")
                stack[k].children.append(row)
                stack.append(row)
            return
        if stack[k].tag in ("td", "th"):
            return


def close(stack: list[Node], tags: set[str] | frozenset[str], within: set[str] | frozenset[str]) -> None:
    """Close the innermost open ``tags`` and what is in them, unless one of ``within`` is nearer."""
    for k in range(len(stack) - 1, 0, -1):
        if stack[k].tag in tags:
            outer = k
            while outer > 1 and stack[outer - 1].tag in tags:
                outer -= 1
            del stack[outer:]
            return
        if stack[k].tag in within:
            return


def visible(node: Node) -> bool:
    return visible_by(node.tag, node.attrs)


def visible_by(tag: str, a: dict[str, str]) -> bool:
    if tag in UNSEEN:
        return False
    if not a:
        return True
    return not (
        "hidden" in a or a.get("aria-hidden", "").lower() == "true" or (tag == "input" and a.get("type", "").lower() == "hidden")
        or ("style" in a and HIDDEN.search(a["style"]))
    )


def painted_inside(node: Node) -> list[Node]:
    """What is shown of a node that is not: the nearest nodes in it that are made visible again, where only visibility hides it."""
    def hides_by_paint(x: Node) -> bool:
        style = x.attrs.get("style", "")
        a = dict(x.attrs, style="")
        return bool(UNPAINTED.search(style)) and not NOT_LAID_OUT.search(style) and visible_by(x.tag, a)

    found, todo = [], [node] if hides_by_paint(node) else []
    while todo:
        for x in reversed(todo.pop().children):
            if isinstance(x, Node):
                if PAINTED.search(x.attrs.get("style", "")) and visible(x):
                    found.append(x)
                elif visible(x) or hides_by_paint(x):
                    todo.append(x)
    return found


def chosen(select: Node) -> str:
    """What a closed list of choices shows: the selected option, or else the first; all of them where several may be."""
    options, todo = [], [select]
    while todo:
        node = todo.pop()
        if isinstance(node, Node):
            if node.tag == "option" and visible(node):
                options.append(node)
            else:
                todo.extend(reversed(node.children))
    if "multiple" not in select.attrs:
        options = [x for x in options if "selected" in x.attrs][-1:] or options[:1]
    return " ".join(render(plain_block(x)) for x in options)


def plain_block(node: Node) -> Node:
    """The children of a node as those of a block without rules of its own."""
    inner = Node("div")
    inner.children = node.children
    return inner


class Page:
    """Lines being laid out; ``gap`` is how many line ends are due before the next text."""

    def __init__(self):
        self.out: list[str] = []
        self.gap, self.space, self.indent, self.mark = 0, False, 0, ""

    def block(self, gap: int) -> None:
        self.gap, self.space = max(self.gap, gap if self.out else 0), False

    def text(self, text: str, keep: bool) -> None:
        words = text if keep else SPACE.sub(" ", text)
        if not keep:
            if words[:1] == " ":
                self.space, words = True, words[1:]
            ends, words = words[-1:] == " ", words.rstrip(" ")
            if not words:
                self.space = self.space or ends
                return
        fresh = self.gap > 0 or not self.out
        if self.gap:
            self.out.append("\n" * self.gap)
        if fresh:
            lead = " " * self.indent
            self.out.append(lead[: max(0, len(lead) - len(self.mark))] + self.mark if self.mark else lead)
            self.mark = ""
        elif self.space:
            self.out.append(" ")
        self.out.append(words.replace("\n", "\n" + " " * self.indent) if keep else words)
        self.gap, self.space = 0, not keep and ends


def render(root: Node, depth: int = 0) -> str:
    """Lay a tree out; ends of nodes are on the stack as functions, so nesting is no limit."""
    page = Page()
    todo: list = [(root, False, None)]
    while todo:
        item, keep, items = todo.pop()
        if callable(item):
            item()
        elif isinstance(item, str):
            page.text(item, keep)
        elif item.tag == "br":
            page.gap, page.space = page.gap + 1 if page.out else 0, False
        elif not visible(item):
            todo.extend((x, keep, items) for x in reversed(painted_inside(item)))
        elif item.tag == "select":
            page.text(chosen(item), False)
        elif item.tag == "input":
            if item.attrs.get("type", "").lower() in BUTTONS:
                page.text(item.attrs.get("value", ""), False)
        elif item.tag == "table" and depth < NESTED_TABLES:
            page.block(2)
            for line in table_lines(item, depth + 1):
                page.text(line, True)
                page.block(1)
            page.block(2)
        elif item.tag == "img":
            if item.attrs.get("alt"):
                page.text(item.attrs["alt"], False)
        elif item.tag == "hr":
            page.block(1)
            page.text("-" * 20, True)
            page.block(1)
        else:
            tag = item.tag
            gap = 0 if tag not in BLOCKS else 2 if tag in SPACED and not (tag in _LIST and items is not None) else 1
            if gap:
                page.block(gap)
            if tag in _LIST:
                start = item.attrs.get("start", "1")
                items = [tag, int(start) if start.lstrip("-").isdigit() else 1]
            elif tag == "li":
                kind = items or ["ul", 1]
                page.mark = f"{kind[1]}. " if kind[0] == "ol" else "- "
                kind[1] += 1
            step = {"li": 3 if page.mark[:1].isdigit() else 2, "dd": 4, "blockquote": 2}.get(tag, 0)
            page.indent += step

            def end(gap=gap, step=step, tag=tag):
                page.indent -= step
                if tag == "li":
                    page.mark = ""
                if gap:
                    page.block(gap)

            todo.append((end, keep, items))
            keep = keep or tag in ("pre", "textarea", "xmp")
            children = item.children
            if tag == "details" and "open" not in item.attrs:
                children = [x for x in children if isinstance(x, Node) and x.tag == "summary"][:1]
            todo.extend((x, keep, items) for x in reversed(children))
    return "".join(page.out)


def table_lines(table: Node, depth: int) -> list[str]:
    """Rows of a table, cells padded to the width of their column and as high as they need; nested tables are laid out inside
    their cell."""
    rows: list[list[list[str]]] = []
    captions: list[str] = []
    todo, down = [*reversed(table.children)], {}  # column: rows below that a cell still reaches into

    def span(cell: Node, name: str) -> int:
        return min(max(int(n), 1), 1000) if (n := cell.attrs.get(name, "1")).isdigit() else 1

    def lines(node: Node) -> list[str]:
        found = "\n".join(x.rstrip() for x in render(plain_block(node), depth).split("\n")).strip("\n")
        return found.split("\n") if found else []

    while todo:
        node = todo.pop()
        if isinstance(node, str) or not visible(node):
            continue
        if node.tag == "tr":
            cells: list[list[str]] = []
            for c in node.children:
                if isinstance(c, Node) and visible(c) and c.tag in ("td", "th"):
                    while down.get(len(cells), 0):  # a cell of a row above reaches here
                        down[len(cells)] -= 1
                        cells.append([])
                    wide, high = (span(c, name) for name in ("colspan", "rowspan"))
                    down.update({len(cells) + k: high - 1 for k in range(wide)} if high > 1 else {})
                    cells.append(lines(c))
                    cells.extend([[]] * (wide - 1))
            for k in [k for k in down if k >= len(cells)]:
                down[k] = max(0, down[k] - 1)
            if cells:
                rows.append(cells)
        elif node.tag == "caption":
            captions.extend(lines(node))
        else:
            todo.extend(reversed(node.children))
    widths: list[int] = []
    for cells in rows:
        widths.extend([0] * (len(cells) - len(widths)))
        for k, c in enumerate(cells):
            widths[k] = max([widths[k], *map(len, c)])
    out = captions
    for cells in rows:
        for n in range(max([1, *map(len, cells)])):
            out.append("  ".join((c[n] if n < len(c) else "").ljust(w) for c, w in zip(cells, widths)).rstrip())
    return out


def visible_text(html: str | None) -> str:
    """The text of a page: lines without trailing space, at most one blank line in a row outside preformatted text."""
    if not html:
        return ""
    lines = [x.rstrip() for x in render(parse(html)).split("\n")]
    return "\n".join(lines).strip("\n")


def extract(pages: DataFrame, keep=("page_id",)) -> DataFrame:
    """``keep`` columns and the text of each page."""
    fields = {"visible": (T.StringType(), pa.string())}
    return map_texts(pages, keep, lambda texts: [list(map(visible_text, texts))], fields, column="html")


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    found = extract(pages.select("page_id", "url", "html"), keep=["page_id", "url"])
    return found.select("page_id", "url", "visible", F.char_length("visible").cast("long").alias("n_chars"))
