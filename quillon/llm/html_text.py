"""Text of HTML pages as a reader would see it.

A tree builder opens and closes elements with the tags that HTML leaves implied, and a
renderer lays the visible ones out: paragraphs apart by a blank line, other blocks on lines
of their own, list items with a bullet or their number under the indent of their list, and
table cells in columns of equal width.

* hidden are scripts, styles, templates and the head, elements with the attribute
  ``hidden``, ``aria-hidden="true"`` or an inline style ``display: none`` or
  ``visibility: hidden``, closed ``details`` but for their summary, hidden inputs, and
  what a style sheet of the page hides by a plain tag, class or id selector; of drawings
  and formulas, definitions, descriptions and annotations
* text, pictures and inputs of a table row outside its cells come before the table
* a null page gives an empty text, like a page with nothing visible
* texts of any length are read whole, in time proportional to their length; a tag that
  never ends is text from its ``<`` on
* a cell spans at most 1000 columns, as HTML has it; tables in more than ``NESTED`` tables
  come out as lines
* repeated rows stay; an empty table gives an empty result; columns of the input named
  ``text`` give way
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from quillon.llm.common import extended

#: Classes of HTML elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style template noscript title meta link base iframe object audio video canvas noembed noframes datalist annotation annotation-xml desc metadata defs symbol".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table ul caption tr tbody thead tfoot td th".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure hr".split())
#: An open element that the start of one of these closes.
CLOSED_BY = {
    "p": frozenset("address article aside blockquote center details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul li dt dd".split()),
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "option": frozenset(["option", "optgroup"]),
    "optgroup": frozenset(["optgroup"]),
    "td": frozenset(["td", "th", "tr", "tbody", "thead", "tfoot"]),
    "th": frozenset(["td", "th", "tr", "tbody", "thead", "tfoot"]),
    "tr": frozenset(["tr", "tbody", "thead", "tfoot"]),
    "tbody": frozenset(["tbody", "thead", "tfoot"]),
    "thead": frozenset(["tbody", "thead", "tfoot"]),
    "tfoot": frozenset(["tbody", "thead", "tfoot"]),
    "head": frozenset(["body"]) | (BLOCK - {"html"}),
}
#: Implied ends don't reach beyond these.
FENCE = {"li": frozenset(["ul", "ol", "menu"]), "dt": frozenset(["dl"]), "dd": frozenset(["dl"])}
_FENCE = frozenset(["table", "td", "th", "caption", "button", "object", "template"])
_TABLE = frozenset(["table", "template"])
_PARTS = frozenset(["td", "th", "tr", "tbody", "thead", "tfoot"])
#: The open elements that the start of a tag closes.
CLOSES = {tag: tuple(o for o, by in CLOSED_BY.items() if tag in by) for tag in frozenset().union(*CLOSED_BY.values())}

#: Columns that a line is moved in at most, however deep its list lies: text stays in proportion to its page.
INDENT = 40
#: Tables nested deeper than this come out as lines, not as columns.
NESTED = 20

_TOKEN = re.compile(r"<!--(?:.*?-->|.*$)|<[!?][^>]*>?|</?[a-zA-Z]|[^<]+|<", re.S)
_IN_TAG = re.compile("[>\"']")
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"([^\s=\"'<>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPACE = re.compile(r"[ \t\n\r\f]+")
_NONE = re.compile(r"display\s*:\s*none", re.I)
_VISIBILITY = re.compile(r"visibility\s*:\s*(hidden|collapse|visible)", re.I)
_BRACE = re.compile(r"[{};]")
_COMMENT = re.compile(r"/\*.*?(?:\*/|$)", re.S)
#: Media of which a reader at a screen sees nothing.
_ELSEWHERE = re.compile(r"@media\s+(?:only\s+)?(?:print|speech|aural|braille|embossed|handheld|projection|tty|tv)\b[^,]*$", re.I)
_SELECTOR = re.compile(r"[.#]?[a-zA-Z][\w-]*$")


class Node:
    __slots__ = ("tag", "attributes", "children")

    def __init__(self, tag: str, attributes: dict[str, str]):
        self.tag, self.attributes, self.children = tag, attributes, []


def attributes_of(tag: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(tag, _NAME.match(tag).end()):
        out.setdefault(m[1].lower(), unescape(m[2] or m[3] or m[4] or ""))
    return out


def tree(page: str) -> tuple[Node, str]:
    """The document's root and the text of its style sheets."""
    root, styles = Node("#root", {}), []
    stack, at = [root], 0
    # where in the stack the open elements of each tag are
    places: defaultdict[str, list[int]] = defaultdict(list)

    # quotes that open inside a tag without an end: each is found out once
    astray: set[int] = set()

    def tag_end(k: int) -> int:
        """Where the tag ends whose inside begins at ``k``; 0 if it never does."""
        seen = []
        while (m := _IN_TAG.search(page, k)) and m.start() not in astray:
            if m[0] == ">":
                return m.end()
            seen.append(m.start())
            k = page.find(m[0], m.end()) + 1
            if not k:
                break
        astray.update(seen)
        return 0

    def close(k: int) -> None:
        for node in stack[k:]:
            places[node.tag].pop()
        del stack[k:]

    def nearest(tags) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    last = page.rfind(">")
    while m := _TOKEN.match(page, at):
        token, at = m[0], m.end()
        if token[0] == "<" and token[-1].isalpha() and len(token) < 4:
            end = tag_end(at) if at <= last else 0
            start = m.start()
            token, at = (page[start:end], end) if end else ("<", start + 1)
        if token[0] != "<" or token == "<":
            stack[-1].children.append(token)
            continue
        name = _NAME.match(token)
        if not name:
            continue
        tag = name[1].lower()
        if token[1] == "/":
            k = nearest((tag,))
            if k and (tag in _TABLE or k > nearest(_TABLE)):
                close(k)
            continue
        # implied ends: innermost first, as far as a fence
        while tag in CLOSES and (k := nearest(CLOSES[tag])):
            if k < nearest(FENCE.get(tag, _TABLE if tag in _PARTS else _FENCE)):
                break
            close(k)
        node = Node(tag, attributes_of(token) if len(token) > len(name[0]) + 1 else {})
        stack[-1].children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(page, at)
            body, at = (page[at : end.start()], end.end()) if end else (page[at:], len(page))
            if tag == "style":
                styles.append(body)
            elif tag in ("textarea", "title"):
                node.children.append(body)
        elif tag not in VOID and not token.endswith("/>"):
            places[tag].append(len(stack))
            stack.append(node)
    return root, "\n".join(styles)


def hidden_by_sheet(sheet: str) -> frozenset[str]:
    """Simple selectors whose elements a screen doesn't show, in one pass over the sheet.

    Rules inside ``@media`` for other media, and inside other at-rules but ``@supports`` and
    ``@layer``, don't count.
    """
    out: set[str] = set()
    sheet = _COMMENT.sub(" ", sheet)
    open_: list[bool] = []  # whether each open block's rules count
    at = 0
    selector = None
    for m in _BRACE.finditer(sheet):
        part = sheet[at : m.start()].strip() if m[0] != ";" else ""
        if m[0] == ";":
            if selector is None:
                at = m.end()  # a statement between rules
            continue
        if m[0] == "{":
            if part.startswith("@"):
                keyword = part[1:].split(None, 1)[0].lower() if len(part) > 1 else ""
                open_.append((not open_ or open_[-1]) and keyword in ("media", "supports", "layer") and not _ELSEWHERE.match(part))
                selector = None
            else:
                selector = part
                open_.append(not open_ or open_[-1])
        else:
            if selector is not None and open_ and open_[-1]:
                found = _VISIBILITY.findall(part)
                if _NONE.search(part):
                    out |= {s.strip() for s in selector.split(",") if _SELECTOR.match(s.strip())}
                elif found:
                    hides = found[-1].lower() != "visible"
                    out |= {("!" if hides else "+") + s.strip() for s in selector.split(",") if _SELECTOR.match(s.strip())}
            if open_:
                open_.pop()
            selector = None
        at = m.end()
    return frozenset(out)


def _named(node: Node, hidden: frozenset[str], mark: str = "") -> bool:
    a = node.attributes
    return f"{mark}{node.tag}" in hidden or bool(a) and (f"{mark}#{a.get('id')}" in hidden or any(f"{mark}.{c}" in hidden for c in a.get("class", "").split()))


def visible(node: Node, hidden: frozenset[str]) -> bool:
    """Whether the element and what is in it are shown at all, visibility aside."""
    a = node.attributes
    if node.tag in UNSEEN or node.tag == "dialog" and "open" not in a or hidden and _named(node, hidden):
        return False
    if not a:
        return True
    return not ("hidden" in a or a.get("aria-hidden", "").lower() == "true" or node.tag == "input" and a.get("type", "").lower() == "hidden" or "style" in a and _NONE.search(a["style"]))


def veiled(node: Node, hidden: frozenset[str], before: bool) -> bool:
    """Whether visibility hides the element's own text; what is in it may be shown again."""
    a = node.attributes
    if "style" in a and (found := _VISIBILITY.findall(a["style"])):
        return found[-1].lower() != "visible"
    if not hidden:
        return before
    return not _named(node, hidden, "+") and (before or _named(node, hidden, "!"))


class Page:
    """Lines of text; ``gap`` is how many line ends the next text needs before it."""

    def __init__(self, hidden: frozenset[str], depth: int = 0):
        self.out: list[str] = []
        self.depth = depth
        self.hidden, self.gap, self.space, self.indent, self.marker = hidden, 0, False, 0, ""

    def block(self, lines: int) -> None:
        if self.out:
            self.gap = max(self.gap, lines)
        self.space = False

    def write(self, text: str) -> None:
        if self.gap or not self.out:
            self.out.append("\n" * self.gap + " " * max(0, min(self.indent, INDENT) - len(self.marker)) + self.marker)
            self.gap, self.marker = 0, ""
        elif self.space:
            self.out.append(" ")
        self.out.append(text)
        self.space = False

    def text(self, raw: str, pre: bool) -> None:
        raw = unescape(raw)
        if pre:
            for k, line in enumerate(raw.split("\n")):
                if k:
                    self.gap = self.gap + 1 if self.out else 0
                if line.strip():
                    self.write(line.rstrip())
            return
        parts = _SPACE.sub(" ", raw)
        if parts.strip(" "):
            self.space |= parts[0] == " "
            self.write(parts.strip(" "))
            self.space = parts[-1] == " "
        elif parts:
            self.space = True

    def __str__(self) -> str:
        return "".join(self.out)


def render(node: Node, page: Page, veil: bool = False) -> None:
    """Walks the tree with a stack of its own, as pages may nest deeply; ``veil``: visibility hides what isn't shown again."""
    work: list[tuple] = [("open", node, False, [], veil)]
    while work:
        step, node, pre, lists, veil = work.pop()
        if step == "call":
            node()
            continue
        if isinstance(node, str):
            if not veil:
                page.text(node, pre)
            continue
        tag = node.tag
        if tag == "br":
            page.gap, page.space = page.gap + 1 if page.out else 0, False
            continue
        if not visible(node, page.hidden):
            continue
        veil = veiled(node, page.hidden, veil)
        if tag == "table" and page.depth < NESTED:
            page.block(2)
            for line in table(node, page.hidden, page.depth + 1, veil):
                page.write(line)
                page.block(1)
            page.block(2)
            continue
        if tag in ("img", "input"):
            if not veil and (shown := node.attributes.get("alt" if tag == "img" else "value", "").strip()):
                page.text(shown, False)
            continue
        if tag == "hr":
            page.block(2)
            continue
        inside, after = lists, None
        if tag in BLOCK:
            nested = bool(lists) and tag in ("ul", "ol")
            gap = 1 if nested or tag not in SPACED else 2
            page.block(gap)
            before = page.indent
            if tag in ("ul", "ol", "menu"):
                start = node.attributes.get("start", "")
                inside = [[tag, int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1]]
            elif tag == "li":
                kind = lists[-1] if lists else ["ul", 1]
                page.marker = f"{kind[1]}. " if kind[0] == "ol" else "- "
                kind[1] += 1
                page.indent += len(page.marker)
            elif tag in ("dd", "blockquote"):
                page.indent += 2

            def after(before=before, gap=gap):
                page.indent, page.marker = before, ""
                page.block(gap)

        children = node.children
        if tag == "details" and "open" not in node.attributes:
            children = [c for c in children if isinstance(c, Node) and c.tag == "summary"]
        if after:
            work.append(("call", after, pre, lists, veil))
        work.extend(("open", c, pre or tag in ("pre", "textarea"), inside, veil) for c in reversed(children))


def table(node: Node, hidden: frozenset[str], depth: int, veil: bool = False) -> list[str]:
    """Caption and rows; cells are padded to the width of their column."""
    caption, rows = [], []
    work = [(iter(node.children), veil)]
    while work:
        child, veil = next(work[-1][0], None), work[-1][1]
        if child is None:
            work.pop()
        elif isinstance(child, str):
            if child.strip(" \t\n\r\f"):
                caption.append(_cell(child, hidden, depth, veil))
        elif visible(child, hidden):
            veil = veiled(child, hidden, veil)
            if child.tag == "tr":
                bare = [isinstance(c, str) or c.tag in ("img", "input") for c in child.children]
                caption += [_cell(c, hidden, depth, veil) for c, b in zip(child.children, bare, strict=True) if b]
                cells = [c for c, b in zip(child.children, bare, strict=True) if not b and visible(c, hidden)]
                rows.append([(_cell(c, hidden, depth, veiled(c, hidden, veil)), c.attributes.get("colspan", "1")) for c in cells])
            elif child.tag in ("tbody", "thead", "tfoot"):
                work.append((iter(child.children), veil))
            elif child.tag in ("td", "th"):
                rows.append([(_cell(child, hidden, depth, veil), "1")])
            elif child.tag not in ("col", "colgroup"):
                caption.append(_cell(child, hidden, depth, veil))
    grid, widths = [], {}
    for row in rows:
        line, column = [], 0
        for text, span in row:
            line.append((column, text))
            if span == "1":
                widths[column] = max(widths.get(column, 0), len(text))
            column += min(int(span), 1000) if span.isdecimal() and int(span) else 1
        grid.append(line)
    out = [c for c in caption if c]
    for line in grid:
        at, shown = 0, ""
        for k, (column, text) in enumerate(line):
            start = sum(widths.get(c, 0) + 3 for c in range(at, column)) if k == 0 and column else 0
            end = line[k + 1][0] if k + 1 < len(line) else column + 1
            width = sum(widths.get(c, 0) for c in range(column, end)) + 3 * (end - column - 1)
            shown += " " * start + (text.ljust(width) + " | " if k + 1 < len(line) else text)
        if shown.strip(" |"):
            out.append(shown.rstrip())
    return out


def _cell(node: Node | str, hidden: frozenset[str], depth: int, veil: bool = False) -> str:
    inner = Page(hidden, depth)
    wrap = Node("span", {})
    wrap.children = [node] if isinstance(node, str) or node.tag in ("img", "input") else node.children
    render(wrap, inner, veil)
    return _SPACE.sub(" ", str(inner)).strip()


def text_of(page: str | None) -> str:
    if not page:
        return ""
    root, sheet = tree(page)
    out = Page(hidden_by_sheet(sheet))
    render(root, out)
    return str(out)


def extract(pages: DataFrame, html: str = "html", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all but ``html`` by default) and the page's ``text``."""
    kept = [c for c in (pages.columns if keep is None else keep) if c not in ("text", html)]
    source = pages.select(*kept, pages[html].alias("__html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                rows = batch.slice(start, 64)
                texts = pa.array((text_of(v.as_py()) for v in rows.column("__html")), pa.string())
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in kept), texts], names=[*kept, "text"])

    return source.mapInArrow(run, extended(source.drop("__html").schema, "text string"))
