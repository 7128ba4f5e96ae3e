"""HTML to text as it is laid out: all visible text, with block spacing, lists and aligned table cells.

A tokenizer and a tree builder (implied html, body, tbody and tr; end tags implied by what follows; stray end tags
ignored; raw text elements) give a tree, which a renderer without recursion walks:

* paragraphs, headings, lists, tables and the like stand between blank lines, other blocks on lines of their own;
* list items have a dash or their number and hang under it; quotations begin with ``> ``; terms' descriptions are indented;
* a table's columns are as wide as their widest cell (WIDEST characters are padded to at most), ``colspan`` respected;
* white space collapses but in ``pre``, ``textarea`` and no-break spaces; ``br`` and ``hr`` break lines.

Not visible: head, scripts, styles, templates, noscript, media and form controls without text, elements with ``hidden``,
``display: none`` or ``visibility: hidden`` in their style or by a simple rule (element, class or id) of a style sheet on
the page, and what a closed ``details`` holds beside its summary.  Of several rules the one that CSS prefers decides
(importance, the element's own style, layers, specificity, order).  Rules of ``@media`` hold if a screen of SCREEN pixels meets the query;
a query with another feature does not hold, nor do rules of other at-rules than ``@supports`` and ``@layer``.

Formulas show their text without annotations, fractions' parts set apart; drawings (svg) what their text elements hold, each on its own line.

Defined cases: null or empty HTML is the empty text; text without tags is rendered as such; unclosed comments and raw
text end with the page; nesting may be of any depth; repeated rows each get a row; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import arrow_map, tune

WIDEST = 40
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?][^>]*>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s]+)))?")
_SPACE = re.compile(r"[ \t\n\r\f]+")
_CSS_SKIP = re.compile(r"/\*.*?(?:\*/|\Z)|<!--|-->|(\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*')", re.S)
_CSS_STOP = re.compile(r"[{};]")
_FEATURE = re.compile(r"\((min-|max-)?(width|height)\s*(:|[<>]=?)\s*(\d*\.?\d+)(px|em|rem)?\)")
SCREEN = {"width": 1280, "height": 720}
_SIMPLE = re.compile(r"(?:[a-zA-Z][\w-]*|\*)?(?:[.#][\w-]+)?$")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noframes template".split())
UNSEEN = frozenset("head script style title template noscript iframe noframes object audio video canvas annotation annotation-xml mphantom datalist area map param source track".split())
#: What a drawing holds but does not show where it stands.
UNDRAWN = frozenset("defs desc metadata symbol clippath mask pattern marker lineargradient radialgradient filter".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table pre blockquote figure fieldset hr menu".split())
BLOCKS = SPACED | frozenset("address article aside body caption center dd details dialog dir div dt figcaption footer form header hgroup html legend li main nav option optgroup section select summary tbody td tfoot th thead tr".split())
#: A start tag closes these open elements, up to the scope's end.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "caption"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "caption"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "caption"}, {"table"}),
}
ENDS_P = BLOCKS - {"body", "caption", "html", "legend", "li", "optgroup", "option", "select", "tbody", "td", "tfoot", "th", "thead", "tr"}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


class Node:
    __slots__ = ("tag", "attributes", "children")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.attributes, self.children = tag, attributes, []

    def get(self, name: str) -> str | None:
        if name not in self.attributes.lower():
            return None
        for m in _ATTRIBUTE.finditer(self.attributes):
            if m[1].lower() == name:
                return unescape(m[2] or m[3] or m[4] or "")
        return None


def build(html: str) -> tuple[Node, list[str]]:
    """(the html element, texts of style sheets)."""
    root = Node("html")
    body = Node("body")
    root.children.append(body)
    stack = [root, body]
    sheets: list[str] = []
    at, n = 0, len(html)

    def close(tags: set[str], scope: set[str]) -> None:
        for i in range(len(stack) - 1, 1, -1):
            if stack[i].tag in scope:
                return
            if stack[i].tag in tags:
                del stack[i:]
                # An outer one may be open as well: a cell in a row, both ended by the next row.
                close(tags, scope)
                return

    def open_(tag: str, attributes: str) -> Node:
        node = Node(tag, attributes)
        stack[-1].children.append(node)
        return node

    while at < n:
        m = _TAG.search(html, at)
        if m is None:
            stack[-1].children.append(html[at:])
            break
        if m.start() > at:
            stack[-1].children.append(html[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if name is None:
            continue
        tag, end, attributes = name.lower(), m[1] or m[4], (m[3] or m[6] or "")
        if tag in ("html", "body", "head"):
            if end and tag == "head" and len(stack) > 2 and any(x.tag == "head" for x in stack):
                close({"head"}, set())
            elif not end and tag == "head":
                stack.append(open_("head", attributes))
            elif not end and tag == "body":
                close({"head"}, set())
                body.attributes = attributes or body.attributes
            continue
        if end:
            if tag == "p" and not any(x.tag == "p" for x in stack[2:]):
                open_("p", "")
            elif tag == "br":
                open_("br", "")
            elif tag in HEADINGS:
                close(set(HEADINGS), {"table", "td", "th"})
            else:
                for i in range(len(stack) - 1, 1, -1):
                    if stack[i].tag == tag:
                        del stack[i:]
                        break
                    if stack[i].tag in ("td", "th", "caption") and tag not in ("table", "tr", "tbody", "thead", "tfoot", "td", "th", "caption"):
                        break
            continue
        if len(stack) > 2 and stack[-1].tag == "head" and tag not in ("title", "meta", "link", "base", "style", "script", "noscript", "template"):
            close({"head"}, set())
        if tag in ENDS_P:
            close({"p"}, {"table", "td", "th", "button", "object"})
        if tag in HEADINGS and stack[-1].tag in HEADINGS:
            stack.pop()
        if tag in CLOSES:
            close(*CLOSES[tag])
            if tag in ("td", "th") and stack[-1].tag != "tr" and any(x.tag == "table" for x in stack):
                if stack[-1].tag == "table":
                    stack.append(open_("tbody", ""))
                stack.append(open_("tr", ""))
            elif tag == "tr" and stack[-1].tag == "table":
                stack.append(open_("tbody", ""))
        node = open_(tag, attributes)
        if tag in RAW and not (attributes.endswith("/") and any(x.tag in ("svg", "math") for x in stack)):
            stop = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(html, at)
            text = html[at : stop.start()] if stop else html[at:]
            if tag == "style" and media_holds(node.get("media") or ""):
                sheets.append(text)
            elif tag == "textarea":
                node.children.append(text)
            if stop is None:
                break
            gt = html.find(">", stop.end() - 1)
            at = gt + 1 if gt >= 0 else n
        elif tag not in VOID and not attributes.endswith("/"):
            stack.append(node)
        elif tag not in VOID and tag in BLOCKS:
            stack.append(node)  # a slash closes nothing in HTML
    return root, sheets


def media_holds(query: str) -> bool:
    """Whether a screen of SCREEN pixels meets one of the media queries."""
    return not query.strip() or any(_query_holds(" ".join(q.lower().split())) for q in query.split(","))


def _query_holds(query: str) -> bool:
    denied = query.startswith("not ")
    kind, *features = re.split(r"\band\b", query.removeprefix("not ").removeprefix("only "))
    if kind.strip().startswith("("):
        kind, features = "all", [kind, *features]
    holds = kind.strip() in ("all", "screen")
    for f in features:
        f = f.strip()
        if m := _FEATURE.fullmatch(f):
            have, want = SCREEN[m[2]], float(m[4]) * (1 if m[5] == "px" else 16)
            sign = {"min-": ">=", "max-": "<="}.get(m[1], "==") if m[3] == ":" else m[3]
            holds &= {">=": have >= want, "<=": have <= want, "==": have == want, ">": have > want, "<": have < want}[sign]
        elif f in ("(orientation: portrait)", "(orientation:portrait)"):
            holds = False
        elif f not in ("(orientation: landscape)", "(orientation:landscape)"):
            return False
    return holds != denied


def declared(style: str) -> dict[str, tuple[bool, str]]:
    """display and visibility as the declarations set them, with their importance."""
    out: dict[str, tuple[bool, str]] = {}
    for d in style.split(";"):
        name, _, value = d.partition(":")
        name, value = name.strip().lower(), value.strip().lower()
        if name in ("display", "visibility") and value:
            bare = re.sub(r"\s*!\s*important$", "", value)
            important = bare != value
            if (name == "display" or bare in ("hidden", "collapse", "visible")) and important >= out.get(name, (False,))[0]:
                out[name] = important, bare
    return out


def sheet_rules(sheets: list[str]) -> dict[str, dict[str, tuple]]:
    """For each simple selector (element, .class, #id, or element with one of these) and property: (rank, value), the highest rank of CSS."""
    out: dict[str, dict[str, tuple]] = {}
    order = 0
    for sheet in sheets:
        css = _CSS_SKIP.sub(lambda m: '""' if m[1] else " ", sheet)
        at = start = 0
        # Open blocks: (kind, selectors or nothing, own declarations); rules within a rule or a block that does not hold are passed over.
        blocks: list[tuple[str, str, list[str]]] = []
        layers = 0
        while at <= len(css):
            m = _CSS_STOP.search(css, at)
            stop, end = (m[0], m.start()) if m else ("}", len(css))
            text = css[start:end].strip()
            at = start = end + 1
            if stop == "{":
                passed = bool(blocks) and blocks[-1][0] in ("rule", "passed")
                if passed:
                    kind = "passed"
                elif text.startswith("@"):
                    name, _, rest = text[1:].replace("(", " (", 1).partition(" ")
                    name = name.lower()
                    holds = name == "layer" or name == "media" and media_holds(rest) or name == "supports" and not rest.strip().lower().startswith("not")
                    kind = ("layer" if name == "layer" else "group") if holds else "passed"
                else:
                    kind = "rule"
                layers += kind == "layer"
                blocks.append((kind, text, []))
                continue
            if blocks and blocks[-1][0] == "rule" and text:
                blocks[-1][2].append(text)
            if stop == "}" and blocks:
                kind, selectors, own = blocks.pop()
                layers -= kind == "layer"
                if m is None and blocks:
                    at = start = len(css)  # the sheet's end closes what is open
                if kind != "rule":
                    continue
                found = declared(";".join(own))
                order += 1
                for x in selectors.split(",") if found else ():
                    x = x.strip()
                    if not x or not _SIMPLE.match(x):
                        continue
                    cut = min((i for i in (x.find("."), x.find("#")) if i >= 0), default=len(x))
                    element = x[:cut].lower()
                    key = ("" if element == "*" and cut < len(x) else element) + x[cut:]
                    weight = ("#" in x, "." in x, element not in ("", "*"))
                    for name, (important, value) in found.items():
                        rank = (important, False, not layers, weight, order)
                        if name not in (had := out.setdefault(key, {})) or had[name][0] < rank:
                            had[name] = rank, value
    return out


class Page:
    """Lines under construction."""

    __slots__ = ("lines", "line", "gap", "pre", "wants_space")

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.gap = False
        self.pre = 0
        self.wants_space = False

    def text(self, raw: str) -> None:
        text = unescape(raw) if "&" in raw else raw
        if self.pre:
            for i, part in enumerate(text.replace("\r\n", "\n").split("\n")):
                if i:
                    self.break_line(True)
                if part:
                    self._add(part)
            return
        text = _SPACE.sub(" ", text)
        if text == " ":
            self.wants_space = bool(self.line)
            return
        if not text:
            return
        core = text.strip(" ")
        if text[0] == " ":
            self.wants_space = bool(self.line)
        if self.wants_space and self.line:
            self.line.append(" ")
        self.wants_space = text[-1] == " "
        self._add(core)

    def _add(self, text: str) -> None:
        if not self.line and self.gap:
            if self.lines:
                self.lines.append("")
            self.gap = False
        self.line.append(text)

    def break_line(self, always: bool = False) -> None:
        self.wants_space = False
        if self.line or always:
            if not self.line and self.gap:
                self.gap = False
                if self.lines:
                    self.lines.append("")
            self.lines.append("".join(self.line).rstrip())
            self.line = []

    def put(self, lines: list[str], spaced: bool = False) -> None:
        self.break_line()
        if spaced:
            self.gap = True
        if lines and self.gap:
            if self.lines:
                self.lines.append("")
            self.gap = False
        self.lines += lines

    def done(self) -> list[str]:
        self.break_line()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return self.lines


def table_lines(rows: list[list[tuple[list[str], int]]]) -> list[str]:
    """Rows of (lines, columns spanned) as aligned text."""
    grid = [[cell for lines, span in row for cell in [lines, *([[]] * (span - 1))]] for row in rows]
    columns = max((len(r) for r in grid), default=0)
    width = [max((min(len(x), WIDEST) for r in grid if c < len(r) for x in r[c]), default=0) for c in range(columns)]
    out = []
    for r in grid:
        for i in range(max((len(cell) for cell in r), default=0)):
            parts = [(cell[i] if i < len(cell) else "").ljust(width[c]) for c, cell in enumerate(r)]
            out.append(" | ".join(parts).rstrip(" |") if not any(p.strip() for p in parts) else " | ".join(parts).rstrip())
    return out


def _hidden(node: Node, rules: dict[str, dict[str, tuple]]) -> tuple[bool, str | None]:
    """(not displayed at all, visibility that it sets)."""
    if node.tag in UNSEEN or node.tag == "input":
        return True, None
    low = node.attributes.lower() if node.attributes else ""
    best: dict[str, tuple] = {}
    if "hidden" in low and node.get("hidden") is not None:
        best["display"] = (), "none"
    if rules:
        names = [f".{c}" for c in (node.get("class") or "").split()]
        if i := node.get("id"):
            names.append(f"#{i}")
        for x in ("*", node.tag, *names, *(node.tag + x for x in names)):
            for name, found in rules.get(x, {}).items():
                if name not in best or best[name][0] < found[0]:
                    best[name] = found
    if "style" in low and (style := node.get("style")):
        for name, (important, value) in declared(_CSS_SKIP.sub(lambda m: '""' if m[1] else " ", style)).items():
            if name not in best or best[name][0] < (important, True):
                best[name] = (important, True), value
    if "display" in best and best["display"][1] == "none":
        return True, None
    if "visibility" in best:
        return False, "visible" if best["visibility"][1] == "visible" else "hidden"
    return False, None


def _number(text: str | None, default: int) -> int:
    m = re.match(r"\s*(-?\d{1,6})", text or "")
    return int(m[1]) if m else default


def render(html: str | None) -> str:
    """The page's visible text."""
    if not html:
        return ""
    root, sheets = build(html)
    rules = sheet_rules(sheets)
    page = Page()
    pages, tables, lists = [page], [], []
    shown = True
    drawn = ""  # in a drawing: "svg", or "text" within a text element
    todo: list = [("in", root)]
    while todo:
        step, x, *more = todo.pop()
        page = pages[-1]
        if step == "text":
            if shown and drawn != "svg":
                page.text(x)
            continue
        if step == "out":
            tag = x.tag
            if drawn == "text" and tag == "text" and more[2] == "svg":
                page.break_line()
            shown, drawn = more[0], more[2]
            if tag == "pre" or tag == "textarea":
                page.break_line()
                page.pre -= 1
            if tag in ("li", "blockquote", "dd") and more[1]:
                lines = pages.pop().done()
                parent = pages[-1]
                if tag == "li":
                    mark = more[1]
                    parent.put([(mark if i == 0 else " " * len(mark) if line else "") + line for i, line in enumerate(lines)])
                elif tag == "blockquote":
                    parent.put([("> " + line).rstrip() for line in lines], True)
                else:
                    parent.put(["    " + line if line else "" for line in lines])
            elif tag in ("td", "th") and more[1]:
                lines = pages.pop().done()
                tables[-1][-1].append((lines, max(1, min(100, _number(x.get("colspan"), 1)))))
            elif tag == "table":
                rows = tables.pop()
                pages[-1].put(table_lines([r for r in rows if r]), True)
            elif tag in ("ul", "ol", "menu", "dir"):
                lists.pop()
            page = pages[-1]
            if tag in BLOCKS:
                page.break_line()
                if tag in SPACED and not (tag in ("ul", "ol", "menu") and lists):
                    page.gap = bool(page.lines)
            continue
        gone, visibility = _hidden(x, rules)
        if gone or drawn and x.tag in UNDRAWN:
            continue
        tag, was, around = x.tag, shown, drawn
        if tag == "svg":
            drawn = "svg"
        elif drawn == "svg" and tag == "text":
            drawn = "text"
            page.break_line()
        elif drawn and tag == "foreignobject":
            drawn = ""
        if visibility:
            shown = visibility == "visible"
        if tag == "br":
            page.break_line(True)
            continue
        if tag in BLOCKS:
            page.break_line()
            if tag in SPACED and not (tag in ("ul", "ol", "menu") and lists):
                page.gap = bool(page.lines)
        extra = None
        if tag in ("ul", "ol", "menu", "dir"):
            lists.append([tag, _number(x.get("start"), 1)])
        elif tag == "li":
            if lists and lists[-1][0] == "ol":
                number = _number(x.get("value"), lists[-1][1])
                lists[-1][1] = number + 1
                extra = f"{number}. "
            else:
                extra = "- "
            pages.append(Page())
        elif tag in ("blockquote", "dd"):
            extra = " "
            pages.append(Page())
        elif tag == "table":
            tables.append([[]])
        elif tag == "tr" and tables:
            tables[-1].append([])
        elif tag in ("td", "th") and tables:
            extra = " "
            pages.append(Page())
        if tag == "pre" or tag == "textarea":
            pages[-1].pre += 1
        elif extra and page.pre:
            pages[-1].pre = page.pre
        todo.append(("out", x, was, extra, around))
        children = x.children
        if tag == "details" and x.get("open") is None:
            children = [c for c in children if isinstance(c, Node) and c.tag == "summary"][:1]
        if tag == "pre" and children and isinstance(children[0], str):
            children = [children[0].removeprefix("\n"), *children[1:]]
        if tag in ("mfrac", "mtable", "mtr"):
            children = [y for c in children for y in (c, " ")]
        for c in reversed(children):
            todo.append(("text", c) if isinstance(c, str) else ("in", c))
    return "\n".join(pages[0].done())


def extract(pages: DataFrame, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """page_id, text, n_chars, n_lines of every page."""
    tune(pages.sparkSession)

    def make():
        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [render(x) for x in batch.column("html").to_pylist()]
            return pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array([t.count("\n") + 1 if t else 0 for t in texts], pa.int64())],
                names=["id", "text", "n_chars", "n_lines"],
            )

        return f

    rows = pages.select(F.col(page_id).alias("id"), F.col(html).alias("html"))
    return arrow_map(rows, f"id {rows.schema['id'].dataType.simpleString()}, text string, n_chars bigint, n_lines bigint", make).withColumnRenamed("id", page_id)
