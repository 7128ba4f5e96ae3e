"""Web pages as sections: headings open them, the text of paragraphs, items and cells goes to the one that is open."""

from __future__ import annotations

from dataclasses import dataclass, field
from html.parser import HTMLParser

from quarry.functions.normalize import display_text

# Fixed values that the data model prescribes.
DROPPED = ("script", "style", "noscript", "svg", "template")
HEADINGS = {f"h{i}": i + 1 for i in range(1, 7)}
TEXTS = ("p", "li", "td", "th", "dd", "dt", "pre")
ROOT_ID, ROOT_TAG = "details", "main"
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
CAPSULE = 1200
#: What begins ends what is still open of these, up to the element that holds them.
ENDS = {"li": (("li",), ("ul", "ol")), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "tr": (("tr",), ("table",)), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",))}
#: What begins ends a paragraph.
BLOCKS = ("p", "div", "ul", "ol", "dl", "table", "pre", "main", "section", "article", "header", "footer", "nav", "blockquote", "form", "hr", *HEADINGS)


def clean(text: str) -> str:
    return " ".join(display_text(text).split())


def capsule(title: str, text: str, limit: int = CAPSULE) -> str:
    """A section in short: its title and the beginning of its text."""
    whole = "\n".join(x for x in (title, " ".join(text.split())) if x)
    return whole if len(whole) <= limit else whole[: limit - 1].rstrip() + "…"


@dataclass
class Section:
    title: str
    parent: str
    path: str
    level: int
    texts: list[str] = field(default_factory=list)

    @property
    def text(self) -> str:
        return "\n\n".join(self.texts)


class _Reader(HTMLParser):
    """Headings and texts in order, of the whole page and of its root; a text within another counts once, where it stands."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[str] = []
        self.found: list[tuple[str, str, int]] = []  # tag, text, which root it is in
        self.buffers: list[tuple[str, list[str]]] = []
        self.titles: dict[str, str] = {}
        self.dropped = 0
        self.roots: list[tuple[int, int]] = []  # (depth at which it was opened, rank)

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            if tag == "br":
                self.handle_data(" ")
            if tag == "hr":
                self.end_open(("p",), ("body",))
            return
        if tag in BLOCKS:
            self.end_open(("p",), ("li", "td", "th", "dd", "dt", "div", "main", "section", "article", "body"))
        if tag in ENDS:
            self.end_open(*ENDS[tag])
        self.open.append(tag)
        self.dropped += tag in DROPPED
        if dict(attrs).get("id") == ROOT_ID:
            self.roots.append((len(self.open), 2))
        elif tag == ROOT_TAG:
            self.roots.append((len(self.open), 1))
        if tag in HEADINGS or tag in TEXTS or tag == "title":
            self.buffers.append((tag, []))

    def handle_endtag(self, tag):
        if tag not in self.open:
            return
        while self.open:
            top = self.open.pop()
            self.dropped -= top in DROPPED
            if self.buffers and top == self.buffers[-1][0]:
                self.close_buffer()
            while self.roots and self.roots[-1][0] > len(self.open):
                self.roots.pop()
            if top == tag:
                return

    def end_open(self, tags: tuple[str, ...], holders: tuple[str, ...]):
        for tag in reversed(self.open):
            if tag in tags:
                self.handle_endtag(tag)
                return
            if tag in holders:
                return

    def close_buffer(self):
        tag, words = self.buffers.pop()
        text = clean(" ".join(words))
        if not text:
            return
        if tag in ("title", "h1", "h2"):
            self.titles.setdefault(tag, text)
        if tag != "title":
            self.found.append((tag, text, max((r for _, r in self.roots), default=0)))

    def handle_data(self, data):
        if self.buffers and not self.dropped:
            self.buffers[-1][1].append(data)

    def close(self):
        super().close()
        while self.buffers:
            self.close_buffer()


def sections(html: str | None, above: tuple[str, ...] = ()) -> list[Section]:
    """The sections that have text, below the page's title (and ``above``).

    The root is the element named ``details``, else ``main``, else the whole page.  A heading that only repeats the page's
    title opens nothing; text before any heading belongs to the page itself.
    """
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    title = next((reader.titles[t] for t in ("title", "h1", "h2") if t in reader.titles), "")
    root = max((r for _, _, r in reader.found), default=0)
    base = [x for x in (*above, title) if x]
    stack: list[tuple[int, str]] = []
    out: list[Section] = []
    for tag, text, rank in reader.found:
        if rank < root:
            continue
        if tag in HEADINGS:
            if text.casefold() == title.casefold():
                continue
            level = HEADINGS[tag]
            stack = [x for x in stack if x[0] < level] + [(level, text)]
            out.append(Section(text, stack[-2][1] if len(stack) > 1 else title, " / ".join([*base, *(t for _, t in stack)]), level))
            continue
        if not out:
            out.append(Section(title, base[-2] if len(base) > 1 else title, " / ".join(base), 1))
        out[-1].texts.append(text)
    return [s for s in out if s.texts]
