"""HTML extraction: a tree with implied tags, visibility rules, and a plain-text layout of all visible text.

Blocks are kept apart (paragraph-like ones by an empty line), list items get
their marks and indents, and tables of several columns keep aligned cells.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchforge.llm.common import slices, small_batches, tidied

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes textarea title".split())
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure fieldset".split())
BLOCKS = PARAGRAPHS | frozenset(
    "html body div section article header footer nav aside main address form li dt dd tr td th thead tbody tfoot caption "
    "figcaption details summary center legend hgroup menu dir search optgroup option".split()
)
#: An open element that a new start tag of these names ends, and the elements that stop the search for it.
ENDS = {
    "p": ("p", frozenset("address article aside blockquote center details dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())),
    "li": ("li", frozenset(["li"])),
    "dt": ("dt", frozenset(["dt", "dd"])),
    "dd": ("dd", frozenset(["dt", "dd"])),
    "option": ("option", frozenset(["option", "optgroup"])),
    "td": ("td", frozenset("td th tr tbody thead tfoot".split())),
    "th": ("th", frozenset("td th tr tbody thead tfoot".split())),
    "tr": ("tr", frozenset("tr tbody thead tfoot".split())),
    "thead": ("thead", frozenset("tbody thead tfoot".split())),
    "tbody": ("tbody", frozenset("tbody thead tfoot".split())),
    "tfoot": ("tfoot", frozenset("tbody thead tfoot".split())),
    "head": ("head", BLOCKS - {"html"}),
}
WALLS = {name: frozenset("ul ol menu".split()) if name == "li" else frozenset(["dl"]) if name in ("dt", "dd") else frozenset(["table"]) for name in ENDS}
WALLS["p"] = frozenset("table td th caption button object".split())
HIDDEN = frozenset("head script style template noscript iframe object audio video canvas datalist noembed noframes meta link title desc defs symbol metadata".split())
#: Cells of tables with several columns are wrapped at this width; longer words stand out.
CELL = 60
#: Where only parts of tables may stand; all else found there is put before the table.
IN_TABLE = frozenset("table tbody thead tfoot tr".split())
TABLE_PARTS = frozenset("caption colgroup col tbody thead tfoot tr td th style script template".split())
TABLE_ROWS = frozenset("caption colgroup tbody thead tfoot tr td th".split())
#: Types of input fields whose values aren't shown as text.
NO_TEXT = frozenset("hidden checkbox radio file image password range color".split())

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
PLAIN = re.compile(r"[^\"'>]*")
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
SPACES = re.compile(r"[ \t\n\r\f]+")
#: What a style sheet's braces are looked for without: comments and strings.
ASIDE = re.compile(r"/\*.*?(?:\*/|\Z)|<!--|-->|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'", re.DOTALL)
BRACE = re.compile(r"([^{}]*)([{}]|\Z)")
SHOWS = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([\w-]+)([^;]*)", re.IGNORECASE)
EVERYWHERE = frozenset(["", "all", "screen", "only all", "only screen"])
COMPOUND = re.compile(r"(\*|[\w-]+)?((?:[.#][\w-]+)*)")


class Node:
    __slots__ = ("attributes", "children", "name")

    def __init__(self, name: str, attributes: str = ""):
        self.name, self.attributes, self.children = name, attributes, []

    def get(self) -> dict[str, str]:
        """Attributes by lower-case name; the first of a name counts."""
        found: dict[str, str] = {}
        for m in ATTRIBUTE.finditer(self.attributes):
            found.setdefault(m[1].lower(), unescape(m[2] or m[3] or m[4] or ""))
        return found


def everywhere(media: str) -> bool:
    """Does a list of media queries take in every screen?"""
    return any(" ".join(q.lower().split()) in EVERYWHERE for q in media.split(","))


def rules(sheet: str) -> Iterator[tuple[str, str]]:
    """Selectors and declarations of a style sheet, without those in @-blocks that depend on a medium or another condition."""
    path: list[list] = []  # what is open: the selectors, "" for an @-block; whether it counts; the declarations so far
    for m in BRACE.finditer(ASIDE.sub(" ", sheet)):
        text, sign = m.groups()
        if sign == "{":
            before, _, head = text.rpartition(";")
            head = head.strip()
            if path and path[-1][0]:
                path[-1][2] += before + ";"
            counts = not path or path[-1][1] and not path[-1][0]  # nested rules have no simple selector
            if head.startswith("@"):
                name, _, condition = head.replace("(", " (", 1).partition(" ")
                path.append(["", counts and (name.lower() == "@layer" or name.lower() == "@media" and everywhere(condition)), ""])
            else:
                path.append([head, counts, ""])
        elif path:
            head, counts, own = path.pop()
            if head and counts:
                yield head, own + text


Said = dict[str, list[tuple]]


def said_by(sheet: str, n: int) -> Iterator[tuple[str, tuple]]:
    """What a style sheet says of display and visibility, by a name, class or id that its compound selectors need.

    Each is (compound, property, rank, value); of what is said of an element the
    largest rank counts: importance, ids, classes, names, place.
    """
    for selectors, declared in rules(sheet):
        for said in SHOWS.finditer(declared):
            n += 1
            important = "!important" in said[3].lower().replace(" ", "")
            for selector in selectors.lower().split(","):
                m = COMPOUND.fullmatch(selector.strip())
                if not m or not m[0]:
                    continue
                own = re.findall(r"[.#][\w-]+", m[2])
                ids, classes = sum(x[0] == "#" for x in own), sum(x[0] == "." for x in own)
                name = m[1] if m[1] and m[1] != "*" else ""
                rank = (important, ids, classes, bool(name), n)
                yield own[-1] if own else name or "*", (frozenset([*own, *filter(None, [name])]), said[1].lower(), rank, said[2].lower())


def tree(html: str) -> tuple[Node, Said]:
    """The element tree, and what style sheets say by selector. Elements may stand in each other to any depth."""
    root = Node("#root")
    path, holders = [root], [[root]]  # open elements, and the lists of children that hold them
    n_open: dict[str, int] = {}
    said: Said = {}
    at, end = 0, len(html)

    def shut(k: int) -> None:
        for node in path[k:]:
            n_open[node.name] -= 1
        del path[k:], holders[k:]

    def put(child: Node | str, name: str = "") -> list:
        """Append to the innermost open element; what can't stand in a table goes before it."""
        of = path[-1]
        if of.name in IN_TABLE and name not in TABLE_PARTS and (name or child.strip(" \t\n\r\f")):
            k = next((k for k in range(len(path) - 1, 0, -1) if path[k].name == "table"), 0)
            if k:
                where = next(i for i in range(len(holders[k]) - 1, -1, -1) if holders[k][i] is path[k])
                holders[k].insert(where, child)
                return holders[k]
        of.children.append(child)
        return of.children

    def open_(node: Node) -> None:
        holders.append(put(node, node.name))
        path.append(node)
        n_open[node.name] = n_open.get(node.name, 0) + 1

    def text(part: str) -> None:
        if part:
            put(unescape(part) if "&" in part else part)

    def close(name: str, stop: frozenset[str] = frozenset()) -> bool:
        if not n_open.get(name):
            return False
        for k in range(len(path) - 1, 0, -1):
            if path[k].name == name:
                shut(k)
                return True
            if path[k].name in stop:
                return False
        return False

    while at < end:
        i = html.find("<", at)
        if i < 0:
            text(html[at:])
            break
        text(html[at:i])
        after = html[i + 1 : i + 2]
        if html.startswith("<!--", i):
            j = html.find("-->", i + 4)
            at = end if j < 0 else j + 3
        elif after in ("!", "?") or after == "/" and not NAME.match(html, i + 2):
            j = html.find(">", i)
            at = end if j < 0 else j + 1
        elif after == "/":
            name = NAME.match(html, i + 2)[0].lower()
            j = html.find(">", i)
            at = end if j < 0 else j + 1
            if name == "br":
                put(Node("br"), "br")
            elif name == "p" and not n_open.get("p"):
                put(Node("p"), "p")
            elif name not in VOID:
                close(name, frozenset(["table"]) if name not in ("table", "body", "html") else frozenset())
        elif m := NAME.match(html, i + 1):
            name = m[0].lower()
            j = m.end()
            while True:  # to the end of the tag; a quote counts after = only
                j = PLAIN.match(html, j).end()
                if j >= end or html[j] == ">":
                    break
                k = html.find(html[j], j + 1) if html[max(0, j - 8) : j].rstrip().endswith("=") else j
                j = end if k < 0 else k + 1
            if j >= end:
                break  # the file ends within a tag
            node = Node(name, html[m.end() : j])
            at = j + 1
            for ended, (_, starts) in ENDS.items():
                if name in starts:
                    close(ended, WALLS[ended])
            if name in TABLE_ROWS and n_open.get("table"):  # back from what was put before the table
                shut(1 + max(k for k, of in enumerate(path) if of.name in IN_TABLE))
            if name in ("td", "th") and path[-1].name in ("table", "tbody", "thead", "tfoot"):
                open_(Node("tr"))
            if name in RAW:
                put(node, name)
                m = re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE).search(html, at)
                inner = html[at : m.start() if m else end]
                j = html.find(">", m.end()) if m else -1
                at = end if j < 0 else j + 1
                if name == "style":
                    if everywhere(node.get().get("media", "")):
                        for key, one in said_by(inner, sum(map(len, said.values()))):
                            said.setdefault(key, []).append(one)
                else:
                    node.children.append(unescape(inner) if name in ("textarea", "title") else inner)
            elif name in VOID:
                put(node, name)
            else:
                open_(node)
        else:
            text("<")
            at = i + 1
    return root, said


def performed(work: Iterator) -> None:
    """Run a generator and those that it yields, innermost first: recursion without a limit of depth."""
    stack = [work]
    while stack:
        inner = next(stack[-1], None)
        if inner is None:
            stack.pop()
        else:
            stack.append(inner)


def wrapped(text: str) -> list[str]:
    """Lines of a cell, cut between words where they are longer than `CELL`."""
    found = []
    for line in text.split("\n"):
        if len(line) <= CELL:
            found.append(line)
            continue
        own = ""
        for word in line.split(" "):
            if own and len(own) + 1 + len(word) > CELL:
                found.append(own)
                own = word
            else:
                own = f"{own} {word}" if own else word
        found.append(own)
    return found


class Layout:
    """Lines of text with pending spaces and block breaks. What may nest is a generator that yields the inner work."""

    def __init__(self, said: Said, shown: bool = True):
        self.said = said
        self.shown = shown
        self.lines: list[str] = []
        self.line: list[str] = []
        self.indent = ""
        self.mark = ""
        self.gap = 0
        self.space = False

    def visible(self, node: Node) -> bool:
        """Is the element laid out at all?"""
        return self.styles(node)[0]

    def styles(self, node: Node) -> tuple[bool, bool | None]:
        """Is the element laid out, and what its visibility is set to (None: as around it)?"""
        if node.name in HIDDEN:
            return False, None
        a = node.get() if node.attributes else {}
        if "hidden" in a or node.name == "dialog" and "open" not in a or node.name == "input" and a.get("type", "").lower() == "hidden":
            return False, None
        found: dict[str, tuple] = {}
        if self.said:
            own = {node.name, *(f".{c}" for c in a.get("class", "").lower().split()), *([f"#{a['id'].lower()}"] if a.get("id") else [])}
            for key in (*own, "*"):
                for needs, prop, rank, value in self.said.get(key, ()):
                    if needs <= own:
                        found[prop] = max(found.get(prop, (rank, value)), (rank, value))
        for n, m in enumerate(SHOWS.finditer(a.get("style", "")) if "style" in a else ()):
            new = (("!important" in m[3].lower().replace(" ", ""), 1_000_000, 0, False, n), m[2].lower())
            found[m[1].lower()] = max(found.get(m[1].lower(), new), new)
        set_to = found["visibility"][1] if "visibility" in found else ""
        visibility = False if set_to in ("hidden", "collapse") else True if set_to in ("visible", "initial") else None
        return "display" not in found or found["display"][1] != "none", visibility

    def flush(self) -> None:
        if self.line:
            if self.gap and self.lines and self.lines[-1]:
                self.lines.append("")
            self.lines.append((self.indent[: len(self.indent) - len(self.mark)] + self.mark if self.mark else self.indent) + "".join(self.line).rstrip())
            self.line, self.mark, self.gap = [], "", 0
        self.space = False

    def words(self, text: str) -> None:
        if not self.shown:
            return
        if not text.strip(" \t\n\r\f"):
            self.space = self.space or bool(text and self.line)
            return
        if text[0] in " \t\n\r\f":
            self.space = True
        if self.space and self.line:
            self.line.append(" ")
        self.line.append(SPACES.sub(" ", text).strip(" "))
        self.space = text[-1] in " \t\n\r\f"

    def block(self, node: Node, wide: bool) -> Iterator:
        self.flush()
        self.gap |= wide
        yield self.children(node)
        self.flush()
        self.gap |= wide

    def children(self, node: Node) -> Iterator:
        for child in node.children:
            if isinstance(child, str):
                self.words(child)
            else:
                yield self.show(child)

    def show(self, node: Node) -> Iterator:
        laid_out, visibility = self.styles(node)
        if not laid_out:
            return
        around = self.shown
        self.shown = around if visibility is None else visibility
        yield self.inner(node)
        self.shown = around

    def inner(self, node: Node) -> Iterator:
        name = node.name
        if name == "br":
            if self.line:
                self.flush()
            else:
                self.gap = 1
        elif name == "pre":
            self.flush()
            self.gap = 1
            for k, part in enumerate("".join(texts(node, self)).strip("\n").split("\n")):
                self.line = [part] if part.strip() else []
                if self.line or k == 0:
                    self.flush()
                else:
                    self.lines.append("")
            self.gap = 1
        elif name in ("ul", "ol", "menu", "dir"):
            yield self.list(node)
        elif name == "table":
            yield self.table(node)
        elif name == "details" and "open" not in node.get():
            for child in node.children:
                if isinstance(child, Node) and child.name == "summary":
                    yield self.block(child, False)
                    break
        elif name == "hr":
            self.flush()
            self.gap = 1
        elif name == "input":
            a = node.get()
            self.words("" if a.get("type", "").lower() in NO_TEXT else a.get("value", "") or a.get("placeholder", ""))
        elif name in BLOCKS:
            yield self.block(node, name in PARAGRAPHS)
        elif name == "q":
            self.words('"')
            yield self.children(node)
            self.words('"')
        else:
            yield self.children(node)

    def list(self, node: Node) -> Iterator:
        self.flush()
        outer = not self.indent
        self.gap |= outer
        a = node.get()
        count = int(a["start"]) if re.fullmatch(r"-?[0-9]{1,9}", a.get("start", "")) else 1
        for child in node.children:
            if isinstance(child, str):
                self.words(child)
                continue
            laid_out, visibility = self.styles(child)
            if child.name != "li" or not laid_out:
                yield self.show(child)
                continue
            self.flush()
            if node.name == "ol":
                own = child.get().get("value", "")
                count = int(own) if re.fullmatch(r"-?[0-9]{1,9}", own) else count
                mark = f"{count}. "
                count += 1
            else:
                mark = "- "
            before, around = self.indent, self.shown
            self.indent, self.mark, self.shown = before + " " * len(mark), mark, around if visibility is None else visibility
            yield self.children(child)
            self.flush()
            self.indent, self.mark, self.shown = before, "", around
        self.flush()
        self.gap |= outer

    def table(self, node: Node) -> Iterator:
        self.flush()
        self.gap = 1
        grid: list[dict[int, list[str]]] = []
        until: dict[int, int] = {}  # the row up to which a cell from above reaches, by column
        for row, shown in rows(node, self):
            y = len(grid)
            grid.append({})
            x = 0
            for cell in row.children:
                if not isinstance(cell, Node) or cell.name not in ("td", "th"):
                    continue
                laid_out, visibility = self.styles(cell)
                if not laid_out:
                    continue
                while until.get(x, 0) > y:
                    x += 1
                a = cell.get() if cell.attributes else {}
                wide, tall = (min(int(v[:9]), most) if (v := a.get(k, "1")).isascii() and v.isdigit() and int(v[:9]) else 1 for k, most in SPANS)
                inner = Layout(self.said, shown if visibility is None else visibility)
                yield inner.children(cell)
                inner.flush()
                grid[y][x] = inner.lines
                for taken in range(x, x + wide):
                    until[taken] = y + tall
                x += wide
        for child in node.children:
            if isinstance(child, Node) and child.name == "caption":
                yield self.show(child)
        columns = sorted({x for r in grid for x in r})
        if len(columns) > 1:
            grid = [{x: wrapped("\n".join(lines)) for x, lines in r.items()} for r in grid]
        width = {x: min(CELL, max((len(line) for r in grid for line in r.get(x, ())), default=0)) for x in columns}
        for r in grid:
            for k in range(max(map(len, r.values()), default=0)):
                parts = [r[x][k] if x in r and k < len(r[x]) else "" for x in columns]
                last = max((i for i, part in enumerate(parts) if part), default=-1)
                self.line = ["  ".join([part.ljust(width[x]) for x, part in zip(columns[: last + 1], parts, strict=False)])] if last >= 0 else []
                self.flush()
        self.gap = 1


#: Attributes of cells that reach over columns or rows, and the most that the standard lets them (fixed values).
SPANS = (("colspan", 1000), ("rowspan", 65534))


def rows(table: Node, layout: Layout) -> Iterator[tuple[Node, bool]]:
    """Rows that are laid out, and their visibility."""
    stack = [(child, layout.shown) for child in reversed(table.children)]
    while stack:
        node, shown = stack.pop()
        if isinstance(node, Node) and node.name in ("tr", "thead", "tbody", "tfoot"):
            laid_out, visibility = layout.styles(node)
            shown = shown if visibility is None else visibility
            if laid_out and node.name == "tr":
                yield node, shown
            elif laid_out:
                stack += [(child, shown) for child in reversed(node.children)]


def texts(pre: Node, layout: Layout) -> Iterator[str]:
    """Visible text as it stands."""
    stack: list[tuple] = [(child, layout.shown) for child in reversed(pre.children)]
    while stack:
        node, shown = stack.pop()
        if isinstance(node, str):
            if shown:
                yield node
        elif node.name == "br":
            yield "\n"
        else:
            laid_out, visibility = layout.styles(node)
            shown = shown if visibility is None else visibility
            stack += [(child, shown) for child in reversed(node.children)] if laid_out else []


def visible_text(html: str | None) -> str | None:
    """All visible text of a page, laid out in lines; null for null.

    Text that only stands in for what isn't shown (alternatives of images and
    objects) isn't visible; values and placeholders of input fields are.
    """
    if html is None:
        return None
    root, said = tree(html)
    layout = Layout(said)
    performed(layout.children(root))
    layout.flush()
    return "\n".join(layout.lines).strip("\n")


def extracted(pages: DataFrame, html: str = "html") -> DataFrame:
    """`pages` with the column of markup replaced by `text`, its visible text.

    A null page gives a null text, an empty one or one without visible text an
    empty text; broken markup is read as far as it goes and pages count whole;
    repeated rows repeat, an empty table stays empty, all other columns stay and
    one named text is overwritten.
    """

    @F.arrow_udf("string")
    @tidied
    def shown(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in batches:
            yield pa.array([visible_text(h) for some in slices(part) for h in some.to_pylist()], pa.string())

    return small_batches(pages).withColumn("__text", shown(F.col(html))).drop(html, "text").withColumnRenamed("__text", "text")
