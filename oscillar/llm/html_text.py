"""HTML extraction by layout-aware rendering.

A small tree builder closes what HTML lets authors leave open (paragraphs, list items, cells, options ...), visibility rules
drop what a browser doesn't show, and a renderer lays the rest out: blocks on lines of their own, blank lines around
paragraphs and headings, list markers with indentation, preformatted text as it stands, and table cells padded to columns.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oscillar.llm.common import sliced, table

# Fixed values of the HTML standard: elements by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes noscript".split())
ESCAPABLE = frozenset("textarea title".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li listing main menu nav ol optgroup option p plaintext pre search section summary table ul".split()
)
SPACED = frozenset("blockquote dl figure h1 h2 h3 h4 h5 h6 hr ol p pre table ul fieldset".split())
UNSEEN = frozenset("head script style template noscript iframe noembed noframes object audio video canvas datalist title meta link annotation annotation-xml desc defs symbol metadata rp".split())
#: what may stand in a head; anything else ends it, as a body does.
IN_HEAD = frozenset("head base basefont bgsound link meta title noscript noframes style script template".split())
CLOSES_P = BLOCKS - {"body", "html", "li", "dd", "dt", "option", "optgroup", "legend", "figcaption"}
#: an opening tag ends an open element of these, up to the given borders.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir", "table"}),
    "dt": ({"dt", "dd"}, {"dl", "table"}),
    "dd": ({"dt", "dd"}, {"dl", "table"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "tr": ({"td", "th", "tr", "caption"}, {"table"}),
    "tbody": ({"td", "th", "tr", "thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "thead": ({"td", "th", "tr", "thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"td", "th", "tr", "thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "body": ({"head"}, {"html"}),
    "rt": ({"rt", "rp"}, {"ruby"}),
    "rp": ({"rt", "rp"}, {"ruby"}),
}
SCOPE = frozenset("table td th caption html body".split())
P_SCOPE = SCOPE | {"button"}

TOKEN = re.compile(r"""<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"'=]|=\s*"[^"]*"|=\s*'[^']*'|["'=])*?)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
VISIBILITY = re.compile(r"(?:^|;)\s*visibility\s*:\s*(visible|hidden|collapse)", re.I)
#: levels of indentation that are laid out; deeper blocks stay at the last of them.
DEEPEST = 40
NUMBER = re.compile(r"-?\d{1,9}", re.A)
DIGITS = re.compile(r"[ \t\n\r\f]*\+?(\d+)", re.A)
MOST_SPAN = {"colspan": 1000, "rowspan": 65534}
#: inputs that show their value; one without a type is a text.
VALUED = frozenset("submit button reset text search tel url email number date month week time datetime-local".split())
#: a rule of a style sheet, and what its declarations say of boxes and visibility.
COMMENT, RULE = re.compile(r"/\*.*?(?:\*/|\Z)", re.S), re.compile(r"([^{}]*)\{([^{}]*)\}")
SIMPLE = re.compile(r"(?:[a-z][a-z0-9]*|[.#][\w-]+)")
DISPLAY = re.compile(r"(?:^|;)\s*display\s*:\s*([a-z-]+)", re.I)
SPACES = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []


def attributes(source: str) -> dict[str, str]:
    out: dict[str, str] = {}
    if source.strip():
        for name, value in ATTRIBUTE.findall(source):
            out.setdefault(name.lower(), html.unescape(value.strip("\"'")) if value else "")
    return out


def build(source: str) -> Node:
    """The element tree; text is a string among the children."""
    root = Node("#root", {})
    stack = [root]
    places: dict[str, list[int]] = defaultdict(list)  # where the open elements of a tag lie in the stack
    at, end = 0, len(source)

    def innermost(tags) -> int:
        return max((places[t][-1] for t in tags if t in places and places[t]), default=0)

    def close(tags, borders) -> None:
        """Ends the innermost open element of these tags and all within it, unless a border lies between."""
        k = innermost(tags)
        if k > innermost(borders):
            while len(stack) > k:
                places[stack.pop().tag].pop()

    def push(node: Node) -> None:
        places[node.tag].append(len(stack))
        stack.append(node)

    while at < end:
        m = TOKEN.search(source, at)
        stop = m.start() if m else end
        if stop > at:
            text = html.unescape(source[at:stop])
            if stack[-1].tag == "head" and text.strip():
                close({"head"}, ())
            stack[-1].children.append(text)
        if not m:
            break
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if tag == "p" and not places["p"]:
                stack[-1].children.append(Node("p", {}))
            elif tag == "br":
                stack[-1].children.append(Node("br", {}))
            else:
                close({tag}, SCOPE - {tag} if tag not in ("table", "tr", "tbody", "thead", "tfoot", "body", "html") else {"table"} - {tag})
            continue
        if stack[-1].tag == "head" and tag not in IN_HEAD:
            close({"head"}, ())
        if tag in CLOSES_P:
            close({"p"}, P_SCOPE)
        if tag in ENDS:
            inner, borders = ENDS[tag]
            before = -1
            while before != len(stack):  # a row ends the cell and the row before it
                before = len(stack)
                close(inner, borders)
        if tag in ("td", "th") and stack[-1].tag in ("table", "tbody", "thead", "tfoot"):
            row = Node("tr", {})
            stack[-1].children.append(row)
            push(row)
        node = Node(tag, attributes(m[3]))
        stack[-1].children.append(node)
        if tag == "plaintext":  # nothing after it is markup
            node.children.append(source[at:])
            break
        if tag in RAW or tag in ESCAPABLE:
            found = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*>?", re.I).search(source, at)
            stop = found.start() if found else end
            node.children.append(html.unescape(source[at:stop]) if tag in ESCAPABLE else source[at:stop])
            at = found.end() if found else end
        elif tag not in VOID:
            push(node)
    return root


def style_rules(root: Node) -> dict[str, tuple[bool | None, bool | None]]:
    """(has no box, is visible) by simple selector (a tag, a class or an id) from the page's own style elements.

    Later rules win. Rules within at-rules, which hold for some media only, and other selectors are passed over.
    """
    rules: dict[str, tuple[bool | None, bool | None]] = {}
    work: list = [root]
    while work:
        node = work.pop()
        if isinstance(node, str):
            continue
        if node.tag != "style":
            work += reversed(node.children)
            continue
        sheet = COMMENT.sub(" ", "".join(c for c in node.children if isinstance(c, str)))
        for selectors, said in RULE.findall(top_level(sheet)):
            display, visibility = DISPLAY.search(said), VISIBILITY.search(said)
            if display or visibility:
                for name in (x.strip() for x in selectors.split(",")):
                    if SIMPLE.fullmatch(name):
                        before = rules.get(name, (None, None))
                        rules[name] = (display[1].lower() == "none" if display else before[0], visibility[1].lower() == "visible" if visibility else before[1])
    return rules


def top_level(sheet: str) -> str:
    """A style sheet without its at-rules."""
    out, at, depth, skipped = [], 0, 0, -1
    for m in re.finditer(r"[{};@]", sheet):
        c = m[0]
        if c == "@" and depth == 0 and skipped < 0:
            out.append(sheet[at : m.start()])
            skipped = 0
        elif c == "{":
            depth += 1
        elif c == "}":
            depth = max(0, depth - 1)
            if skipped >= 0 and depth == 0:
                skipped, at = -1, m.end()
        elif c == ";" and skipped >= 0 and depth == 0:
            skipped, at = -1, m.end()
    return "".join(out) + (sheet[at:] if skipped < 0 else "")


def ruled(node: Node, rules: dict, which: int) -> bool | None:
    """What the sheet says of a node: an id's rule comes before those of classes, and these before a tag's."""
    names = ["#" + node.attrs.get("id", ""), *("." + c for c in reversed(node.attrs.get("class", "").split())), node.tag]
    return next((rules[n][which] for n in names if n in rules and rules[n][which] is not None), None)


def hidden(node: Node, rules: dict | None = None) -> bool:
    """What a browser lays out no box for."""
    a = node.attrs
    if node.tag in UNSEEN or node.tag == "dialog" and "open" not in a or node.tag == "input" and a.get("type", "").lower() == "hidden":
        return True
    own = DISPLAY.search(a["style"]) if "style" in a else None
    if own:
        return own[1].lower() == "none"
    told = ruled(node, rules, 0) if rules else None
    return "hidden" in a if told is None else told


def shown(node: Node, before: bool, rules: dict | None = None) -> bool:
    """Whether the text of an element is visible: it inherits that, and may set it anew."""
    found = VISIBILITY.search(node.attrs["style"]) if "style" in node.attrs else None
    if found:
        return found[1].lower() == "visible"
    told = ruled(node, rules, 1) if rules else None
    return before if told is None else told


def svg_texts(node: Node, rules: dict | None = None) -> list[Node]:
    """The text elements and embedded pages of a drawing; its other text is not drawn."""
    out, work = [], list(reversed(node.children))
    while work:
        n = work.pop()
        if isinstance(n, str) or hidden(n, rules):
            continue
        if n.tag in ("text", "foreignobject"):
            out += [n, " "]
        else:
            work += reversed(n.children)
    return out


class Layout:
    """Lines of a flow of blocks; text is collapsed as it comes, blank lines are held back until more text follows."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.gap = 0
        self.indent: list[str] = []
        self.marker = ""
        self.space = False

    def text(self, s: str) -> None:
        s = SPACES.sub(" ", s)
        if s.startswith(" "):
            self.space = bool(self.line)
            s = s[1:]
        if not s:
            return
        if s.endswith(" "):
            s, after = s[:-1], True
        else:
            after = False
        if self.space and self.line:
            self.line.append(" ")
        self.line.append(s)
        self.space = after

    def put(self, s: str) -> None:
        """One line as it stands."""
        if self.gap and self.lines:
            self.lines.append("")
        self.gap = 0
        lead = "".join(self.indent[-DEEPEST:])
        if self.marker:
            lead = lead[: len(lead) - len(self.marker)] + self.marker
            self.marker = ""
        self.lines.append((lead + s).rstrip())

    def flush(self) -> None:
        if self.line:
            self.put("".join(self.line))
            self.line = []
        self.space = False

    def block(self, spaced: bool) -> None:
        self.flush()
        self.gap = self.gap or int(spaced)

    def result(self) -> str:
        self.flush()
        return "\n".join(self.lines)


def aligned(rows: list[list[tuple[str, int, int]]]) -> list[str]:
    """Rows of (text, colspan, rowspan) cells with each column padded to its widest cell; a cell's lines stay below each other.

    A cell takes the first free column, and its columns in the rows that it spans are not free. Only columns in which a cell
    begins take room, so spans may be as wide as they like.
    """
    placed: list[list[tuple[int, str]]] = []
    taken: list[tuple[int, int, int]] = []  # columns from, to, and rows that are still spanned from above, in order
    widths: dict[int, int] = {}
    for row in rows:
        cells, k, over = [], 0, 0
        below = [(lo, hi, n - 1) for lo, hi, n in taken if n > 1]
        for text, span, down in row:
            while over < len(taken) and taken[over][0] <= k:
                k = max(k, taken[over][1])
                over += 1
            cells.append((k, text))
            widths[k] = max(widths.get(k, 0), *map(len, text.split("\n"))) if span == 1 else widths.get(k, 0)
            if down > 1:
                below.append((k, k + span, down - 1))
            k += span
        taken = sorted(below)
        placed.append(cells)
    starts, at = {}, 0
    for k in sorted(widths):
        starts[k] = at
        at += widths[k] + 2
    out = []
    for cells in placed:
        height = max((text.count("\n") + 1 for _, text in cells), default=0)
        split = [(k, text.split("\n")) for k, text in cells]
        for y in range(height):
            line = ""
            for k, lines in split:
                if y < len(lines) and lines[y]:
                    line = line.ljust(starts[k]) if len(line) <= starts[k] else line + "  "
                    line += lines[y]
            out.append(line.rstrip())
    return out


def span_of(node: Node, name: str = "colspan") -> int:
    """The standard's reading of a span: leading digits, 1 where there are none, its largest values; a rowspan of 0 goes on to the end."""
    found = DIGITS.match(node.attrs.get(name, ""))
    value = int(found[1][:9]) if found else 1
    return min(value or (1 if name == "colspan" else MOST_SPAN[name]), MOST_SPAN[name])


def render(root: Node) -> str:
    """All visible text, laid out. No recursion, however deep the tree."""
    flow = Layout()
    flows: list[Layout] = []
    tables: list[list[list[tuple[str, int, int]]]] = []
    counters: list[int | None] = []
    pre = 0
    work: list[tuple] = [("open", root, True)]
    rules = style_rules(root)
    while work:
        what, node, seen = work.pop()
        if what == "open":
            if isinstance(node, str):
                if not seen:
                    continue
                if tables and not flows_inside(flows, tables):
                    if node.strip():
                        flow.text(node)
                elif pre:
                    parts = node.replace("\r\n", "\n").split("\n")
                    for k, part in enumerate(parts):
                        if k:
                            flow.put("".join(flow.line)) if flow.line else flow.put("")
                            flow.line = []
                        if part:
                            flow.line.append(part)
                else:
                    flow.text(node)
                continue
            if hidden(node, rules):
                continue
            tag = node.tag
            seen = shown(node, seen, rules)
            work.append(("close", node, seen))
            children = svg_texts(node, rules) if tag == "svg" else node.children
            if tag == "details" and "open" not in node.attrs:
                children = [c for c in children if isinstance(c, Node) and c.tag == "summary"][:1]
            work += [("open", c, seen) for c in reversed(children)]
            if tag == "br":
                if flow.line:
                    flow.flush()
                elif flow.lines:
                    flow.gap = 1
            elif tag == "table":
                flow.block(True)
                tables.append([])
            elif tag == "tr" and tables:
                tables[-1].append([])
            elif tag in ("td", "th") and tables:
                if not tables[-1]:
                    tables[-1].append([])
                flows.append(flow)
                flow = Layout()
            elif tag == "caption" and tables:
                flow.block(False)
            elif tag in BLOCKS:
                flow.block(tag in SPACED and not (tag in ("ul", "ol") and counters))
                if tag in ("ul", "ol", "menu", "dir"):
                    start = node.attrs.get("start", "1").strip()
                    counters.append((int(start) if NUMBER.fullmatch(start) else 1) if tag == "ol" else None)
                elif tag == "li":
                    number = counters[-1] if counters else None
                    value = node.attrs.get("value", "").strip()
                    if number is not None and NUMBER.fullmatch(value):
                        number = int(value)
                    marker = "- " if number is None else f"{number}. "
                    if counters and number is not None:
                        counters[-1] = number + 1
                    flow.indent.append(" " * len(marker))
                    flow.marker = marker if seen else ""
                elif tag in ("dd", "blockquote"):
                    flow.indent.append("  ")
                elif tag in ("pre", "listing", "plaintext"):
                    pre += 1
                    if children and isinstance(children[0], str) and children[0][:1] == "\n":
                        work[-1] = ("open", children[0][1:], seen)
            elif tag in ("textarea", "button", "select", "input"):
                flow.space = bool(flow.line)
                if tag == "input" and seen and node.attrs.get("type", "text").lower() in VALUED and node.attrs.get("value", "").strip():
                    flow.text(node.attrs["value"])
                    flow.space = True
        else:
            tag = node.tag
            if tag == "table" and tables:
                rows = tables.pop()
                flow.flush()
                for line in aligned(rows):
                    if line:
                        flow.put(line)
                flow.block(True)
            elif tag in ("td", "th") and flows and tables:
                tables[-1][-1].append((flow.result(), span_of(node), span_of(node, "rowspan")))
                flow = flows.pop()
            elif tag == "caption":
                flow.block(False)
            elif tag in BLOCKS:
                flow.flush()
                if tag in ("ul", "ol", "menu", "dir"):
                    counters.pop()
                elif tag == "li":
                    flow.indent.pop()
                    flow.marker = ""
                elif tag in ("dd", "blockquote"):
                    flow.indent.pop()
                elif tag in ("pre", "listing", "plaintext"):
                    pre -= 1
                flow.block(tag in SPACED and not (tag in ("ul", "ol") and counters))
    return flow.result().strip("\n")


def flows_inside(flows: list, tables: list) -> bool:
    """Whether the innermost table has an open cell."""
    return len(flows) >= len(tables)


def visible_text(source: str) -> str:
    return render(build(source))


def extract_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """page_id, text, n_chars, n_lines for every row.

    All visible text is kept; blocks more than DEEPEST levels of indentation deep are not indented further, as their lines
    would be longer than the page. Style rules of the page count where their selector is a tag, a class or an id.

    A null or empty html gives an empty text; null ids and repeated rows are kept as they are. An empty table gives an empty
    result. Other columns are ignored, whatever their names. No rows meet, so the plan has no shuffle.
    """

    def run(batches):
        for b in sliced(batches, "content", 2 << 20):
            texts = [visible_text(h) for h in b.column("content").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("page_id"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array([t.count("\n") + 1 if t else 0 for t in texts], pa.int64())],
                names=["page_id", "text", "n_chars", "n_lines"],
            )

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("content"))
    return rows.mapInArrow(run, "page_id long, text string, n_chars long, n_lines long")


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))
