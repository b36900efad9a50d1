"""Pages as trees of blocks, and simple tree matching between them."""

from __future__ import annotations

import hashlib
import html
import re

# Fixed values of HTML: elements without content, with raw text, and those that don't begin a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img".split())
#: What an opening tag closes, and where the search for it stops.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
# What is not part of an article: by element, by role, by name of class or id.
APART = frozenset("head script style nav aside footer form button select noscript template svg math object iframe dialog audio video canvas menu fieldset textarea title".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar toolbar".split())
NAMES = (
    "ad|ads|advert|adverts|advertisement|advertising|sponsor|sponsored|promo|banner|cookie|cookies|consent|gdpr|notice|notices|alert|alerts|nav|navbar|navigation|menu|breadcrumb|breadcrumbs|"
    "sidebar|aside|footer|masthead|topbar|comment|comments|disqus|respond|share|sharing|social|related|newsletter|subscribe|signup|login|popup|modal|overlay|pagination|pager|toolbar|widget|widgets"
)
NAMED = re.compile(rf"(?!(?:no|has|with)[-_])(?:[a-z0-9]+[-_]+){{0,3}}(?:{NAMES})(?:[-_]*(?:wrap|wrapper|container|box|bar|list|item|items|area|section|block|inner|links|text|content|unit|slot|form|\d+))?|(?:site|page|top|global|main)?[-_]?header")

TAG = re.compile(r"<(?:!--.*?(?:--!?>|\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']+|\"[^\"]*\"|'[^']*')*+|[^>]*)(?:>|\Z))", re.DOTALL)
ATTRIBUTE = re.compile(r"(?<![^\s\"'/])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.IGNORECASE)
DEEPEST, MOST_RUNS, MOST_LABELS = 48, 24, 48


class Node:
    __slots__ = ("tag", "label", "apart", "children", "parent", "depth")

    def __init__(self, tag: str, label: str, apart: bool, parent: Node | None):
        self.tag, self.label, self.apart, self.parent = tag, label, apart, parent
        self.children: list[Node | int] = []
        self.depth = parent.depth + 1 if parent else 0


def attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(text)} if text and not text.isspace() else {}


def described(tag: str, given: str, in_article: bool) -> tuple[str, bool]:
    """The label of an element, and whether it stands apart from any article."""
    a = attributes(given)
    names = a.get("class", "").lower().split()
    label = ".".join([tag, *(re.sub(r"\d+", "0", n) for n in names)])[:80]
    apart = tag in APART or (tag == "header" and not in_article) or a.get("role", "").lower() in ROLES or "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in a.get("style", "").replace(" ", "").lower()
    if not apart and tag not in ("html", "body") and (names or "id" in a):
        apart = any(NAMED.fullmatch(n) and not (in_article and n.endswith("header")) for n in [*names, a.get("id", "").lower()])
    return ("!" if apart else "") + label, apart


def parsed(text: str) -> tuple[Node, list[tuple[str, int, Node]]]:
    """The tree of blocks of a page, and its blocks in order: text, characters inside links, element.

    Unclosed and crossed elements, a page cut off anywhere and unknown elements are accepted; an element
    nested deeper than a few dozen others counts as its ancestor, its text stays.
    """
    root = node = Node("#page", "#page", False, None)
    blocks: list[tuple[str, int, Node]] = []
    buffer: list[str] = []
    links = linked = 0
    open_inline: list[tuple[str, Node]] = []
    articles = 0

    def flush() -> None:
        nonlocal linked
        if buffer:
            whole = " ".join("".join(buffer).split())
            if whole:
                node.children.append(len(blocks))
                blocks.append((whole, min(linked, len(whole)), node))
            buffer.clear()
        linked = 0

    def up(to: Node) -> None:
        nonlocal node, articles, links
        while node is not to:
            articles -= node.tag in ("article", "main")
            node = node.parent
        while open_inline and open_inline[-1][1].depth > node.depth:
            links -= open_inline.pop()[0] == "a"

    at, n = 0, len(text)
    while at < n:
        m = TAG.search(text, at)
        piece = text[at : m.start()] if m else text[at:]
        if piece:
            if "&" in piece:
                piece = html.unescape(piece)
            buffer.append(piece)
            if links:
                linked += len(piece)
        if not m:
            break
        at, tag = m.end(), m[2]
        if not tag:
            continue
        tag = tag.lower()
        if m[1]:
            if tag in INLINE:
                for i in range(len(open_inline) - 1, -1, -1):
                    if open_inline[i][0] == tag and open_inline[i][1] is node:
                        del open_inline[i]
                        links -= tag == "a"
                        break
                else:
                    back = node
                    while back.parent and back.tag in INLINE and back.tag != tag:
                        back = back.parent
                    if back.tag == tag and back.parent:
                        flush()
                        up(back.parent)
                continue
            back = node
            while back and back.tag != tag:
                back = back.parent
            flush()
            if back and back.parent:
                up(back.parent)
            continue
        if tag in VOID:
            if tag in ("br", "hr", "img", "wbr") and tag != "wbr":
                buffer.append(" ")
            if tag == "hr":
                flush()
            continue
        given = m[3] or ""
        if tag in INLINE:
            label, apart = described(tag, given, articles > 0)
            if not apart or tag == "a":
                open_inline.append((tag, node))
                links += tag == "a"
                continue
        else:
            label, apart = described(tag, given, articles > 0)
            # An open paragraph ends where a block begins.
            back = node
            if tag in CLOSES:
                closing, stop = CLOSES[tag]
                while back.parent and back.tag not in closing and back.tag not in stop:
                    back = back.parent
                if back.tag in closing:
                    flush()
                    up(back.parent)
            elif node.tag == "p":
                flush()
                up(node.parent)
        flush()
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])", re.IGNORECASE).search(text, at)
            at = end.start() if end else n
            if end:
                close = text.find(">", end.end())
                at = close + 1 if close >= 0 else n
            continue
        if m[3] is not None and given.endswith("/") and tag not in ("p", "div", "li"):
            continue
        if node.depth >= DEEPEST:
            continue
        new = Node(tag, label, apart, node)
        node.children.append(new)
        node = new
        articles += tag in ("article", "main")
    flush()
    return root, blocks


class Group:
    """Siblings of one label, as one node: a list counts once whatever its length."""

    __slots__ = ("label", "children", "blocks", "id")

    def __init__(self, label: str):
        self.label, self.children, self.blocks, self.id = label, [], [], -1


def grouped(nodes: list[Node], label: str = "#page") -> Group:
    """The tree with neighbouring siblings of one label joined into one node."""
    out = Group(label)
    runs: list[tuple[str, list]] = []
    for node in nodes:
        for c in node.children:
            name = "#" if isinstance(c, int) else c.label
            if runs and runs[-1][0] == name:
                runs[-1][1].append(c)
            else:
                runs.append((name, [c]))
        runs.append(("", []))  # members of one list don't run into each other
    merged: list[tuple[str, list]] = []
    if len(nodes) == 1 and len(runs) <= MOST_RUNS:
        merged = [r for r in runs if r[0]]
    else:  # several members, or very many changes: one node for each label
        kinds = {r[0] for r in runs}
        by: dict[str, list] = {}
        for name, some in runs:
            if name:
                by.setdefault(name.split(".")[0] if len(kinds) > MOST_LABELS else name, []).extend(some)
        merged = list(by.items())
    for name, some in merged:
        if name == "#":
            g = Group("#")
            g.blocks = some
        else:
            g = grouped(some, name)
        out.children.append(g)
    return out


def shape(g: Group) -> list:
    """A tree without its texts: label, then children."""
    return [g.label, *(shape(c) for c in g.children)]


def match(a: list, b: list) -> int:
    """Simple tree matching: the most nodes that two trees share in order under equal labels."""
    if a[0] != b[0]:
        return 0
    return 1 + table(a, b)[-1][-1]


def table(a: list, b: list) -> list[list[int]]:
    rows = [[0] * len(b)]
    for i in range(1, len(a)):
        row, before = [0], rows[-1]
        for j in range(1, len(b)):
            best = before[j] if before[j] >= row[-1] else row[-1]
            if a[i][0] == b[j][0]:
                both = before[j - 1] + match(a[i], b[j])
                if both > best:
                    best = both
            row.append(best)
        rows.append(row)
    return rows


def pairs(a: list, b: list) -> list[tuple[int, int]]:
    """The children of two matching nodes that are matched with each other."""
    rows, i, j, out = table(a, b), len(a) - 1, len(b) - 1, []
    while i and j:
        if a[i][0] == b[j][0] and rows[i][j] == rows[i - 1][j - 1] + match(a[i], b[j]) and rows[i][j] > max(rows[i - 1][j], rows[i][j - 1]):
            out.append((i, j))
            i, j = i - 1, j - 1
        elif rows[i][j] == rows[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return out[::-1]


def united(template: list, page: list) -> list:
    """The template with the nodes of ``page`` that it lacks, each after its matched left neighbour."""
    matched = dict(pairs(page, template))
    if len(matched) == len(page) - 1 and all(template[j] == page[i] for i, j in matched.items()):
        return template
    out, done = [template[0]], 1
    for i in range(1, len(page)):
        j = matched.get(i)
        if j is None:
            out.append(page[i])
            continue
        out += template[done:j]
        out.append(united(template[j], page[i]))
        done = j + 1
    out += template[done:]
    if len(out) > 2 * MOST_RUNS:  # so that templates stay small: one node for each label
        by: dict[str, list] = {}
        few = len({c[0] for c in out[1:]}) <= MOST_LABELS
        for c in out[1:]:
            name = c[0] if few else c[0].split(".")[0]
            by[name] = united(by[name], [name, *c[1:]]) if name in by else [name, *c[1:]]
        out = [out[0], *by.values()]
    return out


def numbered(template: list) -> dict[int, int]:
    """The number of each node of a template, in page order, by identity."""
    ids: dict[int, int] = {}

    def visit(node: list) -> None:
        ids[id(node)] = len(ids)
        for c in node[1:]:
            visit(c)

    visit(template)
    return ids


def aligned(page: list, template: list) -> list[int]:
    """For each node of ``page`` in page order, the number of the template's node matched with it, or -1."""
    ids, out = numbered(template), []

    def visit(a: list, b: list | None) -> None:
        out.append(-1 if b is None else ids[id(b)])
        to = dict(pairs(a, b)) if b is not None else {}
        for i in range(1, len(a)):
            visit(a[i], b[to[i]] if i in to else None)

    visit(page, template if template and template[0] == page[0] else None)
    return out


def flattened(g: Group) -> list[Group]:
    out = [g]
    for c in g.children:
        out += flattened(c)
    return out


def digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=6).digest())
