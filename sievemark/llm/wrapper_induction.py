"""Main texts of pages by wrapper induction.

Pages of one host come from the same template.  Every page becomes a tree of blocks in
which a list of like siblings is one node.  The trees of a host are aligned
one after another by simple tree matching with the host's template, which takes up what
it lacks.  Then all pages are aligned with the finished template and, for every text
node, the texts that stand in it are counted exactly: a text that stands in the same
node of ``share`` of the host's pages, three at least, is constant and belongs to the
template.  What varies are slots.  Slots that stand apart from an article -- menus,
forms, footers, adverts, comments, lists of links -- are told by element, role, name and links;
the others are the content, within the page's article or, where the page marks none,
within the part of the template that holds most of the varying text.

Pages whose longest block is the same count once as evidence, so copies of one article
don't turn it into template.

Only skeletons (labels and 48-bit hashes of blocks) are shuffled: by host and 64 salts, so a host with
a third of all pages is spread, then one small template a salt.  Templates are bounded by labels and not by
pages.  Texts go through one join with the wrappers, which are broadcast up to ``most_broadcast`` bytes
and else joined by host with adaptive splitting of large hosts.

Defined cases: null html counts as empty and gives an empty text; a null or odd url belongs to the host ``''``;
every row gives one row, repeated ids and urls included; a host with one or two pages has no constants; very
long, cut-off and deeply nested pages are read whole; an empty table gives an empty result; other columns are not
read, so their names can't clash.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import staged, tidied, tidy
from ._dom import Group, Node, aligned, digest, flattened, grouped, parsed, shape, united

SALTS = 64
KEPT = 20_000  # cached alignments of a worker


def host_of(url: str | Column) -> Column:
    """The host of an address, lower-cased; empty where there is none."""
    url = F.col(url) if isinstance(url, str) else url
    return F.coalesce(F.lower(F.regexp_extract(url, r"^\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:\s]*)", 1)), F.lit(""))


def compact(x) -> str:
    return json.dumps(x, separators=(",", ":"), ensure_ascii=False)


def within_apart(node: Node) -> bool:
    while node:
        if node.apart:
            return True
        node = node.parent
    return False


def skeletons(pages: DataFrame) -> DataFrame:
    """(host, sig, salt, shape, texts): the tree without texts, and [hash, characters, of them in links] of each text node's blocks."""

    def run(batches):
        for b in tidy(batches):
            cols: list[list] = [[], [], [], []]
            for host, source in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                root, blocks = parsed(source or "")
                if not blocks:
                    continue
                tree = grouped([root])
                seen = [digest(t) for t, _, _ in blocks]
                longest = max(range(len(blocks)), key=lambda i: (not within_apart(blocks[i][2]), len(blocks[i][0]), seen[i]))  # noqa: B023
                texts = [[[seen[i], len(blocks[i][0]), blocks[i][1]] for i in g.blocks] for g in flattened(tree)]
                for col, value in zip(cols, (host, seen[longest], compact(shape(tree)), compact(texts)), strict=True):
                    col.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.string())], ["host", "sig", "shape", "texts"])

    found = pages.mapInArrow(run, "host string, sig bigint, shape string, texts string")
    once = found.groupBy("host", "sig").agg(F.min(F.struct("shape", "texts")).alias("s"))
    return once.select("host", "sig", F.pmod(F.col("sig"), F.lit(SALTS)).cast("int").alias("salt"), "s.shape", "s.texts")


def united_by(trees: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One template for each key from ``shape``, aligned in order; a task holds one template at a time."""

    def run(batches):
        now, template, seen = None, None, set()
        out: list[tuple] = []
        for b in batches:
            columns = [b.column(i).to_pylist() for i in range(len(keys) + 1)]
            for *key, text in zip(*columns, strict=True):
                if key != now:
                    if template is not None:
                        out.append((*now, compact(template)))
                    now, template, seen = key, None, set()
                if text not in seen and len(seen) < KEPT:
                    seen.add(text)
                    template = json.loads(text) if template is None else united(template, json.loads(text))
                elif text not in seen:
                    template = united(template, json.loads(text))
        if template is not None:
            out.append((*now, compact(template)))
        arrays = [pa.array([r[i] for r in out], pa.int32() if name == "salt" else pa.string()) for i, name in enumerate([*keys, "shape"])]
        yield pa.RecordBatch.from_arrays(arrays, [*keys, "shape"])

    kinds = ", ".join(f"{k} int" if k == "salt" else f"{k} string" for k in keys)
    return trees.repartition(*keys).sortWithinPartitions(*keys, order).select(*keys, "shape").mapInArrow(run, f"{kinds}, shape string")


def joined(left: DataFrame, small: DataFrame, most_broadcast: int) -> DataFrame:
    """``left`` with what its host has; the right side is broadcast if its bytes, which are counted, allow it."""
    size = small.agg(F.sum(sum(F.octet_length(F.coalesce(c, F.lit(""))) for c in small.columns))).first()[0] or 0
    return left.join(F.broadcast(small) if size <= most_broadcast else small, "host", "left")


def evidence(trees: DataFrame, templates: DataFrame, share: float, most_broadcast: int) -> DataFrame:
    """(host, slots): for each text node of a template the characters that vary, and the hashes of constant texts."""

    def run(batches):
        known: dict[tuple[str, str], list[int]] = {}
        for b in batches:
            cols: list[list] = [[], [], [], []]
            for host, form, texts, template in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                at = known.get((form, template))
                if at is None:
                    if len(known) >= KEPT:
                        known.clear()
                    at = known[form, template] = aligned(json.loads(form), json.loads(template))
                own = {}
                for node, some in zip(at, json.loads(texts), strict=True):
                    if node >= 0:
                        for h, size, linked in some:
                            own[node, h] = size - linked
                for (node, h), size in own.items():
                    for col, value in zip(cols, (host, node, h, size), strict=True):
                        col.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["host", "node", "h", "size"])

    renamed = trees.select("host", F.col("shape").alias("form"), "texts")
    placed = joined(renamed, templates, most_broadcast).select("host", "form", "texts", "shape")
    counted = placed.mapInArrow(run, "host string, node int, h bigint, size bigint").groupBy("host", "node", "h").agg(F.count("*").alias("pages"), F.max("size").alias("size"))
    totals = trees.groupBy("host").agg(F.count("*").alias("total"))
    counted = joined(counted, totals, most_broadcast).withColumn("constant", (F.col("pages") >= 3) & (F.col("pages") >= F.lit(share) * F.col("total")))
    # What is constant stands in `share` of the pages, so a page's number of texts bounds the list.
    nodes = counted.groupBy("host", "node").agg(F.sum(F.when(~F.col("constant"), F.col("pages") * F.col("size")).otherwise(0)).alias("varies"), F.sort_array(F.collect_list(F.when(F.col("constant"), F.col("h")))).alias("constants"))
    return nodes.groupBy("host").agg(F.to_json(F.sort_array(F.collect_list(F.struct("node", "varies", "constants")))).alias("slots"))


@tidied
def induce_wrappers(pages: DataFrame, *, url_col: str = "url", html_col: str = "html", share: float = 0.5, most_broadcast: int = 32 << 20) -> DataFrame:
    """(host, shape, slots): the template of every host, and what stands in its text nodes."""
    source = pages.select(host_of(url_col).alias("host"), F.col(html_col).alias("html"))
    trees = staged(skeletons(source), "skeletons")
    templates = staged(united_by(united_by(trees, ["host", "salt"], "sig"), ["host"], "salt"), "templates")
    return templates.join(evidence(trees, templates, share, most_broadcast), "host", "left")


class Wrapper:
    """A host's template with its slots."""

    def __init__(self, template: str | None, slots: str | None, region_share: float = 0.75):
        self.tree = json.loads(template) if template else None
        found = {s["node"]: s for s in json.loads(slots)} if slots else {}
        self.constant = {(node, h) for node, s in found.items() for h in s.get("constants", ())}
        self.cache: dict[str, list[int]] = {}
        self.region = -1
        if self.tree:
            self._choose(found, region_share)

    def _choose(self, found: dict, region_share: float) -> None:
        """The deepest node that holds most of the varying text outside of what stands apart."""
        weight, kids, count = {}, {}, 0

        def visit(node: list, apart: bool) -> int:
            nonlocal count
            me, count = count, count + 1
            apart = apart or node[0].startswith("!")
            own = 0 if apart or me not in found else found[me]["varies"]
            kids[me] = [visit(c, apart) for c in node[1:]]
            if any(kids[k] for k in kids[me]):
                containers.add(me)
            weight[me] = own + sum(weight[k] for k in kids[me])
            return me

        containers: set[int] = set()
        now = visit(self.tree, False)
        least = region_share * weight[now]
        while True:
            inner = [k for k in kids[now] if k in containers and weight[k] >= least and weight[k]]
            if not inner:
                break
            now = inner[0]
        self.region = now

    def places(self, page: list) -> list[int]:
        key = compact(page)
        if key not in self.cache:
            if len(self.cache) >= KEPT:
                self.cache.clear()
            self.cache[key] = aligned(page, self.tree) if self.tree else [-1] * key.count("[")
        return self.cache[key]

    def content(self, source: str) -> str:
        """The text of a page's content slots, blocks in page order parted by an empty line."""
        root, blocks = parsed(source)
        if not blocks:
            return ""
        tree = grouped([root])
        groups = flattened(tree)
        place = dict(zip(map(id, groups), self.places(shape(tree)), strict=True))
        menu = links_only(tree, blocks)
        regions = marked(root)
        inside: set[int] = set()
        if not regions and self.region > 0:
            for g in groups:
                if place[id(g)] == self.region:
                    inside |= {i for x in flattened(g) for i in x.blocks}
        out = {}
        for g in groups:
            for i in g.blocks:
                text, _, node = blocks[i]
                if within_apart(node) or i in menu or (place[id(g)], digest(text)) in self.constant:
                    continue
                if regions:
                    if not below(node, regions):
                        continue
                elif inside and i not in inside:
                    continue
                out[i] = text
        return "\n\n".join(out[i] for i in sorted(out))


def marked(root: Node) -> set[int]:
    """The page's articles outside of what stands apart, else its main parts; empty if it marks none."""
    found: dict[str, set[int]] = {"article": set(), "main": set()}
    todo = [root]
    while todo:
        node = todo.pop()
        if node.apart:
            continue
        if node.tag in found:
            found[node.tag].add(id(node))
        todo += [c for c in node.children if isinstance(c, Node)]
    return found["article"] or found["main"]


def below(node: Node, regions: set[int]) -> bool:
    while node:
        if id(node) in regions:
            return True
        node = node.parent
    return False


def links_only(tree: Group, blocks: list) -> set[int]:
    """Blocks of lists that are nearly all links."""
    out: set[int] = set()
    for g in flattened(tree):
        if g.label.lstrip("!").split(".")[0] in ("ul", "ol", "dl", "table"):
            some = [i for x in flattened(g) for i in x.blocks]
            if len(some) >= 3 and sum(blocks[i][1] for i in some) >= 0.8 * sum(len(blocks[i][0]) for i in some):
                out.update(some)
    return out


def extract_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", share: float = 0.5, most_broadcast: int = 32 << 20) -> DataFrame:
    """The id, url and main text of every page, and the text's code points."""
    wrappers = induce_wrappers(pages, url_col=url_col, html_col=html_col, share=share, most_broadcast=most_broadcast)
    kind = pages.schema[id_col].dataType.simpleString()
    source = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), host_of(url_col).alias("host"), F.col(html_col).alias("html"))

    def run(batches):
        known: dict[tuple, Wrapper] = {}
        for b in tidy(batches):
            texts = []
            for source, template, slots in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
                w = known.get((template, slots))
                if w is None:
                    if len(known) >= 1000:
                        known.clear()
                    w = known[template, slots] = Wrapper(template, slots)
                texts.append(w.content(source or ""))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], ["id", "url", "text"])

    ready = joined(source, wrappers, most_broadcast).select("id", "url", "html", "shape", "slots")
    out = ready.mapInArrow(run, f"id {kind}, url string, text string")
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"))
