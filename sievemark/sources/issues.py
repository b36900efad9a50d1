"""Issues as a paged Spark source: ``spark.read.format("issue_pages")``.

A page source is a folder of ``page-*.json`` files, each ``{"issues": [...],
"nextPageToken": ...}``; pages are read in parallel, one a partition.
"""

from __future__ import annotations

import json

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "key string, summary string, description string, status string, updated string, resolutiondate string, assignee string, comments string"


class Page(InputPartition):
    def __init__(self, path: str, most: int | None = None):
        self.path, self.most = path, most


class IssuePages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "issue_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return IssueReader(self.options)


class IssueReader(DataSourceReader):
    """Pages are found and opened through Arrow's file systems, so the folder may be local or shared.

    With ``limit`` only the first so many issues, in page order, are read: whole pages are
    counted on the driver until there are enough, and the last one is cut.
    """

    def __init__(self, options):
        self.path, self.limit = options["path"], int(options.get("limit", "0"))

    def partitions(self):
        store, root = opened(self.path)
        names = sorted(f.path for f in store.get_file_info(fs.FileSelector(root)) if f.base_name.startswith("page-") and f.base_name.endswith(".json"))
        if not self.limit:
            return [Page(n) for n in names]
        out, left = [], self.limit
        for n in names:
            if left <= 0:
                break
            found = len(page(store, n))
            out.append(Page(n, min(found, left)))
            left -= found
        return out

    def read(self, partition):
        store, _ = opened(self.path)
        for i in page(store, partition.path)[: partition.most]:
            x = i.get("fields", {})
            name = lambda k, f="name": (x.get(k) or {}).get(f)
            yield (i["key"], flatten(x.get("summary")), flatten(x.get("description")), name("status"), x.get("updated"), x.get("resolutiondate"), name("assignee", "accountId"), json.dumps((x.get("comment") or {}).get("comments", []), sort_keys=True))


def opened(path: str):
    if path.startswith(("/", "file:")):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


def page(store, path: str) -> list[dict]:
    with store.open_input_stream(path) as f:
        return json.loads(f.read()).get("issues", [])


def flatten(node) -> str:
    """Text of a rich-text tree, parts joined by spaces."""
    if node is None:
        return ""
    if isinstance(node, str):
        return node
    if isinstance(node, list):
        return " ".join(t for t in map(flatten, node) if t)
    return " ".join(t for t in (node.get("text") or "", flatten(node.get("content"))) if t)


def register(spark) -> None:
    spark.dataSource.register(IssuePages)
