"""Files in and out: JSON tables, evaluation cases, documents, keyed tables."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CASES = "id string, issue_key string, query_text string, expected_source_keys array<string>, exclude_keys array<string>, verified boolean"
#: Limits of an uploaded document.
MOST_BYTES, MOST_PAGES, LEAST_CHARS, MOST_CHARS = 10 << 20, 100, 20, 200_000


def json_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A whole-file JSON array as a table."""
    return spark.read.schema(schema).json(path, multiLine=True)


def load_cases(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation cases; fails on an unverified, empty, self-labelled or repeated case."""
    df = spark.read.schema(CASES).json(path)
    wrong = (
        F.when(F.coalesce(F.trim("id"), F.lit("")) == "", "a case has no id")
        .when(~F.coalesce("verified", F.lit(False)), "a case is not verified")
        .when(F.coalesce(F.size("expected_source_keys"), F.lit(0)) < 1, "a case expects nothing")
        .when(F.coalesce("issue_key", "query_text").isNull(), "a case has no query")
        .when(F.array_contains("expected_source_keys", F.col("issue_key")), "a case labels itself")
    )
    bad = df.select(wrong.alias("w")).where("w is not null").limit(1).collect()
    if bad:
        raise ValueError(bad[0].w)
    if not df.groupBy("id").count().where("count > 1").isEmpty():
        raise ValueError("a case id is repeated")
    return df


def docx_text(raw: bytes) -> str:
    """Paragraphs (list items with a bullet) and tables of a word-processing file; document type declarations are refused."""
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    xml = zipfile.ZipFile(io.BytesIO(raw)).read("word/document.xml")
    if b"<!DOCTYPE" in xml or b"<!ENTITY" in xml:
        raise ValueError("declarations are not allowed")
    out = []
    for part in ElementTree.fromstring(xml).iter(f"{w}body"):
        for x in part:
            if x.tag == f"{w}p":
                style = x.find(f"{w}pPr/{w}pStyle")
                listed = x.find(f"{w}pPr/{w}numPr") is not None or style is not None and "list" in (style.get(f"{w}val") or "").lower()
                out.append(("• " if listed else "") + "".join(t.text or "" for t in x.iter(f"{w}t")))
            elif x.tag == f"{w}tbl":
                for row in x.iter(f"{w}tr"):
                    out.append("|" + "|".join("".join(t.text or "" for t in c.iter(f"{w}t")) for c in row.iter(f"{w}tc")) + "|")
    return "\n".join(out)


def sheet_text(raw: bytes) -> str:
    """Cells of all sheets of a workbook, a row a line."""
    n = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    z, shared, out = zipfile.ZipFile(io.BytesIO(raw)), [], []
    if "xl/sharedStrings.xml" in z.namelist():
        shared = ["".join(t.text or "" for t in si.iter(f"{n}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{n}si")]
    for name in sorted(x for x in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", x)):
        for row in ElementTree.fromstring(z.read(name)).iter(f"{n}row"):
            cells = []
            for c in row.iter(f"{n}c"):
                v = c.find(f"{n}v")
                text = "".join(t.text or "" for t in c.iter(f"{n}t")) if v is None else shared[int(v.text)] if c.get("t") == "s" else v.text
                cells.append(text or "")
            out.append(" | ".join(cells))
    return "\n".join(out)


def extract(name: str, raw: bytes) -> tuple[str, str]:
    """(text, error) of one file; one of the two is empty."""
    kind = name.rsplit(".", 1)[-1].lower()
    try:
        if len(raw) > MOST_BYTES:
            return "", "too large"
        if kind in ("txt", "md"):
            text = raw.decode("utf-8-sig")
        elif kind == "docx":
            text = docx_text(raw)
        elif kind == "xlsx":
            text = sheet_text(raw)
        elif kind == "pdf":
            try:
                from pypdf import PdfReader
            except ImportError:
                return "", "no reader for pdf"
            reader = PdfReader(io.BytesIO(raw))
            if reader.is_encrypted:
                return "", "encrypted"
            if len(reader.pages) > MOST_PAGES:
                return "", "too many pages"
            text = "\n".join(p.extract_text() or "" for p in reader.pages)
        else:
            return "", "unknown kind"
    except Exception as e:  # a damaged file is a row with its error, not a failed job
        return "", f"{type(e).__name__}"
    if "\0" in text:
        return "", "binary"
    if not LEAST_CHARS <= len(text.strip()) <= MOST_CHARS:
        return "", "length"
    return text, ""


def documents(spark: SparkSession, path: str) -> DataFrame:
    """(name, text, error) of the files under a path."""

    def run(batches):
        for b in batches:
            both = [extract(n, raw) for n, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[0] for x in both], pa.string()), pa.array([x[1] for x in both], pa.string())], ["name", "text", "error"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content").mapInArrow(run, "name string, text string, error string")


def replace_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def append_table(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)
