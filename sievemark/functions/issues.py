"""Issues as text: queries, error context, fields of the older forms, search phrases."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .tables import field_lines, raw_field, structured_fields
from .text import CODE_DIGITS, UUID, clean_error, clean_text, error_code, field, let, normalized, normalized_step, parse_failure, text

# Patterns of per-ticket identifiers, and of labelled lines in documents and queries.
RECORD = r"\b00[A-Za-z0-9]{13,16}\b"
PHONE_LIKE = r"(?<!\w)\+?\d[\d\s().-]{6,}\d(?!\w)"
ERROR_MARK = "PR_Error_Description"
CODED_LINE = r"(\d{1,6}\s*\|[^\n]{3,150})"
EXTERNAL_ID = r"(?i)\(?\bExternalId\s*=\s*[^)\n]*\)?"
UNITS = {"ms": 0.001, "s": 1.0, "m": 60.0, "h": 3600.0}


def squeezed(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def stable_error(c: Column) -> Column:
    """An error without what differs by ticket: UUIDs, record ids and phone-like numbers; short codes stay."""
    for pattern in (UUID, RECORD, PHONE_LIKE):
        c = F.regexp_replace(text(c), pattern, " ")
    return squeezed(F.regexp_replace(c, r"\s+([.,;:!?])", "$1"))


def marked_error(comments: Column, author: str, clean: bool, digits: int = CODE_DIGITS) -> Column:
    """Value of the error mark in the newest comment by ``author`` that has one; '' if none.

    ``comments``: array of structs (author, body), oldest first.
    """
    def value(body):
        found = F.filter(F.split(text(body), "\n"), lambda x: F.contains(x, F.lit(ERROR_MARK)) & F.contains(x, F.lit(":")))
        said = lambda x: F.regexp_extract(x, r"^[^:]*:(.*)$", 1)
        each = F.transform(found, lambda x: clean_error(said(x), digits) if clean else F.trim(said(x)))
        return F.get(F.filter(each, lambda x: x != ""), F.lit(0))

    own = F.filter(F.reverse(comments), lambda x: F.lower(F.trim(text(x["author"]))) == author)
    return text(F.get(F.array_compact(F.transform(own, lambda x: value(x["body"]))), F.lit(0)))


def issue_query(summary: Column, description: Column, comments: Column, author: str, most: int = 8000) -> Column:
    """Struct (text, step, error) that an issue is searched by; an error may come from its newest marked comment."""
    body = F.substring(F.concat(F.lit("Summary: "), text(summary), F.lit("\n"), text(description)), 1, most)

    def build(b):
        def whole(p):
            error = F.when(p["error"] != "", p["error"]).otherwise(F.substring(marked_error(comments, author, False), 1, 500))

            def labelled(e):
                every = F.concat_ws("\n", b, F.when(p["step"] != "", F.concat(F.lit("Failed Step: "), p["step"])), F.when(e != "", F.concat(F.lit("Error Description: "), e)))
                return F.struct(F.substring(every, 1, most + 1000).alias("text"), p["step"].alias("step"), e.alias("error"))

            return let(error, labelled)

        return let(parse_failure(b), whole)

    return let(body, build)


def resolution_context(query: Column, body: Column) -> Column:
    """Struct of order context: what the body says, else what the query says."""
    names = {"order_reason": ("Order Reason", "OrderReason", "Reason"), "order_type": ("Order Type Failed", "Order Type", "OrderType"), "release": ("Release", "Release Version", "Software Release")}
    return F.struct(*(F.coalesce(F.nullif(field(body, *n), F.lit("")), field(query, *n)).alias(k) for k, n in names.items()))


def error_context(description: Column, comments: Column, author: str, digits: int = CODE_DIGITS) -> Column:
    """The error of an issue: its newest marked comment, with a code of at most ``digits``, else the structured fields, else a line that names one."""
    def stated(d):
        line = F.regexp_extract(d, r"(?im)Error(?:\s+Description)?\s*[:|]\s*(.{20,300})", 1)
        fields = structured_fields(d)
        named = let(fields, lambda m: F.coalesce(m["Error Description"], m["Error Code"]))
        return F.when((F.trim(d) == "") | F.startswith(F.ltrim(d), F.lit("{")), "").otherwise(F.coalesce(named, clean_error(line)))

    return F.coalesce(F.nullif(marked_error(comments, author, True, digits), F.lit("")), let(text(description), stated))


def ticket_text(summary: Column, description: Column, comments: Column, author: str, digits: int = CODE_DIGITS) -> Column:
    """The text an issue is searched by in the older form: category, step, fields, error, and its own numbers as they stand."""
    category = F.trim(F.regexp_extract(text(summary), r"^([A-Z_]+)\s*:", 1))
    step = F.trim(F.regexp_extract(text(summary), r"(?i)Failed\s+Step:\s*([^-\n]+)", 1))
    own = [F.when(raw_field(description, p) != "", F.concat(F.lit(f"{n}: "), raw_field(description, p))) for n, p in (("BAN-CAN", r"BAN[-\s]?CAN"), ("MSISDN", "MSISDN"))]
    said = lambda label, c: F.when(c != "", F.concat(F.lit(label), c))
    parts = F.concat_ws("\n", said("", category), said("Failed Step: ", step), said("", field_lines(description)), said("Error: ", error_context(description, comments, author, digits)), *own)
    return let(parts, lambda p: F.when(p != "", p).otherwise(clean_text(summary)))


def grabbed(c: Column, label: str) -> Column:
    """A labelled category of a query, cleaned; '' if absent or a bare number."""
    value = F.trim(F.btrim(F.trim(F.regexp_extract(text(c), rf"(?im)(?:^|\n|\|)\s*\*?{label}\*?\s*[:|]\s*\*?([^*\n|]{{1,80}}?)\*?\s*(?:\||$|\n)", 1)), F.lit("*")))
    return F.when(F.regexp_like(value, F.lit(r"^\d+$")), "").otherwise(clean_text(value))


def query_fields(c: Column) -> Column:
    """Struct (step, error) of a free query: labelled values, or a line ``code | message``."""
    tidy = F.array_join(F.filter(F.transform(F.split(text(c), "\n"), squeezed), lambda x: x != ""), "\n")

    def parse(b):
        step = F.trim(F.regexp_extract(b, r"(?i)(?:Failed\s+)?Step:\s*([^\n|]{5,120}?)(?:\s*[\n|]|$)", 1))
        coded = F.regexp_extract(b, CODED_LINE, 1)
        named = F.regexp_extract(b, r"(?i)Error(?:\s+(?:Description|Code))?\s*:\s*([^\n]{1,200})", 1)
        return F.struct(clean_text(step).alias("step"), clean_error(F.trim(F.when(coded != "", coded).otherwise(named))).alias("error"))

    return let(tidy, parse)


def document_fields(c: Column) -> Column:
    """Struct (step, error) of a document that describes a fix."""
    tidy = lambda x: F.btrim(F.regexp_replace(x, r"\b\d{6,}\b", ""), F.lit(" -|"))
    step = F.trim(F.regexp_extract(text(c), r"(?i)(?:failed\s+)?step\s*[-:]\s*([^\n]{3,120})", 1))
    named = F.trim(F.regexp_extract(text(c), r"(?i)error(?:\s+response|\s+description)?\s*[-:]\s*([^\n]{3,200})", 1))
    error = F.when(named != "", named).otherwise(F.trim(F.regexp_extract(text(c), CODED_LINE, 1)))
    return F.struct(tidy(step).alias("step"), tidy(F.regexp_replace(error, EXTERNAL_ID, "")).alias("error"))


def summary_step(c: Column) -> Column:
    """Name of the step in a cleaned summary."""
    return let(clean_text(c), lambda s: clean_text(F.regexp_extract(s, r"(?i)Failed\s+Step:\s*([^\n]{5,80}?)\s*$", 1)))


def semantic_query(step: Column, error: Column, query: Column) -> Column:
    """The phrase that similar failures are asked for by meaning."""
    said = F.concat(F.lit("Failed Step: "), F.substring(step, 1, 400), F.lit("\nError Description: "), F.substring(stable_error(error), 1, 450))
    return F.when((step == "") & (error == ""), F.substring(text(query), 1, 900)).otherwise(said)


def exact_terms(step: Column, error: Column) -> Column:
    """Struct (phrase, term) of an exact search; null unless step and error are there."""
    words = F.array_join(F.slice(F.regexp_extract_all(stable_error(error), F.lit("[a-zA-Z0-9]+"), F.lit(0)), 1, 6), " ")
    code = error_code(error)
    return F.when((step != "") & (error != ""), F.struct(F.substring(step, 1, 150).alias("phrase"), F.when(code != "", code).otherwise(words).alias("term")))


def evidence_key(step: Column, error: Column, *context: Column) -> Column:
    """Hash of all that decides which earlier evidence applies."""
    return F.sha2(F.concat_ws("\n", *(F.lower(text(c)) for c in context), normalized_step(step), normalized(stable_error(error))), 256)


def entry_text(*fields: Column) -> Column:
    """The text that a source is found by: its fields that are there."""
    return F.concat_ws(" ", *(F.nullif(text(f), F.lit("")) for f in fields))


def seconds(c: Column, default: float = 60.0) -> Column:
    """Seconds of ``2.5``, ``1m30s`` or ``500ms``; ``default`` where none can be read."""
    value = F.lower(F.trim(text(c)))
    parts = F.regexp_extract_all(value, F.lit(r"\d+(?:\.\d+)?\s*(?:ms|s|m|h)"), F.lit(0))
    weight = F.create_map(*(F.lit(x) for pair in UNITS.items() for x in pair))
    total = F.aggregate(parts, F.lit(0.0), lambda s, x: s + F.regexp_extract(x, r"^(\d+(?:\.\d+)?)", 1).cast("double") * weight[F.regexp_extract(x, r"([a-z]+)$", 1)])
    plain = F.when(F.regexp_like(value, F.lit(r"^\d+(\.\d+)?$")), value.cast("double"))
    return F.coalesce(plain, F.when(total > 0, total), F.lit(default))


def word_chunks(c: Column, size: int = 800, overlap: int = 100, least: int = 50) -> Column:
    """Windows of ``size`` words that share ``overlap``, those of more than ``least`` characters."""
    def cut(words):
        starts = F.sequence(F.lit(0), F.greatest(F.size(words) - 1, F.lit(0)), F.lit(size - overlap))
        return F.filter(F.transform(starts, lambda s: F.array_join(F.slice(words, s + 1, F.lit(size)), " ")), lambda x: F.length(x) > least)

    return let(F.filter(F.split(text(c), r"\s+"), lambda x: x != ""), cut)


def looks_like_no_fix(c: Column, is_table: Column) -> Column:
    """Whether a text describes a fault or a status; tables, fix blocks and numbered steps never do."""
    low = F.lower(F.trim(text(c)))
    head = F.substring(low, 1, 80)
    passes = F.contains(low, F.lit("=== fix")) | F.coalesce(is_table, F.lit(False)) | F.regexp_like(low, F.lit(r"(?m)^\s*\d+[.)]\s+\S"))
    fault = F.contains(low, F.lit("order failed")) & F.contains(low, F.lit("cause"))
    named = F.contains(head, F.lit("error description")) | F.startswith(head, F.lit("current error")) | F.contains(head, F.lit("sla breached"))
    return (low == "") | (~passes & (fault | named | F.regexp_like(head, F.lit(r"^(?:cause:|reason:|error:|error :)"))))
