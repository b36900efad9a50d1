"""Resolution tables and fix blocks: reading, rendering, steps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import clean_error, clean_text, clean_value, let, scrub_identifiers, text

# Rows of the table in order, and the spellings of their labels.
FIELDS = ["Order Type Failed", "BAN CAN", "MSISDN", "Cause", "Category", "Solution applied", "System modified", "Customer action"]
ALIASES = {
    "order type failed": "Order Type Failed", "order type": "Order Type Failed", "failed order type": "Order Type Failed",
    "ban can": "BAN CAN", "ban-can": "BAN CAN", "bancan": "BAN CAN", "ban": "BAN CAN",
    "msisdn": "MSISDN",
    "cause": "Cause", "root cause": "Cause", "reason": "Cause",
    "category": "Category",
    "solution applied": "Solution applied", "solution": "Solution applied", "workaround": "Solution applied", "workaround applied": "Solution applied",
    "system modified": "System modified", "system": "System modified", "systems modified": "System modified",
    "customer action": "Customer action", "customer": "Customer action", "next step": "Customer action",
}
SEPARATOR = r"^:?-{2,}:?$"
GENERATED = ["Cause", "Solution applied", "System modified", "Customer action"]
STORED = {"wa_cause": ("Cause", 300), "wa_solution": ("Solution applied", 500), "wa_system": ("System modified", 80), "wa_customer": ("Customer action", 300), "wa_category": ("Category", 120)}
SYSTEMS = [("salesforce", "Salesforce"), ("matrixx", "Matrixx"), (r"\baria\b", "Aria"), ("nokia", "Nokia"), (r"\beda\b", "EDA"), ("network", "Network"), ("asurion", "Asurion"), (r"\bsf\b", "SF")]
MARKS = r"(?i)===\s*(?:FIX|END)\s*==="
NO_ACTION = r"(?i)^(?:no|none|nil|nothing|not)\b[^.]{0,40}$"
NO_FIX = "NO_RELIABLE_WORKAROUND"
LABELS = ["Order Reason", "Order Type", "Step", "Failed Step", "Error Description", "Error Code", "Sub Type", "Order Sub Type", "Service Type", "Action"]
ERROR_LABELS = ["Error Description", "Error Code"]


def lookup(table: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in table.items() for x in pair))


def squash(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def label_key(c: Column) -> Column:
    return F.lower(squash(F.btrim(F.trim(F.regexp_replace(c, r"[*_`]", "")), F.lit(": "))))


def parse_table(body: Column, least: int = 3) -> Column:
    """Map of canonical label to value: first occurrence wins, null unless ``least`` labels and one value are there."""
    rows = F.filter(F.transform(F.split(text(body), "\n"), lambda x: F.trim(x)), lambda x: F.startswith(x, F.lit("|")))
    cells = F.transform(rows, lambda x: F.transform(F.split(F.btrim(F.replace(x, F.lit("||"), F.lit("|")), F.lit("| ")), r"\|"), lambda x: F.trim(x)))
    real = F.filter(cells, lambda x: (F.size(x) >= 2) & ~F.forall(x, lambda y: (y == "") | F.regexp_like(y, F.lit(SEPARATOR))))
    named = F.transform(real, lambda x: F.struct(F.try_element_at(lookup(ALIASES), label_key(F.element_at(x, 1))).alias("k"), squash(F.array_join(F.slice(x, F.lit(2), F.size(x) - 1), " | ")).alias("v")))
    named = first_of_each(F.filter(named, lambda x: x["k"].isNotNull()))
    enough = lambda first: (F.size(first) >= least) & F.exists(first, lambda x: clean_value(x["v"]) != "")
    return let(named, lambda first: F.when(enough(first), F.map_from_entries(first)))


def first_of_each(pairs: Column) -> Column:
    """Entries (k, v) whose key did not occur before."""
    return let(pairs, lambda p: let(F.transform(p, lambda x: x["k"]), lambda keys: F.filter(p, lambda x, i: F.array_position(keys, x["k"]) == i + 1)))


def render(values: Column, filler: str = "NA") -> Column:
    """The eight rows ``|label|value|``; absent values show the filler."""
    def rows(v):
        def row(f):
            value = F.coalesce(F.try_element_at(v, F.lit(f)), F.lit(""))
            return F.concat(F.lit(f"|{f}|"), F.when(value == "", filler).otherwise(value), F.lit("|"))

        return F.concat_ws("\n", *(row(f) for f in FIELDS))

    return let(values, rows)


def rendered_rows(body: Column) -> Column:
    """(label, value) of an own rendering, blank values kept."""
    rows = F.filter(F.transform(F.split(text(body), "\n"), lambda x: F.trim(x)), lambda x: F.regexp_like(x, F.lit(r"^\|[^|]+\|.*\|$")))
    return F.transform(rows, lambda x: F.struct(F.trim(F.regexp_extract(x, r"^\|([^|]+)\|(.*)\|$", 1)).alias("label"), F.trim(F.regexp_extract(x, r"^\|([^|]+)\|(.*)\|$", 2)).alias("value")))


def blank_template(ban: Column, msisdn: Column) -> Column:
    return render(F.create_map(F.lit("BAN CAN"), text(ban), F.lit("MSISDN"), text(msisdn)), "")


def steps(body: Column) -> Column:
    """Parts between semicolons and line ends, without block marks, list marks, closing points and cause lines."""
    parts = F.split(F.regexp_replace(text(body), MARKS, "\n"), r"\s*;\s*|\n")
    parts = F.transform(parts, lambda x: F.btrim(F.trim(F.regexp_replace(x, r"^\s*(?:\d+[.)]|[-*•])\s*", "")), F.lit(".;")))
    return F.filter(parts, lambda x: (x != "") & ~F.regexp_like(x, F.lit(r"(?i)^[ \t*_]*(?:root[ \t]+)?cause[ \t]*:")))


def cause_of(body: Column) -> Column:
    return F.trim(F.regexp_extract(text(body), r"(?i)(?:^|\n)[ \t*_]*(?:root[ \t]+)?cause[ \t]*:[ \t]*([^\n]+)", 1))


def render_fix(cause: Column, parts: Column) -> Column:
    """Numbered fix block without identifiers; empty without steps."""
    def block(clean):
        numbered = F.transform(clean, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 100000)))
        head = F.when(clean_value(cause) != "", F.concat(F.lit("Root Cause: "), scrub_identifiers(cause), F.lit("\n"))).otherwise("")
        return F.when(F.size(clean) == 0, "").otherwise(F.concat(F.lit("=== FIX ===\n"), head, F.array_join(numbered, "\n"), F.lit("\n=== END ===")))

    return let(F.filter(F.transform(parts, scrub_identifiers), lambda x: x != ""), block)


def value_of(values: Column, label: str) -> Column:
    return F.coalesce(F.try_element_at(values, F.lit(label)), F.lit(""))


def to_fix_block(body: Column, values: Column | None = None) -> Column:
    """A past resolution as a fix block: of a table its solution and what the customer must do, of prose its parts."""
    table = parse_table(body) if values is None else values

    def build(t):
        follow = clean_value(value_of(t, "Customer action"))
        more = F.when((follow == "") | F.regexp_like(follow, F.lit(NO_ACTION)), F.array().cast("array<string>")).otherwise(steps(follow))
        tabled = render_fix(clean_value(value_of(t, "Cause")), F.concat(steps(clean_value(value_of(t, "Solution applied"))), more))
        return F.when(t.isNotNull(), tabled).otherwise(render_fix(cause_of(body), steps(body)))

    return let(table, build)


def raw_field(body: Column, label: str) -> Column:
    """A labelled value of a description as it stands."""
    pattern = rf"(?im)(?:^|\n|\|)\s*\*{{0,2}}{label}\*{{0,2}}\s*[:|]\s*\*{{0,2}}([^*\n|]{{1,120}}?)\*{{0,2}}\s*(?:\||$|\n)"
    return squash(F.regexp_extract(text(body), pattern, 1))


def ticket_fields(description: Column, filler: str = "NA") -> Column:
    """Map of the rows that the asking ticket owns."""
    kind = raw_field(description, "Order Type")
    kind = F.when((kind != "") & ~F.regexp_like(kind, F.lit(r"(?i)\border\b")), F.concat(kind, F.lit(" order"))).otherwise(kind)
    own = {"Order Type Failed": kind, "BAN CAN": raw_field(description, r"BAN[-\s]?CAN"), "MSISDN": raw_field(description, "MSISDN"), "Category": raw_field(description, "Order Reason")}
    return F.create_map(*(x for k, v in own.items() for x in (F.lit(k), F.when(v == "", filler).otherwise(v))))


def infer_system(c: Column) -> Column:
    """The first known system that a text names, '' for none."""
    return first_match(c, [(rf"(?i){p}", name) for p, name in SYSTEMS])


def reply_fields(answer: Column) -> Column:
    """Map of the generated rows in a model's reply, as lines or as a table; empty where it declined."""
    table = F.coalesce(parse_table(answer, 1), F.create_map().cast("map<string,string>"))
    named = F.transform(F.filter(F.split(text(answer), "\n"), lambda x: F.contains(x, F.lit(":"))), lambda x: F.struct(
        F.try_element_at(lookup(ALIASES), label_key(F.regexp_extract(x, r"^([^:]*):", 1))).alias("k"),
        F.trim(F.btrim(squash(F.regexp_extract(x, r"^[^:]*:(.*)$", 1)), F.lit("|"))).alias("v")))
    own = lambda x: x["k"].isin(GENERATED)
    pairs = F.concat(F.transform(F.map_entries(table), lambda x: F.struct(x["key"].alias("k"), x["value"].alias("v"))), named)
    kept = F.filter(first_of_each(F.filter(pairs, lambda x: x["k"].isNotNull() & own(x))), lambda x: clean_value(x["v"]) != "")
    declined = (text(answer) == "") | F.contains(text(answer), F.lit(NO_FIX))
    return F.when(declined, F.create_map().cast("map<string,string>")).otherwise(F.map_from_entries(kept))


def over(base: Column, more: Column) -> Column:
    """Two maps as one; entries of ``more`` replace those of ``base``."""
    return let(more, lambda m: F.map_concat(F.map_filter(base, lambda k, v: ~F.map_contains_key(m, k)), m))


def compose(description: Column, answer: Column) -> Column:
    """The finished table from the ticket's own rows and a reply; '' where the model declined."""
    return let(reply_fields(answer), lambda g: F.when(F.size(g) == 0, "").otherwise(render(over(ticket_fields(description), g))))


def from_raw(description: Column, body: Column, values: Column | None = None) -> Column:
    """The table from a past resolution without a model: a table's generated rows, or prose as one line of steps."""
    own = ticket_fields(description)
    lines_ = F.filter(F.transform(F.split(F.regexp_replace(text(body), MARKS, " "), "\n"), lambda x: F.trim(F.regexp_replace(x, r"^\s*(?:\d+[.)]|[-*•])\s*", ""))), lambda x: x != "")
    solution = F.substring(scrub_identifiers(F.array_join(lines_, "; ")), 1, 500)
    said = let(solution, lambda s: F.create_map(F.lit("Solution applied"), F.when(s == "", "NA").otherwise(s), F.lit("System modified"), F.coalesce(F.nullif(infer_system(s), F.lit("")), F.lit("NA"))))
    return let(parse_table(body) if values is None else values, lambda t: F.when(t.isNotNull(), render(over(own, F.map_filter(t, lambda k, v: k.isin(GENERATED))))).otherwise(render(over(own, said))))


def from_fix_answer(description: Column, block: Column, extra: Column) -> Column:
    """The table that goes with a fix block; ``extra`` (a map) overrides what the block says."""
    inner = F.regexp_replace(text(block), MARKS, "\n")
    pick = lambda label, other: F.when(clean_value(value_of(extra, label)) != "", value_of(extra, label)).otherwise(other)
    tidy = lambda c: F.substring(scrub_identifiers(clean_value(c)), 1, 500)

    def build(solution):
        return render(over(ticket_fields(description), F.create_map(
            F.lit("Cause"), tidy(pick("Cause", cause_of(inner))), F.lit("Solution applied"), solution,
            F.lit("System modified"), pick("System modified", infer_system(solution)), F.lit("Customer action"), tidy(value_of(extra, "Customer action")))))

    return let(tidy(pick("Solution applied", F.array_join(steps(inner), "; "))), build)


def stored_rows(body: Column) -> Column:
    """Struct of what is stored of a resolution's table, each value with its own bound."""
    def build(t):
        return F.struct(t.isNotNull().alias("is_table"), *(F.substring(clean_value(value_of(t, label)), 1, most).alias(name) for name, (label, most) in STORED.items()))

    return let(parse_table(body), build)


def from_stored(stored: Column, body: Column) -> Column:
    """Map of a resolution's rows: those stored, else those that its body has; null if it is no table."""
    pairs = F.filter(F.array(*(F.struct(F.lit(label).alias("k"), clean_value(stored[name]).alias("v")) for name, (label, _) in STORED.items())), lambda x: x["v"] != "")
    return F.when(stored["is_table"] & (F.size(pairs) > 0), F.map_from_entries(pairs)).otherwise(parse_table(body))


def structured_fields(body: Column) -> Column:
    """Map of known labels to cleaned values, where one stands there.

    A label stands at a line's start or after a bar, bold or not, and a colon or a bar
    follows.  Values of error labels run to the line's end, others to a bar; bare numbers
    only count as errors.
    """
    def pair(label, body):
        error = label in ERROR_LABELS
        inside, end = (r"[^*\n]", r"\s*(?:$|\n)") if error else (r"[^*\n|]", r"\*?\s*(?:\||$|\n)")
        raw = F.regexp_extract(body, rf"(?im)(?:^|\n|\|)\s*\*?{label}\*?\s*[:|]\s*\*?({inside}{{1,200}}?){end}", 1)
        real = lambda v: (v != "") if error else (v != "") & ~F.regexp_like(v, F.lit(r"^\d+$"))
        value = let(raw, lambda r: clean_error(r) if error else clean_text(r))
        return let(value, lambda v: F.when(real(v), F.struct(F.lit(label).alias("k"), v.alias("v"))))

    def read(body, low):
        there = (F.when(F.contains(low, F.lit(label.lower())), pair(label, body)) for label in LABELS)  # a label that occurs nowhere is not looked for
        return F.map_from_entries(F.array_compact(F.array(*there)))

    return let(text(body), lambda t: let(F.lower(t), lambda low: read(t, low)))


def field_lines(body: Column) -> Column:
    """The structured fields as ``Label: value`` lines, in the order of the labels."""
    return let(structured_fields(body), lines_of)


def lines_of(fields: Column) -> Column:
    """``field_lines`` of fields that were read before."""
    return F.concat_ws("\n", *(F.when(F.map_contains_key(fields, label), F.concat(F.lit(f"{label}: "), fields[label])) for label in LABELS))


def first_match(body: Column, table: list[tuple[str, str]], default: str = "") -> Column:
    """Name of the first pattern in order that occurs."""
    out = None
    for pattern, name in table:
        out = F.when(F.regexp_like(text(body), F.lit(pattern)), name) if out is None else out.when(F.regexp_like(text(body), F.lit(pattern)), name)
    return F.lit(default) if out is None else out.otherwise(default)
