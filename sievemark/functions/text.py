"""String functions on columns: cleaning, parsing, hashing.

Each takes and returns a Column and stays inside generated code; the empty string
stands for an absent value, and null counts as empty.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and word lists of the matching rules.
DATETIME = r"(?i)\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b|\b\d{4}[/-]\d{1,2}[/-]\d{1,2}\b|\b\d{1,2}:\d{2}(?::\d{2})?\s*(?:am|pm)?\b"
DAY_OR_TIME = r"(?i)\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b|\b\d{1,2}:\d{2}(?::\d{2})?\s*(?:am|pm)?\b"
RECORD_ID = r"\b[0-9][A-Za-z0-9]{14,17}\b"
ANY_RECORD_ID = r"\b(?=[A-Za-z0-9]*\d)[A-Za-z0-9]{15}(?:[A-Za-z0-9]{3})?\b"
LONG_DIGITS = r"(?<![0-9])\d{6,}(?![0-9])"
ORDER_LABEL = r"(?i)(?:Order\s+Id|Order)\s*:\s*"
NON_ASCII, EMPTY_BRACKETS, SPACED_DASH = r"[^\x00-\x7f]+", (r"\(\s*\)", r"\[\s*\]"), r"\s*-\s*"
EDGE = " -|:•‣●"
CODE_DIGITS = 6
CODE_PREFIX = rf"(?s)^[\s*•·▪◦\-|>]*(\d{{1,{CODE_DIGITS}}})\s*\|(.*)$"
POINTER = r"(?i)duplicat\w*|please\s+refer\s+to|refer\s+to\s+(?:the\s+)?(?:ticket|jira|sac)|merged\s+(?:with|into)|tracked\s+(?:in|under)|raised\s+as\s+(?:a\s+)?duplicate"
TICKET_REFERENCE = r"browse/([A-Za-z]+-\d+)|\b([A-Z]{2,}-\d{3,})\b"
HAS_REFERENCE = r"browse/[A-Za-z]+-\d+|smart-?link|\b[A-Z]{2,}-\d{3,}\b"
FIX_BLOCK = r"(?is)===\s*FIX\s*===\s*(.*?)\s*===\s*END\s*==="
FIX_OPEN = r"(?is)===\s*FIX\s*===\s*(.+)$"
UUID = r"\b[A-Fa-f0-9]{8}-[A-Fa-f0-9]{4}-[A-Fa-f0-9]{4}-[A-Fa-f0-9]{4}-[A-Fa-f0-9]{12}\b"
EMAIL = r"\b[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}\b"
PHONE = r"(?<!\w)\+?\d[\d ()-]{8,}\d(?!\w)"
PHONE_TAKEN = r"(^|\W)\+?\d[\d ()-]{8,}\d(\z|\W)"
SEVEN_DIGITS = r"\b\d{7,}\b"
WORD_EDGE = r"(?:(?<!\w)(?=\w)|(?<=\w)(?!\w))"
EMPTY_SPELLINGS = ("", "na", "n/a", "n.a.", "none", "-", "--", "nil")
PLACEHOLDER = r"(?is)^(?:n/?a|none|done|fixed|resolved|closed|ok|completed?|(?:completed?|retr(?:y|ied))\s+(?:the\s+)?(?:failed\s+)?step)[.! ]*$"
AUTOMATIC_CLOSURE = r"(?is)(?:resolved for more than\s+\d+\s+days?\s+with no response|will now be automatically closed|automatically closed due to inactivity)"
ERROR_CODES = (
    r"^\s*\[?(-?\d{1,6})\]?\s*$",
    r"(?i)\b(?:error\s*code|status\s*code|http(?:\s+status)?)\s*[:=# ]+([A-Z][A-Z0-9_-]*|-?\d{1,6})\b",
    r"(?i)\berror\s*[:=#]\s*([A-Z][A-Z0-9_-]*|-?\d{1,6})\b",
    r"^\s*\[?([A-Z][A-Z0-9_-]{1,30}|-?\d{1,6})\]?\s*(?:(?:\||:|-|–)|(?=\s+[A-Z]))",
    r"\b(UNABLE_TO_LOCK_ROW|DUPLICATE_VALUE|REQUEST_LIMIT_EXCEEDED)\b",
)
MEDIA = r"(?i)!\s*[^!\n]*?\.(?:png|jpe?g|gif|bmp|svg|pdf|docx?|xlsx?)[^!\n]*!?"
ATTACHMENT = r"\[\^[^\]\n]+\]"
UPDATE_NOTE, UPDATE_DETAILS = "update from salesforce", ("orderstepid", "order step link", "pr_error_description__c", "lastmodifieddate", "execution log")


def text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, also where a lambda uses it for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ascii_edges(pattern: str) -> str:
    """The pattern with ``\\b`` at words of ``\\w``; by itself it counts other letters as parts of words, which ``\\w`` doesn't."""
    return pattern.replace(r"\b", WORD_EDGE)


def strip_edge(c: Column) -> Column:
    return F.btrim(c, F.lit(EDGE))


def clean_text(c: Column) -> Column:
    """One spelling for equal failures: no per-order noise, markup or non-ASCII."""
    c = F.regexp_replace(F.regexp_replace(text(c), NON_ASCII, " "), DATETIME, " ")
    for pattern in (RECORD_ID, LONG_DIGITS, ORDER_LABEL, r"\*", *EMPTY_BRACKETS):
        c = F.regexp_replace(c, pattern, "")
    c = F.regexp_replace(F.regexp_replace(c, SPACED_DASH, " "), r"\s+", " ")
    return strip_edge(c)


def clean_error(c: Column, digits: int = CODE_DIGITS) -> Column:
    """As ``clean_text``, with a leading ``code |`` kept; longer numbers than ``digits`` are no codes."""
    prefix = CODE_PREFIX.replace(f"{{1,{CODE_DIGITS}}}", f"{{1,{digits}}}")
    code, message = F.regexp_extract(text(c), prefix, 1), clean_text(F.regexp_extract(text(c), prefix, 2))
    return F.when(code == "", clean_text(c)).when(message == "", code).otherwise(F.concat(code, F.lit(" | "), message))


def fix_block(c: Column) -> Column:
    closed, opened = F.regexp_extract(c, FIX_BLOCK, 1), F.regexp_extract(c, FIX_OPEN, 1)
    inner = F.when(F.regexp_like(c, F.lit(FIX_BLOCK)), closed).otherwise(opened)
    return F.when(F.regexp_like(c, F.lit(FIX_OPEN)), F.concat(F.lit("=== FIX ===\n"), F.trim(inner), F.lit("\n=== END ==="))).otherwise(c)


def is_pointer(c: Column) -> Column:
    return F.regexp_like(text(c), F.lit(POINTER)) & F.regexp_like(text(c), F.lit(HAS_REFERENCE))


def referenced_ticket(c: Column) -> Column:
    one, two = (F.regexp_extract(text(c), TICKET_REFERENCE, i) for i in (1, 2))
    return F.upper(F.when(one != "", one).otherwise(two))


def tokens(c: Column) -> Column:
    """Lower-case runs of letters and digits, repeats kept."""
    return F.regexp_extract_all(F.lower(text(c)), F.lit("[a-z0-9]+"), F.lit(0))


def token_set(c: Column) -> Column:
    return F.array_distinct(tokens(c))


def strip_volatile(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, DAY_OR_TIME, " "), ANY_RECORD_ID, " ")


def error_signature(c: Column) -> Column:
    """Struct of the leading code and the distinct tokens of the cleaned rest."""
    code = F.regexp_extract(text(c), CODE_PREFIX, 1)
    rest = F.when(code == "", text(c)).otherwise(F.regexp_extract(text(c), CODE_PREFIX, 2))
    return F.struct(code.alias("code"), token_set(strip_volatile(clean_text(rest))).alias("tokens"))


def signature(step: Column, error: Column) -> Column:
    """Bucket key of a failure: cleaned step and error in small letters."""
    squash = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    return F.concat_ws("||", squash(clean_text(step)), squash(clean_error(error)))


def failure_signature(step: Column, error: Column) -> Column:
    code = error_signature(error)["code"]
    return F.when(code != "", F.concat(F.lit("code:"), code)).when(clean_text(error) != "", F.concat(F.lit("err:"), F.lower(clean_text(error)))).otherwise(F.concat(F.lit("step:"), F.lower(clean_text(step))))


def redact(c: Column, taken: bool = False) -> Column:
    """Identifiers, addresses and long numbers replaced by marks, in that order.

    ``taken``: as engines without look-around do it, which take a number's neighbours along and put them
    back; a plus that is the only thing but one space between two numbers stays then.
    """
    c = F.regexp_replace(F.regexp_replace(text(c), ascii_edges(UUID), "[ID]"), ascii_edges(EMAIL), "[EMAIL]")
    for pattern, mark in ((PHONE_TAKEN, "$1[NUMBER]$2"),) * 2 if taken else ((PHONE, "[NUMBER]"),):
        c = F.regexp_replace(c, pattern, mark)
    return F.regexp_replace(c, ascii_edges(SEVEN_DIGITS), "[NUMBER]")


def has_identifiers(c: Column) -> Column:
    return F.regexp_like(text(c), F.lit(LONG_DIGITS)) | F.regexp_like(text(c), F.lit(ANY_RECORD_ID))


def scrub_identifiers(c: Column) -> Column:
    c = F.regexp_replace(F.regexp_replace(text(c), LONG_DIGITS, ""), ANY_RECORD_ID, "")
    return F.btrim(F.regexp_replace(c, r"\s+", " "), F.lit(" -|,;"))


def normalized(c: Column) -> Column:
    """Alphanumeric tokens in small letters, joined by a space."""
    return F.array_join(tokens(c), " ")


def normalized_step(c: Column) -> Column:
    return normalized(F.regexp_replace(text(c), r"(?i)\s*\(change plan\)\s*$", ""))


def vote_key(c: Column) -> Column:
    """Target of a vote: runs of seven digits and more removed, tokens joined."""
    return normalized(F.regexp_replace(text(c), r"\d{7,}", " "))


def field(c: Column, *names: str, most: int = 500) -> Column:
    """First value over names of ``Label: value`` lines and ``|Label| value`` cells."""
    found = []
    for name in names:
        for pattern in (rf"(?im)^\s*\*{{0,2}}\s*{name}\s*\*{{0,2}}\s*:\s*\*{{0,2}}\s*([^\n]+)$", rf"(?im)^\s*\|{{1,2}}\s*{name}\s*\|{{1,2}}\s*([^\n|]+)"):
            found.append(F.nullif(F.btrim(F.regexp_extract(text(c), pattern, 1), F.lit(" |*\t\r")), F.lit("")))
    return F.substring(F.coalesce(*found, F.lit("")), 1, most)


def parse_failure(c: Column) -> Column:
    """Struct of step and error of a labelled text; a step may also stand inside a summary line."""
    step = field(c, r"Failed\s+Step", "Step")
    inline = F.btrim(F.regexp_extract(text(c), r"(?i)\bFailed\s+Step\s*:\s*(.+?)(?:\s+-\s*Order\s*:|\n|$)", 1), F.lit(" -*|\t"))
    return F.struct(F.when(step != "", step).otherwise(F.substring(inline, 1, 500)).alias("step"), field(c, r"Error\s+Description", r"Error\s+Code", "Error").alias("error"))


def error_code(c: Column) -> Column:
    """First code found by ordered patterns, in capitals; the year of a leading date is passed over."""
    value = F.trim(text(c))
    dated = F.regexp_like(value, F.lit(r"^\s*\d{4}[-/]\d{1,2}[-/]\d{1,2}"))
    found = []
    for pattern in ERROR_CODES:
        code = F.upper(F.regexp_extract(value, pattern, 1))
        found.append(F.when((code != "") & ~(dated & F.regexp_like(code, F.lit(r"^\d{4}$"))), code))
    return F.coalesce(*found, F.lit(""))


def clean_newlines(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text(c), "\r\n?", "\n"), "\n{3,}", "\n\n"))


def epoch(c: Column) -> Column:
    """Seconds since 1970 of an ISO time, 0 where it can't be read."""
    return F.coalesce(F.try_to_timestamp(c).cast("double"), F.lit(0.0))


def clean_value(c: Column) -> Column:
    """A field's value with white space made one, '' for the spellings of nothing."""
    value = F.trim(F.regexp_replace(text(c), r"\s+", " "))
    return F.when(F.lower(value).isin(*EMPTY_SPELLINGS), "").otherwise(value)


def labelled(c: Column, *names: str) -> Column:
    """Value of the first name that labels a line, with the lines up to the next label; null if none does."""
    found = []
    for name in names:
        label = rf"(?im)^[ \t]*(?:\|{{1,2}}[ \t]*|\*{{0,2}}[ \t]*){name}[ \t]*\*{{0,2}}[ \t]*(?:\|{{1,2}}|:)[ \t]*"
        pattern = label + r"(.*(?:\n(?![ \t]*(?:\||\*{0,2}[\w /]{2,40}\*{0,2}[ \t]*:)).*)*)"
        lines_ = F.transform(F.split(F.regexp_extract(text(c), pattern, 1), "\n"), lambda x: F.rtrim(x, F.lit(" |")))
        found.append(F.when(F.regexp_like(text(c), F.lit(label)), F.regexp_replace(F.array_join(lines_, "\n"), r"^\s+|\s+$", "")))
    return F.coalesce(*found)


def resolution_text(c: Column) -> Column:
    """The solution field, else the fix block, else the whole body."""
    block = r"(?is)===\s*fix\s*===\s*(.*?)(?:===\s*end\s*===|$)"
    inner = F.when(F.regexp_like(text(c), F.lit(block)), F.trim(F.regexp_extract(text(c), block, 1)))
    return F.coalesce(labelled(c, r"Solution Applied", "Resolution", "Workaround", "Fix"), inner, F.trim(text(c)))


def resolution_evidence(c: Column) -> Column:
    """Solution and customer action, one after the other."""
    return F.concat_ws("\n", F.nullif(resolution_text(c), F.lit("")), F.nullif(labelled(c, "Customer Action"), F.lit("")))


def lines(c: Column) -> Column:
    return F.filter(F.transform(F.split(text(c), "\n"), lambda x: F.trim(F.regexp_replace(x, r"^\s*(?:\d+[.)]|[-*])\s*", ""))), lambda x: x != "")


def is_placeholder(c: Column) -> Column:
    return F.forall(lines(c), lambda x: F.regexp_like(x, F.lit(PLACEHOLDER)))


def is_automatic_closure(c: Column) -> Column:
    return F.regexp_like(text(c), F.lit(AUTOMATIC_CLOSURE))


def strip_media(c: Column) -> Column:
    """The prose around embedded media and attachment links, with the blank runs they leave made one."""
    bare = F.regexp_replace(F.regexp_replace(text(c), MEDIA, " "), ATTACHMENT, " ")
    return F.regexp_replace(F.regexp_replace(bare, r"\n\s*\n+", "\n\n"), r"^\s+|\s+$", "")


def is_generated(c: Column, *markers: str) -> Column:
    """An automatic closure, an update that another system posted, or a comment with an own marker."""
    low = F.lower(text(c))
    found = is_automatic_closure(c) | (F.contains(low, F.lit(UPDATE_NOTE)) & F.greatest(*(F.contains(low, F.lit(d)) for d in UPDATE_DETAILS)))
    for m in markers:
        found = found | F.contains(text(c), F.lit(m))
    return found


def bounded_query(c: Column, most: int = 1800) -> Column:
    half = (most - 5) // 2
    return F.when(F.length(text(c)) <= most, text(c)).otherwise(F.concat(F.substring(c, 1, half), F.lit("\n...\n"), F.right(c, F.lit(half))))


def sha256_norm(*cs: Column) -> Column:
    """Hash of normalised parts joined by a bar."""
    return F.sha2(F.concat_ws("|", *(F.lower(F.trim(F.regexp_replace(text(c), r"\s+", " "))) for c in cs)), 256)


def canonical_json(struct: Column) -> Column:
    """Compact JSON; give the struct's fields in name order."""
    return F.to_json(struct, {"ignoreNullFields": "false"})


def quote_is_present(quote: Column, body: Column, least: int = 12) -> Column:
    squash = lambda c: F.trim(F.regexp_replace(text(c), r"\s+", " "))
    return (F.length(squash(quote)) >= least) & F.contains(squash(body), squash(quote))
