"""Text expressions: white space, normalization, estimates, identifiers and titles.

Positions are Unicode code points. Public offsets are 0-based and half-open; the
1-based functions of SQL are wrapped here and nowhere else.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The code points that count as white space, as a class body for Java's regex engine.
WS_BODY = r"\x09-\x0d\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WS = f"[{WS_BODY}]"
WS_CODES = (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
# Ends of lines.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}]"
# Typographic quotes and dashes, with the plain character that each folds to.
CONFUSABLES = {
    "‘": "'", "’": "'", "‚": "'", "‛": "'", "′": "'", "´": "'", "`": "'",
    "“": '"', "”": '"', "„": '"', "‟": '"', "″": '"',
    "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "―": "-", "−": "-",
}
KNOWN_ROLES = ("requirement", "questionnaire", "context")
DEFAULT_ROLE = "requirement"


def strip(text: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(F.regexp_replace(text, f"^{WS}+", ""), rf"{WS}+\z", "")


def repair_hyphens(text: Column) -> Column:
    """Join words that a line end split after a hyphen (between ASCII lower-case letters)."""
    return F.regexp_replace(text, r"([a-z])-\n([a-z])", "$1$2")


def normalize_block(text: Column) -> Column:
    """Hyphens repaired, line ends and runs of spaces and tabs to one space, stripped; other white space stays inside."""
    return strip(F.regexp_replace(F.translate(repair_hyphens(text), "\n", " "), r"[ \t]+", " "))


def fold_confusables(text: Column) -> Column:
    return F.translate(text, "".join(CONFUSABLES), "".join(CONFUSABLES.values()))


def collapse(text: Column) -> Column:
    """Every run of white space to one space, quotes and dashes folded."""
    return fold_confusables(F.regexp_replace(text, f"{WS}+", " "))


def needle(text: Column) -> Column:
    """A quote as it is searched for."""
    return fold_confusables(strip(F.regexp_replace(text, f"{WS}+", " ")))


def estimate_tokens(chars: Column) -> Column:
    return (F.floor(chars / 4) + 1).cast("long")


def text_slice(text: Column, start: Column, end: Column) -> Column:
    """Code points [start, end); '' where the bounds are missing, negative or reversed."""
    fine = text.isNotNull() & start.isNotNull() & end.isNotNull() & (start >= 0) & (end >= start)
    return F.when(fine, F.substring(text, (start + 1).cast("int"), (end - start).cast("int"))).otherwise(F.lit(""))


def find(text: Column, quote: Column, since: Column) -> Column:
    """0-based position of the first occurrence at or after ``since``; -1 if none or the quote is empty."""
    # locate() with a column as start is only in SQL: search the rest and add what was cut
    rest = F.substring(text, (since + 1).cast("int"), F.length(text))
    at = F.instr(rest, quote)
    return F.when((F.length(quote) > 0) & (at > 0), at - 1 + since).otherwise(F.lit(-1)).cast("long")


def span_key(doc_hash: Column, start: Column) -> Column:
    return F.when(start >= 0, F.concat(F.substring(doc_hash, 1, 12), F.lit(":"), start.cast("string"))).otherwise(F.lit(""))


def run_id(stamp: Column, doc_hash: Column) -> Column:
    """From an ISO time stamp and a document's hash."""
    return F.concat(F.regexp_replace(F.substring(stamp, 1, 19), "[-:]", ""), F.lit("Z-"), F.substring(doc_hash, 1, 8))


def title(text: Column) -> Column:
    """The first sentence's beginning, at most 80 of the first 160 characters; null if nothing is left."""
    edge = r"[ .:\-—]"
    head = strip(F.substring(text, 1, 160))
    head = F.regexp_replace(F.regexp_replace(head, f"^{edge}+", ""), rf"{edge}+\z", "")
    stop = F.instr(head, ".")
    head = F.when(stop > 1, F.substring(head, F.lit(1), stop - 1)).otherwise(head)
    return F.nullif(F.substring(strip(head), 1, 80), F.lit(""))


def heading_ident(matched: Column) -> Column:
    """A heading's identifier without its section sign, white space collapsed."""
    bare = F.regexp_replace(strip(matched), f"^§{WS}*", "")
    return F.regexp_replace(bare, f"{WS}+", " ")


def normalize_role(role: Column) -> Column:
    return F.coalesce(F.nullif(strip(role), F.lit("")), F.lit(DEFAULT_ROLE))


def role_text(full_text: Column, segments: Column, role: str) -> Column:
    """Slices of one role's segments in their order, joined by an empty line."""
    own = F.filter(segments, lambda s: (s["role"] == role) & (s["end"] > s["start"]))
    return F.array_join(F.transform(own, lambda s: text_slice(full_text, s["start"], s["end"])), "\n\n")


def input_token_budget(prompt_chars: int | Column, context_window: int = 200_000, output: int = 8000, margin: int = 8000, schema: int = 1200, cap: int | None = None) -> int | Column:
    """Tokens of input that a model's window leaves beside a prompt: of a number of characters, or of a column of them."""
    fixed = context_window - schema - output - margin
    if isinstance(prompt_chars, Column):
        left = F.greatest(F.lit(fixed) - estimate_tokens(prompt_chars), F.lit(0)).cast("long")
        return left if cap is None else F.least(left, F.lit(cap).cast("long"))
    left = max(fixed - (prompt_chars // 4 + 1), 0)
    return left if cap is None else min(left, cap)
