"""Column functions over the texts of drawings, standards and reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The prefixes, limits and prices of the review rules.
STANDARD_PREFIXES = ("TSS", "SOP", "ISO", "DIN", "JIS", "ASTM", "ASME", "ANSI", "IEC", "NTB")
MAX_EVIDENCE = 150
INPUT_PRICE, OUTPUT_PRICE = 0.075, 0.30  # USD for a million tokens


def strip(c) -> Column:
    """Remove white space of all kinds at both ends; ``trim`` alone removes spaces."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def normalize_text(c) -> Column:
    """Lower case, letters a-z, digits and single spaces only; null becomes empty."""
    return F.coalesce(F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9 ]", ""), r"\s+", " ")), F.lit(""))


def normalize_standard(c) -> Column:
    """``PREFIX rest`` for a code with a letter prefix and a number, else upper case with single spaces; null becomes empty.

    Letters and a number alone, as most codes are, come first: two expressions give what all of them would.
    """
    plain = r"^([A-Za-z]+)[-_ ]*([0-9]+)\z"
    spaced = strip(F.regexp_replace(c, "[-_]", " "))
    shape = r"^([A-Za-z]+)\s*(\d+.*)$"
    coded = F.concat(F.upper(F.regexp_extract(spaced, shape, 1)), F.lit(" "), strip(F.regexp_extract(spaced, shape, 2)))
    return F.coalesce(F.when(F.rlike(c, F.lit(plain)), F.upper(F.regexp_replace(c, plain, "$1 $2"))).when(F.rlike(spaced, F.lit(shape)), coded).otherwise(F.upper(F.regexp_replace(spaced, r"\s+", " "))), F.lit(""))


def _integer(c, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, 1), F.lit("")).try_cast("int")


def note_number(c) -> Column:
    """Number of the first ``NOTE n:`` or ``NOTE n.``, else a leading ``n.``, else null."""
    return F.coalesce(_integer(c, r"(?i)\bNOTE?S?\s+(\d+)\s*[:.]"), _integer(c, r"^\s*(\d+)\.\s+"))


def split_list(c) -> Column:
    """Distinct parts between commas or semicolons, trimmed, without empty ones; null gives an empty list."""
    parts = F.transform(F.split(c, "[;,]"), strip)
    return F.coalesce(F.array_distinct(F.filter(parts, lambda x: x != "")), F.array().cast("array<string>"))


def tokens(c) -> Column:
    """Distinct words of the normalised text."""
    return F.array_distinct(F.filter(F.split(normalize_text(c), " "), lambda x: x != ""))


def jaccard(a, b) -> Column:
    """Jaccard similarity of the word sets; 0 if either is empty."""
    x, y = tokens(a), tokens(b)
    return F.when((F.size(x) == 0) | (F.size(y) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


def token_cost(prompt, completion) -> Column:
    """Price of a call in USD."""
    return prompt / 1e6 * INPUT_PRICE + completion / 1e6 * OUTPUT_PRICE


def fixed(x, digits: int) -> Column:
    """``x`` (not negative; null stays null) with ``digits`` decimals, rounded by its exact binary value, ties to even.

    ``format_string`` rounds the shortest decimal that stands for the double instead. The value is
    split into two halves whose products with the scale are exact, so the distance to the tie is too.
    """
    scale = float(10**digits)
    high = x * 134217729.0 - (x * 134217729.0 - x)
    whole = F.floor(x * scale)
    off = (high * scale - (whole + F.lit(0.5))) + (x - high) * scale
    units = F.when((off > 0) | ((off == 0) & (whole % 2 == 1)), whole + 1).otherwise(whole)
    return F.when(x.isNotNull(), F.format_string(f"%d.%0{digits}d", F.floor(units / int(scale)), units % int(scale)))


def status_class(c) -> Column:
    """observation, correction or approved, in this order of precedence; null without any."""
    low = F.lower(strip(c))
    return (
        F.when(low.contains("observa"), "observation")
        .when(low.contains("requer") | low.contains("correc") | low.contains("correç") | low.contains("fixing"), "correction")
        .when(low.contains("aprovado"), "approved")
    )


def report_text(c, line_break: str = "; ") -> Column:
    """Replace HTML line breaks and drop bold marks."""
    return F.regexp_replace(F.regexp_replace(c, r"(?i)<br\s*/?>", line_break), r"\*\*", "")


def bullets(c) -> Column:
    """Trimmed parts between semicolons, without empty ones; null for a text without a semicolon."""
    return F.when(F.contains(c, F.lit(";")), F.filter(F.transform(F.split(c, ";"), strip), lambda x: x != ""))


def join_list(c, separator: str = "; ") -> Column:
    """Parts joined; empty for null."""
    return F.coalesce(F.array_join(c, separator), F.lit(""))


def fill_prompt(template: str, slots: dict[str, Column]) -> Column:
    """``template`` with each ``{{name}}`` replaced by its column; an empty list reads ``Nenhuma``."""
    out = F.lit(template)
    for name, value in slots.items():
        out = F.replace(out, F.lit("{{" + name + "}}"), value)
    return out


def listed(c) -> Column:
    return F.when(F.size(c) > 0, F.array_join(c, ", ")).otherwise("Nenhuma")


def conformity_band(share) -> Column:
    return F.when(share >= 0.8, "satisfactory").when(share >= 0.5, "partial").when(share.isNotNull(), "insufficient")


def zone_row(c) -> Column:
    """Letter of a zone token, upper case."""
    return F.upper(F.regexp_extract(c, "([A-Za-z])", 1))


def zone_column(c) -> Column:
    """Digits of a zone token, as written."""
    return F.regexp_extract(c, r"(\d+)", 1)


def has_number(texts) -> Column:
    return F.exists(texts, lambda t: t.rlike(r"\d+[.,]?\d*"))


def has_letter(texts) -> Column:
    return F.exists(texts, lambda t: strip(t).rlike("^[A-Z]$"))
