"""Locale-tolerant number parsing and null tokens, as Column -> Column.

All work is JVM-side string/regex expressions plus a guarded ``try_cast`` so
the parse stays inside whole-stage codegen and never raises under ANSI mode.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tokens read as "no value" (compared trimmed, lower-case).
NULL_TOKENS = ["nr", "nd", "na", "", "-"]

# A plain decimal literal after cleaning: optional sign, digits with an optional
# point, optional exponent.  Anything else ("1d", "0x1f", "1.2.3", "nan", "inf")
# is not a number for the engine.
NUMERIC_RE = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
# Thousands grouping with commas, e.g. 1,234 or 12,345,678.9 (opt-in mode).
THOUSANDS_RE = r"^[+-]?[0-9]{1,3}(,[0-9]{3})+(\.[0-9]+)?$"
# Whitespace stripped at both ends (ASCII whitespace and the common Unicode
# blanks a spreadsheet export leaves behind).
_WS_CLASS = r"[\s\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
# the same set as single characters, for trim()
_EDGE_CHARS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B))
               + "\u2028\u2029\u202f\u205f\u3000")


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def null_tokens(c, tokens=NULL_TOKENS) -> Column:
    """Cells equal to a null token (trimmed, any case) become null."""
    c = _c(c)
    return F.when(F.lower(F.trim(c)).isin(list(tokens)), F.lit(None)).otherwise(c)


def strip_blanks(c) -> Column:
    """Remove blanks and NBSP everywhere, then any other whitespace at both
    ends (character translation + trim; no regex)."""
    s = F.translate(_c(c).cast("string"), " \u00A0", "")
    return F.trim(s, F.lit(_EDGE_CHARS))


def fix_separators(s, comma: str = "decimal") -> Column:
    """Comma/point rewrite of blank-free text.

    * with both ``,`` and ``.`` present the commas are dropped (grouping);
    * with only ``,`` present it is the decimal mark (``comma="decimal"``,
      the reference behaviour: ``4,900`` -> ``4.900``).  ``comma="auto"``
      first treats a well-formed thousands pattern (``4,900``) as grouping.

    One ``translate`` whose target depends on the presence of a point: the
    input is referenced twice only, so the expression stays small even after
    Catalyst inlines it into pushed-down filters.
    """
    s = _c(s)
    if comma == "auto":
        target = F.when(F.instr(s, ".") > 0, F.lit("")).when(
            s.rlike(THOUSANDS_RE), F.lit("")).otherwise(F.lit("."))
        return F.call_function("translate", s, F.lit(","), target)
    if comma != "decimal":
        raise ValueError(f"comma must be 'decimal' or 'auto', got {comma!r}")
    target = F.when(F.instr(s, ".") > 0, F.lit("")).otherwise(F.lit("."))
    return F.call_function("translate", s, F.lit(","), target)


def to_double(t) -> Column:
    """Guarded cast of rewritten text: only a plain decimal literal (the
    whole cell) becomes a number; anything else ("1d", "nan", "inf",
    "1.2.3") extracts "" and casts to null.  The input is referenced once,
    so the expression stays small when Catalyst inlines it into pushed-down
    filters.  An overflowing exponent gives infinity, like the reference."""
    return F.regexp_extract(_c(t), NUMERIC_RE, 0).try_cast("double")


def clean_number_text(c, comma: str = "decimal") -> Column:
    """The textual rewrite applied before the cast."""
    return fix_separators(strip_blanks(c), comma)


def parse_locale_number(c, comma: str = "decimal") -> Column:
    """Text -> DOUBLE with the locale rules; unparsable -> null.

    NaN never comes out ("nan" is not a literal here), so later binning never
    sees it (Spark orders NaN above every number).  Null tokens (``nr``,
    ``-``, ...) need no special case: they are not literals either.
    """
    return to_double(clean_number_text(c, comma))


def parse_cell(c, comma: str = "decimal", tokens=NULL_TOKENS) -> Column:
    """Null tokens first, then the locale parse."""
    return parse_locale_number(null_tokens(c, tokens), comma)
