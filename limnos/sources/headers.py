"""Header canonicalisation (B1-B3, B6 detection).

Header names are driver-side metadata: the mapping is computed from
``df.columns`` and applied with ONE ``select(col.alias)`` — no data pass.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FEATURES = ["ph", "temp_c", "cond_us_cm", "do_mg_l", "turb_ntu"]
TARGET = "chl_ug_l"

# Words that name a quantity, in the surveys' languages.
WORDS = {
    "ph": "ph", "temp": "temp_c", "temperatura": "temp_c", "temperature": "temp_c",
    "conductividad": "cond", "conductivity": "cond",
    "oxigeno": "do_mg_l", "oxygen": "do_mg_l", "do": "do_mg_l", "od": "do_mg_l", "o2": "do_mg_l",
    "turbidez": "turb_ntu", "turbiedad": "turb_ntu", "turbidity": "turb_ntu",
    "clorofila": "chl_ug_l", "chlorophyll": "chl_ug_l", "ficocianina": "phyco_ug_l",
    "fecha": "fecha", "hora": "hora", "sitio": "sitio",
}
# Written like this a unit belongs to a quantity even where no word names it.
UNITS = {"ntu": "turb_ntu"}
#: Columns that a header names by one word and at most a unit.
ALONE = {"ph", "phyco_ug_l", "fecha", "hora", "sitio"}
_UNIT = re.compile(r"[a-z]+/[a-z]+|\bmgl\b|\buscm\b|\bntu\b|°? ?c(?=\))")


def plain(name: str) -> str:
    """A header's letters: compatibility forms unfolded, accents and
    non-printable characters (a BOM included) gone, micro signs as ``u``."""
    unfolded = unicodedata.normalize("NFKD", str(name)).translate({0xB5: "u", 0x3BC: "u"})
    kept = (c for c in unfolded if c.isprintable() and not unicodedata.combining(c))
    return " ".join("".join(kept).lower().split())


def canonical_name(name: str) -> str:
    """Column that a header stands for: the quantity that its words name, told
    apart by its unit.  A header that names none, or more than one, stays."""
    text = plain(name)
    units = set(_UNIT.findall(text))
    words = re.findall(r"[a-z0-9]+", _UNIT.sub(" ", text))
    named = {WORDS[w] for w in words if w in WORDS} or {UNITS[u] for u in units if u in UNITS}
    if "do_mg_l" in named and not any(u.startswith("mg") for u in units):
        named.discard("do_mg_l")                # a bare "do" or "o2" may be anything
    if len(named) != 1 or (named <= ALONE and len(words) > 1):
        return name.replace("(mg/l)", "(mg/L)")
    column = named.pop()
    if column == "cond":
        return "cond_ms_cm" if "ms/cm" in units else "cond_us_cm"
    return column


def header_mapping(columns: list[str]) -> dict[str, str]:
    """Original -> canonical; raises when two headers collapse to one name."""
    out, seen = {}, {}
    for c in columns:
        n = canonical_name(c)
        if n in seen:
            raise ValueError(f"headers {seen[n]!r} and {c!r} both map to {n!r}")
        seen[n] = c
        out[c] = n
    return out


def canonical_headers(df: DataFrame) -> DataFrame:
    """Rename every column to its canonical name in one projection."""
    m = header_mapping(df.columns)
    return df.select(*[F.col(f"`{c}`").alias(n) for c, n in m.items()])


def require_columns(df: DataFrame, cols) -> DataFrame:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df
