"""String functions on columns."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    """Without white space of any kind at its ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def fold(c: Column) -> Column:
    """Lower case, white space collapsed; null as empty."""
    return F.lower(strip(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " ")))


def snake_id(c: Column) -> Column:
    """Letters and digits of the folded text, other runs as ``_``; ``field`` if nothing is left."""
    s = F.regexp_replace(F.regexp_replace(fold(c), r"[^\p{L}\p{N}]+", "_"), "^_+|_+$", "")
    return F.when(s == "", "field").otherwise(s)


def capital(w: Column) -> Column:
    return F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 30)))


def title_label(c: Column) -> Column:
    s = F.array_join(F.transform(F.split(c, "_", -1), capital), " ")
    return F.when(s == "", "Field").otherwise(s)


SMALL_WORDS = ("and", "for", "of", "or", "to", "with")


def human_label(key: Column) -> Column:
    """A spec key for people: no ``spec_``, blanks for separators, capitals except on small words."""
    bare = strip(F.regexp_replace(F.regexp_replace(strip(key), "(?i)^spec_", ""), "[_-]", " "))
    words = F.filter(F.split(bare, r"(?U)\s+"), lambda w: w != "")
    out = F.array_join(F.transform(words, lambda w: F.when(F.lower(w).isin(*SMALL_WORDS), F.lower(w)).otherwise(capital(w))), " ")
    return F.when(out == "", key).otherwise(out)


#: The vulgar fractions and what they stand for, told by their own decompositions.
FRACTIONS = {c: unicodedata.normalize("NFKD", c).replace("⁄", "/") for c in "½¼¾⅛⅜⅝⅞⅐⅑⅒⅓⅔⅕⅖⅗⅘⅙⅚"}
_QUOTES = ("″”“′’‘", "\"\"\"'''")


def plain_value(c: Column, apart: bool = False) -> Column:
    """A spec value with ASCII fractions, quotes, degrees and blanks; ``apart``: ``1½`` as ``1 1/2``, not ``11/2``."""

    def signs(s: Column) -> Column:
        if apart:
            s = F.regexp_replace(s, f"(\\d)([{''.join(FRACTIONS)}])", "$1 $2")
        for sign, ascii_form in FRACTIONS.items():
            s = F.replace(s, F.lit(sign), F.lit(ascii_form))
        s = F.translate(s, _QUOTES[0] + "\u00a0\u202f", _QUOTES[1] + "  ")
        return F.replace(F.replace(s, F.lit("℉"), F.lit("°f")), F.lit("℃"), F.lit("°c"))

    return let(strip(F.coalesce(c, F.lit(""))), lambda s: F.when(F.rlike(s, F.lit(r"[^\x00-\x7f]")), signs(s)).otherwise(s))


def parse_number(c: Column) -> Column:
    """Double of ``7``, ``7.5``, ``1/2``, ``1 1/2`` or ``1-1/2``, signed, thousands commas dropped; else null."""
    shape = r"^[+-]?(?:(\d+)\s*[ -]\s*)?(\d+)\s*/\s*(\d+)$"

    def read(s: Column) -> Column:
        part = lambda i: F.nullif(F.regexp_extract(s, shape, i), F.lit("")).try_cast("double")
        sign = F.when(F.startswith(s, F.lit("-")), -1.0).otherwise(1.0)
        return F.when(F.rlike(s, F.lit(r"^[+-]?\d+(?:\.\d+)?$")), s.try_cast("double")).when(F.contains(s, F.lit("/")), sign * (F.coalesce(part(1), F.lit(0.0)) + F.try_divide(part(2), part(3))))

    return let(F.replace(strip(c), F.lit(","), F.lit("")), read)


@F.pandas_udf(StringType())
def nfkd(s: pd.Series) -> pd.Series:
    """Compatibility decomposition, for which Spark has no function."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKD", x))


def sku_form(c: Column, decompose: bool = True) -> Column:
    """A-Z and 0-9 of the upper-cased text; ``decompose=False`` stays native and is the same for ASCII."""
    return F.regexp_replace(F.upper(nfkd(F.coalesce(c, F.lit(""))) if decompose else F.coalesce(c, F.lit(""))), "[^A-Z0-9]", "")


def looks_like_sku(c: Column, decompose: bool = True) -> Column:
    return F.length(sku_form(c, decompose)).between(4, 24)


_HEADS = "|".join(f"{verb}(?:\\s+(?:a|an|the))?" for verb in (r"i\s+need", r"looking\s+for", "need", "find"))


def object_query(c: Column) -> Column:
    """The thing a query asks for: what stands before a stop word, without an opening phrase, three words at most."""
    q = strip(c)
    head = strip(F.get(F.split(q, r"(?iU)\b(?:compatible|designed|fits|for|supporting|supports|that|to|which|with|working|works)\b", 2), F.lit(0)))
    head = strip(F.regexp_replace(head, f"(?iU)^(?:{_HEADS})\\s+", ""))
    words = F.filter(F.split(head, r"(?U)\s+"), lambda w: w != "")
    head = F.when(F.size(words) > 3, F.array_join(F.slice(words, 1, 3), " ")).otherwise(head)
    return F.when(head == "", q).otherwise(head)
