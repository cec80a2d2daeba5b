"""Normalisation of texts, company names, dates and numbers to hashable strings.

Everything is a column expression, except NFKC and the folding of name suffixes, which Spark lacks: those are Arrow
functions over batches.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.wordlists import ENTITY_SUFFIXES

DATE_FORMATS = ("yyyy-MM-dd", "MM/dd/yyyy", "d MMM yyyy", "d MMMM yyyy", "MMMM d, yyyy", "MMM d, yyyy")
CURRENCY = ("$", "€", "£", "¥", "₹", "₩", "CHF", "USD", "EUR", "GBP")


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFKC", x), na_action="ignore")


def squeeze(c: Column) -> Column:
    """White space of any kind to single blanks, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def normalize_text(c: Column, lower: bool = True, compatibility: bool = True, drop_punctuation: bool = False) -> Column:
    # ASCII is its own compatibility form and stays out of Python
    c = F.coalesce(nfkc(F.when(c.rlike(r"[^\x00-\x7f]"), c)), c) if compatibility else c
    c = F.lower(c) if lower else c
    c = F.regexp_replace(c, r"(?U)[^\w\s]", "") if drop_punctuation else c
    return squeeze(c)


def fold_entity(text: str) -> str:
    """Strip suffixes from the end, of up to four words at a time, until none is left; never to nothing."""
    words = text.split()
    while words:
        for n in range(min(4, len(words)), 0, -1):
            if " ".join(words[-n:]).rstrip(".,;:").replace(".", "") in ENTITY_SUFFIXES:
                del words[-n:]
                break
        else:
            break
    return " ".join(words) or text


@F.pandas_udf(T.StringType())
def _fold(s: pd.Series) -> pd.Series:
    return s.map(fold_entity, na_action="ignore")


def normalize_entity(c: Column) -> Column:
    return _fold(normalize_text(c))


def normalize_date(c: Column) -> Column:
    """ISO date by the first format that fits (slashes: month first), with the time where there is one; else the text."""
    t = F.trim(c)
    days = [F.date_format(F.try_to_timestamp(t, F.lit(f)), "yyyy-MM-dd") for f in DATE_FORMATS]
    time = F.when(t.rlike(r"^\d{4}-\d\d?-\d\d?T\d\d?:\d\d?:\d\d?$"), F.date_format(F.try_to_timestamp(t, F.lit("yyyy-M-d'T'H:m:s")), "yyyy-MM-dd'T'HH:mm:ss"))
    loose = [F.date_format(F.try_to_timestamp(t, F.lit(f)), "yyyy-MM-dd") for f in ("yyyy-M-d", "M/d/yyyy")]
    return F.coalesce(*days, *loose, time, normalize_text(t))


def normalize_number(c: Column) -> Column:
    """Symbols and thousands separators off, fixed-point, no trailing zeros; else the text."""
    t = F.trim(c)
    for s in CURRENCY:
        t = F.replace(t, F.lit(s), F.lit(""))
    t = F.trim(F.replace(t, F.lit(","), F.lit("")))
    d = F.when(t.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), t.try_cast("decimal(38,12)")).cast("string")
    d = F.regexp_replace(F.regexp_replace(d, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.coalesce(F.when(d == "-0", "0").otherwise(d), normalize_text(c))


def canonical_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def coerce_value(c: Column) -> Column:
    """struct(kind, value) of a table cell's text: integer, float (percent is divided by 100), text, or null if blank."""
    raw = F.trim(c)
    t = F.regexp_replace(raw, "[,$€£]", "")
    t = F.trim(t)
    whole = F.regexp_replace(t, r"(?<=\d)_(?=\d)", "")
    is_int = whole.rlike(r"^[+-]?\d+$")
    is_float = whole.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$") | F.lower(whole).rlike(r"^[+-]?(nan|inf|infinity)$")
    share = F.trim(F.regexp_replace(raw, "%$", ""))
    percent = raw.endswith("%") & share.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")
    return (
        F.when(raw == "", F.struct(F.lit("null").alias("kind"), F.lit(None).cast("string").alias("value")))
        .when(is_int, F.struct(F.lit("integer").alias("kind"), whole.try_cast("decimal(38,0)").cast("string").alias("value")))
        .when(is_float, F.struct(F.lit("float").alias("kind"), whole.try_cast("double").cast("string").alias("value")))
        .when(percent, F.struct(F.lit("float").alias("kind"), (share.try_cast("double") / 100).cast("string").alias("value")))
        .otherwise(F.struct(F.lit("text").alias("kind"), raw.alias("value")))
    )


def format_cell(c: Column, kind: str) -> Column:
    """Text of a typed cell: true/false, ISO dates and times, durations as h:mm:ss, bytes in hex; null is empty."""
    if kind == "boolean":
        out = F.when(c, "true").otherwise("false")
    elif kind == "date":
        out = F.date_format(c, "yyyy-MM-dd")
    elif kind.startswith("timestamp"):
        out = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    elif kind == "binary":
        out = F.lower(F.hex(c))
    elif kind.startswith("interval"):
        s = F.extract(F.lit("DAY"), c) * 86400 + F.extract(F.lit("HOUR"), c) * 3600 + F.extract(F.lit("MINUTE"), c) * 60 + F.floor(F.extract(F.lit("SECOND"), c))
        out = F.format_string("%d:%02d:%02d", F.floor(s / 3600).cast("long"), F.floor((s % 3600) / 60).cast("long"), (s % 60).cast("long"))
    else:
        out = c.cast("string")
    return F.when(c.isNull(), "").otherwise(out)
