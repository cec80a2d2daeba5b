"""Entity filters: dates, money, percentages, durations and numbers in sentences or paragraphs, with salience."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_MONTH = "(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sep(?:t(?:ember)?)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
_NUM = r"(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?"
#: One grammar a type; the same text serves Java and Python.
TYPES = {
    "date": rf"(?i)\b(?:\d{{4}}-\d{{2}}-\d{{2}}|\d{{1,2}}/\d{{1,2}}/\d{{4}}|{_MONTH}\.? \d{{1,2}}(?:st|nd|rd|th)?,? \d{{4}}|\d{{1,2}} {_MONTH} \d{{4}})\b",
    "money": rf"(?i)(?:[$€£¥] ?{_NUM}(?: ?(?:million|billion|thousand|mn|bn|k))?|\b{_NUM} ?(?:dollars|euros|pounds|usd|eur|gbp)\b|\b(?:usd|eur|gbp|chf) ?{_NUM})",
    "percent": rf"(?i)(?:\b{_NUM} ?%|\b{_NUM} (?:percent|per cent|basis points)\b)",
    "duration": rf"(?i)\b(?:{_NUM}|one|two|three|four|five|six|seven|eight|nine|ten|thirty|sixty|ninety)(?: \(\d+\))?[ -](?:second|minute|hour|day|week|month|quarter|year)s?\b",
    "number": rf"\b{_NUM}\b",
}
_compiled = {k: re.compile(v, re.ASCII if k == "number" else 0) for k, v in TYPES.items()}


def count_expr(text: Column, kind: str) -> Column:
    return F.regexp_count(text, F.lit(TYPES[kind]))


def values_expr(text: Column, kind: str) -> Column:
    return F.regexp_extract_all(text, F.lit(TYPES[kind]), F.lit(0))


def matches(kind: str):  # noqa: ANN201
    """Function of texts: matches with code point offsets."""
    pattern = _compiled[kind]

    @F.pandas_udf("array<struct<start:int,end:int,text:string>>")
    def find(s: pd.Series) -> pd.Series:
        return s.map(lambda t: [{"start": m.start(), "end": m.end(), "text": m.group()} for m in pattern.finditer(t)], na_action="ignore")

    return find


def salience(text: Column, distinct: Column, position: Column, total: Column, after_heading: Column) -> Column:
    """0.6 of how many distinct values, 0.2 of the place (a floor, the last tenth, a bonus under headings), 0.2 of the length."""
    count = F.least(F.lit(1.0), distinct / 3.0)
    back = F.greatest(F.lit(0.0), (position / total - 0.9) / 0.1)
    place = F.when(total <= 1, 1.0).otherwise(F.greatest(F.lit(0.25), back))
    place = F.when(after_heading, F.least(F.lit(1.0), place + 0.3)).otherwise(place)
    n = F.length(text)
    band = F.when((n <= 20) | (n >= 400), 0.0).when(n < 40, (n - 20) / 20.0).when(n <= 200, 1.0).otherwise((400 - n) / 200.0)
    return F.when(distinct <= 0, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.6 * count + 0.2 * place + 0.2 * band)))


def ranked(found: DataFrame, by: str = "salience", k: int = 10) -> DataFrame:
    """The first k filtered units: by salience, then in the order of the corpus, or by position alone."""
    if by not in ("salience", "position"):
        raise ValueError(f"unknown order {by}: salience or position")
    order = [F.desc("salience")] if by == "salience" else []
    return found.orderBy(*order, "doc_id", "n").limit(k)


def filter_units(units: DataFrame, kind: str) -> DataFrame:
    """Units (doc_id, n, total, after_heading, text) that hold the type, with values and salience."""
    v = F.array_distinct(values_expr(F.col("text"), kind))
    got = units.withColumn("values", v).where(F.size("values") > 0)
    return got.withColumn("salience", salience(F.col("text"), F.size("values"), F.col("n"), F.col("total"), F.col("after_heading")))
