"""Dates in free text."""

from __future__ import annotations

import datetime as dt
import functools
import re

import pandas as pd
from dateutil import parser
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_MONTH = "jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?"
_PART = rf"(?:\d{{1,4}}(?:st|nd|rd|th)?|(?:{_MONTH})\.?)"
#: Three numbers or months in a row, apart by little; a lookahead, so that candidates may overlap.
CANDIDATE = rf"(?i)(?=\b({_PART}[\s,./-]{{1,3}}(?:of\s+)?{_PART}[\s,./-]{{1,3}}{_PART})(?![\d]))"
TIMES = r"\b\d?\d:\d\d(?::\d\d)?\b"
_DEFAULTS = (dt.datetime(2020, 9, 1), dt.datetime(1999, 6, 2))


def preprocess(text: Column, patterns: list[str] | None = None) -> Column:
    """The text without clock times and without what the given patterns match."""
    for p in [TIMES, *(patterns or [])]:
        text = F.regexp_replace(text, p, "")
    return text


@functools.lru_cache(1 << 16)
def parse(raw: str) -> dt.datetime | None:
    """The date, if day, month and year are all in the string: two different defaults must give one result.

    The parser is slow, and dates are repeated; so results are kept, of a bounded number of strings.
    """
    try:
        a, b = (parser.parse(raw, fuzzy=True, default=d) for d in _DEFAULTS)
    except (ValueError, OverflowError, TypeError):
        return None
    return a.replace(tzinfo=None) if a == b else None


def find_dates_value(candidates, start: dt.date | None, end: dt.date | None) -> list[tuple[dt.datetime, str]]:
    out, seen = [], set()
    for raw in candidates:
        d = parse(re.sub(r"(?<=\d)(st|nd|rd|th)\b", "", raw, flags=re.I))
        if d is None or (start and d.date() < start) or (end and d.date() > end):
            continue
        if d.date() not in seen:
            seen.add(d.date())
            out.append((d, raw))
    return out


def find_dates(text: Column | str, cutoff_start: str | None = None, cutoff_end: str | None = None, patterns: list[str] | None = None) -> Column:
    """array<struct<ts, raw>> of the different dates in a text, in order, within the (inclusive) range.

    Candidates come from one expression in the JVM; only these short strings go to the parser.
    """
    text = F.col(text) if isinstance(text, str) else text
    start, end = (dt.date.fromisoformat(x) if x else None for x in (cutoff_start, cutoff_end))

    @F.pandas_udf("array<struct<ts:timestamp,raw:string>>")
    def run(found: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else [{"ts": d, "raw": r} for d, r in find_dates_value(x, start, end)] for x in found])

    return run(F.regexp_extract_all(preprocess(text, patterns), F.lit(CANDIDATE), F.lit(1)))


def dates_table(df: DataFrame, id_col: str, text_col: str, **options) -> DataFrame:
    """(doc_id, ts, raw), a row for each date."""
    return df.select(F.col(id_col).alias("doc_id"), F.explode(find_dates(text_col, **options)).alias("d")).select("doc_id", "d.ts", "d.raw")
