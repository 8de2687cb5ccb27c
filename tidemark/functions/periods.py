"""Months and dates as text: keys like 2026-08, hints like 202608, and ISO dates."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Month names, and what "as of" dates and file names look like (the latter in period_hint).
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]


def month_number(name: Column) -> Column:
    """1 to 12 for a month's whole English name in any case, else null."""
    at = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(name)).cast("int")
    return F.nullif(at, F.lit(0))


def _key(year: Column, month: Column) -> Column:
    return F.concat(year, F.lit("-"), F.lpad(month.cast("string"), 2, "0"))


def period_key(period: Column, strict: bool = False) -> Column:
    """"August 2026" to "2026-08"; null if it isn't a month and a year, or an error with ``strict``."""
    start = r"^\s*([A-Za-z]+)\s+(\d{4})"
    found = _key(F.regexp_extract(period, start, 2), month_number(F.regexp_extract(period, start, 1)))
    if not strict:
        return found
    return F.when(found.isNotNull(), found).otherwise(F.raise_error(F.concat(F.lit("not a period: "), F.coalesce(period, F.lit("null")))))


_AS_OF = r"(?i)as of\s+([A-Za-z]+)\s+\d{1,2},?\s*(\d{4})"


def stated_month(text: Column) -> Column:
    """The word after "as of" that a day and a year follow, in lower case; null if there is none."""
    return F.lower(F.nullif(F.regexp_extract(text, _AS_OF, 1), F.lit("")))


def stated_year(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, _AS_OF, 2), F.lit(""))


def nearest_month(word: str, cutoff: float = 0.8) -> int | None:
    """The month whose name is most like ``word``, if the matching-blocks ratio reaches ``cutoff``."""
    close = difflib.get_close_matches(word, MONTHS, n=1, cutoff=cutoff)
    return MONTHS.index(close[0]) + 1 if close else None


def closest_month(words: DataFrame, column: str = "word") -> DataFrame:
    """Distinct non-null words with ``month`` (1 to 12 or null): exact names by an expression, others by similarity.

    Spark has no such ratio, so the few misspelt words, each once, go through a batch function; join the result back.
    """
    distinct = words.select(F.lower(F.trim(F.col(column))).alias(column)).where(F.col(column).isNotNull()).distinct()
    known = distinct.withColumn("month", month_number(F.col(column)))

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[[column]].assign(month=pd.array([nearest_month(w) for w in batch[column]], dtype="Int32"))

    misspelt = known.where(F.col("month").isNull()).select(column).mapInPandas(near, f"{column} string, month int")
    return known.where(F.col("month").isNotNull()).unionByName(misspelt)


def with_period(rows: DataFrame, text: str, out: str = "period") -> DataFrame:
    """Adds the hint YYYYMM that a text states, with its month name read tolerantly; null if it states none."""
    marked = rows.withColumn("_word", stated_month(F.col(text))).withColumn("_year", stated_year(F.col(text)))
    months = closest_month(marked.select("_word"), "_word").withColumnRenamed("month", "_month")
    joined = marked.join(months, "_word", "left")
    hint = F.concat("_year", F.lpad(F.col("_month").cast("string"), 2, "0"))
    return joined.withColumn(out, hint).drop("_word", "_year", "_month")


def period_hint(url: Column) -> Column:
    """The YYYYMM in a file's name: MMYYYY at its start, else the first YYYYMM, else null."""
    name = F.substring_index(url, "/", -1)
    first = F.concat(F.regexp_extract(name, r"^(0[1-9]|1[0-2])(20\d{2})", 2), F.regexp_extract(name, r"^(0[1-9]|1[0-2])(20\d{2})", 1))
    return F.coalesce(F.nullif(first, F.lit("")), F.nullif(F.regexp_extract(name, r"20\d{2}(?:0[1-9]|1[0-2])", 0), F.lit("")))


def leading_hint(url: Column) -> Column:
    """The YYYYMM that a file's name begins with as a number of its own (YYYYMM or MMYYYY), else null: for links whose
    names have other numbers, any of which may look like a month."""
    lead = F.regexp_extract(F.substring_index(url, "/", -1), r"^\d+", 0)
    return F.when(F.length(lead) == 6, period_hint(lead))


def hint_key(hint: Column) -> Column:
    """YYYYMM to YYYY-MM."""
    return F.concat_ws("-", F.substring(hint, 1, 4), F.substring(hint, 5, 2))


def iso(s: Column) -> Column:
    """The first M/D/YYYY anywhere as YYYY-MM-DD, unchecked against a calendar; '' without one."""
    pattern = r"(\d{1,2})/(\d{1,2})/(\d{4})"
    part = lambda k: F.regexp_extract(s, pattern, k)
    return F.when(s.rlike(pattern), F.concat_ws("-", part(3), F.lpad(part(1), 2, "0"), F.lpad(part(2), 2, "0"))).otherwise("")


def iso_long(s: Column) -> Column:
    """The first "Month D, YYYY" as YYYY-MM-DD, by the month's first three letters; '' if these name no month.

    Only a text without that form is read as M/D/YYYY.
    """
    pattern = r"([A-Za-z]+)\.?\s+(\d{1,2}),?\s+(\d{4})"
    word = F.lower(F.substring(F.regexp_extract(s, pattern, 1), 1, 3))
    month = None
    for i, name in enumerate(MONTHS, 1):
        hit = F.lit(name).startswith(word)
        month = F.when(hit, F.lit(i)) if month is None else month.when(hit, F.lit(i))
    date = F.concat_ws("-", F.regexp_extract(s, pattern, 3), F.lpad(month.cast("string"), 2, "0"), F.lpad(F.regexp_extract(s, pattern, 2), 2, "0"))
    return F.when(s.rlike(pattern), F.when(month.isNull(), "").otherwise(date)).otherwise(iso(s))
