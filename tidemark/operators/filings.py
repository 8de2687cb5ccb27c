"""Filings from several sources: one schema, newest date a source, and a since-filter."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.periods import iso, iso_long
from tidemark.functions.text import clean_html, clean_portal, table_rows

# The columns of a filing and of a portal's row; further down the pattern of a line and a block's labels.
FILING = "source string, entity string, reported string, breach_dates string, state_residents string, total string, extra string"
PORTAL = ("entity", "state", "entity_type", "individuals_affected", "submission_date", "breach_type", "location", "business_associate_present")


#: What a stated date must look like.
SINCE = r"\d{4}-\d{2}-\d{2}"
#: The dates of so many sources are broadcast.
MOST_SOURCES = 100_000


def check_since(since: str) -> str:
    """ValueError unless it is a YYYY-MM-DD."""
    if not re.fullmatch(SINCE, since or ""):
        raise ValueError("since must be YYYY-MM-DD")
    return since


def _filing(source: str, **columns: Column | None) -> list[Column]:
    names = [x.split()[0] for x in FILING.split(", ")]
    given = {"source": F.lit(source), **columns}
    return [(F.lit(None) if given.get(n) is None else given[n]).cast("string").alias(n) for n in names]


def from_table(pages: DataFrame, source: str, html: str = "html") -> DataFrame:
    """Filings of an HTML table: rows of six cells or more whose second has a date."""
    rows = pages.select(F.posexplode(table_rows(F.col(html))).alias("pos", "c")).where((F.size("c") >= 6) & (iso(F.get("c", F.lit(1))) != ""))
    c = lambda i: F.get("c", F.lit(i))
    return rows.select(*_filing(source, entity=c(0), reported=iso(c(1)), breach_dates=c(2), state_residents=c(5), extra=F.concat(F.lit("sent "), c(4))))


def from_cells(rows: DataFrame, source: str, cells: str = "cells") -> DataFrame:
    """Filings of rows that come as arrays of cells, by place: 0 entity, 9 date, 6 residents, and 2, 3, 5 in the notes."""
    c = lambda i: F.get(cells, F.lit(i))
    extra = F.concat(clean_html(c(2)), F.lit(", "), clean_html(c(3)), F.lit("; "), clean_html(c(5)))
    return rows.select(*_filing(source, entity=clean_html(c(0)), reported=iso(c(9)), state_residents=clean_html(c(6)), extra=extra))


def from_lines(docs: DataFrame, source: str, text: str = "text") -> DataFrame:
    """Filings of a laid-out text: number, entity, two dates and up to two counts on a line."""
    pattern = r"^\s*\d+\s+(.+?)\s{2,}(\d{1,2}/\d{1,2}/\d{4})\s+(\d{1,2}/\d{1,2}/\d{4})(?:\s+([\d,]+))?(?:\s+([\d,]+))?\s*$"
    rows = docs.select(F.explode(F.split(F.col(text), "\n", -1)).alias("line")).where(F.col("line").rlike(pattern))
    part = lambda k: F.regexp_extract("line", pattern, k)
    count = lambda k: F.nullif(part(k), F.lit(""))
    return rows.select(*_filing(source, entity=F.trim(part(1)), reported=iso(part(2)), breach_dates=part(3), state_residents=count(4), total=count(5), extra=F.lit("dated by its notice")))


#: The labels that end a field in a text of blocks.
BLOCK_LABELS = (
    "Date of Incident",
    "Date Public Notified",
    "Data Accessed",
    "Who is Affected",
    "Number of Individuals Affected",
    "Number of Wisconsin Residents Affected",
    "Who and how to contact",
)


def from_blocks(pages: DataFrame, source: str, html: str = "html") -> DataFrame:
    """Filings of blocks that begin with "Company Name:", with labelled fields; blocks without a date of incident are none."""
    blocks = pages.select(F.explode(F.slice(F.split(clean_html(F.col(html)), "Company Name:", -1), 2, 2_000_000_000)).alias("b"))
    ends = "|".join(BLOCK_LABELS)

    def field(label: str) -> Column:
        pattern = rf"{label}:\s*(.*?)(?=\s+(?:{ends})\b|$)"
        return F.when(F.col("b").rlike(pattern), F.nullif(F.regexp_extract("b", pattern, 1), F.lit("")))

    named = r"^(.*?)\s+Date of Incident:"
    rows = blocks.withColumn("entity", F.nullif(F.regexp_extract("b", named, 1), F.lit(""))).where("entity is not null")
    return rows.select(
        *_filing(source, entity=F.trim("entity"), reported=iso_long(F.coalesce(field("Date Public Notified"), F.lit(""))), breach_dates=field("Date of Incident"), state_residents=field("Number of Wisconsin Residents Affected"), total=field("Number of Individuals Affected"))
    )


def portal_rows(pages: DataFrame, html: str = "html", page: str = "page") -> DataFrame:
    """(page, pos, …): a portal's numbered rows of nine cells or more, the first cell left out; and its stated total."""
    total = F.nullif(F.regexp_extract(F.col(html), r"Displaying [\d,]+ - [\d,]+ of ([\d,]+)", 1), F.lit(""))
    rows = pages.select(page, total.alias("total_listed"), F.posexplode(table_rows(F.col(html), numbered=True, clean=lambda c: c)).alias("pos", "c")).where(F.size("c") >= 9)
    # Cells are cleaned once they are columns, so those that nobody reads, and those of other rows, are not.
    return rows.select(page, "pos", "total_listed", *[clean_portal(F.get("c", F.lit(i + 1))).alias(n) for i, n in enumerate(PORTAL)])


def portal_summary(rows: DataFrame, page: str = "page") -> DataFrame:
    """(n_rows, total_listed, newest_submission_date): the newest is the first listed, by place."""
    at = F.struct(page, "pos")
    return rows.agg(F.count(F.lit(1)).alias("n_rows"), F.max_by("total_listed", at).alias("total_listed"), F.min_by("submission_date", at).alias("newest_submission_date"))


def combine(sources: Mapping[str, DataFrame]) -> DataFrame:
    """All sources' filings, with the key of each."""
    out = None
    for key, rows in sources.items():
        rows = rows.withColumn("source_key", F.lit(key))
        out = rows if out is None else out.unionByName(rows)
    return out


def since_filter(rows: DataFrame, since: str) -> DataFrame:
    """Rows reported on or after a date; compared as text, so those without a date drop out."""
    return rows.where(F.col("reported") >= F.lit(check_since(since)))


def since_by_source(rows: DataFrame, asked: DataFrame, by: str = "source_key") -> tuple[DataFrame, DataFrame]:
    """(kept, refused): :func:`since_filter` with a date for each source, ``asked`` as (``by``, since).

    One source's bad date stops that source alone: it gives no rows and one of ``refused``, (``by``, since, problem), a
    bad date.  Of several good dates the earliest counts; a source that is not asked for gives no rows.  A null date is a
    bad one, a null source a source.
    """
    bad = ~F.coalesce(F.col("since").rlike(rf"\A{SINCE}\z"), F.lit(False))
    refused = asked.where(bad).select(by, "since").distinct()
    refused = refused.withColumn("problem", F.concat(F.lit("since must be YYYY-MM-DD, not "), F.coalesce("since", F.lit("empty"))))
    firsts = asked.groupBy(F.col(by).alias("_by")).agg(F.min("since").alias("_since"), F.bool_or(bad).alias("_bad")).where("not _bad").drop("_bad")
    firsts = F.broadcast(firsts) if firsts.count() <= MOST_SOURCES else firsts
    return rows.join(firsts, F.col(by).eqNullSafe(F.col("_by")) & (F.col("reported") >= F.col("_since")), "left_semi"), refused


def lookback(rows: DataFrame, last_run: str | None, today: str, overlap: int = 2, baseline: int = 30) -> DataFrame:
    """Rows reported from ``overlap`` days before the last run to today, or in the last ``baseline`` days where there was
    none; for a search that looks back four days, ``overlap`` is 4."""
    first = F.date_sub(F.lit(last_run or today).cast("date"), overlap if last_run else baseline).cast("string")
    return rows.where(F.col("reported").between(first, F.lit(today)))


def newest(rows: DataFrame, by: str = "source_key") -> DataFrame:
    """Each source's newest date, null if none of its rows has one."""
    return rows.groupBy(by).agg(F.max(F.nullif("reported", F.lit(""))).alias("newest"))


def newest_first(rows: DataFrame) -> DataFrame:
    return rows.orderBy(F.col("reported").desc(), "source", "entity")


def typed(rows: DataFrame) -> DataFrame:
    """Adds ``reported_date`` and ``total_n`` where the texts are a date and a count."""
    return rows.withColumn("reported_date", F.try_to_date(F.nullif("reported", F.lit("")), "yyyy-MM-dd")).withColumn("total_n", F.expr("try_cast(replace(total, ',', '') as bigint)"))
