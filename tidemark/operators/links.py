"""Links on landed pages: report links, and fingerprints of pages by their labelled links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.text import anchors, resolve_url, text_of


def links(pages: DataFrame, key: str = "page_id", html: str = "html", href: str = '[^"]+') -> DataFrame:
    """(key, pos, href, label) of every anchor, in page order."""
    found = pages.select(key, F.posexplode(anchors(F.col(html), href)).alias("pos", "a"))
    return found.select(key, "pos", F.col("a.href").alias("href"), text_of(F.col("a.inner")).alias("label"))


def report_links(pages: DataFrame, base: str, word: str = "(?i)enrol", key: str = "page_id", html: str = "html", href: str = r'[^"]+\.pdf') -> DataFrame:
    """(url, label, key, pos): anchors to documents whose label has the word, each url once, by its first place.

    The word is matched loosely on purpose, as labels are misspelt at times.
    """
    found = links(pages, key, html, href).where(F.col("label").rlike(word)).withColumn("url", resolve_url(F.col("href"), base))
    return first_by(found.select("url", "label", key, "pos"), "url", [key, "pos"])


def first_by(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Each key's first row: the least by order, without a sort of the rest."""
    others = [c for c in rows.columns if c != key]
    lead = F.struct(*order)
    return rows.groupBy(key).agg(F.min_by(F.struct(*others), lead).alias("_r")).select(key, *[F.col(f"_r.{c}").alias(c) for c in others])


def fingerprint(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, label, href): a page's non-empty labels, each with its last href."""
    found = links(pages, key, html).where("label <> ''")
    return found.groupBy(key, "label").agg(F.max_by("href", "pos").alias("href"))


def diff(old: DataFrame, new: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, label, href, change): labels that only the new fingerprint has are added, those only the old has removed.

    Labels alone count, so a changed href is no change.
    """
    added = new.join(old, [key, "label"], "left_anti").withColumn("change", F.lit("added"))
    removed = old.join(new, [key, "label"], "left_anti").withColumn("change", F.lit("removed"))
    return added.unionByName(removed)


def carry_forward(old: DataFrame, new: DataFrame, failed: DataFrame, key: str = "page_id") -> DataFrame:
    """The new fingerprint, with the old one's rows for pages that could not be fetched."""
    names = failed.select(key).distinct()
    return new.join(names, key, "left_anti").unionByName(old.join(names, key, "left_semi"))


def alerts(old: DataFrame | None, new: DataFrame, failed: DataFrame | None = None, key: str = "page_id") -> DataFrame:
    """(key, label, alert) for added labels; none on the first run (``old`` is None), which sets the baseline, and none
    for pages that failed."""
    told = F.concat(F.lit("["), F.col(key).cast("string"), F.lit("] new: "), F.col("label")).alias("alert")
    if old is None:
        return new.where(F.lit(False)).select(key, "label", told)
    added = new.join(old, [key, "label"], "left_anti")
    if failed is not None:
        added = added.join(failed.select(key).distinct(), key, "left_anti")
    return added.select(key, "label", told)


def discovery_audit(found: DataFrame, month: str = "month", url: str = "url", order: str = "pos") -> DataFrame:
    """(year, n_months, n_links, first_url) of dated links, each month by its first link; undated ones under a null year.

    ``first_url`` is the first link of the year's first month (of all, for undated ones).
    """
    first = found.groupBy(month).agg(F.min_by(url, order).alias("_url"), F.count(F.lit(1)).alias("_n"))
    year = F.substring(month, 1, 4).alias("year")
    return first.groupBy(year).agg(F.count(month).alias("n_months"), F.sum("_n").alias("n_links"), F.min_by("_url", F.coalesce(month, F.lit(""))).alias("first_url"))
