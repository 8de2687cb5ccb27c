"""A panel of (program, month, county, value): history, change against the month before, and ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.text import percent_change


def prior_months(panel: DataFrame) -> DataFrame:
    """(program, month, prior): each program's recorded months, with the one recorded before (null for the first).

    Programs' months are few, so what the window orders is small however large the panel is.
    """
    months = panel.select("program", "month").distinct()
    return months.withColumn("prior", F.lag("month").over(W.partitionBy("program").orderBy("month")))


def rank_changes(panel: DataFrame, months: DataFrame | None = None) -> DataFrame:
    """(program, county, month, now, then, change, pct) against each month's prior one.

    ``months`` (program, month, prior) overrides the recorded order.  Places that the prior month lacks are skipped,
    so a gap in a place's own series is not bridged; a first month has no rows; change against nothing is 0 percent.
    """
    months = prior_months(panel) if months is None else months
    small = F.broadcast if months.count() <= 100_000 else (lambda x: x)
    now = panel.join(small(months.where("prior is not null")), ["program", "month"]).select("program", "county", "month", "prior", F.col("value").alias("now"))
    then = panel.select("program", "county", F.col("month").alias("prior"), F.col("value").alias("then"))
    both = now.join(then, ["program", "county", "prior"])
    change = F.col("now") - F.col("then")
    return both.select("program", "county", "month", "now", "then", change.alias("change"), percent_change(F.col("now"), F.col("then")).alias("pct"))


def latest(panel: DataFrame) -> DataFrame:
    """(program, month, prior) of every program's last month."""
    months = prior_months(panel)
    return months.groupBy("program").agg(F.max("month").alias("month"), F.max_by("prior", "month").alias("prior"))


def require_month(panel: DataFrame, program: str, month: str) -> None:
    """KeyError if the program has no such month."""
    if panel.where((F.col("program") == program) & (F.col("month") == month)).isEmpty():
        raise KeyError(f"no data for {month}")


def totals(panel: DataFrame) -> DataFrame:
    return panel.groupBy("program", "month").agg(F.sum("value").alias("total"))


def baseline_change(totals: DataFrame, months: DataFrame, baseline: str) -> DataFrame:
    """(program, month, baseline, now, then, change, pct): totals of the given months against the baseline month's."""
    now = totals.join(months.select("program", "month"), ["program", "month"]).select("program", "month", F.col("total").alias("now"))
    base = totals.where(F.col("month") == baseline).select("program", F.col("month").alias("baseline"), F.col("total").alias("then"))
    change = F.col("now") - F.col("then")
    return now.join(base, "program").select("program", "month", "baseline", "now", "then", change.alias("change"), percent_change(F.col("now"), F.col("then")).alias("pct"))


def declines(ranked: DataFrame, n: int = 15, by: str = "program") -> DataFrame:
    """Each program's ``n`` largest declines, by change, then percent, then place (our tie-break)."""
    order = W.partitionBy(by).orderBy("change", "pct", "county")
    return ranked.where("change < 0").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def gains(ranked: DataFrame, n: int = 5, by: str = "program") -> DataFrame:
    """Each program's ``n`` largest gains; equal ones by percent and then place."""
    order = W.partitionBy(by).orderBy(F.col("change").desc(), "pct", "county")
    return ranked.where("change > 0").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def directions(ranked: DataFrame, by: str = "program") -> DataFrame:
    """How many declined, gained and stayed, of how many."""
    return ranked.groupBy(by).agg(F.count_if(F.col("change") < 0).alias("declined"), F.count_if(F.col("change") > 0).alias("gained"), F.count_if(F.col("change") == 0).alias("flat"), F.count(F.lit(1)).alias("n"))


def series(panel: DataFrame) -> DataFrame:
    """(program, county, points): months and values in order, gaps left out."""
    points = F.array_sort(F.collect_list(F.struct("month", "value")))
    return panel.groupBy("program", "county").agg(points.alias("points"))


def coverage(panel: DataFrame) -> DataFrame:
    """(program, n_months, first_month, last_month)."""
    return panel.groupBy("program").agg(F.countDistinct("month").alias("n_months"), F.min("month").alias("first_month"), F.max("month").alias("last_month"))
