"""The gate: figures that do not reconcile with their stated totals are refused."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.sections import Sections

# How far a sum may be from its total, how many places are a full list, and from how many on one is asked for.
TOLERANCE, LEAST_ALLOWED, FULL, ASK_FULL = 0.005, 5.0, 102, 50


def allowed(total: Column) -> Column:
    return F.greatest(F.lit(LEAST_ALLOWED), total.cast("double") * F.lit(TOLERANCE))


def mismatch(found: Column, total: Column) -> Column:
    """Does the sum miss a stated total by more than the tolerance?  False without a total."""
    return F.coalesce(F.abs(found - total).cast("double") > allowed(total), F.lit(False))


def count_text(n: Column) -> Column:
    """With thousands separators."""
    return F.format_string("%,d", n.cast("long"))


def problems(n: Column, found: Column, total: Column, conflicts: Column, ask_full: Column) -> Column:
    """A section's problems in order: conflicts, no rows (and then nothing else), a sum that misses, a short list.

    ``conflicts`` is an array of names, of which the first five distinct ones in order are told.  The tolerance is
    told as whole numbers, halves to the even one.
    """
    names = F.array_join(F.slice(F.array_sort(F.array_distinct(conflicts)), 1, 5), ", ")
    told = F.concat(
        F.lit("Rows add up to "), count_text(found), F.lit(", stated are "), count_text(total),
        F.lit(": off by "), count_text(F.abs(found - total)), F.lit(" where "), count_text(F.bround(allowed(total), 0)), F.lit(" may be"),
    )
    empty = F.coalesce(n, F.lit(0)) == 0
    short = F.concat(F.lit("Only "), n.cast("string"), F.lit(f" of {FULL} places, without a stated total to hold them against"))
    found_all = F.array(
        F.when(F.size(conflicts) > 0, F.concat(F.lit("Places with two values in a section: "), names)),
        F.when(empty, F.lit("A section without rows of places")),
        F.when(~empty & mismatch(found, total), told),
        F.when(~empty & ask_full & (n < FULL) & total.isNull(), short),
    )
    return F.array_compact(found_all)


def summarize(sections: Sections, key: str = "doc_id") -> DataFrame:
    """One row a section: (key, program, period, n, found, total, conflicts)."""
    who = [key, "program", "period"]
    sums = sections.rows.groupBy(*who).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("found"))
    odd = sections.conflicts.groupBy(*who).agg(F.collect_set("county").alias("conflicts"))
    out = sections.headers.join(sums, who, "left").join(sections.totals, who, "left").join(odd, who, "left")
    none = F.array().cast("array<string>")
    return out.select(*who, F.coalesce("n", F.lit(0)).alias("n"), "found", "total", F.coalesce("conflicts", none).alias("conflicts"))


def gate(summary: DataFrame) -> DataFrame:
    """Adds ``problems``, ``first_problem`` and ``accepted``; a full list is asked for only of sections with more than 50
    rows, and of a refused one only the first problem is reported."""
    out = summary.withColumn("problems", problems(F.col("n"), F.col("found"), F.col("total"), F.col("conflicts"), F.col("n") > ASK_FULL))
    return out.withColumn("first_problem", F.get("problems", F.lit(0))).withColumn("accepted", F.size("problems") == 0)


def without_sections(docs: DataFrame, sections: Sections, key: str = "doc_id", label: str = "label") -> DataFrame:
    """(key, problem) of documents in which no section was found."""
    none = docs.join(sections.headers.select(key).distinct(), key, "left_anti")
    return none.select(key, F.concat(F.col(label), F.lit(": a document without sections")).alias("problem"))


def status(summary: DataFrame) -> DataFrame:
    """The audit of sections: OK, CONFLICT, or CHK where the sum misses the stated total or there is none."""
    word = F.when(F.size("conflicts") > 0, "CONFLICT").when(F.col("total").isNull() | mismatch(F.col("found"), F.col("total")), "CHK").otherwise("OK")
    return summary.withColumn("status", word)
