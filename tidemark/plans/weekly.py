"""A run from landed inputs to a report or silence, over the state that earlier runs left."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.periods import hint_key, period_hint, period_key, with_period
from tidemark.operators import ledger, links, panel, sections, validate
from tidemark.operators.observed import of_gate
from tidemark.plans.report import Figures, Wording, page, subject, text
from tidemark.sources.scratch import cut
from tidemark.sources.state import StateStore

ENROLLMENT = "program string, month string, county string, value bigint"
MONTH_TOTAL = "program string, month string, total bigint, source string"
PROBLEMS = "key string, detail string, first_seen string, last_seen string"
PRINTS = "page_id string, label string, href string"
NO_UPDATE, NO_DATA = ledger.NO_UPDATE, ledger.NO_DATA


@dataclass
class Outcome:
    """What a run has to say: ``subject`` is NO_UPDATE or NO_DATA, without bodies, if that is nothing."""

    subject: str
    text: str = ""
    html: str = ""
    new_months: list[tuple[str, str]] = field(default_factory=list)
    figures: dict[str, int] = field(default_factory=dict)


#: A mail lists so many problems and alerts at most, and says how many more there are; the state has all of them.
MOST_TOLD = 200


def told(rows: DataFrame, column: str, order: list[str]) -> list[str]:
    """The first lines in order, and the number of all others."""
    n = rows.count()
    first = [r[0] for r in rows.orderBy(*order).select(column).limit(MOST_TOLD).collect()]
    return [*first, f"and {n - MOST_TOLD:,} more"] if n > MOST_TOLD else first


def wanted_links(found: DataFrame, months: DataFrame, program: str, hint: Callable[[Column], Column] = period_hint) -> DataFrame:
    """Links (url, label) with their ``month``, text before file name, without those whose month is recorded.

    ``hint`` reads a month from a file's name.  Links without a month are kept, as their documents may tell it.
    """
    dated = with_period(found, "label", "_stated").withColumn("month", F.nullif(hint_key(F.coalesce("_stated", hint(F.col("url")))), F.lit("")))
    known = months.where(F.col("program") == program).select("month").distinct()
    return dated.drop("_stated").join(known, "month", "left_anti")


def ingest(store: StateStore, documents: DataFrame, dim: DataFrame) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """(new months as (program, month), problems as (url, detail), figures of the gate) of documents (url, label, text),
    recorded in the store.

    A section that the gate accepts is recorded if its program and month are new; of one refused, the first problem is
    told, and the document's other sections are recorded all the same.
    """
    docs = documents.withColumnRenamed("url", "doc_id")
    parsed = sections.parse(docs, dim)
    watched, figures = of_gate(validate.gate(validate.summarize(parsed)))
    judged = cut(watched.withColumn("month", period_key(F.col("period"))))  # read by all that follows, and counted once
    odd = judged.where("not accepted or month is null")
    told = F.when(F.col("month").isNull(), F.concat(F.lit("Unknown month: "), F.col("period"))).otherwise(F.concat(F.col("period"), F.lit(" ["), F.col("program"), F.lit("]: "), F.col("first_problem")))
    none = validate.without_sections(docs, parsed).select(F.col("doc_id").alias("url"), F.col("problem").alias("detail"))
    problems = odd.select(F.col("doc_id").alias("url"), told.alias("detail")).unionByName(none)

    good = judged.where("accepted and month is not null").select("program", "month", "total", F.col("doc_id").alias("source"), "period")
    totals = store.load("month_total", MONTH_TOTAL)
    after, added = ledger.insert_if_absent(totals, good, ["program", "month"], ["source", "period"])
    rows = parsed.rows.withColumn("month", period_key(F.col("period"))).withColumnRenamed("doc_id", "source")
    chosen = ledger.first_write(good, ["program", "month"], ["source", "period"]).select("program", "month", "source", "period")
    fresh = rows.join(chosen, ["program", "month", "source", "period"]).join(added.select("program", "month"), ["program", "month"], "left_semi")
    enrollment = store.load("enrollment", ENROLLMENT)
    new = [(r.program, r.month) for r in added.select("program", "month").collect()]  # a run's months: a handful
    problems = cut(problems)  # judged before the state moves
    store.save("enrollment", enrollment.unionByName(fresh.select("program", "month", "county", "value")))
    store.save("month_total", after)
    return store.spark.createDataFrame(new, "program string, month string"), problems, figures.get


def run(
    store: StateStore,
    pages: DataFrame,
    failed: DataFrame,
    documents: DataFrame,
    dim: DataFrame,
    today: str,
    program: str,
    baseline: str,
    words: Wording = Wording(),
) -> Outcome:
    """One cycle over landed ``pages`` (page_id, html), ``failed`` (page_id, url, error) and ``documents`` (url, label, text).

    State is saved before anything is said.  Known problems are not told again.  The first run takes the pages as the
    baseline, and says so if it says anything.  A month's total that was never stated leaves its change at 0.
    """
    added, found, seen = ingest(store, documents, dim)
    sightings = found.select(ledger.problem_key(F.col("url"), F.col("detail")).alias("key"), "detail", F.lit(today).alias("seen"))
    registry, fresh = ledger.note_problems(store.load("problems", PROBLEMS), sightings)
    problems = told(failed, "error", ["url", "error"]) + told(cut(fresh), "detail", ["key"])
    store.save("problems", registry)

    first_run = not store.exists("fingerprints")
    old = store.load("fingerprints", PRINTS)
    new = links.fingerprint(pages.withColumn("page_id", F.col("page_id").cast("string")))
    gone = failed.select(F.col("page_id").cast("string").alias("page_id"))
    alerts = told(cut(links.alerts(None if first_run else old, new, gone)), "alert", ["page_id", "label"])
    store.save("fingerprints", links.carry_forward(old, new, gone))

    new_months = sorted((r.program, r.month) for r in added.collect())
    if not (new_months or alerts or problems):
        return Outcome(NO_UPDATE, figures=seen)
    totals = {r.month: r.total for r in store.load("month_total", MONTH_TOTAL).where(F.col("program") == program).collect()}
    if not totals:
        return Outcome(NO_DATA, "\n".join(problems), figures=seen)
    fresh_months = [m for p, m in new_months if p == program]
    month = max(fresh_months) if fresh_months else max(totals)
    before = max((m for m in totals if m < month), default=None)
    mom = (totals[month] or 0) - (totals[before] or 0) if before and None not in (totals[month], totals[before]) else 0
    own = store.load("enrollment", ENROLLMENT).where(F.col("program") == program)
    ranked = panel.rank_changes(own).where(F.col("month") == month).orderBy("change", "pct", "county").collect()
    base = None
    if baseline in totals and baseline != month and None not in (totals[baseline], totals[month]):
        change = totals[month] - totals[baseline]
        base = {"baseline": baseline, "change": change, "pct": change / totals[baseline] * 100 if totals[baseline] else 0.0}
    if first_run:
        problems.append("First run: the watched pages are the baseline; their changes are told from the next run on.")
    figures = Figures(month, totals[month] or 0, mom, [r.asDict() for r in ranked], alerts, problems, base)
    return Outcome(subject(figures, words), text(figures, words), page(figures, words), new_months, seen)


def deliver(outcome: Outcome, folder: str) -> str:
    """What a run prints, with the mail's body in ``report.html``; a body of an earlier run is removed first.

    This runs on the driver, for a mail job on the same machine.
    """
    body = Path(folder) / "report.html"
    body.unlink(missing_ok=True)
    if not outcome.html:
        return "\n".join(x for x in (outcome.subject, outcome.text) if x)
    body.write_text(outcome.html, encoding="utf-8")
    return f"{outcome.subject}\n\n{outcome.text}"
