"""Sections in landed text: rows that belong to the header above, to the next one, or to none."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.resolve import canonical_fuzzy
from tidemark.sources.scratch import cut

# What a header, a row and a number look like, and which programs a header can name.
HEADER = r"(?i)^(.*?)\s+Enrollments?\s*(?:[—–-]|for)\s*([A-Za-z]+\s+\d{4})"
ROW = r"^([A-Za-z][A-Za-z.'\s+#ﬀ-ﬆ-]*?)\s+(?=[\d*])(.*)$"
NUMBER = r"\d[\d,]*"
PROGRAMS = (("dual", ("mmai", "fide", "snp")), ("healthchoice", ("choice", "hci")))
TOTALS = ("grandtotal", "total")


@dataclass(frozen=True)
class Sections:
    """``headers`` (doc_id, program, period), ``rows`` (…, county, value, pos), ``totals`` (…, total), ``conflicts``
    (…, county, pos): a section is a program and period of a document, and has a header though it may have no rows."""

    headers: DataFrame
    rows: DataFrame
    totals: DataFrame
    conflicts: DataFrame


def lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, pos, line): a text's non-blank lines, trimmed, by their order."""
    split = docs.select(key, F.posexplode(F.split(F.col(text), r"\R", -1)).alias("pos", "line"))
    return split.withColumn("line", F.regexp_replace("line", r"(?U)^\s+|\s+$", "")).where("line <> ''")


def program_of(header: Column) -> Column:
    """The first program of which the header holds a word; null if none."""
    out = None
    for name, words in PROGRAMS:
        test = F.lower(header).rlike("|".join(words))
        out = F.when(test, name) if out is None else out.when(test, name)
    return out


def events(docs: DataFrame, dim: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, pos, header, label, value, county, is_total): the lines that are a recognised header or hold a figure."""
    marked = lines(docs, key, text)
    program = program_of(F.regexp_extract("line", HEADER, 1))
    marked = marked.withColumn("is_header", F.coalesce(F.col("line").rlike(HEADER) & program.isNotNull(), F.lit(False)))
    header = F.when(F.col("is_header"), F.struct(program.alias("program"), F.regexp_extract("line", HEADER, 2).alias("period")))
    label = F.when(~F.col("is_header") & F.col("line").rlike(ROW), F.regexp_extract("line", ROW, 1))
    numbers = F.regexp_extract_all(F.regexp_extract("line", ROW, 2), F.lit(NUMBER), F.lit(0))
    value = F.replace(F.element_at(F.when(F.size(numbers) > 0, numbers), -1), F.lit(","), F.lit("")).cast("long")
    marked = marked.select(key, "pos", header.alias("header"), label.alias("label"), F.when(label.isNotNull(), value).alias("value"))
    marked = marked.where(F.col("header").isNotNull() | F.col("value").isNotNull())
    named = canonical_fuzzy(marked, dim, "label", "county")
    is_total = F.col("county").isNull() & F.regexp_replace(F.lower("label"), "[^a-z]", "").isin(*TOTALS)
    return named.withColumn("is_total", F.coalesce(is_total, F.lit(False)))


class _Walk:
    """A document's lines in order, as a reader would take them: the section open now, the rows that wait for one, and
    each section's values so far."""

    def __init__(self) -> None:
        self.open, self.waiting, self.sections, self.conflicts = None, [], {}, []

    def eval(self, row):
        self.key, pos, value = row[0], row["pos"], row["value"]
        if row["header"] is not None:
            self.open = (row["header"]["program"], row["header"]["period"])
            rows = self.sections.setdefault(self.open, [{}, None])[0]
            rows.update(self.waiting)
            self.waiting = []
        elif row["is_total"]:
            if self.open:
                self.sections[self.open][1] = value
            self.open = None
        elif row["county"] is not None:
            if not self.open:
                self.waiting.append((row["county"], (value, pos)))
                return
            rows = self.sections[self.open][0]
            if row["county"] in rows and rows[row["county"]][0] != value:
                self.conflicts.append((*self.open, row["county"], pos))
            rows[row["county"]] = (value, pos)

    def terminate(self):
        for (program, period), (rows, total) in self.sections.items():
            yield self.key, "header", program, period, None, None, None
            if total is not None:
                yield self.key, "total", program, period, None, total, None
            for county, (value, pos) in rows.items():
                yield self.key, "row", program, period, county, value, pos
        for program, period, county, pos in self.conflicts:
            yield self.key, "conflict", program, period, county, None, pos


def walked(docs: DataFrame, dim: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, part, program, period, county, value, pos): what :func:`parse` gives, by a walk over each document's lines.

    ``part`` is header, row, total or conflict.  A table function takes the lines of a document in order and holds that
    document's values alone; documents are dealt out over the tasks.  It is the rule as prose has it, to hold the windows
    of :func:`parse` against; these stay the faster way.
    """
    found = events(docs, dim, key, text).select(key, "pos", "header", "county", "value", "is_total")
    kind = found.schema[key].dataType.simpleString()
    walk = F.udtf(_Walk, returnType=f"`{key}` {kind}, part string, program string, period string, county string, value bigint, pos int")
    return walk(found.asTable().partitionBy(key).orderBy("pos"))


def as_one(found: Sections, key: str = "doc_id") -> DataFrame:
    """The four tables of :func:`parse` in the form of :func:`walked`."""
    out = None
    for part, table, value in (("header", found.headers, None), ("row", found.rows, "value"), ("total", found.totals, "total"), ("conflict", found.conflicts, None)):
        have = lambda c, kind: (F.col(c) if c in table.columns else F.lit(None).cast(kind)).alias(c)  # noqa: B023, E731
        rows = table.select(key, F.lit(part).alias("part"), "program", "period", have("county", "string"), (F.col(value) if value else F.lit(None)).cast("long").alias("value"), have("pos", "int"))
        out = rows if out is None else out.unionByName(rows)
    return out


def parse(docs: DataFrame, dim: DataFrame, key: str = "doc_id", text: str = "text") -> Sections:
    """Sections of every document, each document by itself.

    A recognised header opens a section, and a "Total" or "Grand Total" line with a number closes it.  A row belongs
    to the section open above it; rows with none wait for the next recognised header; at the end of the text they are
    dropped.  Headers of unknown programs neither open nor close, and their lines are tried as rows.  The value is a
    row's last number, and a row without numbers is none.  Within an open section a place that comes again with
    another value than its last is a conflict; the last value stays.  Texts without lines have no sections.
    """
    named = events(docs, dim, key, text)
    order = W.partitionBy(key).orderBy("pos")
    before, after = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(1, W.unboundedFollowing)
    event = F.when(F.col("header").isNotNull(), "open").when(F.col("is_total"), "close")
    placed = named.withColumn("event", event).withColumn("open", F.coalesce(F.last("event", True).over(before) == "open", F.lit(False)))
    above, below = F.last("header", True).over(before), F.first("header", True).over(after)
    section = F.when(F.col("open"), above).when(F.col("county").isNotNull(), below)
    # Four tables are read from this one, so the texts are parsed and their labels resolved once.
    placed = cut(placed.withColumn("section", section).where("section is not null or header is not null"))

    who = [F.col(key), F.col("section.program").alias("program"), F.col("section.period").alias("period")]
    headers = placed.where("header is not null").select(key, "header.program", "header.period").distinct()
    totals = placed.where("open and is_total").select(*who, "value", "pos").groupBy(key, "program", "period").agg(F.max_by("value", "pos").alias("total"))
    rows = placed.where("county is not null and section is not null").select(*who, "county", "value", "pos", "open")
    # A waiting row counts as written when its header comes, so it never conflicts, but a later row may conflict with it.
    again = W.partitionBy(key, "program", "period", "county").orderBy("pos")
    rows = rows.withColumn("conflict", F.coalesce(F.col("open") & (F.lag("value").over(again) != F.col("value")), F.lit(False)))
    conflicts = rows.where("conflict").select(key, "program", "period", "county", "pos")
    last = rows.groupBy(key, "program", "period", "county").agg(F.max_by("value", "pos").alias("value"), F.max("pos").alias("pos"))
    return Sections(headers, last, totals, conflicts)
