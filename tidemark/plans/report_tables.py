"""The report's bodies as a table: one row a program, put together by Spark from figures that never leave it.

The wording, the styles and the order of the parts are those of :mod:`tidemark.plans.report`, which writes one body from a
run's figures; here all programs' bodies are written in one job.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tidemark.functions.places import display
from tidemark.functions.text import escape_html
from tidemark.operators import panel
from tidemark.plans.report import STYLE, WAYS, Wording
from tidemark.sources.scratch import cut


@F.pandas_udf(StringType())
def percent(x: pd.Series) -> pd.Series:
    """One decimal and a sign, rounded as the number's exact value demands; Spark's own format rounds its short form."""
    return x.map(lambda v: None if pd.isna(v) else f"{v:+.1f}%")


def figures(points: DataFrame, baseline: str) -> tuple[DataFrame, DataFrame]:
    """(facts, ranked) of a panel's latest months: a row a program (program, month, total, mom, base, base_change, base_pct,
    declined, gained, flat, n), and the ranked changes of its places."""
    last = panel.latest(points)
    totals = cut(panel.totals(points))
    ranked = cut(panel.rank_changes(points, last))
    before = totals.select("program", F.col("month").alias("prior"), F.col("total").alias("prior_total"))
    base = panel.baseline_change(totals, last, baseline).select("program", F.col("baseline").alias("base"), F.col("change").alias("base_change"), F.col("pct").alias("base_pct"))
    facts = last.join(totals, ["program", "month"]).join(before, ["program", "prior"], "left").join(base, "program", "left").join(panel.directions(ranked), "program", "left")
    mom = F.coalesce(F.col("total") - F.col("prior_total"), F.lit(0)).alias("mom")
    return cut(facts.select("program", "month", "total", mom, "base", "base_change", "base_pct", "declined", "gained", "flat", "n")), ranked


def _signed(x: str) -> Column:
    return F.format_string("%+,d", F.col(x))


def _plain(x: str) -> Column:
    return F.format_string("%,d", F.col(x))


def _plain_number(x: str) -> Column:
    return F.col(x).cast("string")


def _facts(facts: DataFrame, words: Wording) -> DataFrame:
    """(program, at, name, value, way): the named values that a program has."""
    told = [
        (F.lit("Data month"), F.col("month"), F.lit(0)),
        (F.lit(words.unit), _plain("total"), F.lit(0)),
        (F.lit("Change vs prior month"), _signed("mom"), F.signum("mom")),
        (F.concat(F.lit("Change vs "), F.col("base"), F.lit(" baseline")), F.concat(_signed("base_change"), F.lit(" ("), percent("base_pct"), F.lit(")")), F.signum("base_change")),
        (F.lit("Counties"), F.concat(_plain_number("declined"), F.lit(" declined, "), _plain_number("gained"), F.lit(" gained, "), _plain_number("flat"), F.lit(" flat, of "), _plain_number("n")), F.lit(0)),
    ]
    rows = F.array(*[F.struct(F.lit(i).alias("at"), name.alias("name"), value.alias("value"), way.cast("int").alias("way")) for i, (name, value, way) in enumerate(told)])
    # A baseline that a program lacks, or places that it cannot compare, leave their values null.
    return facts.select("program", F.explode(rows).alias("f")).select("program", "f.*").where("name is not null and value is not null")


def _rankings(ranked: DataFrame, words: Wording) -> list[tuple[int, str, tuple[str, ...], tuple[int, ...], DataFrame]]:
    """(part, title, columns, widths, rows as (program, rank, cells, way)) of declines and gains."""
    shown, moved = display(F.col("county")), [_signed("change"), percent("pct")]
    row = lambda table, cells: table.select("program", "rank", F.array(*cells).alias("cells"), F.signum("change").cast("int").alias("way"))
    down, up = panel.declines(ranked, 15), panel.gains(ranked, 5)
    return [
        (3, words.fell, ("County", "Prior", "Now", "Change", "%"), (14, 9, 9, 8, 8), row(down, [shown, _plain("then"), _plain("now"), *moved])),
        (4, words.rose, ("County", "Change", "%"), (14, 8, 8), row(up, [shown, *moved])),
    ]


def _put_together(lines: list[DataFrame], between: str) -> DataFrame:
    """(program, body) of (program, part, at, line)."""
    whole = reduce(DataFrame.unionByName, lines)
    parts = whole.groupBy("program", "part").agg(F.expr("listagg(line, '\n') WITHIN GROUP (ORDER BY at)").alias("text"))
    return parts.groupBy("program").agg(F.expr(f"listagg(text, '{between}') WITHIN GROUP (ORDER BY part)").alias("body"))


def _line(rows: DataFrame, part: int, at: Column, line: Column) -> DataFrame:
    return rows.select("program", F.lit(part).alias("part"), at.cast("int").alias("at"), line.alias("line"))


def _padded(cells: Column, widths: tuple[int, ...]) -> Column:
    def fit(i: int, w: int) -> Column:
        x = F.get(cells, F.lit(i))
        return F.when(F.length(x) >= w, x).otherwise(F.rpad(x, w, " ") if i == 0 else F.lpad(x, w, " "))

    return F.concat(F.lit("  "), F.concat_ws(" ", *[fit(i, w) for i, w in enumerate(widths)]))


def text_bodies(facts: DataFrame, ranked: DataFrame, words: Wording = Wording()) -> DataFrame:
    """(program, body): each program's report as plain text, a blank line between its parts."""
    fixed = [(0, 0, words.title), (0, 1, words.byline), (1, 0, words.about), (5, 0, words.caveat), (6, 0, words.context)]
    lines = [_line(facts, part, F.lit(at), F.lit(x)) for part, at, x in fixed if x]
    values = _facts(facts, words)
    lines.append(_line(values, 2, F.col("at"), F.concat("name", F.lit(": "), "value")))
    for part, title, columns, widths, rows in _rankings(ranked, words):
        have = rows.select("program").distinct()
        lines += [_line(have, part, F.lit(-2), F.lit(title)), _line(have, part, F.lit(-1), _padded(F.array(*map(F.lit, columns)), widths))]
        lines.append(_line(rows, part, F.col("rank"), _padded(F.col("cells"), widths)))
    return _put_together(lines, "\n\n")


def deliver_bodies(bodies: DataFrame, folder: str) -> None:
    """A folder of its own for each program's body, as files; what an earlier run left in ``folder`` goes."""
    bodies.select("program", "body").write.mode("overwrite").partitionBy("program").text(folder)


def delivered(spark: SparkSession, folder: str) -> DataFrame:
    """(program, body) of what was delivered."""
    return spark.read.text(folder, wholetext=True).select(F.col("program").cast("string").alias("program"), F.regexp_replace("value", r"\n\z", "").alias("body"))


def _tag(name: str, inner: Column, style: str = "", way: Column | None = None) -> Column:
    """A tag with the style's declarations and, where a direction is given and not 0, its colour."""
    own = STYLE.get(style, "")
    plain = F.lit(f'<{name} style="{own}">' if own else f"<{name}>")
    if way is not None:
        colour = F.when(way < 0, WAYS[-1]).when(way > 0, WAYS[1])
        plain = F.when(colour.isNull(), plain).otherwise(F.concat(F.lit(f'<{name} style="{own}{"; " if own else ""}color: '), colour, F.lit('">')))
    return F.concat(plain, inner, F.lit(f"</{name}>"))


def _row(tag: str, cells: Column, n: int, way: Column | None = None) -> Column:
    cell = lambda i: _tag(tag, escape_html(F.get(cells, F.lit(i))), "number" if i else "name", way if way is not None and i > n - 3 else None)
    return _tag("tr", F.concat(*[cell(i) for i in range(n)]))


def html_bodies(facts: DataFrame, ranked: DataFrame, words: Wording = Wording()) -> DataFrame:
    """(program, body): the same parts as HTML for mail, a line for each row."""
    safe = lambda x: escape_html(F.lit(x))
    fixed = [(0, 0, words.title), (0, 1, words.byline), (1, 0, words.about), (5, 0, words.caveat), (6, 0, words.context)]
    lines = [_line(facts, part, F.lit(at), _tag("h1", safe(x), "heading") if (part, at) == (0, 0) else _tag("p", safe(x))) for part, at, x in fixed if x]
    lines += [_line(facts, -1, F.lit(0), F.lit(f'<main style="{STYLE["page"]}">')), _line(facts, 7, F.lit(0), F.lit("</main>\n"))]
    values = _facts(facts, words)
    told = F.concat(_tag("th", escape_html(F.col("name")), "name"), _tag("td", escape_html(F.col("value")), "", F.col("way")))
    lines += [_line(facts, 2, F.lit(-1), F.lit("<table>")), _line(values, 2, F.col("at"), _tag("tr", told)), _line(facts, 2, F.lit(99), F.lit("</table>"))]
    for part, title, columns, _, rows in _rankings(ranked, words):
        have, n = rows.select("program").distinct(), len(columns)
        lines += [_line(have, part, F.lit(-3), F.lit("<table>")), _line(have, part, F.lit(-2), _tag("caption", safe(title), "caption")), _line(have, part, F.lit(-1), _row("th", F.array(*map(F.lit, columns)), n))]
        lines += [_line(rows, part, F.col("rank"), _row("td", F.col("cells"), n, F.col("way"))), _line(have, part, F.lit(99), F.lit("</table>"))]
    return _put_together(lines, "\n")
