from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidemark.functions import periods
from tidemark.functions import text as tx
from tidemark.operators import links

INDEX = """
<a href="/a/082026agg.pdf">Enrollment as of August 1, 2026</a>
<a class="x" href="/a/072022.pdf"><b>Enrolllment</b> as of July 1, 2022</a>
<a href="https://else.example/r.pdf">Enrollment​ as of  September 1, 2020</a>
<a href="/map.pdf">County map</a> <a href="/manual.html">Enrollment manual</a>
<a href="/a/082026agg.pdf">Enrollment again</a>"""


def value(spark, text, column):
    return spark.createDataFrame([(text,)], "s string").select(column(F.col("s"))).first()[0]


def test_report_links(spark):
    pages = spark.createDataFrame([(1, INDEX), (2, None), (3, "")], "page_id int, html string")
    got = sorted((r.pos, r.url, r.label) for r in links.report_links(pages, "https://base.example").collect())
    assert got == [
        (0, "https://base.example/a/082026agg.pdf", "Enrollment as of August 1, 2026"),
        (1, "https://base.example/a/072022.pdf", "Enrolllment as of July 1, 2022"),
        (2, "https://else.example/r.pdf", "Enrollment as of September 1, 2020"),
    ]


def test_fingerprint_diff_and_alerts(spark):
    page = lambda h: spark.createDataFrame([("s", h)], "page_id string, html string")
    old = links.fingerprint(page('<a href="1">A</a><p>at 10:00</p>'))
    new = links.fingerprint(page('<a href="9">A</a><p>at 11:00</p><a href="2"><i>New</i> <b>Report</b></a><a href="3"> </a><a href="4">A</a>'))
    assert sorted((r.label, r.href, r.change) for r in links.diff(old, new).collect()) == [("New Report", "2", "added")]
    assert {r.label: r.href for r in new.collect()} == {"A": "4", "New Report": "2"}
    assert [r.alert for r in links.alerts(old, new).collect()] == ["[s] new: New Report"]
    assert links.alerts(None, new).count() == 0
    failed = spark.createDataFrame([("s",)], "page_id string")
    assert links.alerts(old, new, failed).count() == 0
    assert [r.href for r in links.carry_forward(old, new, failed).collect()] == ["1"]


@pytest.mark.parametrize(("text", "period"), [("as of August 1, 2026", "202608"), ("as of July 1, 2022", "202207"), ("as of Septermber 1, 2020", "202009"), ("as of Bananuary 1, 2020", None), ("nothing", None), (None, None)])
def test_period_from_text(spark, text, period):
    rows = spark.createDataFrame([(text,)], "s string")
    assert periods.with_period(rows, "s").first().period == period


@pytest.mark.parametrize(("url", "hint"), [("/x/202504MCO.pdf", "202504"), ("/x/082026agg.pdf", "202608"), ("/201901/march2026.pdf", None), ("/x/rep201913.pdf", None)])
def test_period_hint(spark, url, hint):
    assert value(spark, url, periods.period_hint) == hint


@pytest.mark.parametrize(("url", "hint"), [("/x/200103-7.pdf", "200103"), ("/x/082026.pdf", "202608"), ("/x/199503-200103.pdf", None), ("/x/report-200103.pdf", None), ("/x/2001031.pdf", None), ("/200103/7.pdf", None), (None, None)])
def test_leading_hint(spark, url, hint):
    assert value(spark, url, periods.leading_hint) == hint


@pytest.mark.parametrize(("text", "key"), [("August 2026", "2026-08"), (" january 2026", "2026-01"), ("", None), ("Nonsense", None), ("2026-08", None), ("Smarch 2020", None), (None, None)])
def test_period_key(spark, text, key):
    assert value(spark, text, periods.period_key) == key
    if key is None:
        with pytest.raises(Exception, match="not a period"):
            value(spark, text, lambda c: periods.period_key(c, strict=True))


@pytest.mark.parametrize(("text", "date"), [("11/9/2026", "2026-11-09"), ("x 1/02/2003 4/5/2006", "2003-01-02"), ("13/45/2026", "2026-13-45"), ("none", ""), ("", "")])
def test_iso(spark, text, date):
    assert value(spark, text, periods.iso) == date


@pytest.mark.parametrize(("text", "date"), [("Sept. 5, 2025", "2025-09-05"), ("March 15 2024", "2024-03-15"), ("1/2/2003", "2003-01-02"), ("Foo 1, 2020", ""), ("none", "")])
def test_iso_long(spark, text, date):
    assert value(spark, text, periods.iso_long) == date


@pytest.mark.parametrize(
    ("raw", "clean"),
    [("<b>a</b>&#8217;s&nbsp;&amp;quot;x", "a ’s \"x"), ("a ​ b &#39;c&#39; &rsquo;", "a b 'c' '"), ("&#65;&#66;x&#;&#12", "ABx&#;&#12"), ("&#65601;", "A"), ("", ""), (None, None)],
)
def test_clean_html(spark, raw, clean):
    assert value(spark, raw, tx.clean_html) == clean


def test_forms_and_formats(spark):
    assert [value(spark, s, tx.email_valid) for s in ("a@b.c", "a b@c.d", "a@b")] == [True, False, False]
    assert [value(spark, s, tx.phone_valid) for s in ("+1 (555) 010-0000", "012", "abc")] == [True, False, False]
    assert value(spark, "A  B & c!", lambda c: tx.slug(c, c)) == "a-b-c:a-b-c"
    assert value(spark, "<&>", tx.escape_html) == "&lt;&amp;&gt;"
