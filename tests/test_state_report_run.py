from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.places import COUNTIES, dimension
from tidemark.operators import filings, ledger
from tidemark.plans import report
from tidemark.plans.weekly import NO_UPDATE, Outcome, deliver, run, wanted_links
from tidemark.sources import landing
from tidemark.sources.state import StateStore
from tidemark.streaming.ledger_stream import distinct_stream, run_ledger

RANKED = [{"county": "Cook", "now": 900, "then": 1000, "change": -100, "pct": -10.0}, {"county": "Will", "now": 5, "then": 5, "change": 0, "pct": 0.0}, {"county": "StClair", "now": 520, "then": 500, "change": 20, "pct": 4.0}]


def test_first_write_wins(spark):
    state = spark.createDataFrame([("p", "2026-01", 1)], "program string, month string, total int")
    new = spark.createDataFrame([("p", "2026-01", 9), ("p", "2026-02", 2), ("p", "2026-02", 3)], "program string, month string, total int")
    after, added = ledger.insert_if_absent(state, new, ["program", "month"], ["total"])
    assert sorted(tuple(r) for r in after.collect()) == [("p", "2026-01", 1), ("p", "2026-02", 2)]
    assert [tuple(r) for r in added.collect()] == [("p", "2026-02", 2)]


def test_problems_are_told_once(spark):
    kind = "key string, detail string, first_seen string, last_seen string"
    sight = lambda day, detail: spark.createDataFrame([("k", detail, day)], "key string, detail string, seen string")
    registry, fresh = ledger.note_problems(spark.createDataFrame([], kind), sight("d1", "x"))
    assert fresh.count() == 1
    registry, fresh = ledger.note_problems(registry, sight("d2", "y"))
    assert fresh.count() == 0 and tuple(registry.first()) == ("k", "x", "d1", "d2")
    registry = ledger.clear_problems(registry, spark.createDataFrame([("k",)], "key string"))
    assert ledger.note_problems(registry, sight("d3", "z"))[1].count() == 1


def test_report_carries_the_same_figures():
    f = report.Figures("2026-08", 2253817, -6710, RANKED, ["[s] new: <b>R</b>"], ["<script> row & total"], {"baseline": "2026-01", "change": -64067, "pct": -2.8})
    body, page = report.text(f), report.page(f)
    for needle in ("2026-08", "2,253,817", "-6,710", "-64,067", "-2.8%", "Cook", "1,000", "900", "-100", "-10.0%", "St. Clair", "+20", "+4.0%", "1 declined, 1 gained, 1 flat, of 3"):
        assert needle in body and needle in page, needle
    assert body.index("row & total") < body.index("[s] new") < body.index("Data month")
    assert "<script>" not in page and "&lt;script&gt; row &amp; total" in page and "<style" not in page
    assert max(map(len, page.splitlines())) < 1000
    assert report.subject(f) == "ALERT: Enrollment 2026-08: -6,710 MoM"
    assert "no change" in report.subject(report.Figures("2026-08", 1, 0, []))


def _doc(month, cook):
    rows = "\n".join(f"{c} {cook if c == 'Cook' else 10}" for c in COUNTIES)
    return (f"https://x/{month}.pdf", month, f"Health Choice Enrollment for {month}\n{rows}\nGrand Total {1010 + cook}")


def test_run_reports_and_then_is_silent(spark, tmp_path):
    store, dim = StateStore(spark, f"file://{tmp_path}/state"), dimension(spark)
    pages = lambda *labels: spark.createDataFrame([("s", "".join(f'<a href="{x}">{x}</a>' for x in labels))], "page_id string, html string")
    none = spark.createDataFrame([], "page_id string, url string, error string")
    docs = lambda *rows: spark.createDataFrame(list(rows), "url string, label string, text string")
    first = run(store, pages("A"), none, docs(_doc("July 2026", 100), _doc("August 2026", 90), ("https://x/b.pdf", "bad", "Health Choice Enrollment for June 2026\nCook 5\nTotal 500")), dim, "d1", "healthchoice", "2026-07")
    assert first.figures == {"sections": 3, "accepted": 2, "refused": 1, "conflicts": 0, "unstated": 0, "rows": 205}
    assert first.subject == "Enrollment 2026-08: -10 MoM" and "1 declined, 0 gained, 101 flat, of 102" in first.text
    assert "Rows add up to 5, stated are 500" in first.text and "baseline; their changes" in first.text and "new: A" not in first.text
    again = run(store, pages("A"), none, docs(_doc("July 2026", 100), ("https://x/b.pdf", "bad", "Health Choice Enrollment for June 2026\nCook 5\nTotal 500")), dim, "d2", "healthchoice", "2026-07")
    assert again.subject == NO_UPDATE
    failed = spark.createDataFrame([("s", "u", "u: timeout")], "page_id string, url string, error string")
    told = run(store, pages("A").limit(0), failed, docs(_doc("July 2026", 1)), dim, "d3", "healthchoice", "2026-07")
    assert "u: timeout" in told.text and "new:" not in told.text
    alert = run(store, pages("A", "B"), none, docs(_doc("July 2026", 1)), dim, "d4", "healthchoice", "2026-07")
    assert alert.subject.startswith("ALERT: ") and "[s] new: B" in alert.text


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([(i % 7, i % 3, i) for i in range(60)], "u long, d long, n long")
    rows.repartition(6).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/in")
    run_ledger(stream, f"{tmp_path}/out", f"{tmp_path}/cp", "u long, d long, n long", ["u", "d"], ["n"]).awaitTermination()
    out = spark.read.parquet(f"{tmp_path}/out")
    assert out.count() == out.select("u", "d").distinct().count() == 21
    run_ledger(stream, f"{tmp_path}/out", f"{tmp_path}/cp", "u long, d long, n long", ["u", "d"], ["n"]).awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 21


def test_landing(spark, tmp_path, monkeypatch):
    blocks = spark.createDataFrame([(" S \n\nSubj\n(3)\nMon\nfirst\nsecond",), ("S\nSubj\nTue",), ("",), (None,)], "text string")
    got = [tuple(r) for r in landing.mail_items(blocks).collect()]
    assert got == [("S", "Subj", 3, "Mon", "first second"), ("S", "Subj", 1, "Tue", "")]
    raw = spark.createDataFrame([("a", "u", None, b"ok \xff", None), ("b", "v", None, None, "v: Timeout: slow")], landing.RAW_PAGE)
    good, bad = landing.fetched(raw)
    assert good.first().html == "ok �" and bad.first().error == "v: Timeout: slow"
    (tmp_path / "x.pdf").write_bytes(b"abc")
    (tmp_path / "y.pdf").write_bytes(b"damaged")

    def extract(content: bytes) -> str:
        if content == b"damaged":
            raise ValueError("damaged")
        return content.decode()

    got = {r.path[-5:]: (r.text, r.error) for r in landing.extract_documents(spark, str(tmp_path), extract).collect()}
    assert got == {"x.pdf": ("abc", None), "y.pdf": (None, "ValueError: damaged")}
    rows = spark.createDataFrame([(0, "a"), (1, "b"), (3, "c")], "page int, x string")
    pages = spark.createDataFrame([(0,), (1,), (2,), (3,)], "page int")
    assert [r.x for r in landing.pages_until_empty(pages, rows, 9).collect()] == ["a", "b"]
    many = [("x", 0, 9, 1), ("x", 0, 9, 1), ("x", 1, 9, 2), ("x", 3, 9, 3), ("y", 1, 9, 4), (None, 0, None, 5), (None, 1, None, 6), ("z", 0, 0, 7), ("z", 1, 5, 8), ("z", None, 5, 9), ("w", 0, 2, 10), ("w", 1, 2, 11), ("w", 2, 2, 12), ("v", -1, 3, 13)]
    for bound in (landing.MOST_LISTINGS, 0):
        monkeypatch.setattr(landing, "MOST_LISTINGS", bound)
        many_rows = spark.createDataFrame(many, "listing string, page int, most int, x int")
        got = landing.listings_until_empty(many_rows, "listing")
        assert sorted(r.x for r in got.collect()) == [1, 1, 2, 5, 7, 10, 11] and got.columns == ["listing", "page", "most", "x"]
        assert landing.listings_until_empty(many_rows.limit(0), "listing").isEmpty()
    found, failed = landing.readers({"a": lambda: rows, "b": lambda: rows.limit(0)}, ["a", "b", "zz"])
    assert set(found) == {"a"} and set(failed) == {"b", "zz"}


def test_filings(spark):
    page = "<table><tr><td>A &amp; B</td><td>1/2/2024</td><td>x</td><td>y</td><td>z</td><td>12</td></tr><tr><td>short</td></tr><tr><td>C</td><td>no date</td><td></td><td></td><td></td><td></td></tr></table>"
    pages = spark.createDataFrame([(page,)], "html string")
    rows = filings.combine({"t": filings.from_table(pages, "T")})
    assert [(r.entity, r.reported, r.state_residents, r.extra) for r in rows.collect()] == [("A & B", "2024-01-02", "12", "sent z")]
    assert filings.since_filter(rows, "2024-01-02").count() == 1 and filings.since_filter(rows, "2024-01-03").count() == 0
    assert filings.newest(rows).first().newest == "2024-01-02"
    blocks = spark.createDataFrame([("x Company Name: One Two Date of Incident: 1/1/2024 Date Public Notified: May 3, 2024 Number of Individuals Affected: 7 Company Name: none",)], "html string")
    assert [(r.entity, r.reported, r.breach_dates, r.total, r.state_residents) for r in filings.from_blocks(blocks, "W").collect()] == [("One Two", "2024-05-03", "1/1/2024", "7 ", None)]
    try:
        filings.check_since("2024-1-1")
    except ValueError:
        pass
    else:
        raise AssertionError
    rows = spark.createDataFrame([("a", "2024-01-01", 1), ("a", "2024-02-01", 2), ("b", "2024-02-01", 3), (None, "2024-02-01", 4), ("c", "2024-02-01", 5), ("a", "", 6), ("a", None, 7), ("d", "2024-02-01", 8)], "source_key string, reported string, x int")
    asked = spark.createDataFrame([("a", "2024-02-01"), ("a", "2024-01-15"), ("b", "2024-1-1"), ("b", "2024-01-01"), (None, "2024-02-01"), ("c", None), ("c", None), ("e", "2024-02-01\n")], "source_key string, since string")
    kept, refused = filings.since_by_source(rows, asked)
    assert sorted(r.x for r in kept.collect()) == [2, 4] and kept.columns == rows.columns
    assert {(r.source_key, r.since) for r in refused.collect()} == {("b", "2024-1-1"), ("c", None), ("e", "2024-02-01\n")} and refused.count() == 3
    assert filings.since_by_source(rows, asked.limit(0))[0].isEmpty()
    typed = filings.typed(spark.createDataFrame([("s", "e", "2024-13-01", None, None, "1,234", None)], filings.FILING)).first()
    assert typed.reported_date is None and typed.total_n == 1234


def test_caps(spark):
    rows = spark.range(20).withColumn("g", F.lit("a"))
    top = ledger.top_with_rest(rows, 15, [F.col("id")], "g").collect()
    assert len(top) == 16 and [r.n_more for r in top if r["rank"] is None] == [5]
    assert ledger.capped(rows, 15, [F.col("id")]).where("include_next_run").count() == 5


def test_delivery_leaves_no_stale_body(tmp_path):
    assert deliver(Outcome("S", "body", "<p>"), str(tmp_path)) == "S\n\nbody" and (tmp_path / "report.html").read_text() == "<p>"
    assert deliver(Outcome(NO_UPDATE), str(tmp_path)) == NO_UPDATE and not (tmp_path / "report.html").exists()


def test_known_months_are_not_wanted_again(spark):
    found = spark.createDataFrame([("/a/x.pdf", "Enrollment as of July 1, 2026"), ("/a/082026.pdf", "Enrollment"), ("/a/y.pdf", "Enrollment")], "url string, label string")
    months = spark.createDataFrame([("p", "2026-07"), ("q", "2026-08")], "program string, month string")
    assert {r.url: r.month for r in wanted_links(found, months, "p").collect()} == {"/a/082026.pdf": "2026-08", "/a/y.pdf": None}


def test_baselines_and_open_calls(spark):
    items = spark.createDataFrame([("a", 1), ("b", 2)], "state string, n int")
    assert {r.state: r.is_baseline for r in ledger.with_baseline(items, items.where("n = 1"), "state").collect()} == {"a": False, "b": True}
    calls = spark.createDataFrame([(1, "2024-01-01"), (2, "2024-02-01"), (3, None)], "n int, due string")
    assert [r.n for r in ledger.still_open(calls, "due", F.lit("2024-01-15")).collect()] == [2, 3]


def test_distinct_stream(spark, tmp_path):
    rows = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:05:00"), (2, "2024-01-01 00:01:00")], "k int, t string").withColumn("t", F.col("t").cast("timestamp"))
    rows.write.parquet(f"{tmp_path}/in")
    stream = distinct_stream(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), ["k"], "t", "1 hour")
    query = stream.writeStream.format("memory").queryName("seen").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r.k for r in spark.table("seen").collect()) == [1, 2]
