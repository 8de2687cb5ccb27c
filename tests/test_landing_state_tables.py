from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tidemark.functions.places import dimension
from tidemark.operators import observed, panel, sections, validate
from tidemark.plans import report, report_tables
from tidemark.sources import landing, paged, scratch
from tidemark.sources.state import Claimed, StateStore


def test_catalogs_need_no_schema(spark):
    bodies = [
        {"states": {"A": {"name": "First", "sources": [{"url": "u", "kind": "news", "search_terms": ["x", "y"], "extra": {"deep": [1]}}, {"url": 5, "search_terms": "no list", "unverified": True}, "no object", None]}, "B": {"sources": []}, "C": {}, "D": 7}},
        {"states": [1, 2]},
        {"other": 1},
    ]
    texts = [json.dumps(b) for b in bodies] + ["{broken", "", None]
    rows = landing.catalog(spark.createDataFrame([(t,) for t in texts], "body string")).collect()
    got = sorted((r.state, r.name, r.url, r.kind, r.search_terms, r.unverified) for r in rows if r.url != "5")
    assert got == [("A", "First", "u", "news", ["x", "y"], False)]
    assert [(r.state, r.search_terms, r.unverified) for r in rows if r.url == "5"] == [("A", None, True)]
    assert landing.catalog(spark.createDataFrame([], "body string")).count() == 0


def test_catalog_files(spark, tmp_path):
    (tmp_path / "one.json").write_text(json.dumps({"states": {"A": {"sources": [{"url": "u"}]}}}, indent=2))
    assert [r.url for r in landing.catalog(landing.catalog_files(spark, str(tmp_path))).collect()] == ["u"]


@pytest.fixture(scope="module")
def listing(spark, tmp_path_factory):
    at = "file://" + str(tmp_path_factory.mktemp("listing")) + "/l"
    rows = spark.range(100).select(F.floor(F.col("id") / 5).cast("int").alias("page"), F.col("id").cast("string").alias("source_id"), F.lit("u").alias("url"), F.concat(F.lit("<p>"), "id").alias("html"))
    rows.where("page <> 14").write.partitionBy("page").parquet(at)
    return at


def test_listing_ends_at_limit_and_first_empty_page(spark, listing):
    pages = lambda df: sorted({r.page for r in df.collect()})
    assert pages(paged.listing(spark, listing)) == list(range(14))
    assert pages(paged.listing(spark, listing, limit=3)) == [0, 1, 2]
    assert pages(paged.listing(spark, listing, limit=0)) == [0]
    assert paged.listing(spark, listing).count() == 70
    assert paged.listing(spark, listing + "-missing").count() == 0


def test_page_filters_reach_the_source(spark, listing):
    asked = paged.listing(spark, listing, pages_per_task=2).where("page >= 4 and page < 9 and source_id <> '21'")
    assert sorted({r.page for r in asked.collect()}) == [4, 5, 6, 7, 8] and asked.count() == 24
    tasks = lambda df: df.select(F.spark_partition_id().alias("i")).distinct().count()
    assert tasks(asked) == 3 and tasks(paged.listing(spark, listing, pages_per_task=2)) == 7
    plan = asked._jdf.queryExecution().executedPlan().toString()
    assert "source_id" in plan and ">= 4" not in plan and "< 9" not in plan  # what the source has taken over is filtered no more
    one = paged.listing(spark, listing).where("page = 6").select("source_id")
    assert tasks(one) == 1 and sorted(r[0] for r in one.collect()) == [str(i) for i in range(30, 35)]
    assert paged.listing(spark, listing).where("page > 500").count() == 0


def test_new_documents_are_read_once(spark, tmp_path):
    folder, out = tmp_path / "in", [f"file://{tmp_path}/ledger", f"file://{tmp_path}/seen"]
    folder.mkdir()
    opened = spark.sparkContext.accumulator(0)

    def extract(content: bytes) -> str:
        opened.add(1)
        return content.decode()

    def call():
        landing.read_new_documents(spark, f"file://{folder}", extract, *out).awaitTermination()
        return {r.path[-5:]: (r.text, r.length, r.batch, (r.error or "")[:12]) for r in spark.read.parquet(out[0]).collect()}

    (folder / "a.pdf").write_bytes(b"one")
    (folder / "b.pdf").write_bytes(b"\xff")
    (folder / "c.txt").write_bytes(b"not asked for")
    first = {"a.pdf": ("one", 3, 0, ""), "b.pdf": (None, 1, 0, "UnicodeDecod")}
    assert call() == first and opened.value == 2
    assert call() == first and opened.value == 2
    (folder / "d.pdf").write_bytes(b"two")
    assert call() == first | {"d.pdf": ("two", 3, 1, "")} and opened.value == 3
    with pytest.raises(landing.ExtractorUnavailable):
        landing.read_new_documents(spark, f"file://{folder}", None, *out)


def test_one_of_two_writers_has_the_next_version(spark, tmp_path):
    one, two = (StateStore(spark, f"file://{tmp_path}/s") for _ in range(2))
    rows = lambda n: spark.createDataFrame([(n,)], "n int")
    assert one.save("t", rows(1)) == 1
    base = two.version("t")
    assert one.save("t", rows(2)) == 2
    with pytest.raises(Claimed):
        two.save("t", rows(9), after=base)  # made from version 1, which is no longer in force
    assert [r.n for r in two.load("t", "n int").collect()] == [2]

    class Slow(StateStore):
        """Another writer comes while this one writes."""

        def _create(self, fs, mark):
            made = StateStore._create(fs, mark)
            with pytest.raises(Claimed):
                two.save("t", rows(8))
            return made

    assert Slow(spark, f"file://{tmp_path}/s").save("t", rows(3)) == 3
    with pytest.raises(Exception, match="boom"):
        one.save("t", rows(1).select(F.raise_error(F.lit("boom")).cast("int").alias("n")))
    assert one.save("t", rows(4)) == 4  # the claim of a writer that failed is given back
    fs, mark = one._fs(f"file://{tmp_path}/s/_claims/t/v=5")
    assert one._create(fs, mark)  # a writer that was killed
    with pytest.raises(Claimed):
        one.save("t", rows(5))
    one.release("t")
    assert one.save("t", rows(5)) == 5 and [r.n for r in one.load("t", "n int").collect()] == [5]


def test_bodies_of_all_programs_equal_single_reports(spark):
    import random

    r = random.Random(1)
    points = [(p, c, m, r.choice([0, 10, 1000, 2000, r.randint(1, 9_000_000)])) for p in ("p", "q & <r>", "s") for c in ("Cook", "StClair", "Will", *[f"Place {i:02} of a long name" for i in range(25)]) for m in ("2026-01", "2026-06", "2026-07") if r.random() < 0.9]
    points += [("lone", "Cook", "2026-07", 5)]
    rows = spark.createDataFrame(points, "program string, county string, month string, value bigint")
    facts, ranked = report_tables.figures(rows, "2026-01")
    words = report.Wording(context="Context & more", byline="by <x>")
    texts, pages = ({x.program: x.body for x in f(facts, ranked, words).collect()} for f in (report_tables.text_bodies, report_tables.html_bodies))
    assert set(texts) == set(pages) == {"p", "q & <r>", "s", "lone"}
    totals = {(x.program, x.month): x.total for x in panel.totals(rows).collect()}
    for p in texts:
        months = sorted(m for q, m in totals if q == p)
        own = [x.asDict() for x in ranked.where(F.col("program") == p).orderBy("change", "pct", "county").collect()]
        now, then = totals[p, months[-1]], totals.get((p, "2026-01"))
        base = {"baseline": "2026-01", "change": now - then, "pct": (now - then) / then * 100 if then else 0.0} if then is not None else None
        mom = now - totals[p, months[-2]] if len(months) > 1 else 0
        f = report.Figures(months[-1], now, mom, own, baseline=base)
        assert texts[p] == report.text(f, words)
        assert pages[p] == report.page(f, words)


def test_percent_rounds_the_exact_value(spark):
    values = [0.25, 0.35, -0.05, 2.45, 0.75, 1e9 / 3, 0.0]
    rows = spark.createDataFrame([(x,) for x in [*values, None]], "x double")
    assert [r[0] for r in rows.select(report_tables.percent("x")).collect()] == [*(f"{x:+.1f}%" for x in values), None]


def test_walk_equals_windows(spark):
    text = "\n".join(["Cook 7", "Will 3", "Unknown Plan Enrollment for May 2026", "Lake 1", "Health Choice Enrollment for June 2026", "Cook 8", "Cook 8", "Lake 2,000", "Grand Total *", "Will 4", "Nowhere 9", "Total 2,015", "Kane 5", "FIDE SNP Enrollments — July 2026", "Kane 6", "Kane 7", "Health Choice Enrollment for June 2026", "Cook 9", "Total 1", "Pike 3"])
    docs = spark.createDataFrame([("a", text), ("b", "nothing"), ("c", None), ("d", "Health Choice Enrollment for June 2026"), (None, "Health Choice Enrollment for June 2026\nCook 1")], "doc_id string, text string")
    rows = lambda df: sorted(map(tuple, df.select("doc_id", "part", "program", "period", "county", "value", "pos").collect()), key=str)
    walk = rows(sections.walked(docs, dimension(spark)))
    assert walk == rows(sections.as_one(sections.parse(docs, dimension(spark))))
    assert {x[1] for x in walk} == {"header", "row", "total", "conflict"} and {x[0] for x in walk} == {"a", "d", None}


def test_figures_are_taken_while_rows_pass(spark):
    summary = spark.createDataFrame([("a", 3, 10, 10, []), ("b", 3, 10, 90, []), ("c", 1, 5, None, ["x"])], "k string, n bigint, found bigint, total bigint, conflicts array<string>")
    judged, seen = observed.of_gate(validate.gate(summary))
    scratch.cut(judged)
    assert seen.get == {"sections": 3, "accepted": 1, "refused": 2, "conflicts": 1, "unstated": 1, "rows": 7}
    empty, seen = observed.of_gate(validate.gate(summary.limit(0)))
    empty.collect()
    assert seen.get == {"sections": 0, "accepted": 0, "refused": 0, "conflicts": 0, "unstated": 0, "rows": 0}


def test_shared_folder_is_named_in_full(spark):
    """A path without a scheme belongs to the cluster's file system, not to each machine's own disk."""
    assert scratch.shared_folder(spark).startswith("file:/") and scratch.new_folder(spark, "x").startswith("file:/")
