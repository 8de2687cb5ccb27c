from __future__ import annotations

import pytest

from tidemark.functions.places import COUNTIES, dimension
from tidemark.operators import sections, validate
from tidemark.operators.sections import Sections


def parsed(spark, *texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    return sections.parse(docs, dimension(spark))


def rows_of(found: Sections):
    return {(r.doc_id, r.program, r.period, r.county): r.value for r in found.rows.collect()}


SIMPLE = "FIDE-SNP Enrollments for August 2026\nAdams   578\nCook  1 2  36,652\n\nGrand Total  37,230\nWill 7"


def test_rows_and_total(spark):
    found = parsed(spark, SIMPLE)
    assert rows_of(found) == {(0, "dual", "August 2026", "Adams"): 578, (0, "dual", "August 2026", "Cook"): 36652}
    assert [(r.program, r.total) for r in found.totals.collect()] == [("dual", 37230)]
    assert found.conflicts.count() == 0


def test_orphans_go_to_the_next_header(spark):
    text = "MMAI Enrollment — July 2020\nAdams 537\nGrand Total 537\nBureau 230\nHealth Choice Enrollment - July 2020 (continued)\nCook 9"
    assert rows_of(parsed(spark, text)) == {(0, "dual", "July 2020", "Adams"): 537, (0, "healthchoice", "July 2020", "Bureau"): 230, (0, "healthchoice", "July 2020", "Cook"): 9}


def test_conflicts_and_repeats(spark):
    head = "HCI Enrollment for May 2021\n"
    found = parsed(spark, head + "Adams 578\nAdams 999", head + "Adams 578\nAdams 578", head + "Adams 1\nAdams 2\nAdams 1")
    assert sorted((r.doc_id, r.county) for r in found.conflicts.collect()) == [(0, "Adams"), (2, "Adams"), (2, "Adams")]
    assert {k[0]: v for k, v in rows_of(found).items()} == {0: 999, 1: 578, 2: 1}


def test_waiting_row_conflicts_only_with_later_ones(spark):
    text = "Cook 1\nCook 2\nHCI Enrollment for May 2021\nCook 3"
    found = parsed(spark, text)
    assert rows_of(found) == {(0, "healthchoice", "May 2021", "Cook"): 3}
    assert found.conflicts.count() == 1


def test_unknown_headers_suppressed_totals_and_ends(spark):
    text = "HCI Enrollment for May 2021\nCook 3\nOther Enrollment for May 2021\nWill 4\nGrand Total *\nKane 5\nTotal 12 * *\nLake 6"
    found = parsed(spark, text)
    assert {k[3]: v for k, v in rows_of(found).items()} == {"Cook": 3, "Will": 4, "Kane": 5}
    assert [r.total for r in found.totals.collect()] == [12]


def test_empty_texts(spark):
    found = parsed(spark, None, "", "no header\nCook 4", "HCI Enrollment for May 2021")
    assert [(r.doc_id, r.program) for r in found.headers.collect()] == [(3, "healthchoice")]
    gate = validate.gate(validate.summarize(found)).collect()
    assert [(r.doc_id, r.first_problem, r.accepted) for r in gate] == [(3, "A section without rows of places", False)]


def judged(spark, n, value, total, conflicts=(), ask=True):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(n, n * value if n else None, total, list(conflicts))], "n long, found long, total long, conflicts array<string>")
    return rows.select(validate.problems(F.col("n"), F.col("found"), F.col("total"), F.col("conflicts"), F.lit(ask))).first()[0]


@pytest.mark.parametrize(
    ("n", "total", "told"),
    [(102, 10200, []), (102, 20000, ["Rows add up to 10,200, stated are 20,000: off by 9,800 where 100 may be"]), (102, 10230, []), (40, None, ["Only 40 of 102 places, without a stated total to hold them against"]), (100, 10000, []), (0, None, ["A section without rows of places"])],
)
def test_validation(spark, n, total, told):
    assert judged(spark, n, 100, total) == told


def test_conflicts_come_first_and_are_listed_once(spark):
    told = judged(spark, 102, 100, 0, ["Will", "Cook", "Will", "Adams", "Lake", "Kane", "Bond"])
    assert told[0] == "Places with two values in a section: Adams, Bond, Cook, Kane, Lake" and len(told) == 2


def test_short_lists_are_only_asked_of_long_ones(spark):
    assert judged(spark, 40, 1, None, ask=False) == []


def test_status(spark):
    body = "\n".join(f"{c} 10" for c in COUNTIES)
    found = parsed(spark, f"HCI Enrollment for May 2021\n{body}\nTotal 1,020", "HCI Enrollment for June 2021\nCook 1\nCook 2\nTotal 2", "HCI Enrollment for July 2021\nCook 1")
    assert {r.doc_id: r.status for r in validate.status(validate.summarize(found)).collect()} == {0: "OK", 1: "CONFLICT", 2: "CHK"}
