from __future__ import annotations

import pytest

from tidemark.operators import panel


@pytest.fixture(scope="module")
def small(spark):
    rows = [("p", "2026-07", "Cook", 1000), ("p", "2026-07", "Adams", 500), ("p", "2026-07", "Will", 200), ("p", "2026-08", "Cook", 900), ("p", "2026-08", "Adams", 520), ("p", "2026-08", "Will", 200)]
    return spark.createDataFrame(rows, "program string, month string, county string, value long")


def test_declines_come_first(small):
    got = [(r.county, r.now, r.then, r.change, r.pct) for r in panel.rank_changes(small).orderBy("change", "pct").collect()]
    assert got == [("Cook", 900, 1000, -100, -10.0), ("Will", 200, 200, 0, 0.0), ("Adams", 520, 500, 20, 4.0)]
    ranked = panel.rank_changes(small)
    assert [r.county for r in panel.declines(ranked).collect()] == ["Cook"]
    assert [r.county for r in panel.gains(ranked).collect()] == ["Adams"]
    assert tuple(panel.directions(ranked).first())[1:] == (1, 1, 1, 3)


def test_gaps_are_not_bridged(spark):
    rows = [("p", "2026-01", "A", 5), ("p", "2026-01", "B", 3), ("p", "2026-02", "A", 6), ("p", "2026-03", "A", 0), ("p", "2026-03", "B", 2)]
    p = spark.createDataFrame(rows, "program string, month string, county string, value long")
    assert sorted((r.county, r.month, r.change) for r in panel.rank_changes(p).collect()) == [("A", "2026-02", 1), ("A", "2026-03", -6)]


def test_first_month_unknown_month_and_zero_base(spark, small):
    first = small.where("month = '2026-07'")
    assert panel.rank_changes(first).count() == 0
    with pytest.raises(KeyError):
        panel.require_month(small, "p", "2020-01")
    panel.require_month(small, "p", "2026-07")
    zero = spark.createDataFrame([("p", "1", "A", 0), ("p", "2", "A", 4)], "program string, month string, county string, value long")
    assert panel.rank_changes(zero).first().pct == 0.0


def test_override_baseline_series_and_coverage(small):
    totals = panel.totals(small)
    got = panel.baseline_change(totals, panel.latest(small), "2026-07").first()
    assert (got.now, got.then, got.change) == (1620, 1700, -80) and got.pct == pytest.approx(-80 / 17)
    cook = panel.series(small).where("county = 'Cook'").first().points
    assert [tuple(x) for x in cook] == [("2026-07", 1000), ("2026-08", 900)]
    assert tuple(panel.coverage(small).first()) == ("p", 2, "2026-07", "2026-08")


def test_empty_panel(spark):
    none = spark.createDataFrame([], "program string, month string, county string, value long")
    assert panel.rank_changes(none).count() == 0 and panel.coverage(none).count() == 0
