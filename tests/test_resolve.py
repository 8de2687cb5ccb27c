from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions.places import COUNTIES, DISPLAY, dimension, display
from tidemark.operators import resolve


def fuzzy(spark, *labels):
    rows = spark.createDataFrame([(x,) for x in labels], "label string")
    return {r.label: r.name for r in resolve.canonical_fuzzy(rows, dimension(spark), "label").collect()}


def test_dimension_is_complete():
    assert len(COUNTIES) == len(set(COUNTIES)) == 102
    assert set(DISPLAY) <= set(COUNTIES)


def test_spacing_variants_are_exact(spark):
    rows = spark.createDataFrame([(x,) for x in ("De Witt", "St. Clair", "La Salle", "Jo Daviess", "Rock Island", "DeKalb", "Grand Total")], "label string")
    found = {r.label: r.name for r in resolve.canonical(rows, dimension(spark), "label").collect()}
    assert found == {"De Witt": "DeWitt", "St. Clair": "StClair", "La Salle": "LaSalle", "Jo Daviess": "JoDaviess", "Rock Island": "RockIsland", "DeKalb": "DeKalb", "Grand Total": None}


def test_damaged_labels_are_recovered(spark):
    expected = {"Chris+an": "Christian", "Galla+n": "Gallatin", "Faye e": "Fayette", "De Wi": "DeWitt", "Pia": "Piatt", "Sco": "Scott", "Eﬃngham": "Effingham", "Jeﬀerson": "Jefferson", "Clay": "Clay", "Clark": "Clark"}
    assert fuzzy(spark, *expected) == expected


def test_ambiguous_labels_stay_unresolved(spark):
    assert fuzzy(spark, "Ma", "C", "Aetna Better Health", "Mar", "", "   ") == {"Ma": None, "C": None, "Aetna Better Health": None, "Mar": None, "": None, "   ": None}


def test_null_labels_and_empty_tables(spark):
    assert fuzzy(spark, None, "Cook") == {None: None, "Cook": "Cook"}
    empty = spark.createDataFrame([], "label string")
    assert resolve.canonical_fuzzy(empty, dimension(spark), "label").count() == 0


def test_display_names(spark):
    rows = spark.createDataFrame([("StClair",), ("Cook",)], "n string")
    assert {r.d for r in rows.select(display(F.col("n")).alias("d")).collect()} == {"St. Clair", "Cook"}


def test_cascade_prefers_id_then_url_then_name(spark):
    known = spark.createDataFrame([("a", "u1", "North Clinic", 1), ("b", "u2", "South Clinic", 2), ("c", "u3", "East Clinic", None)], "id string, url string, name string, amount int")
    found = spark.createDataFrame(
        [("a", "u2", "South Clinic", 1), ("x", "u2", "other", 5), ("y", None, "EAST-clinic", None), ("z", None, "Noth Clinic", 1), ("w", None, "Far Away", 1), ("v", None, None, 1)],
        "id string, url string, name string, amount int",
    )
    got = {r.id: (r.matched_id, r.matched_by, r.status) for r in resolve.match_cascade(found, known, ["amount"]).collect()}
    assert got == {"a": ("a", "id", "unchanged"), "x": ("b", "url", "UPDATE"), "y": ("c", "name", "unchanged"), "z": ("a", "name", "unchanged"), "w": (None, None, "NEW"), "v": (None, None, "NEW")}


def test_upsert_touches_owned_columns_alone(spark):
    sheet = spark.createDataFrame([("a", 1, "mine"), ("b", 2, "mine")], "id string, n int, note string")
    new = spark.createDataFrame([("a", 5), ("c", 7)], "id string, n int")
    assert sorted(tuple(r) for r in resolve.upsert(sheet, new, "id", ["n"]).collect()) == [("a", 5, "mine"), ("b", 2, "mine"), ("c", 7, None)]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, last + (x != y))
    return row[-1]


def damaged(r, name, n):
    for _ in range(n):
        i = r.randrange(len(name) + 1)
        name = r.choice([name[:i] + r.choice("abc") + name[i:], name[:i] + name[i + 1 :], name[:i] + r.choice("abc") + name[i + 1 :]])
    return name


@pytest.mark.parametrize("closeness", [1, 2, 3])
def test_near_names_match_brute_force(spark, closeness):
    r = random.Random(closeness)
    stock = {"".join(r.choice("abc") for _ in range(r.choice([1, 2, 3, 4, 7, 12, 30]))) for _ in range(150)}
    probes = {damaged(r, q, r.randint(0, closeness + 1)) for q in stock} - {""}
    ids = {q: f"i{k}" for k, q in enumerate(sorted(stock))}
    got = {x.p: (x.best.edits, x.best.id) for x in resolve.near_names(spark.createDataFrame([(p,) for p in probes], "p string"), spark.createDataFrame(list(ids.items()), "q string, id string"), closeness).collect()}
    want = {p: min((edits(p, q), i) for q, i in ids.items()) for p in probes}
    assert got == {p: x for p, x in want.items() if x[0] <= closeness}


def near(spark, probes, ids, closeness):
    found = resolve.near_names(spark.createDataFrame([(p,) for p in probes], "p string"), spark.createDataFrame(list(ids.items()), "q string, id string"), closeness)
    return {x.p: (x.best.edits, x.best.id) for x in found.collect()}


def test_names_that_share_their_pieces_do_not_meet_one_by_one(spark, monkeypatch):
    """All of a numbered stock shares two pieces; the nearest within one edit are found without a comparison of names."""
    monkeypatch.setattr(resolve.F, "levenshtein", lambda *x: resolve.F.raise_error(resolve.F.lit("names met")).cast("int"))
    ids = {f"supplier{i:09d}": f"i{i}" for i in range(400)}
    got = near(spark, [q + "x" for q in ids] + ["other" + q for q in ids], ids, 2)
    assert got == {q + "x": (1, i) for q, i in ids.items()}


@pytest.mark.parametrize("closeness", [1, 2, 3])
def test_crowds_match_brute_force(spark, monkeypatch, closeness):
    monkeypatch.setattr(resolve, "CROWD", 3)
    r = random.Random(closeness)
    ids = {f"sup*lier{i:05d}": f"i{i}" for i in r.sample(range(500), 60)}
    probes = {damaged(r, q, r.randint(0, closeness + 1)) for q in ids}
    want = {p: min((edits(p, q), i) for q, i in ids.items()) for p in probes}
    assert near(spark, probes, ids, closeness) == {p: x for p, x in want.items() if x[0] <= closeness}


def test_cascade_with_repeated_and_null_ids(spark):
    """Rows are told apart by themselves, not by their ids, and each comes out once."""
    known = spark.createDataFrame([("c", "u1", "clinic", 1), ("c", "u1", "clinic", 0), (None, "u9", "lost clinic", 1), ("d", "", "", 1)], "id string, url string, name string, amount int")
    found = spark.createDataFrame(
        [("5", None, "clinix", 0), ("5", None, "zzzzzzzzzz", 0), (None, None, "clinix", 7), (None, None, None, 7), (None, "u9", "nowhere", 1), ("c", None, "c", 0), ("e", "", "!!", 1), ("5", None, "clinix", 0)],
        "id string, url string, name string, amount int",
    )
    got = sorted(((r.id, r.name, r.matched_id, r.matched_by, r.status) for r in resolve.match_cascade(found, known, ["amount"]).collect()), key=str)
    assert got == sorted(
        [
            ("5", "clinix", "c", "name", "unchanged"),
            ("5", "clinix", "c", "name", "unchanged"),
            ("5", "zzzzzzzzzz", None, None, "NEW"),
            (None, "clinix", "c", "name", "UPDATE"),
            (None, None, None, None, "NEW"),
            (None, "nowhere", None, None, "NEW"),
            ("c", "c", "c", "id", "unchanged"),
            ("e", "!!", None, None, "NEW"),
        ],
        key=str,
    )


def test_cascade_takes_very_long_names(spark):
    r = random.Random(1)
    names = ["".join(r.choice("abcdefgh") for _ in range(n)) for n in (2000, 2000, 20_000)]
    known = spark.createDataFrame([(str(i), None, x, 1) for i, x in enumerate(names)], "id string, url string, name string, amount int")
    found = spark.createDataFrame([(f"n{i}", None, damaged(r, x, 2), 1) for i, x in enumerate(names)] + [("far", None, damaged(r, names[0], 9), 1)], "id string, url string, name string, amount int")
    assert {x.id: x.matched_id for x in resolve.match_cascade(found, known, ["amount"]).collect()} == {"n0": "0", "n1": "1", "n2": "2", "far": None}


def test_large_dimensions_are_met_by_three_letters(spark):
    r = random.Random(3)
    names = sorted({"".join(r.choice("abcde") for _ in range(r.randint(2, 9))) for _ in range(220)})
    labels = sorted({"".join(c for c in x if r.random() < 0.8) for x in names} | {"abc", "eda", "zzz", "aabbc"})
    dim = spark.createDataFrame([(x, x.upper()) for x in names], "norm string, name string")
    got = {x.label: (x.name, x.how) for x in resolve.resolved_labels(spark.createDataFrame([(x,) for x in labels], "label string"), dim, dim_size=10_000_000).collect()}

    def within(a, b):
        rest = iter(b)
        return all(x in rest for x in a)

    for x in labels:
        pre, sub = [n for n in names if n.startswith(x)], [n for n in names if within(x, n)]
        want = (x.upper(), "exact") if x in names else (None, None)
        if x not in names and len(x) >= 3:
            want = (pre[0].upper(), "prefix") if len(pre) == 1 else (sub[0].upper(), "subsequence") if not pre and len(sub) == 1 else (None, None)
        assert got[x] == want, x
    assert {how for _, how in got.values()} == {None, "exact", "prefix", "subsequence"}


@pytest.mark.parametrize("size", [10, 10_000_000])
def test_dimension_size_changes_the_plan_not_the_result(spark, size):
    rows = spark.createDataFrame([("Pia",), ("Cook",)], "label string")
    found = {r.label: r.how for r in resolve.resolved_labels(rows, dimension(spark), dim_size=size).collect()}
    assert found == {"Pia": "prefix", "Cook": "exact"}
