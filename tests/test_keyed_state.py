from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import functions as F

from tidemark.operators import ledger
from tidemark.streaming.keyed_state import in_force, run_items, run_problems


def ticks(spark, tmp_path, schema, batches, start):
    """Rows that land batch by batch, each taken in by a run of its own from the checkpoint of the one before."""
    at, seen = f"file://{tmp_path}", []
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(f"{at}/land")
        start(spark.readStream.schema(schema).parquet(f"{at}/land"), f"{at}/out", f"{at}/check").awaitTermination()
        seen.append(n)
    return f"{at}/out"


def test_items_enter_once_and_are_updated(spark, tmp_path):
    schema = "id string, seen int, amount int, note string"
    batches = [
        [("a", 2, 20, "later"), ("a", 1, 10, "first"), ("b", 1, None, "null"), (None, 1, 5, "no id")],
        [("a", 3, 10, "restated"), ("b", 2, 7, "now known"), (None, 2, 6, "still no id"), ("c", 9, 1, "c")],
        [("c", 1, 1, "late, as it stood"), ("a", 0, 11, "late change")],
    ]
    out = ticks(spark, tmp_path, schema, batches, lambda s, o, c: run_items(s, o, c, ["id"], ["seen"], ["amount"]))
    assert {r.id: (r.seen, r.amount, r.note, r.status) for r in in_force(spark, out, ["id"]).collect()} == {
        "a": (1, 11, "first", "UPDATE"), "b": (1, 7, "null", "UPDATE"), None: (1, 6, "no id", "UPDATE"), "c": (9, 1, "c", "NEW"),
    }
    assert spark.read.parquet(out).count() == 4 + 3  # restatements say nothing


def test_items_without_material_fields_are_the_batch_ledger(spark, tmp_path):
    schema = "k long, day string, at int"
    batches = [[(i % 7 if i % 5 else None, f"d{(i * n) % 4}", i * 31 % 100) for i in range(40)] for n in (1, 2, 3)]
    out = ticks(spark, tmp_path, schema, batches, lambda s, o, c: run_items(s, o, c, ["k", "day"], ["at"]))
    state = spark.createDataFrame([], schema)
    for rows in batches:
        state, _ = ledger.insert_if_absent(state, spark.createDataFrame(rows, schema), ["k", "day"], ["at"])
    got = [tuple(r) for r in in_force(spark, out, ["k", "day"]).select("k", "day", "at").collect()]
    assert sorted(got, key=str) == sorted(map(tuple, state.collect()), key=str)


def test_problems_fall_silent_and_come_back(spark, tmp_path):
    day = lambda d: datetime(2024, 1, d, tzinfo=timezone.utc)
    batches = [
        [("x", "one", day(2)), ("x", "zero", day(1)), ("y", None, day(2)), (None, "n", day(2))],
        [("x", "again", day(4)), ("z", "z", day(20))],  # y and the null key are due by then
        [("x", "new one", day(21)), ("y", "y", day(22)), ("z", "z2", day(19))],
    ]
    out = ticks(spark, tmp_path, "key string, detail string, seen timestamp", batches, lambda s, o, c: run_problems(s, o, c, quiet_days=7, late="2 days"))
    rows = {r.key: (r.detail, r.first_seen.day, r.last_seen.day, r.status) for r in in_force(spark, out, ["key"]).collect()}
    assert rows == {"x": ("new one", 21, 21, "new"), "y": ("y", 22, 22, "new"), "z": ("z", 20, 20, "seen"), None: ("n", 2, 2, "cleared")}
    cleared = {(r.key, r.last_seen.day) for r in spark.read.parquet(out).where("status = 'cleared'").collect()}
    assert cleared == {("x", 4), ("y", 2), (None, 2)}


def test_null_keys_are_keys(spark):
    kind = "k string, n int"
    state, new = spark.createDataFrame([(None, 1), ("a", 1)], kind), spark.createDataFrame([(None, 2), ("a", 2), ("b", 2)], kind)
    after, added = ledger.insert_if_absent(state, new, ["k"], ["n"])
    assert sorted(map(tuple, after.collect()), key=str) == [("a", 1), ("b", 2), (None, 1)] and added.count() == 1
    assert ledger.new_keys(state, new, ["k"]).collect() == [("b",)]
    registry = spark.createDataFrame([(None, "d", "1", "2")], "key string, detail string, first_seen string, last_seen string")
    seen = spark.createDataFrame([(None, "e", "3"), ("p", None, "3"), (None, "e", "1")], "key string, detail string, seen string")
    merged, fresh = ledger.note_problems(registry, seen)
    assert sorted(map(tuple, merged.collect()), key=str) == [("p", None, "3", "3"), (None, "d", "1", "3")] and [r.key for r in fresh.collect()] == ["p"]
    assert ledger.clear_problems(merged, spark.createDataFrame([(None,)], "key string")).select("key").collect() == [("p",)]
    grown = ledger.new_or_grown(spark.createDataFrame([(None, 1), ("a", 3), ("a", 2), ("z", None)], kind), spark.createDataFrame([(None, 2), ("a", 3), ("b", 1), ("z", 1)], kind), "k", "n")
    assert sorted(((r.k, r.before, r.reason) for r in grown.collect()), key=str) == [("b", None, "new"), ("z", None, "grown"), (None, 1, "grown")]


def test_new_items_enter_the_book_once(spark):
    book = spark.createDataFrame([("a", 1, "d0", "d0")], "id string, amount int, first_seen string, last_updated string")
    matched = spark.createDataFrame([("a", 2, "a", "UPDATE"), ("b", 5, None, "NEW"), ("b", 4, None, "NEW"), (None, 9, None, "NEW")], "id string, amount int, matched_id string, status string")
    got = ledger.apply_items(book, matched, F.lit("d1"), ["amount"])
    assert sorted(map(tuple, got.collect())) == [("a", 2, "d0", "d1"), ("b", 4, "d1", "d1")]
