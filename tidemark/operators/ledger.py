"""State that only grows: recorded months, known problems, seen items."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.sources.scratch import cut


def first_write(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Each key's first row by ``order``; later ones are restatements and ignored."""
    others = [c for c in rows.columns if c not in keys]
    least = F.min_by(F.struct(*others), F.struct(*order)).alias("_r")
    return rows.groupBy(*keys).agg(least).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in others])


def matching(rows: DataFrame, known: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """``rows`` whose keys are (``left_semi``) or are not (``left_anti``) among the ``known`` ones; a null key is a key."""
    seen = known.select(*[F.col(k).alias(f"_known{i}") for i, k in enumerate(keys)])
    return rows.join(seen, reduce(and_, [F.col(k).eqNullSafe(F.col(f"_known{i}")) for i, k in enumerate(keys)]), how)


def insert_if_absent(state: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(state after, rows added): new keys by their first row; what is recorded stays as it is, under a null key, too."""
    added = matching(first_write(new, keys, order), state, keys, "left_anti").select(*state.columns)
    return state.unionByName(added), added


def new_keys(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    return matching(after.select(*keys).distinct(), before, keys, "left_anti")


def problem_key(url: Column, detail: Column | None = None) -> Column:
    """A url and its problem's first 40 characters, or "err" for one that could not be read."""
    return F.concat(url, F.lit("|"), F.lit("err") if detail is None else F.substring(detail, 1, 40))


def note_problems(registry: DataFrame, seen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(registry after, new ones) of (key, detail, first_seen, last_seen), from sightings (key, detail, seen).

    A known problem keeps its detail and first date and gets the last one, unless that is earlier; only new keys are
    worth a report.  A null key is one problem.
    """
    sighted = seen.groupBy(F.col("key").alias("_key")).agg(F.min_by("detail", F.struct("seen", "detail")).alias("_detail"), F.min("seen").alias("_first"), F.max("seen").alias("_last"))
    known = registry.withColumn("_old", F.lit(True))
    merged = known.join(sighted, F.col("key").eqNullSafe(F.col("_key")), "full_outer").select(
        F.when(F.col("_old"), F.col("key")).otherwise(F.col("_key")).alias("key"),
        F.when(F.col("_old"), F.col("detail")).otherwise(F.col("_detail")).alias("detail"),
        F.coalesce("first_seen", "_first").alias("first_seen"),
        F.greatest("_last", "last_seen").alias("last_seen"),
    )
    new = sighted.select(F.col("_key").alias("key"), F.col("_detail").alias("detail"), F.col("_first").alias("first_seen"), F.col("_last").alias("last_seen"))
    return merged, matching(new, registry, ["key"], "left_anti")


def clear_problems(registry: DataFrame, solved: DataFrame) -> DataFrame:
    return matching(registry, solved, ["key"], "left_anti")


def keep_last(rows: DataFrame, n: int, order: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """The last ``n`` rows (of each group): without groups a plain top-n, so nothing is gathered to be ranked."""
    down = [F.col(c).desc() for c in order]
    if not by:
        return rows.orderBy(*down).limit(n)
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(*by).orderBy(*down))).where(F.col("_n") <= n).drop("_n")


def new_or_grown(old: DataFrame, new: DataFrame, key: str, count: str) -> DataFrame:
    """Items that the old state lacks, or whose count has grown, with ``reason`` (new, grown) and the old count.

    A null key is one item.  An item that the old state has twice counts as its larger count; a null count is none.
    """
    before = old.groupBy(F.col(key).alias("_known")).agg(F.max(count).alias("before")).withColumn("_old", F.lit(True))
    joined = new.join(before, F.col(key).eqNullSafe(F.col("_known")), "left")
    reason = F.when(F.col("_old").isNull(), "new").when(F.coalesce(F.col(count), F.lit(0)) > F.coalesce("before", F.lit(0)), "grown")
    return joined.withColumn("reason", reason).where("reason is not null").drop("_known", "_old")


def capped(rows: DataFrame, n: int, order: Sequence[Column], out: str = "include_next_run") -> DataFrame:
    """All rows, with their rank; those past ``n`` are carried over to the next run.

    The rows are sorted by ranges; a row's rank is its place in its range and the number of rows in those before.
    """
    ranged = cut(rows.orderBy(*order).withColumn("_range", F.spark_partition_id()))
    counts = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))  # one row a range
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    place = F.row_number().over(W.partitionBy("_range").orderBy(*order))
    ranked = ranged.join(F.broadcast(before), "_range").withColumn("rank", (place + F.col("_before")).cast("int")).drop("_range", "_before")
    return ranked.withColumn(out, F.col("rank") > n)


def top_with_rest(rows: DataFrame, n: int, order: Sequence[Column], by: str) -> DataFrame:
    """Each group's first ``n`` rows, and one more row that says how many are left out (null rank)."""
    ranked = rows.withColumn("rank", F.row_number().over(W.partitionBy(by).orderBy(*order)))
    top = ranked.where(F.col("rank") <= n).withColumn("n_more", F.lit(None).cast("long"))
    rest = rows.groupBy(by).agg(F.greatest(F.count(F.lit(1)) - n, F.lit(0)).alias("n_more")).where("n_more > 0")
    return top.unionByName(rest, allowMissingColumns=True)


def apply_items(ledger: DataFrame, matched: DataFrame, today: Column, material: Sequence[str]) -> DataFrame:
    """The ledger after a run of matched items (``match_cascade``): new items enter, changed ones get their material
    fields and date of update, all others stay; ``first_seen`` never changes.

    Of several items that change one, and of new ones with the same id, the least in their material fields counts; a new
    item enters once.  New items without an id stay out, as no later run could tell them.
    """
    changed = matched.where("status = 'UPDATE'").groupBy(F.col("matched_id").alias("id")).agg(F.min(F.struct(*material)).alias("_new"))
    column = lambda c: F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in material else F.col(c)
    stamp = F.when(F.col("_new").isNotNull(), today).otherwise(F.col("last_updated")).alias("last_updated")
    kept = ledger.join(changed, "id", "left").select(*[stamp if c == "last_updated" else column(c) for c in ledger.columns])
    fresh = first_write(matched.where("status = 'NEW' and id is not null"), ["id"], [*material, *[c for c in ledger.columns if c in matched.columns and c not in (*material, "id")]])
    fresh = fresh.withColumn("first_seen", today).withColumn("last_updated", today)
    have = [c for c in ledger.columns if c in fresh.columns]
    return kept.unionByName(fresh.select(*have), allowMissingColumns=True)


NO_UPDATE, NO_DATA, REPORT = "NO_UPDATE", "NO_DATA", "REPORT"


def silence(new: Column, alerts: Column, problems: Column, history: Column) -> Column:
    """What a run says, by its numbers: nothing new, no alert and no problem is NO_UPDATE; something, but no history to
    report on, is NO_DATA; else it reports.  A null number counts as none."""
    some = lambda c: F.coalesce(c, F.lit(0)) > 0
    return F.when(~(some(new) | some(alerts) | some(problems)), NO_UPDATE).when(~some(history), NO_DATA).otherwise(REPORT)


def with_baseline(items: DataFrame, ledger: DataFrame, by: str) -> DataFrame:
    """Adds ``is_baseline``: items of a key (a state, a source) of which the ledger has nothing yet.

    Such items set the key's baseline and are not news, whether the whole ledger is new or only that key.
    """
    known = ledger.select(by).distinct().withColumn("_known", F.lit(True))
    return items.join(known, by, "left").withColumn("is_baseline", F.col("_known").isNull()).drop("_known")


def still_open(rows: DataFrame, due: str, today: Column) -> DataFrame:
    """Calls whose due date is not past; those without one are kept."""
    return rows.where(F.col(due).isNull() | (F.col(due) >= today))
