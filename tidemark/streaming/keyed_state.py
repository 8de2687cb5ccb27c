"""The ledger and the problem registry as keyed state: a value for each key in Spark's state store, timers where a problem
falls silent.

Each tick of new rows changes the keys that it names and reads no others, so its cost does not grow with the ledger.  What
changes is written out once a batch, and the table in force is each key's last row.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StringType, StructField, StructType

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class ItemState(StatefulProcessor):
    """A key's row in force: the first by ``order`` of the first batch that has the key enters as NEW.

    With ``material`` fields, a later batch whose first row differs in one is an UPDATE of these fields; all other rows
    are restatements and say nothing.
    """

    def __init__(self, keys: Sequence[str], order: Sequence[str], material: Sequence[str], fields: StructType):
        self.keys, self.order, self.material = list(keys), list(order), list(material)
        self.others = [f for f in fields if f.name not in keys]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("kept", StructType(self.others))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        # None sorts first, as in Spark; a batch is read once and one of its rows held.
        least = min(rows, key=lambda r: [(r[c] is not None, r[c]) for c in self.order])
        names = [f.name for f in self.others]
        if not self.kept.exists():
            now, status = {c: least[c] for c in names}, "NEW"
        else:
            now, status = dict(zip(names, self.kept.get())), "UPDATE"
            new = {c: least[c] for c in self.material}
            if all(now[c] == x for c, x in new.items()):
                return
            now |= new
        self.kept.update(tuple(now[c] for c in names))
        yield Row(**dict(zip(self.keys, key)), **now, status=status)

    def close(self) -> None:
        pass


class ProblemState(StatefulProcessor):
    """A known problem: it keeps its first detail and date, gets the last date, and ends when it was not seen for
    ``quiet`` milliseconds of event time; what comes after that is a new problem."""

    def __init__(self, quiet: int):
        self.quiet = quiet

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getValueState("known", "detail string, first_seen long, last_seen long")

    def _row(self, key, detail, first, last, status) -> Row:
        at = lambda ms: datetime.fromtimestamp(ms / 1000, timezone.utc)
        return Row(key=key[0], detail=detail, first_seen=at(first), last_seen=at(last), status=status)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        least, last = None, None
        for r in rows:
            ms = round(r["seen"].timestamp() * 1000)
            here = (ms, r["detail"] is not None, r["detail"])
            least, last = here if least is None else min(least, here), ms if last is None else max(last, ms)
        first, detail, status = least[0], least[2], "new"
        if self.known.exists():
            was = self.known.get()
            self.handle.deleteTimer(was[2] + self.quiet)
            if first < was[2] + self.quiet:
                detail, first, last, status = was[0], was[1], max(last, was[2]), "seen"
        self.known.update((detail, first, last))
        self.handle.registerTimer(last + self.quiet)
        yield self._row(key, detail, first, last, status)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        detail, first, last = self.known.get()
        self.known.clear()
        yield self._row(key, detail, first, last, "cleared")

    def close(self) -> None:
        pass


@contextmanager
def _rocks(spark: SparkSession):
    """Streams started inside keep their state in RocksDB, on the executors' disks, with its changes in the checkpoint."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)


def _tick(changes: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Take in all that is there now, and stop.  A batch that is run again replaces its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    with _rocks(changes.sparkSession):
        return changes.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_items(stream: DataFrame, path: str, checkpoint: str, keys: Sequence[str], order: Sequence[str], material: Sequence[str] = ()) -> StreamingQuery:
    """One tick of the ledger: first write wins, and material fields are updated.  A null key is a key."""
    kinds = StructType([*[stream.schema[c] for c in keys], *[f for f in stream.schema if f.name not in keys], StructField("status", StringType())])
    state = ItemState(keys, order, material, stream.schema)
    return _tick(stream.groupBy(*keys).transformWithState(state, kinds, "Update", "None"), path, checkpoint)


def run_first(stream: DataFrame, path: str, checkpoint: str, keys: Sequence[str], order: Sequence[str]) -> StreamingQuery:
    """One tick of a ledger whose rows stay as they enter: each key's least row by ``order``, of which the first column
    tells the delivery, so that no later delivery replaces a row.  A null key is a key, and null comes first in the order.

    Without material fields, Spark's own streaming aggregate keeps the state, and no row goes through Python.
    """
    rest = [c for c in stream.columns if c not in (*keys, *order)]
    least = stream.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("_least"))
    return _tick(least.select(*keys, "_least.*"), path, checkpoint)


def run_problems(stream: DataFrame, path: str, checkpoint: str, quiet_days: float, late: str = "1 day") -> StreamingQuery:
    """One tick of the registry, from sightings (key, detail, seen TIMESTAMP).

    Sightings that come more than ``late`` behind the latest one of earlier ticks are ignored.
    """
    timed = stream.select("key", "detail", "seen").withWatermark("seen", late)
    kinds = "key string, detail string, first_seen timestamp, last_seen timestamp, status string"
    return _tick(timed.groupBy("key").transformWithState(ProblemState(round(quiet_days * 86_400_000)), kinds, "Update", "EventTime"), path, checkpoint)


def in_force(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """Each key's last row of what ticks wrote."""
    rows = spark.read.parquet(path)
    others = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch").alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in others])
