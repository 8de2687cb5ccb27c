"""The ledger over a stream: each key's first row is appended once, and restatements are ignored."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.ledger import first_write, matching
from tidemark.sources.scratch import cut

#: A batch of up to so many keys goes to where the ledger's files are; a larger one is joined by a shuffle.
BROADCAST_KEYS = 200_000


def append_new(spark: SparkSession, path: str, schema: str, keys: Sequence[str], order: Sequence[str]):
    """A ``foreachBatch`` function that appends a batch's new keys to the table at ``path``.

    A batch that is run again finds its keys in its own folder's place and replaces it, so it is applied once.  The ledger
    is read for its keys alone and, unless the batch is very large, not moved: of each file only keys of the batch are left.
    """

    def apply(batch: DataFrame, number: int) -> None:
        state = spark.read.schema(schema + ", batch bigint").option("basePath", path).parquet(path) if number else None
        new = cut(first_write(batch, keys, order))
        if state is not None:
            asked = new.select(*keys)
            asked = F.broadcast(asked) if asked.count() <= BROADCAST_KEYS else asked.hint("shuffle_hash")
            known = matching(state.where(F.col("batch") < number).select(*keys), asked, keys, "left_semi")
            new = matching(new, known, keys, "left_anti")
        new.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return apply


def run_ledger(stream: DataFrame, path: str, checkpoint: str, schema: str, keys: Sequence[str], order: Sequence[str]) -> StreamingQuery:
    """Append a stream's rows to the ledger at ``path``, with all that is there now, and then stop."""
    apply = append_new(stream.sparkSession, path, schema, keys, order)
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def distinct_stream(stream: DataFrame, keys: Sequence[str], time: str, delay: str) -> DataFrame:
    """The first row of each key within a watermark, by Spark's own state: for endless streams whose keys come again
    only within ``delay``."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys))
