"""What lands from outside: raw pages, laid-out documents, mail blocks and catalogs.

Nothing here fetches; a landing job writes ``RAW_PAGE`` rows (or files), and plans start from them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.sources.scratch import cut

RAW_PAGE = "source_id string, url string, fetched_at timestamp, body binary, error string"
#: The ends of so many listings are broadcast.
MOST_LISTINGS = 100_000
#: Characters of extracted texts that a task holds at a time, beside the document it reads.
TEXT_HELD = 4_000_000
MAIL = "sender string, subject string, count int, date string, snippet string"


def page_text(body: Column) -> Column:
    """Bytes as UTF-8, with U+FFFD for what isn't."""
    return F.make_valid_utf8(body.cast("string"))


def fetched(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pages with text, failures as (source_id, url, error)): one source's failure leaves the others alone."""
    good = pages.where(F.col("error").isNull()).withColumn("html", page_text(F.col("body"))).drop("body", "error")
    bad = pages.where(F.col("error").isNotNull()).select("source_id", "url", F.substring("error", 1, 200).alias("error"))
    return good, bad


class ExtractorUnavailable(RuntimeError):
    """No way to get text from a document is at hand."""


def _extracted(files: DataFrame, extractor: Callable[[bytes], str] | None) -> DataFrame:
    """(path, modified, length, text, error) of files (path, modificationTime, length, content)."""
    if extractor is None:
        raise ExtractorUnavailable("no extractor for laid-out documents was given")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begin, load, texts, errors = 0, 0, [], []
            for i, content in enumerate(batch.column(3)):
                try:
                    texts.append(extractor(content.as_py()))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001  a document's failure is a row, not the job's end
                    texts.append(None)
                    errors.append(f"{type(e).__name__}: {e}"[:200])
                load += len(texts[-1] or "")
                if load > TEXT_HELD or i == len(batch) - 1:
                    told = [c.slice(begin, i + 1 - begin) for c in batch.columns[:3]]
                    yield pa.RecordBatch.from_arrays([*told, pa.array(texts, pa.string()), pa.array(errors, pa.string())], ["path", "modified", "length", "text", "error"])
                    begin, load, texts, errors = i + 1, 0, [], []

    return files.select("path", "modificationTime", "length", "content").mapInArrow(run, "path string, modified timestamp, length long, text string, error string")


def extract_documents(spark: SparkSession, path: str, extractor: Callable[[bytes], str] | None, glob: str = "*.pdf") -> DataFrame:
    """(path, text, error) of laid-out documents under a path, by a pluggable ``extractor`` of one document's bytes.

    One document is one unit of work; one that fails has its error and null text.  Files of no bytes have no rows, as
    Spark's reader leaves them out.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    return _extracted(files, extractor).select("path", "text", "error")


def read_new_documents(spark: SparkSession, path: str, extractor: Callable[[bytes], str] | None, ledger: str, checkpoint: str, glob: str = "*.pdf", files_a_batch: int = 10_000) -> StreamingQuery:
    """Extract the documents that landed since the last call into the ledger table at ``ledger``, and stop.

    The ledger has a row for each file (path, modified, length, text, error, batch): what was read, when it was written and
    with what result.  The checkpoint knows the files of earlier calls, so these are neither opened nor extracted again; a
    document that failed stays in the ledger with its error.  A batch that is run again replaces its own folder.
    """
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("pathGlobFilter", glob).option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_a_batch).load(path)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{ledger}/batch={number}")

    return _extracted(files, extractor).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def variant_rows(rows: DataFrame, value: Column, path: str, *keep: str, key: str = "key", item: str = "item") -> DataFrame:
    """``keep``, ``pos``, ``key`` and ``item``: a row for each member of the object or the array at ``path`` in a VARIANT.

    An array's members have no key.  Where there is nothing at the path, or something else, there are no rows.
    """
    spark = rows.sparkSession
    whole = rows.withColumn("_v", F.try_variant_get(value, path, "variant"))
    members = spark.tvf.variant_explode(F.col("_v").outer()).select(F.col("pos"), F.col("key").alias(key), F.col("value").alias(item))
    return whole.lateralJoin(members).select(*keep, "pos", key, item)


def catalog(documents: DataFrame, body: str = "body") -> DataFrame:
    """(state, name, agency, award, url, kind, note, search_terms, unverified, more): a row for each source of nested catalogs.

    Catalogs are JSON texts, ``{"states": {<state>: {..., "sources": [{...}]}}}``.  They are read as VARIANT, so no schema
    is stated: fields that a source lacks are null, a field of another type than expected is null, ``unverified`` is false
    unless it is true, and ``more`` is the whole source, with whatever else it tells.  Texts that are no JSON, states
    without sources and sources that are no objects give no rows.
    """
    whole = documents.select(F.try_parse_json(F.col(body)).alias("v")).where("v is not null")
    states = variant_rows(whole, F.col("v"), "$.states", key="state", item="s").drop("pos")
    of_state = lambda name: F.try_variant_get("s", f"$.{name}", "string")
    rows = states.select("state", "s", of_state("name").alias("name"), of_state("agency").alias("agency"), of_state("fy2026_award").alias("award"))
    sources = variant_rows(rows, F.col("s"), "$.sources", "state", "name", "agency", "award", item="more").drop("key")
    of_source = lambda name, kind="string": F.try_variant_get("more", f"$.{name}", kind).alias(name)
    told = sources.where(F.schema_of_variant("more").startswith("OBJECT"))
    return told.select("state", "name", "agency", "award", *map(of_source, ("url", "kind", "note")), of_source("search_terms", "array<string>"), F.coalesce(of_source("unverified", "boolean"), F.lit(False)).alias("unverified"), "more")


def catalog_files(spark: SparkSession, path: str) -> DataFrame:
    """Catalog files, one text each, for :func:`catalog`."""
    return spark.read.text(path, wholetext=True).withColumnRenamed("value", "body")


def mail_items(blocks: DataFrame, text: str = "text") -> DataFrame:
    """Mail blocks to (sender, subject, count, date, snippet).

    Lines are trimmed and blank ones left out: sender, subject, perhaps a "(n)" count (else 1), date, and then the
    snippet, of up to 240 characters.
    """
    lines = F.filter(F.transform(F.split(F.col(text), "\n", -1), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "")
    rows = blocks.select(lines.alias("l"))
    at = lambda i: F.coalesce(F.get("l", i), F.lit(""))
    counted = at(F.lit(2)).rlike(r"^\(\d+\)$")
    date = F.when(counted, 3).otherwise(2)
    rest = F.slice("l", date + 2, F.greatest(F.size("l") - date - 1, F.lit(0)))
    return rows.where(F.size("l") > 0).select(
        at(F.lit(0)).alias("sender"),
        at(F.lit(1)).alias("subject"),
        F.when(counted, F.expr("try_cast(regexp_extract(get(l, 2), '(\\\\d+)', 1) as int)")).otherwise(1).alias("count"),
        at(date).alias("date"),
        F.substring(F.array_join(rest, " "), 1, 240).alias("snippet"),
    )


def reference_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Reference data with a header and a stated schema."""
    return spark.read.schema(schema).option("header", True).csv(path)


def pages_until_empty(pages: DataFrame, rows: DataFrame, limit: int, page: str = "page") -> DataFrame:
    """Rows of a paged listing: at most ``limit`` pages (one at least), and none from the first page without rows on."""
    counts = pages.select(page).distinct().join(rows.groupBy(page).agg(F.count(F.lit(1)).alias("n")), page, "left")
    end = counts.where(F.col("n").isNull()).agg(F.min(page)).first()[0]
    last = max(1, limit) if end is None else min(end, max(1, limit))
    return rows.where(F.col(page) < last)


def listings_until_empty(rows: DataFrame, listing: str, page: str = "page", most: str = "most") -> DataFrame:
    """Rows of many paged listings at once, by :func:`pages_until_empty`'s rule for each: pages count from 0, ``most`` (the
    least that a listing's rows state; null or under one: one page) limits them, and none comes from the first page
    without rows on.  A null listing is a listing; rows without a page are on none; repeated rows stay.

    Only distinct pages below the limit are put in order, so no window is longer than a listing's limit.
    """
    if {listing, page, most} & {"_listing", "_most", "_end"}:
        raise ValueError("a column's name is taken")
    limits = rows.groupBy(F.col(listing).alias("_listing")).agg(F.greatest(F.coalesce(F.min(most), F.lit(1)), F.lit(1)).alias("_most"))
    seen = rows.where(F.col(page) >= 0).select(F.col(listing).alias("_listing"), F.col(page).alias("_page")).distinct()
    seen = seen.alias("s").join(limits.alias("m"), F.col("s._listing").eqNullSafe(F.col("m._listing")) & (F.col("_page") < F.col("_most"))).select("s._listing", "_page")
    # Without a gap before it, a page's number is its place.
    place = F.row_number().over(Window.partitionBy("_listing").orderBy("_page")) - 1
    ends = cut(seen.withColumn("_place", place).where("_place = _page").groupBy("_listing").agg(F.max("_page").alias("_end")))
    small = F.broadcast(ends) if ends.count() <= MOST_LISTINGS else ends
    return rows.join(small, F.col(listing).eqNullSafe(F.col("_listing")) & F.col(page).between(0, F.col("_end")), "left_semi")


def readers(table: dict[str, Callable[[], DataFrame]], wanted: Sequence[str]) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """(rows by key, failures by key): unknown keys and readers that fail end up among the failures, in 200 characters."""
    rows, failed = {}, {}
    for key in wanted:
        try:
            if key not in table:
                raise KeyError(f"no reader for {key}")
            found = table[key]()
            if found.isEmpty():
                raise ValueError("no rows parsed")
            rows[key] = found
        except Exception as e:  # noqa: BLE001  one source's failure leaves the others alone
            failed[key] = str(e)[:200]
    return rows, failed
