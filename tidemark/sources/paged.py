"""Landed listings, page by page: a data source that prunes pages before it opens any.

A landing job writes each page of a listing under ``<path>/page=<n>/`` as Parquet files, and no files for a page without
rows, as Spark's ``partitionBy("page")`` does.  The listing ends at the first page that has none.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

PAGE = "page int, source_id string, url string, html string"
_PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


@dataclass
class Pages(InputPartition):
    """Consecutive pages, read one after the other by one task."""

    first: int
    last: int


class PagedReader(DataSourceReader):
    def __init__(self, options: dict[str, str], columns: list[str]):
        self.path, self.columns = options["path"].rstrip("/"), columns
        self.limit, self.a_task = int(options.get("limit", 2**31 - 1)), int(options.get("pagespertask", 16))
        self.low, self.high = 0, 2**31 - 1

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Bounds on the page are kept here; all other filters stay with Spark."""
        for f in filters:
            match f:
                case EqualTo(("page",), int(n)):
                    self.low, self.high = max(self.low, n), min(self.high, n)
                case GreaterThan(("page",), int(n)):
                    self.low = max(self.low, n + 1)
                case GreaterThanOrEqual(("page",), int(n)):
                    self.low = max(self.low, n)
                case LessThan(("page",), int(n)):
                    self.high = min(self.high, n - 1)
                case LessThanOrEqual(("page",), int(n)):
                    self.high = min(self.high, n)
                case _:
                    yield f

    def _folder(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path)

    def partitions(self) -> list[Pages]:
        """Folders are listed, and no file is opened: pages from 0 on, up to the limit (one at least) and to the first
        that is missing, cut down to those that filters ask for."""
        from pyarrow import fs

        store, path = self._folder()
        found = store.get_file_info(fs.FileSelector(path, allow_not_found=True))
        have = {int(x.base_name.removeprefix("page=")) for x in found if x.type == fs.FileType.Directory and x.base_name.removeprefix("page=").isdigit()}
        end = next(n for n in range(len(have) + 1) if n not in have)
        first, last = self.low, min(end, max(1, self.limit), self.high + 1) - 1
        return [Pages(n, min(n + self.a_task - 1, last)) for n in range(first, last + 1, self.a_task)] or [Pages(0, -1)]

    def read(self, partition: Pages) -> Iterator:
        import pyarrow as pa
        import pyarrow.parquet as pq
        from pyarrow import fs

        store, path = self._folder()
        for n in range(partition.first, partition.last + 1):
            for file in sorted(x.path for x in store.get_file_info(fs.FileSelector(f"{path}/page={n}")) if x.path.endswith(".parquet")):
                with store.open_input_file(file) as stream:
                    for batch in pq.ParquetFile(stream).iter_batches(2000, columns=[c for c in self.columns if c != "page"]):
                        yield pa.RecordBatch.from_arrays([pa.array([n] * len(batch), pa.int32()) if c == "page" else batch.column(c) for c in self.columns], self.columns)


class PagedSource(DataSource):
    """``spark.read.format("landed_pages")`` with options ``path``, ``limit`` (pages) and ``pagesPerTask``."""

    @classmethod
    def name(cls) -> str:
        return "landed_pages"

    def schema(self) -> str:
        return PAGE

    def reader(self, schema) -> PagedReader:
        return PagedReader({k.lower(): v for k, v in self.options.items()}, schema.fieldNames())


def listing(spark: SparkSession, path: str, limit: int | None = None, pages_per_task: int = 16) -> DataFrame:
    """(page, source_id, url, html) of a landed listing.  Comparisons of ``page`` with numbers reach the source, so other
    pages' files are not opened."""
    spark.conf.set(_PUSHDOWN, "true")
    spark.dataSource.register(PagedSource)
    reader = spark.read.format("landed_pages").option("path", path).option("pagesPerTask", pages_per_task)
    return (reader if limit is None else reader.option("limit", limit)).load()
