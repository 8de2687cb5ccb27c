from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import filings
from tidemark.plans import queries
from tidemark.sources import landing
from tidemark.streaming import keyed_state

SF = "/root/testdata/sf0.001"


def test_a_ledger_without_material_fields_keeps_what_came_first(spark, tmp_path):
    def tick(k, rows):
        spark.createDataFrame([(*r, k) for r in rows], "user long, n int, e long, delivery int").coalesce(1).write.mode("append").parquet(f"{tmp_path}/landed")
        stream = spark.readStream.schema("user long, n int, e long, delivery int").parquet(f"{tmp_path}/landed")
        keyed_state.run_first(stream, f"{tmp_path}/out", f"{tmp_path}/state", ["user"], ["delivery", "n"]).awaitTermination()

    tick(0, [(1, 5, 10), (1, 4, 11), (None, 9, 12)])
    tick(1, [(1, 1, 13), (2, 3, 14), (2, None, 15), (None, 1, 16)])
    assert {r.user: r.e for r in keyed_state.in_force(spark, f"{tmp_path}/out", ["user"]).collect()} == {1: 11, None: 12, 2: 15}


def test_document_files_do_not_grow_with_the_table(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(queries, "DOCUMENTS_A_FILE", 7)
    monkeypatch.setattr(queries, "new_folder", lambda spark, kind: f"file://{tmp_path}/{kind}")
    got = queries.document_folder(spark, SF)
    assert got.count() == queries.table(spark, SF, "documents").count()
    assert max(len(x.read_text().splitlines()) for x in (tmp_path / "folder" / "files").glob("*.txt")) <= 7


def test_long_texts_are_handed_on_before_the_batch_ends(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(landing, "TEXT_HELD", 10)
    for i in range(20):
        (tmp_path / f"{i}.pdf").write_bytes(b"x" * (i + 1))

    def extractor(content):
        return content.decode() if len(content) != 5 else 1 / 0

    got = landing.extract_documents(spark, str(tmp_path), extractor).collect()
    assert sorted(len(r.text) for r in got if r.error is None) == [n for n in range(1, 21) if n != 5]
    assert [r.error for r in got if r.text is None] == ["ZeroDivisionError: division by zero"]


def test_cells_that_nobody_reads_are_not_cleaned(spark):
    pages = spark.createDataFrame([(1, "<tr data-ri='0'></tr>")], "page long, html string")
    plan = lambda *c: filings.portal_rows(pages).select(*c)._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace")
    assert plan("page") == 0 < plan("page", "state") < plan("page", "state", "entity")


def test_lines_and_pages_are_dealt_by_their_number(spark, monkeypatch):
    for name, rows, query in (("KEYS_A_TASK", "lineitem", queries.conflict_keys), ("PAGES_A_TASK", "orders", queries.portal_cells)):
        monkeypatch.setattr(queries, name, 100)
        n = queries.table(spark, SF, rows).count()
        assert n > 100 and query(spark, SF).rdd.getNumPartitions() == -(-n // 100)
