"""Deliveries of the streamed ingestion."""

import duckdb
import pytest
from pyspark.sql import functions as F

from vaultry.plans import change_queries, registry


@pytest.mark.parametrize("docs_of_file", [150, 10_000])
def test_a_delivery_is_several_files_and_one_micro_batch(spark, tmp_path, monkeypatch, docs_of_file):
    sf, work = tmp_path / "sf", tmp_path / "work"
    sf.mkdir()
    duckdb.sql("SELECT i AS doc_id, 'text ' || (i % 700) AS text FROM range(1000) r(i)").write_parquet(str(sf / "documents.parquet"))
    monkeypatch.setattr(change_queries, "_DOCS_OF_FILE", docs_of_file)
    monkeypatch.setattr(change_queries, "_work_folder", lambda _: str(work))
    got = {tuple(r) for r in change_queries.stream_ingest_deliveries(spark, str(sf)).collect()}
    files = 1000 // docs_of_file + 1
    for n in range(6):
        assert len(list((work / "in" / str(n)).glob("*.parquet"))) == files
    assert sorted(int(p.name) for p in (work / "checkpoint" / "commits").iterdir() if p.name.isdigit()) == list(range(6))
    sql = registry.ORACLES["stream_ingest_deliveries"].replace("FROM documents", f"FROM '{sf}/documents.parquet'")
    assert got == set(duckdb.sql(sql).fetchall())
