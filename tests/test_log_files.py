"""Commits of the log that are interrupted, repeated and rivalled."""

import pytest
from pyspark.sql import functions as F

from vaultry.operators import ledger
from vaultry.sinks import commits, log_files


def lines(spark, *rows):
    return spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "n int, value string")


def files_of(spark, folder, version=None):
    return [r.file for r in log_files.read(spark, folder, version).orderBy("line_no").collect()]


def test_log_is_replaced_as_a_whole(spark, tmp_path, monkeypatch):
    folder, order = str(tmp_path / "log"), [F.col("n")]
    assert files_of(spark, folder) == []
    first = lines(spark, '{"file": "raw/a.md", "date": "2"}', "broken", '{"file": "raw/gone.md"}', '{"file": "raw/a.md", "date": "1", "pages_created": ["p"], "x": [1, {"é": null}]}')
    assert log_files.append(spark, folder, first, order, "one") == 1
    existing = spark.createDataFrame([("raw/a.md",), ("raw/b.md",)], "path string")

    def prune():
        return log_files.rewrite(spark, folder, lambda log: ledger.pruned_lines(log, existing), [F.col("line_no")], "prune")

    # the driver dies after staging and before publishing
    with monkeypatch.context() as m:
        m.setattr(commits, "publish", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            prune()
    assert files_of(spark, folder) == ["raw/a.md", None, "raw/gone.md", "raw/a.md"]
    assert prune() == 2 and prune() == 2
    row = log_files.read(spark, folder).first()
    assert (row.file, row.date, row.pages_created) == ("raw/a.md", "2", ["p"])
    assert log_files.append(spark, folder, lines(spark, '{"file": "raw/b.md"}'), order, "two") == 3
    assert files_of(spark, folder) == ["raw/a.md", "raw/b.md"]
    assert commits.at(spark, folder, 2)["backup"] == 1
    assert files_of(spark, folder, 1) == ["raw/a.md", None, "raw/gone.md", "raw/a.md"]
    log_files.restore(spark, folder, 1, "undo")
    assert len(files_of(spark, folder)) == 4


def test_rewrite_sees_what_a_rival_appended(spark, tmp_path):
    folder, order, seen = str(tmp_path / "log"), [F.col("n")], []
    log_files.append(spark, folder, lines(spark, '{"file": "a"}'), order, "one")

    def doubled(log):
        if not seen:
            log_files.append(spark, folder, lines(spark, '{"file": "b"}'), order, "rival")
        seen.append(1)
        return log.select(F.concat("file", F.lit("!")).alias("f"), "line_no").select("line_no", F.to_json(F.struct(F.col("f").alias("file"))).alias("value"))

    log_files.rewrite(spark, folder, doubled, [F.col("line_no")], "mark")
    assert files_of(spark, folder) == ["a!", "b!"] and len(seen) == 2
