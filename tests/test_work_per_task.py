"""How much one task or one row gets, whatever the files' layout."""

import datetime as dt
import json

from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

from veilwork import fixtures as fx
from veilwork.plans.queries import QUERIES
from veilwork.sources import writers
from veilwork.streaming.intake import run_intake, stream_files


def test_notes_are_dealt_by_rows(spark, tmp_path, monkeypatch):
    day = dt.datetime(2020, 1, 1)
    n = 20_000
    tables = {
        "orders": (spark.range(n).selectExpr("id as o_orderkey", "id % 3 as o_custkey").withColumn("o_orderdate", F.lit(day)), 1),
        "customer": (spark.range(3).selectExpr("id as c_custkey", "'name ' || id as c_name", "0 as c_nationkey"), 1),
        "nation": (spark.range(1).selectExpr("cast(id as int) as n_nationkey", "'X' as n_name"), 1),
    }
    for name, (frame, files) in tables.items():
        frame.coalesce(files).write.parquet(str(tmp_path / f"{name}.parquet"))
    monkeypatch.setattr(fx, "ROWS_PER_TASK", 500)
    notes = fx.note_docs(spark, str(tmp_path))
    sizes = [r["count"] for r in notes.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == n and max(sizes) < 550


def test_files_read_whole_grow_in_number(spark, tmp_path, monkeypatch):
    docs = spark.range(6000).selectExpr("id as doc_id", "'mail a' || id || '@b.example.org now' as text")
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(writers, "scratch_path", lambda _, name: str(tmp_path / f"kept-{name}"))
    total = QUERIES["streamed_intake"](spark, str(tmp_path)).first()
    assert (total["status"], total["entities"]) == (1, 6000)
    files = list(tmp_path.glob("kept-intake/in/part-*"))
    assert max(len(f.read_text().splitlines()) for f in files) <= 500


def test_intake_keeps_no_text_it_took_in(spark, tmp_path, monkeypatch):
    kept = []
    monkeypatch.setattr(DataFrame, "persist", lambda self, *a: kept.append(self.columns) or self)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("mail a@b.example.org")
    (tmp_path / "in" / "b.txt").write_text("nothing")
    run_intake(stream_files(spark, str(tmp_path / "in"), True), str(tmp_path / "out"), str(tmp_path / "state"), "salt", ["EMAIL"])
    assert kept == [["path", "deidentified", "chunks"]]
    answers = spark.read.parquet(str(tmp_path / "out" / "summary")).collect()
    assert sorted(json.loads(r["summary"])["numberOfDeidEntities"] for r in answers) == [0, 1]
