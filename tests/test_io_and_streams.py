import datetime as dt
import json
from pathlib import Path

import pytest
from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from veilwork.operators.catalog import CONTEXT_RULES
from veilwork.operators.pipeline import StepTransformer, compose
from veilwork.operators.stats import chunk_totals, file_statistics, summary_records
from veilwork.operators.tagging import tag_tokens, tags_to_chunks, token_table
from veilwork.sources import readers, writers
from veilwork.streaming.intake import run_intake, stream_files, windowed_counts


def test_rules_round_trip(spark, tmp_path):
    readers.write_rules(spark, CONTEXT_RULES, str(tmp_path / "rules"))
    back = readers.read_rules(spark, str(tmp_path / "rules"))
    assert back == tuple(sorted(CONTEXT_RULES, key=lambda r: r.entity))


def test_one_pretty_printed_rule(spark, tmp_path):
    record = {"entity": "X", "ruleScope": "sentence", "regex": "1", "matchScope": "token", "prefix": ["a"], "contextLength": 4}
    (tmp_path / "x.json").write_text(json.dumps(record, indent=2))
    (rule,) = readers.read_rules(spark, str(tmp_path / "x.json"), multi_line=True)
    assert (rule.entity, rule.prefix, rule.suffix, rule.context_length) == ("X", ("a",), (), 4)


def test_policy_round_trip(spark, tmp_path):
    readers.write_policy(spark, {"SSN": "skip"}, str(tmp_path / "p"))
    assert readers.read_policy(spark, str(tmp_path / "p")) == {"SSN": "skip"}


def test_text_lines_and_whole_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\n\ntwo\n")
    assert [r.text for r in readers.read_text(spark, str(tmp_path)).collect()] == ["one", "", "two"]
    assert [r.text for r in readers.read_text(spark, str(tmp_path), whole_file=True).collect()] == ["one\n\ntwo\n"]
    assert readers.with_line_ids(readers.read_text(spark, str(tmp_path))).select("doc_id").distinct().count() == 3


def test_seed_frame_fits_a_pipeline(spark):
    seed = readers.seed_frame(spark)
    assert [r.text for r in seed.collect()] == [""]
    model = Pipeline(stages=[StepTransformer(lambda d: d.withColumn("n", F.length("text")))]).fit(seed)
    assert [r.n for r in model.transform(spark.createDataFrame([("abc",)], "text string")).collect()] == [3]


def test_compose_nests(spark):
    step = lambda d: d.withColumn("id", F.col("id") + 1)
    assert [r.id for r in compose(step, [step, [step]])(spark.range(1)).collect()] == [3]


def test_asset_lookup(spark, tmp_path):
    base = str(tmp_path)
    words = spark.createDataFrame([("CITY", "Rome")], "entity string, phrase string")
    for name in ("small_city", "large_city", "names"):
        words.write.parquet(f"{base}/{name}")
    assert readers.read_dictionary(spark, base, "names").count() == 1
    for target in ("city", "absent"):
        with pytest.raises(ValueError):
            readers.find_asset(spark, base, target)


def test_one_folder_per_path(spark, tmp_path):
    frame = spark.createDataFrame([("/in/a.img", 1), ("/in/b.img", 2), ("/other/a.img", 3)], "path string, v int")
    writers.write_per_file(frame, str(tmp_path / "out"))
    folders = [p.name for p in Path(tmp_path / "out").iterdir() if p.is_dir()]
    assert len(folders) == 3 and all(f.startswith("path_key=") for f in folders)


def test_summary(spark):
    frame = spark.createDataFrame(
        [("a", ["xy", "z"]), ("a", []), ("b", ["q"])], "path string, c array<string>"
    ).select("path", F.transform("c", lambda c: F.struct(c.alias("chunk"))).alias("chunks"))
    got = {r.path: json.loads(r.summary) for r in summary_records(file_statistics(frame)).collect()}
    assert got["a"] == {"status": 1, "numberOfPages": 2, "numberOfDeidEntities": 2, "numberOfChars": 3}
    empty = chunk_totals(spark.createDataFrame([], "chunk string")).collect()[0]
    assert (empty.entities, empty.characters) == (0, 0)


def test_tags_with_strays_and_label_change(spark):
    tags = ["B-A", "I-A", "O", "I-A", "I-B", "B-B", "I-B", "O"]
    rows = [(1, 0, i, i * 2, i * 2 + 1, str(i), t) for i, t in enumerate(tags)]
    frame = spark.createDataFrame(rows, "doc_id int, sent_id int, token_id int, begin int, end int, token string, tag string")
    got = sorted((r.begin, r.end, r.chunk, r.entity) for r in tags_to_chunks(frame).collect())
    assert got == [(0, 3, "0 1", "A"), (6, 7, "3", "A"), (8, 9, "4", "B"), (10, 13, "5 6", "B")]


def test_user_model(spark):
    toks = token_table(spark.createDataFrame([(1, "Ann met Bob.")], "doc_id int, text string"))
    tagged = tag_tokens(toks, lambda b: ["b-name" if t[0].isupper() else "o" for t in b["token"]])
    got = sorted((r.chunk, r.entity) for r in tags_to_chunks(tagged).collect())
    assert got == [("Ann", "NAME"), ("Bob", "NAME")]


@pytest.mark.parametrize("binary", [False, True])
def test_intake_takes_each_file_once(spark, tmp_path, binary):
    inbox, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    inbox.mkdir()
    (inbox / "a.txt").write_text("SSN 123-45-6789")
    run = lambda: run_intake(
        stream_files(spark, str(inbox), binary), out, state, "s", ["SSN"], {"SSN": "mask_label"}
    )
    run()
    (inbox / "b.txt").write_text("nothing")
    run()
    run()
    texts = spark.read.parquet(f"{out}/text").collect()
    assert sorted(r.deidentified for r in texts) == ["SSN <SSN>", "nothing"]
    assert spark.read.parquet(f"{out}/summary").count() == 2


def test_late_rows_are_dropped(spark, tmp_path):
    base = tmp_path / "in"
    day = dt.datetime(2024, 1, 1)

    def add(name, *hours):
        rows = [(day + dt.timedelta(hours=h), "X") for h in hours]
        spark.createDataFrame(rows, "ts timestamp, entity string").coalesce(1).write.parquet(str(base / name))

    def run():
        stream = spark.readStream.schema("ts timestamp, entity string").parquet(f"{base}/*")
        (
            windowed_counts(stream).writeStream.format("parquet").option("path", str(tmp_path / "out"))
            .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
        )

    add("a", 1, 2, 60)
    run()
    add("b", 3, 61)  # the first day is closed by now
    run()
    add("c", 140)
    run()
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("window_start").collect()
    assert [(r.window_start, r["count"]) for r in got] == [(day, 2), (day + dt.timedelta(days=2), 2)]
