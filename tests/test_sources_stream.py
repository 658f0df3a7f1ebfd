from datetime import date, datetime
import json

from trendspark.sources import coverage, records
from trendspark.streaming.daily import daily_counts, upsert_days


def gaps(spark, a, b, start=date(2024, 1, 1), end=date(2024, 3, 31), as_of=date(2024, 6, 1)):
    c = spark.createDataFrame([("s", a, b)], "series_id string, covered_from date, covered_to date")
    return sorted((r["gap_from"].isoformat()[5:], r["gap_to"].isoformat()[5:]) for r in coverage.gaps(c, start, end, as_of).collect())


def test_gaps(spark):
    assert gaps(spark, None, None) == [("01-01", "03-31")]
    assert gaps(spark, date(2023, 1, 1), date(2024, 5, 1)) == []
    assert gaps(spark, date(2024, 2, 1), date(2024, 5, 1)) == [("01-01", "01-31")]
    assert gaps(spark, date(2024, 2, 1), date(2024, 2, 10)) == [("01-01", "01-31"), ("02-11", "03-31")]
    assert gaps(spark, date(2023, 1, 1), date(2024, 3, 31), as_of=date(2024, 4, 1)) == [("03-30", "03-31")]


def test_cache_roundtrip(spark, tmp_path):
    schema = "series_id string, day date, v bigint"
    old = spark.createDataFrame([("s", date(2024, 1, 1), 1), ("s", date(2024, 2, 1), 2)], schema)
    coverage.save_points(old, str(tmp_path / "c"))
    new = coverage.merged(old, spark.createDataFrame([("s", date(2024, 2, 1), 5), ("t", date(2024, 2, 2), 6)], schema))
    coverage.save_points(new, str(tmp_path / "c"))
    got = {(r["series_id"], r["day"].isoformat(), r["v"]) for r in spark.read.parquet(str(tmp_path / "c")).collect()}
    assert got == {("s", "2024-01-01", 1), ("s", "2024-02-01", 5), ("t", "2024-02-02", 6)}


def test_replies_and_events(spark, tmp_path):
    (tmp_path / "0123456789abcdef.json").write_text(json.dumps({"items": [{"timestamp": "2024010100", "views": 7}, {"timestamp": "2024010200"}]}))
    (tmp_path / "fedcba9876543210.json").write_text('{"__wt_no_data":true}')
    rows = records.view_items(records.recorded_replies(spark, str(tmp_path))).collect()
    assert sorted((r["url_key"], r["d"], r["v"]) for r in rows) == [("0123456789abcdef", "2024010100", 7), ("0123456789abcdef", "2024010200", None)]
    lines = [json.dumps({"type": "assistant", "message": {"content": [{"type": "text", "text": "hi"}, {"type": "tool_use", "name": "Bash", "input": {"command": "wt doctor"}}]}}), "broken", json.dumps({"type": "result", "result": "done"})]
    steps = records.transcript_steps(spark.createDataFrame([("a", k, x) for k, x in enumerate(lines)], "id string, ord int, line string"), "id", "line").orderBy("ord").collect()
    assert [(s["kind"], s["text"]) for s in steps] == [("text", "hi"), ("tool_use", "wt doctor"), ("answer", "done")]


def test_stream_equals_batch_on_closed_days(spark, tmp_path):
    schema = "event_type string, ts timestamp"
    for k, day in enumerate((1, 2, 2, 4, 9)):
        spark.createDataFrame([("a", datetime(2024, 1, day, 5)), ("b", datetime(2024, 1, day, 23)), (None, datetime(2024, 1, day))], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    upsert_days(daily_counts(stream, "event_type"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    key = lambda df: {(r["event_type"], str(r["day"]), r["views"]) for r in df.collect()}
    batch, got = key(daily_counts(spark.read.parquet(str(tmp_path / "in")), "event_type")), key(spark.read.parquet(str(tmp_path / "out")))
    assert got <= batch and {x for x in batch if x[1] <= "2024-01-04"} <= got
