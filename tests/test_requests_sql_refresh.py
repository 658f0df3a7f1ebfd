from collections import Counter
from datetime import date, datetime
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
import json
from pathlib import Path
import threading

import pytest
from pyspark.sql import functions as F

from trendspark.functions import sql, text
from trendspark.operators import scoring
from trendspark.session import observed
from trendspark.sources import coverage, records, requests
from trendspark.streaming.daily import daily_counts, rolling_totals


@pytest.fixture
def server():
    """Replies by path, and how often each was asked for."""
    seen = Counter()

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            seen[self.path] += 1
            status = {"/ok": 200, "/none": 404, "/no": 403, "/odd": 418, "/broken": 200, "/down": 503, "/later": 200 if seen["/later"] > 2 else 429}[self.path]
            body = b"<html>" if self.path == "/broken" else json.dumps({"path": self.path}).encode()
            self.send_response(status)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    s = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}", seen
    s.shutdown()


def test_requests(spark, server, tmp_path):
    base, seen = server
    urls = [f"{base}{p}" for p in ("/ok", "/none", "/no", "/odd", "/broken", "/down", "/later")] + ["http://127.0.0.1:1/x", None]
    df = spark.createDataFrame([(u, "x") for u in urls * 2], "url string, body string")
    kept = str(tmp_path / "kept")
    got = spark.createDataFrame(requests.fetch_json(df, "tests", kept=kept, retries=2, pause=0.01, timeout=5.0).collect(), requests.REPLY)
    by = {r["url"].split("/")[-1]: (r["http_status"], r["error"], r["tries"]) for r in got.collect()}
    assert by == {"ok": (200, None, 1), "none": (404, None, 1), "no": (403, "forbidden", 1), "odd": (418, "http", 1), "broken": (200, "bad_json", 1), "down": (503, "upstream", 3), "later": (200, None, 3), "x": (None, "network", 3)}
    assert seen["/ok"] == 1 and seen["/down"] == 3
    requests.keep_replies(got, kept)
    again = {r["url"].split("/")[-1]: r["tries"] for r in requests.fetch_json(df, "tests", kept=kept, retries=0, pause=0.01).collect()}
    assert (again["ok"], again["none"], again["later"]) == (0, 0, 0) and again["no"] == 1 and seen["/ok"] == 1
    with pytest.raises(ValueError, match="missing_contact"):
        requests.fetch_json(df, " ")


def test_data_source(spark, server):
    base, _ = server
    requests.register(spark)
    load = lambda urls: spark.read.format("json_requests").option("urls", json.dumps(urls)).option("contact", "tests").option("requests_a_task", 1).load()
    assert {(r["url"][-3:], r["http_status"], r["error"]) for r in load([f"{base}/ok", f"{base}/no"]).collect()} == {("/ok", 200, None), ("/no", 403, "forbidden")}
    assert load([]).count() == 0


def test_incremental_load(spark, tmp_path):
    path = str(tmp_path / "cache")
    series = spark.createDataFrame([("a",), ("b",), ("bad",), (None,)], "series_id string")
    asked = []

    def load(gaps):
        asked.append(sorted((r["series_id"], r["gap_from"], r["gap_to"]) for r in gaps.collect()))
        days = gaps.where("series_id <> 'bad'").select("series_id", F.explode(F.sequence("gap_from", "gap_to")).alias("day"))
        good = days.select("series_id", "day", F.dayofmonth("day").cast("bigint").alias("v"), F.lit(None).cast("string").alias("error"))
        return good.unionByName(gaps.where("series_id = 'bad'").select("series_id", F.lit(None).cast("date").alias("day"), F.lit(None).cast("bigint").alias("v"), F.lit("upstream").alias("error")))

    def rows(start, end, as_of):
        return coverage.refresh(spark, path, series, start, end, as_of, load).collect()

    one = rows(date(2025, 1, 20), date(2025, 2, 5), date(2025, 4, 1))
    assert Counter(r["series_id"] for r in one) == {"a": 17, "b": 17, "bad": 1} and {r["error"] for r in one if r["series_id"] == "bad"} == {"upstream"}
    rows(date(2025, 1, 20), date(2025, 2, 5), date(2025, 4, 1))
    assert asked[1] == [("bad", date(2025, 1, 20), date(2025, 2, 5))]  # of the others nothing is missing
    three = rows(date(2025, 1, 10), date(2025, 3, 1), date(2025, 4, 1))
    assert ("a", date(2025, 1, 10), date(2025, 1, 19)) in asked[2] and ("a", date(2025, 2, 6), date(2025, 3, 1)) in asked[2]
    a = sorted((r["day"], r["v"]) for r in three if r["series_id"] == "a")
    assert len(a) == 51 and all(d.day == v for d, v in a)
    assert coverage.stored_bytes(spark, path) > 0 and coverage.stored_bytes(spark, path + "x") == 0
    early = rows(date(2014, 1, 1), date(2014, 2, 1), date(2025, 4, 1))  # before the first day with counts there is nothing to ask for
    assert {r["series_id"] for r in early} <= {"bad"} and len(asked) == 3


def test_sql_functions(spark):
    assert set(sql.register(spark)) >= {"bare_title", "spark_line", "sentences_of"}
    row = spark.sql("SELECT bare_title('Java (island)') a, edition_of(' EN.wikipedia.org ') b, percent_change(4, 5) c, per_million(1, 0) d, array_middle(array(5D, 1D, 3D, 4D)) e, spark_line(array(0D, NULL, 7D)) f").first()
    assert tuple(row) == ("Java", "en.wikipedia", 25.0, None, 3.5, "▁ █")
    t = "One. Two: three\n- four"
    want = spark.createDataFrame([(t,)], "t string").select(text.sentences(F.col("t"))).first()[0]
    got = spark.sql("SELECT s.sentence FROM VALUES (:t) AS v(t), LATERAL sentences_of(v.t) AS s ORDER BY s.position", args={"t": t}).collect()
    assert [r[0] for r in got] == want == ["One.", "Two:", "three", "- four"]


def test_rolling_totals_of_a_stream(spark, tmp_path):
    src, out = tmp_path / "src", str(tmp_path / "out")
    src.mkdir()
    rows = [("k", datetime(2025, 1, d, 5), n) for d, n in ((1, 2), (2, 1), (5, 3), (9, 1), (20, 1))] + [("j", datetime(2025, 1, 3, 5), 1)]
    events = [(k, ts) for k, ts, n in rows for _ in range(n)]
    days = daily_counts(spark.createDataFrame(events, "event_type string, ts timestamp"), "event_type")
    days.coalesce(1).write.mode("overwrite").parquet(str(src))
    q = rolling_totals(spark.readStream.schema(days.schema).parquet(str(src)), "event_type", 7).writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r["event_type"], r["day"].day): (r["views"], r["total"], r["complete"]) for r in spark.read.parquet(out).collect()}
    assert got[("k", 1)] == (2, 2, True) and got[("k", 5)] == (3, 6, True) and got[("k", 9)] == (1, 4, True) and got[("j", 3)] == (1, 1, True)


def test_runs_and_scores(spark, tmp_path):
    df = spark.createDataFrame([("s", "en", 1)], "series_id string, lang string, x int")
    run = str(tmp_path / "run")
    records.write_run({"results": df}, run, {"topic": "gold"}, {"since": "2y"})
    assert records.read_run(spark, run)["monthly"].count() == 0 and records.read_told(spark, run, "analysis") == {"topic": "gold"} and records.read_told(spark, run, "none") is None
    records.write_scores(spark.createDataFrame([("a", True), ("b", False)], "scenario string, pass boolean"), "m", str(tmp_path / "scores"))
    told = json.loads(next(Path(tmp_path / "scores").glob("*.json")).read_text())
    assert (told["model"], told["passed"], told["total"], len(told["results"])) == ("m", 1, 2, 2)
    assert records.run_id(datetime(2025, 1, 2, 3, 4)).startswith("r_20250102T0304_")


def test_observed_and_allowed(spark):
    df, seen = observed(spark.range(7), "seen", top=F.max("id"))
    df.write.format("noop").mode("overwrite").save()
    assert seen.get == {"rows": 7, "top": 6}
    c = ["node x.mjs views gold --langs en", "wt doctor", "wt views gold; rm -rf /", "wt fly", "cat x | wt views gold", "wt check $(cat x)"]
    assert spark.createDataFrame([(c,)], "c array<string>").select(scoring.allowed(F.col("c"))).first()[0] == c[:2]
