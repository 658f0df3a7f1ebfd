"""Readers and writers of recorded replies, corpora, transcripts and finished runs."""

from __future__ import annotations

from datetime import datetime
import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .tables import exists

RUN_TABLES = ("results", "monthly", "daily")


def request_key(url: Column) -> Column:
    """The 16 hex digits by which a recorded reply is filed."""
    return F.substring(F.sha1(url), 1, 16)


def recorded_replies(spark: SparkSession, path: str) -> DataFrame:
    """``(url_key, body)`` of a folder of recorded replies, one JSON file each."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("f"), F.col("value").alias("body"))
    return files.select(F.regexp_extract("f", r"([0-9a-f]{16})\.json$", 1).alias("url_key"), "body")


def view_items(replies: DataFrame, body: str = "body") -> DataFrame:
    """``(url_key, d, v)`` of page-view replies; the no-data marker and replies without items give no rows."""
    items = F.from_json(body, "items ARRAY<STRUCT<timestamp: STRING, views: BIGINT>>")["items"]
    return replies.select("url_key", F.explode(items).alias("i")).select("url_key", F.col("i.timestamp").alias("d"), F.col("i.views").alias("v"))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A corpus of one JSON object a line; lines that do not parse are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


EVENT = "type STRING, message STRUCT<content: ARRAY<STRUCT<type: STRING, text: STRING, name: STRING, input: STRUCT<command: STRING>, content: STRING>>>, result STRING, total_cost_usd DOUBLE, num_turns INT"


def transcript_steps(events: DataFrame, key: str, line: str) -> DataFrame:
    """``(<key>, ord, kind, text)`` of an agent's event stream, one JSON event a line: what was said, which commands ran, the final
    answer. Lines that are no event are skipped. ``events`` has ``<key>``, ``ord`` and the line."""
    e = F.from_json(line, EVENT)
    rows = events.select(key, "ord", e.alias("e")).where("e.type is not null")
    part = F.transform(
        F.coalesce("e.message.content", F.array().cast("array<struct<type:string,text:string,name:string,input:struct<command:string>,content:string>>")),
        lambda c: F.struct(c["type"].alias("kind"), F.coalesce(c["text"], c["input"]["command"], c["content"]).alias("text")),
    )
    last = F.when(F.col("e.type") == "result", F.array(F.struct(F.lit("answer").alias("kind"), F.col("e.result").alias("text"))))
    return rows.select(key, "ord", F.explode(F.concat(part, F.coalesce(last, F.array().cast("array<struct<kind:string,text:string>>")))).alias("p")).select(key, "ord", "p.*").where("text is not null")


MONTHLY = "series_id string, month date, views bigint, complete boolean, project_views bigint, per_million double, days_missing bigint"


def run_id(moment: datetime) -> str:
    return f"r_{moment:%Y%m%dT%H%M}_{uuid.uuid4().hex[:6]}"


def write_run(tables: dict[str, DataFrame], path: str, analysis: dict | None = None, request: dict | None = None) -> None:
    """A finished run: the result rows, then one folder each for monthly and daily figures by language, and the texts of the
    analysis and of the request. Rows without a ``lang`` get that of their series' result."""
    spark = tables["results"].sparkSession
    tables["results"].write.mode("overwrite").parquet(f"{path}/results")
    langs = spark.read.parquet(f"{path}/results").select("series_id", "lang")
    for name in RUN_TABLES:
        if name in tables and name != "results":
            rows = tables[name].drop("lang").join(langs, "series_id")
            rows.write.mode("overwrite").partitionBy("lang").parquet(f"{path}/{name}")
    for name, told in (("analysis", analysis), ("input", request)):
        if told is not None:
            spark.createDataFrame([(json.dumps(told, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/{name}")


def read_run(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a finished run; a run without monthly figures has an empty table of them."""
    out = {n: spark.read.parquet(f"{path}/{n}") for n in RUN_TABLES if exists(spark, f"{path}/{n}")}
    if "results" in out and "monthly" not in out:
        out["monthly"] = spark.createDataFrame([], MONTHLY + ", lang string")
    return out


def read_told(spark: SparkSession, path: str, name: str) -> dict | None:
    """The text ``analysis`` or ``input`` of a run."""
    if not exists(spark, f"{path}/{name}"):
        return None
    return json.loads("\n".join(r[0] for r in spark.read.text(f"{path}/{name}").collect()))


def write_scores(scores: DataFrame, model: str, path: str) -> None:
    """Results of an evaluation as JSON: one file with the model, totals and every scenario's checks."""
    rows = F.array_sort(F.collect_list(F.struct("*")))
    scores.agg(F.lit(model).alias("model"), F.count_if("pass").alias("passed"), F.count("*").alias("total"), rows.alias("results")).coalesce(1).write.mode("overwrite").json(path)
