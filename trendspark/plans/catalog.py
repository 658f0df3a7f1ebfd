"""What the tables of a data folder know of pages and items, in the form the resolution of topics reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import bare_title, topic_words
from ..operators.resolve import HITS, MEASURED, Wiki, resolve_topics
from ..operators.series import BY
from ..operators.shredding import REPLY, flat_tables
from ..sources.tables import current_meta, edition_of, exists, table


def daily_series(spark: SparkSession, data: str) -> DataFrame:
    """The daily series on record ``(series_id, project, title, lang, qid)``; an item is all titles of one bare name."""
    meta = current_meta(table(spark, data, "series_meta")).where("granularity = 'daily' and title is not null").withColumn("project", edition_of(F.col("project")))
    return meta.select(BY, "project", "title", F.regexp_extract("project", r"^([^.]+)", 1).alias("lang"), F.lower(bare_title(F.col("title"))).alias("qid"))


def wiki_of(series: DataFrame, topics: DataFrame, from_lang: str, checked: DataFrame | None = None) -> Wiki:
    """The titles of the series as a wiki: pages are those of ``from_lang``, hits its titles that hold all words of a topic, the
    shortest first. ``checked``: where titles were followed to."""
    own = series.where(F.col("lang") == from_lang).groupBy("title").agg(F.min("qid").alias("qid"))
    pages = own.select("title", F.lit(False).alias("missing"), F.lit(None).cast("bigint").alias("bytes"), "qid", F.col("title").rlike(r"(?i)\(disambiguation\)\s*$").alias("is_disambig"))
    asked = topics.select("topic", topic_words(F.col("topic")).alias("_w")).where(F.size("_w") > 0)
    words = own.select("title", F.explode(F.array_distinct(topic_words(F.col("title")))).alias("w"))
    hits = asked.select("topic", F.size("_w").alias("_n"), F.explode("_w").alias("w")).join(words, "w").groupBy("topic", "title", "_n").agg(F.countDistinct("w").alias("_c")).where(F.col("_c") >= F.col("_n"))
    ranked = F.transform(F.slice(F.array_sort(F.collect_list(F.struct(F.length("title").alias("l"), "title"))), 1, HITS), lambda x: x["title"])
    search = hits.groupBy("topic").agg(ranked.alias("t")).select("topic", F.posexplode("t").alias("rank", "title")).withColumn("rank", F.col("rank") + 1)
    links = pages.withColumn("topic", F.lower(bare_title(F.col("title"))))
    links = links.join(topics.select(F.col("topic").alias("_t"), F.lower(F.trim("topic")).alias("_k")), F.col("topic") == F.col("_k")).select(F.col("_t").alias("topic"), *[c for c in pages.columns])
    returned = links.select("topic", F.lit(1).alias("rank"), "title")
    sitelinks = series.groupBy("qid", "lang").agg(F.min("title").alias("title"))
    none = series.where("false")
    if checked is None:
        no = F.lit(None).cast("string")
        checked = none.select("lang", "title", F.col("title").alias("canonical"), no.alias("redirected_from"), F.lit(False).alias("missing"), F.lit(None).cast("bigint").alias("bytes"), "qid", F.lit(False).alias("is_disambig"))
    items = series.groupBy("qid").agg(F.min(bare_title(F.col("title"))).alias("label"))
    return Wiki(pages, returned, search, items, links, sitelinks, none.select(F.col("qid").alias("topic"), "lang", "title"), checked)


def seen(spark: SparkSession, data: str, series: DataFrame) -> tuple[DataFrame | None, DataFrame | None]:
    """Log events and revisions of the recorded replies, by the series of their titles; nothing where no replies are kept."""
    if not exists(spark, f"{data}/api_responses.parquet"):
        return None, None
    t = flat_tables(table(spark, data, "api_responses"), REPLY, "body", "response_id")
    of = series.select(BY, "title")
    log = t["logevent"].select("title", F.col("timestamp").try_cast("timestamp").alias("ts"), F.concat_ws("/", "type", "action").alias("kind")).where("ts is not null").join(of, "title")
    edits = t["revision"].select("parent_id", F.col("timestamp").try_cast("timestamp").alias("ts")).where("ts is not null").join(t["page"].select(F.col("row_id").alias("parent_id"), "title"), "parent_id").join(of, "title")
    return log.select(BY, "ts", "kind"), edits.select(BY, "ts")


def resolved_series(spark: SparkSession, data: str, topic: str, langs: list[str], from_lang: str = "en", verify: bool = True, allow_fold: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(entities, editions, series)`` of a topic: ``series`` are those on record of the titles it resolved to."""
    series = daily_series(spark, data)
    topics = spark.createDataFrame([(topic,)], "topic string")
    entities, editions = resolve_topics(topics, langs, wiki_of(series, topics, from_lang), verify, allow_fold)
    measured = editions.where(F.col("status").isin(*MEASURED)).select("lang", F.col("title").alias("_title"), "qid", "status", "warning", "redirected_from")
    return entities, editions, series.join(measured, ["lang", "qid"]).drop("_title")
