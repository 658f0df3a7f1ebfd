"""Queries of the series, quality, resolution, claims and cache operators, and the SQL they are compared with."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import dates, rounding, text
from ..operators import claims, quality, resolve, scoring, series, shredding
from ..operators.series import BY
from ..operators.trailing import dense_days
from ..session import checkpointed
from ..sources import coverage
from ..sources.records import request_key
from ..sources.tables import current_meta, day_of, edition_of, holding_points, table
from ..streaming.daily import daily_counts
from .engine import Config, analyse, result_numbers
from .oracles import ORACLES  # noqa: F401

AS_OF = date(2025, 8, 1)


def _r(c: str | Column, k: int = 6) -> Column:
    return rounding.round_near(F.col(c) if isinstance(c, str) else c, k)


def _ym(c: str) -> Column:
    return F.date_format(c, "yyyyMM")


def _daily(spark: SparkSession, d: str) -> DataFrame:
    return dense_days(holding_points(table(spark, d, "point_cache"))).withColumnRenamed("v", "views")


def _meta(spark: SparkSession, d: str) -> DataFrame:
    return current_meta(table(spark, d, "series_meta")).withColumn("project", edition_of(F.col("project")))


def _totals(spark: SparkSession, d: str) -> DataFrame:
    return series.month_totals(table(spark, d, "project_totals"))


def _monthly(spark: SparkSession, d: str) -> DataFrame:
    return series.monthly_rollup(_daily(spark, d))


def _normalized(spark: SparkSession, d: str) -> DataFrame:
    return series.normalized(_monthly(spark, d).join(_meta(spark, d).select(BY, "project"), BY), _totals(spark, d))


def reindex_daily(spark: SparkSession, d: str) -> DataFrame:
    return _daily(spark, d).select(BY, F.date_format("day", "yyyyMMdd").alias("d"), "views")


def reindex_window(spark: SparkSession, d: str) -> DataFrame:
    """The axis of the 24 complete months before the day of the analysis, for all series."""
    span = dates.month_window(AS_OF, 24)
    daily = series.on_axis(holding_points(table(spark, d, "point_cache")), span.start, span.end)
    return series.header(daily).select(BY, "days", "days_missing", "days_zero")


def series_header(spark: SparkSession, d: str) -> DataFrame:
    h = series.header(_daily(spark, d))
    return h.select(BY, F.date_format("first_day", "yyyyMMdd").alias("first_day"), F.date_format("last_day", "yyyyMMdd").alias("last_day"), "days", "days_missing", "days_zero")


def monthly_rollup(spark: SparkSession, d: str) -> DataFrame:
    return _monthly(spark, d).select(BY, _ym("month").alias("ym"), "views", "days_present", "days_missing", "complete")


def project_totals_range(spark: SparkSession, d: str) -> DataFrame:
    t = series.month_totals(table(spark, d, "project_totals"), date(2023, 1, 15), dates.month_end(dates.last_complete_month(AS_OF)))
    return t.select("project", _ym("month").alias("ym"), "project_views")


def per_million(spark: SparkSession, d: str) -> DataFrame:
    return _normalized(spark, d).select(BY, _ym("month").alias("ym"), "views", "project_views", "per_million")


def trailing_blocks(spark: SparkSession, d: str) -> DataFrame:
    return series.trailing_blocks(_monthly(spark, d)).select(BY, _ym("month").alias("ym"), "block", "n", "available")


def compare_blocks(spark: SparkSession, d: str) -> DataFrame:
    c = series.compare_blocks(_normalized(spark, d), 6)
    return c.select(
        BY, "insufficient_history", "months_available", "months_required", _ym("prior_from").alias("prior_from"), _ym("prior_to").alias("prior_to"),
        _ym("recent_from").alias("recent_from"), _ym("recent_to").alias("recent_to"), "days_missing", F.col("raw.prior").alias("raw_prior"), F.col("raw.recent").alias("raw_recent"),
        _r("raw.yoy_pct").alias("raw_yoy"), _r("normalized.prior").alias("norm_prior"), _r("normalized.recent").alias("norm_recent"), _r("normalized.yoy_pct").alias("norm_yoy"),
        F.col("normalized.unavailable").alias("withheld"),
    )


def median_daily_90d(spark: SparkSession, d: str) -> DataFrame:
    return series.median_daily(_daily(spark, d)).select(BY, F.col("median_daily").cast("double").alias("median_daily"))


def index_to_100(spark: SparkSession, d: str) -> DataFrame:
    return series.index_to_100(_normalized(spark, d)).select(BY, _ym("month").alias("ym"), _r("index", 4).alias("index_100"))


def quarter_matrix(spark: SparkSession, d: str) -> DataFrame:
    m = series.period_matrix(_normalized(spark, d), "project", 24)
    return m.select(dates.quarter_label(F.col("period")).alias("period"), "project", "views")


def month_matrix_wide(spark: SparkSession, d: str) -> DataFrame:
    """Months by editions, a column for each of the eight with the most views of their own in the fixed table of totals, and one for
    all others together."""
    m = series.period_matrix(_normalized(spark, d), "project", 10_000)
    names = [r[0] for r in _totals(spark, d).groupBy("project").agg(F.sum("project_views").alias("v")).orderBy(F.desc("v"), "project").limit(8).collect()]
    shown = m.withColumn("project", F.when(F.col("project").isin(names), F.col("project")).otherwise("others"))
    w = series.pivot_matrix(shown, "project", [*names, "others"])
    return w.select(dates.month_label(F.col("period")).alias("period"), *[F.col(f"`{n}`").alias(f"e{k}") for k, n in enumerate(names, 1)], "others")


def robust_z(spark: SparkSession, d: str) -> DataFrame:
    return quality.robust_z(_daily(spark, d)).select(BY, F.date_format("day", "yyyyMMdd").alias("d"), _r("z", 5).alias("z"))


def daily_spikes(spark: SparkSession, d: str) -> DataFrame:
    return quality.detect_spikes(_daily(spark, d)).select(BY, F.date_format("day", "yyyyMMdd").alias("d"), "views", "z")


def spike_share(spark: SparkSession, d: str) -> DataFrame:
    daily = _daily(spark, d)
    return quality.spike_summary(daily, quality.detect_spikes(daily))


def best_split(spark: SparkSession, d: str) -> DataFrame:
    return quality.best_splits(_monthly(spark, d)).select(BY, F.col("k").cast("bigint").alias("k"), _r("difference", 5).alias("difference"))


def changepoints(spark: SparkSession, d: str) -> DataFrame:
    c = quality.changepoints(quality.complete_months(_monthly(spark, d))).where("changepoint is not null")
    return c.select(BY, F.date_format("changepoint.month", "yyyyMM").alias("ym"), *[F.col(f"changepoint.{x}").alias(x) for x in ("direction", "ratio", "share_of_total_change", "before", "after")])


def monthly_spikes(spark: SparkSession, d: str) -> DataFrame:
    c = quality.monthly_spikes(quality.complete_months(_monthly(spark, d))).where("monthly_spike is not null")
    months = F.array_join(F.transform("monthly_spike.months", lambda m: F.date_format(m["month"], "yyyyMM")), ",")
    return c.select(BY, months.alias("months"), F.col("monthly_spike.count").alias("n"), F.col("monthly_spike.share_of_views").alias("share"))


def change_without_spikes(spark: SparkSession, d: str) -> DataFrame:
    daily = _daily(spark, d)
    return quality.change_without_spikes(daily, quality.detect_spikes(daily), 90)


def _evidence(spark: SparkSession, d: str) -> DataFrame:
    breaks = quality.changepoints(quality.complete_months(_monthly(spark, d))).where("changepoint is not null").select(BY, F.col("changepoint.month").alias("month"))
    return quality.break_evidence(breaks, *_seen(spark, d))


def break_evidence(spark: SparkSession, d: str) -> DataFrame:
    return _evidence(spark, d).select(BY, _ym("month").alias("ym"), "cause", "events", F.coalesce("kinds", F.lit("")).alias("kinds"))


def _seen(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The coverage record's updates as log, late corrections of the point cache as revisions."""
    log = table(spark, d, "series_meta").select(BY, F.col("updated").cast("timestamp").alias("ts"), F.concat(F.lit("meta/"), F.coalesce("granularity", F.lit(""))).alias("kind")).distinct()
    return log, table(spark, d, "point_cache").select(BY, F.col("fetched_at").cast("timestamp").alias("ts"))


def _rated(spark: SparkSession, d: str, daily: DataFrame | None = None) -> DataFrame:
    daily = (daily or _daily(spark, d)).join(_meta(spark, d).select(BY, "project"), BY, "left")
    return quality.assess(quality.with_evidence(quality.profile(daily, _totals(spark, d), 6), *_seen(spark, d)))


def _injected(spark: SparkSession, d: str) -> DataFrame:
    """The daily series with breaks and spikes put in: series whose id begins with 0 to 5 rise tenfold from June 2024, those with
    a to f fall to a tenth; on one day of March 2023 every series has fifty times its views."""
    head = F.substring(BY, 1, 1)
    level = F.when(F.col("day") < F.lit(date(2024, 6, 1)), 1.0).when(head.between("0", "5"), 10.0).when(head.between("a", "f"), 0.1).otherwise(1.0)
    spike = F.when(F.col("day") == F.lit(date(2023, 3, 15)), 50.0).otherwise(1.0)
    return _daily(spark, d).withColumn("views", F.floor(F.col("views") * level * spike + 0.5).cast("bigint"))


def injected_breaks(spark: SparkSession, d: str) -> DataFrame:
    """Breaks of the series with breaks put in, and what was seen at their time."""
    daily = _injected(spark, d)
    c = quality.changepoints(quality.complete_months(series.monthly_rollup(daily))).where("changepoint is not null")
    found = quality.break_evidence(c.select(BY, F.col("changepoint.month").alias("month")), *_seen(spark, d))
    return c.join(found, BY).select(BY, _ym("month").alias("ym"), *[F.col(f"changepoint.{x}").alias(x) for x in ("direction", "ratio", "share_of_total_change", "before", "after")], "cause", "events")


def injected_spikes(spark: SparkSession, d: str) -> DataFrame:
    daily = _injected(spark, d)
    return quality.spike_summary(daily, quality.detect_spikes(daily))


def injected_rubric(spark: SparkSession, d: str) -> DataFrame:
    """The rubric over the series with breaks and spikes put in."""
    return _rated(spark, d, _injected(spark, d)).select(BY, "confidence", "score", F.array_join(F.transform("reasons", lambda r: r["id"]), ",").alias("reasons"), "cause")


def rubric_scores(spark: SparkSession, d: str) -> DataFrame:
    return _rated(spark, d).select(BY, "confidence", "score", F.array_join(F.transform("reasons", lambda r: r["id"]), ",").alias("reasons"))


def confidence_counts(spark: SparkSession, d: str) -> DataFrame:
    r = _rated(spark, d)
    return r.groupBy("confidence").agg(F.count("*").alias("series"), F.count_if(F.size("reasons") > 0).alias("with_reasons"))


def sparklines(spark: SparkSession, d: str) -> DataFrame:
    return series.month_sparklines(_monthly(spark, d))


def views_report(spark: SparkSession, d: str) -> DataFrame:
    """The whole main query over the 24 months before the day of the analysis."""
    meta = _meta(spark, d).where("granularity = 'daily'")
    r = analyse(holding_points(table(spark, d, "point_cache")), _totals(spark, d), meta, AS_OF, Config(spike_days=90), *_seen(spark, d)).results
    return r.select(
        BY, "lang", "title", "median_daily", F.col("window_days_missing").alias("days_missing"), "sparkline", "confidence", "score", F.array_join(F.transform("reasons", lambda x: x["id"]), ",").alias("reasons"),
        F.date_format("changepoint.month", "yyyyMM").alias("break_ym"), "cause", "spike_share", F.col("insufficient_history").isNotNull().alias("too_short"), F.col("raw.prior").alias("raw_prior"), F.col("raw.recent").alias("raw_recent"),
        rounding.round_half(F.col("raw.yoy_pct"), 1).alias("raw_yoy"), _r("normalized.prior", 4).alias("norm_prior"), _r("normalized.recent", 4).alias("norm_recent"), _r("normalized.yoy_pct", 4).alias("norm_yoy"),
    )


def limitation_counts(spark: SparkSession, d: str) -> DataFrame:
    daily = series.header(_daily(spark, d)).join(_meta(spark, d).select(BY, "project"), BY)
    return daily.groupBy("project").agg(F.max("days_missing").alias("worst"), F.count_if(F.col("days_missing") > 0).alias("flagged"), F.bool_or(F.col("days_zero") > 0).alias("any_zero"))


def gap_planning(spark: SparkSession, d: str) -> DataFrame:
    c = _meta(spark, d).select(BY, day_of(F.col("covered_from")).alias("covered_from"), day_of(F.col("covered_to")).alias("covered_to"))
    g = coverage.gaps(c, date(2022, 1, 1), date(2025, 7, 30), AS_OF)
    return g.select(BY, F.date_format("gap_from", "yyyyMMdd").alias("gap_from"), F.date_format("gap_to", "yyyyMMdd").alias("gap_to"))


def cache_stats(spark: SparkSession, d: str) -> DataFrame:
    s = coverage.cache_stats(holding_points(table(spark, d, "point_cache")))
    return s.select("series", "points", F.date_format("first_day", "yyyyMMdd").alias("first_day"), F.date_format("last_day", "yyyyMMdd").alias("last_day"))


def winner_pick(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("topic is not null")
    c = docs.select(F.lower("topic").alias("topic"), F.col("doc_id").alias("rank"), F.col("topic").alias("title"), F.concat(F.lit("Q"), "doc_id").alias("qid"), F.col("n_chars").alias("bytes"))
    return resolve.pick_winner(c).select("topic", "qid", "bytes")


def rival_articles(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("topic is not null")
    c = docs.select(F.lower("topic").alias("topic"), F.col("doc_id").alias("rank"), F.concat_ws("#", "topic", "doc_id").alias("title"), F.concat(F.lit("Q"), "doc_id").alias("qid"), F.col("n_chars").alias("bytes"))
    win = resolve.pick_winner(c.withColumn("title", F.col("topic"))).select("topic", "qid", "bytes")
    links = c.withColumns({"missing": F.lit(False), "is_disambig": F.lit(False)})
    return resolve.rival_articles(links, win).select("topic", "qid", "bytes")


def competing_senses(spark: SparkSession, d: str) -> DataFrame:
    m = _meta(spark, d).where("title is not null")
    bare = text.bare_title(F.col("title"))
    titles = m.select(bare.alias("topic"), F.col(BY).alias("ord"), "title")
    return resolve.competing_senses(titles.select("topic", F.lit(None).cast("string").alias("winner")).distinct(), titles).select("topic", F.lower("title").alias("title"))


def edition_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Which of ten asked editions have a series of a title, which not."""
    m = _meta(spark, d).where("title is not null")
    langs = F.array(*[F.lit(x) for x in ("en", "de", "fr", "es", "pl", "it", "ru", "ja", "uk", "xx")])
    asked = m.select(text.bare_title(F.col("title")).alias("topic")).distinct().select("topic", F.col("topic").alias("qid"), F.explode(langs).alias("lang"))
    links = m.select(text.bare_title(F.col("title")).alias("qid"), F.regexp_extract("project", r"^([^.]+)", 1).alias("lang"), "title").groupBy("qid", "lang").agg(F.min("title").alias("title"))
    none = links.select("qid", "lang", "title").limit(0)
    checked = none.select("lang", "title", F.col("title").alias("canonical"), F.col("title").alias("redirected_from"), F.lit(False).alias("missing"), F.lit(0).alias("bytes"), "qid", F.lit(False).alias("is_disambig"))
    r = resolve.resolve_editions(asked, links, none.withColumnRenamed("qid", "topic"), checked)
    return r.select("topic", "lang", "title", "status")


def _replies(spark: SparkSession, d: str, *names: str) -> list[DataFrame]:
    t = shredding.flat_tables(table(spark, d, "api_responses"), shredding.REPLY, "body", "response_id")
    return [t[n] for n in names]


def edition_status(spark: SparkSession, d: str) -> DataFrame:
    """Every recorded item in six editions. What the replies do not tell, the state of a linked title and the links of the source
    article, is put in by the length of the title and the item's last digit, so that every status occurs."""
    (links,) = _replies(spark, d, "sitelink")
    qid = F.regexp_extract("parent_id", r"entity:([^/]*)$", 1)
    links = links.where("title is not null").groupBy(qid.alias("qid"), F.regexp_replace("site", "wiki$", "").alias("lang")).agg(F.min("title").alias("title"))
    asked = links.select("qid").distinct().select(F.col("qid").alias("topic"), "qid", F.explode(F.array(*[F.lit(x) for x in ("en", "de", "fr", "es", "pl", "it")])).alias("lang"))
    digit = F.right("qid", F.lit(1))
    langlinks = asked.select("topic", "lang", F.when(digit.between("0", "3"), F.concat("qid", F.lit("#part"))).when(digit.between("4", "6"), F.col("qid")).alias("title")).where("title is not null")
    k = F.length("title") % 6
    other = F.when(k == 1, "Q0").otherwise(F.col("qid"))
    checked = links.select(
        "lang", "title", F.when(k.isin(1, 3), F.concat("title", F.lit(" (whole)"))).otherwise(F.col("title")).alias("canonical"), F.when(k.isin(1, 3), F.col("title")).alias("redirected_from"),
        (k == 0).alias("missing"), F.length("title").alias("bytes"), other.alias("qid"), (k == 2).alias("is_disambig"), F.col("qid").alias("_of"),
    )
    checked = checked.withColumn("_n", F.row_number().over(series.W.partitionBy("lang", "title").orderBy("_of"))).where("_n = 1").drop("_n", "_of")
    parts = [resolve.resolve_editions(asked, links, langlinks, checked, fold).withColumn("folds", F.lit(fold)) for fold in (False, True)]
    return parts[0].unionByName(parts[1]).select("qid", "lang", "title", "status", "warning", "target", "folds")


def item_names(spark: SparkSession, d: str) -> DataFrame:
    """Name, description and editions of every recorded item."""
    t = shredding.flat_tables(table(spark, d, "api_responses"), shredding.REPLY, "body", "response_id")
    return shredding.item_names(t).withColumn("editions", F.array_join("editions", ","))


def page_senses(spark: SparkSession, d: str) -> DataFrame:
    """Of every name that a recorded page bears with a qualifier: the article that is meant and its rivals."""
    (p,) = _replies(spark, d, "page")
    pages = p.groupBy("title").agg(F.bool_and(F.col("missing").isNotNull()).alias("missing"), F.max(F.col("length").cast("bigint")).alias("bytes"), F.min("pageprops_wikibase_item").alias("qid"), F.bool_or(F.col("pageprops_disambiguation").isNotNull()).alias("is_disambig"))
    links = pages.withColumn("topic", F.lower(text.bare_title(F.col("title"))))
    named = links.where(~F.col("missing") & ~F.col("is_disambig")).withColumn("rank", F.lit(0))
    win = resolve.pick_winner(named).select("topic", "title", "qid", "bytes")
    senses = resolve.dab_senses(win, win.select("topic", F.concat("topic", F.lit(" (disambiguation)")).alias("dab")), links)
    return win.select("topic", F.lit("winner").alias("role"), "title", "qid", "bytes").unionByName(senses.select("topic", F.lit("rival").alias("role"), "title", "qid", "bytes"))


def redirect_chain(spark: SparkSession, d: str) -> DataFrame:
    """Titles asked for in every recorded reply, through normalisation and redirect to their page. A reply does not hold its
    request: what it normalized, what it redirected and the pages reached by neither were asked for."""
    t = shredding.flat_tables(table(spark, d, "api_responses"), shredding.REPLY, "body", "response_id")
    key = lambda df: df.withColumn("lang", F.regexp_extract("row_id", r"^([^/]+/[^/]+)", 1))
    pairs = lambda name: key(t[name]).groupBy("lang", F.col("from").alias("from_title")).agg(F.min("to").alias("to_title"))
    pages = key(t["page"]).groupBy("lang", "title").agg(
        F.bool_and(F.col("missing").isNotNull()).alias("missing"), F.max(F.col("length").cast("bigint")).alias("bytes"), F.min("pageprops_wikibase_item").alias("qid"), F.bool_or(F.col("pageprops_disambiguation").isNotNull()).alias("is_disambig")
    )
    normalized, redirects = pairs("normalized"), pairs("redirect")
    asked = resolve.asked_titles(*[key(t[x]).select("lang", F.col("from").alias("from_title"), F.col("to").alias("to_title")) for x in ("normalized", "redirect")], pages)
    return resolve.follow_titles(asked, normalized, redirects, pages).select(F.col("lang").alias("reply"), "title", "canonical", "redirected_from", "missing", "qid")


def topic_words(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.array_join(text.topic_words(F.col("topic")), " ").alias("words"), text.reads_as_sentence(F.col("topic")).alias("sentence"))


def match_confidence(spark: SparkSession, d: str) -> DataFrame:
    m = _meta(spark, d)
    rows = m.select(BY, F.col("title").alias("query"), F.when(F.col("agent") == "user", "search").otherwise("exact-title").alias("via"), text.bare_title(F.col("title")).alias("title"), F.lit(None).cast("string").alias("label"), F.array().cast("array<string>").alias("senses"))
    return resolve.match_confidence(rows).select(BY, F.size("hits").alias("hits"), _r("coverage").alias("coverage"), "confidence")


def sentence_counts(spark: SparkSession, d: str) -> DataFrame:
    s = text.sentences(F.col("text"))
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.size(s).alias("sentences"), F.length(F.array_join(s, "")).alias("letters"))


def number_extraction(spark: SparkSession, d: str) -> DataFrame:
    n = text.numbers(F.col("text"))
    total = F.aggregate(n, F.lit(0.0), lambda s, x: s + x)
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.size(n).alias("figures"), _r(total, 3).alias("total"))


def untraceable_figures(spark: SparkSession, d: str) -> DataFrame:
    """Figures of the documents that differ from all totals of their edition, in millions; a document of no known edition is shown
    nothing."""
    shown = _totals(spark, d).groupBy("project").agg(F.array_sort(F.collect_list(F.floor(F.col("project_views") / 1_000_000).cast("double"))).alias("shown"))
    docs = table(spark, d, "documents").where("text is not null").withColumn("project", edition_of(F.col("project"))).join(shown, "project", "left")
    return claims.untraceable_figures(docs, "doc_id", "text", "shown")


def _run_rows(spark: SparkSession, d: str) -> DataFrame:
    """One run's results: of every edition its series with the most views in the recent block."""
    r = _rated(spark, d).join(_meta(spark, d).select(BY, "title"), BY)
    top = r.groupBy("project").agg(F.max_by(F.struct(*[c for c in r.columns if c != "project"]), F.struct(F.coalesce("raw.recent", F.lit(-1)), BY)).alias("_t")).select("project", "_t.*")
    return top.withColumn("lang", F.regexp_extract("project", r"^([^.]+)", 1))


def claims_checker(spark: SparkSession, d: str) -> DataFrame:
    """All documents as drafts, against one finished run."""
    # a draft is held against a run that is there: its few rows are computed once, and read by every branch of the check
    results = checkpointed(result_numbers(_run_rows(spark, d)).withColumn("run_id", F.lit("run")))
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("draft_id"), F.lit("run").alias("run_id"), "text")
    runs = spark.createDataFrame([("run", "views", "views", [])], "run_id string, topic string, label string, shared array<double>")
    return claims.verdicts(docs, claims.check_claims(docs, runs, results))


def eval_totals(spark: SparkSession, d: str) -> DataFrame:
    t = scoring.eval_totals(table(spark, d, "eval_results"))
    return t.select("model", "results_file", "total", "passed", _r("total_cost", 4).alias("total_cost"), _r("avg_turns").alias("avg_turns"))


def eval_checks(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "eval_results").dropDuplicates(["result_id", "results_file", "scenario"]).withColumn("model", F.lower(F.trim("model")))
    return rows.groupBy("model").agg(*[F.count_if(f"checks.{c}").alias(c) for c in scoring.CHECKS])


def answer_commands(spark: SparkSession, d: str) -> DataFrame:
    """Commands and the topics they ask for, in every answer."""
    rows = table(spark, d, "eval_results").where("answer is not null").select("result_id", "answer").distinct()
    c = rows.select("result_id", F.explode(scoring.commands_in(F.col("answer"))).alias("command"))
    return c.select("result_id", "command", scoring.topic_in(F.col("command")).alias("topic"), F.size(scoring.arguments(F.col("command"))).alias("arguments"))


def abbrev_numbers(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "project_totals").where("v is not null").select("project", "ym", "v").distinct()
    return rows.select("project", "ym", rounding.abbreviated(F.col("v")).alias("short"), rounding.abbreviated(F.floor(F.col("v") / 1000)).alias("thousandth"))


def date_scalars(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("o_orderdate").cast("date")
    days = table(spark, d, "orders").select(c.alias("o")).distinct()
    o = F.col("o")
    fmt = lambda x: F.date_format(x, "yyyyMMdd")
    return days.select(
        fmt(o).alias("d"), fmt(F.date_add(o, 45)).alias("plus45"), fmt(F.add_months(o, 1)).alias("plus_month"), fmt(F.add_months(o, -12)).alias("year_before"), fmt(dates.month_of(o)).alias("month_start"),
        fmt(F.last_day(o)).alias("month_end"), dates.days_in_month(o).alias("days"), dates.month_label(o).alias("label"), dates.quarter_label(o).alias("quarter"),
    )


def math_scalars(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("l_extendedprice").cast("double")
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", _r(rounding.damped(x)).alias("damped"), _r(rounding.nice_ceiling(x), 2).alias("ceiling"),
        rounding.round_half(x / 1000, 1).alias("tenths"), rounding.round_half(x / 8, 2).alias("eighths"), rounding.round_half(F.col("l_quantity").cast("double") * 0.05, 1).alias("twentieths"), rounding.round_up_half(x).alias("whole"), _r(rounding.percent_change(x, x * (1 - F.col("l_discount").cast("double"))), 4).alias("change"),
    )


def json_scalars(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.substring(F.sha1("props"), 1, 16).alias("key"), F.size(F.map_keys(F.from_json("props", "map<string,string>"))).alias("fields"))


def encoded_titles(spark: SparkSession, d: str) -> DataFrame:
    """Titles of the series as parts of a URL."""
    return table(spark, d, "series_meta").where("title is not null").select("title").distinct().select("title", text.encoded_title(F.col("title")).alias("encoded"))


def allowed_commands(spark: SparkSession, d: str) -> DataFrame:
    """Of the commands in every answer, how many may be run."""
    c = scoring.commands_in(F.col("answer"))
    rows = table(spark, d, "eval_results").where("answer is not null").select("result_id", "answer").distinct()
    return rows.groupBy("result_id").agg(F.sum(F.size(c)).alias("commands"), F.sum(F.size(scoring.allowed(c))).alias("allowed"))


def request_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "series_meta").select(BY, request_key(text.encoded_title(F.lower("access"))).alias("key"), text.site_for(F.col("agent")).alias("site"), text.project_for(F.col("agent")).alias("project")).distinct()


def event_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Kinds of every user's events, the first seen first."""
    e = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.min(F.struct("ts", "event_id")).alias("f"), F.count("*").alias("n"))
    rows = e.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("f", "event_type"))).alias("k"), F.sum("n").alias("events"))
    return rows.select("user_id", F.array_join(F.col("k.event_type"), ", ").alias("kinds"), "events")


def year_change(spark: SparkSession, d: str) -> DataFrame:
    w = series.W.partitionBy("o_orderpriority").orderBy("day")
    days = table(spark, d, "orders").groupBy("o_orderpriority", F.col("o_orderdate").cast("date").alias("day")).agg(F.count("*").alias("n"))
    rows = days.withColumns({"_y": F.lag(F.year("day")).over(w), "_i": F.row_number().over(w), "_n": F.count("*").over(series.W.partitionBy("o_orderpriority"))})
    return rows.select("o_orderpriority", F.date_format("day", "yyyyMMdd").alias("d"), "n", F.coalesce(F.year("day") != F.col("_y"), F.lit(False)).alias("new_year"), _r((F.col("_i") - 1) / F.greatest(F.lit(1), F.col("_n") - 1)).alias("position"))


def rollup_views(spark: SparkSession, d: str) -> DataFrame:
    m = _monthly(spark, d).join(_meta(spark, d).select(BY, "project", "agent"), BY)
    return m.rollup("project", "agent").agg(F.sum("views").alias("views"), F.countDistinct(BY).alias("series"))


def stream_daily_counts(spark: SparkSession, d: str) -> DataFrame:
    """Events per type and day, by the operator that also runs on the stream."""
    return daily_counts(table(spark, d, "events"), "event_type").select("event_type", F.date_format("day", "yyyyMMdd").alias("d"), "views")


def market_share_by_region(spark: SparkSession, d: str) -> DataFrame:
    """Orders per region and month per million of all orders of the month."""
    o = table(spark, d, "orders").select("o_custkey", dates.month_of(F.col("o_orderdate").cast("date")).alias("month"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("c_nationkey"), "r_name")
    by = o.join(c, "o_custkey").join(n, "c_nationkey").groupBy("r_name", "month").agg(F.count("*").alias("orders"))
    share = F.col("orders") / F.sum("orders").over(series.W.partitionBy("month")) * 1e6
    return by.select("r_name", _ym("month").alias("ym"), "orders", _r(share, 3).alias("per_million"))


QUERIES = {
    f.__name__: f
    for f in (
        reindex_daily, reindex_window, series_header, monthly_rollup, project_totals_range, per_million, trailing_blocks, compare_blocks, median_daily_90d, index_to_100,
        quarter_matrix, month_matrix_wide, robust_z, daily_spikes, spike_share, best_split, changepoints, monthly_spikes, change_without_spikes, break_evidence,
        injected_breaks, injected_spikes, injected_rubric, rubric_scores, confidence_counts, sparklines, views_report, limitation_counts, gap_planning, cache_stats, winner_pick, rival_articles, competing_senses, edition_gaps, edition_status, page_senses, item_names,
        redirect_chain, topic_words, match_confidence, sentence_counts, number_extraction, untraceable_figures, claims_checker, eval_totals, eval_checks, answer_commands,
        abbrev_numbers, date_scalars, math_scalars, json_scalars, encoded_titles, allowed_commands, request_keys, event_kinds, year_change, rollup_views, stream_daily_counts, market_share_by_region,
    )
}
