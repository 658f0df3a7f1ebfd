"""The main query: from points to rated comparisons, for any number of series in one plan."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date
import importlib.util

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.dates import FLOOR, month_window, since_months
from ..functions.rounding import round_half
from ..functions.text import numbers, sentences, sparkline
from ..operators import claims, quality, series
from ..operators.series import BY
from ..sources.coverage import cache_stats


class EngineError(Exception):
    """``code``, what went wrong, and what to do about it."""

    def __init__(self, code: str, message: str, fix: str = ""):
        super().__init__(message)
        self.code, self.message, self.fix = code, message, fix or ERRORS.get(code, "")

    def as_dict(self) -> dict[str, str]:
        return {"error": self.code, "message": self.message, "fix": self.fix}


#: The codes an error can have, and what to do about it where nothing better is said.
ERRORS = {
    "no_topic": "name a topic", "no_langs": "--langs en,de,fr", "topic_not_found": "use a more specific phrase or an exact title", "window_too_short": "compare at least 2m",
    "bad_since": "write 2y, 18m or 90d", "no_run": "--run with the folder of a finished run", "run_not_found": "run views with --out first", "no_claims": "pass the draft's text",
    "notes_unverified": "quote figures of the run", "fixture_missing": "record the reply first", "bad_json": "look at the reply's body", "unknown_command": "views, resolve, report, check or doctor",
    "upstream": "the recorded status is no success", "internal": "report the message",
}


@dataclass(frozen=True)
class Config:
    since: str = "2y"
    days: int = 90
    spike_days: int = 365


@dataclass
class Analysis:
    daily: DataFrame
    monthly: DataFrame
    results: DataFrame
    months: int


#: Signals of a series, as a struct of its result row.
SIGNALS = ("months_available", "median_daily", "days_missing_share", "spike_days", "spike_share", "yoy_excl_spikes", "changepoint", "monthly_spike", "cause", "events", "kinds")


def window_months(since: str) -> int:
    try:
        months = since_months(since)
    except ValueError as e:
        raise EngineError("bad_since", str(e)) from None
    if months < 2:
        raise EngineError("window_too_short", f"{since} is less than two months")
    return months


def analyse(points: DataFrame, totals: DataFrame, meta: DataFrame, as_of: date, config: Config = Config(), log: DataFrame | None = None, revisions: DataFrame | None = None) -> Analysis:
    """Rated comparisons of all series in ``meta``.

    ``points``: ``(series_id, day, v)``; ``totals``: ``(project, month, project_views)``; ``meta``: ``(series_id, project, title)``, one row a series,
    with ``status``, ``warning`` and ``redirected_from`` where titles were resolved; ``log`` ``(series_id, ts, kind)`` and ``revisions`` ``(series_id, ts)``:
    what was seen at the time of a break. ``results`` has one row per series, whether it has points or not: ``raw`` and ``normalized``
    are null where ``insufficient_history`` is not. Points are read once; all else runs on one partitioning by series.
    """
    months = window_months(config.since)
    span = month_window(as_of, months)
    start = max(span.start, FLOOR)
    told = [F.col(c) if c in meta.columns else F.lit(None).cast("string").alias(c) for c in ("status", "warning", "redirected_from")]
    wanted = meta.select(BY, "project", "title", *told)
    daily = series.on_axis(points, start, span.end, wanted)
    profiles = quality.profile(daily.join(wanted.select(BY, "project"), BY), totals, months // 2, config.days, config.spike_days)
    rated = quality.assess(quality.with_evidence(profiles, log, revisions))
    results = wanted.withColumn("lang", F.regexp_extract("project", r"^([^.]+)", 1)).join(rated.drop("project", "insufficient_history", "yoy_pct"), BY, "left")
    results = results.withColumns({
        "signals": F.struct(*SIGNALS), "sparkline": sparkline(F.transform("monthly", lambda m: m["views"])),
        "insufficient_history": F.when(F.col("months_available") < F.col("months_required"), F.struct("months_available", "months_required")),
    })
    monthly = rated.select(BY, F.explode("monthly").alias("m")).select(BY, "m.*")
    return Analysis(daily, monthly, results, months)


def hint(results: int, unresolved: list[dict], topic: str, candidates: list[str] = (), langs: list[str] = ()) -> dict | None:
    """What to try next where a topic is known but nothing of it could be measured."""
    if results or not unresolved:
        return None
    tries = ["a wider phrase for the topic"]
    if candidates:
        tries.append(f"another bearer of the name: {', '.join(candidates)}")
    if langs:
        tries.append(f"the name as it is in {langs[0]} (--from {langs[0]})")
    return {"problem": f"no edition asked for has an article on {topic}", "try": [*tries, "resolve with the same arguments, which reads no counts"]}


def result_numbers(results: DataFrame) -> DataFrame:
    """``results`` in the form the claims check reads, with every number a reader is shown: figures, signals, dates, reasons."""
    raw, norm = F.col("raw"), F.col("normalized")
    shown = lambda *xs: F.filter(F.array(*[x.cast("double") for x in xs]), lambda x: x.isNotNull())
    pct = lambda x: round_half(x, 1)
    figures = shown(raw["prior"], raw["recent"], pct(raw["yoy_pct"]), round_half(norm["prior"], 2), round_half(norm["recent"], 2), pct(norm["yoy_pct"]))
    # whatever else the row holds is told as text, and all numbers of the text are taken
    held = [c for c in ("signals", "median_daily", "score", "window_days_missing", "window_days_zero", "insufficient_history", "reasons", "prior_from", "prior_to", "recent_from", "recent_to", "changepoint", "monthly_spike", "spike_share", "spike_days", "yoy_excl_spikes") if c in results.columns]
    prose = F.coalesce(F.to_json(F.struct(*held)), F.lit("")) if held else F.lit("")
    return results.select("lang", "title", "confidence", pct(raw["yoy_pct"]).alias("raw_yoy"), pct(norm["yoy_pct"]).alias("normalized_yoy"), figures.alias("figures"), F.concat(figures, numbers(prose)).alias("numbers"))


def check_draft(spark: SparkSession, results: DataFrame, topic: str, text: str, reference: str = "") -> DataFrame:
    """Issues of one draft against one run's results."""
    if not (text or "").strip():
        raise EngineError("no_claims", "nothing to check", "pass the draft's text")
    import re

    shared = [float(x.replace(",", "")) for x in re.findall(r"-?\d[\d,]*(?:\.\d+)?", reference)]
    drafts = spark.createDataFrame([(1, "run", text)], "draft_id int, run_id string, text string")
    runs = spark.createDataFrame([("run", topic, topic, shared)], "run_id string, topic string, label string, shared array<double>")
    return claims.check_claims(drafts, runs, result_numbers(results).withColumn("run_id", F.lit("run")))


def counted(spark: SparkSession, text: str) -> dict[str, int]:
    """How many sentences and figures of a draft were looked at."""
    df = spark.createDataFrame([(text,)], "t string")
    s, n = df.select(F.size(sentences(F.col("t"))), F.size(numbers(F.col("t")))).first()
    return {"sentences_checked": s, "figures_checked": n}


def doctor(spark: SparkSession, points: DataFrame | None = None) -> dict:
    """Versions, settings that matter, what the cache holds, optional libraries, and what is wrong with them."""
    warnings = []
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        warnings.append("session time zone is not UTC")
    if spark.conf.get("spark.sql.adaptive.enabled") != "true":
        warnings.append("adaptive execution is off")
    if not spark.sparkContext.master.startswith("local") and spark.sparkContext.getConf().get("spark.checkpoint.dir") is None:
        warnings.append("spark.checkpoint.dir names no shared folder")
    held = {k: str(v) if isinstance(v, date) else v for k, v in cache_stats(points).first().asDict().items()} if points is not None else None
    optional = {m: importlib.util.find_spec(m) is not None for m in ("regex", "tokenizers", "pyarrow", "pandas", "numpy")}
    warnings += [f"{m} is missing" for m, there in optional.items() if not there]
    return {"spark": spark.version, "master": spark.sparkContext.master, "points": held and held["points"], "cache": held, "libraries": optional, "warnings": warnings, "ok": not warnings}
