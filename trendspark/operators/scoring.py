"""Scoring of agent transcripts against scenarios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import numbers, reads_as_sentence
from .claims import untraceable_figures

CHECKS = ("ran_a_command", "correct_commands", "required_content", "avoided_wrong_claims", "numbers_traceable", "topic_extracted")


def commands_in(text: Column) -> Column:
    """Command lines of the fenced shell blocks in a text."""
    blocks = F.regexp_extract_all(text, F.lit(r"```(?:bash|sh|shell)?\s*\n([\s\S]*?)```"), F.lit(1))
    lines = F.flatten(F.transform(blocks, lambda b: F.transform(F.split(b, "\n"), lambda x: F.trim(x))))
    return F.filter(lines, lambda x: (x != "") & ~x.startswith("#"))


# Commands that may be run.
ALLOWED = ("views", "resolve", "report", "check", "doctor")


def allowed(commands: Column) -> Column:
    """Of command lines those whose first words are a program and a command that may be run, and that chain, pipe or redirect nothing."""
    pattern = rf"^\s*(?:node\s+)?\S+\s+(?:{'|'.join(ALLOWED)})\b[^;&|<>`$]*$"
    return F.filter(commands, lambda c: c.rlike(pattern))


def arguments(command: Column) -> Column:
    """A command line cut into arguments; quoted ones stay whole and lose their quotes."""
    return F.transform(F.regexp_extract_all(command, F.lit(r"\"[^\"]*\"|'[^']*'|\S+"), F.lit(0)), lambda a: F.regexp_replace(a, "^[\"']|[\"']$", ""))


def topic_in(command: Column) -> Column:
    """The topic a command asks for; null where it asks for none."""
    raw = F.regexp_extract(command, r"\b(?:views|resolve)\s+(\"[^\"]*\"|'[^']*'|[^\s-]\S*)", 1)
    return F.when(raw != "", F.regexp_replace(raw, "^[\"']|[\"']$", ""))


def _unmet(patterns: Column, text: Column) -> Column:
    return F.filter(F.coalesce(patterns, F.array().cast("array<string>")), lambda p: ~F.regexp_like(text, F.concat(F.lit("(?i)"), F.replace(p, F.lit("(?i)"), F.lit("")))))


def score(transcripts: DataFrame, scenarios: DataFrame) -> DataFrame:
    """``(transcript_id, scenario, pass, <six checks>)`` of ``transcripts`` ``(transcript_id, scenario, commands array<string>, answer,
    tool_output, reference)`` held against ``scenarios`` ``(scenario, must_call, must_mention, must_not_mention)``, arrays of patterns
    without regard to case."""
    t = transcripts.join(scenarios, "scenario")
    none = F.array().cast("array<string>")
    answer, calls = F.coalesce("answer", F.lit("")), F.coalesce("commands", none)
    t = t.withColumn("_shown", F.concat(numbers(F.coalesce("tool_output", F.lit(""))), numbers(F.coalesce("reference", F.lit("")))))
    invented = untraceable_figures(t.withColumn("_a", answer), "transcript_id", "_a", "_shown").select("transcript_id").distinct().withColumn("_bad", F.lit(True))
    wrong = F.coalesce("must_not_mention", none)
    rows = t.join(invented, "transcript_id", "left").select(
        "transcript_id", "scenario", (F.size(calls) > 0).alias("ran_a_command"), (F.size(_unmet(F.col("must_call"), F.array_join(calls, "\n"))) == 0).alias("correct_commands"),
        (F.size(_unmet(F.col("must_mention"), answer)) == 0).alias("required_content"), (F.size(_unmet(wrong, answer)) == F.size(wrong)).alias("avoided_wrong_claims"),
        F.col("_bad").isNull().alias("numbers_traceable"), (~F.exists(calls, lambda c: F.coalesce(reads_as_sentence(topic_in(c)), F.lit(False)))).alias("topic_extracted"),
    )
    every = F.lit(True)
    for c in CHECKS:
        every = every & F.col(c)
    return rows.withColumn("pass", every)


def eval_totals(results: DataFrame) -> DataFrame:
    """Per model (in small letters) and results file: rows, passed, cost and turns. Repeated rows count once."""
    rows = results.dropDuplicates(["result_id", "results_file", "scenario"]).withColumn("model", F.lower(F.trim("model")))
    return rows.groupBy("model", "results_file").agg(
        F.count("*").alias("total"), F.count_if("passed").alias("passed"), F.sum("cost").alias("total_cost"), F.avg("turns").alias("avg_turns")
    )
