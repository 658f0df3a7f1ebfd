"""Prose against figures: numbers from nowhere, wrong direction, wrong subject, missing caution.

``results``: one row per run and edition, ``(run_id, lang, title, confidence, raw_yoy, normalized_yoy, figures, numbers)``: ``figures``
are the numbers of its comparison, ``numbers`` all its numbers (both ``array<double>``). A run has one row per edition, so a
run's rows are an array; every sentence of a draft meets those of its own run only.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.rounding import let, round_half, round_up_half
from ..functions.text import CAUTION, DECLINE, GROWTH, WORD_CODES, figure_value, figures, language_names, sentences

#: Figures the documentation states, which any text may quote.
DOCUMENTED = (7.0, 25.0, 1e6)


def exempt(v: Column) -> Column:
    """Small whole numbers and years need no source."""
    a = F.abs(v)
    return (a == F.floor(a)) & ((a <= 24) | a.between(1900, 2100))


def _tolerance(a: Column) -> Column:
    return F.when(a >= 100, F.greatest(F.lit(0.5), 0.02 * a)).otherwise(0.5)


def traceable(v: Column, shown: Column) -> Column:
    """Whether a figure is one of ``shown``: as it is, rounded, within a half, or within 2 % from 100 on. From 1 on the half
    takes in every rounding, so that one interval is the test."""
    a = F.abs(v)
    small = lambda o: (F.abs(o) == a) | (F.abs(round_up_half(o)) == a) | (round_half(F.abs(o), 1) == a)
    ends = F.struct((a - _tolerance(a)).alias("lo"), (a + _tolerance(a)).alias("hi"))
    return F.when(a >= 1, let(ends, lambda e: F.exists(shown, lambda o: F.abs(o).between(e["lo"], e["hi"])))).otherwise(F.exists(shown, small))


def matches(a: Column, shown: Column) -> Column:
    """The looser test of attribution: within the tolerance, or rounded to the same whole number."""
    whole = F.floor(a + 0.5)
    ends = F.struct(F.least(a - _tolerance(a), whole - 0.5).alias("lo"), (a + _tolerance(a)).alias("hi"), (whole + 0.5).alias("below"))
    return let(ends, lambda e: F.exists(shown, lambda o: (F.abs(o) >= e["lo"]) & ((F.abs(o) <= e["hi"]) | (F.abs(o) < e["below"]))))


def untraceable_figures(drafts: DataFrame, key: str, text: str, shown: str) -> DataFrame:
    """Distinct ``(<key>, figure)`` of the texts that no number of the array column ``shown`` explains."""
    rows = drafts.select(key, F.col(shown).alias("_s"), F.explode(F.array_distinct(figures(F.col(text)))).alias("figure")).withColumn("_v", figure_value(F.col("figure")))
    return rows.where(F.col("_v").isNotNull() & ~exempt(F.col("_v")) & ~traceable(F.col("_v"), F.coalesce("_s", F.array().cast("array<double>")))).select(key, "figure").distinct()


def _editions_named(sentence: Column, names: dict[str, str]) -> Column:
    """Codes of the editions a sentence names, by code or by language; ``names``: the language of every code that the results
    have. One pattern for codes, one for codes that are English words and so must be written as codes are, one for names."""
    if not names:
        return F.array().cast("array<string>")
    some = lambda xs: "|".join(re.escape(x) for x in sorted(xs, key=len, reverse=True)) or "(?!)"
    plain, words = [c for c in names if c not in WORD_CODES], [c for c in names if c in WORD_CODES]
    found = lambda pattern: F.regexp_extract_all(sentence, F.lit(pattern), F.lit(0))
    written = rf"\b(?:{some(words)})(?=\.wikipedia\b|:)|(?<=\()(?:{some(words)})(?=\))|\b(?:{some([w.upper() for w in words])})\b"
    codes = F.transform(F.concat(found(rf"(?i)(?<![a-z])(?:{some(plain)})(?![a-z])"), found(written)), F.lower)
    of_name: dict[str, str] = {n.lower(): c for c, n in reversed(names.items())}
    named = F.transform(found(rf"(?i)\b(?:{some(of_name)})"), lambda x: F.create_map(*[F.lit(v) for n, c in of_name.items() for v in (n, c)])[F.lower(x)])
    return F.concat(codes, named)


def _rows_named(sentence: Column, rows: Column, names: dict[str, str]) -> Column:
    """The rows a sentence is about: their edition is named, or a title that is not the topic's own."""
    about = lambda named: F.filter(rows, lambda r: F.array_contains(named, r["lang"]) | (r["distinguishing"] & (F.instr(sentence, r["title"]) > 0)))
    return let(_editions_named(sentence, names), about)


def check_claims(drafts: DataFrame, runs: DataFrame, results: DataFrame) -> DataFrame:
    """Issues ``(draft_id, id, severity, lang, figure, sentence)`` of all drafts.

    ``drafts``: ``(draft_id, run_id, text)``; ``runs``: ``(run_id, topic, label, shared array<double>)``, the numbers of the run outside
    its rows; ``results`` as above. A sentence is held against a row when it names exactly one. Null and empty texts have no issues.
    """
    generic = lambda r, g: F.coalesce(F.contains(F.lower(g), F.lower(r)) | F.contains(F.lower(r), F.lower(g)), F.lit(False))
    own = results.join(runs.select("run_id", "topic", "label"), "run_id", "left").withColumn(
        "distinguishing", F.col("title").isNotNull() & (F.col("title") != "") & ~generic(F.col("title"), F.col("topic")) & ~generic(F.col("title"), F.col("label"))
    )
    codes = sorted(r[0] for r in results.select(F.lower("lang")).distinct().where("lower(lang) is not null").collect())  # as many as there are editions
    names = language_names(drafts.sparkSession, codes)
    fields = ("lang", "title", "confidence", "raw_yoy", "normalized_yoy", "figures", "numbers", "distinguishing")
    by_run = own.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("rows"))
    doc = F.array(*[F.lit(x) for x in DOCUMENTED])
    shared = F.concat(F.coalesce("shared", F.array().cast("array<double>")), doc)
    base = drafts.join(runs.select("run_id", shared.alias("shared")), "run_id").join(by_run, "run_id", "left").where(F.length("text") > 0)
    everything = F.concat(F.col("shared"), F.coalesce(F.flatten(F.transform("rows", lambda r: r["numbers"])), F.array().cast("array<double>")))
    invented = untraceable_figures(base.withColumn("_all", everything), "draft_id", "text", "_all").select(
        "draft_id", F.lit("untraceable_figure").alias("id"), F.lit("error").alias("severity"), F.lit(None).cast("string").alias("lang"), "figure", F.lit(None).cast("string").alias("sentence")
    )
    said = base.select("draft_id", "shared", "rows", F.explode(sentences(F.col("text"))).alias("sentence"))
    # the row (if it is one) is told once a sentence: the explode keeps it from being told again for every use
    one = let(_rows_named(F.col("sentence"), F.col("rows"), names), lambda refs: F.when(F.size(refs) == 1, refs[0]))
    said = said.where(F.col("sentence").rlike(r"[0-9]")).select("draft_id", "shared", "rows", "sentence", one.alias("row"), F.explode(figures(F.col("sentence"))).alias("figure"))
    said = said.where("row is not null").withColumn("v", figure_value(F.col("figure")))
    said = said.where(F.col("v").isNotNull() & ~exempt(F.col("v"))).withColumn("a", F.abs("v"))
    a, row, s = F.col("a"), F.col("row"), F.col("sentence")
    said = said.withColumn("_own", matches(a, F.col("shared")) | matches(a, F.coalesce(row["numbers"], F.array().cast("array<double>"))))
    minus = F.ltrim("figure").startswith("-")
    grows, falls = s.rlike(GROWTH) & ~s.rlike(DECLINE), s.rlike(DECLINE) & ~s.rlike(GROWTH)

    def turned(yoy: Column) -> Column:
        hit = yoy.isNotNull() & matches(a, F.array(yoy))
        return F.coalesce(hit & (((yoy < 0) & grows & ~minus) | ((yoy > 0) & falls & ~minus & ~s.rlike(r"(?i)\bnot\b"))), F.lit(False))

    unsafe = F.coalesce((row["confidence"] == "low") & matches(a, F.coalesce(row["figures"], F.array().cast("array<double>"))) & ~s.rlike(CAUTION), F.lit(False))
    others = F.exists("rows", lambda r: matches(a, r["numbers"]))
    issue = lambda cond, name, severity: F.when(cond, F.struct(F.lit(name).alias("id"), F.lit(severity).alias("severity")))
    each = F.array(
        issue(F.col("_own") & turned(row["raw_yoy"]), "direction_conflict", "error"),
        issue(F.col("_own") & turned(row["normalized_yoy"]), "direction_conflict", "error"),
        issue(F.col("_own") & unsafe, "low_confidence_quoted", "warning"),
        issue(~F.col("_own") & F.coalesce(others, F.lit(False)), "misattributed_figure", "warning"),
    )
    found = said.select("draft_id", F.explode(F.filter(each, lambda x: x.isNotNull())).alias("_i"), row["lang"].alias("lang"), "figure", "sentence")
    return invented.unionByName(found.select("draft_id", "_i.id", "_i.severity", "lang", "figure", "sentence"))


def verdicts(drafts: DataFrame, issues: DataFrame) -> DataFrame:
    """Per draft ``(draft_id, ok, errors, warnings, sentences)``; a draft is ok when it has no error."""
    n = issues.groupBy("draft_id").agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    rows = drafts.select("draft_id", F.coalesce(F.size(sentences(F.col("text"))), F.lit(0)).alias("sentences")).join(n, "draft_id", "left").na.fill(0, ["errors", "warnings"])
    return rows.select("draft_id", (F.col("errors") == 0).alias("ok"), "errors", "warnings", "sentences")
