"""Mixing sources to target weights.

Every text gets a hash-random key. Within a source, texts stand in the order of their keys; the running total of their
tokens is computed in parts of the key range: part sums first, then a running total inside each part, so that a source
that holds most of the corpus is spread over as many tasks as there are parts, and there are the more parts the more texts
there are. Tokens are counted where a text lies; what is moved is its hash, id and size. A source's budget is its share of the
wanted total, at most as often as its texts may be repeated; the order is walked in whole rounds and cut exactly where
the budget ends, the last text being taken up to the token.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window as W, functions as F

from ..session import checkpointed
from . import tokens

#: Texts of one source that a part of the key range should hold.
PART_TEXTS = 100_000


def _source(c: str):
    return F.regexp_replace(F.lower(F.trim(c)), r"[\s_\-]+", "-")


def _spread(documents: DataFrame, targets: DataFrame, seed: int, tokenizer: str) -> tuple[DataFrame, DataFrame]:
    """The distinct texts of the targeted sources, sized, keyed and in parts; and one row per target, of a table written by hand."""
    wanted = targets.select(_source("source").alias("source"), "target_share", "max_repeats").where("source is not null and target_share > 0 and max_repeats > 0")
    wanted = wanted.groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    docs = documents.select("doc_id", _source("source").alias("source"), "text").where("source is not null and length(text) > 0").join(wanted.select("source"), "source", "left_semi")
    sized = tokens.with_token_counts(docs.withColumn("_h", F.sha2("text", 256)), "text", tokenizer).select("doc_id", "source", "_h", "n_tokens")
    # a repost is the same text: it belongs to the source of its least id, and is counted once
    # texts without tokens are left out behind the aggregation: a filter before it would count tokens once more, and of all texts
    texts = sized.groupBy("_h").agg(F.min(F.struct("doc_id", "source")).alias("_d"), F.max("n_tokens").alias("n_tokens")).where("n_tokens > 0")
    keyed = checkpointed(texts.select("_d.doc_id", "_d.source", "n_tokens", F.xxhash64("_h", F.lit(seed)).alias("_key"), "_h"))
    bits = max(4, min(30, math.ceil(math.log2(1 + keyed.count() / PART_TEXTS))))
    return keyed.withColumn("_part", F.shiftright("_key", 64 - bits)), wanted


def budgets(texts: DataFrame, wanted: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """``(source, target_share, max_repeats, available, budget)``, one row per target. ``total_tokens``: size of the
    mixture; if not given, that of all distinct texts of the targeted sources."""
    have = texts.groupBy("source").agg(F.sum("n_tokens").alias("available"))
    rows = wanted.join(have, "source", "left").withColumn("available", F.coalesce("available", F.lit(0)))
    total = F.sum("available").over(W.partitionBy()) if total_tokens is None else F.lit(total_tokens).cast("bigint")  # as many rows as targets
    share = F.floor(F.col("target_share") * total + 0.5).cast("bigint")
    return rows.select("source", "target_share", "max_repeats", "available", F.least(share, F.col("available") * F.col("max_repeats")).alias("budget"))


def mix(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 17, tokenizer: str = tokens.TOKENIZER) -> DataFrame:
    """``(source, doc_id, epoch, n_tokens, taken_tokens)``: one row per use of a text, epochs from 0; ``taken_tokens`` is less
    than ``n_tokens`` only for the text at which a source's budget ends.

    Texts are told apart by content: reposts, in whatever source, are one text, used at most ``max_repeats`` times.
    Spellings of a source (case, separators, outer blanks) are one source; a null source has no target, a target
    without texts yields nothing. Null and empty texts are left out. Repeated rows change nothing.
    """
    texts, wanted = _spread(documents, targets, seed, tokenizer)
    plan = budgets(texts, wanted, total_tokens)
    sums = texts.groupBy("source", "_part").agg(F.sum("n_tokens").alias("_n"))
    sums = sums.select("source", "_part", (F.sum("_n").over(W.partitionBy("source").orderBy("_part")) - F.col("_n")).alias("_before"))
    inside = W.partitionBy("source", "_part").orderBy("_key", "_h").rowsBetween(W.unboundedPreceding, -1)
    placed = (
        texts.withColumn("_in", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
        .join(sums.join(plan.where("budget > 0").select("source", "available", "budget"), "source"), ["source", "_part"])  # parted as the texts are
        .withColumn("_at", F.col("_before") + F.col("_in"))
    )
    rounds = F.floor((F.col("budget") - F.col("_at") - 1) / F.col("available"))  # the last epoch that reaches the text
    return (
        placed.where("budget > _at")
        .select("source", "doc_id", "n_tokens", "_at", "available", "budget", F.explode(F.sequence(F.lit(0), rounds.cast("int"))).alias("epoch"))
        .select("source", "doc_id", "epoch", "n_tokens", F.least(F.col("n_tokens"), F.col("budget") - F.col("_at") - F.col("epoch") * F.col("available")).alias("taken_tokens"))
    )


def mixture_checks(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 17, tokenizer: str = tokens.TOKENIZER) -> DataFrame:
    """Per target ``(source, off_budget, over_repeated, gaps, unequal_uses)``, all 0 for a mixture as promised: tokens by which it
    misses its budget; texts used more often than allowed; epochs of a text left out; texts whose number of uses differs
    by more than one from another's of the source."""
    texts, wanted = _spread(documents, targets, seed, tokenizer)
    uses = mix(documents, targets, total_tokens, seed, tokenizer).groupBy("source", "doc_id").agg(F.count("*").alias("n"), F.max("epoch").alias("e"), F.sum("taken_tokens").alias("t"))
    every = texts.select("source", "doc_id").join(uses, ["source", "doc_id"], "left").na.fill(0, ["n", "t"])
    of = every.groupBy("source").agg(F.sum("t").alias("t"), F.max("n").alias("most"), F.min("n").alias("least"), F.count_if(F.col("e") + 1 != F.col("n")).alias("gaps"))
    plan = budgets(texts, wanted, total_tokens).join(of, "source", "left").na.fill(0, ["t", "most", "least", "gaps"])
    return plan.select("source", F.abs(F.col("budget") - F.col("t")).alias("off_budget"), (F.col("most") > F.col("max_repeats")).cast("int").alias("over_repeated"), "gaps", (F.col("most") - F.col("least") > 1).cast("int").alias("unequal_uses"))


def shares(mixture: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target ``(source, target_share, actual_share, tokens, uses, most_repeats)``; a target nothing was drawn for has 0."""
    by_text = mixture.groupBy("source", "doc_id").agg(F.count("*").alias("r"), F.sum("taken_tokens").alias("t"))
    got = by_text.groupBy("source").agg(F.sum("t").alias("tokens"), F.sum("r").alias("uses"), F.max("r").alias("most_repeats"))
    want = targets.select(_source("source").alias("source"), "target_share").where("source is not null").groupBy("source").agg(F.max("target_share").alias("target_share"))
    rows = want.join(got, "source", "left").na.fill(0, ["tokens", "uses", "most_repeats"])
    whole = F.sum("tokens").over(W.partitionBy())  # as many rows as there are targets
    return rows.select("source", "target_share", F.coalesce(F.try_divide("tokens", whole), F.lit(0.0)).alias("actual_share"), "tokens", "uses", "most_repeats")
