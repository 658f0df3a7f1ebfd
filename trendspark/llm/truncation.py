"""Texts cut off before their end, and how often each source cuts.

The corpus itself tells what an end looks like. Its words form a trie, held as a table of nodes (prefixes of words, with
the number of times each is a word and the number of times it goes on): a text whose final token is no word but a proper
prefix of words was cut inside a word. The same trie is kept per context, the two tokens before: a final token that is
a word elsewhere, but here only ever the beginning of another, was cut too. Where the final words are whole, the corpus'
word sequences tell whether a text or line can end there, and structure tells what was left open (code fences, JSON,
table rows).

Length is evidence of another kind: lengths (in characters, bytes, or without a mark of omission) at which a source's
texts pile up are limits. It never decides alone. What the end says and how far the texts of that length outnumber the
usual are added up as logarithms of odds (``WEIGHTS``): at a limit an end that the corpus does not know is a cut, a
sentence that ends with its full stop is none.

All counts are over all distinct texts, whatever their number of copies. Sequences that no text ends with are dropped
before anything is counted or moved. Sequences and nodes are keyed by 64-bit hashes: two that collide would add up their
counts, which at 10^12 different sequences befalls one of 10^7. Texts are told apart by 128 bits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import checkpointed

#: Run ids, numbers, tokens: the first two are written as one sign each before the text is cut into tokens.
RUN_ID, NUMBER = r"\br_\d{8}T\d{4}_[0-9a-f]*", r"(?U)(?<!\w)\d+(?:[.,]\d+)*"
ID_SIGN, NUMBER_SIGN = "\ue000", "\ue001"
TOKEN = rf"(?U)[{ID_SIGN}{NUMBER_SIGN}]|\w+|\.\.\.|\n|[^\w\s]"
#: Share of occurrences that must be ends for an end to be one; occurrences that make a sequence known.
END_SHARE, KNOWN = 0.03, 3
#: A length is a limit if at least so many texts have it and so many times more than lengths around it.
PILE, PILE_FACTOR = 5, 8.0
#: Lengths around a length, nearest and farthest, that tell how many texts are usual.
NEAR, FAR = 30, 200
#: Logarithm of the odds of a cut before anything is known, what each kind of end adds to it, and the most a length adds.
PRIOR = -1.5
WEIGHTS = {"structure": 6.0, "word": 6.0, "context": 5.0, "sequence": 4.0, "unknown": 0.0, "usual": -2.0, "stop": -3.5}
LENGTH_MOST = 4.5
#: An end that at least this share of the occurrences of its sequence are is a usual one.
USUAL = 0.5
#: Keys that are broadcast to drop sequences nobody asks for; of more, sequences are counted first and dropped then.
ASKED = 2_000_000
#: Characters at a text's end that are cut into tokens for its final ones; texts with longer tokens are taken whole.
TAIL = 400
#: Marks of omission a writer or a field limit may leave.
MARK = r"\s*(\[(\.\.\.|…)\]|\.\.\.|…)$"

_STOP = (".", "?", "!", "\n")


def _tokens(text: Column) -> Column:
    signed = F.regexp_replace(F.regexp_replace(text, RUN_ID, ID_SIGN), NUMBER, NUMBER_SIGN)
    return F.regexp_extract_all(F.regexp_replace(signed, r"\n+", "\n"), F.lit(TOKEN), F.lit(0))


def _unmarked(text: Column) -> Column:
    """A text without a mark of omission at its end."""
    may = text.endswith("…") | text.endswith("...") | text.endswith("]")
    return F.when(may, F.regexp_replace(text, MARK, "")).otherwise(text)


def _with_last_tokens(df: DataFrame, name: str, text: Column) -> DataFrame:
    """``df`` with at least the last five tokens of a text, all of a shorter one. A blank is always between two tokens."""
    tail = F.when(F.length(text) <= TAIL, text).otherwise(F.regexp_replace(F.right(text, F.lit(TAIL)), r"^\S*\s", ""))
    df = df.withColumn("_tail", _tokens(tail))
    return df.withColumn(name, F.when((F.length(text) > TAIL) & (F.size("_tail") < 5), _tokens(text)).otherwise(F.col("_tail"))).drop("_tail")


def _word(w: Column) -> Column:
    return F.when(F.length(w) > 1, w != "...").otherwise(w.rlike(r"(?U)^\w"))


def _key(kind: int, *tokens: Column) -> Column:
    """Hash of a sequence; null unless all tokens are there. Kinds 1 to 3 are sequences, 12 is the context of a trie."""
    there = tokens[0].isNotNull()
    for t in tokens[1:]:
        there = there & t.isNotNull()
    return F.when(there, F.xxhash64(F.lit(kind), *tokens))


def _limits(rows: DataFrame) -> DataFrame:
    """``(_source, measure, length, odds)``: lengths at which a source's distinct texts pile up, and how far, as a logarithm.
    A source has at most as many rows here as it has lengths."""
    measures = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("length")) for m in ("chars", "bytes", "unmarked")])
    counts = rows.where("sig is not null").select("_source", "_h", F.explode(measures).alias("_l")).select("_source", "_h", "_l.*").where("length is not null").distinct()
    counts = counts.groupBy("_source", "measure", "length").agg(F.count("*").alias("n"))
    by = W.partitionBy("_source", "measure").orderBy("length")
    around = lambda a, b: F.coalesce(F.sum("n").over(by.rangeBetween(a, b)), F.lit(0)) / float(FAR - NEAR + 1)
    # below a limit lengths are as frequent as usual, and above a source's shortest texts they are
    counts = counts.withColumn("usual", F.greatest(around(-FAR, -NEAR), around(NEAR, FAR)) + 0.5 / (FAR - NEAR + 1))
    return counts.where((F.col("n") >= PILE) & (F.col("n") >= PILE_FACTOR * F.col("usual"))).select("_source", "measure", "length", F.log(F.col("n") / F.col("usual")).alias("odds"))


def _tally(corpus: DataFrame, asked: DataFrame) -> DataFrame:
    """``(key, w, ends, goes_on)`` of the corpus (column ``_text``): of every asked sequence (``w`` null) how often an end (of text,
    line or sentence) follows it and how often not; of every asked context, and of context 0, which is all, its words."""
    text = F.col("_text")
    bare = _unmarked(text)
    # the final token, before a mark of omission, counts for no word
    cut = corpus.withColumn("_t", _tokens(text)).withColumn("_n", F.when(bare == text, F.size("_t")).otherwise(F.size(_tokens(bare))))
    at = cut.where(F.size("_t") > 0).select("_t", "_n", F.explode(F.sequence(F.lit(0), F.size("_t") - 1)).alias("_i"))
    t, i = F.col("_t"), F.col("_i")
    near = at.select(F.get(t, i).alias("w"), F.get(t, i - 1).alias("p1"), F.get(t, i - 2).alias("p2"), F.get(t, i + 1).alias("f1"), (i < F.col("_n") - 1).alias("inner"))
    w, p1, p2 = F.col("w"), F.col("p1"), F.col("p2")
    said = F.when(F.col("inner") & _word(w), w)
    none = F.lit(None).cast("string")
    each = [(_key(1, w), none), (_key(2, p1, w), none), (_key(3, p2, p1, w), none), (F.when(said.isNotNull(), _key(12, p2, p1)), said), (F.when(said.isNotNull(), F.lit(0).cast("bigint")), said)]
    rows = near.select((F.col("f1").isNull() | F.col("f1").isin(*_STOP)).alias("e"), F.explode(F.array(*[F.struct(k.alias("key"), x.alias("w")) for k, x in each])).alias("_k"))
    rows = rows.select("e", "_k.*").where("key is not null")
    keys = asked.unionByName(asked.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("key")))
    few = asked.count() <= ASKED
    if few:
        rows = rows.join(F.broadcast(keys), "key", "left_semi")
    counts = rows.groupBy("key", "w").agg(F.sum(F.col("e").cast("bigint")).alias("ends"), F.sum((~F.col("e")).cast("bigint")).alias("goes_on"))
    return checkpointed(counts if few else counts.join(keys, "key", "left_semi"))


def _verdicts(tails: DataFrame, tally: DataFrame) -> DataFrame:
    """``(sig, end)``: what kind of end each distinct tail is, one of ``WEIGHTS``; open structures and full stops are told
    elsewhere."""
    names = ("g1", "g2", "g3", "u3")
    asked = tails.select("sig", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(k).alias("key")) for k in names])).alias("_q")).select("sig", "_q.*").where("key is not null")
    each = lambda k, c: F.max(F.when(F.col("k") == k, F.col(c))).alias(f"{k}_{c[0]}")
    grams = asked.join(tally.where("w is null"), "key").groupBy("sig").agg(*[each(k, c) for k in names for c in ("ends", "goes_on")])
    # nodes of the trie: of each word the prefixes of the lengths that are asked for
    nodes = tails.where("node is not null").select("sig", "node", F.explode(F.array(F.lit(0).cast("bigint"), "c2")).alias("key")).where("key is not null")
    lengths = sorted(r[0] for r in nodes.select(F.length("node").alias("n")).distinct().collect())  # lengths of words
    held = F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.length("w"))
    words = tally.where("w is not null").select("key", "w", (F.col("ends") + F.col("goes_on")).alias("n"), F.explode(held).alias("_l")).select("key", "w", "n", F.substring("w", F.lit(1), F.col("_l")).alias("node"))
    whole = F.col("node") == F.col("w")
    trie = words.groupBy("key", "node").agg(F.sum(F.when(whole, F.col("n")).otherwise(0)).alias("words"), F.sum(F.when(~whole, F.col("n")).otherwise(0)).alias("longer"))
    top = F.col("key") == 0
    found = nodes.join(trie, ["key", "node"]).groupBy("sig").agg(
        *[F.max(F.when(top if k == 0 else ~top, F.col(c))).alias(f"{c[0]}{k}") for k in (0, 2) for c in ("words", "longer")]
    )
    rows = tails.join(grams, "sig", "left").join(found, "sig", "left")
    num = lambda c: F.coalesce(F.col(c), F.lit(0))
    own = F.when(F.col("marked"), 0).otherwise(1)
    # what several texts end with before a mark of omission is a way to end, where nothing goes on from the same words
    habit = F.col("marked") & (num("g3_e") - 1 >= 2) & (num("l2") == 0)
    word = F.col("node").isNotNull() & (num("w0") == 0) & (num("l0") > 0) & ~habit
    context = (num("l2") >= 2) & (num("w2") <= END_SHARE * num("l2")) & (num("u3_e") - own <= END_SHARE * num("l2"))
    share = F.lit(None).cast("double")  # of the longest sequence the corpus knows
    for k in ("g1", "g2", "g3"):
        e, both = num(f"{k}_e") - 1, num(f"{k}_e") - 1 + num(f"{k}_g")
        share = F.when(both >= KNOWN, e / both).otherwise(share)
    end = F.when(word, "word").when(context, "context").when(share < END_SHARE, "sequence").when(share >= USUAL, "usual").otherwise("unknown")
    return rows.select("sig", end.alias("end"))


def find_truncated(df: DataFrame, id_col: str, source_col: str, text_col: str) -> DataFrame:
    """``(<id>, source, evidence)``, one row per distinct id, source and text: ``evidence`` is what tells most of a cut,
    ``word``, ``context`` (the trie), ``sequence``, ``structure``, or ``length`` where an end that says nothing by itself lies at a
    limit; null for a whole text.

    ``source`` is the source in lower case without outer blanks; null stays null and is a source of its own. A null or
    empty (or blank) text is whole: nothing was there to cut. A text of any length is read to its end. Repeated rows
    count once; other columns of ``df``, whatever their names, are left out.
    """
    raw, text = F.col("_raw"), F.col("_text")
    source = df.select(F.col(id_col).alias("_id"), F.lower(F.trim(source_col)).alias("_source"), F.col(text_col).alias("_raw")).withColumn("_text", F.regexp_replace("_raw", r"\s+$", ""))
    # all that is asked of a text is told from its row: texts are moved once only, as the corpus
    line = F.substring_index(text, "\n", -1)
    fence = F.pmod(F.length(text) - F.length(F.replace(text, F.lit("```"), F.lit("``"))), F.lit(2)) == 1
    broken = fence | (F.ltrim(text).startswith("{") & F.try_parse_json(text).isNull()) | (line.startswith("|") & ~line.endswith("|"))
    t, u = F.col("_t"), F.col("_u")
    last = lambda a, k: F.when(F.size(a) >= k, F.element_at(a, -k))
    told = source.withColumn("_bare", _unmarked(text)).withColumn("marked", F.col("_bare") != text)
    told = _with_last_tokens(_with_last_tokens(told, "_t", text), "_u", F.when(F.col("marked"), F.col("_bare")))
    told = told.withColumn("_u", F.coalesce("_u", "_t"))
    rows = told.select(
        "_id", "_source", F.md5("_text").alias("_h"), F.length("_raw").alias("chars"), F.octet_length(F.regexp_replace("_raw", "�$", "?")).alias("bytes"),
        F.when(F.col("marked"), F.length("_bare")).alias("unmarked"), F.coalesce("marked", F.lit(False)).alias("marked"), F.coalesce(broken, F.lit(False)).alias("broken"),
        F.coalesce(~F.col("marked") & F.element_at(t, F.when(F.size(t) > 0, -1)).isin(".", "?", "!"), F.lit(False)).alias("stopped"),
        F.when(_word(last(u, 1)), last(u, 1)).alias("node"), _key(12, last(u, 3), last(u, 2)).alias("c2"), _key(3, last(u, 3), last(u, 2), last(u, 1)).alias("u3"),
        _key(1, last(t, 1)).alias("g1"), _key(2, last(t, 2), last(t, 1)).alias("g2"), _key(3, last(t, 3), last(t, 2), last(t, 1)).alias("g3"),
        (F.length(text) > 0).alias("_filled"),
    )
    sig = F.xxhash64("marked", "node", "c2", "u3", "g1", "g2", "g3")
    rows = checkpointed(rows.withColumn("sig", F.when(F.col("_filled"), sig)).drop("_filled").distinct())
    tails = rows.where(~F.col("stopped") & F.col("sig").isNotNull()).select("sig", "marked", "node", "c2", "u3", "g1", "g2", "g3").distinct()
    asked = tails.select(F.explode(F.array("c2", "u3", "g1", "g2", "g3")).alias("key")).where("key is not null").distinct()
    ends = _verdicts(tails, _tally(source.where(F.length(text) > 0).select("_text").distinct(), asked))
    # how far the texts of a row's length outnumber the usual, by the measure that tells most
    limits = _limits(rows)
    measured = rows
    for m in ("chars", "bytes", "unmarked"):
        of = limits.where(F.col("measure") == m).select(F.col("_source").alias("_s"), F.col("length").alias("_l"), F.col("odds").alias(f"_o_{m}"))
        measured = measured.join(of, F.col("_source").eqNullSafe(F.col("_s")) & (F.col(m) == F.col("_l")), "left").drop("_s", "_l")
    odds = F.least(F.lit(LENGTH_MOST), F.coalesce(F.greatest("_o_chars", "_o_bytes", "_o_unmarked"), F.lit(0.0)))
    end = F.when(F.col("broken"), "structure").when(F.col("stopped"), "stop").otherwise(F.coalesce("end", F.lit("unknown")))
    weight = F.coalesce(*[F.when(F.col("_end") == k, F.lit(w)) for k, w in WEIGHTS.items()])
    cut = (F.lit(PRIOR) + weight + odds > 0) & F.col("sig").isNotNull()
    alone = F.coalesce(*[F.when(F.col("_end") == k, F.lit(PRIOR + w > 0)) for k, w in WEIGHTS.items()])
    return (
        measured.join(ends, "sig", "left")
        .withColumn("_end", end)
        .select(F.col("_id").alias(id_col), F.col("_source").alias("source"), F.when(cut, F.when(alone, F.col("_end")).otherwise("length")).alias("evidence"))
    )


def truncation_by_source(found: DataFrame) -> DataFrame:
    """Per source ``(source, texts, cut, share)`` of :func:`find_truncated`'s rows."""
    return found.groupBy("source").agg(
        F.count("*").alias("texts"), F.count("evidence").alias("cut"), (F.count("evidence") / F.count("*")).alias("share")
    )
