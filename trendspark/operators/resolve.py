"""From topics to articles: which of several candidates is meant, how sure that is, and which editions have it.

Everything is done for many topics at once, and no choice depends on the order in which rows arrive.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.text import bare_title, reads_as_sentence, topic_words

#: Sizes from which an article is a rival: half the winner's, at most so much.
RIVAL_SHARE, RIVAL_MOST, RIVALS = 0.5, 20_000, 3
DAB = r"(?i)\(disambiguation\)\s*$"


def item_number(qid: Column) -> Column:
    return F.coalesce(F.regexp_extract(qid, r"^[Qq](\d+)$", 1).try_cast("bigint"), F.lit(9_007_199_254_740_991))


def pick_winner(candidates: DataFrame) -> DataFrame:
    """One row per topic of ``(topic, rank, title, qid, bytes)``: candidates without an item are out; of those that carry the
    topic's very name the longest article wins, then the lesser item; where none carries it, the search rank decides."""
    named = F.lower(bare_title(F.col("title"))) == F.lower(F.trim("topic"))
    rows = candidates.where(F.col("qid").isNotNull() & (F.col("qid") != "")).withColumn("_n", F.coalesce(named, F.lit(False)))
    order = [F.desc("_n"), F.desc(F.when(F.col("_n"), F.coalesce("bytes", F.lit(0)))), F.when(F.col("_n"), item_number(F.col("qid"))), F.col("rank"), F.col("title")]
    return rows.withColumn("_rn", F.row_number().over(W.partitionBy("topic").orderBy(*order))).where("_rn = 1").drop("_rn", "_n")


def competing_senses(topics: DataFrame, titles: DataFrame) -> DataFrame:
    """``(topic, title)``: titles that share the topic's or the winner's bare name and carry a qualifier.

    ``topics``: ``(topic, winner)``; ``titles``: ``(topic, ord, title)``. The winner and disambiguation pages are no senses;
    spellings that differ in case are one.
    """
    key = F.lower(bare_title(F.col("title")))
    small = F.lower("title")
    rows = titles.join(topics.select("topic", F.lower(F.trim("topic")).alias("_q"), F.lower(bare_title(F.coalesce("winner", "topic"))).alias("_k"), F.lower("winner").alias("_w")), "topic")
    rows = rows.where(~F.col("title").rlike(DAB) & ((key == F.col("_q")) | (key == F.col("_k"))) & (key != small) & ~small.eqNullSafe(F.col("_w")))
    first = F.row_number().over(W.partitionBy("topic", small).orderBy("ord", "title"))
    return rows.withColumn("_rn", first).where("_rn = 1").select("topic", "ord", "title")


def rival_articles(links: DataFrame, winners: DataFrame) -> DataFrame:
    """Up to three rivals per topic by size: linked pages ``(topic, title, qid, bytes, missing, is_disambig)`` that exist, have an
    item other than the winner's, and at least half the winner's size (or 20,000)."""
    rows = links.join(winners.select("topic", F.col("qid").alias("_q"), F.col("bytes").alias("_b")), "topic")
    floor = F.least(F.lit(RIVAL_MOST), F.greatest(F.lit(1.0), F.coalesce("_b", F.lit(0)) * RIVAL_SHARE))
    rows = rows.where(F.col("qid").isNotNull() & (F.col("qid") != F.col("_q")) & ~F.coalesce("missing", F.lit(False)) & ~F.coalesce("is_disambig", F.lit(False)) & (F.coalesce("bytes", F.lit(0)) >= floor))
    rn = F.row_number().over(W.partitionBy("topic").orderBy(F.desc("bytes"), "title"))
    return rows.withColumn("_rn", rn).where(F.col("_rn") <= RIVALS).drop("_q", "_b", "_rn")


def match_confidence(matches: DataFrame) -> DataFrame:
    """``matches`` ``(query, via, title, label, senses array<string>)`` with ``hits``, ``coverage`` and ``confidence``."""
    q, t = topic_words(F.col("query")), F.array_union(topic_words(F.coalesce("title", F.lit(""))), topic_words(F.coalesce("label", F.lit(""))))
    rows = matches.withColumns({"_q": q, "_t": t}).withColumn("hits", F.filter("_q", lambda w: F.array_contains(F.col("_t"), w)))
    rows = rows.withColumn("coverage", F.coalesce(F.try_divide(F.size("hits"), F.size("_q")), F.lit(0.0)))
    rivals = F.coalesce(F.size("senses"), F.lit(0)) > 0
    level = (
        F.when(F.col("via") == "exact-title", F.when(rivals, "medium").otherwise("high"))
        .when(reads_as_sentence(F.col("query")) | (F.size("hits") == 0) | (F.col("coverage") < 0.5), "low")
        .otherwise("medium")
    )
    return rows.withColumn("confidence", level).drop("_q", "_t")


#: Hits and items a topic is looked for in, other candidates that are named.
HITS, ITEMS, OTHERS = 10, 5, 3


def disambiguation_pages(returned: DataFrame) -> DataFrame:
    """``(topic, dab)``: of the pages ``returned`` for a topic, ``(topic, rank, title, missing, is_disambig)``, the first that lists its senses."""
    there = returned.where(~F.coalesce("missing", F.lit(False)) & F.coalesce("is_disambig", F.lit(False)))
    return there.groupBy("topic").agg(F.min_by("title", F.struct("rank", "title")).alias("dab"))


def dab_senses(winners: DataFrame, dabs: DataFrame, links: DataFrame) -> DataFrame:
    """``(topic, title, qid, bytes)``: up to three rivals of each winner ``(topic, title, qid, bytes)`` among the pages that the topic's
    disambiguation page links, ``links`` ``(topic, title, qid, bytes, missing, is_disambig)``: those whose titles claim the topic's name."""
    topics = winners.join(dabs, "topic").select("topic", F.col("dab").alias("winner"))
    names = competing_senses(topics, links.select("topic", F.lit(0).alias("ord"), "title")).select("topic", F.lower("title").alias("_t"))
    claim = links.join(names, (links.topic == names.topic) & (F.lower(links.title) == F.col("_t")), "left_semi")
    return rival_articles(claim, winners).select("topic", "title", "qid", "bytes")


def find_entities(topics: DataFrame, pages: DataFrame, search: DataFrame, items: DataFrame, returned: DataFrame | None = None) -> DataFrame:
    """``(topic, via, title, qid, bytes, others)`` by the first route that has an answer: a page of that very title (else the first
    page ``returned`` for it), the best of ten search hits, an item label; ``via`` is null for a topic no route knows. ``others``: the
    titles of up to three more candidates of the route.

    ``topics``: ``(topic)``; ``pages``: ``(title, missing, bytes, qid, is_disambig)``; ``search``: ``(topic, rank, title)``; ``items``: ``(label, qid)``;
    ``returned``: ``(topic, rank, title)``. A title that is a disambiguation page falls through to the search.
    """
    usable = pages.where(F.col("qid").isNotNull() & ~F.coalesce("missing", F.lit(False)) & ~F.coalesce("is_disambig", F.lit(False)))
    small = usable.withColumn("_k", F.lower("title"))
    exact = topics.withColumn("_k", F.lower(F.trim("topic"))).join(small, "_k").withColumn("rank", F.lit(0)).select("topic", "rank", "title", "qid", "bytes")
    if returned is not None:
        first = returned.where(~F.col("title").rlike(DAB)).join(pages.where(~F.coalesce("missing", F.lit(False))).select("title"), "title", "left_semi")
        first = first.groupBy("topic").agg(F.min_by("title", F.struct("rank", "title")).alias("title")).join(usable, "title")
        exact = exact.unionByName(first.join(exact.select("topic"), "topic", "left_anti").select("topic", F.lit(1).alias("rank"), "title", "qid", "bytes"))
    hits = search.where(F.col("rank") <= HITS).join(usable, "title").select("topic", "rank", "title", "qid", "bytes")
    by_label = items.withColumn("_n", F.row_number().over(W.partitionBy(F.lower("label")).orderBy(item_number(F.col("qid"))))).where(F.col("_n") <= ITEMS)
    labelled = topics.join(by_label.select(F.lower("label").alias("_k"), F.col("label").alias("title"), "qid", F.col("_n").alias("rank")), F.lower(F.trim("topic")) == F.col("_k"))
    labelled = labelled.select("topic", "rank", "title", "qid", F.lit(0).cast("bigint").alias("bytes"))
    routes = None
    for k, (via, df) in enumerate((("exact-title", exact), ("search", hits), ("entity-search", labelled))):
        won = pick_winner(df)
        rest = df.join(won.select("topic", F.col("title").alias("_w"), F.col("qid").alias("_q")), "topic").where((F.col("title") != F.col("_w")) | (F.col("qid") != F.col("_q")))
        rest = rest.withColumn("_n", F.row_number().over(W.partitionBy("topic").orderBy("rank", "title"))).where(F.col("_n") <= OTHERS)
        rest = rest.groupBy("topic").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "title"))), lambda x: x["title"]).alias("others"))
        part = won.join(rest, "topic", "left").select("topic", F.struct(F.lit(k).alias("o"), F.lit(via).alias("via"), "title", "qid", "bytes", F.coalesce("others", F.array().cast("array<string>")).alias("others")).alias("_r"))
        routes = part if routes is None else routes.unionByName(part)
    best = routes.groupBy("topic").agg(F.min_by("_r", "_r.o").alias("_r"))
    return topics.join(best, "topic", "left").select("topic", "_r.via", "_r.title", "_r.qid", "_r.bytes", "_r.others")


def asked_titles(normalized: DataFrame, redirects: DataFrame, pages: DataFrame) -> DataFrame:
    """``(lang, title)`` a reply was asked for: titles it normalized, titles it redirected that are no normalized
    form, and pages that neither led to."""
    to = lambda df: df.select("lang", F.col("to_title").alias("title"))
    of = lambda df: df.select("lang", F.col("from_title").alias("title"))
    first = of(redirects).join(to(normalized), ["lang", "title"], "left_anti")
    direct = pages.select("lang", "title").join(to(normalized).unionByName(to(redirects)), ["lang", "title"], "left_anti")
    return of(normalized).unionByName(first).unionByName(direct).distinct()


def follow_titles(asked: DataFrame, normalized: DataFrame, redirects: DataFrame, pages: DataFrame) -> DataFrame:
    """``asked`` ``(lang, title)`` through normalisation and redirect to its page: adds ``canonical``, ``redirected_from``,
    ``missing``, ``bytes``, ``qid``, ``is_disambig``. A title that no table knows is missing."""
    n = normalized.select("lang", F.col("from_title").alias("title"), F.col("to_title").alias("_n"))
    r = redirects.select("lang", F.col("from_title").alias("_n"), F.col("to_title").alias("_r"))
    p = pages.select("lang", F.col("title").alias("canonical"), "missing", "bytes", "qid", "is_disambig")
    rows = asked.join(n, ["lang", "title"], "left").withColumn("_n", F.coalesce("_n", "title")).join(r, ["lang", "_n"], "left")
    rows = rows.withColumn("canonical", F.coalesce("_r", "_n")).join(p, ["lang", "canonical"], "left")
    return rows.withColumn("redirected_from", F.when(F.col("_r").isNotNull(), F.col("_n"))).withColumn("missing", F.col("missing").isNull() | F.col("missing")).drop("_n", "_r")


def resolve_editions(asked: DataFrame, sitelinks: DataFrame, langlinks: DataFrame, checked: DataFrame, allow_fold: bool = False) -> DataFrame:
    """Every asked ``(topic, qid, lang)`` exactly once, with ``title`` and ``status``: ``ok``, ``measures_broader_topic``, ``disambiguation_page``
    (both measured, with a warning), or a reason why it is not measured: ``title_gone``, ``folded_into_broader_article``, ``section_only``,
    ``not_linked_in_wikidata``, ``no_article``.

    ``sitelinks``: ``(qid, lang, title)``; ``langlinks``: ``(topic, lang, title)`` of the source article; ``checked``: :func:`follow_titles`.
    """
    c = checked.select("lang", "title", "canonical", "redirected_from", "missing", "bytes", F.col("qid").alias("_cq"), "is_disambig")
    rows = asked.join(sitelinks, ["qid", "lang"], "left").join(langlinks.select("topic", "lang", F.col("title").alias("_ll")), ["topic", "lang"], "left").join(c, ["lang", "title"], "left")
    folded = F.col("redirected_from").isNotNull() & F.col("_cq").isNotNull() & (F.col("_cq") != F.col("qid"))
    status = (
        F.when(F.col("title").isNull(), F.when(F.col("_ll").contains("#"), "section_only").when(F.col("_ll").isNotNull(), "not_linked_in_wikidata").otherwise("no_article"))
        .when(F.col("canonical").isNotNull() & F.col("missing"), "title_gone")
        .when(folded, "measures_broader_topic" if allow_fold else "folded_into_broader_article")
        .when(F.coalesce("is_disambig", F.lit(False)), "disambiguation_page")
        .otherwise("ok")
    )
    rows = rows.withColumn("status", status)
    warning = F.when(F.col("status").isin("measures_broader_topic", "disambiguation_page"), F.col("status"))
    target = F.when(F.col("status").isin("folded_into_broader_article", "measures_broader_topic"), F.col("canonical")).when(F.col("status").isin("section_only", "not_linked_in_wikidata"), F.col("_ll"))
    return rows.select("topic", "qid", "lang", F.coalesce("canonical", "title").alias("title"), "bytes", "redirected_from", "status", warning.alias("warning"), target.alias("target"))


MEASURED = ("ok", "measures_broader_topic", "disambiguation_page")


@dataclass(frozen=True)
class Wiki:
    """What is known of pages and items: ``pages`` ``(title, missing, bytes, qid, is_disambig)`` of the language topics are named in, ``returned``
    ``(topic, rank, title)``, ``search`` ``(topic, rank, title)``, ``items`` ``(label, qid)``, ``dab_links`` ``(topic, title, qid, bytes, missing, is_disambig)``,
    ``sitelinks`` ``(qid, lang, title)``, ``langlinks`` ``(topic, lang, title)``, ``checked``: :func:`follow_titles` of the editions."""

    pages: DataFrame
    returned: DataFrame
    search: DataFrame
    items: DataFrame
    dab_links: DataFrame
    sitelinks: DataFrame
    langlinks: DataFrame
    checked: DataFrame


def resolve_topics(topics: DataFrame, langs: list[str], wiki: Wiki, verify: bool = True, allow_fold: bool = False) -> tuple[DataFrame, DataFrame]:
    """Topics to articles, the whole way: entities ``(topic, via, title, qid, bytes, others, label, senses, hits, coverage, confidence)``, one row a topic,
    and editions as of :func:`resolve_editions`, one row for every topic that has an item and every language. ``verify``: whether
    titles are followed to their pages."""
    found = find_entities(topics, wiki.pages, wiki.search, wiki.items, wiki.returned)
    dabs = disambiguation_pages(wiki.returned.join(wiki.pages.select("title", "missing", "is_disambig"), "title"))
    senses = dab_senses(found.where("qid is not null").select("topic", "title", "qid", "bytes"), dabs, wiki.dab_links)
    senses = senses.groupBy("topic").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.coalesce("bytes", F.lit(0))).alias("b"), "title"))), lambda x: x["title"]).alias("senses"))
    labels = wiki.items.groupBy("qid").agg(F.min("label").alias("label"))
    rows = found.join(labels, "qid", "left").join(senses, "topic", "left").withColumns({"senses": F.coalesce("senses", F.array().cast("array<string>")), "query": F.col("topic")})
    entities = match_confidence(rows.withColumn("via", F.coalesce("via", F.lit("none")))).withColumn("via", F.nullif("via", F.lit("none"))).drop("query")
    asked = found.where("qid is not null").select("topic", "qid", F.explode(F.array(*[F.lit(x) for x in langs]).cast("array<string>")).alias("lang"))
    checked = wiki.checked if verify else wiki.checked.where("false")
    return entities, resolve_editions(asked, wiki.sitelinks, wiki.langlinks, checked, allow_fold)
