"""Queries of the general data problems (p1, p2, p4, p5) and the SQL they are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import outliers, regrid, shredding, trailing
from ..sources.tables import holding_points, table
from .oracles import BARE_SQL


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return shredding.nested_elements(table(spark, d, "api_responses"))


#: The query of each flat table, and the relation it is.
FLAT = {
    "p1_replies": "reply", "p1_pages": "page", "p1_search_hits": "search", "p1_normalized": "normalized", "p1_redirects": "redirect", "p1_logevents": "logevent",
    "p1_langlinks": "langlink", "p1_revisions": "revision", "p1_entities": "entity", "p1_labels": "label", "p1_descriptions": "description", "p1_sitelinks": "sitelink",
}


def _flat_query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, d: str) -> DataFrame:
        return shredding.flat_table(table(spark, d, "api_responses"), shredding.REPLY, "body", "response_id", FLAT[name])

    query.__name__, query.__doc__ = name, f"The flat table of the relation {FLAT[name]}, singleton descendants inlined, with its key and its parent's."
    return query


def p1_orphans(spark: SparkSession, d: str) -> DataFrame:
    """Rows of every flat table, and those among them whose parent row is missing: none."""
    return shredding.orphans(shredding.flat_tables(table(spark, d, "api_responses"), shredding.REPLY, "body", "response_id"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return trailing.idle_and_peak_days(table(spark, d, "point_cache"))


def p2_trailing(spark: SparkSession, d: str) -> DataFrame:
    out = trailing.trailing_totals(holding_points(table(spark, d, "point_cache")))
    return out.withColumns({"d": F.date_format("day", "yyyyMMdd"), "avg_7": F.round("avg_7", 6), "avg_30": F.round("avg_30", 6)}).drop("day")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return regrid.hours_without_reading(table(spark, d, "live_points"))


def p4_grid(spark: SparkSession, d: str) -> DataFrame:
    return regrid.hourly_grid(table(spark, d, "live_points")).withColumn("value", F.floor(F.col("value") * 1000 + 0.500001) / 1000)


def p4_counter(spark: SparkSession, d: str) -> DataFrame:
    """The readings taken as those of a cumulative counter: what accrued in every hour, and where the counter was reset."""
    points = table(spark, d, "live_points").select("series_id", regrid.moment_of(F.col("d")).alias("at"), "v", "seen_at")
    grid = regrid.regrid(points, "series_id", "at", "v", "seen_at", regrid.COUNTER)
    return grid.select("series_id", F.date_format("cell", "yyyyMMddHH").alias("slot"), "readings", "resets", (F.floor(F.col("value") * 1000 + 0.500001) / 1000).alias("value"), "state")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return outliers.implausible_points(table(spark, d, "point_cache"), table(spark, d, "series_meta"), table(spark, d, "project_totals"))


def p5_impossible(spark: SparkSession, d: str) -> DataFrame:
    """The points beyond a physical limit alone."""
    return p5_found(spark, d).where("kind = 'impossible'").select("series_id", "d")


def p5_stuck(spark: SparkSession, d: str) -> DataFrame:
    """The points in stuck runs alone."""
    return p5_found(spark, d).where("kind = 'stuck'").select("series_id", "d")


QUERIES = {f.__name__: f for f in (p1_found, *map(_flat_query, FLAT), p1_orphans, p2_found, p2_trailing, p4_found, p4_grid, p4_counter, p5_found, p5_impossible, p5_stuck)}

_TRAILING = """
WITH p AS (
  SELECT series_id, try_strptime(substr(regexp_replace(d, '[^0-9]', '', 'g'), 1, 8), '%Y%m%d')::DATE AS day,
         max({'f': fetched_at, 'v': coalesce(v, -9223372036854775807)}) AS m
  FROM point_cache WHERE series_id IS NOT NULL GROUP BY 1, 2),
h AS (SELECT series_id, day, nullif(m.v, -9223372036854775807) AS v FROM p WHERE day IS NOT NULL),
s AS (SELECT series_id, min(day) AS a, max(day) AS b FROM h GROUP BY 1),
x AS (SELECT series_id, unnest(generate_series(a, b, INTERVAL 1 DAY))::DATE AS day FROM s),
y AS (SELECT x.series_id, x.day, h.v, greatest(coalesce(h.v, 0), 0) AS n FROM x LEFT JOIN h USING (series_id, day)),
t AS (SELECT series_id, day, v,
        sum(n) OVER (PARTITION BY series_id ORDER BY day ROWS 6 PRECEDING)::BIGINT AS total_7,
        sum(n) OVER (PARTITION BY series_id ORDER BY day ROWS 29 PRECEDING)::BIGINT AS total_30 FROM y)
"""

_READINGS = r"""
WITH n AS (SELECT series_id, trim(d) AS d, v, seen_at FROM live_points WHERE v IS NOT NULL AND series_id IS NOT NULL),
i AS (SELECT series_id, d, v, seen_at, CASE
    WHEN regexp_full_match(d, '\d{10}') THEN epoch(try_strptime(d || '0000', '%Y%m%d%H%M%S'))
    WHEN regexp_full_match(d, '\d{14}') THEN epoch(try_strptime(d, '%Y%m%d%H%M%S'))
    WHEN regexp_full_match(d, '\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\d(Z|[+-]\d\d:\d\d)?') THEN
      epoch(try_strptime(replace(d[1:19], 'T', ' '), '%Y-%m-%d %H:%M:%S'))
      - CASE WHEN length(d) = 25 THEN (CASE d[20] WHEN '-' THEN -1 ELSE 1 END) * (d[21:22]::INT * 3600 + d[24:25]::INT * 60) ELSE 0 END
    END AS ep FROM n),
"""

_POINTS = """
WITH h AS (
  SELECT series_id, try_strptime(substr(regexp_replace(d, '[^0-9]', '', 'g'), 1, 8), '%Y%m%d')::DATE AS day,
         nullif((max({'f': fetched_at, 'v': coalesce(v, -9223372036854775807)})).v, -9223372036854775807) AS v FROM point_cache WHERE series_id IS NOT NULL GROUP BY 1, 2),
m AS (SELECT series_id, regexp_replace(lower(trim((max({'u': updated, 'p': project})).p)), '\\.org$', '') AS project FROM series_meta GROUP BY 1),
t AS (SELECT regexp_replace(lower(trim(project)), '\\.org$', '') AS project, trim(ym) AS ym, max(v) AS most FROM project_totals WHERE v > 0 GROUP BY 1, 2),
q AS (SELECT h.*, coalesce(v < 0 OR v > most, false) AS bad FROM h LEFT JOIN m USING (series_id) LEFT JOIN t ON t.project = m.project AND t.ym = strftime(day, '%Y%m') WHERE day IS NOT NULL)
"""

_WRAPPED = """
WITH RECURSIVE w AS (
  SELECT DISTINCT response_id, response_id::VARCHAR || '#' || substr(sha256(body), 1, 16) AS id, '' AS trail, body::JSON AS j FROM api_responses WHERE json_valid(body)
  UNION ALL
  SELECT response_id, id, CASE WHEN h.k IS NULL THEN trail WHEN trail = '' THEN h.k ELSE trail || '.' || h.k END, h.j FROM (
    SELECT response_id, id, trail, unnest(CASE
      WHEN json_type(j) = 'VARCHAR' AND coalesce(json_valid(j->>'$'), false) THEN [{'k': NULL::VARCHAR, 'j': (j->>'$')::JSON}]
      WHEN json_type(j) = 'ARRAY' THEN list_transform(range(json_array_length(j)::BIGINT), lambda i: {'k': i::VARCHAR, 'j': json_extract(j, '$[' || i || ']')})
      WHEN json_type(j) = 'OBJECT' AND NOT list_has_any(json_keys(j), ['query', 'entities', 'success', 'batchcomplete']) THEN
        list_transform(json_keys(j), lambda k: {'k': replace(replace(replace(k, '~', '~0'), '/', '~1'), '.', '~2'), 'j': json_extract(j, '$."' || k || '"')})
      ELSE [] END) AS h FROM w)),
reply AS (
  SELECT response_id, id || '/reply:' || trail AS row_id, j FROM w
  WHERE json_type(j) = 'OBJECT' AND list_has_any(json_keys(j), ['query', 'entities', 'success', 'batchcomplete']))"""


def _held(name: str, parent: str, path: str, marks: str, needs: str | None) -> str:
    """The occurrences of an element below its parent: of a list, of one object, or of an object keyed by id."""
    return f""",
{name} AS (SELECT * FROM (
  SELECT response_id, parent_id, h.k, parent_id || '/{name}:' || replace(replace(h.p, '~', '~0'), '/', '~1') AS row_id, h.j FROM (
    SELECT response_id, parent_id, unnest(CASE
      WHEN json_type(v) = 'ARRAY' THEN list_transform(range(json_array_length(v)::BIGINT), lambda i: {{'k': NULL::VARCHAR, 'p': i::VARCHAR, 'j': json_extract(v, '$[' || i || ']')}})
      WHEN json_type(v) = 'OBJECT' AND list_has_any(json_keys(v), [{marks}]) THEN [{{'k': NULL::VARCHAR, 'p': '0', 'j': v}}]
      WHEN json_type(v) = 'OBJECT' THEN list_transform(json_keys(v), lambda k: {{'k': k, 'p': k, 'j': json_extract(v, '$."' || k || '"')}}) ELSE [] END) AS h
    FROM (SELECT response_id, row_id AS parent_id, json_extract(j, '$.{path}') AS v FROM {parent})))
  WHERE json_type(j) = 'OBJECT'{f" AND j->>'$.{needs}' IS NOT NULL" if needs else ''})"""


#: Relation: parent, path, fields by which a bare object is known, field it needs, natural key, columns.
_ELEMENTS = {
    "page": ("reply", "query.pages", "'title', 'ns', 'pageid', 'missing'", "title", "title", "pageid ns title missing length pagelanguage contentmodel pageprops.wikibase_item pageprops.disambiguation pageprops.defaultsort"),
    "search": ("reply", "query.search", "'title', 'pageid'", "title", "title", "ns title pageid size wordcount snippet timestamp"),
    "normalized": ("reply", "query.normalized", "'from', 'to'", "from", "from", "from to fromencoded"),
    "redirect": ("reply", "query.redirects", "'from', 'to'", "from", "from", "from to tofragment"),
    "logevent": ("reply", "query.logevents", "'logid', 'title'", "title", "logid", "logid ns title type action timestamp params.target_ns params.target_title"),
    "langlink": ("page", "langlinks", "'lang', 'title'", "title", "lang", "lang title"),
    "revision": ("page", "revisions", "'timestamp', 'size'", "timestamp", "timestamp", "timestamp size"),
    "entity": ("reply", "entities", "'id', 'sitelinks'", None, "id", "id type"),
    "label": ("entity", "labels", "'language', 'value'", None, "language", "language value"),
    "description": ("entity", "descriptions", "'language', 'value'", None, "language", "language value"),
    "sitelink": ("entity", "sitelinks", "'site', 'title'", "title", "site", "site title"),
}


def _relation_sql(name: str) -> str:
    if name == "reply":
        return _WRAPPED + """
SELECT DISTINCT row_id, NULL::VARCHAR AS parent_id, NULL::VARCHAR AS parent_relation, response_id, NULL::VARCHAR AS natural_key, j->>'$.success' AS success,
  j->>'$.batchcomplete' AS batchcomplete, j->>'$.query.searchinfo.totalhits' AS query_searchinfo_totalhits FROM reply"""
    parent, path, marks, needs, key, columns = _ELEMENTS[name]
    above = "" if parent == "reply" else _held(parent, *_ELEMENTS[parent][:4])
    shown = ", ".join(f"j->>'$.{c}' AS \"{c.replace('.', '_')}\"" for c in columns.split())
    return _WRAPPED + above + _held(name, parent, path, marks, needs) + f"""
SELECT DISTINCT row_id, parent_id, '{parent}' AS parent_relation, response_id, coalesce(j->>'$.{key}', k) AS natural_key, {shown} FROM {name}"""


def _found_sql() -> str:
    parts, above = [], ""
    for name in _ELEMENTS:
        above += _held(name, *_ELEMENTS[name][:4])
    for name in shredding.CASES:
        parent, key = _ELEMENTS[name][0], _ELEMENTS[name][4]
        of = f"coalesce(p.j->>'$.{_ELEMENTS[parent][4]}', p.k, '')" if parent != "reply" else "''"
        source = f"{name} c JOIN {parent} p ON p.row_id = c.parent_id" if parent != "reply" else f"{name} c"
        parts.append(f"SELECT c.response_id, '{name}' AS kind, {of} AS parent, coalesce(c.j->>'$.{key}', c.k) AS item FROM {source}")
    return _WRAPPED + above + "\nSELECT DISTINCT * FROM (" + "\nUNION ALL ".join(parts) + ") WHERE item IS NOT NULL"


def _orphans_sql() -> str:
    names = [*_ELEMENTS]
    above = "".join(_held(n, *_ELEMENTS[n][:4]) for n in names)
    counts = " UNION ALL ".join(
        f"SELECT '{n}' AS relation, count(DISTINCT c.row_id) AS rows, count(DISTINCT c.row_id) FILTER (p.row_id IS NULL) AS orphans FROM {n} c LEFT JOIN {_ELEMENTS[n][0]} p ON p.row_id = c.parent_id" for n in names
    )
    return _WRAPPED + above + f"\nSELECT * FROM ({counts}) WHERE rows > 0"


def _chain_sql() -> str:
    above = "".join(_held(n, *_ELEMENTS[n][:4]) for n in ("page", "normalized", "redirect"))
    return _WRAPPED + above + """,
n AS (SELECT parent_id AS r, j->>'$.from' AS f, j->>'$.to' AS t FROM normalized), e AS (SELECT parent_id AS r, j->>'$.from' AS f, j->>'$.to' AS t FROM redirect),
n1 AS (SELECT r, f, min(t) AS t FROM n GROUP BY 1, 2), e1 AS (SELECT r, f, min(t) AS t FROM e GROUP BY 1, 2),
p AS (SELECT parent_id AS r, j->>'$.title' AS title, bool_and(j->>'$.missing' IS NOT NULL) AS missing, min(j->>'$.pageprops.wikibase_item') AS qid FROM page GROUP BY 1, 2),
a AS (SELECT r, f AS title FROM n UNION SELECT r, f FROM e WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.r = e.r AND n.t = e.f)
  UNION SELECT r, title FROM p WHERE NOT EXISTS (SELECT 1 FROM (FROM n UNION ALL FROM e) x WHERE x.r = p.r AND x.t = p.title))
SELECT a.r AS reply, a.title, coalesce(e1.t, n1.t, a.title) AS canonical, CASE WHEN e1.t IS NOT NULL THEN coalesce(n1.t, a.title) END AS redirected_from, coalesce(p.missing, true) AS missing, p.qid
FROM a LEFT JOIN n1 ON n1.r = a.r AND n1.f = a.title LEFT JOIN e1 ON e1.r = a.r AND e1.f = coalesce(n1.t, a.title) LEFT JOIN p ON p.r = a.r AND p.title = coalesce(e1.t, n1.t, a.title)"""


_STATUS = r""",
l AS (SELECT regexp_extract(parent_id, 'entity:([^/]*)$', 1) AS qid, regexp_replace(j->>'$.site', 'wiki$', '') AS lang, min(j->>'$.title') AS title FROM sitelink GROUP BY 1, 2),
a AS (SELECT qid, unnest(['en', 'de', 'fr', 'es', 'pl', 'it']) AS lang FROM (SELECT DISTINCT qid FROM l)),
c AS (SELECT lang, title, length(title) % 6 AS k, min(qid) AS cq FROM l GROUP BY 1, 2),
s AS (SELECT a.qid, a.lang, l.title, right(a.qid, 1) AS g, k, cq, k = 1 OR (k = 3 AND cq <> a.qid) AS folded FROM a LEFT JOIN l USING (qid, lang) LEFT JOIN c USING (lang, title)),
t AS (SELECT *, f AS folds, CASE WHEN title IS NULL THEN CASE WHEN g BETWEEN '0' AND '3' THEN 'section_only' WHEN g BETWEEN '4' AND '6' THEN 'not_linked_in_wikidata' ELSE 'no_article' END
  WHEN k = 0 THEN 'title_gone' WHEN folded THEN CASE WHEN f THEN 'measures_broader_topic' ELSE 'folded_into_broader_article' END WHEN k = 2 THEN 'disambiguation_page' ELSE 'ok' END AS status FROM s, (SELECT unnest([true, false]) AS f))
SELECT qid, lang, CASE WHEN k IN (1, 3) THEN title || ' (whole)' ELSE title END AS title, status, CASE WHEN status IN ('measures_broader_topic', 'disambiguation_page') THEN status END AS warning,
  CASE WHEN status IN ('folded_into_broader_article', 'measures_broader_topic') THEN title || ' (whole)' WHEN status = 'section_only' THEN qid || '#part' WHEN status = 'not_linked_in_wikidata' THEN qid END AS target, folds FROM t"""
_SENSES = """,
q AS (SELECT j->>'$.title' AS title, bool_and(j->>'$.missing' IS NOT NULL) AS missing, max((j->>'$.length')::BIGINT) AS bytes, min(j->>'$.pageprops.wikibase_item') AS qid,
  bool_or(j->>'$.pageprops.disambiguation' IS NOT NULL) AS dab FROM page GROUP BY 1),
n AS (SELECT *, lower(""" + BARE_SQL.format(c="title") + """) AS topic FROM q),
win AS (SELECT * FROM n WHERE NOT missing AND NOT dab AND qid IS NOT NULL AND qid <> ''
  QUALIFY row_number() OVER (PARTITION BY topic ORDER BY coalesce(bytes, 0) DESC, coalesce(try_cast(regexp_extract(qid, '^[Qq]([0-9]+)$', 1) AS BIGINT), 9007199254740991), title) = 1),
r AS (SELECT n.* FROM n JOIN win USING (topic) WHERE n.topic <> lower(n.title) AND NOT regexp_matches(n.title, '(?i)\\(disambiguation\\)\\s*$') AND n.qid <> win.qid AND NOT n.missing AND NOT n.dab
  AND coalesce(n.bytes, 0) >= least(20000, greatest(1.0, coalesce(win.bytes, 0) * 0.5)) QUALIFY row_number() OVER (PARTITION BY n.topic ORDER BY n.bytes DESC, n.title) <= 3)
SELECT topic, 'winner' AS role, title, qid, bytes FROM win UNION ALL SELECT topic, 'rival', title, qid, bytes FROM r"""


ORACLES = {
    "item_names": _WRAPPED + "".join(_held(n, *_ELEMENTS[n][:4]) for n in ("entity", "label", "description", "sitelink")) + """
SELECT coalesce(e.j->>'$.id', e.k) AS qid, min(l.j->>'$.value') AS label, min(c.j->>'$.value') AS description, coalesce(array_to_string(list_sort(list_distinct(list(s.j->>'$.site'))), ','), '') AS editions
FROM entity e LEFT JOIN label l ON l.parent_id = e.row_id AND l.j->>'$.language' = 'en' LEFT JOIN description c ON c.parent_id = e.row_id AND c.j->>'$.language' = 'en'
LEFT JOIN sitelink s ON s.parent_id = e.row_id WHERE coalesce(e.j->>'$.id', e.k) IS NOT NULL GROUP BY 1""",
    "edition_status": _WRAPPED + "".join(_held(n, *_ELEMENTS[n][:4]) for n in ("entity", "sitelink")) + _STATUS,
    "page_senses": _WRAPPED + _held("page", *_ELEMENTS["page"][:4]) + _SENSES,
    "redirect_chain": _chain_sql(),
    "p1_found": _found_sql(),
    "p1_orphans": _orphans_sql(),
    **{q: _relation_sql(n) for q, n in FLAT.items()},
    "p2_found": _TRAILING
    + """, u AS (SELECT series_id, day, 7 AS span_days, total_7 AS t FROM t UNION ALL SELECT series_id, day, 30, total_30 FROM t),
b AS (SELECT series_id, span_days, max(t) AS m FROM u GROUP BY 1, 2),
e AS (SELECT u.series_id, u.span_days, min(u.day) AS peak FROM u JOIN b USING (series_id, span_days) WHERE u.t = b.m AND b.m > 0 GROUP BY 1, 2)
SELECT series_id, strftime(day, '%Y%m%d') AS d, span_days, 'idle' AS mark FROM u WHERE t = 0
UNION ALL SELECT series_id, strftime(peak, '%Y%m%d'), span_days, 'peak' FROM e""",
    "p2_trailing": _TRAILING
    + """SELECT series_id, strftime(day, '%Y%m%d') AS d, v, total_7, round(total_7 / 7.0, 6)::DOUBLE AS avg_7, total_30, round(total_30 / 30.0, 6)::DOUBLE AS avg_30 FROM t""",
    "p4_found": _READINGS
    + """r AS (SELECT DISTINCT series_id, floor(ep / 3600)::BIGINT AS h FROM i WHERE ep IS NOT NULL),
s AS (SELECT series_id, min(h) AS a, max(h) AS b FROM r GROUP BY 1),
g AS (SELECT series_id, unnest(generate_series(a, b)) AS h FROM s)
SELECT g.series_id, strftime(make_timestamp(g.h * 3600000000), '%Y%m%d%H') AS slot FROM g ANTI JOIN r USING (series_id, h)""",
    "p4_grid": _READINGS
    + """u AS (SELECT series_id, ep, (max({'o': seen_at, 'v': v})).v AS v FROM i WHERE ep IS NOT NULL GROUP BY 1, 2),
x AS (SELECT *, lead(ep) OVER (PARTITION BY series_id ORDER BY ep) AS e1 FROM u),
y AS (SELECT *, unnest(generate_series(floor(ep / 3600)::BIGINT, floor(e1 / 3600)::BIGINT)) AS c FROM x WHERE e1 - ep <= 21600),
w AS (SELECT series_id, c, sum(v * o) AS a, sum(o) AS s FROM (SELECT *, least(e1, (c + 1) * 3600) - greatest(ep, c * 3600) AS o FROM y) GROUP BY 1, 2),
k AS (SELECT series_id, floor(ep / 3600)::BIGINT AS c, count(*) AS readings, arg_max(v, ep) AS last FROM u GROUP BY 1, 2),
g AS (SELECT series_id, unnest(generate_series(min(c), max(c))) AS c FROM k GROUP BY 1),
t AS (
  SELECT g.series_id, g.c, coalesce(readings, 0) AS readings, CASE WHEN readings > 0 THEN coalesce(a / nullif(s, 0), last) WHEN s > 0 THEN a / s END AS value,
         CASE WHEN readings > 0 THEN 'read' WHEN s > 0 THEN 'filled' ELSE 'uncovered' END AS state FROM g LEFT JOIN k USING (series_id, c) LEFT JOIN w USING (series_id, c))
SELECT series_id, strftime(make_timestamp(c * 3600000000), '%Y%m%d%H') AS slot, readings, floor(value * 1000 + 0.500001) / 1000 AS value, state FROM t""",
    "p4_counter": _READINGS
    + """u AS (SELECT series_id, ep, (max({'o': seen_at, 'v': v})).v AS v FROM i WHERE ep IS NOT NULL GROUP BY 1, 2),
x AS (SELECT *, lead(ep) OVER w AS e1, lead(v) OVER w AS v1, lag(v) OVER w AS v0 FROM u WINDOW w AS (PARTITION BY series_id ORDER BY ep)),
y AS (SELECT *, CASE WHEN v1 >= v THEN v1 - v ELSE v1 END AS inc, unnest(generate_series(floor(ep / 3600)::BIGINT, floor(e1 / 3600)::BIGINT)) AS c FROM x WHERE e1 - ep <= 21600),
w AS (SELECT series_id, c, sum(inc * o / (e1 - ep)) AS a, sum(o) AS s FROM (SELECT *, least(e1, (c + 1) * 3600) - greatest(ep, c * 3600) AS o FROM y) GROUP BY 1, 2),
k AS (SELECT series_id, floor(ep / 3600)::BIGINT AS c, count(*) AS readings, count(*) FILTER (v < v0) AS resets FROM x GROUP BY 1, 2),
g AS (SELECT series_id, unnest(generate_series(min(c), max(c))) AS c FROM k GROUP BY 1),
t AS (
  SELECT g.series_id, g.c, coalesce(readings, 0) AS readings, coalesce(resets, 0) AS resets, CASE WHEN readings > 0 THEN coalesce(a, 0) WHEN s > 0 THEN a END AS value,
         CASE WHEN readings > 0 THEN 'read' WHEN s > 0 THEN 'filled' ELSE 'uncovered' END AS state FROM g LEFT JOIN k USING (series_id, c) LEFT JOIN w USING (series_id, c))
SELECT series_id, strftime(make_timestamp(c * 3600000000), '%Y%m%d%H') AS slot, readings, resets, floor(value * 1000 + 0.500001) / 1000 AS value, state FROM t""",
    "p5_impossible": _POINTS + "SELECT series_id, strftime(day, '%Y%m%d') AS d FROM q WHERE bad",
    "p5_stuck": _POINTS
    + """, r AS (SELECT series_id, day, v::DOUBLE AS v FROM q WHERE NOT bad AND v IS NOT NULL),
f AS (SELECT *, coalesce(day - lag(day) OVER w = 1, false) AS follows, lag(v) OVER w AS v0 FROM r WINDOW w AS (PARTITION BY series_id ORDER BY day)),
n AS (SELECT *, sum(CASE WHEN follows AND v = v0 AND v <> 0 THEN 0 ELSE 1 END) OVER (PARTITION BY series_id ORDER BY day) AS run FROM f),
l AS (SELECT *, count(*) OVER (PARTITION BY series_id, run) AS len FROM n),
s AS (SELECT *, CASE WHEN follows AND len < 5 THEN abs(v - v0) END AS step FROM l),
c AS (SELECT series_id, count(*) AS days, 1.4826 * median(step) AS scatter, count(step) AS pairs, count(*) FILTER (step = 0) AS equal FROM s GROUP BY 1),
p AS (SELECT *, least(1, greatest(0.0001, (equal + 0.5) / (pairs + 1.0), CASE WHEN scatter = 0 THEN 1 ELSE 1 / (sqrt(2 * pi()) * scatter) END)) AS p FROM c)
SELECT series_id, strftime(day, '%Y%m%d') AS d FROM s JOIN p USING (series_id) WHERE v <> 0 AND len >= 4 AND days * pow(p::DOUBLE, len - 1) < 0.01""",
}
