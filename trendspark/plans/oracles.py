"""The SQL that the queries of :mod:`reference` are compared with: plain formulations over the same tables."""

from __future__ import annotations

from ..functions.text import QUALIFIER, STOPWORDS
from ..operators.quality import RULES

def _rd(x: str, k: int) -> str:
    """``x`` to ``k`` decimals: the digits of the exact binary value, rounded as a decimal number."""
    return f"round(printf('%.25f', ({x})::DOUBLE)::DECIMAL(38, 25), {k})::DOUBLE"


# Building blocks, each a chain of common table expressions that uses the ones before.
_DAILY = """
p AS (
  SELECT series_id, try_strptime(substr(regexp_replace(d, '[^0-9]', '', 'g'), 1, 8), '%Y%m%d')::DATE AS day,
         max({'f': fetched_at, 'v': coalesce(v, -9223372036854775807)}) AS m
  FROM point_cache WHERE series_id IS NOT NULL GROUP BY 1, 2),
h AS (SELECT series_id, day, nullif(m.v, -9223372036854775807) AS v FROM p WHERE day IS NOT NULL),
span AS (SELECT series_id, min(day) AS a, max(day) AS b FROM h GROUP BY 1),
axis AS (SELECT series_id, unnest(generate_series(a, b, INTERVAL 1 DAY))::DATE AS day FROM span),
daily AS (SELECT axis.series_id, axis.day, h.v AS views FROM axis LEFT JOIN h USING (series_id, day))"""
_MONTHLY = """
monthly AS (
  SELECT series_id, date_trunc('month', day)::DATE AS month, coalesce(sum(views), 0)::BIGINT AS views, count(*) AS days_present,
         count(*) - count(views) AS days_missing, count(*) = day(last_day(min(day))) AS complete
  FROM daily GROUP BY 1, 2)"""
_META = """
meta AS (
  SELECT series_id, regexp_replace(lower(trim(m.project)), '\\.org$', '') AS project, m.title AS title, m.access AS access, m.agent AS agent,
         m.granularity AS granularity, m.covered_from AS covered_from, m.covered_to AS covered_to
  FROM (SELECT series_id, arg_max({'project': project, 'title': title, 'access': access, 'agent': agent, 'granularity': granularity,
        'covered_from': covered_from, 'covered_to': covered_to}, updated) AS m FROM series_meta GROUP BY 1))"""
_TOTALS = """
totals AS (
  SELECT regexp_replace(lower(trim(project)), '\\.org$', '') AS project, strptime(ym || '01', '%Y%m%d')::DATE AS month, max(v) AS project_views
  FROM project_totals WHERE v IS NOT NULL AND project IS NOT NULL GROUP BY 1, 2)"""
_NORMAL = f"""
normal AS (
  SELECT n.*, t.project_views,
         CASE WHEN n.complete AND t.project_views > 0 THEN {_rd('n.views / t.project_views * 1e6', 4)} END AS per_million
  FROM (SELECT monthly.*, meta.project FROM monthly JOIN meta USING (series_id)) n LEFT JOIN totals t USING (project, month))"""
_MEDIAN = """
med90 AS (
  SELECT series_id, median(coalesce(views, 0))::DOUBLE AS median_daily
  FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY day DESC) AS rn FROM daily) WHERE rn <= 90 GROUP BY 1)"""
_COMPARE = """
numbered AS (
  SELECT *, CASE WHEN complete THEN row_number() OVER (PARTITION BY series_id, complete ORDER BY month DESC) END AS rn FROM normal),
blocks AS (
  SELECT series_id, count(*) FILTER (complete) AS months_available,
    min(month) FILTER (rn BETWEEN 7 AND 12) AS pf, max(month) FILTER (rn BETWEEN 7 AND 12) AS pt, min(month) FILTER (rn <= 6) AS rf, max(month) FILTER (rn <= 6) AS rt,
    sum(days_missing) FILTER (rn <= 12)::BIGINT AS days_missing, sum(views) FILTER (rn BETWEEN 7 AND 12)::BIGINT AS p, sum(views) FILTER (rn <= 6)::BIGINT AS r,
    sum(project_views) FILTER (rn BETWEEN 7 AND 12) AS ptot, sum(project_views) FILTER (rn <= 6) AS rtot,
    count(*) FILTER (rn <= 12 AND NOT coalesce(project_views > 0, false)) AS gaps
  FROM numbered GROUP BY 1),
compared AS (
  SELECT *, months_available >= 12 AS enough, months_available >= 12 AND gaps = 0 AS known,
         p * 1e6 / nullif(ptot, 0) AS np, r * 1e6 / nullif(rtot, 0) AS nr FROM blocks)"""
_SPIKES = f"""
dz AS (SELECT *, ln(1 + greatest(coalesce(views, 0), 0)::DOUBLE) AS x FROM daily),
dm AS (SELECT series_id, median(x) AS med, median(coalesce(views, 0)) AS mv, count(*) AS n FROM dz GROUP BY 1),
da AS (SELECT series_id, median(abs(x - med)) AS mad FROM dz JOIN dm USING (series_id) GROUP BY 1),
dj AS (SELECT dz.*, dm.mv, dm.n, CASE WHEN mad > 0 THEN 0.6745::DOUBLE * (x - med) / mad END AS z, mad FROM dz JOIN dm USING (series_id) JOIN da USING (series_id)),
dh AS (SELECT *, CASE WHEN mad > 0 THEN z > 3.5 ELSE mv >= 1 AND coalesce(views, 0) >= greatest(4 * mv, mv + 1) END AS hit FROM dj),
dc AS (SELECT *, count(*) FILTER (hit) OVER (PARTITION BY series_id) AS hits FROM dh),
spikes AS (SELECT series_id, day, views, {_rd('z', 1)} AS z FROM dc WHERE hit AND hits <= greatest(5, floor(0.05::DOUBLE * n + 0.5))),
shares AS (
  SELECT a.series_id, coalesce(b.n, 0) AS spike_days, CASE WHEN a.t > 0 THEN {_rd('coalesce(b.v, 0) / a.t', 3)} ELSE 0.0 END AS spike_share
  FROM (SELECT series_id, coalesce(sum(views), 0) AS t FROM daily GROUP BY 1) a
  LEFT JOIN (SELECT series_id, count(*) AS n, sum(views) AS v FROM spikes GROUP BY 1) b USING (series_id))"""
_SPLIT = f"""
cm AS (
  SELECT series_id, month, views, ln(1 + greatest(views, 0)::DOUBLE) AS x, row_number() OVER w AS i, count(*) OVER (PARTITION BY series_id) AS n
  FROM monthly WHERE complete WINDOW w AS (PARTITION BY series_id ORDER BY month)),
cs AS (
  SELECT *, avg(x) OVER (PARTITION BY series_id ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
          - avg(x) OVER (PARTITION BY series_id ORDER BY month ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS diff FROM cm),
split AS (
  SELECT series_id, k, d FROM (
    SELECT series_id, i - 1 AS k, abs(diff) AS d, row_number() OVER (PARTITION BY series_id ORDER BY round(abs(diff), 10) DESC, i) AS rn
    FROM cs WHERE n >= 10 AND i - 1 BETWEEN 4 AND n - 4) WHERE rn = 1),
lists AS (SELECT series_id, array_agg(x ORDER BY month) AS xs, array_agg(views ORDER BY month) AS vs, array_agg(month ORDER BY month) AS ms, count(*) AS n FROM cm GROUP BY 1),
parts AS (
  SELECT series_id, k, d, n, vs, ms, list_aggregate(xs[greatest(1, k - 2):k], 'median') AS b, list_aggregate(xs[k + 1:k + 3], 'median') AS a,
         list_aggregate(xs[1:3], 'median') - list_aggregate(xs[n - 2:n], 'median') AS total FROM split JOIN lists USING (series_id)),
breaks AS (
  SELECT series_id, ms[k + 1] AS month, CASE WHEN b - a > 0 THEN 'drop' ELSE 'rise' END AS direction, {_rd('exp(abs(b - a))', 1)} AS ratio,
         {_rd('(b - a) / total', 2)} AS share_of_total_change, floor(exp(b) - 1 + 0.5)::BIGINT AS before, floor(exp(a) - 1 + 0.5)::BIGINT AS after
  FROM parts WHERE list_max(vs) >= 100 AND total <> 0 AND (b - a) / total >= 0.6 AND exp(abs(b - a)) >= 1.8
    AND CASE WHEN b - a > 0 THEN list_max(vs[k + 1:n]) < list_min(vs[1:k]) ELSE list_min(vs[k + 1:n]) > list_max(vs[1:k]) END)"""
_MSPIKE = f"""
mm AS (SELECT series_id, median(x) AS med, median(views) AS mv, count(*) AS n, sum(views) AS t FROM cm GROUP BY 1),
ma AS (SELECT series_id, median(abs(x - med)) AS mad FROM cm JOIN mm USING (series_id) GROUP BY 1),
mz AS (
  SELECT cm.series_id, cm.month, cm.views, {_rd('q', 1)} AS z, mv, t
  FROM (SELECT cm.*, mm.mv, mm.t, 0.6745::DOUBLE * (x - med) / mad AS q FROM cm JOIN mm USING (series_id) JOIN ma USING (series_id) WHERE mm.n >= 6 AND mad > 0) cm),
mspikes AS (
  SELECT series_id, string_agg(strftime(month, '%Y%m'), ',' ORDER BY month) AS months, count(*)::INT AS n,
         coalesce({_rd('sum(views) / nullif(max(t), 0)', 3)}, 0.0) AS share
  FROM mz WHERE z > 3.5 OR (mv > 0 AND views >= 4 * mv) GROUP BY 1 HAVING count(*) <= 3)"""


def _sensitivity(n: int) -> str:
    return f"""
sa AS (
  SELECT d.series_id, d.day, coalesce(d.views, 0) AS v, s.day IS NOT NULL AS hit, count(*) OVER (PARTITION BY d.series_id) AS n,
         count(s.day) OVER (PARTITION BY d.series_id) AS hits, row_number() OVER (PARTITION BY d.series_id ORDER BY d.day DESC) AS rn
  FROM daily d LEFT JOIN spikes s ON s.series_id = d.series_id AND s.day = d.day),
sf AS (SELECT series_id, median(v) AS fill FROM sa WHERE NOT hit GROUP BY 1),
ss AS (
  SELECT series_id, sum(CASE WHEN hit THEN fill ELSE v END) FILTER (rn <= {n}) AS r, sum(CASE WHEN hit THEN fill ELSE v END) FILTER (rn BETWEEN {n + 1} AND {2 * n}) AS p
  FROM sa JOIN sf USING (series_id) WHERE hits > 0 AND n >= {2 * n} GROUP BY 1),
sensitive AS (SELECT series_id, CASE WHEN p > 0 THEN {_rd('(r / p - 1) * 100', 1)} END AS yoy_excl_spikes FROM ss)"""


_EVIDENCE = """
logs AS (SELECT DISTINCT series_id, updated AS ts, 'meta/' || coalesce(granularity, '') AS kind FROM series_meta),
le AS (
  SELECT series_id, count(*) AS events, string_agg(DISTINCT kind, ', ') AS kinds FROM breaks b JOIN logs USING (series_id)
  WHERE ts >= b.month - INTERVAL 2 MONTH AND ts < b.month + INTERVAL 2 MONTH GROUP BY 1),
re AS (
  SELECT b.series_id, count(*) AS edits FROM breaks b JOIN point_cache q USING (series_id)
  WHERE q.fetched_at >= b.month - INTERVAL 2 MONTH AND q.fetched_at < b.month + INTERVAL 2 MONTH GROUP BY 1),
evidence AS (
  SELECT b.series_id, b.month, CASE WHEN le.events > 0 THEN 'article_event' WHEN re.edits > 0 THEN 'edits_only' ELSE 'no_activity' END AS cause,
         coalesce(le.events, 0) AS events, coalesce(le.kinds, '') AS kinds FROM breaks b LEFT JOIN le USING (series_id) LEFT JOIN re USING (series_id))"""
_FIRES = {
    "no_signal": "med < 1", "very_low_volume": "med >= 1 AND med < 10", "low_volume": "med >= 10 AND med < 50", "monthly_spike": "ms IS NOT NULL", "spike_heavy": "spike_share > 0.2",
    "changepoint_article_event": "cp IS NOT NULL AND cause IS NOT DISTINCT FROM 'article_event'", "changepoint_unexplained": "cp IS NOT NULL AND cause IS DISTINCT FROM 'article_event'",
    "spike_sign_flip": "sign(ex) <> sign(yoy)", "sparse": "missing > 0.1", "short_history": "months < 24",
}
_RATED = """
signals AS (
  SELECT d.series_id, d.share AS missing, coalesce(m.median_daily, 0) AS med, s.spike_share, sensitive.yoy_excl_spikes AS ex, lists.n AS months, b.month AS cp, e.cause,
         ms.n AS ms, CASE WHEN c.enough AND c.p > 0 THEN (c.r::DOUBLE / c.p - 1) * 100 END AS yoy
  FROM (SELECT series_id, (count(*) - count(views)) / count(*) AS share FROM daily GROUP BY 1) d LEFT JOIN med90 m USING (series_id) LEFT JOIN shares s USING (series_id)
  LEFT JOIN sensitive USING (series_id) LEFT JOIN (SELECT series_id, count(*) FILTER (complete) AS n FROM normal GROUP BY 1) lists USING (series_id) LEFT JOIN breaks b USING (series_id)
  LEFT JOIN evidence e USING (series_id) LEFT JOIN mspikes ms USING (series_id) LEFT JOIN compared c USING (series_id)),
fired AS (
  SELECT series_id, list_filter([""" + ", ".join(f"CASE WHEN {_FIRES[r]} THEN {{'id': '{r}', 'c': {c}::DOUBLE, 'q': {str(q).lower()}}} END" for r, c, q in RULES) + """], lambda r: r IS NOT NULL) AS rules FROM signals),
scored AS (
  SELECT series_id, rules, """ + _rd("greatest(0.0, list_reduce(list_prepend(1.0::DOUBLE, list_transform(rules, lambda r: r.c)), lambda x, y: x - y))", 2) + """ AS score,
         coalesce(list_bool_or(list_transform(rules, lambda r: r.q)), false) AS out FROM fired),
rated AS (
  SELECT series_id, CASE WHEN out THEN 'low' WHEN score >= 0.7 THEN 'high' WHEN score >= 0.4 THEN 'medium' ELSE 'low' END AS confidence, score,
         coalesce(array_to_string(list_transform(rules, lambda r: r.id), ','), '') AS reasons, len(rules) AS n FROM scored)"""


def _with(*parts: str) -> str:
    return "WITH " + ",".join(parts) + "\n"


_ALL = (_DAILY, _MONTHLY, _META, _TOTALS, _NORMAL, _MEDIAN, _COMPARE, _SPIKES, _SPLIT, _MSPIKE, _sensitivity(365), _EVIDENCE, _RATED)
_ROUND = "sign({x}) * floor(abs({x}) * 1e6 + 0.5) / 1e6"


def _r6(x: str) -> str:
    return _ROUND.format(x=f"({x})")


_WORDS = ", ".join(f"'{w}'" for w in STOPWORDS)
_TOKENS = r"list_filter(string_split(regexp_replace(lower({c}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'), ' '), lambda w: length(w) >= 2 AND NOT list_contains([{w}], w))"
BARE_SQL = "trim(regexp_replace({c}, '" + QUALIFIER.replace("{", "{{").replace("}", "}}") + "', ''))"
_NUM = r"list_transform(regexp_extract_all(text, '-?[0-9][0-9,]*(?:\.[0-9]+)?'), lambda x: replace(x, ',', '')::DOUBLE)"

_INJECTED = _DAILY.replace("daily AS (SELECT axis.series_id, axis.day, h.v AS views FROM", """daily AS (SELECT axis.series_id, axis.day,
  floor(h.v * CASE WHEN axis.day < DATE '2024-06-01' THEN 1.0::DOUBLE WHEN series_id[1] BETWEEN '0' AND '5' THEN 10.0::DOUBLE WHEN series_id[1] BETWEEN 'a' AND 'f' THEN 0.1::DOUBLE ELSE 1.0::DOUBLE END
    * CASE WHEN axis.day = DATE '2023-03-15' THEN 50 ELSE 1 END + 0.5)::BIGINT AS views FROM""")

#: The days of the window, for every daily series on record.
_WINDOW = _DAILY.replace("daily AS (SELECT axis.series_id", "whole AS (SELECT axis.series_id") + """,
daily AS (SELECT s.series_id, s.day, h.v AS views FROM (
  SELECT series_id, unnest(generate_series(DATE '2023-08-01', DATE '2025-07-31', INTERVAL 1 DAY))::DATE AS day FROM meta WHERE granularity = 'daily') s LEFT JOIN h USING (series_id, day))"""
_COMPARE_12 = _COMPARE.replace("BETWEEN 7 AND 12", "BETWEEN 13 AND 24").replace("rn <= 12", "rn <= 24").replace("rn <= 6", "rn <= 12").replace("months_available >= 12", "months_available >= 24")
_SPARK = """
bars AS (SELECT m.series_id, CASE WHEN max(t) <= 0 THEN repeat('▁', count(*)) ELSE
string_agg(substr('▁▂▃▄▅▆▇█', greatest(0, least(7, floor(views / nullif(t, 0) * 7 + 0.5)))::INT + 1, 1), '' ORDER BY month) END AS sparkline
FROM monthly m JOIN (SELECT series_id, max(views) AS t FROM monthly GROUP BY 1) USING (series_id) GROUP BY 1)"""

ORACLES = {
    "views_report": _with(_META, _WINDOW, _MONTHLY, _TOTALS, _NORMAL, _MEDIAN, _COMPARE_12, _SPIKES, _SPLIT, _MSPIKE, _sensitivity(90), _EVIDENCE, _RATED, _SPARK) + f"""SELECT series_id, regexp_extract(project, '^([^.]+)', 1) AS lang, title, median_daily,
n.days_missing, sparkline, confidence, score, reasons, strftime(b.month, '%Y%m') AS break_ym, e.cause, spike_share, NOT enough AS too_short, CASE WHEN enough THEN p END AS raw_prior, CASE WHEN enough THEN r END AS raw_recent,
CASE WHEN enough AND p > 0 THEN {_rd('(r::DOUBLE / p - 1) * 100', 1)} END AS raw_yoy, CASE WHEN known THEN floor(np * 1e4 + 0.5) / 1e4 END AS norm_prior, CASE WHEN known THEN floor(nr * 1e4 + 0.5) / 1e4 END AS norm_recent,
CASE WHEN known AND np > 0 THEN sign(nr / np - 1) * floor(abs((nr / np - 1) * 100) * 1e4 + 0.5) / 1e4 END AS norm_yoy
FROM (SELECT * FROM meta WHERE granularity = 'daily') m LEFT JOIN med90 USING (series_id) LEFT JOIN rated USING (series_id) LEFT JOIN bars USING (series_id) LEFT JOIN breaks b USING (series_id)
LEFT JOIN evidence e USING (series_id) LEFT JOIN shares USING (series_id) LEFT JOIN compared USING (series_id)
LEFT JOIN (SELECT series_id, count(*) - count(views) AS days_missing FROM daily GROUP BY 1) n USING (series_id)""",
    "injected_breaks": _with(_INJECTED, _MONTHLY, _SPLIT, _EVIDENCE) + """SELECT b.series_id, strftime(b.month, '%Y%m') AS ym, direction, ratio, share_of_total_change, before, after, cause, events
FROM breaks b JOIN evidence e USING (series_id)""",
    "injected_spikes": _with(_INJECTED, _SPIKES) + "SELECT series_id, spike_days, spike_share FROM shares",
    "injected_rubric": _with(_INJECTED, *_ALL[1:]) + "SELECT series_id, confidence, score, reasons, e.cause FROM rated LEFT JOIN evidence e USING (series_id)",
    "reindex_daily": _with(_DAILY) + "SELECT series_id, strftime(day, '%Y%m%d') AS d, views FROM daily",
    "reindex_window": _with(_DAILY) + """SELECT s.series_id, count(*) AS days, count(*) - count(h.v) AS days_missing, count(*) FILTER (h.v = 0) AS days_zero
FROM (SELECT series_id, unnest(generate_series(DATE '2023-08-01', DATE '2025-07-31', INTERVAL 1 DAY))::DATE AS day FROM span) s LEFT JOIN h USING (series_id, day) GROUP BY 1""",
    "series_header": _with(_DAILY) + """SELECT series_id, strftime(min(day), '%Y%m%d') AS first_day, strftime(max(day), '%Y%m%d') AS last_day, count(*) AS days,
count(*) - count(views) AS days_missing, count(*) FILTER (views = 0) AS days_zero FROM daily GROUP BY 1""",
    "monthly_rollup": _with(_DAILY, _MONTHLY) + "SELECT series_id, strftime(month, '%Y%m') AS ym, views, days_present, days_missing, complete FROM monthly",
    "project_totals_range": _with(_TOTALS) + "SELECT project, strftime(month, '%Y%m') AS ym, project_views FROM totals WHERE month BETWEEN DATE '2023-01-01' AND DATE '2025-07-31'",
    "per_million": _with(_DAILY, _MONTHLY, _META, _TOTALS, _NORMAL) + "SELECT series_id, strftime(month, '%Y%m') AS ym, views, project_views, per_million FROM normal",
    "trailing_blocks": _with(_DAILY, _MONTHLY) + """SELECT series_id, strftime(month, '%Y%m') AS ym, CASE WHEN rn <= n // 2 THEN 'recent' ELSE 'prior' END AS block, (n // 2)::INT AS n, n AS available
FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY month DESC) AS rn, count(*) OVER (PARTITION BY series_id) AS n FROM monthly WHERE complete)
WHERE n // 2 > 0 AND rn <= 2 * (n // 2)""",
    "compare_blocks": _with(_DAILY, _MONTHLY, _META, _TOTALS, _NORMAL, _COMPARE) + f"""SELECT series_id, NOT enough AS insufficient_history, months_available, 12 AS months_required,
CASE WHEN enough THEN strftime(pf, '%Y%m') END AS prior_from, CASE WHEN enough THEN strftime(pt, '%Y%m') END AS prior_to, CASE WHEN enough THEN strftime(rf, '%Y%m') END AS recent_from,
CASE WHEN enough THEN strftime(rt, '%Y%m') END AS recent_to, CASE WHEN enough THEN days_missing END AS days_missing, CASE WHEN enough THEN p END AS raw_prior, CASE WHEN enough THEN r END AS raw_recent,
CASE WHEN enough AND p > 0 THEN {_r6('(r::DOUBLE / p - 1) * 100')} END AS raw_yoy, CASE WHEN known THEN {_r6('np')} END AS norm_prior, CASE WHEN known THEN {_r6('nr')} END AS norm_recent,
CASE WHEN known AND np > 0 THEN {_r6('(nr / np - 1) * 100')} END AS norm_yoy, CASE WHEN enough THEN NOT known END AS withheld FROM compared""",
    "median_daily_90d": _with(_DAILY, _MEDIAN) + "SELECT series_id, median_daily FROM med90",
    "index_to_100": _with(_DAILY, _MONTHLY, _META, _TOTALS, _NORMAL) + """SELECT n.series_id, strftime(n.month, '%Y%m') AS ym,
sign(n.per_million) * floor(abs(n.per_million / b.base * 100) * 10000 + 0.5) / 10000 AS index_100
FROM normal n JOIN (SELECT series_id, arg_min(per_million, month) AS base FROM normal WHERE complete AND per_million > 0 GROUP BY 1) b USING (series_id) WHERE n.complete AND n.per_million IS NOT NULL""",
    "quarter_matrix": _with(_DAILY, _MONTHLY, _META, _TOTALS, _NORMAL) + """SELECT 'Q' || quarter(month) || ' ' || strftime(month, '%y') AS period, project, sum(views)::BIGINT AS views
FROM normal WHERE complete GROUP BY 1, 2""",
    "month_matrix_wide": _with(_DAILY, _MONTHLY, _META, _TOTALS, _NORMAL) + """, r AS (SELECT project, row_number() OVER (ORDER BY sum(project_views) DESC, project) AS k FROM totals GROUP BY 1)
SELECT strftime(month, '%m.%y') AS period, """ + ", ".join(f"sum(views) FILTER (k = {k})::BIGINT AS e{k}" for k in range(1, 9)) + """, sum(views) FILTER (coalesce(k, 9) > 8)::BIGINT AS others
FROM normal LEFT JOIN r USING (project) WHERE complete GROUP BY 1""",
    "robust_z": _with(_DAILY, _SPIKES) + "SELECT series_id, strftime(day, '%Y%m%d') AS d, sign(z) * floor(abs(z) * 1e5 + 0.5) / 1e5 AS z FROM dj",
    "daily_spikes": _with(_DAILY, _SPIKES) + "SELECT series_id, strftime(day, '%Y%m%d') AS d, views, z FROM spikes",
    "spike_share": _with(_DAILY, _SPIKES) + "SELECT series_id, spike_days, spike_share FROM shares",
    "best_split": _with(_DAILY, _MONTHLY, _SPLIT) + "SELECT series_id, k, floor(d * 1e5 + 0.5) / 1e5 AS difference FROM split",
    "changepoints": _with(_DAILY, _MONTHLY, _SPLIT) + "SELECT series_id, strftime(month, '%Y%m') AS ym, direction, ratio, share_of_total_change, before, after FROM breaks",
    "monthly_spikes": _with(_DAILY, _MONTHLY, _SPLIT, _MSPIKE) + "SELECT series_id, months, n, share FROM mspikes",
    "change_without_spikes": _with(_DAILY, _SPIKES, _sensitivity(90)) + "SELECT series_id, yoy_excl_spikes FROM sensitive",
    "break_evidence": _with(_DAILY, _MONTHLY, _SPLIT, _EVIDENCE) + "SELECT series_id, strftime(month, '%Y%m') AS ym, cause, events, kinds FROM evidence",
    "rubric_scores": _with(*_ALL) + "SELECT series_id, confidence, score, reasons FROM rated",
    "confidence_counts": _with(*_ALL) + "SELECT confidence, count(*) AS series, count(*) FILTER (n > 0) AS with_reasons FROM rated GROUP BY 1",
    "sparklines": _with(_DAILY, _MONTHLY) + """SELECT m.series_id, CASE WHEN max(t) <= 0 THEN repeat('▁', count(*)) ELSE
string_agg(substr('▁▂▃▄▅▆▇█', greatest(0, least(7, floor(views / nullif(t, 0) * 7 + 0.5)))::INT + 1, 1), '' ORDER BY month) END AS sparkline
FROM monthly m JOIN (SELECT series_id, max(views) AS t FROM monthly GROUP BY 1) USING (series_id) GROUP BY 1""",
    "limitation_counts": _with(_DAILY, _META) + """SELECT project, max(mi) AS worst, count(*) FILTER (mi > 0) AS flagged, bool_or(z > 0) AS any_zero
FROM (SELECT series_id, count(*) - count(views) AS mi, count(*) FILTER (views = 0) AS z FROM daily GROUP BY 1) JOIN meta USING (series_id) GROUP BY 1""",
    "gap_planning": _with(_META) + """, c AS (SELECT series_id, strptime(covered_from, '%Y%m%d')::DATE AS a, strptime(covered_to, '%Y%m%d')::DATE AS b FROM meta),
g AS (
  SELECT series_id, DATE '2022-01-01' AS f, DATE '2025-07-30' AS t FROM c WHERE a > DATE '2025-07-30' OR b < DATE '2022-01-01'
  UNION ALL SELECT series_id, DATE '2022-01-01', least(DATE '2025-07-30', (a - INTERVAL 1 DAY)::DATE) FROM c WHERE NOT (a > DATE '2025-07-30' OR b < DATE '2022-01-01')
  UNION ALL SELECT series_id, greatest(DATE '2022-01-01', least((b + INTERVAL 1 DAY)::DATE, DATE '2025-07-30')), DATE '2025-07-30' FROM c WHERE NOT (a > DATE '2025-07-30' OR b < DATE '2022-01-01'))
SELECT series_id, strftime(f, '%Y%m%d') AS gap_from, strftime(t, '%Y%m%d') AS gap_to FROM g WHERE f <= t""",
    "cache_stats": _with(_DAILY) + "SELECT count(DISTINCT series_id) AS series, count(*) AS points, strftime(min(day), '%Y%m%d') AS first_day, strftime(max(day), '%Y%m%d') AS last_day FROM h",
    "winner_pick": f"""SELECT topic, qid, bytes FROM (SELECT lower(topic) AS topic, 'Q' || doc_id AS qid, n_chars AS bytes,
row_number() OVER (PARTITION BY lower(topic) ORDER BY lower({BARE_SQL.format(c='topic')}) = lower(trim(topic)) DESC,
  CASE WHEN lower({BARE_SQL.format(c='topic')}) = lower(trim(topic)) THEN coalesce(n_chars, 0) END DESC NULLS LAST, doc_id) AS rn FROM documents WHERE topic IS NOT NULL) WHERE rn = 1""",
    "rival_articles": f"""WITH w AS (SELECT lower(topic) AS topic, doc_id, n_chars AS b, row_number() OVER (PARTITION BY lower(topic) ORDER BY lower({BARE_SQL.format(c='lower(topic)')}) = lower(trim(topic)) DESC,
  CASE WHEN lower({BARE_SQL.format(c='lower(topic)')}) = lower(trim(topic)) THEN coalesce(n_chars, 0) END DESC NULLS LAST, doc_id) AS rn FROM documents WHERE topic IS NOT NULL),
r AS (SELECT lower(d.topic) AS topic, 'Q' || d.doc_id AS qid, d.n_chars AS bytes, row_number() OVER (PARTITION BY lower(d.topic) ORDER BY d.n_chars DESC, d.topic || '#' || d.doc_id) AS rn
  FROM documents d JOIN w ON w.topic = lower(d.topic) AND w.rn = 1 WHERE d.doc_id <> w.doc_id AND coalesce(d.n_chars, 0) >= least(20000, greatest(1.0, coalesce(w.b, 0) * 0.5)))
SELECT topic, qid, bytes FROM r WHERE rn <= 3""",
    "competing_senses": _with(_META) + f""", t AS (SELECT {BARE_SQL.format(c='title')} AS topic, title FROM meta WHERE title IS NOT NULL)
SELECT DISTINCT topic, lower(title) AS title FROM t WHERE lower({BARE_SQL.format(c='title')}) <> lower(title) AND NOT regexp_matches(title, '(?i)\\(disambiguation\\)\\s*$')""",
    "edition_gaps": _with(_META) + f""", t AS (SELECT {BARE_SQL.format(c='title')} AS topic, regexp_extract(project, '^([^.]+)', 1) AS lang, title FROM meta WHERE title IS NOT NULL),
a AS (SELECT DISTINCT topic, unnest(['en', 'de', 'fr', 'es', 'pl', 'it', 'ru', 'ja', 'uk', 'xx']) AS lang FROM t), l AS (SELECT topic, lang, min(title) AS title FROM t GROUP BY 1, 2)
SELECT topic, lang, l.title, CASE WHEN l.title IS NULL THEN 'no_article' ELSE 'ok' END AS status FROM a LEFT JOIN l USING (topic, lang)""",
    "topic_words": f"""SELECT doc_id, array_to_string({_TOKENS.format(c='topic', w=_WORDS)}, ' ') AS words,
len(list_filter(regexp_split_to_array(trim(topic), '\\s+'), lambda w: w <> '')) >= 5 OR trim(topic) LIKE '%?' AS sentence FROM documents""",
    "match_confidence": _with(_META) + f""", q AS (SELECT series_id, title, agent, {_TOKENS.format(c='title', w=_WORDS)} AS a, {_TOKENS.format(c=BARE_SQL.format(c='title'), w=_WORDS)} AS b FROM meta),
h AS (SELECT *, len(list_filter(a, lambda w: list_contains(b, w))) AS hits FROM q)
SELECT series_id, hits::INT AS hits, coalesce({_r6('hits / nullif(len(a), 0)')}, 0.0) AS coverage, CASE WHEN agent IS DISTINCT FROM 'user' THEN 'high'
WHEN len(list_filter(regexp_split_to_array(trim(title), '\\s+'), lambda w: w <> '')) >= 5 OR trim(title) LIKE '%?' OR hits = 0 OR hits / nullif(len(a), 0) < 0.5 THEN 'low' ELSE 'medium' END AS confidence FROM h""",
    "number_extraction": f"""SELECT doc_id, len(n)::INT AS figures, sign(coalesce(list_sum(n), 0)) * floor(abs(coalesce(list_sum(n), 0)) * 1000 + 0.5) / 1000 AS total
FROM (SELECT doc_id, {_NUM} AS n FROM documents WHERE text IS NOT NULL)""",
    "eval_totals": f"""SELECT lower(trim(model)) AS model, results_file, count(*) AS total, count(*) FILTER (passed) AS passed, floor(sum(cost) * 1e4 + 0.5) / 1e4 AS total_cost, {_r6('avg(turns)')} AS avg_turns
FROM (SELECT DISTINCT ON (result_id, results_file, scenario) * FROM eval_results) GROUP BY 1, 2""",
    "eval_checks": "SELECT lower(trim(model)) AS model, " + ", ".join(f"count(*) FILTER (checks.{c}) AS {c}" for c in ("ran_a_command", "correct_commands", "required_content", "avoided_wrong_claims", "numbers_traceable", "topic_extracted"))
    + " FROM (SELECT DISTINCT ON (result_id, results_file, scenario) * FROM eval_results) GROUP BY 1",
    "abbrev_numbers": "SELECT project, ym, " + ", ".join(
        f"""CASE WHEN {x} < 1000 THEN {x}::VARCHAR WHEN {x} < 9950 THEN printf('%.1fk', {_rd(f'{x} / 1000.0::DOUBLE', 1)}) WHEN {x} < 999500 THEN floor({x} / 1000.0 + 0.5)::BIGINT || 'k'
ELSE printf('%.1fM', {_rd(f'{x} / 1e6', 1)}) END AS {n}""" for x, n in (("v", "short"), ("(v // 1000)", "thousandth"))) + " FROM (SELECT DISTINCT project, ym, v FROM project_totals WHERE v IS NOT NULL)",
    "date_scalars": """SELECT DISTINCT strftime(o, '%Y%m%d') AS d, strftime(o + INTERVAL 45 DAY, '%Y%m%d') AS plus45, strftime(o + INTERVAL 1 MONTH, '%Y%m%d') AS plus_month, strftime(o - INTERVAL 12 MONTH, '%Y%m%d') AS year_before,
strftime(date_trunc('month', o), '%Y%m%d') AS month_start, strftime(last_day(o), '%Y%m%d') AS month_end, day(last_day(o))::INT AS days, strftime(o, '%m.%y') AS label,
'Q' || quarter(o) || ' ' || strftime(o, '%y') AS quarter FROM (SELECT o_orderdate::DATE AS o FROM orders)""",
    "math_scalars": f"""SELECT l_orderkey, l_linenumber, {_r6('ln(1 + x)')} AS damped, CASE WHEN x > 0 THEN ceil(x / pow(10.0, floor(log10(x)))) * pow(10.0, floor(log10(x))) ELSE 1.0 END AS ceiling,
{_rd('x / 1000', 1)} AS tenths, {_rd('x / 8', 2)} AS eighths, {_rd('l_quantity::DOUBLE * 0.05::DOUBLE', 1)} AS twentieths, floor(x + 0.5)::BIGINT AS whole, sign(c) * floor(abs(c) * 10000 + 0.5) / 10000 AS change
FROM (SELECT *, (x * (1 - l_discount::DOUBLE) / x - 1) * 100 AS c FROM (SELECT *, l_extendedprice::DOUBLE AS x FROM lineitem))""",
    "json_scalars": "SELECT event_id, substr(sha1(props), 1, 16) AS key, len(json_keys(props))::INT AS fields FROM events",
    "request_keys": "SELECT DISTINCT series_id, substr(sha1(lower(access)), 1, 16) AS key, replace(agent, '-', '_') || 'wiki' AS site, agent || '.wikipedia' AS project FROM series_meta",
    "event_kinds": """SELECT user_id, string_agg(event_type, ', ' ORDER BY f) AS kinds, sum(n)::BIGINT AS events
FROM (SELECT user_id, event_type, min({'t': ts, 'e': event_id}) AS f, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1""",
    "year_change": f"""SELECT o_orderpriority, strftime(day, '%Y%m%d') AS d, n, coalesce(year(day) <> lag(year(day)) OVER w, false) AS new_year,
{_r6('(row_number() OVER w - 1) / greatest(1, count(*) OVER (PARTITION BY o_orderpriority) - 1)')} AS position
FROM (SELECT o_orderpriority, o_orderdate::DATE AS day, count(*) AS n FROM orders GROUP BY 1, 2) WINDOW w AS (PARTITION BY o_orderpriority ORDER BY day)""",
    "rollup_views": _with(_DAILY, _MONTHLY, _META) + "SELECT project, agent, sum(views)::BIGINT AS views, count(DISTINCT series_id) AS series FROM monthly JOIN meta USING (series_id) GROUP BY ROLLUP (project, agent)",
    "stream_daily_counts": "SELECT event_type, strftime(ts, '%Y%m%d') AS d, count(*) AS views FROM events WHERE event_type IS NOT NULL AND ts IS NOT NULL GROUP BY 1, 2",
    "market_share_by_region": """SELECT r_name, strftime(month, '%Y%m') AS ym, orders, floor(orders / sum(orders) OVER (PARTITION BY month) * 1e6 * 1000 + 0.5) / 1000 AS per_million FROM (
SELECT r_name, date_trunc('month', o_orderdate) AS month, count(*) AS orders FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
JOIN region ON r_regionkey = n_regionkey GROUP BY 1, 2)""",
    "encoded_titles": """SELECT DISTINCT title, replace(replace(replace(replace(replace(replace(url_encode(replace(title, ' ', '_')), '%21', '!'), '%27', chr(39)), '%28', '('), '%29', ')'), '%2A', '*'), '%7E', '~') AS encoded
FROM series_meta WHERE title IS NOT NULL""",
    "allowed_commands": r"""WITH a AS (SELECT DISTINCT result_id, answer FROM eval_results WHERE answer IS NOT NULL),
b AS (SELECT result_id, answer, unnest(regexp_extract_all(answer, '```(?:bash|sh|shell)?\s*\n([\s\S]*?)```', 1)) AS block FROM a),
c AS (SELECT result_id, trim(unnest(string_split(block, chr(10))), ' ') AS command FROM b)
SELECT a.result_id, count(command) AS commands, count(*) FILTER (regexp_matches(command, '^\s*(node\s+)?\S+\s+(views|resolve|report|check|doctor)\b[^;&|<>`$]*$')) AS allowed
FROM (SELECT DISTINCT result_id FROM a) a LEFT JOIN (SELECT * FROM c WHERE command <> '' AND NOT starts_with(command, '#')) c USING (result_id) GROUP BY 1""",
    "sentence_counts": r"""WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(text, '([.!?;:])\s+', '\1' || chr(30), 'g'), '\n+', chr(30), 'g'),
  '(^|\s)[-*•]\s+', chr(30), 'g'), chr(30)), lambda x: trim(x, ' ')), lambda x: x <> '') AS s FROM documents WHERE text IS NOT NULL)
SELECT doc_id, len(s)::INT AS sentences, length(array_to_string(s, ''))::INT AS letters FROM s""",
    "untraceable_figures": _with(_TOTALS) + r"""
, t AS (SELECT DISTINCT project, floor(project_views / 1000000)::DOUBLE AS s FROM totals),
f AS (SELECT DISTINCT doc_id, project, unnest(regexp_extract_all(text, '-?[0-9][0-9,]*(?:\.[0-9]+)?')) AS figure FROM (SELECT doc_id, text, regexp_replace(lower(trim(project)), '\.org$', '') AS project FROM documents)),
v AS (SELECT *, abs(try_cast(replace(figure, ',', '') AS DOUBLE)) AS a FROM f)
SELECT doc_id, figure FROM v WHERE a IS NOT NULL AND NOT (a = floor(a) AND (a <= 24 OR a BETWEEN 1900 AND 2100)) AND NOT EXISTS (SELECT 1 FROM t WHERE t.project = v.project AND
  CASE WHEN v.a >= 100 THEN abs(s - v.a) <= greatest(0.5, 0.02::DOUBLE * v.a) WHEN v.a >= 1 THEN abs(s - v.a) <= 0.5 ELSE s = v.a OR floor(s + 0.5) = v.a END)
""",
    "answer_commands": r"""
WITH a AS (SELECT DISTINCT result_id, answer FROM eval_results WHERE answer IS NOT NULL),
b AS (SELECT result_id, unnest(regexp_extract_all(answer, '```(?:bash|sh|shell)?\s*\n([\s\S]*?)```', 1)) AS block FROM a),
c AS (SELECT result_id, trim(unnest(string_split(block, chr(10)))) AS command FROM b)
SELECT result_id, command, nullif(trim(regexp_extract(command, '\b(?:views|resolve)\s+("[^"]*"|\x27[^\x27]*\x27|[^\s-]\S*)', 1), '"'), '') AS topic,
  len(regexp_extract_all(command, '"[^"]*"|\x27[^\x27]*\x27|\S+'))::INT AS arguments FROM c WHERE command <> '' AND NOT starts_with(command, '#')
""",
}
