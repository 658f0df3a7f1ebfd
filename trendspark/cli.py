"""Command line: views, report, check, resolve, doctor."""

from __future__ import annotations

import argparse
from collections import Counter
from datetime import date, datetime
import json
from pathlib import Path
import sys

from pyspark.sql import functions as F

from .functions.rounding import fixed
from .operators.resolve import MEASURED
from .operators.series import index_to_100, month_totals, period_matrix
from .plans import catalog, engine, render
from .plans.engine import EngineError
from .session import checkpointed, get_spark
from .sources import records
from .sources.tables import holding_points, table


class _Parser(argparse.ArgumentParser):
    def error(self, message: str):
        raise EngineError("unknown_command", message)


def _parser() -> argparse.ArgumentParser:
    p = _Parser(prog="trendspark")
    sub = p.add_subparsers(dest="command")

    def command(name: str, help: str) -> argparse.ArgumentParser:
        return sub.add_parser(name, help=help)

    for name, what in (("views", "rated comparisons of a topic's series"), ("resolve", "which articles a topic means")):
        c = command(name, what)
        c.add_argument("topic")
        c.add_argument("--data", required=True, help="folder of the tables")
        c.add_argument("--langs", default="", help="editions, comma separated")
        c.add_argument("--from", dest="from_lang", default="en", help="edition in which the topic is named")
        c.add_argument("--no-verify", dest="verify", action="store_false", help="do not follow titles to their pages")
        c.add_argument("--allow-fold", action="store_true", help="measure a wider article where there is no own one")
        if name == "views":
            c.add_argument("--as-of", type=date.fromisoformat, required=True)
            c.add_argument("--since", default="2y")
            c.add_argument("--out", help="folder for the run")
            c.add_argument("--no-cache", dest="cache", action="store_false", help="compute anew what the folder already has")
            c.add_argument("--table", action="store_true")
    for name, what in (("report", "HTML and SVG of a finished run"), ("check", "a draft against a finished run")):
        c = command(name, what)
        c.add_argument("--run", "--dir", dest="run", default="")
        c.add_argument("--topic", default="")
        if name == "report":
            c.add_argument("--html", default="report.html")
            c.add_argument("--svg")
            c.add_argument("--notes", default="")
        else:
            c.add_argument("text", nargs="?", help="the draft, or - for standard input")
            c.add_argument("--claims", help="file with the draft")
    command("doctor", "state of the session and the data").add_argument("--data")
    return p


def languages(text: str) -> list[str]:
    out = list(dict.fromkeys(x.strip().lower() for x in text.split(",") if x.strip()))
    if not out:
        raise EngineError("no_langs", "no edition given")
    return out


def _views(spark, args: argparse.Namespace) -> int:
    topic = args.topic.strip()
    if not topic:
        raise EngineError("no_topic", "no topic given")
    langs = languages(args.langs)
    request = {k: str(getattr(args, k)) for k in ("topic", "data", "langs", "from_lang", "verify", "allow_fold", "as_of", "since") if hasattr(args, k)}
    if args.command == "views":
        engine.window_months(args.since)
        if args.out and args.cache and records.read_told(spark, args.out, "input") == request:
            return _told(args, records.read_told(spark, args.out, "analysis"))
    entities, editions, series = catalog.resolved_series(spark, args.data, topic, langs, args.from_lang, args.verify, args.allow_fold)
    entity = entities.first().asDict(True)
    if entity["via"] is None:
        raise EngineError("topic_not_found", f"nothing on record bears the name {topic!r}")
    rows = [r.asDict() for r in editions.collect()]  # one an edition asked for
    unresolved = [{"lang": r["lang"], "reason": r["status"], "target": r["target"]} for r in rows if r["status"] not in MEASURED]
    told = {"topic": topic, "entity": entity, "unresolved": unresolved}
    if args.command == "resolve":
        print(json.dumps(told | {"resolved": [{k: r[k] for k in ("lang", "title", "warning", "redirected_from")} for r in rows if r["status"] in MEASURED]}, default=str))
        return 0
    totals = month_totals(table(spark, args.data, "project_totals"))
    points = holding_points(table(spark, args.data, "point_cache")).join(series.select("series_id"), "series_id", "left_semi")
    a = engine.analyse(points, totals, series, args.as_of, engine.Config(args.since), *catalog.seen(spark, args.data, series))
    results = checkpointed(a.results)
    found = [_shown(r.asDict(True)) for r in results.drop("monthly").orderBy("lang", "title", "series_id").collect()]  # one an edition and article
    told |= {"run_id": records.run_id(datetime.now()), "window": {"as_of": args.as_of, "complete_months": a.months}, "results": found}
    told["hint"] = engine.hint(len(found), unresolved, topic, entity["others"], langs)
    if args.out:
        monthly = results.select("series_id", F.explode("monthly").alias("m")).select("series_id", "m.*")
        records.write_run({"results": results.drop("monthly"), "monthly": monthly, "daily": a.daily}, args.out, told, request)
    return _told(args, told)


def _shown(row: dict) -> dict:
    """A result row as it is told: names of the contract, figures rounded, nothing that does not apply."""
    raw, norm = row.get("raw"), row.get("normalized")
    short = row.get("insufficient_history")
    out = {k: row.get(k) for k in ("series_id", "lang", "title", "status", "warning", "redirected_from")}
    out |= {"median_daily_90d": row["median_daily"], "days_missing": row["window_days_missing"], "sparkline": row["sparkline"], "confidence": row["confidence"], "confidence_score": row["score"]}
    out |= {"confidence_reasons": [x["detail"] for x in row["reasons"] or []] or None, "signals": row["signals"], "insufficient_history": short}
    if not short:
        out |= {"raw": raw and raw | {"yoy_pct": _pct(raw["yoy_pct"])}, "normalized": norm and {k: (_pct(v) if k == "yoy_pct" else v if not isinstance(v, float) else float(fixed(v, 2))) for k, v in norm.items()}}
    return {k: v for k, v in out.items() if v is not None}


def _pct(x: float | None) -> float | None:
    return None if x is None else float(fixed(x, 1))


def _told(args: argparse.Namespace, told: dict) -> int:
    if args.table:
        print(render.told_table(told["results"], told["unresolved"]))
    else:
        print(json.dumps({k: v for k, v in told.items() if v is not None}, default=str))
    return 0


def _run_tables(spark, args: argparse.Namespace) -> dict:
    if not args.run:
        raise EngineError("no_run", "no run given")
    tables = records.read_run(spark, args.run)
    if "results" not in tables:
        raise EngineError("run_not_found", f"no finished run in {args.run}")
    return tables


def _check(spark, args: argparse.Namespace) -> int:
    results = _run_tables(spark, args)["results"]
    text = Path(args.claims).read_text() if args.claims and args.claims != "-" else sys.stdin.read() if "-" in (args.text, args.claims) else args.text
    issues = [r.asDict() for r in engine.check_draft(spark, results, args.topic, text or "").collect()]
    bad = [i for i in issues if i["severity"] == "error"]
    print(json.dumps({"ok": not bad, **engine.counted(spark, text), "errors": bad, "warnings": [i for i in issues if i["severity"] != "error"]}))
    return int(bool(bad))


def _report(spark, args: argparse.Namespace) -> int:
    tables = _run_tables(spark, args)
    results = tables["results"]
    warned = []
    if args.notes:
        issues = [r.asDict() for r in engine.check_draft(spark, results, args.topic, args.notes).collect()]
        bad = [i for i in issues if i["severity"] == "error"]
        if bad:
            raise EngineError("notes_unverified", "; ".join(i["figure"] for i in bad))
        warned = [i for i in issues if i["severity"] != "error"]
    analysis = records.read_told(spark, args.run, "analysis") or {}
    rows = [r.asDict(True) for r in results.orderBy("lang", "title", "series_id").collect()]
    twice = Counter(r["lang"] for r in rows)
    name = {r["series_id"]: r["lang"] if twice[r["lang"]] == 1 else f"{r['lang']} {r['title']}" for r in rows}
    months = [r.asDict() for r in tables["monthly"].where("complete").orderBy("month").select("series_id", "month", "views", "per_million").collect()]  # months of the window by series
    labels = sorted({m["month"] for m in months})
    index = {(r["series_id"], r["month"]): r["index"] for r in index_to_100(tables["monthly"]).collect()}
    lines = {n: [(k, index.get((s, m))) for k, m in enumerate(labels)] for s, n in name.items()}
    chart = render.line_chart(lines, [x.strftime("%m.%y") for x in labels], f"{args.topic or analysis.get('topic', '')}: views per million, first month 100")
    change = render.bar_chart({name[r["series_id"]]: (r["normalized"] or {}).get("yoy_pct") for r in rows}, "change of the share of views, %")
    bars = render.spark_bars({name[s]: [m["views"] for m in months if m["series_id"] == s] for s in name})
    by = {(x["period"].strftime("%m.%y"), name[x["series_id"]]): float(x["views"]) for x in period_matrix(tables["monthly"], "series_id").collect() if x["series_id"] in name}
    periods = list(dict.fromkeys(p for p, _ in sorted(by, key=lambda k: (k[0][3:], k[0][:2]))))
    data = render.matrix(periods, list(name.values()), by)
    limits = render.limitations(rows, len(analysis.get("unresolved", [])), (analysis.get("entity") or {}).get("senses"), args.topic or analysis.get("topic", ""))
    Path(args.html).write_text(render.report(args.topic or analysis.get("topic", ""), rows, [chart, change, bars], data, args.notes, limits))
    if args.svg:
        Path(args.svg).write_text(chart)
    print(json.dumps({"html": args.html, "svg": args.svg, "warnings": warned}))
    return 0


def run(args: argparse.Namespace) -> int:
    spark = get_spark()
    if args.command == "doctor":
        print(json.dumps(engine.doctor(spark, holding_points(table(spark, args.data, "point_cache")) if args.data else None)))
        return 0
    return {"views": _views, "resolve": _views, "report": _report, "check": _check}[args.command](spark, args)


def main(argv: list[str] | None = None) -> int:
    parser = _parser()
    try:
        args = parser.parse_args(argv)
        if not args.command:
            parser.print_help()
            return 0
        return run(args)
    except EngineError as e:
        print(json.dumps(e.as_dict()))
        return 1
    except BrokenPipeError:
        return 0


if __name__ == "__main__":
    sys.exit(main())
