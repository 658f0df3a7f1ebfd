import json
from pathlib import Path

import pytest

from trendspark import cli
from trendspark.plans import render
from trendspark.plans.engine import EngineError, doctor

ROW = {"lang": "en", "title": "Gold <mine>", "median_daily": 12.5, "raw": {"yoy_pct": -3.25}, "normalized": None, "confidence": "low", "sparkline": "▁█", "reasons": [{"detail": "too few"}], "window_days_missing": 3}
DATA = Path("/root/testdata/sf0.001")


def test_table_and_report():
    t = render.table([ROW])
    assert "-3.3" in t and "en: too few" in t and "–" in t
    page = render.report("Gold", [ROW], [render.bar_chart({"en": -3.0, "de": None}, "x")], notes="a & b")
    assert "a &amp; b" in page and "Gold &lt;mine&gt;" in page
    limits = render.limitations([ROW], unresolved=2, senses=["Gold (x)"], topic="Gold")
    assert "name Gold" in limits[0] and "Gold (x)" in limits[0] and any("up to 3 days" in x for x in limits) and any(x.startswith("2 of the editions") for x in limits)
    assert len(render.limitations([])) == 4 and any(x.startswith("1 of 1 rows") for x in limits)


def test_gaps_break_lines():
    assert render.segments([(0, 1.0), (1, None), (2, 3.0), (3, 4.0)]) == [[(0, 1.0)], [(2, 3.0), (3, 4.0)]]
    assert render.line_chart({"a": [(0, 1.0), (1, None), (2, 3.0)]}, ["x", "y", "z"], "t").count("<polyline") == 2
    assert "–" in render.matrix(["p"], ["a", "b"], {("p", "a"): 5.0})


def test_wide_letters():
    assert render.width("日本") == 4 and render.width(render.clip("日本語テキスト", 5)) <= 5 and render.padded("日", 4) == "日  "


def test_doctor_and_languages(spark):
    assert doctor(spark)["ok"]
    assert cli.languages(" EN, de,,") == ["en", "de"]
    with pytest.raises(EngineError):
        cli.languages(" ,")


@pytest.mark.skipif(not DATA.exists(), reason="needs the test tables")
def test_commands(spark, tmp_path, capsys):
    from trendspark.functions.text import bare_title
    from trendspark.sources.tables import current_meta, table
    from pyspark.sql import functions as F

    m = current_meta(table(spark, str(DATA), "series_meta")).where("granularity = 'daily'").orderBy("series_id").select(bare_title(F.col("title")).alias("t"), "project").first()
    lang = m["project"].split(".")[0]
    run = str(tmp_path / "run")
    assert cli.main(["views", m["t"], "--data", str(DATA), "--langs", f"{lang},xx", "--from", lang, "--as-of", "2025-08-01", "--out", run]) == 0
    out = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    row = out["results"][0]
    assert row["lang"] == lang and {"lang": "xx", "reason": "no_article", "target": None} in out["unresolved"] and out["run_id"].startswith("r_")
    assert {"median_daily_90d", "days_missing", "sparkline", "confidence", "confidence_score", "signals", "status"} <= set(row) and ("raw" in row or "insufficient_history" in row)
    assert out["entity"]["via"] and "hint" not in out
    again = ["views", m["t"], "--data", str(DATA), "--langs", f"{lang},xx", "--from", lang, "--as-of", "2025-08-01", "--out", run]
    assert cli.main(again) == 0 and json.loads(capsys.readouterr().out.strip().splitlines()[-1])["run_id"] == out["run_id"]  # kept
    assert cli.main(["resolve", m["t"], "--data", str(DATA), "--langs", f"{lang},xx", "--from", lang, "--allow-fold", "--no-verify"]) == 0
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1])["resolved"][0]["lang"] == lang
    assert cli.main(["report", "--dir", run, "--html", str(tmp_path / "r.html"), "--svg", str(tmp_path / "r.svg")]) == 0
    page = (tmp_path / "r.html").read_text()
    assert page.count("<svg") >= 3 and "<table>" in page and "could not be measured" in page
    capsys.readouterr()
    assert cli.main(["check", "--run", run, "It reached 123456789.5 views. Nothing else."]) == 1
    told = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert (told["sentences_checked"], told["figures_checked"], told["errors"][0]["figure"]) == (2, 1, "123456789.5")

    def code(*argv):
        assert cli.main(list(argv)) == 1
        return json.loads(capsys.readouterr().out.strip().splitlines()[-1])["error"]

    views = ["views", m["t"], "--data", str(DATA), "--as-of", "2025-08-01"]
    assert code("report", "--run", run, "--notes", "It reached 123456789.5 views.", "--html", str(tmp_path / "x.html")) == "notes_unverified"
    assert code("views", "no such topic", "--data", str(DATA), "--langs", "en", "--as-of", "2025-08-01") == "topic_not_found"
    assert code(*views) == "no_langs" and code("views", " ", *views[2:], "--langs", "en") == "no_topic"
    assert code(*views, "--langs", "en", "--since", "soon") == "bad_since" and code(*views, "--langs", "en", "--since", "1m") == "window_too_short"
    assert code("check", "x") == "no_run" and code("check", "--run", str(tmp_path / "none"), "x") == "run_not_found" and code("check", "--run", run, " ") == "no_claims"
    assert code("fly") == "unknown_command"
    assert cli.main([]) == 0
