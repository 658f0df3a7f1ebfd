import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from trendspark.functions import dates, rounding, text
from trendspark.operators import claims


def values(spark, rows, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


def test_rounding(spark):
    xs = [1.25, -1.25, 2.5, -2.5, 0.0, None]
    got = values(spark, [(x,) for x in xs], "x double", rounding.round_half(F.col("x"), 1), rounding.round_up_half(F.col("x")))
    assert got == [(1.3, 1), (-1.3, -1), (2.5, 3), (-2.5, -2), (0.0, 0), (None, None)]
    for k, xs in ((1, [1.45, 0.15, 0.25, -1.45, 8.05, 1e17, 123456789.05, 0.05, 4.35, 1e300]), (2, [1.005, 2.675, 0.125, 1.115, 1e-300]), (4, [0.00005, 1.00005, 12345.67895])):
        got = values(spark, [(x,) for x in xs], "x double", rounding.round_half(F.col("x"), k))
        assert [g for g, in got] == [float(rounding.fixed(x, k)) for x in xs]
    rng = random.Random(3)
    xs = [n / 100 for n in range(-2000, 2000, 5)] + [rng.uniform(-1000, 1000) for _ in range(2000)] + [rng.randrange(10**9) / 1000 for _ in range(2000)]
    got = values(spark, [(x,) for x in xs], "x double", *(rounding.round_half(F.col("x"), k) for k in (0, 1, 2)))
    assert got == [tuple(float(rounding.fixed(x, k)) for k in (0, 1, 2)) for x in xs]
    assert values(spark, [(-0.04,)], "x double", rounding.round_half(F.col("x"), 1).cast("string")) == [("0.0",)]
    assert [rounding.fixed(x, 2) for x in (1.005, 2.675, None)] == ["1.00", "2.67", None]
    assert rounding.fixed(0.25, 1) == "0.3"


def test_medians(spark):
    rows = [([3.0, 1.0, 2.0],), ([4.0, 1.0, 9.0, 5.0],), ([None, 7.0],), ([],), ([None],), (None,)]
    assert [r[0] for r in values(spark, rows, "a array<double>", rounding.array_median(F.col("a")))] == [2.0, 4.5, 7.0, None, None, None]


def test_abbreviation(spark):
    cases = {999: "999", 1000: "1.0k", 9999: "10k", 9949: "9.9k", 192823: "193k", 999_499: "999k", 999_999: "1.0M", 1_250_000: "1.3M", None: "–"}
    assert {r[0]: r[1] for r in values(spark, [(k,) for k in cases], "n bigint", "n", rounding.abbreviated(F.col("n")))} == cases
    assert [r[0] for r in values(spark, [(0.0,), (1.0,), (423.0,), (1001.0,)], "x double", rounding.nice_ceiling(F.col("x")))] == [1.0, 1.0, 500.0, 2000.0]


def test_months():
    assert dates.add_months(date(2026, 1, 31), 1) == date(2026, 2, 28)
    assert dates.add_months(date(2024, 2, 29), 12) == date(2025, 2, 28)
    assert dates.add_months(date(2026, 12, 31), 2) == date(2027, 2, 28)
    assert dates.last_complete_month(date(2026, 1, 31)) == date(2025, 12, 1)
    assert dates.month_window(date(2001, 8, 1), 24) == dates.Span(date(1999, 8, 1), date(2001, 7, 31), 24)
    assert [dates.since_months(x) for x in ("2y", "18m", "90d", "3d")] == [24, 18, 3, 1]
    assert dates.since_start("1y", date(2026, 2, 28)) == date(2025, 2, 28)
    with pytest.raises(ValueError):
        dates.since_months("soon")


def test_sparkline(spark):
    cases = [([1, 8, None, 4],), ([0, 0],), ([None, None],), ([],), ([-5, 10],)]
    assert [r[0] for r in values(spark, cases, "a array<bigint>", text.sparkline(F.col("a")))] == ["▂█ ▅", "▁▁", "", "", "▁█"]


def test_titles_and_words(spark):
    rows = [("Java (island)",), ("Apple Inc.",), ("Mercury",), ("Gold, Ltd",), ("A (b) c",)]
    assert [r[0] for r in values(spark, rows, "t string", text.bare_title(F.col("t")))] == ["Java", "Apple", "Mercury", "Gold", "A (b) c"]
    rows = [("How is gold mining growing?",), ("Ґанок é1 x",), ("",)]
    assert [r[0] for r in values(spark, rows, "t string", text.topic_words(F.col("t")))] == [["gold", "mining"], ["ґанок", "é1"], []]
    rows = [("a b c d e",), ("gold mining",), ("gold?",)]
    assert [r[0] for r in values(spark, rows, "t string", text.reads_as_sentence(F.col("t")))] == [True, False, True]


def test_prose(spark):
    rows = [("One is 1,234.5. Two: -3%\n- three 7",)]
    (r,) = values(spark, rows, "t string", text.sentences(F.col("t")), text.numbers(F.col("t")))
    assert r == (["One is 1,234.5.", "Two:", "-3%", "- three 7"], [1234.5, -3.0, 7.0])
    (r,) = values(spark, [("0\n11\n22\n33: 44\n 5",)], "t string", text.sentences(F.col("t")))
    assert r == (["0", "11", "22", "33:", "44", "5"],)
    got = values(spark, [("it is up",), ("see it.wikipedia",), ("the IT edition",), ("(it)",), ("In Basque",), ("in zh-yue",), ("ZH",), ("Europe",)], "s string", claims._editions_named(F.col("s"), {"it": "Italian", "eu": "Basque", "zh": "Chinese", "zh-yue": "Cantonese"}))
    assert [set(x[0]) for x in got] == [set(), {"it"}, {"it"}, {"it"}, {"eu"}, {"zh-yue"}, {"zh"}, set()]
    assert text.language_names(spark, ["eu", "hy", "ta", "xx"]) == {"eu": "Basque", "hy": "Armenian", "ta": "Tamil", "xx": "xx"}
