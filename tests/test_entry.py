from pathlib import Path
import re

import pytest

import __spark_entry__

DATA = Path("/root/testdata/sf0.001")


def test_registry():
    q, o = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 80
    assert {"p1_found", "p2_found", "p4_found", "p5_found"} <= set(q)


def test_every_query_but_a_few_has_sql():
    """Those whose work cannot be said in SQL: tokens, vocabularies, random fields, autoregressions, and the check of a draft."""
    rest = set(__spark_entry__.queries()) - set(__spark_entry__.oracle_sql())
    assert rest <= {"claims_checker", "p3_found", "p3_share", "p5_found", "p6_pack", "p6_fill", "p7_mix", "p7_shares", "p8_found", "p8_masked"}


def test_nothing_outside_imports_the_text_operators():
    root = Path(__spark_entry__.__file__).parent
    for f in root.glob("trendspark/**/*.py"):
        if "llm" not in f.parts:
            assert not re.search(r"(from|import) .*\bllm\b", f.read_text()), f


@pytest.mark.skipif(not DATA.exists(), reason="needs the test tables")
def test_entry_runs(spark):
    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and "confidence" in df.columns


@pytest.mark.skipif(not DATA.exists(), reason="needs the test tables")
@pytest.mark.parametrize("name", ["p2_found", "p4_found", "monthly_rollup", "compare_blocks", "changepoints", "gap_planning", "winner_pick", "p1_found", "p1_langlinks", "p1_orphans", "p4_counter", "p5_stuck", "rubric_scores", "injected_rubric", "views_report", "edition_status", "page_senses", "sentence_counts", "math_scalars"])
def test_queries_equal_their_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    df = __spark_entry__.queries()[name](spark, str(DATA))
    want = con.sql(__spark_entry__.oracle_sql()[name])
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    key = lambda rows: sorted(tuple("" if x is None else f"{float(x):.6g}" if isinstance(x, (int, float)) else str(x) for x in r) for r in rows)
    assert key(df.select(*cols).collect()) == key(want.select(*cols).fetchall())
