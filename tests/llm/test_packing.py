from collections import Counter, defaultdict
import random

from hypothesis import given, settings, strategies as st

from trendspark.llm import packing, tokens
from trendspark.llm.packing import fill_report, pack, plan

LIMITS = "pack_name string, capacity_tokens int, size int"


def check_plan(h, c):
    runs, made = plan(h, c)
    used, ranks = Counter(), defaultdict(list)
    for s, r, b, n in runs:
        ranks[s] += range(r, r + n)
        for k in range(n):
            used[b + k] += s
    assert {s: sorted(x) for s, x in ranks.items()} == {s: list(range(n)) for s, n in h.items()}
    assert set(used) == set(range(made)) and max(used.values(), default=0) <= c
    return made


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 40).flatmap(lambda c: st.tuples(st.just(c), st.dictionaries(st.integers(1, c), st.integers(1, 30), max_size=12))))
def test_plans_hold_every_item_once_and_overfill_nothing(x):
    c, h = x
    made = check_plan(h, c)
    # at most one container may be half empty beside another that is
    assert made <= 2 * -(-sum(s * n for s, n in h.items()) // c) + 1


def test_large_items_pair():
    assert check_plan({6: 5, 4: 5}, 10) == 5
    assert check_plan({5: 7}, 10) == 4
    assert check_plan({}, 10) == 0


def test_plan_does_not_grow_with_the_number_of_items():
    rng = random.Random(3)
    h = {s: rng.randrange(1, 50) for s in range(1, 200)}
    few, many = plan(h, 512)[0], plan({s: n * 1000 for s, n in h.items()}, 512)[0]
    assert len(many) < 3 * len(few)


def test_texts(spark, monkeypatch):
    texts = ["one two three"] * 40 + ["word " * n for n in (5, 60, 63, 64, 200, 333)] + [None, "", "tail"]
    df = spark.createDataFrame([(i, t, i, 0) for i, t in enumerate(texts)], "doc_id bigint, text string, size int, container int")
    limits = spark.createDataFrame([("small", 64, 1), ("small", 64, 1), ("big", 4096, 1), (None, 5, 1), ("none", 0, 1), ("null", None, 1)], LIMITS)
    rows = pack(df, limits).collect()
    size = dict(enumerate(tokens.count([t or "" for t in texts])))
    for name, c in (("small", 64), ("big", 4096)):
        mine = [r for r in rows if r["pack_name"] == name]
        fill = Counter()
        pieces = defaultdict(list)
        for r in mine:
            pieces[r["doc_id"]].append((r["first_token"], r["n_tokens"]))
            if r["container"] is not None:
                fill[r["container"]] += r["n_tokens"]
        assert max(fill.values()) <= c and set(fill) == set(range(len(fill)))
        for i, n in size.items():
            at = 0
            for first, m in sorted(pieces[i]):
                assert first == at
                at += m
            assert at == n and len(pieces[i]) == max(1, -(-n // c))
    assert {r["pack_name"] for r in rows} == {"small", "big"}
    rep = {r["pack_name"]: r for r in fill_report(pack(df, limits)).collect()}
    assert rep["big"]["containers"] == rep["big"]["bound"] == 1


def test_ranks_are_dense_whatever_the_skew(spark):
    df = spark.range(500).selectExpr("cast(if(id % 3 = 0, 1, id) as string) k", "id")
    rows = packing._ranked(df, ["k"], "id", 16).collect()
    by = defaultdict(list)
    for r in rows:
        by[r["k"]].append(r["_rank"])
    assert all(sorted(x) == list(range(len(x))) for x in by.values())


def test_checks_tell_what_is_wrong(spark):
    docs = spark.createDataFrame([(i, "word " * (10 + 9 * i)) for i in range(12)], "doc_id bigint, text string")
    limits = spark.createDataFrame([("small", 64, 1)], LIMITS)
    packed = pack(docs, limits)
    tell = lambda df: packing.packing_checks(docs, df, limits).first().asDict()
    assert tell(packed) == {"pack_name": "small", "capacity": 64, "texts": 12, "lost": 0, "overfull": 0, "torn": 0, "split": 0}
    assert tell(packed.where("doc_id <> 3"))["lost"] == 1 and tell(packed.withColumn("container", packed.container * 0))["overfull"] == 1
    assert tell(packed.withColumn("first_token", packed.first_token + 1))["torn"] == 12
    assert tell(packed.limit(0)) == {"pack_name": "small", "capacity": 64, "texts": 0, "lost": 12, "overfull": 0, "torn": 0, "split": 0}


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    limits = spark.createDataFrame([("small", 64, 1)], LIMITS)
    assert pack(df, limits).count() == 0
    assert pack(spark.createDataFrame([(1, "a")], "doc_id bigint, text string"), limits.limit(0)).count() == 0
