from collections import Counter, defaultdict

from trendspark.llm import mixing, tokens
from trendspark.llm.mixing import mix, shares

DOCS = "doc_id bigint, text string, source string, n_tokens string, epoch string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, "x", "y") for i, (t, s) in enumerate(rows)], DOCS)


def targets(spark, rows):
    return spark.createDataFrame(rows, "source string, target_share double, max_repeats int")


def corpus():
    rows = [(f"text {i} of the north " * (1 + i % 7), ("north", "North", "NORTH ")[i % 3]) for i in range(80)]
    rows += [(f"small piece {i}", "far_south") for i in range(4)] + [(f"west {i} " * 3, "west") for i in range(30)]
    return rows + [(None, "west"), ("", "west"), ("no source", None), ("no target", "east")]


WANT = [("north", 0.5, 2), ("far-south", 0.3, 3), ("west", 0.2, 4), ("absent", 0.0, 1), (None, 0.1, 1), ("gone", 0.1, 2)]


def test_budgets_are_met_to_the_token(spark):
    rows = corpus()
    got = mix(docs(spark, rows), targets(spark, WANT), total_tokens=900).collect()
    size = tokens.count([t or "" for t, _ in rows])
    taken, uses = Counter(), defaultdict(Counter)
    for r in got:
        taken[r["source"]] += r["taken_tokens"]
        uses[r["source"]][r["doc_id"]] += 1
        assert 0 < r["taken_tokens"] <= r["n_tokens"] == size[r["doc_id"]]
    south = sum(size[i] for i, (_, s) in enumerate(rows) if s == "far_south")
    assert taken == {"north": 450, "west": 180, "far-south": min(270, 3 * south)}
    assert max(max(c.values()) for c in uses.values()) <= 4 and max(uses["far-south"].values()) <= 3
    assert sum(r["taken_tokens"] < r["n_tokens"] for r in got) <= 3


def test_a_round_is_complete_before_the_next(spark):
    got = mix(docs(spark, corpus()), targets(spark, WANT), total_tokens=3000).where("source = 'west'").collect()
    epochs = Counter(r["epoch"] for r in got)
    assert epochs[0] == 30 and sorted(epochs) == list(range(len(epochs)))
    assert len({(r["doc_id"], r["epoch"]) for r in got}) == len(got)


def test_reposts_are_one_text(spark):
    rows = [("the same text", "north")] * 20 + [("the same text", "west")] * 20 + [("another one", "west")]
    got = mix(docs(spark, rows), targets(spark, [("north", 0.5, 2), ("west", 0.5, 2)]), total_tokens=10_000).collect()
    uses = Counter(r["doc_id"] for r in got)
    assert set(uses) == {0, 40} and max(uses.values()) == 2


def test_same_seed_same_mixture(spark):
    d, t = docs(spark, corpus()), targets(spark, WANT)
    one, two, other = (sorted(map(tuple, mix(d, t, 300, seed).collect())) for seed in (1, 1, 2))
    assert one == two != other


def test_report(spark):
    t = targets(spark, WANT)
    rep = {r["source"]: r for r in shares(mix(docs(spark, corpus()), t, total_tokens=900), t).collect()}
    assert abs(sum(r["actual_share"] for r in rep.values()) - 1) < 1e-9
    assert rep["gone"]["tokens"] == 0 and rep["north"]["tokens"] == 450
    assert rep["west"]["most_repeats"] >= 1


def test_empty(spark):
    t = targets(spark, WANT)
    assert mix(docs(spark, []), t).count() == 0
    assert mix(docs(spark, corpus()), t.limit(0)).count() == 0
    assert {r["actual_share"] for r in shares(mix(docs(spark, []), t), t).collect()} == {0.0}


def test_source_spellings(spark):
    df = spark.createDataFrame([("A_b",), (" a-B ",), ("a b",)], "source string").select(mixing._source("source").alias("s"))
    assert {r["s"] for r in df.collect()} == {"a-b"}


def test_checks_hold_whatever_the_parts(spark, monkeypatch):
    monkeypatch.setattr(mixing, "PART_TEXTS", 2)
    for total in (None, 900, 3000):
        rows = mixing.mixture_checks(docs(spark, corpus()), targets(spark, WANT), total).collect()
        assert {tuple(r)[1:] for r in rows} == {(0, 0, 0, 0)} and len(rows) == 4
