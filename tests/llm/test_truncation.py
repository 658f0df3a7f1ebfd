import math
import random

from trendspark.llm import truncation
from trendspark.llm.truncation import find_truncated, truncation_by_source

SENTENCES = [
    "The series starts late and is complete otherwise.", "Readers come mostly in winter, which the chart shows clearly.", "Confidence is medium, because history is short.",
    "A view says that someone looked, nothing more.", "Totals for March were read early and may still grow.", "The editors left the question open, as before.",
]


def corpus(seed=1, n=120):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        text = " ".join(rng.choice(SENTENCES) for _ in range(rng.randrange(2, 9)))
        out.append(text + rng.choice(["", "\n\n- no article\n- confidence: high", "\n\nThanks for asking", "\n\n```\nviews\n```"]))
    return out


def found(spark, texts, source="m"):
    df = spark.createDataFrame([(i, source, t, "x") for i, t in enumerate(texts)], "id bigint, model string, answer string, source string")
    return {r["id"]: r["evidence"] for r in find_truncated(df, "id", "model", "answer").collect()}


def test_whole_texts_stay_whole(spark):
    base = corpus() + [s[:-1] for s in SENTENCES[:3]] + [None, "", "  \n"]
    got = found(spark, base)
    assert set(got) == set(range(len(base))) and not any(got.values()), {k: (v, base[k][-40:]) for k, v in got.items() if v}


def test_cuts_inside_words_sentences_and_structures(spark):
    base = corpus()
    cut = ["The series starts late and is compl", "Readers come mostly in winter, which the", "Confidence is medium, because histo…", "Totals for March were read ea [...]", SENTENCES[0] + "\n\n```\nviews", '{"answer": "The ser', "| a | b |\n|---|---|\n| 1 |"[:-2]]
    got = found(spark, base + cut)
    assert [got[len(base) + k] for k in range(len(cut))] == ["word", "sequence", "word", "word", "structure", "structure", "structure"]
    assert not any(got[k] for k in range(len(base)))


def test_a_usual_ellipsis_is_no_cut(spark):
    base = corpus() + [t + " As far as the log tells." for t in corpus(2, 20)] + [" ".join(random.Random(k).sample(SENTENCES, 3)) + " More months may tell..." for k in range(9)]
    assert not any(found(spark, base).values())


def test_lengths_that_pile_up_are_limits(spark):
    long = [" ".join(random.Random(s).choices(SENTENCES, k=12)) for s in range(30)]
    base = corpus(n=60)
    cuts = [t[:400] for t in long] + [t[:300] + "…" for t in long]
    got = found(spark, base + cuts)
    assert {k for k in range(60) if not got[len(base) + k]} == {k for k, t in enumerate(cuts) if t.endswith(".")}
    # an end the corpus knows as one: the length alone raises no verdict, nor does the end; both together do
    known = [" ".join([*random.Random(s).choices(SENTENCES, k=7), "x" * 500])[:430] + "\n\nThanks for asking" for s in range(30)]
    assert not any(found(spark, corpus(n=120) + known[:4])[120 + k] for k in range(4))
    got = found(spark, base + known)
    assert {got[len(base) + k] for k in range(30)} == {"length"}


def test_a_length_near_the_shortest_is_no_limit(spark):
    """Few texts are shorter than the shortest: there, only longer ones tell how many are usual."""
    lengths = [n for n in range(230, 1200) for _ in range(6)] + [1200] * 300
    rows = spark.createDataFrame([("m", f"{i}", n, n + 2, None, 1) for i, n in enumerate(lengths)], "_source string, _h string, chars int, bytes int, unmarked int, sig bigint")
    assert {(r["measure"], r["length"]) for r in truncation._limits(rows).collect()} == {("chars", 1200), ("bytes", 1202)}


def test_trie_and_length_are_added_up():
    w, p = truncation.WEIGHTS, truncation.PRIOR
    assert all(p + w[k] > 0 for k in ("word", "context", "sequence", "structure")) and all(p + w[k] < 0 for k in ("unknown", "usual", "stop"))
    assert p + w["unknown"] + math.log(truncation.PILE_FACTOR) > 0 > p + w["usual"] + math.log(truncation.PILE_FACTOR)
    assert p + w["usual"] + truncation.LENGTH_MOST > 0 > p + w["stop"] + truncation.LENGTH_MOST


def test_both_ways_to_drop_sequences_agree(spark, monkeypatch):
    base = corpus() + ["The series starts late and is compl", "Readers come mostly in winter, which the"]
    one = found(spark, base)
    monkeypatch.setattr(truncation, "ASKED", 0)
    assert found(spark, base) == one


def test_tails_end_as_the_whole_text_does(spark):
    texts = [t + e for t in corpus(3, 20) for e in ("", "…", " r_20250521T0518_4db", " 1,234.5", " 12abc", "\n\n", " " + "y" * 600, "\n" * 500 + "z")]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    s = truncation.F.col("s")
    for r in truncation._with_last_tokens(df, "a", s).withColumn("b", truncation._tokens(s)).collect():
        n = min(5, len(r["b"]))
        assert r["a"][-n:] == r["b"][-n:], r["s"][-40:]


def test_copies_are_no_limit(spark):
    text = " ".join(SENTENCES)
    assert not any(found(spark, corpus(n=60) + [text] * 50).values())


def test_report_and_repeated_rows(spark):
    base = corpus(n=60)
    rows = [(i, " M ", t) for i, t in enumerate([*base, "The series starts late and is compl"])] * 2 + [(99, None, "x y.")]
    rep = {r["source"]: r for r in truncation_by_source(find_truncated(spark.createDataFrame(rows, "id bigint, model string, answer string"), "id", "model", "answer")).collect()}
    assert (rep["m"]["texts"], rep["m"]["cut"], rep[None]["cut"]) == (61, 1, 0)


def test_long_text_and_empty_table(spark):
    assert found(spark, corpus(n=30) + ["a" * 200_000, " ".join(SENTENCES * 400)])[30] is None
    assert found(spark, []) == {}
