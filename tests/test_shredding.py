import json

from trendspark.operators.shredding import MANY, REPLY, Edge, Element, SchemaGraph, flat_table, flat_tables, nested_elements, opened, orphans, shred


def found(spark, bodies):
    df = spark.createDataFrame(list(enumerate(bodies)), "response_id bigint, body string")
    return {tuple(r) for r in nested_elements(df).collect()}


PAGE = {"ns": 0, "title": "A", "langlinks": [{"lang": "de", "title": "B"}, {"lang": "fr", "title": None}], "revisions": [{"timestamp": "t1", "size": 3}]}
ROWS = {("page", "", "A"), ("langlink", "A", "de"), ("revision", "A", "t1")}


def test_shapes_of_a_repeated_element(spark):
    for pages in ([PAGE], PAGE, {"17": PAGE}, [PAGE, {"ns": 0, "langlinks": [{"lang": "pl", "title": "C"}]}], [PAGE, None, 5]):
        assert {r[1:] for r in found(spark, [json.dumps({"query": {"pages": pages}})])} == ROWS


def test_no_elements(spark):
    bodies = [None, "", "null", "[]", "<html>", '{"query": null}', '{"query": {"pages": null, "search": []}}', '{"query": {"pages": [{"title": "A"}', '{"query":{"pages":[]}} x', '"text"', "17"]
    assert found(spark, bodies) == set()


def test_wrapped_replies(spark):
    reply = json.dumps({"query": {"search": [{"title": "S"}, {"title": None}]}})
    for body in (reply, f"[{reply}]", json.dumps(reply), json.dumps([reply]), json.dumps(json.dumps([json.loads(reply)])), f" \n{reply}\n"):
        assert found(spark, [body]) == {(0, "search", "", "S")}, body


def test_wrapped_to_any_depth(spark):
    reply = {"query": {"search": [{"title": "S"}]}}
    bodies, strings, lists, objects = [], reply, reply, reply
    for _ in range(10):
        strings, lists, objects = json.dumps(strings), [lists], {"body": objects, "a.b": 1}
        bodies += [strings, json.dumps(lists), json.dumps(objects), json.dumps({"body": json.dumps([json.dumps(objects)])})]
    assert found(spark, bodies) == {(i, "search", "", "S") for i in range(len(bodies))}


def test_what_damages_a_wrapped_reply(spark):
    inner = ['{"query": {"search": [{"title": "S"}]', '{"query": NaN, "batchcomplete": 1}', '{"query": {}, "query": {"search": [{"title": "S"}]}}', "[" * 2000 + "]" * 2000]
    bodies = [json.dumps([x]) for x in inner] + ["[" * 2000 + "]" * 2000, json.dumps(["\ud800", {"query": {"search": {"title": "\ud800 S"}}}])]
    assert {r[0] for r in found(spark, bodies)} <= {5}


def test_trails_are_keys(spark):
    body = json.dumps([{"query": {"search": [{"title": "S"}]}}, {"a.b/c": [{"query": {"search": {"title": "T"}}}]}])
    rows = shred(spark.createDataFrame([(1, body)], "i int, body string"), REPLY, "body", ["i"]).where("relation = 'search'").collect()
    assert {(r["row_path"], r["item"]) for r in rows} == {("/reply:0/search:0", "S"), ("/reply:1.a~2b~1c.0/search:0", "T")}
    assert opened('[1, "x", "17", null, true]', frozenset({"query"})) == []


def test_orphans(spark):
    df = spark.createDataFrame([(1, json.dumps({"query": {"pages": [PAGE, {"title": "Z"}]}}))] * 2, "response_id bigint, body string")
    t = flat_tables(df, REPLY, "body", "response_id")
    assert {tuple(r) for r in orphans(t).collect()} == {("page", 2, 0), ("langlink", 1, 0), ("revision", 1, 0)}
    t["page"] = t["page"].where("title = 'Z'")
    assert {(r["relation"], r["orphans"]) for r in orphans(t).collect()} == {("page", 0), ("langlink", 1), ("revision", 1)}
    one = flat_table(df, REPLY, "body", "response_id", "langlink")
    assert one.collect() == t["langlink"].collect()


def test_entities_and_logs(spark):
    body = {"entities": {"Q1": {"id": "Q1", "sitelinks": {"dewiki": {"site": "dewiki", "title": "T"}, "frwiki": {"site": "frwiki", "title": None}}}}}
    log = {"query": {"logevents": [{"logid": 5, "title": "L"}, {"logid": 6}], "normalized": {"from": "a", "to": "A"}, "redirects": [{"from": "x", "to": "y"}]}}
    assert {r[1:] for r in found(spark, [json.dumps(body), json.dumps(log)])} == {("sitelink", "Q1", "dewiki"), ("logevent", "", "5"), ("normalized", "", "a"), ("redirect", "", "x")}


def test_keys_link_and_copies_count_once(spark):
    df = spark.createDataFrame([(1, json.dumps({"query": {"pages": [PAGE, {"title": "Z"}]}}), "x")] * 3, "response_id bigint, body string, row_path string")
    t = flat_tables(df, REPLY, "body", "response_id")
    pages, links = t["page"].collect(), t["langlink"].collect()
    assert len(pages) == 2 and len(links) == 1
    assert links[0]["parent_id"] == next(p["row_id"] for p in pages if p["title"] == "A")
    assert pages[0]["parent_id"] == t["reply"].collect()[0]["row_id"]


def test_graph_analysis():
    e = [Element(x) for x in "abcde"]
    g = SchemaGraph("a", e, [Edge("a", "b", "b"), Edge("b", "c", "c", MANY), Edge("a", "d", "d"), Edge("b", "d", "d"), Edge("d", "e", "e")])
    assert set(g.relations()) == {"a", "c", "d"}  # b and e are inlined; c is repeated, d shared
    loop = SchemaGraph("a", e[:2], [Edge("a", "b", "b"), Edge("b", "b", "b")])
    assert loop.relations()["b"].recursive


def test_recursion(spark):
    g = SchemaGraph("n", [Element("n", ("v",), key="v", marks=("v",))], [Edge("n", "n", "kids", MANY)])
    body = json.dumps({"v": "1", "kids": [{"v": "2", "kids": [{"v": "3"}]}, {"v": "4"}]})
    rows = shred(spark.createDataFrame([(1, body)], "i int, body string"), g, "body", ["i"]).select("parent_key", "item").collect()
    assert {tuple(r) for r in rows} == {(None, "1"), ("1", "2"), ("2", "3"), ("1", "4")}


def test_empty(spark):
    assert nested_elements(spark.createDataFrame([], "response_id bigint, body string, kind string")).count() == 0
