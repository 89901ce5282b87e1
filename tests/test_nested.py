import json

from bagweave.operators import nested

GRAPH = {"__json_class__": "Graph", "label": "true", "__label__": "7", "items": [{"type": "a"}, None, {"type": "b", "items": {"type": "c", "items": [5, {"type": "a"}]}}]}


def frame(spark, payloads):
    return spark.createDataFrame(list(enumerate(payloads)), "record_id bigint, payload string")


def paths(spark, payloads):
    return {(r.record_id, r.graph_no, r.item_path) for r in nested.nested_items(frame(spark, payloads), "record_id", "payload").collect()}


def test_paths(spark):
    want = {"0", "2", "2.0", "2.0.1"}
    text = json.dumps([[GRAPH], ["location"]])
    assert paths(spark, [text, json.dumps(text), text[:-5], "", None, "null", "[]"]) == {(r, 0, p) for r in (0, 1) for p in want}


def test_deep_nesting(spark):
    deep = '{"__json_class__":"Graph","items":' + '{"items":[' * 30_000 + "]}" * 30_000 + "}"
    good, value = nested.parse(deep)
    of, bodies, edges = nested.merkle(value)
    assert good and len(bodies) == 30_001 and sum(1 for _ in nested.items_below(of[id(value)], nested.held_items(edges))) == 30_000
    assert nested.parse(deep[:-1]) == (False, None)


def test_parser_agrees_with_json():
    for text in ('{"a":[1,2.5,-3e2,"x\\n",true,null,{}],"b":{}}', "[]", " [ ] ", '{"a" : [ { } , [ ] ] }'):
        assert nested.parse_deep(text) == json.loads(text)
    for text in ("[1,]", "{", '{"a":}', "[1 2]", "", "[]x", '{"a"}'):
        try:
            nested.parse_deep(text)
        except ValueError:
            continue
        raise AssertionError(text)


def test_merkle_round_trip(spark):
    payloads = [json.dumps(x) for x in ([GRAPH, GRAPH], {"bags": [GRAPH], "n": 1.0, "m": -0.0}, [[{"a": {}}, [{"a": {}}]]], 3)]
    t = nested.nested_tables(frame(spark, payloads), "record_id", "payload")
    bodies = {r.node: r.body for r in t["nodes"].collect()}
    for r in t["roots"].collect():
        assert json.dumps(nested.rebuild(r.node, bodies), sort_keys=True) == json.dumps(json.loads(payloads[r.record_id]), sort_keys=True)
    graphs = t["graphs"].collect()
    assert len(graphs) == 3 and len({g.node for g in graphs}) == 1 and all(g.label is True and g.label_no == 7 for g in graphs)
    edges = {(r.parent, r.field, r.ordinal, r.child) for r in t["edges"].collect()}
    assert {e[3] for e in edges} <= set(bodies) and {e[0] for e in edges} <= set(bodies)


def test_copies_and_extra_columns(spark):
    text = json.dumps(GRAPH)
    df = spark.createDataFrame([(1, text, "x"), (1, text, "x"), (None, text, "y")], "record_id bigint, payload string, body string")
    assert nested.nested_items(df, "record_id", "payload").count() == 8
    assert nested.nested_items(df.limit(0), "record_id", "payload").count() == 0


def test_records_without_id_stay_apart(spark):
    other = {**GRAPH, "label": "false", "items": [{"type": "z"}, *GRAPH["items"][1:]]}
    df = spark.createDataFrame([(None, json.dumps(GRAPH)), (None, json.dumps(other)), (None, json.dumps(GRAPH)), (1, json.dumps(GRAPH))], "record_id bigint, payload string")
    assert nested.nested_items(df, "record_id", "payload").count() == 12
    t = nested.nested_tables(df, "record_id", "payload")
    assert t["items"].count() == 12 and sorted((r.record_id or 0, r.label) for r in t["graphs"].collect()) == [(0, False), (0, True), (1, True)]
