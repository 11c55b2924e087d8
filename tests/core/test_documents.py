import json

import pytest
from hypothesis import given
from hypothesis import strategies as st

from stratalens.documents import convert, nodes, parse, schema

USERS = '{"users":[{"name":"alice","zip":"00420","tags":["a","b"],"ok":true},{"name":"bob 100%","zip":"99999","tags":[],"ok":null}],"count":2,"weird key!":"va_lue"}'


def frame(spark, *texts):
    return spark.createDataFrame([("d", i, t) for i, t in enumerate(texts)], "doc string, rec long, text string")


def tree(spark, *texts, format="json"):
    return nodes.document(nodes.shred(frame(spark, *texts), format), format == "xml").cache()


def test_walk(spark):
    t = tree(spark, USERS)
    assert nodes.meta(t)["root_id"] == 2
    root = nodes.node(t, 2).first()
    assert (root.kind, root.n_children) == (parse.OBJECT, 3)
    kids = nodes.children(t, 2).collect()
    assert [(k.name, k.n_children) for k in kids] == [("users", 2), ("count", 0), ("weird key!", 0)]
    assert [k.name for k in nodes.children(t, 2, 1, 1).collect()] == ["count"]
    alice = nodes.search(t, "alice").first()
    assert len(nodes.ancestors(t, alice.id)) == 5
    assert alice.path == "$.users[0].name" == nodes.path_of(t, alice.id)
    assert [r.value for r in nodes.search(t, "100%").collect()] == ["bob 100%"]
    assert nodes.search(t, "va_lue", "values").count() == 1
    assert nodes.search(t, "name", "keys").count() == 2
    assert nodes.at_path(t, '$["weird key!"]').first().value == "va_lue"
    assert nodes.at_path(t, "$.users[0].zip").first().value == "00420"
    assert nodes.search(t, "ALICE", exact=True).count() == 0
    assert nodes.search(t, "^a", "values", regex=True).count() == 2
    first = nodes.search(t, "a", limit=1).first().id
    assert all(r.id > first for r in nodes.search(t, "a", after=first).collect())
    s = nodes.stats(t, 2).first()
    assert (s.children, s.arrays, s.numbers, s.strings, s.distinct_values, s.max) == (3, 1, 1, 1, 2, 2.0)
    index = nodes.trigrams(t)
    for q in ("alice", "lic", "zz", "name", "va_lue"):
        assert {r.id for r in nodes.search_indexed(t, index, q).collect()} == {r.id for r in nodes.found(t, q).collect()}
    assert nodes.matches(t, "alice") == [{"path": "$.users[0].name", "name": "name", "value": "alice"}]


def test_stored_index(spark, tmp_path):
    t = tree(spark, USERS)
    path = str(tmp_path / "index")
    nodes.write_index(t, path)
    assert nodes.search_indexed(t, spark.read.parquet(path), "alice").count() == 1
    assert nodes.drop_index(spark, path) and not nodes.drop_index(spark, path)


def test_several_values(spark):
    t = tree(spark, '{"a":1}', '{"a":2} [3]')
    assert nodes.meta(t)["root_id"] == 1
    assert [(r.id, r.path) for r in t.orderBy("id").collect()] == [(1, "$"), (2, "$[0]"), (3, "$[0].a"), (4, "$[1]"), (5, "$[1].a"), (6, "$[2]"), (7, "$[2][0]")]
    assert [r.ord for r in nodes.children(t, 1).collect()] == [0, 1, 2]


def test_scopes(spark):
    t = tree(spark, '{"needle":"needle","x":["needle",1]}')
    assert (nodes.found(t, "needle", "keys").count(), nodes.found(t, "needle", "values").count()) == (1, 2)


@pytest.mark.parametrize(("text", "at"), [("[1,2,]", 5), ('{"a":1,}', 7), ("{", 1), ('"abc', 0), ('{"a"}', 4), ("{a:1}", 1), ("[1 2]", 3)])
def test_bad_json(text, at):
    with pytest.raises(parse.Bad) as e:
        parse.parse_json(text, strict=True)
    assert e.value.at == at


@pytest.mark.parametrize("text", ["01", "1.", "-", "1e", "1e+", ".5", "+1", "", "[tru]", '"\\x"', "1 2x"])
def test_strictly_bad(text):
    with pytest.raises(parse.Bad):
        parse.parse_json(text, strict=True)


@pytest.mark.parametrize("text", ["0", "-0", "0.5", "1e10", "1E-2", "123.456e+7"])
def test_numbers_keep_their_digits(text):
    assert [(x.kind, x.value) for x in parse.parse_json(text, strict=True)] == [(parse.NUMBER, text)]


def test_lenient_json():
    assert [x.value for x in parse.parse_json('{"a":01,}')] == [None, "01"]
    with pytest.raises(parse.Bad):
        parse.parse_json("[1,]")
    with pytest.raises(parse.Bad):
        parse.parse_json("[" * 600)
    assert len(parse.parse_json("[" * 600 + "]" * 600, strict=True)) == 600
    assert parse.unescape("\\ud83d\\ude00 \\ud83d x") == "😀 \ufffd x"
    got = parse.parse_json('{"a":1,"a":{"b":2}}')
    assert [(x.name, x.key) for x in got] == [(None, "i0"), ("a", 'i0\x1ek"a"'), ("a", None), ("b", None)]


values = st.recursive(st.none() | st.booleans() | st.integers() | st.text(), lambda x: st.lists(x) | st.dictionaries(st.text(), x), max_leaves=20)


@given(values)
def test_json_round_trip(v):
    found = parse.parse_json(json.dumps(v), strict=True)
    assert parse.json_values(found) == [v]
    assert json.loads(convert.subtree_json(found)) == v
    assert json.loads(convert.dump(v, 2)) == v


@given(st.lists(values), st.integers(1, 7))
def test_array_splitter(v, n):
    text = json.dumps(v)
    assert [json.loads(x) for x in parse.split_array(text[i : i + n] for i in range(0, len(text), n))] == v


def test_broken_records(spark):
    d = frame(spark, '{"a":1}', "{", None)
    assert [r.rec for r in nodes.broken(d).collect()] == [1]
    assert {r.rec for r in nodes.shred(d, on_error="skip").collect()} == {0}
    with pytest.raises(Exception, match="unexpected end"):
        nodes.shred(d).collect()


XML = '<?xml version="1.0"?><c:catalog xmlns:c="u"><item id="1" cls="a">  hi <b>x</b><!-- no -->tail</item><item id="2"><![CDATA[ <raw> ]]></item><e/></c:catalog>'


def test_xml(spark):
    t = tree(spark, XML, format="xml")
    assert [(r.kind, r.name, r.value) for r in t.where("id > 1").orderBy("id").collect()] == [
        (6, "c:catalog", None), (7, "xmlns:c", "u"), (6, "item", None), (7, "id", "1"), (7, "cls", "a"), (8, None, "hi"), (6, "b", None), (8, None, "x"), (8, None, "tail"),
        (6, "item", None), (7, "id", "2"), (8, None, " <raw> "), (6, "e", None)]
    assert nodes.at_path(t, "/c:catalog/item[2]/@id").first().value == "2"
    assert nodes.at_path(t, "/c:catalog/item/@cls").first().value == "a"
    assert nodes.search(t, "1", "attributes").count() == 1
    assert convert.subtree(t, 11, xml=True)[0] == '<item id="2"> &lt;raw&gt; </item>'
    text, cut = convert.subtree(t, 2, xml=True)
    assert not cut and [x[:6] for x in parse.parse_xml(text)] == [x[:6] for x in parse.parse_xml(XML)]


@pytest.mark.parametrize("text", ["<a></b>", "<a>", "<a b></a>", "<a b=c></a>", "</a>", "<a><!-- </a>", "<a><![CDATA[ </a>"])
def test_bad_xml(text):
    with pytest.raises(parse.Bad):
        parse.parse_xml(text)


def test_csv_documents():
    value = lambda t, **k: parse.json_values(parse.csv_nodes(t, **k))[0]
    assert value('id,zip,q\n1,02134,"123"\n') == [{"id": 1, "zip": "02134", "q": "123"}]
    assert value('a,b\n"x,y\nz",2\n') == [{"a": "x,y\nz", "b": 2}]
    assert value("a,b\n1\n1,2,3\n") == [{"a": 1}, {"a": 1, "b": 2, "#2": 3}]
    assert value("a,b\r\n\r\n1,2\r\n\r\n3,4\r\n") == [{"a": 1, "b": 2}, {"a": 3, "b": 4}]
    assert value("1,2\n3,4\n") == [[1, 2], [3, 4]]
    assert value('a,b\n1,"open\n2,3') == [{"a": 1, "b": "open\n2,3"}]


CASES = [
    ({"start": 1, "junk": 0, "items": [{"price": 1, "junk": 2, "meta": {"sku": "a", "z": 1}}, {"price": 2, "meta": {"sku": "b"}}], "tags": ["a", "b"]}, ["start", "items[].price", "items[].meta.sku", "tags[]"], {"start": 1, "items": [{"price": 1, "meta": {"sku": "a"}}, {"price": 2, "meta": {"sku": "b"}}], "tags": ["a", "b"]}),
    ({"a": 1}, ["a", "b.c"], {"a": 1}),
    ({"a b": 1, "other": 2}, ['["a b"]'], {"a b": 1}),
    ({"o": {"x": 1, "y": 2}, "drop": 1}, ["o"], {"o": {"x": 1, "y": 2}}),
]


@pytest.mark.parametrize(("value", "paths", "want"), CASES)
def test_projection(spark, value, paths, want):
    assert convert.project_value(value, [convert.segments(p) for p in paths]) == want
    assert [json.loads(r.text) for r in convert.project(frame(spark, json.dumps(value)), paths).collect()] == [want]


def test_projection_edges(spark):
    assert convert.project_text('{"a": 1.50}', ["a"]) == '{"a":1.50}'
    assert (convert.project_text("3", ["a"]), convert.project_text("3", ["a"], lines=False)) == ("{}", None)
    df = spark.createDataFrame([((1, [(1, 2), None]), 3)], "a struct<b:int,c:array<struct<d:int,e:int>>>, z int")
    assert convert.project_typed(df, ["a.c[].d"]).first().asDict(True) == {"a": {"c": [{"d": 1}, None]}}


def test_diff(spark):
    a = '{"a":1,"b":{"x":1,"y":[1,2]},"c":[1],"d":"s","e":null,"g.h":{"i":1}}'
    b = '{"a":1,"b":{"x":2,"y":[1,2,{"q":1}]},"c":{"z":1},"e":null,"f":{"n":{"m":1}},"g":{"h":{"i":1}}}'
    got = convert.diff(nodes.shred(frame(spark, a)), nodes.shred(frame(spark, b))).collect()
    assert sorted((r.op, r.path, r.a, r.b) for r in got) == sorted([
        ("changed", "$.b.x", "1", "2"), ("added", "$.b.y[2]", None, "{1 keys}"), ("changed", "$.c", "[1 items]", "{1 keys}"), ("removed", "$.d", "s", None), ("added", "$.f", None, "{1 keys}"), ("removed", "$.g.h", "{1 keys}", None), ("added", "$.g", None, "{1 keys}")])
    report = convert.value_diff(json.loads(a), json.loads(b))
    assert {(e["op"], e["path"]) for e in report["entries"]} == {("changed", "$.b.x"), ("added", "$.b.y[2]"), ("changed", "$.c"), ("removed", "$.d"), ("added", "$.f"), ("removed", '$["g.h"]'), ("added", "$.g")}
    assert (report["added"], report["removed"], report["changed"], report["truncated"]) == (3, 2, 2, False)
    assert not convert.value_diff(1, 1.0)["entries"]
    assert convert.value_diff(1, True)["changed"] == 1
    assert convert.value_diff([1, 2, 3], [], 2)["truncated"]
    for f, word in (("txt", "~ $.b.x: 1 -> 2"), ("csv", "changed,$.b.x,1,2"), ("json", '"truncated": false'), ("html", "<td>$.b.x</td>")):
        assert word in convert.diff_as(report, f)


def test_subtree(spark):
    t = tree(spark, '{"a":[1,{"b":1.50,"b":2}],"c":{}}')
    assert convert.subtree(t, 3, indent=None) == ('[1,{"b":1.50,"b":2}]', False)
    t = tree(spark, json.dumps(list(range(500))))
    text, cut = convert.subtree(t, 2, budget=100)
    assert cut and json.loads(text) == list(range(99))


def test_schema(spark):
    texts = frame(spark, '{"a":1,"b":[1,2.5],"c":{"d":null}}', '{"a":"x","b":[],"e":[{"f":1},{"g":2}]}')
    got = schema.infer_schema(texts)
    assert got["required"] == ["a", "b"]
    p = got["properties"]
    assert (p["a"]["type"], p["b"]["items"], p["c"]["properties"]["d"]) == (["integer", "string"], {"type": "number"}, {"type": "null"})
    assert p["e"]["items"]["required"] == []
    assert [f["select"] for f in schema.field_tree(got)] == ["a", "b[]", "c", "e[]"]
    assert [c["select"] for c in schema.field_tree(got)[3]["children"]] == ["e[].f", "e[].g"]
    assert schema.infer_schema(frame(spark)) == {"$schema": schema.DRAFT}
    assert schema.infer(parse.parse_json(json.dumps([1] * 100 + ["x"])))["items"] == {"type": "integer"}


@given(st.lists(values, min_size=1, max_size=5))
def test_schema_allows_its_records(vs):
    from functools import reduce

    s = reduce(schema.merge, [schema.infer(parse.parse_json(json.dumps(v)), None) for v in vs])
    for v in vs:
        assert schema.Validator(s).faults(v) == []


RULES = [
    ({"type": "integer"}, 1, True), ({"type": "integer"}, 1.5, False), ({"type": ["string", "null"]}, None, True), ({"enum": [1, "a"]}, "b", False), ({"const": True}, 1, False), ({"minLength": 2}, "a", False), ({"maxLength": 2}, "abc", False), ({"pattern": "^a"}, "ba", False),
    ({"minimum": 2}, 1, False), ({"maximum": 2}, 3, False), ({"exclusiveMinimum": 2}, 2, False), ({"exclusiveMaximum": 2}, 2, False), ({"multipleOf": 0.1}, 0.3, True), ({"multipleOf": 2}, 3, False), ({"allOf": [{"minimum": 1}, {"maximum": 2}]}, 3, False), ({"anyOf": [{"type": "string"}, {"minimum": 5}]}, 6, True),
    ({"oneOf": [{"minimum": 1}, {"minimum": 2}]}, 3, False), ({"not": {"type": "string"}}, "a", False), ({"minProperties": 1}, {}, False), ({"maxProperties": 1}, {"a": 1, "b": 2}, False), ({"additionalProperties": False, "properties": {"a": {}}}, {"b": 1}, False), ({"additionalProperties": {"type": "string"}}, {"b": 1}, False), ({"required": ["a"]}, {}, False),
    ({"minItems": 1}, [], False), ({"maxItems": 1}, [1, 2], False), ({"items": {"type": "string"}}, ["a", 1], False), ({"items": [{"type": "string"}, {"type": "integer"}]}, ["a", 1], True), ({"$ref": "#/definitions/x", "definitions": {"x": {"minimum": 3}}}, 2, False), ({"$ref": "#/nowhere"}, 2, False), (False, 1, False), ({"$ref": "#"}, 1, True)]


@pytest.mark.parametrize(("rule", "value", "fine"), RULES)
def test_validation(rule, value, fine):
    assert (not schema.Validator(rule).faults(value)) == fine


def test_validation_of_tables(spark):
    got = schema.validate(frame(spark, '{"a":1}', '{"a":"x","b":[1,"y"]}', "{"), {"properties": {"a": {"type": "integer"}, "b": {"items": {"type": "integer"}}}}, "rec")
    assert sorted((r.key, r.path) for r in got.collect()) == [("1", "$.a"), ("1", "$.b[1]"), ("2", "$")]


def test_conversions(spark):
    v = {"a": [1, {"b": "x: y"}], "e": {}, "n": None, "t": "true", "s": "plain"}
    assert convert.to_yaml(v) == 'a:\n  - 1\n  -\n    b: "x: y"\ne: {}\nn: null\nt: "true"\ns: plain'
    assert convert.to_xml({"a": [1, 2], "1x": "<"}) == "<root>\n  <a>1</a>\n  <a>2</a>\n  <_1x>&lt;</_1x>\n</root>"
    assert convert.to_xml([{}, None]) == "<root>\n  <item/>\n  <item></item>\n</root>"
    assert convert.to_csv([{"a": 1, "b": [1]}, {"c": 'x"'}, 5]) == 'a,b,c\n1,[1],\n,,"x"""\n5,5,5'
    assert convert.to_csv({"rows": [1, 2], "n": 2}) == "value\n1\n2"
    for bad in ({"a": 1}, 3, [[1]]):
        with pytest.raises(ValueError):
            convert.to_csv(bad)
    assert convert.xml_object('<r a="1"><x>1</x><x/>t</r>') == {"r": {"@a": "1", "x": ["1", ""], "#text": "t"}}
    assert convert.xml_object("<a/><b/>") == {"root": {"a": "", "b": ""}}
    assert [r.text for r in convert.converted(frame(spark, '{"a":1.50}', None), "yaml").collect()] == ["a: 1.50", None]


def test_files(spark, tmp_path):
    (tmp_path / "a.ndjson").write_text('{"a":1}\n\n{"a":2}\n')
    t = nodes.document(nodes.shred(nodes.read_lines(spark, str(tmp_path / "a.ndjson"), "a")))
    assert [r.path for r in t.where("kind = 3").orderBy("id").collect()] == ["$[0].a", "$[1].a"]
    nodes.write(t, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == t.count()
    (tmp_path / "b.json").write_text("[1, 2, {}]")
    assert [r.text for r in convert.array_table(spark, str(tmp_path / "b.json")).orderBy("rec").collect()] == ["1", "2", "{}"]
    assert nodes.read_whole(spark, str(tmp_path / "b.json")).first().text == "[1, 2, {}]"
