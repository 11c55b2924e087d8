"""Tables of nodes: the same from texts read by their shapes as from each text parsed, and no work left to one task."""

import json
import random
import re

import pytest
from hypothesis import given
from hypothesis import strategies as st

from stratalens.documents import convert, nodes, parse
from stratalens.operators import rows
from stratalens.plans import star

FOLDER = "/root/testdata/sf0.001"
values = st.recursive(st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False, allow_infinity=False) | st.text('ab"\\:,{}[]-1e \n\x1eé😀'), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text('ab"\\: 1', max_size=3), x, max_size=4), max_leaves=12)


def frame(spark, *texts, doc="d"):
    return spark.createDataFrame([(doc, i, t) for i, t in enumerate(texts)], "doc string, rec long, text string")


def outcome(f, text):
    try:
        return f(text)
    except parse.Bad as e:
        return str(e)


READER = parse.Reader(parse.parse_json)


def by_shape(text):
    shape, found = READER.read(text)
    return shape.filled(found)


@given(values, st.integers(0, 80), st.sampled_from(["", '"', "\\", ",", ":", "}", "]", "1", "-", "e", "true", "\n", '"a":', '"x"', ",}", "\\ud83d"]), st.booleans())
def test_shapes_read_as_the_parser_does(v, at, sign, ascii_):
    text = json.dumps(v, ensure_ascii=ascii_)
    for t in (text, text[:at] + sign + text[at:], text[:at] + sign + text[at + 1 :]):
        assert outcome(by_shape, t) == outcome(parse.parse_json, t)


@pytest.mark.parametrize(("good", "bad"), [('{"a":1}', '{"a":}'), ('{"a":1,}', '{"a":,1}'), ("[1,2]", "[1,2"), ('["a"]', '["a":]'), ('{"a":"b"}', '{"a":"b}')])
def test_a_known_shape_lets_nothing_else_pass(good, bad):
    reader = parse.Reader(parse.parse_json)
    reader.read(good)
    with pytest.raises(parse.Bad):
        reader.read(bad)


def test_alike_texts_are_parsed_once(monkeypatch):
    calls = []
    real = parse.parse_json
    monkeypatch.setattr(parse, "parse_json", lambda t: calls.append(t) or real(t))
    reader = parse.Reader(parse.parse_json)
    for k in range(1000):
        shape, found = reader.read(f'{{"k": {k}, "s": "{k}\\n"}}')
        assert [x.value for x in shape.filled(found)] == [None, str(k), f"{k}\n"]
    assert len(calls) == 1
    for k in range(3000):  # other shapes; what is remembered has an end
        reader.read("[" + ",".join(["1"] * (k % 300)) + f']{{"n{k}":true}}')
    assert reader.held <= reader.KNOWN + 1


def test_nodes_come_in_large_batches():
    records = [(("d", k), *parse.Reader(parse.parse_json).read(f'{{"a":[{k},true]}}')) for k in range(100)]
    b = nodes._batch(records, ["doc", "rec"], list(nodes.TYPES))
    assert b.num_rows == 400
    assert [x["value"] for x in b.slice(396).to_pylist()] == [None, None, "99", "true"]


def test_shred_is_the_parser(spark):
    r = random.Random(3)
    value = lambda d=0: r.choice([1, "x", 'q"\\', None, True, 2.5]) if d > 2 or r.random() < 0.5 else [value(d + 1) for _ in range(r.randrange(4))] if r.random() < 0.5 else {r.choice("abc"): value(d + 1) for _ in range(r.randrange(4))}
    texts = [json.dumps(value()) for _ in range(300)] + ["", '{"a":1,"a":2} [3]', json.dumps(["z" * 70_000, 1]), json.dumps(list(range(nodes.BATCH_NODES * 2 + 5))), json.dumps(list(range(25_000)))]
    got = nodes.shred(frame(spark, *texts)).collect()
    want = [("d", k, *x) for k, t in enumerate(texts) for x in parse.parse_json(t)]
    assert sorted(map(tuple, got), key=lambda x: x[1:3]) == want
    some = nodes.shred(frame(spark, *texts), columns=["value", "rec"])
    assert some.columns == ["value", "rec"] and some.count() == len(want)


def test_several_queries(spark):
    t = nodes.shred(frame(spark, '{"p":"tags","tags":["p",1],"px":0}'))
    assert sorted(r.path for r in nodes.found(t, ["p", "tags"], "keys", exact=True).collect()) == [".p", ".tags"]
    assert nodes.found(t, ["p", "tags"], "values", exact=True).count() == 2


def test_one_row_group_is_read_by_all_tasks(spark):
    for texts in (star.json_texts(spark, FOLDER), star.event_texts(spark, FOLDER)):
        assert texts.rdd.getNumPartitions() == 8
        assert max(len(p) for p in texts.rdd.glom().collect()) < texts.count() / 2


@pytest.mark.parametrize("make", [lambda t, f: nodes.document(nodes.shred(t, f), f == "xml"), nodes.shred_document])
@pytest.mark.parametrize("format", ["json", "xml"])
def test_documents_are_numbered(spark, make, format):
    r = random.Random(5)
    one = (lambda: "[" + ",".join(["1"] * r.randrange(5)) + "]" + r.choice(["", ' {"a":2}'])) if format == "json" else (lambda: "<a>" + "<b/>" * r.randrange(4) + "</a>")
    docs = {d: {k * 7 - 20: one() for k in range(n)} for d, n in (("x", 200), ("y", 1), ("z", 3))}
    table = [(d, rec, t) for d, rs in docs.items() for rec, t in rs.items()] + [("x", 5000, None)] * (format == "json") + [("none", 0, None)] * (format == "json")
    r.shuffle(table)
    want = []
    for d, rs in docs.items():
        found = [(rec, parse.parse_json(t) if format == "json" else parse.parse_xml(t)) for rec, t in sorted(rs.items())]
        tops = [x for _, f in found for x in f if x.parent is None]
        want.append((d, 1, None, 0, len(tops), "" if format == "xml" else "$"))
        ids = before = 0
        for rec, f in found:
            mine = [x for x in f if x.parent is None]
            for x in f:
                place = before + [m.id <= x.id for m in mine].count(True) - 1
                path = x.path if format == "xml" else ("$" if len(tops) == 1 else f"$[{place}]") + x.path
                want.append((d, x.id + ids + 1, 1 if x.parent is None else x.parent + ids + 1, x.ord + before if x.parent is None else x.ord, x.n_children, path))
            ids, before = ids + len(f), before + len(mine)
    got = make(spark.createDataFrame(table, "doc string, rec long, text string"), format).select("doc", "id", "parent_id", "ord", "n_children", "path").collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_no_task_sorts_a_whole_document(spark):
    plan = nodes.shred_document(star.json_texts(spark, FOLDER))._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line and "rec" in line.split("windowspecdefinition", 1)[1].split("specifiedwindowframe")[0]]
    assert windows and all("__part" in line for line in windows)


def test_broken_records_of_a_document(spark):
    d = frame(spark, '{"a":1}', "{", None, "[2]")
    assert [(x.id, x.path) for x in nodes.shred_document(d, on_error="skip").orderBy("id").collect()] == [(1, "$"), (2, "$[0]"), (3, "$[0].a"), (4, "$[1]"), (5, "$[1][0]")]
    with pytest.raises(Exception, match="unexpected end"):
        nodes.shred_document(d).collect()


def test_index_of_letters_that_grow_small(spark):
    n = nodes.shred(frame(spark, '["İİab", "HIGH", "xhighx", "hi"]'))
    index = nodes.trigrams(n)
    for q in ("ab", "i̇ab", "high", "igh"):
        assert {x.id for x in nodes.search_indexed(n, index, q).collect()} == {x.id for x in nodes.found(n, q).collect()}
    assert nodes.search_indexed(n, index, "i̇ab").count() == 1


def test_differences_of_texts_are_those_of_nodes(spark):
    r = random.Random(7)
    value = lambda d=0: r.choice([1, 2, "x", "y" * 500, None, True, 'q"']) if d > 2 or r.random() < 0.4 else [value(d + 1) for _ in range(r.randrange(4))] if r.random() < 0.4 else {r.choice(["a", "b", "c d"]): value(d + 1) for _ in range(r.randrange(4))}
    pairs = [(json.dumps(value()), json.dumps(value())) for _ in range(150)] + [('{"a":1,"a":2}', '{"a":1,"a":3}'), ('{"a":[1,{"b":2}]}', '{"a":[3,{"b":4}]}'), ("[1]", "[1]"), (None, "[1]"), ("[1]", None), ("1 [2]", "1 [3] 4")]
    a, b = frame(spark, *(x for x, _ in pairs)), frame(spark, *(y for _, y in pairs))
    a, b = a.where("rec % 10 <> 3"), b.where("rec % 10 <> 4")
    order = lambda d: sorted(map(str, d.collect()))
    got = order(convert.diff_texts(a, b))
    assert got and got == order(convert.diff(nodes.shred(a), nodes.shred(b)))
    x, y = frame(spark, "[1]", "{", "{"), frame(spark, "{", "[1]", "{")
    assert order(convert.diff_texts(x, y, on_error="skip")) == order(convert.diff(nodes.shred(x, on_error="skip"), nodes.shred(y, on_error="skip")))
    with pytest.raises(Exception, match="unexpected end"):
        convert.diff_texts(x.where("rec = 2"), y.where("rec = 2")).collect()
    p = frame(spark, "<a><b>1</b><b>2</b></a>"), frame(spark, '<a k="1"><b>3</b></a>')
    assert order(convert.diff_texts(*p, "xml")) == order(convert.diff(*(nodes.shred(t, "xml") for t in p)))


def test_texts_are_compared_without_a_join_of_nodes(spark):
    left = star.json_texts(spark, FOLDER)
    plan = convert.diff_texts(left, left)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and plan.index("MapInArrow") < plan.index("Join")


def test_stored_tables(spark):
    d = rows.stored(spark.range(5), "five")
    assert d.count() == 5 and "/stratalens/five-" in d.inputFiles()[0]


#: The columns that Python makes for a query.
MADE = [
    ("json_search_keys", "rec name path"),
    ("json_nodes", "rec kind value path"),
    ("json_search", "rec value path"),
    ("json_stats", "kind value path"),
    ("json_path", "rec value path"),
]


@pytest.mark.parametrize(("name", "columns"), MADE)
def test_only_what_a_query_needs_is_made_and_once(spark, name, columns):
    plan = star.QUERIES[name](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    made = re.findall(r"MapInArrow [^\n]*?, \[([^\]]*)\]", plan)
    assert [sorted(re.sub(r"#\d+L?", "", m).split(", ")) for m in made] == [sorted(columns.split())]
