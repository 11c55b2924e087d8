"""Projection of records to chosen paths, differences of documents, and documents as JSON, XML, YAML or CSV texts."""

from __future__ import annotations

import csv
import io
import json
import re
from collections.abc import Callable, Iterator
from xml.parsers import expat

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalens.documents import parse

_NOTHING = object()
MAX_SUMMARY = 120


def segments(path: str) -> list[str | None]:
    """Keys of a path, None for [] (each element)."""
    out: list[str | None] = []
    for m in re.finditer(r'\[\]|\[("(?:[^"\\]|\\.)*"|[^\]]*)\]|[^.\[]+', path):
        if m[0] == "[]":
            out.append(None)
        elif m[1] is not None:
            out.append(json.loads(m[1]) if m[1].startswith('"') else m[1])
        else:
            out.append(m[0])
    return out


def project_value(v: object, wanted: list[list[str | None]]) -> object:
    """v with the wanted paths only: keys in their own order, elements of which nothing is left dropped; _NOTHING where there is nothing."""
    if any(not w for w in wanted):
        return v
    if isinstance(v, list):
        inner = [w[1:] for w in wanted if w[0] is None]
        return [x for x in (project_value(e, inner) for e in v) if x is not _NOTHING] if inner else _NOTHING
    if isinstance(v, dict):
        out = {}
        for k, x in v.items():
            inner = [w[1:] for w in wanted if w[0] == k]
            if inner and (y := project_value(x, inner)) is not _NOTHING:
                out[k] = y
        return out
    return _NOTHING


class _Number(float):
    """A number that is written with its own digits."""

    def __new__(cls, text: str):
        x = super().__new__(cls, text)
        x.text = text
        return x

    def __repr__(self) -> str:
        return self.text


def dump(v: object, indent: int | None = None) -> str:
    """JSON, numbers with the digits they came with."""
    pad = lambda n: "" if indent is None else "\n" + " " * (indent * n)
    colon = ":" if indent is None else ": "

    def go(x: object, n: int) -> str:
        if isinstance(x, dict):
            return "{" + ",".join(pad(n + 1) + json.dumps(k, ensure_ascii=False) + colon + go(y, n + 1) for k, y in x.items()) + (pad(n) if x else "") + "}"
        if isinstance(x, list):
            return "[" + ",".join(pad(n + 1) + go(y, n + 1) for y in x) + (pad(n) if x else "") + "]"
        return x.text if isinstance(x, _Number) else json.dumps(x, ensure_ascii=False)

    return go(v, 0)


def load(text: str) -> object:
    return json.loads(text, parse_float=_Number, parse_int=lambda t: _Number(t) if len(t) < 300 else int(t))


def project_text(text: str, paths: list[str], lines: bool = True) -> str | None:
    """A record's text projected; where nothing is left, {} in a file of lines and nothing in an array."""
    got = project_value(load(text), [segments(p) for p in paths])
    return ("{}" if lines else None) if got is _NOTHING else dump(got)


def project(texts: DataFrame, paths: list[str], column: str = "text", lines: bool = True) -> DataFrame:
    """texts with the column's records projected, in Arrow batches; of records that are arrays the elements are."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else project_text(t, paths, lines))

    out = texts.withColumn(column, run(column))
    return out if lines else out.where(F.col(column).isNotNull())


def project_typed(df: DataFrame, paths: list[str]) -> DataFrame:
    """Typed tables projected by columns alone: only the fields that the paths name are read."""

    def shape(dtype: T.DataType, c, wanted: list[list[str | None]]):
        if any(not w for w in wanted):
            return c
        if isinstance(dtype, T.ArrayType):
            return F.transform(c, lambda x: shape(dtype.elementType, x, [w[1:] for w in wanted if w[0] is None]))
        keep = [(f, [w[1:] for w in wanted if w[0] == f.name]) for f in dtype]
        return F.when(c.isNotNull(), F.struct(*(shape(f.dataType, c.getField(f.name), w).alias(f.name) for f, w in keep if w)))

    want = [segments(p) for p in paths]
    keep = [(f, [w[1:] for w in want if w[0] == f.name]) for f in df.schema]
    return df.select(*(shape(f.dataType, F.col(f"`{f.name}`"), w).alias(f.name) for f, w in keep if w))


def diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """(doc, rec, op, path, a, b) of what differs between two tables of nodes (from `shred`): added and removed subtrees once, at their top; objects by key, of repeated keys the first, arrays by place, other values as texts. Paths are keys, so the walk is one full outer join by key and a semi-join with the parents that both have alike."""

    def side(n: DataFrame, s: str) -> DataFrame:
        value = F.when(F.col("kind").isin(parse.OBJECT, parse.ELEMENT), F.concat(F.lit("{"), F.col("n_children"), F.lit(" keys}"))).when(F.col("kind") == parse.ARRAY, F.concat(F.lit("["), F.col("n_children"), F.lit(" items]"))).when(F.col("kind") == parse.NULL, "null").otherwise(F.when(F.length("value") > MAX_SUMMARY, F.concat(F.substring("value", 1, MAX_SUMMARY), F.lit("…"))).otherwise(F.coalesce("value", F.lit(""))))
        return n.where("key is not null").select("doc", "rec", "key", F.col("kind").alias(f"kind_{s}"), value.alias(f"text_{s}"), F.coalesce("value", F.lit("")).alias(f"value_{s}"))

    both = side(a, "a").join(side(b, "b"), ["doc", "rec", "key"], "full")
    alike = F.col("kind_a") == F.col("kind_b")
    container = F.col("kind_a").isin(parse.OBJECT, parse.ARRAY, parse.ELEMENT)
    op = F.when(F.col("kind_b").isNull(), "removed").when(F.col("kind_a").isNull(), "added").when(~alike | (~container & (F.col("value_a") != F.col("value_b"))), "changed")
    parent = F.regexp_replace("key", "\x1e[^\x1e]*$", "")
    found = both.withColumns({"op": op, "parent": parent}).where("op is not null")
    alone = found.where("op <> 'changed' and parent <> key").join(both.where(alike & container).select("doc", "rec", F.col("key").alias("parent")), ["doc", "rec", "parent"], "left_semi")
    out = found.where("op = 'changed' or parent = key").unionByName(alone)
    # the first step of a key is the record's place; names stand in JSON's quotes
    shown = F.transform(F.slice(F.split("key", "\x1e"), F.lit(2), F.size(F.split("key", "\x1e"))), lambda s: F.when(s.startswith("i"), F.concat(F.lit("["), F.substr(s, F.lit(2)), F.lit("]"))).otherwise(F.concat(F.lit("."), F.get_json_object(F.concat(F.lit('{"k":'), F.substr(s, F.lit(2)), F.lit("}")), "$.k"))))
    return out.select("doc", "rec", "op", F.concat(F.lit("$"), F.array_join(shown, "")).alias("path"), F.col("text_a").alias("a"), F.col("text_b").alias("b"))


def _summary(x: parse.Node) -> str:
    if x.kind in (parse.OBJECT, parse.ELEMENT):
        return f"{{{x.n_children} keys}}"
    if x.kind == parse.ARRAY:
        return f"[{x.n_children} items]"
    value = "null" if x.kind == parse.NULL else x.value or ""
    return value[:MAX_SUMMARY] + "…" if len(value) > MAX_SUMMARY else value


def _shown(key: str) -> str:
    """The path of a key: its first step is the record's place, and names stand in JSON's quotes."""
    return "$" + "".join(f"[{s[1:]}]" if s[0] == "i" else f".{json.loads(s[1:])}" for s in key.split("\x1e")[1:])


def node_diff(a: list[parse.Node], b: list[parse.Node]) -> Iterator[tuple[str, str, str | None, str | None]]:
    """(op, path, a, b) of what differs between two records, as `diff` says."""
    left, right = ({x.key: x for x in nodes if x.key is not None} for nodes in (a, b))
    holds = (parse.OBJECT, parse.ARRAY, parse.ELEMENT)
    for key in left | right:
        x, y = left.get(key), right.get(key)
        if x and y:
            if x.kind != y.kind or (x.kind not in holds and (x.value or "") != (y.value or "")):
                yield "changed", _shown(key), _summary(x), _summary(y)
            continue
        above = key.rpartition("\x1e")[0]
        if not above or (above in left and above in right and left[above].kind == right[above].kind and left[above].kind in holds):
            yield ("removed", _shown(key), _summary(x), None) if x else ("added", _shown(key), None, _summary(y))


def diff_texts(a: DataFrame, b: DataFrame, format: str = "json", on_error: str = "raise") -> DataFrame:
    """`diff` of two tables of texts (doc, rec, text): the records are joined, not their nodes, and both texts of a record compared in one place. All are read, so that broken ones are found; equal ones don't differ, and of ones of the same shape only values are looked at. (doc, rec) must be unique on each side."""
    from stratalens.documents import nodes

    read = nodes._READERS[format]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = parse.Reader(read)

        def one(text: str | None) -> tuple[parse.Shape, list]:
            try:
                return reader.read(text or "")
            except parse.Bad:
                if on_error == "raise":
                    raise
                return parse.Shape([], []), []

        def differences(x: str | None, y: str | None) -> Iterator[tuple[str, str, str | None, str | None]]:
            s, v = one(x)
            if x == y:
                return
            t, w = one(y)
            if s is not t:
                yield from node_diff(s.filled(v), t.filled(w))
            elif v != w:
                some = [k for k, i in enumerate(s.slots) if i >= 0 and v[i] != w[i]]
                yield from node_diff(*([s.nodes[k]._replace(value=z[s.slots[k]]) for k in some] for z in (v, w)))

        for batch in batches:
            out = [(doc, rec, *d) for doc, rec, x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True) for d in differences(x, y)]
            types = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], ["doc", "rec", "op", "path", "a", "b"])

    left, right = (nodes._select(t).withColumnRenamed("text", s) for t, s in ((a, "a"), (b, "b")))
    return left.join(right, ["doc", "rec"], "full").mapInArrow(run, "doc string, rec long, op string, path string, a string, b string")


def value_diff(x: object, y: object, limit: int = 5000) -> dict:
    """The same for two values on the driver, typed: 1 and 1.0 are equal; names that aren't words stand in quotes."""
    out: list[dict] = []
    count = {"added": 0, "removed": 0, "changed": 0}

    def say(op: str, path: str, a: object, b: object) -> None:
        count[op] += 1
        if len(out) < limit:
            show = lambda v: "" if v is _NOTHING else json.dumps(v, ensure_ascii=False)[:400] if isinstance(v, (dict, list)) or v is None or isinstance(v, bool) else str(v)
            out.append({"op": op, "path": path, "a": show(a), "b": show(b)})

    kind = lambda v: "null" if v is None else "boolean" if isinstance(v, bool) else "number" if isinstance(v, (int, float)) else type(v).__name__
    todo = [(x, y, "$")]
    while todo:
        a, b, path = todo.pop()
        if kind(a) != kind(b):
            say("changed", path, a, b)
        elif isinstance(a, dict):
            at = lambda k: path + parse.step(k, parse.STRING, parse.OBJECT, 0, False)
            todo += reversed([(a[k], b[k], at(k)) for k in a if k in b])
            for k in a:
                if k not in b:
                    say("removed", at(k), a[k], _NOTHING)
            for k in b:
                if k not in a:
                    say("added", at(k), _NOTHING, b[k])
        elif isinstance(a, list):
            n = min(len(a), len(b))
            todo += reversed([(a[i], b[i], f"{path}[{i}]") for i in range(n)])
            for i in range(n, len(a)):
                say("removed", f"{path}[{i}]", a[i], _NOTHING)
            for i in range(n, len(b)):
                say("added", f"{path}[{i}]", _NOTHING, b[i])
        elif a != b:
            say("changed", path, a, b)
    return count | {"truncated": sum(count.values()) > len(out), "entries": out}


def diff_as(report: dict, format: str = "txt") -> str:
    """A difference as TXT, JSON, CSV or HTML."""
    rows = report["entries"]
    if format == "json":
        return json.dumps(report, ensure_ascii=False, indent=2)
    if format == "csv":
        out = io.StringIO()
        w = csv.DictWriter(out, ["op", "path", "a", "b"], lineterminator="\n")
        w.writeheader()
        w.writerows(rows)
        return out.getvalue()
    if format == "html":
        cell = lambda v: _escape("" if v is None else str(v))
        body = "\n".join(f"<tr class=\"{r['op']}\"><td>{r['op']}</td><td>{cell(r['path'])}</td><td>{cell(r['a'])}</td><td>{cell(r['b'])}</td></tr>" for r in rows)
        return f"<table>\n<tr><th>op</th><th>path</th><th>a</th><th>b</th></tr>\n{body}\n</table>"
    return "\n".join(f"{dict(added='+', removed='-', changed='~')[r['op']]} {r['path']}: {r['a'] or ''} -> {r['b'] or ''}" for r in rows)


def _escape(s: str, attribute: bool = False) -> str:
    s = s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    return s.replace('"', "&quot;") if attribute else s


def subtree_json(nodes: list[parse.Node], indent: int | None = 2) -> str:
    """A subtree's text from its nodes in pre-order, the first its top; repeated keys and digits stay."""
    out: list[str] = []
    open_: list[list] = []  # [closing sign, children to come, any written]
    pad = lambda: "" if indent is None else "\n" + " " * (indent * len(open_))
    named = False
    for x in nodes:
        if open_:
            out.append(("," if open_[-1][2] else "") + pad())
            open_[-1][2] = True
            open_[-1][1] -= 1
            named = open_[-1][0] == "}"
            if named:
                out.append(json.dumps(x.name or "", ensure_ascii=False) + (":" if indent is None else ": "))
        if x.kind in (parse.OBJECT, parse.ARRAY):
            a, b = "{}" if x.kind == parse.OBJECT else "[]"
            if x.n_children:
                out.append(a)
                open_.append([b, x.n_children, False])
                continue
            out.append(a + b)
        else:
            out.append("null" if x.kind == parse.NULL else json.dumps(x.value, ensure_ascii=False) if x.kind not in (parse.NUMBER, parse.BOOL) else x.value)
        while open_ and not open_[-1][1]:
            close = open_.pop()[0]
            out.append(pad() + close)
    return "".join(out)


def subtree_xml(nodes: list[parse.Node]) -> str:
    """A subtree of elements as XML: attributes in the tag, a text alone beside its tags, empty elements closed at once."""
    kids: dict[int | None, list[parse.Node]] = {}
    for x in nodes[1:]:
        kids.setdefault(x.parent, []).append(x)
    out: list[str] = []
    todo: list[tuple[parse.Node | str, int]] = [(nodes[0], 0)] if nodes else []
    while todo:
        x, n = todo.pop()
        pad = "  " * n
        if isinstance(x, str):
            out.append(pad + x)
        elif x.kind == parse.ELEMENT:
            own = kids.get(x.id, [])
            inner = [k for k in own if k.kind != parse.ATTRIBUTE]
            tag = x.name + "".join(f' {k.name}="{_escape(k.value or "", True)}"' for k in own if k.kind == parse.ATTRIBUTE)
            if not inner:
                out.append(f"{pad}<{tag}/>")
            elif len(inner) == 1 and inner[0].kind == parse.TEXT:
                out.append(f"{pad}<{tag}>{_escape(inner[0].value or '')}</{x.name}>")
            else:
                out.append(f"{pad}<{tag}>")
                todo.append((f"</{x.name}>", n))
                todo += [(k, n + 1) for k in reversed(inner)]
        elif x.kind == parse.ATTRIBUTE:
            out.append(f'{pad}{x.name}="{_escape(x.value or "", True)}"')
        else:
            out.append(pad + _escape(x.value or ""))
    return "\n".join(out)


def subtree(nodes: DataFrame, id: int, budget: int = 50_000, xml: bool = False, indent: int | None = 2) -> tuple[str, bool]:
    """(text of a node and what is below it, whether the budget cut it). Ids are in pre-order, so a subtree is a range of ids: from the node up to the next one that isn't deeper."""
    top = nodes.where(F.col("id") == id).select("depth").head()
    if top is None:
        raise KeyError(id)
    end = nodes.where((F.col("id") > id) & (F.col("depth") <= top[0])).agg(F.min("id")).first()[0]
    inside = nodes.where((F.col("id") >= id) & (F.col("id") < end if end is not None else F.lit(True)))
    budget = max(100, min(budget, 300_000))
    rows = inside.select("id", "parent_id", "ord", "depth", "kind", "name", "value", "n_children").orderBy("id").limit(budget + 1).collect()
    cut = len(rows) > budget
    got = [parse.Node(*r, "", None) for r in rows[:budget]]
    if cut:  # containers hold what is left of their children
        seen: dict[int | None, int] = {}
        for x in got:
            seen[x.parent] = seen.get(x.parent, 0) + 1
        got = [x._replace(n_children=seen.get(x.id, 0)) for x in got]
    return (subtree_xml(got) if xml else subtree_json(got, indent)), cut


_PLAIN = re.compile(r"[:#\[\]{}&*!|>'\"%@`,\n\t]|^[\s-]|\s$|^(?:true|false|null|~|yes|no|on|off)$|^[+-]?[\d.eE+]+$|^$", re.IGNORECASE)


def _yaml_scalar(v: object) -> str:
    if isinstance(v, str):
        return json.dumps(v, ensure_ascii=False) if _PLAIN.search(v) else v
    return dump(v)


def to_yaml(v: object, level: int = 0) -> str:
    pad = "  " * level
    if isinstance(v, list):
        return "\n".join(f"{pad}-\n{to_yaml(x, level + 1)}" if isinstance(x, (dict, list)) else f"{pad}- {_yaml_scalar(x)}" for x in v) or f"{pad}[]"
    if isinstance(v, dict):
        out = []
        for k, x in v.items():
            key = k if re.fullmatch(r"[\w.-]+", k, re.ASCII) else json.dumps(k, ensure_ascii=False)
            if isinstance(x, (dict, list)) and x:
                out.append(f"{pad}{key}:\n{to_yaml(x, level + 1)}")
            else:
                out.append(f"{pad}{key}: {'[]' if x == [] else '{}' if x == {} else _yaml_scalar(x)}")
        return "\n".join(out) or f"{pad}{{}}"
    return pad + _yaml_scalar(v)


def _tag(k: str) -> str:
    n = re.sub(r"[^\w.-]", "_", k, flags=re.ASCII)
    return n if re.match(r"[A-Za-z_]", n) else "_" + n


def to_xml(v: object) -> str:
    """An object's keys as elements under <root>, arrays as the element repeated; a root array as <item>s."""

    def go(x: object, name: str, n: int) -> str:
        pad = "  " * n
        if isinstance(x, list):
            return "\n".join(go(y, name, n) for y in x)
        if isinstance(x, dict):
            if not x:
                return f"{pad}<{_tag(name)}/>"
            return f"{pad}<{_tag(name)}>\n" + "\n".join(go(y, k, n + 1) for k, y in x.items()) + f"\n{pad}</{_tag(name)}>"
        text = "" if x is None else x if isinstance(x, str) else dump(x)
        return f"{pad}<{_tag(name)}>{_escape(text)}</{_tag(name)}>"

    return "<root>\n" + "\n".join(go(x, "item", 1) for x in v) + "\n</root>" if isinstance(v, list) else go(v, "root", 0)


def to_csv(v: object) -> str:
    """An array of objects as a table of all their keys in the order of appearance; of other values as a column; an object with one array as that array."""
    if isinstance(v, dict):
        arrays = [x for x in v.values() if isinstance(x, list)]
        v = arrays[0] if len(arrays) == 1 else None
    if not isinstance(v, list):
        raise ValueError("only an array is a table")

    def cell(x: object) -> str:
        s = "" if x is None else x if isinstance(x, str) else dump(x)
        return '"' + s.replace('"', '""') + '"' if re.search(r'[",\n\r]', s) else s

    if not any(isinstance(x, (dict, list)) for x in v):
        return "\n".join(["value", *map(cell, v)])
    names = list(dict.fromkeys(k for x in v if isinstance(x, dict) for k in x))
    if not names:
        raise ValueError("no element has a name")
    return "\n".join([",".join(map(cell, names)), *(",".join(cell(x.get(k) if isinstance(x, dict) else x) for k in names) for x in v)])


def xml_object(text: str) -> dict:
    """XML as an object: attributes as @name, repeated children as arrays, text beside others as #text, nothing as ''. A fragment of several elements stands under root."""
    try:
        return _xml_object(text)
    except expat.ExpatError:
        return _xml_object(f"<root>{text}</root>")


def _xml_object(text: str) -> dict:
    top: dict = {}
    stack: list[tuple[dict, list[str]]] = [(top, [])]

    def start(_: str, attributes: dict) -> None:
        stack.append(({f"@{k}": v for k, v in attributes.items()}, []))

    def end(name: str) -> None:
        own, texts = stack.pop()
        t = "".join(texts).strip()
        got: object = own
        if t and own:
            own["#text"] = t
        elif not own:
            got = t
        up = stack[-1][0]
        if name not in up:
            up[name] = got
        elif isinstance(up[name], list):
            up[name].append(got)
        else:
            up[name] = [up[name], got]

    p = expat.ParserCreate()
    p.StartElementHandler, p.EndElementHandler = start, end
    p.CharacterDataHandler = lambda s: stack[-1][1].append(s)
    p.Parse(text, True)
    return top


def converted(texts: DataFrame, to: str, column: str = "text") -> DataFrame:
    """texts with the column's JSON as yaml, xml or csv, or its XML as json."""
    how: Callable[[str], str] = {"yaml": lambda t: to_yaml(load(t)), "xml": lambda t: to_xml(load(t)), "csv": lambda t: to_csv(load(t)), "json": lambda t: dump(xml_object(t))}[to]

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else how(t))

    return texts.withColumn(column, run(column))


def array_elements(path: str, size: int = 1 << 20) -> Iterator[str]:
    """The elements' texts of a file with one JSON array, read piece by piece."""

    def pieces() -> Iterator[str]:
        with open(path, encoding="utf-8-sig") as f:
            while t := f.read(size):
                yield t

    yield from parse.split_array(pieces())


def array_table(spark, path: str) -> DataFrame:
    """(rec, text) of the elements of one JSON array: one task splits, as only reading tells where elements end; the records are spread afterwards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            pass
        rec, held = 0, []
        for t in array_elements(path):
            held.append(t)
            if len(held) == 1000:
                yield pa.RecordBatch.from_arrays([pa.array(range(rec, rec + len(held)), pa.int64()), pa.array(held, pa.string())], ["rec", "text"])
                rec, held = rec + len(held), []
        yield pa.RecordBatch.from_arrays([pa.array(range(rec, rec + len(held)), pa.int64()), pa.array(held, pa.string())], ["rec", "text"])

    return spark.range(1, numPartitions=1).mapInArrow(run, "rec long, text string")
