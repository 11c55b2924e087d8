"""JSON Schema: inferred from records and merged by Spark, fields listed, records checked."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalens.documents import parse

SAMPLES, OBJECT_KEYS, NODES, DEPTH, ERRORS = 100, 1000, 2_000_000, 64, 1000
DRAFT = "http://json-schema.org/draft-07/schema#"


def infer(nodes: list[parse.Node], samples: int | None = SAMPLES) -> dict:
    """The schema of one value from its nodes, children before parents; of arrays the first `samples` elements count."""
    done: dict[int, dict] = {}
    kids: dict[int, list[parse.Node]] = {}
    for x in reversed(nodes):
        own = kids.pop(x.id, [])[::-1]
        if x.kind == parse.OBJECT:
            props: dict[str, dict] = {}
            for k in own[:OBJECT_KEYS]:
                name = k.name or ""
                props[name] = merge(props[name], done[k.id]) if name in props else done[k.id]
            out = {"type": "object", "properties": props, "required": sorted(props)}
        elif x.kind == parse.ARRAY:
            items = [done[k.id] for k in own[:samples]]
            out = {"type": "array"} | ({"items": reduce(merge, items)} if items else {})
        elif x.kind == parse.NUMBER:
            out = {"type": "integer" if re.fullmatch(r"-?\d+", x.value or "") else "number"}
        else:
            out = {"type": {parse.BOOL: "boolean", parse.NULL: "null"}.get(x.kind, "string")}
        for k in own:
            done.pop(k.id, None)
        done[x.id] = out
        if x.parent is not None:
            kids.setdefault(x.parent, []).append(x)
    return done[nodes[0].id] if nodes else {}


def _types(s: dict) -> set[str]:
    t = s.get("type", [])
    return {t} if isinstance(t, str) else set(t)


def merge(a: dict, b: dict) -> dict:
    """What both allow; types are a sorted list, so that the order of records doesn't matter, and integer is within number."""
    if a == b:
        return a
    types = _types(a) | _types(b)
    if "number" in types:
        types.discard("integer")
    out: dict = {}
    if types:
        out["type"] = sorted(types) if len(types) > 1 else min(types)
    if "properties" in a or "properties" in b:
        p, q = a.get("properties"), b.get("properties")
        out["properties"] = {k: merge(p[k], q[k]) if p and q and k in p and k in q else (p or {}).get(k) or (q or {}).get(k) or {} for k in sorted({*(p or {}), *(q or {})})}
        need = set(a.get("required", [])) & set(b.get("required", [])) if p is not None and q is not None else set((a if p is not None else b).get("required", []))
        out["required"] = sorted(need)
    if "items" in a or "items" in b:
        out["items"] = merge(a["items"], b["items"]) if "items" in a and "items" in b else a.get("items", b.get("items"))
    return out


def schemas(texts: DataFrame, column: str = "text", samples: int | None = SAMPLES) -> DataFrame:
    """One row (schema) of all records: each partition merges its own, then their few results are merged, in a tree of two levels."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: dict | None = None
        for b in batches:
            for t in b.column(0).to_pylist():
                if t is not None:
                    for top in _records(parse.parse_json(t)):
                        s = infer(top, samples)
                        now = s if now is None else merge(now, s)
        yield pa.RecordBatch.from_arrays([pa.array([] if now is None else [json.dumps(now, sort_keys=True)], pa.string())], ["schema"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        all_ = [json.loads(t) for b in batches for t in b.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([json.dumps(reduce(merge, all_), sort_keys=True)] if all_ else [], pa.string())], ["schema"])

    parts = texts.select(F.col(column).cast("string")).mapInArrow(local, "schema string").distinct()
    return parts.mapInArrow(join, "schema string").repartition(1).mapInArrow(join, "schema string")


def _records(nodes: list[parse.Node]) -> Iterator[list[parse.Node]]:
    at = [i for i, x in enumerate(nodes) if x.parent is None] + [len(nodes)]
    for i, j in zip(at, at[1:], strict=False):
        yield [x._replace(id=x.id - i, parent=None if x.parent is None else x.parent - i) for x in nodes[i:j]]


def infer_schema(texts: DataFrame, column: str = "text") -> dict:
    got = schemas(texts, column).head()
    return {"$schema": DRAFT} | (json.loads(got[0]) if got else {})


def field_tree(schema: dict) -> list[dict]:
    """The fields of a record: name, path, the path that a projection takes (arrays are passed through, as []), children."""
    while schema.get("type") == "array" and "items" in schema:
        schema = schema["items"]

    def one(key: str, s: dict, prefix: str) -> dict:
        word = re.fullmatch(r"[A-Za-z_$][\w$]*", key, re.ASCII)
        path = prefix + (f"{'.' if prefix else ''}{key}" if word else f"[{json.dumps(key, ensure_ascii=False)}]")
        inner = path
        while s.get("type") == "array" and "items" in s:
            inner, s = inner + "[]", s["items"]
        kids = [one(k, v, inner) for k, v in s.get("properties", {}).items()] if s.get("type") == "object" else []
        return {"name": key, "path": path, "select": inner, "leaf": not kids, "children": kids}

    return [one(k, v, "") for k, v in schema.get("properties", {}).items()] if schema.get("type") == "object" else []


def _same(a: object, b: object) -> bool:
    return type(a) is type(b) and a == b or (isinstance(a, (int, float)) and isinstance(b, (int, float)) and not isinstance(a, bool) and not isinstance(b, bool) and a == b)


def _is(v: object, t: str) -> bool:
    number = isinstance(v, (int, float)) and not isinstance(v, bool)
    return {"object": isinstance(v, dict), "array": isinstance(v, list), "string": isinstance(v, str), "number": number, "integer": number and float(v).is_integer(), "boolean": isinstance(v, bool), "null": v is None}.get(t, False)


class Validator:
    """Checks values against a schema; at most ERRORS faults and NODES visits a value."""

    def __init__(self, schema: dict):
        self.root = schema
        self.left = NODES

    def faults(self, v: object) -> list[tuple[str, str]]:
        out: list[tuple[str, str]] = []
        self.left = NODES
        self._check(v, self.root, "$", out, 0)
        return out[:ERRORS]

    def _ok(self, v: object, s: dict | bool, path: str, depth: int) -> bool:
        out: list[tuple[str, str]] = []
        self._check(v, s, path, out, depth)
        return not out

    def _check(self, v: object, s: dict | bool, path: str, out: list, depth: int) -> None:
        self.left -= 1
        if depth > DEPTH or self.left < 0 or len(out) >= ERRORS:
            return
        if isinstance(s, bool):
            if not s:
                out.append((path, "nothing is allowed here"))
            return
        say = lambda m: out.append((path, m))
        if "$ref" in s:
            target: object = self.root
            for part in s["$ref"].lstrip("#").strip("/").split("/") if s["$ref"] != "#" else []:
                part = part.replace("~1", "/").replace("~0", "~")
                target = target.get(part) if isinstance(target, dict) else target[int(part)] if isinstance(target, list) and part.isdigit() else None
            if isinstance(target, (dict, bool)):
                self._check(v, target, path, out, depth + 1)
            else:
                say(f"unknown reference {s['$ref']}")
        if (t := s.get("type")) is not None and not any(_is(v, x) for x in ([t] if isinstance(t, str) else t)):
            say(f"is not of type {t if isinstance(t, str) else ' or '.join(t)}")
            return
        if "enum" in s and not any(_same(v, x) for x in s["enum"]):
            say("is not one of the allowed values")
        if "const" in s and not _same(v, s["const"]):
            say("is not the constant")
        if isinstance(v, str):
            self._text(v, s, say)
        elif isinstance(v, (int, float)) and not isinstance(v, bool):
            self._number(v, s, say)
        elif isinstance(v, dict):
            self._object(v, s, path, out, depth, say)
        elif isinstance(v, list):
            self._array(v, s, path, out, depth, say)
        for sub in s.get("allOf", []):
            self._check(v, sub, path, out, depth + 1)
        if "anyOf" in s and not any(self._ok(v, x, path, depth + 1) for x in s["anyOf"]):
            say("matches none of anyOf")
        if "oneOf" in s and (n := sum(self._ok(v, x, path, depth + 1) for x in s["oneOf"])) != 1:
            say(f"matches {n} of oneOf, not one")
        if "not" in s and self._ok(v, s["not"], path, depth + 1):
            say("matches what it must not")

    def _text(self, v: str, s: dict, say) -> None:
        if len(v) < s.get("minLength", 0):
            say(f"is shorter than {s['minLength']}")
        if len(v) > s.get("maxLength", math.inf):
            say(f"is longer than {s['maxLength']}")
        if "pattern" in s and not re.search(s["pattern"], v):
            say("doesn't match the pattern")

    def _number(self, v: float, s: dict, say) -> None:
        for key, bad, word in (("minimum", v < s.get("minimum", -math.inf), "below"), ("maximum", v > s.get("maximum", math.inf), "above"), ("exclusiveMinimum", v <= s.get("exclusiveMinimum", -math.inf), "not above"), ("exclusiveMaximum", v >= s.get("exclusiveMaximum", math.inf), "not below")):
            if key in s and bad:
                say(f"is {word} {s[key]}")
        if m := s.get("multipleOf"):
            q = v / m
            if abs(q - round(q)) > 1e-9:
                say(f"is no multiple of {m}")

    def _object(self, v: dict, s: dict, path: str, out: list, depth: int, say) -> None:
        if len(v) < s.get("minProperties", 0) or len(v) > s.get("maxProperties", math.inf):
            say("has too few or too many properties")
        for k in s.get("required", []):
            if k not in v:
                say(f"lacks {k}")
        props, more = s.get("properties", {}), s.get("additionalProperties", True)
        for k, x in v.items():
            where = path + parse.step(k, parse.STRING, parse.OBJECT, 0, False)
            if k in props:
                self._check(x, props[k], where, out, depth + 1)
            elif more is False:
                out.append((where, "isn't allowed"))
            elif isinstance(more, dict):
                self._check(x, more, where, out, depth + 1)

    def _array(self, v: list, s: dict, path: str, out: list, depth: int, say) -> None:
        if len(v) < s.get("minItems", 0) or len(v) > s.get("maxItems", math.inf):
            say("has too few or too many items")
        items = s.get("items")
        for i, x in enumerate(v):
            sub = items[i] if isinstance(items, list) and i < len(items) else items if isinstance(items, (dict, bool)) else None
            if sub is not None:
                self._check(x, sub, f"{path}[{i}]", out, depth + 1)


def validate(texts: DataFrame, schema: dict, key: str, column: str = "text") -> DataFrame:
    """(key, path, message) of every fault of every record; a text that isn't JSON is a fault."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        check = Validator(schema)
        for b in batches:
            rows: list[tuple] = []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    values = parse.json_values(parse.parse_json(t or ""))
                except parse.Bad as e:
                    rows.append((k, "$", str(e)))
                    continue
                rows += [(k, p, m) for v in values for p, m in check.faults(v)]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], pa.string()) for j in range(3)], ["key", "path", "message"])

    return texts.select(F.col(key).cast("string"), F.col(column).cast("string")).mapInArrow(run, "key string, path string, message string")
