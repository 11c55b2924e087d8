"""JSON and XML texts into nodes in pre-order, without recursion; numbers keep their digits, repeated keys stay."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from typing import NamedTuple
from xml.parsers import expat

OBJECT, ARRAY, STRING, NUMBER, BOOL, NULL, ELEMENT, ATTRIBUTE, TEXT = range(9)
KINDS = ["objects", "arrays", "strings", "numbers", "booleans", "nulls", "elements", "attributes", "text"]
DEPTH, STRICT_DEPTH = 512, 4096
_BLANK = re.compile(r"[ \t\r\n]*")
_STRING = re.compile(r'"((?:[^"\\]|\\.)*)"', re.DOTALL)
_LOOSE = re.compile(r"-?[0-9+\-.eE]+")
_EXACT = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?", re.ASCII)
_IDENT = re.compile(r"[A-Za-z_$][A-Za-z0-9_$]*", re.ASCII)
# a key with its colon, or a string's quote and inside, or a number
_LEAF = re.compile(r'("(?>[^"\\]*(?:\\.[^"\\]*)*)"[ \t\r\n]*:)|(")?((?(2)(?>[^"\\]*(?:\\.[^"\\]*)*)|[-0-9][0-9+\-.eE]*))(?(2)")', re.DOTALL)
_WORDS = {"true": BOOL, "false": BOOL, "null": NULL}


class Bad(ValueError):
    """A text that can't be read, with the place of the fault."""

    def __init__(self, message: str, at: int):
        super().__init__(f"{message} at {at}")
        self.at = at


class Node(NamedTuple):
    id: int
    parent: int | None
    ord: int
    depth: int
    kind: int
    name: str | None
    value: str | None
    n_children: int
    path: str
    key: str | None


def step(name: str | None, kind: int, parent_kind: int, ord_: int, xml: bool) -> str:
    """What a node adds to its parent's path."""
    if xml:
        return f"/@{name}" if kind == ATTRIBUTE else "/text()" if kind == TEXT else f"/{name or '*'}"
    if parent_kind == ARRAY:
        return f"[{ord_}]"
    return f".{name}" if _IDENT.fullmatch(name or "") else f"[{json.dumps(name or '', ensure_ascii=False)}]"


def unescape(raw: str) -> str:
    """The characters of a JSON string's inside; halves of pairs become U+FFFD, unknown escapes the character itself."""
    if "\\" not in raw:
        return raw
    short = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}
    text = re.sub(r"\\(?:u([0-9a-fA-F]{4})|(.))", lambda m: chr(int(m[1], 16)) if m[1] else short.get(m[2], m[2]), raw, flags=re.DOTALL)
    return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


class _Builder:
    def __init__(self, xml: bool, depth: int):
        self.rows: list[list] = []
        self.stack: list[int] = []
        self.seen: list[set] = []
        self.top, self.xml, self.depth = 0, xml, depth

    def add(self, kind: int, name: str | None, value: str | None) -> int:
        i = len(self.rows)
        if self.stack:
            p = self.rows[self.stack[-1]]
            parent, ord_, parent_kind, path, key = self.stack[-1] + 1, p[7], p[4], p[8], p[9]
            p[7] += 1
            names = self.seen[-1]
            label = f"i{ord_}" if parent_kind == ARRAY else f"k{json.dumps(name if name is not None else f'#{ord_}')}"
            key = None if key is None or label in names else f"{key}\x1e{label}"
            names.add(label)
        else:
            parent, ord_, parent_kind, path, key = None, self.top, ARRAY, "", ""
            self.top += 1
            key = f"i{ord_}"
        where = path + step(name, kind, parent_kind, ord_, self.xml) if self.stack or self.xml else ""
        self.rows.append([i + 1, parent, ord_, len(self.stack) + 1, kind, name, value, 0, where, key])
        return i

    def open(self, kind: int, name: str | None, at: int) -> None:
        if len(self.stack) >= self.depth:
            raise Bad("nested too deep", at)
        self.stack.append(self.add(kind, name, None))
        self.seen.append(set())

    def close(self) -> None:
        self.stack.pop()
        self.seen.pop()

    def nodes(self) -> list[Node]:
        return [Node(*r) for r in self.rows]


def parse_json(text: str, strict: bool = False) -> list[Node]:
    """All values of the text, one after the other, with ids from 1 in pre-order. A comma before } and odd numbers as 01 pass unless strict."""
    b = _Builder(False, STRICT_DEPTH if strict else DEPTH)
    i = 1 if text.startswith("﻿") else 0
    n = len(text)
    blank = _BLANK.match
    while (i := blank(text, i).end()) < n:
        i = _value(b, text, i, None, strict)
        # within an open container: what comes next
        while b.stack:
            i = blank(text, i).end()
            top = b.rows[b.stack[-1]]
            closing = "}" if top[4] == OBJECT else "]"
            if i >= n:
                raise Bad("unexpected end", n)
            c = text[i]
            if c == closing:
                b.close()
                i += 1
                continue
            if top[7]:
                if c != ",":
                    raise Bad(f"unexpected {c!r}", i)
                i = blank(text, i + 1).end()
                if text[i : i + 1] == closing and closing == "}" and not strict:
                    b.close()
                    i += 1
                    continue
            if top[4] == OBJECT:
                m = _STRING.match(text, i)
                if not m:
                    raise Bad("a key is missing", min(i, n))
                i = blank(text, m.end()).end()
                if text[i : i + 1] != ":":
                    raise Bad("a colon is missing", i)
                i = _value(b, text, blank(text, i + 1).end(), unescape(m[1]), strict)
            else:
                i = _value(b, text, i, None, strict)
    if strict and not b.rows:
        raise Bad("empty text", 0)
    return b.nodes()


def _value(b: _Builder, text: str, i: int, name: str | None, strict: bool) -> int:
    """Reads a value's start, or all of it where it is no container, and gives the place after it."""
    c = text[i : i + 1]
    if c == "{" or c == "[":
        b.open(OBJECT if c == "{" else ARRAY, name, i)
        return i + 1
    if c == '"':
        m = _STRING.match(text, i)
        if not m:
            raise Bad("a string has no end", i)
        if strict and re.search(r"[\x00-\x1f]|\\(?!u[0-9a-fA-F]{4}|[\"\\/bfnrt])", re.sub(r"\\\\", "", m[1])):
            raise Bad("a bad string", i)
        b.add(STRING, name, unescape(m[1]))
        return m.end()
    for word, kind in _WORDS.items():
        if text.startswith(word, i):
            b.add(kind, name, None if kind == NULL else word)
            return i + len(word)
    m = (_EXACT if strict else _LOOSE).match(text, i) if c and c in "-0123456789" else None
    if not m or (strict and text[m.end() : m.end() + 1] and text[m.end()] in "0123456789.eE+-"):
        raise Bad(f"unexpected {c!r}" if c else "unexpected end", i)
    b.add(NUMBER, name, m[0])
    return m.end()


class Shape(NamedTuple):
    """Nodes of all texts that differ in strings and numbers only; slots: for each node the place of its value among a text's values, -1 if it is the node's own."""

    nodes: list[Node]
    slots: list[int]

    def filled(self, values: list[str | None]) -> list[Node]:
        return [x if s < 0 else x._replace(value=values[s]) for x, s in zip(self.nodes, self.slots, strict=True)]


class Reader:
    """Reads texts one after the other. JSON that is alike but for its strings and numbers is parsed once: a text is cut at these, and what is left, keys and kinds of values included, settles which way `parse_json` goes. Only what it has accepted is remembered, up to KNOWN nodes, of texts up to LONGEST characters."""

    KNOWN, LONGEST = 100_000, 1 << 16

    def __init__(self, read: Callable[[str], list[Node]]):
        self.parse, self.known, self.held = read, {}, 0

    def read(self, text: str) -> tuple[Shape, list[str | None]]:
        """The shape of a text and its values."""
        if self.parse is not parse_json or len(text) > self.LONGEST:
            found = self.parse(text)
            return Shape(found, [-1] * len(found)), []
        parts = _LEAF.split(text)
        values = parts[3::4]
        del parts[3::4]
        if "\\" in text:
            values = [v and unescape(v) for v in values]
        shape = self.known.get(key := tuple(parts))
        if shape is None:
            found = parse_json(text)
            places = iter([i for i, v in enumerate(values) if v is not None])
            shape = Shape(found, [next(places) if x.kind in (STRING, NUMBER) else -1 for x in found])
            if self.held + len(found) > self.KNOWN:
                self.known, self.held = {}, 0
            self.known[key] = shape
            self.held += len(found) + 1
        return shape, values


def parse_xml(text: str) -> list[Node]:
    """Elements, their attributes first among their children, texts without the blanks around them, CDATA as it is; comments, instructions and declarations are dropped and prefixes stay in names."""
    b = _Builder(True, DEPTH)
    held: list[str] = []
    inside = [False]

    def flush() -> None:
        t = "".join(held).strip()
        held.clear()
        if t:
            b.add(TEXT, None, t)

    def start(name: str, attributes: list[str]) -> None:
        flush()
        b.open(ELEMENT, name, p.CurrentByteIndex)
        for k, v in zip(attributes[::2], attributes[1::2], strict=True):
            b.add(ATTRIBUTE, k, v)

    def end(_: str) -> None:
        flush()
        b.close()

    def cdata_start() -> None:
        flush()
        inside[0] = True

    def cdata_end() -> None:
        inside[0] = False
        if held:
            b.add(TEXT, None, "".join(held))
            held.clear()

    p = expat.ParserCreate()
    p.ordered_attributes = True
    p.buffer_text = True
    p.StartElementHandler, p.EndElementHandler, p.CharacterDataHandler = start, end, held.append
    p.StartCdataSectionHandler, p.EndCdataSectionHandler = cdata_start, cdata_end
    p.CommentHandler = lambda _: flush()
    p.ProcessingInstructionHandler = lambda *_: flush()
    try:
        p.Parse(text.lstrip("﻿"), True)
    except expat.ExpatError as e:
        raise Bad(expat.errors.messages[e.code], p.ErrorByteIndex) from None
    return b.nodes()


def number_cell(cell: str) -> bool:
    """Whether a field of delimited text counts as a number in a document: JSON's own form, so that 007 stays a text."""
    return _EXACT.fullmatch(cell) is not None


def csv_nodes(text: str, delimiter: str | None = None, header: bool | None = None) -> list[Node]:
    """Delimited text as a document: an array of objects by the header's names, or of arrays where there is none. Fields in quotes are texts; short rows have fewer keys, extra fields no name; blank lines don't count, and a quote that isn't closed ends with the text."""
    from stratalens.sources.detect import looks_like_header, most_frequent_delimiter

    text = text.lstrip("﻿")
    delimiter = delimiter or most_frequent_delimiter(text.split("\n", 1)[0])
    rows: list[list[tuple[str, bool]]] = [[]]
    i, n = 0, len(text)
    plain = re.compile(rf"[^{re.escape(delimiter)}\r\n]*")
    while i < n:
        if text[i] == '"':
            m = re.compile(r'"((?:[^"]|"")*)("|$)').match(text, i)
            rows[-1].append((m[1].replace('""', '"'), True))
            i = plain.match(text, m.end()).end()
        else:
            m = plain.match(text, i)
            rows[-1].append((m[0], False))
            i = m.end()
        if i < n and text[i] == delimiter:
            i += 1
            if i >= n or text[i] in "\r\n":
                rows[-1].append(("", False))
        if i < n and text[i] in "\r\n":
            i += 2 if text.startswith("\r\n", i) else 1
            rows.append([])
    rows = [r for r in rows if r and r != [("", False)]]
    b = _Builder(False, DEPTH)
    names: list[str] | None = None
    cells = [[c for c, _ in r] for r in rows[:2]]
    if rows and (header if header is not None else looks_like_header(cells[0], cells[1] if len(cells) > 1 else None)):
        names = [c for c, _ in rows.pop(0)]
    b.open(ARRAY, None, 0)
    for r in rows:
        b.open(ARRAY if names is None else OBJECT, None, 0)
        for k, (c, was_quoted) in enumerate(r):
            b.add(NUMBER if not was_quoted and number_cell(c) else STRING, names[k] if names and k < len(names) else None, c)
        b.close()
    b.close()
    return b.nodes()


def json_values(nodes: list[Node]) -> list[object]:
    """The nodes of JSON as Python values; of repeated keys the last one counts."""
    made: list[object] = []
    tops: list[object] = []
    for x in nodes:
        v: object = {} if x.kind == OBJECT else [] if x.kind == ARRAY else None if x.kind == NULL else x.value == "true" if x.kind == BOOL else json.loads(x.value) if x.kind == NUMBER and _EXACT.fullmatch(x.value) else x.value
        made.append(v)
        if x.parent is None:
            tops.append(v)
        elif isinstance(p := made[x.parent - 1], list):
            p.append(v)
        else:
            p[x.name if x.name is not None else f"#{x.ord}"] = v
    return tops


def split_array(chunks) -> object:
    """The texts of a JSON array's elements (or of the values of a text that is none), one after another, from an iterator of texts: nothing but the present element is held."""
    depth, inside, escaped, now, top = 0, False, False, [], None
    for chunk in chunks:
        for c in chunk:
            if top is None:
                if c in " \t\r\n﻿":
                    continue
                top = c
                if c == "[":
                    depth = 1
                    continue
            if inside:
                now.append(c)
                if escaped:
                    escaped = False
                elif c == "\\":
                    escaped = True
                elif c == '"':
                    inside = False
                continue
            if c == '"':
                inside = True
            elif c in "{[":
                depth += 1
            elif c in "}]":
                depth -= 1
                if top == "[" and depth == 0:
                    break
            if top == "[" and depth == 1 and c == ",":
                if s := "".join(now).strip():
                    yield s
                now = []
            else:
                now.append(c)
                if top != "[" and depth == 0 and c in "}]":
                    yield "".join(now).strip()
                    now = []
    if s := "".join(now).strip():
        yield s
