"""What a file is, told from its first bytes on the driver; no job runs."""

from __future__ import annotations

import codecs
import os
import re
import zlib
from collections import Counter
from dataclasses import dataclass, field
from pathlib import Path

from stratalens.functions.text import NUMBER

HEAD, SAMPLE, PROBE = 256 << 10, 4000, 64 << 10
DELIMITERS = [",", "\t", ";", "|", "\x01", "\x1f", "~", "^", "\0", " ", ":"]
EXTENSIONS = {"csv": "csv", "tsv": "tsv", "tab": "tsv", "txt": "delimited", "dat": "delimited", "psv": "psv", "parquet": "parquet", "pq": "parquet", "json": "unsupported", "ndjson": "unsupported", "jsonl": "unsupported", "jsonlines": "unsupported"}
_NAME = re.compile(r"[\w .\-/()#%]{1,64}", re.ASCII)


@dataclass
class Detected:
    path: str
    size: int
    mtime: float
    format: str = "unknown"
    compression: str = "none"
    encoding: str = "utf-8"
    delimiter: str | None = None
    quote: str | None = None
    escape: str | None = None
    has_header: bool | None = None
    confidence: float = 0.3
    skip_rows: int = 0
    candidates: list[str] = field(default_factory=list)
    suggest_quote: str | None = '"'
    sample: str = ""
    warnings: list[str] = field(default_factory=list)


def compression_of(head: bytes) -> str:
    return "gzip" if head[:2] == b"\x1f\x8b" else "zstd" if head[:4] == b"\x28\xb5\x2f\xfd" else "none"


def valid_utf8(data: bytes) -> bool:
    """Whether data is UTF-8 but for a character cut at its end."""
    try:
        codecs.getincrementaldecoder("utf-8")().decode(data, final=False)
    except UnicodeDecodeError:
        return False
    return True


def encoding_of(head: bytes) -> tuple[str, int, list[str]]:
    """(encoding, bytes of the mark, warnings)."""
    if head.startswith(codecs.BOM_UTF8):
        return "utf-8", 3, []
    if head.startswith(codecs.BOM_UTF16_LE):
        return "utf-16", 2, []
    if head.startswith(codecs.BOM_UTF16_BE):
        return "utf-16be", 2, ["The file is UTF-16 of the big-endian kind."]
    if valid_utf8(head) and head[1:2000:2].count(0) <= min(len(head), 2000) / 4:
        return "utf-8", 0, []
    if head[1:2000:2].count(0) > min(len(head), 2000) / 4:
        return "utf-16", 0, ["The file looks like UTF-16 without a mark."]
    return "latin-1", 0, ["The file isn't valid UTF-8 and is read as Latin-1."]


def split_line(line: str, delimiter: str, quotes: bool = True) -> list[str]:
    """The fields of one line; with quotes, doubled ones stand for one."""
    if not quotes:
        return line.split(delimiter)
    out, now, inside, i = [], [], False, 0
    while i < len(line):
        c = line[i]
        if inside:
            if c != '"':
                now.append(c)
            elif line[i + 1 : i + 2] == '"':
                now.append('"')
                i += 1
            else:
                inside = False
        elif c == '"':
            inside = True
        elif c == delimiter:
            out.append("".join(now))
            now = []
        else:
            now.append(c)
        i += 1
    return [*out, "".join(now)]


def looks_like_header(first: list[str], second: list[str] | None) -> bool:
    """Names rather than data: few numbers, few repeats, and either a row below with more numbers or short plain words."""
    filled = [c.strip() for c in first if c.strip()]
    if not filled:
        return False
    share = lambda cells, test: sum(map(test, cells)) / len(cells)
    number = lambda c: NUMBER.fullmatch(c) is not None
    numbers = share(filled, number)
    if numbers > 0.3 or len({c.lower() for c in filled}) / len(filled) < 0.7:
        return False
    if second is None:
        return True
    below = [c.strip() for c in second if c.strip()]
    if not below or share(below, number) > numbers:
        return True
    return share(filled, lambda c: _NAME.fullmatch(c) is not None) >= 0.8


@dataclass
class Guess:
    delimiter: str | None = None
    has_header: bool | None = None
    confidence: float = 0.0
    skip_rows: int = 0
    ranked: list[str] = field(default_factory=list)
    quote: str | None = '"'


def guess_delimiter(lines: list[str]) -> Guess:
    """The delimiter by which most lines have the same number of fields, more fields and more usual delimiters first among near equals, each read with and without quotes."""
    usable = [x for x in lines if x.strip()][:60]
    if not usable:
        return Guess()
    scored = []
    for preference, d in enumerate(DELIMITERS):
        for quotes in (True, False):
            counts = [len(split_line(x, d, quotes)) for x in usable]
            usual = Counter(c for c in counts if c > 1)
            if usual:
                fields, hits = max(usual.items(), key=lambda kv: (kv[1], kv[0]))
                score = hits / len(counts) * 1000 + min(fields, 40) * 5 - preference + 0.5 * quotes
                scored.append((score, d, quotes, next(i for i, c in enumerate(counts) if c > 1)))
    if not scored:
        return Guess(confidence=0.2)
    scored.sort(key=lambda x: -x[0])
    score, d, quotes, skip = scored[0]
    rows = [split_line(x, d, quotes) for x in usable[skip : skip + 2]]
    header = looks_like_header(rows[0], rows[1] if len(rows) > 1 else None)
    confidence = max(0.2, min(0.95, (score + len(DELIMITERS)) / 1000 * 0.95))
    return Guess(d, header, confidence, skip, list(dict.fromkeys(x[1] for x in scored)), '"' if quotes else None)


def most_frequent_delimiter(line: str) -> str:
    """Of , ; tab and |, the one that a line has most of outside quotes; the comma where it has none."""
    bare = re.sub(r'"[^"]*"?', "", line)
    return max(",;\t|", key=lambda d: bare.count(d))


def sniff_text(text: str) -> str:
    """json, xml, tsv or csv, of a pasted or downloaded text."""
    t = text.lstrip()
    line = t.split("\n", 1)[0]
    return "json" if t[:1] in ("{", "[") else "xml" if t[:1] == "<" else "tsv" if "\t" in line else "csv" if "," in line else "json"


def document_format(path: str) -> str:
    ext = Path(path).suffix.lower().lstrip(".")
    return "ndjson" if ext in ("ndjson", "jsonl") else "xml" if ext == "xml" else "json"


def head_of(path: str, n: int = HEAD) -> bytes:
    with open(path, "rb") as f:
        raw = f.read(n)
    if compression_of(raw) == "gzip":
        try:
            return zlib.decompressobj(31).decompress(raw, n)
        except zlib.error:
            return b""
    return b"" if compression_of(raw) == "zstd" else raw


def detect(path: str) -> Detected:
    """Format, compression, encoding, delimiter, header and preamble of a file, with how sure that is; the content counts for more than the extension."""
    if not os.path.isfile(path):
        raise FileNotFoundError(f"not a file: {path}")
    stat = os.stat(path)
    out = Detected(path, stat.st_size, stat.st_mtime)
    with open(path, "rb") as f:
        out.compression = compression_of(f.read(8))
    head = head_of(path)
    if out.compression == "gzip" and not head:
        out.warnings.append("The start of this gzip file can't be decompressed.")
    if out.compression == "zstd":
        out.warnings.append("Zstandard files are read, but not previewed.")
    if head[:4] == b"PAR1":
        out.format, out.encoding, out.confidence, out.suggest_quote, out.sample = "parquet", "binary", 1.0, None, "(Parquet)"
        return out
    out.encoding, mark, notes = encoding_of(head)
    out.warnings += notes
    if out.encoding == "utf-8" and out.compression == "none" and stat.st_size > HEAD and not _deep_utf8(path, stat.st_size):
        out.encoding = "latin-1"
        out.warnings.append("Bytes further on aren't valid UTF-8, so the file is read as Latin-1.")
    text = head[mark:].decode({"utf-16": "utf-16-le", "utf-16be": "utf-16-be"}.get(out.encoding, out.encoding), "replace")
    out.sample = text[:SAMPLE]
    lines = re.split(r"\r?\n", text)
    lines = (lines[:-1] if len(lines) > 1 else lines)[:200]
    first = text.lstrip("﻿ \t\r\n")[:1]
    by_name = EXTENSIONS.get(re.sub(r"\.(gz|zst|zstd)$", "", path.lower()).rsplit(".", 1)[-1])
    if first in ("[", "{") and first:
        out.format, out.confidence = "unsupported", 0.95
        out.warnings.append("This looks like JSON, which is opened as a document, not as a table.")
    elif not first:
        out.format, out.confidence = by_name or "unknown", 0.1
        out.warnings.append("The file appears to be empty.")
    else:
        g = guess_delimiter(lines)
        out.delimiter, out.has_header, out.confidence, out.skip_rows, out.candidates, out.suggest_quote = g.delimiter, g.has_header, g.confidence, g.skip_rows, g.ranked, g.quote
        if g.delimiter is None:
            out.format = by_name or "delimited"
            out.warnings.append("No delimiter was found; the file is one column of text.")
        else:
            out.format = {"\t": "tsv", ",": "csv", "|": "psv"}.get(g.delimiter, "delimited")
            out.quote = out.escape = '"'
            if g.quote is None:
                out.warnings.append("Quotes aren't paired and are read as ordinary characters.")
            if g.skip_rows:
                out.warnings.append(f"The first {g.skip_rows} lines look like a preamble and are skipped.")
    table = {"csv", "tsv", "psv", "delimited"}
    if by_name and by_name != out.format and not {by_name, out.format} <= table:
        out.warnings.append(f"The name says {by_name}, the content {out.format}, which counts.")
        out.confidence = min(out.confidence, 0.55)
    return out


def _deep_utf8(path: str, size: int) -> bool:
    """Whether windows at a quarter, half and nine tenths of the file are UTF-8 but for characters cut at their ends."""
    with open(path, "rb") as f:
        for share in (0.25, 0.5, 0.9):
            f.seek(int(size * share))
            data = f.read(PROBE)
            start = next((i for i in range(4) if i >= len(data) or data[i] & 0xC0 != 0x80), 4)
            if len(data) > 8 and not valid_utf8(data[start:]):
                return False
    return True


MAX_SLICE = 4 << 20


def raw_slice(path: str, offset: int, length: int) -> dict:
    """Whole lines around the bytes offset .. offset + length, at most MAX_SLICE of them."""
    size = os.path.getsize(path)
    want, start = max(1, min(int(length), MAX_SLICE)), max(0, min(int(offset), max(0, size - 1)))
    with open(path, "rb") as f:
        low = max(0, start - 4096)
        f.seek(low)
        data = f.read(start - low + want + 4096)
    begin = start - low
    if start:
        newline = data.rfind(b"\n", 0, begin + 1)
        begin = newline + 1 if newline >= 0 else begin
    end = min(begin + want, len(data))
    if end < len(data):
        newline = data.rfind(b"\n", begin + 1, end + 1)
        end = newline + 1 if newline >= 0 else end
    return {"path": path, "offset": low + begin, "length": end - begin, "total": size, "text": data[begin:end].decode("utf-8", "replace"), "at_end": low + end >= size}
