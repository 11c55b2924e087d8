"""Language identification of spans (operator 4).

The script of a word's characters, by ranges of code points, narrows the candidates: the languages that the labelled documents write in that script, or where they have none the ones in SCRIPTS. A word's score for a candidate is the log probability of its byte trigrams (ASCII lower case, a space at either end) in the language's hashed multinomial, counted over all documents by their label `lang`. Viterbi over a document's words, with a penalty for each change of language, labels them; runs of one label are the spans.

Words are runs of bytes above 32, also where scripts change within one, which then has the script of its first letter beyond Latin; a word without a letter has no evidence and stays with its neighbours. Ties go to staying, then to the language that comes first by name.

Defined cases: a document with no word (null or empty text) has one span of no words and a null language; one without any letter is "und"; with no labelled document the scripts' own languages remain, and words of other scripts are "und"; null labels train nothing; repeated rows are labelled alike; other columns don't matter. Time grows with the words, however long a document is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalens.llm import common, textcols

BUCKETS, PENALTY, SHARE = 1 << 14, 14.0, 0.05
#: First code point of a range, its script.
RANGES = [(0x0, ""), (0x41, "Latin"), (0x5B, ""), (0x61, "Latin"), (0x7B, ""), (0xC0, "Latin"), (0x250, ""), (0x370, "Greek"), (0x400, "Cyrillic"), (0x530, "Armenian"), (0x590, "Hebrew"), (0x600, "Arabic"), (0x700, ""), (0x750, "Arabic"), (0x780, ""), (0x900, "Devanagari"), (0x980, "Bengali"), (0xA00, ""), (0xB80, "Tamil"), (0xC00, "Telugu"), (0xC80, ""), (0xE00, "Thai"), (0xE80, ""), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x1380, ""), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, ""), (0x3040, "Kana"), (0x3100, ""), (0x3400, "Han"), (0x4DC0, ""), (0x4E00, "Han"), (0xA000, ""), (0xAC00, "Hangul"), (0xD7B0, ""), (0xF900, "Han"), (0xFB00, ""), (0x20000, "Han"), (0x30000, "")]
#: Languages of a script that no labelled document is written in; scripts of several languages, as Han, aren't here, so that words in them are "und" then.
SCRIPTS = {"Greek": ["el"], "Cyrillic": ["ru"], "Armenian": ["hy"], "Hebrew": ["he"], "Arabic": ["ar"], "Devanagari": ["hi"], "Bengali": ["bn"], "Tamil": ["ta"], "Telugu": ["te"], "Thai": ["th"], "Georgian": ["ka"], "Hangul": ["ko"], "Ethiopic": ["am"], "Kana": ["ja"]}
NAMES = ["", *sorted({s for _, s in RANGES if s})]
_STARTS = np.array([c for c, _ in RANGES])
_CODES = np.array([NAMES.index(s) for _, s in RANGES], np.int8)
_LETTER = np.array([chr(i).isalpha() if i < 128 else True for i in range(256)])
_FLUSH = 8 << 20


def scripts(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each word the script of its first letter beyond Latin, else Latin if it has such a letter, else ''."""
    b = buf.astype(np.int32)
    n1, n2, n3 = (np.append(b[k:], np.full(min(k, len(b)), 128, np.int32)) & 63 for k in (1, 2, 3))
    point = np.where(b < 128, b, np.where(b < 0xE0, (b & 31) << 6 | n1, np.where(b < 0xF0, (b & 15) << 12 | n1 << 6 | n2, (b & 7) << 18 | n1 << 12 | n2 << 6 | n3)))
    script = _CODES[np.searchsorted(_STARTS, point, "right") - 1]
    script[(b & 0xC0) == 0x80] = 0
    latin = NAMES.index("Latin")
    out = np.zeros(len(starts), np.int8)
    for at in (np.flatnonzero(script == latin), np.flatnonzero((script > 0) & (script != latin))):
        at = at[::-1]
        w = np.searchsorted(starts, at, "right") - 1
        ok = (w >= 0) & (at < ends[w])
        out[w[ok]] = script[at[ok]]  # the last write, of the first character, stays
    return out


def features(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """By chunk: trigram bucket of each letter, index of its word, the words' scripts, index of each document's first word, bounds of the documents in the letters."""
    for _, _, buf, bounds in textcols.chunks(texts):
        low = textcols.LOWER[buf]
        starts, ends, first = textcols.words(low, bounds)
        letter = _LETTER[low]
        c = np.where(letter, low, 32).astype(np.int64)
        before, after = np.full(len(c), 32), np.full(len(c), 32)
        before[1:], after[:-1] = c[:-1], c[1:]
        before[bounds[:-1][bounds[:-1] < len(c)]] = 32
        after[bounds[1:][bounds[1:] > 0] - 1] = 32
        at = np.flatnonzero(letter)
        code = ((before[at] << 16 | c[at] << 8 | after[at]) * 2654435761 & 0xFFFFFFFF) >> 18
        yield code, np.searchsorted(starts, at, "right") - 1, scripts(buf, starts, ends), first, np.searchsorted(at, bounds)


def train(docs: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, score of each for each trigram bucket, whether each may write each script), from all documents with a label. What comes to the driver has a fixed size for each language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in batches:
            langs, lo = b.column(0).to_pylist(), 0
            for code, _, script, first, letters in features(b.column(1)):
                own = np.array(langs[lo : lo + len(first) - 1], object)
                lo += len(own)
                names, which = np.unique(own.astype(str), return_inverse=True)
                x = np.bincount(np.repeat(which, np.diff(letters)) * BUCKETS + code, minlength=len(names) * BUCKETS).reshape(len(names), BUCKETS)
                y = np.bincount(np.repeat(which, np.diff(first)) * len(NAMES) + script, minlength=len(names) * len(NAMES)).reshape(len(names), len(NAMES))
                for k, name in enumerate(names):
                    total[name] = total.get(name, 0) + np.concatenate([x[k], y[k]])
        for name, n in total.items():
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(some), pa.string()), pa.array(some.astype(np.int32)), pa.array(n[some].astype(np.int64))], ["lang", "bucket", "n"])

    d = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where("lang is not null and text <> ''")
    rows = d.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    langs = sorted(rows.lang.unique())
    n = np.zeros((len(langs), BUCKETS + len(NAMES)))
    n[[langs.index(x) for x in rows.lang] if len(rows) else [], rows.bucket.to_numpy(int)] = rows.n.to_numpy(float)
    tri, script = n[:, :BUCKETS] + 0.5, n[:, BUCKETS:].copy()
    script[:, 0] = 0
    may = script >= SHARE * np.maximum(script.sum(1, keepdims=True), 1)
    scores = np.log(tri / tri.sum(1, keepdims=True)) - np.log(1 / BUCKETS)
    more = sorted({x for name, ls in SCRIPTS.items() for x in ls if not may[:, NAMES.index(name)].any()} - set(langs))
    every = sorted([*langs, *more, "und"])
    out, ok = np.zeros((BUCKETS, len(every)), np.float32), np.zeros((len(NAMES), len(every)), bool)
    for k, x in enumerate(langs):
        out[:, every.index(x)] = scores[k]
        ok[:, every.index(x)] = may[k]
    for name, ls in SCRIPTS.items():
        if not ok[NAMES.index(name)].any():
            ok[NAMES.index(name), [every.index(x) for x in ls]] = True
    ok[0] = True  # no evidence: any
    ok[~ok.any(1), every.index("und")] = True
    return every, out, ok


def viterbi(e: np.ndarray, first: np.ndarray, penalty: float) -> np.ndarray:
    """The best label of each row of e (words by labels); first: bounds of the documents, which are independent. Step t takes word t of all documents that have one."""
    n = np.diff(first)
    order = np.argsort(-n, kind="stable")
    start, n = first[:-1][order], n[order]
    labels, back = np.zeros(len(e), np.int16), np.zeros(e.shape, np.int16)
    own = np.arange(e.shape[1], dtype=np.int16)
    longest = int(n[0]) if len(n) else 0
    alive = np.searchsorted(-n, -np.arange(longest), "left")  # documents with more than t words
    v = np.zeros((len(n), e.shape[1]), np.float32)
    for t in range(longest):
        k = alive[t]
        at, was = start[:k] + t, v[:k]
        if t:
            best = was.argmax(1)
            move = was[np.arange(k), best][:, None] - np.float32(penalty)
            go = move > was
            back[at] = np.where(go, best[:, None], own)
            was = np.where(go, move, was)
        new = was + e[at]
        v[:k] = new - new.max(1, keepdims=True)
    state = v.argmax(1).astype(np.int16) if len(n) else own[:0]
    for t in range(longest - 1, -1, -1):
        k = alive[t]
        at = start[:k] + t
        labels[at] = state[:k]
        state[:k] = back[at, state[:k]]
    return labels


def spans(docs: DataFrame, penalty: float = PENALTY) -> DataFrame:
    """(doc_id, span, lang, start_word, end_word) of every document: its runs of words of one language, in order, end exclusive."""
    names, table, ok = train(docs)
    shared = docs.sparkSession.sparkContext.broadcast((np.array(names, object), table, ok))

    def label(ids: pa.Array, parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        names = shared.value[0]
        e = np.concatenate([x for x, _ in parts])
        shift = np.cumsum([0, *(len(x) for x, _ in parts)])
        first = np.concatenate([f[:-1] + s for (_, f), s in zip(parts, shift, strict=False)] + [shift[-1:]])
        got = viterbi(e, first, penalty)
        new = np.ones(len(got), bool)
        new[1:] = got[1:] != got[:-1]
        new[first[:-1][first[:-1] < len(got)]] = True
        at = np.flatnonzero(new)
        doc = np.searchsorted(first, at, "right") - 1
        bare = np.flatnonzero(np.diff(first) == 0)
        end = np.append(at[1:], len(got))
        doc_all = np.concatenate([doc, bare])
        rank = np.arange(len(at)) - np.searchsorted(at, first[doc], "left")
        zeros = np.zeros(len(bare), np.int64)
        lang = np.concatenate([names[got[at]], np.full(len(bare), None, object)])
        return pa.RecordBatch.from_arrays([ids.take(pa.array(doc_all)), pa.array(np.concatenate([rank, zeros]).astype(np.int32)), pa.array(lang, pa.string()), pa.array(np.concatenate([at - first[doc], zeros])), pa.array(np.concatenate([end - first[doc], zeros]))], ["doc_id", "span", "lang", "start_word", "end_word"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, table, ok = shared.value
        barred = np.where(ok, 0, -1e6).astype(np.float32)
        barred[0] -= 0.001 * (shared.value[0] != "und")  # where no word has evidence
        for b in batches:
            parts, lo, done, held = [], 0, 0, 0
            for code, word, script, first, _ in features(b.column(1)):
                e = barred[script]
                if len(code):
                    heads = np.flatnonzero(np.diff(word, prepend=-1))
                    e[word[heads]] += np.add.reduceat(table[code], heads, axis=0)
                parts.append((e, first))
                lo, held = lo + len(first) - 1, held + e.size
                if held > _FLUSH:
                    yield label(b.column(0).slice(done, lo - done), parts)
                    parts, done, held = [], lo, 0
            if parts:
                yield label(b.column(0).slice(done, lo - done), parts)

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return d.mapInArrow(run, "doc_id long, span int, lang string, start_word long, end_word long")
