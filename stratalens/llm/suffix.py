"""Suffix-array dedup (operator 7): passages of MIN_WORDS words or more that occur in two documents or more.

Suffixes are sorted where equal ones can meet. Every run of MIN_WORDS words belongs to its anchor, the run's ANCHOR-word gram of least hash, so equal runs have equal anchors; neighbouring runs of one anchor are a slice of the text. Anchors that only one document has are dropped by their hashes alone; the other slices are exchanged by anchor, equal ones collapsed, and a suffix array is built over each block of anchors: suffixes smaller than their successors are sorted directly, scans of the buckets induce the rest, and the common prefixes of neighbours in it find the runs that occur again. No run is missed and none is matched by a hash alone, but for 64-bit hashes of words.

Documents of equal texts are taken as one, and its copies get its place.

Defined cases: words are runs of bytes above 32, compared as bytes; a passage that occurs again only within its own document isn't a repeat; null or empty texts, texts under MIN_WORDS words and rows with a null doc_id have none; rows of one doc_id are one document, whose texts may differ: a passage in two of its texts isn't a repeat, and spans count the words of the text they are in; an empty table has none; a document of any length is read whole; other columns don't matter. Of each passage the least doc_id keeps its copy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stratalens.llm import common, textcols
from stratalens.llm.textcols import U

MIN_WORDS, ANCHOR = 50, 20
#: Words of a block of anchors whose suffixes are sorted together; a block is longer where one anchor is.
BLOCK = 300_000
_PLACE = U((1 << 26) - 1)


def slices(wh: np.ndarray, first: np.ndarray, length: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, first word in the array, number of runs, anchor's hash) of the slices of runs that share an anchor."""
    grams = textcols.ngrams(wh, anchor)
    width = length - anchor + 1
    if len(grams) < width:
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, U),)
    low = (grams & ~_PLACE) | (np.arange(len(grams), dtype=U) & _PLACE)
    span = 1
    while 2 * span <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if width > span:
        low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
    at = np.arange(len(low))
    low = low[(textcols.room(first)[: len(low)] >= length)]
    at = at[(textcols.room(first)[: len(at)] >= length)]
    if not len(at):
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, U),)
    place = at + ((low & _PLACE).astype(np.int64) - at) % (1 << 26)
    doc = np.searchsorted(first, at, "right") - 1
    new = np.ones(len(at), bool)
    new[1:] = (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])
    head = np.flatnonzero(new)
    return doc[head], at[head], np.diff(np.append(head, len(at))), grams[place[head]]


def smaller_than_next(t: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than its successor; the last counts as smaller."""
    n = len(t)
    differs = np.ones(n, bool)
    differs[:-1] = t[:-1] != t[1:]
    end = np.flatnonzero(differs)
    up = np.ones(n, bool)
    up[:-1] = t[:-1] < t[1:]
    return up[end[np.searchsorted(end, np.arange(n))]]


def packed(t: np.ndarray, bits: int) -> tuple[np.ndarray, int]:
    """Each position's next tokens in one number, blank after a 0, and how many they are."""
    per = max(1, min(16, 63 // bits))
    out, live = np.zeros(len(t), np.int64), np.ones(len(t), bool)
    for k in range(per):
        nxt = np.zeros(len(t), np.int64)
        nxt[: max(0, len(t) - k)] = t[k:]
        out = (out << bits) | np.where(live, nxt, 0)
        live &= nxt > 0
    return out, per


def suffix_array(t: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of t in the order of their first `depth` tokens at least, by two-stage sorting. t: tokens above 0, with a 0 after each text; a suffix ends with its text, and of equal ones the text that comes first is first."""
    n = len(t)
    bits = int(t.max()).bit_length() if n else 1
    keys, per = packed(t, bits)
    small = smaller_than_next(t)
    ends = np.flatnonzero(t == 0)
    left = ends[np.searchsorted(ends, np.arange(n))] - np.arange(n)  # tokens before the text's end
    # stage one: the smaller ones, directly, `per` tokens a round, only where they still tie
    direct = np.flatnonzero(small & (t > 0))
    order = direct[np.argsort(keys[direct], kind="stable")]
    group = np.zeros(len(order), np.int64)
    if len(order):
        group[1:] = np.cumsum(keys[order[1:]] != keys[order[:-1]])
    done = per
    while done < depth and len(order):
        tied = np.zeros(len(order), bool)
        same = group[1:] == group[:-1]
        tied[1:] |= same
        tied[:-1] |= same
        at = np.flatnonzero(tied & (left[order] >= done))
        if not len(at):
            break
        key = keys[np.minimum(order[at] + done, n - 1)]
        # members of a group that have ended come before all others
        sub = np.lexsort((key, group[at]))
        order[at] = order[at][sub]
        cut = np.zeros(len(order), bool)
        cut[1:] = group[1:] != group[:-1]
        k, g = key[sub], group[at]
        fresh = np.ones(len(at), bool)
        fresh[1:] = (k[1:] != k[:-1]) | (g[1:] != g[:-1])
        cut[at] |= fresh
        cut[0] = False
        group = np.cumsum(cut)
        done += per
    # stage two: buckets' scans induce the suffixes larger than their successors
    sizes = np.bincount(t, minlength=int(t.max()) + 1)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    sa = np.full(n, -1, np.int64)
    sa[: len(ends)] = ends
    s_count = np.bincount(t[order], minlength=len(sizes))
    s_start = bounds[1:] - s_count
    rank = np.arange(len(order)) - np.concatenate([[0], np.cumsum(s_count)])[t[order]]
    sa[s_start[t[order]] + rank] = order
    out, head, tokens, larger = sa.tolist(), bounds.tolist(), t.tolist(), (~small).tolist()
    for p in range(n):
        j = out[p] - 1
        if j >= 0 and larger[j]:
            c = tokens[j]
            out[head[c]] = j
            head[c] += 1
    return np.array(out, np.int64)


def again(texts: pa.Array, low: np.ndarray, high: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(slice, first run, end of runs, least doc_id) of the runs of `length` words that occur in two documents: stretches of a slice with one least doc_id. low, high: the least and greatest doc_id that has each slice."""
    parts, ids, place = [], [], []
    for lo, _, buf, bounds in textcols.chunks(texts):
        starts, ends, first = textcols.words(buf, bounds)
        n = np.diff(first)
        parts.append((textcols.span_hash(buf, starts, ends), n, lo))
    wh, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    _, token = np.unique(wh, return_inverse=True)
    ends = np.cumsum(n)
    t = np.insert(token.astype(np.int64) + 1, ends, 0)
    ids = np.repeat(np.arange(len(n)), n + 1)
    place = np.arange(len(t)) - np.repeat(ends - n + np.arange(len(n)), n + 1)
    sa = suffix_array(t, length)
    sa = sa[n[ids[sa]] - place[sa] >= length]
    keys, per = packed(t, int(t.max()).bit_length())
    same = np.ones(max(0, len(sa) - 1), bool)
    for off in sorted({*range(0, length - per + 1, per), max(0, length - per)}):
        live = np.flatnonzero(same)
        if not len(live):
            break
        if per > length:
            same[live] = [np.array_equal(t[a : a + length], t[b : b + length]) for a, b in zip(sa[:-1][live], sa[1:][live], strict=True)]
        else:
            same[live] = keys[sa[:-1][live] + off] == keys[sa[1:][live] + off]
    if not len(sa):
        return (np.empty(0, np.int64),) * 4
    heads = np.flatnonzero(np.concatenate([[True], ~same]))
    count = np.diff(np.append(heads, len(sa)))
    lead = np.repeat(np.minimum.reduceat(low[ids[sa]], heads), count)
    found = lead != np.repeat(np.maximum.reduceat(high[ids[sa]], heads), count)
    s, o, lead = ids[sa][found], place[sa][found], lead[found]
    by = np.lexsort((o, s))
    s, o, lead = s[by], o[by], lead[by]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (o[1:] != o[:-1] + 1) | (lead[1:] != lead[:-1])
    head = np.flatnonzero(new)
    return s[head], o[head], o[head] + np.diff(np.append(head, len(s))), lead[head]


def repeats(docs: DataFrame, length: int = MIN_WORDS, anchor: int = ANCHOR, block: int = BLOCK) -> DataFrame:
    """(doc_id, start_word, end_word, n_words, keep): the longest stretches of each document that runs of `length` words found in other documents cover; keep: the document has the least doc_id of all that have these runs."""
    common.small_batches(docs.sparkSession)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text <> ''").withColumn("part", F.xxhash64("text"))
    same = d.groupBy(F.unhex(F.md5("text")).alias("key")).agg(F.min("doc_id").alias("lead"), F.max("doc_id").alias("high")).where("lead <> high")
    same = common.stored(d.select("doc_id", "part", F.unhex(F.md5("text")).alias("key")).join(same, "key").select("doc_id", "part", "lead", "high").distinct(), "same")
    one = common.with_small(d, same, ["doc_id", "part"], "left").where("lead is null or lead = doc_id").select("doc_id", "text", F.coalesce("high", "doc_id").alias("high"), "part")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, high, part = (b.column(k).to_numpy() for k in (0, 2, 3))
            for lo, _, buf, bounds in textcols.chunks(b.column(1)):
                starts, ends, first = textcols.words(buf, bounds)
                doc, at, runs, key = slices(textcols.span_hash(buf, starts, ends), first, length, anchor)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(ids[lo + doc]), pa.array(high[lo + doc]), pa.array((at - first[doc]).astype(np.int32)), pa.array(runs.astype(np.int32)), pa.array(part[lo + doc])], ["key", "doc_id", "high", "at", "runs", "part"])

    key = Window.partitionBy("key")
    cuts = one.mapInArrow(cut, "key long, doc_id long, high long, at int, runs int, part long")
    cuts = cuts.withColumns({"a": F.min("doc_id").over(key), "b": F.max("high").over(key)}).where("a <> b")
    cuts = cuts.groupBy("doc_id", "part").agg(F.array_sort(F.collect_list(F.struct("at", "runs", "key"))).alias("cuts"))

    def shown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(4)
            bound, flat = lists.offsets.to_numpy(), lists.values
            at, runs, key = (flat.field(k).to_numpy() for k in ("at", "runs", "key"))
            ids, high, part = b.column(0).to_numpy(), b.column(2).to_numpy(), b.column(3).to_numpy()
            for lo, hi, buf, bounds in textcols.chunks(b.column(1)):
                starts, ends, first = textcols.words(buf, bounds)
                i, j = bound[lo], bound[hi]
                doc = np.repeat(np.arange(hi - lo), np.diff(bound[lo : hi + 1]))
                w = first[doc] + at[i:j]
                raw = buf.tobytes()
                text = [raw[x:y] for x, y in zip(starts[w].tolist(), ends[w + runs[i:j] + length - 2].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(key[i:j]), pa.array(text, pa.binary()), pa.array(ids[lo + doc]), pa.array(high[lo + doc]), pa.array(at[i:j]), pa.array(part[lo + doc])], ["key", "slice", "doc_id", "high", "at", "part"])

    shown_in = one.join(cuts, ["doc_id", "part"]).select("doc_id", "text", "high", "part", "cuts").mapInArrow(shown, "key long, slice binary, doc_id long, high long, at int, part long")
    cut_out = common.stored(shown_in.withColumn("hash", F.xxhash64("slice")), "slices")
    # equal slices are one row here, however often they occur; their places meet the result again by hash
    pieces = cut_out.groupBy("key", "slice").agg(F.min("doc_id").alias("low"), F.max("high").alias("high")).withColumn("hash", F.xxhash64("slice")).repartition("key").sortWithinPartitions("key")

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for b in batches:
            while b.num_rows:
                keys = b.column(0).to_numpy()
                if size < block:  # take rows until the block is full, then to the end of the anchor
                    weight = np.cumsum(np.diff(b.column(1).offsets.to_numpy() if hasattr(b.column(1), "offsets") else np.frombuffer(b.column(1).buffers()[1], np.int32)[b.column(1).offset : b.column(1).offset + b.num_rows + 1])) // 6
                    k = min(b.num_rows, int(np.searchsorted(weight, block - size)) + 1)
                    size += int(weight[k - 1])
                else:
                    last = held[-1].column(0)[-1].as_py()
                    k = int(np.searchsorted(keys != last, True)) if (keys == last).any() and keys[0] == last else 0
                    if k == 0:
                        yield from solve(held)
                        held, size = [], 0
                        continue
                held.append(b.slice(0, k))
                b = b.slice(k)
        if held:
            yield from solve(held)

    def solve(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = pa.Table.from_batches(held).combine_chunks()
        col = lambda k: b.column(k).combine_chunks()
        s, lo, hi, lead = again(col(1), col(2).to_numpy(), col(3).to_numpy(), length)
        yield pa.RecordBatch.from_arrays([col(0).take(pa.array(s)), col(4).take(pa.array(s)), pa.array(lo), pa.array(hi + length - 1), pa.array(lead)], ["key", "hash", "lo", "hi", "lead"])

    found = pieces.mapInArrow(sort, "key long, hash long, lo long, hi long, lead long")
    runs = cut_out.select("key", "hash", "doc_id", "part", "at").join(found, ["key", "hash"]).select("doc_id", "part", (F.col("at") + F.col("lo")).alias("start_word"), (F.col("at") + F.col("hi")).alias("end_word"), (F.col("lead") == F.col("doc_id")).alias("keep"))
    copies = common.with_small(d, same.where("doc_id <> lead").select("doc_id", "part"), ["doc_id", "part"], "left_semi").dropDuplicates(["doc_id", "part"])
    copies = copies.select("doc_id", "part", F.lit(0).cast("long").alias("start_word"), F.regexp_count("text", F.lit(r"[^\x00-\x20]+")).cast("long").alias("end_word"), F.lit(False).alias("keep")).where(F.col("end_word") >= length)
    doc = Window.partitionBy("doc_id", "part", "keep").orderBy("start_word", "end_word")
    out = runs.unionByName(copies).withColumn("reach", F.max("end_word").over(doc.rowsBetween(Window.unboundedPreceding, -1)))
    out = out.withColumn("stretch", F.sum(F.when(F.col("start_word") <= F.col("reach"), 0).otherwise(1)).over(doc.rowsBetween(Window.unboundedPreceding, 0)))
    out = out.groupBy("doc_id", "part", "keep", "stretch").agg(F.min("start_word").alias("start_word"), F.max("end_word").alias("end_word"))
    return out.select("doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), "keep")
