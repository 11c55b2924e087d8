"""Byte-level BPE encoding and decoding (operator 3).

Spark's higher-order functions fold the ranked merges over a word's bytes: each step looks up the rank of every two neighbouring pieces joined and merges the leftmost pair of least rank. The ranks are a literal: an array of small maps, by hash, so that a look-up doesn't search all keys. Words are counted over the whole table; the fold runs once for each distinct word that occurs often, of at most FREQUENT words whatever the size of the table, and their ids are broadcast. One Arrow pass then splits the texts and looks each word up; words that the broadcast lacks are merged there, once in each worker while its table of RARE words lasts, so no exchange ever holds the texts. The same pass decodes the ids' binary pieces and compares them with the text.

A vocabulary is a file of base64 pieces and ranks, the path a parameter; it isn't copied into the repository. Words that aren't frequent are merged by encode_short, a list of pairs, and those of more than LONG bytes by encode_word, a heap, since a list takes time with the square of the length; results are those of the fold.

Defined cases: a null text has null tokens, an empty one none; repeated rows are encoded alike; other columns don't matter. Texts that aren't valid UTF-8 are read as Java reads them.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.classic.column import Column as ClassicColumn

from stratalens.llm import common, textcols

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
FREQUENT, RARE, LONG = 1 << 18, 1 << 16, 64
#: More than the bytes of a word that is folded.
PLACE_BITS = 20
PLACES = 1 << PLACE_BITS
_WHITE = r"\u0009-\u000d \u0085   -     　"
#: Letters first, as most words are letters: no other branch can begin where they match.
PATTERN = rf" ?\p{{L}}++| ?\p{{N}}++|'(?:[stmd]|re|ve|ll)| ?[^{_WHITE}\p{{L}}\p{{N}}]++|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+"
#: 0 white, 1 letters (and all bytes of characters beyond ASCII), 2 digits, 3 other signs.
_KIND = np.array([0 if i <= 32 else 1 if i > 127 or chr(i).isalpha() else 2 if chr(i).isdigit() else 3 for i in range(256)], np.int8)
_words = regex.compile(PATTERN)


def read_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, f)}


def array_literal(spark: SparkSession, values: pa.Array) -> Column:
    """values as one literal array in Spark's own binary form: it is found by position, and plans don't print it."""
    df = spark.createDataFrame(pa.table({"a": pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)}))
    value = df._jdf.queryExecution().executedPlan().executeCollect()[0].getArray(0)
    jvm = spark.sparkContext._jvm.org.apache.spark.sql
    return ClassicColumn(jvm.classic.ExpressionUtils.column(jvm.catalyst.expressions.Literal(value, df._jdf.schema().apply(0).dataType())))


def map_literal(spark: SparkSession, keys: pa.Array, values: pa.Array, room: int = 2) -> Callable[[Column], Column]:
    """A function from a column of the keys' type, text or binary, to its value, or null: maps of 2 ** (room - 1) to 2 ** room keys, by the key's hash."""
    n = 1 << max(4, len(keys).bit_length() - room)
    at = spark.createDataFrame(pa.table({"k": keys})).select(F.pmod(F.hash("k"), F.lit(n)).alias("at")).toArrow().column(0).to_numpy() if len(keys) else np.empty(0, np.int64)
    order = np.argsort(at, kind="stable")
    bounds = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=n))]).astype(np.int32)
    maps = array_literal(spark, pa.MapArray.from_arrays(pa.array(bounds), keys.take(pa.array(order)), values.take(pa.array(order))))
    return lambda k: F.try_element_at(F.get(maps, F.pmod(F.hash(k), F.lit(n))), k)


def char(rank: int) -> str:
    """The character that stands for a piece; none is a surrogate."""
    return chr(rank + 0x100 if rank < 0xD700 else rank + 0x900)


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def folder(spark: SparkSession, ranks: dict[bytes, int]) -> Callable[[Column], Column]:
    """A function from a binary column to the ids of its pieces after all merges.

    The fold's state is the string of pieces, a character for each; a step looks up the rank of every two neighbours joined, in a literal map of all pairs of pieces that the vocabulary joins, and puts the leftmost pair of least rank together. Rank and place are one number, so that the least of them tells both.
    """
    pairs = [(char(ranks[w[:k]]) + char(ranks[w[k:]]), r * PLACES) for w, r in ranks.items() for k in range(1, len(w)) if w[:k] in ranks and w[k:] in ranks]
    rank = map_literal(spark, pa.array([k for k, _ in pairs], pa.string()), pa.array([r for _, r in pairs], pa.int64()), 1)
    chars = array_literal(spark, pa.array([char(i) for i in range(max(ranks.values()) + 1)], pa.string()))
    single = [i for i in range(256) if bytes([i]) in ranks]

    def fold(word: Column) -> Column:
        def step(s: Column, _: Column) -> Column:
            found = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(s) - 1)), lambda i: rank(F.substring(s, i, F.lit(2))) + i)
            joined = lambda m, i: F.concat(F.substring(s, F.lit(1), i - 1), F.get(chars, F.shiftright(m, PLACE_BITS).cast("int")), F.substring(s, i + 2, F.length(s)))
            return let(F.array_min(found), lambda m: F.when(m.isNull(), s).otherwise(joined(m, m.bitwiseAND(PLACES - 1).cast("int"))))

        start = F.translate(F.decode(word, "ISO-8859-1"), "".join(map(chr, single)), "".join(char(ranks[bytes([i])]) for i in single))
        done = F.aggregate(F.sequence(F.lit(2), F.octet_length(word)), start, step)
        point = lambda s: F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.ascii(F.substring(s, i, F.lit(1))))
        return F.transform(let(done, point), lambda p: F.when(p < 0xD800, p - 0x100).otherwise(p - 0x900))

    return fold


def encode_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges by a heap over linked pieces, in n log n steps."""
    if word in ranks:
        return [ranks[word]]
    ends, nxt, prev, alive = [i + 1 for i in range(len(word))], list(range(1, len(word) + 1)), list(range(-1, len(word) - 1)), [True] * len(word)
    heap: list[tuple[int, int, int]] = []

    def offer(i: int) -> None:
        j = nxt[i]
        if j < len(word) and (r := ranks.get(word[i : ends[j]])) is not None:
            heapq.heappush(heap, (r, i, ends[j]))

    for i in range(len(word)):
        offer(i)
    while heap:
        _, i, end = heapq.heappop(heap)
        j = nxt[i] if alive[i] else len(word)
        if j >= len(word) or ends[j] != end:
            continue
        ends[i], nxt[i], alive[j] = end, nxt[j], False
        if nxt[i] < len(word):
            prev[nxt[i]] = i
        offer(i)
        if prev[i] >= 0:
            offer(prev[i])
    out, i = [], 0
    while i < len(word):
        out.append(ranks[word[i : ends[i]]])
        i = nxt[i]
    return out


def encode_short(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges over a list of pieces: quicker for few of them."""
    if word in ranks:
        return [ranks[word]]
    get, none = ranks.get, 1 << 31
    pieces = [word[i : i + 1] for i in range(len(word))]
    pairs = [get(word[i : i + 2], none) for i in range(len(word) - 1)]
    while pairs and (least := min(pairs)) < none:
        i = pairs.index(least)
        pieces[i] += pieces.pop(i + 1)
        del pairs[i]
        if i < len(pairs):
            pairs[i] = get(pieces[i] + pieces[i + 1], none)
        if i:
            pairs[i - 1] = get(pieces[i - 1] + pieces[i], none)
    return [ranks[x] for x in pieces]


def encode_whole(text: str, ranks: dict[bytes, int]) -> list[int]:
    return [x for w in _words.findall(text) for x in encode_word(w.encode(), ranks)]


def near_words(buf: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of letters, digits or other signs, with the space before them: by bytes, so nearly the pattern's words. It only proposes entries for the literal of frequent words."""
    kind = _KIND[buf]
    new = np.ones(len(buf), bool)
    new[1:] = kind[1:] != kind[:-1]
    new[bounds[:-1][bounds[:-1] < len(buf)]] = True
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(buf))
    solid = kind[starts] > 0
    starts, ends = starts[solid], ends[solid]
    space = (starts > 0) & (buf[starts - 1] == 32) & ~np.isin(starts, bounds)
    return starts - space, ends


def frequent_words(docs: DataFrame, limit: int = FREQUENT) -> DataFrame:
    """(word: binary) of the words that occur at least c times, c being the least count, 2 at least, that at most limit words reach."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, buf, bounds in textcols.chunks(b.column(0), 8 * textcols.CHUNK):
                starts, ends = near_words(buf, bounds)
                short = ends - starts <= 4 * LONG
                starts, ends = starts[short], ends[short]
                _, at, n = np.unique(textcols.span_hash(buf, starts, ends), return_index=True, return_counts=True)
                raw = buf.tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([raw[i:j] for i, j in zip(starts[at].tolist(), ends[at].tolist(), strict=True)], pa.binary()), pa.array(n)], ["word", "n"])

    counts = docs.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).where("n > 1")
    counts = common.stored(counts, "words")
    steps = sorted(counts.groupBy(F.least("n", F.lit(1 << 16)).alias("n")).agg(F.count(F.lit(1)).alias("words")).collect(), reverse=True)  # a row for each count, 65,536 at most
    least, total = None, 0
    for n, k in steps:
        total += k
        if total > limit:
            break
        least = n
    return counts.where(F.lit(False) if least is None else F.col("n") >= least).select("word")


class Words(dict):
    """Word -> its ids as the bytes of 32-bit numbers: the frequent words, and up to `room` others, merged when they are first asked for and forgotten together."""

    def __init__(self, words: list[str], ids: list[bytes], ranks: dict[bytes, int], room: int = RARE, long: int = LONG):
        super().__init__(zip(words, ids, strict=True))
        self.words, self.ids, self.ranks, self.room, self.long = words, ids, ranks, room, long

    def __reduce__(self):
        return Words, (self.words, self.ids, self.ranks, self.room, self.long)

    def __missing__(self, word: str) -> bytes:
        raw = word.encode()
        short = len(raw) <= self.long
        ids = np.array((encode_short if short else encode_word)(raw, self.ranks), np.int32).tobytes()
        if short:
            if len(self) >= len(self.words) + self.room:
                self.clear()
                self.update(zip(self.words, self.ids, strict=True))
            self[word] = ids
        return ids


def encode(docs: DataFrame, vocabulary: str = VOCABULARY, frequent: int = FREQUENT, rare: int = RARE, long: int = LONG) -> DataFrame:
    """(doc_id, tokens: the ids of the whole text, n_tokens, round_trip: whether decoding gives the text again) of all documents."""
    spark = docs.sparkSession
    common.small_batches(spark)
    ranks = read_ranks(vocabulary)
    folded = folder(spark, ranks)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    often = frequent_words(d, frequent).where(F.is_valid_utf8(F.col("word").cast("string"))).select(F.col("word").cast("string").alias("key"), folded(F.col("word")).alias("ids")).toArrow()
    words, ids = (often.column(i).combine_chunks() for i in range(2))
    bounds, numbers = (4 * ids.offsets.to_numpy()).tolist(), ids.flatten().to_numpy().astype(np.int32).tobytes()
    lo = bounds[0] if bounds else 0
    shared = spark.sparkContext.broadcast(Words(words.to_pylist(), [numbers[i - lo : j - lo] for i, j in zip(bounds, bounds[1:])], ranks, rare, long))
    del often, words, ids, bounds, numbers
    kinds = pa.schema([("doc_id", pa.int64()), ("tokens", pa.list_(pa.int32())), ("n_tokens", pa.int32()), ("round_trip", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        ids_of = table.__getitem__
        pieces = [b""] * (max(table.ranks.values()) + 1)
        for piece, i in table.ranks.items():
            pieces[i] = piece
        pieces = pa.array(pieces, pa.binary())
        for b in batches:
            null, valid = (x.to_numpy(zero_copy_only=False) for x in (b.column(1).is_null(), b.column(2)))
            for i, j, buf, at in textcols.chunks(b.column(1), 8 * textcols.CHUNK):
                raw, ends = buf.tobytes(), at.tolist()
                tokens = [b"".join(map(ids_of, _words.findall(raw[x:y].decode()))) for x, y in zip(ends, ends[1:])]
                places = np.cumsum([0, *map(len, tokens)]) // 4
                numbers = pa.array(np.frombuffer(b"".join(tokens), np.int32))
                back = pieces.take(numbers)
                _, off, data = back.buffers()
                where = (np.frombuffer(off, np.int32)[places] if len(back) else 0 * places).tolist()
                out = data.to_pybytes() if data is not None else b""
                same = [out[x:y] == raw[u:v] for x, y, u, v in zip(where, where[1:], ends, ends[1:])]
                lists = pa.ListArray.from_arrays(pa.array(places.astype(np.int32)), numbers, mask=pa.array(null[i:j]))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), lists, pa.array(np.diff(places).astype(np.int32)), pa.array(np.array(same, bool) & valid[i:j])], schema=kinds)

    # bytes that are no text become what Java reads them as
    as_java = F.array_join(F.regexp_extract_all("text", F.lit("(?s).+"), F.lit(0)), "")
    valid = F.coalesce(F.is_valid_utf8("text"), F.lit(True))
    return d.select("doc_id", F.when(valid, F.col("text")).otherwise(as_java).alias("text"), valid.alias("valid")).mapInArrow(run, "doc_id long, tokens array<int>, n_tokens int, round_trip boolean")


def decoded(spark: SparkSession, tokens: Column, vocabulary: str = VOCABULARY) -> Column:
    """The text of the ids: their binary pieces, concatenated; an unknown id becomes U+FFFD."""
    ranks = read_ranks(vocabulary)
    pieces: list[bytes | None] = [None] * (max(ranks.values()) + 1)
    for piece, i in ranks.items():
        pieces[i] = piece
    table = array_literal(spark, pa.array(pieces, pa.binary()).view(pa.string()))  # bytes, mostly no whole characters: nothing checks or changes them
    return F.array_join(F.transform(tokens, lambda t: F.get(table, t)), "", "\ufffd")


def encoded(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, tokens, n_tokens, round_trip: whether decoding gives the text again) of every document."""
    return encode(docs, vocabulary)
