"""MinHash near-dedup with circulant permutations (operator 10).

A document's shingles are its runs of SHINGLE words (runs of ASCII letters and digits and of all other characters' bytes, ASCII case ignored). Shingle hashes go through the permutation sigma into a universe of 2 ** 20 points; coordinate k of the signature is the least pi[(sigma(x) + k) mod 2 ** 20] over the shingles x: the second permutation, circularly shifted, gives all coordinates, and the values that one shingle brings lie side by side in its table. Bands of ROWS coordinates choose candidate pairs; the exact Jaccard index of the shingle sets decides; groups are the connected components.

Most dissimilar candidates never meet their texts: each set has a sketch, a bit for the hash of each shingle. Every bit in which two sketches differ is a shingle of one set alone, so too many of them, or sizes too far apart, prove that the index is below the threshold: no link is lost by it.

Defined cases: fewer words than SHINGLE make one shingle; a text with no word (signs only) is one shingle as a whole; null or empty texts and rows with a null doc_id are near nothing and kept; rows of one doc_id count as one document, near whatever any of its texts is near; a document is in one group only, of ties the least doc_id is kept; an empty table gives no group; a text of any length is read whole; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from stratalens.llm import common, textcols
from stratalens.llm.textcols import U

SHINGLE, BANDS, ROWS, THRESHOLD, SEED = 3, 42, 3, 0.5, 20
UNIVERSE_BITS = 20
#: Least and most bits of a sketch.
SKETCH, SKETCHES = 1 << 10, 1 << 13
#: Pairs, and rows of buckets, that are held at once.
PAIRS, HELD = 1 << 16, 1 << 14
_tables: dict[tuple[int, int], np.ndarray] = {}


def circulant(k: int, seed: int) -> np.ndarray:
    """Items of k values, item x being pi[x], pi[x + 1], ... around the circle, as one overlapping view of pi."""
    got = _tables.get((k, seed))
    if got is None:
        pi = np.random.default_rng(seed).permutation(1 << UNIVERSE_BITS).astype(np.uint32)
        got = _tables[k, seed] = np.ndarray((len(pi),), f"V{4 * k}", np.concatenate([pi, pi[:k]]), strides=(4,))
    return got


def sigma(shingles: np.ndarray) -> np.ndarray:
    """Positions in the universe: the top bits of the hash, then a bijection on them."""
    bits, mask = U(UNIVERSE_BITS), U((1 << UNIVERSE_BITS) - 1)
    with np.errstate(over="ignore"):
        x = shingles >> (U(64) - bits)
        x = (x * U(0x5851F42D4C957F2D) + U(0x14057B7EF767814F)) & mask
        x ^= x >> U(UNIVERSE_BITS // 2)
        return ((x * U(0x2545F4914F6CDD1D)) & mask).astype(np.int64)


def signature(shingles: np.ndarray, k: int, seed: int = SEED) -> np.ndarray:
    table, at, out = circulant(k, seed), sigma(shingles), np.full(k, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(at), 2048):
        np.minimum(out, table[at[i : i + 2048]].view(np.uint32).reshape(-1, k).min(axis=0), out=out)
    return out


def shingle_sets(texts: pa.Array, shingle: int = SHINGLE) -> Iterator[np.ndarray]:
    """Each text's sorted distinct shingle hashes."""
    for _, _, buf, bounds in textcols.chunks(texts):
        low = textcols.LOWER[buf]
        starts, ends, first = textcols.words(low, bounds, textcols.WORDLIKE)
        wh = textcols.span_hash(low, starts, ends)
        grams, n_words = textcols.ngrams(wh, shingle), np.diff(first)
        for d in range(len(bounds) - 1):
            n = n_words[d]
            if n >= shingle:
                yield np.unique(grams[first[d] : first[d + 1] - shingle + 1])
            elif n:
                yield textcols.ngrams(wh[first[d] : first[d + 1]], int(n))
            elif bounds[d + 1] > bounds[d]:
                yield textcols.span_hash(low, bounds[d : d + 1], bounds[d + 1 : d + 2])
            else:
                yield np.empty(0, U)


def sketch(shingles: np.ndarray) -> bytes:
    """Bits of which each shingle sets one: twice as many as shingles at least, as far as SKETCHES goes, and a power of two, so that halves laid on each other are the sketch of half as many."""
    n = min(SKETCHES, max(SKETCH, 2 << max(0, len(shingles) - 1).bit_length()))
    bits = np.zeros(n, bool)
    bits[(shingles >> U(UNIVERSE_BITS)).astype(np.int64) & (n - 1)] = True
    return np.packbits(bits, bitorder="little").tobytes()


class Sketches:
    """The sketches of a column, for each number of bits those of as many or more."""

    def __init__(self, column: pa.Array):
        raw = column.to_pylist()
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        self.lengths, self.folded = lengths, {}
        above = np.empty((0, SKETCHES // 64), U)
        where = np.empty(0, np.int64)
        n = SKETCHES // 8
        while n >= SKETCH // 8:
            own = np.flatnonzero(lengths == n)
            bits = np.frombuffer(b"".join([raw[i] for i in own]), U).reshape(-1, n // 8)
            above, where = np.concatenate([bits, above]), np.concatenate([own, where])
            at = np.full(len(column), -1)
            at[where] = np.arange(len(where))
            self.folded[n] = above, at
            above = above[:, : n // 16] | above[:, n // 16 :]
            n //= 2


def may_be_near(x: Sketches, y: Sketches, i: np.ndarray, j: np.ndarray, sizes: np.ndarray, threshold: float) -> np.ndarray:
    """Whether x[i] and y[j], whose sizes have the sums `sizes`, can reach the threshold as far as their sketches tell."""
    most, out = sizes * ((1 - threshold) / (1 + threshold)) + 1e-6, np.ones(len(i), bool)
    common_length = np.minimum(x.lengths[i], y.lengths[j])
    for n in np.unique(common_length).tolist():
        (a, at), (b, bt), own = x.folded[n], y.folded[n], np.flatnonzero(common_length == n)
        step = max(1, (1 << 22) // n)
        for k in range(0, len(own), step):
            o = own[k : k + step]
            out[o] = np.bitwise_count(a[at[i[o]]] ^ b[bt[j[o]]]).sum(axis=1, dtype=np.int64) <= most[o]
    return out


def near_sizes(x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    return np.minimum(x, y) >= threshold * np.maximum(x, y) - 1e-6


def signatures(docs: DataFrame, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, seed: int = SEED) -> DataFrame:
    """(doc_id, part: the text's hash, whole: one of the shingle set, size: its shingles, sketch, bands: array of the bands' hashes) of each document with a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = textcols.mix(np.arange(1, bands + 1, dtype=U))
        for b in batches:
            whole, keys, ids, sizes, sketches = [], [], [], [], []
            for i, s in enumerate(shingle_sets(b.column(1), shingle)):
                if len(s):
                    ids.append(i)
                    sizes.append(len(s))
                    sketches.append(sketch(s))
                    whole.append(textcols.mix1(int(np.bitwise_xor.reduce(s)) + len(s)))
                    sig = signature(s, bands * rows, seed).reshape(bands, rows).astype(U)
                    with np.errstate(over="ignore"):
                        acc = salt.copy()
                        for r in range(rows):
                            acc = textcols.mix(acc * U(0x100000001B3) + sig[:, r])
                    keys.append(acc.view(np.int64))
            keys = pa.array(np.concatenate(keys) if keys else np.empty(0, np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype=np.int32) * bands), keys)
            at = pa.array(ids, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(2).take(at), pa.array(np.array(whole, U).view(np.int64)), pa.array(sizes, pa.int64()), pa.array(sketches, pa.binary()), lists], ["doc_id", "part", "whole", "size", "sketch", "bands"])

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text <> ''").withColumn("part", F.xxhash64("text"))
    return d.mapInArrow(run, "doc_id long, part long, whole long, size long, sketch binary, bands array<long>")


def jaccard(pairs: DataFrame, texts: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """pairs (a, b) with their exact Jaccard index j."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            j = np.empty(b.num_rows)
            for i, (x, y) in enumerate(zip(shingle_sets(b.column(2), shingle), shingle_sets(b.column(3), shingle), strict=True)):
                both = len(np.intersect1d(x, y, assume_unique=True))
                j[i] = both / max(1, len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(j)], ["a", "b", "j"])

    joined = pairs.join(texts.select(F.col("rep").alias("b"), F.col("text").alias("tb")), "b").join(texts.select(F.col("rep").alias("a"), F.col("text").alias("ta")), "a")
    return joined.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long, j double")


def possible(pairs: DataFrame, sketches: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose sketches don't rule them out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            every, x, y = np.arange(b.num_rows), Sketches(b.column(2)), Sketches(b.column(4))
            sizes = b.column(3).to_numpy(), b.column(5).to_numpy()
            keep = near_sizes(*sizes, threshold) & may_be_near(x, y, every, every, sizes[0] + sizes[1], threshold)
            yield b.select(["a", "b"]).filter(pa.array(keep))

    joined = pairs.join(sketches.toDF("b", "yn", "y"), "b").join(sketches.toDF("a", "xn", "x"), "a")
    return joined.select("a", "b", "x", "xn", "y", "yn").mapInArrow(run, "a long, b long")


def in_buckets(rows: DataFrame, threshold: float) -> DataFrame:
    """rows (key, rep, lead, root, odd, size, sketch) -> (a, b): within each key the odd ones with all of other roots but the leader, unless sizes or sketches rule them out. Pairs are made PAIRS at a time and mostly end there, so that a bucket of many dissimilar sets costs no exchange and no text."""

    def pairs(t: pa.Table) -> Iterator[pa.RecordBatch]:
        key, rep, lead, root, odd, size = (t[c].to_numpy() for c in ("key", "rep", "lead", "root", "odd", "size"))
        bits = Sketches(t["sketch"].combine_chunks())
        new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        group = np.searchsorted(new, np.arange(len(key)), "right") - 1
        first, after = new[group], np.append(new[1:], len(key))[group]
        whole = np.flatnonzero(odd)
        ends = np.cumsum(after[whole] - first[whole])
        total, done = int(ends[-1]) if len(ends) else 0, 0
        while done < total:
            at = np.arange(done, min(total, done + PAIRS))
            k = np.searchsorted(ends, at, "right")
            i = whole[k]
            j = after[i] - (ends[k] - at)
            done = int(at[-1]) + 1
            for test in (lambda: root[i] != root[j], lambda: near_sizes(size[i], size[j], threshold), lambda: (rep[j] != lead[j]) & (~odd[j] | (rep[i] > rep[j])), lambda: may_be_near(bits, bits, i, j, size[i] + size[j], threshold)):
                keep = test()
                i, j = i[keep], j[keep]
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(rep[i], rep[j])), pa.array(np.minimum(rep[i], rep[j]))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n, want = 0, HELD
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= want:
                t = pa.Table.from_batches(held)
                key = t["key"].to_numpy()
                cut = int(np.flatnonzero(key != key[-1])[-1]) + 1 if key[0] != key[-1] else 0  # the last bucket may go on
                yield from pairs(t.slice(0, cut)) if cut else ()
                held = t.slice(cut).to_batches()
                n -= cut
                want = max(HELD, 2 * n)
        if n:
            yield from pairs(pa.Table.from_batches(held))

    return rows.select("key", "rep", "lead", "root", "odd", "size", "sketch").repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long").distinct()


def groups(docs: DataFrame, threshold: float = THRESHOLD, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, seed: int = SEED) -> DataFrame:
    """(doc_id, group_id, group_size, keep) of each document in a group of two or more; group_id is the group's least doc_id, the one to keep.

    The nodes are the distinct shingle sets, so that documents of equal ones are joined first and one text stands for all. In each band's bucket, all are compared with the least one; then the pairs in a bucket that this leaves in different groups are compared too, so that every candidate pair is decided exactly, without the square of a group of copies. Texts are read only for the pairs that sizes and sketches leave open. The sets of one doc_id are joined as well.
    """
    common.small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sigs = common.stored(signatures(docs, shingle, bands, rows, seed), "sigs")
    reps = sigs.groupBy("whole").agg(F.min(F.struct("doc_id", "part", "bands")).alias("r")).select(F.col("whole").alias("rep"), "r.doc_id", "r.part", "r.bands")
    key = Window.partitionBy("key")
    buckets = common.stored(reps.select("rep", "doc_id", "part", F.explode("bands").alias("key")).withColumns({"lead": F.min("rep").over(key), "high": F.max("rep").over(key)}).where("lead <> high").select("key", "rep", "lead", "doc_id", "part"), "buckets")
    chosen = buckets.select("rep", "doc_id", "part").distinct()
    texts = docs.where("text <> ''").withColumn("part", F.xxhash64("text"))
    texts = common.stored(common.with_small(texts, chosen, ["doc_id", "part"], "inner").dropDuplicates(["rep"]).select("rep", "text"), "candidates")
    sketches = sigs.select(F.col("whole").alias("rep"), "size", "sketch").join(chosen.select("rep"), "rep", "left_semi").dropDuplicates(["rep"])
    sketches = common.stored(sketches, "sketches")
    led = possible(buckets.where("rep <> lead").select(F.col("rep").alias("a"), F.col("lead").alias("b")).distinct(), sketches, threshold)
    stars = common.stored(jaccard(led, texts, shingle), "stars")
    near = stars.where(F.col("j") >= threshold).select("a", "b")
    parts = common.components(near, "parts")
    # a bucket's members outside its leader's group, against all of other groups in that bucket
    inside = buckets.select("key", "rep", "lead").join(parts.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    at_lead = F.max(F.when(F.col("rep") == F.col("lead"), F.col("root"))).over(key)
    open_ = common.stored(inside.withColumn("at_lead", at_lead).withColumn("odd", F.col("root") != F.col("at_lead")).withColumn("any", F.max("odd").over(key)).where("any").select("key", "rep", "lead", "root", "odd"), "open")
    rest = in_buckets(open_.join(sketches, "rep"), threshold)
    more = jaccard(rest.join(stars, ["a", "b"], "left_anti"), texts, shingle).where(F.col("j") >= threshold).select("a", "b")
    ids = sigs.select("doc_id", "whole").distinct()
    several = ids.groupBy("doc_id").agg(F.min("whole").alias("b"), F.collect_set("whole").alias("a")).where("size(a) > 1").select(F.explode("a").alias("a"), "b")
    roots = common.components(near.union(more).union(several), "groups").withColumnRenamed("node", "whole")
    grouped = ids.join(roots, "whole", "left").select("doc_id", F.coalesce("root", "whole").alias("root")).distinct()
    sized = grouped.groupBy("root").agg(F.min("doc_id").alias("group_id"), F.count(F.lit(1)).alias("group_size")).where("group_size > 1")
    return grouped.join(sized, "root").select("doc_id", "group_id", "group_size", (F.col("doc_id") == F.col("group_id")).alias("keep"))


def drop_near_copies(docs: DataFrame, **parameters) -> DataFrame:
    """docs, all columns, with one document of each group, the one of the least doc_id; of repeated rows (same doc_id and text) one stays, the one whose other columns hash least."""
    gone = common.stored(groups(docs, **parameters).where("not keep").select("doc_id"), "gone")
    left = common.with_small(docs.alias("d"), gone, "doc_id", "left_anti")
    twice = docs.groupBy("doc_id").count().where("count > 1 and doc_id is not null").select("doc_id")
    twice = common.stored(twice, "twice")
    if twice.isEmpty():
        return left
    same = Window.partitionBy("doc_id", "text").orderBy(F.xxhash64(*[c for c in docs.columns if not isinstance(docs.schema[c].dataType, T.MapType)]))
    nth = "__copy" + "_" * max(map(len, docs.columns))  # no column's name
    again = common.with_small(left, twice, "doc_id", "left_semi").select(*docs.columns, F.row_number().over(same).alias(nth))
    return common.with_small(left, twice, "doc_id", "left_anti").unionByName(again.where(F.col(nth) == 1).drop(nth))
