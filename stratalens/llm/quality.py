"""Hashed n-gram models of trusted and raw text: quality rules (operator 2) and importance resampling (operator 6).

Two kinds of n-grams, hashed into buckets: runs of three bytes (16,384 buckets: the top bits of a multiplicative hash), and pairs of neighbouring words (4,096 buckets: the exclusive or of the words' polynomial hashes, so that every word that is followed by itself falls into bucket 0). Words are runs of bytes above 32. The raw model counts all documents; the target model those that the labels call good and not toxic. Each target probability is smoothed towards the raw one, so that a bucket without evidence says nothing.

Defined cases: a null or empty text has no n-gram, so score and weight 0; with no trusted document all ratios are 0; repeated rows count as often as they occur and get equal scores; labels with a null or unknown doc_id are ignored, and a doc_id is trusted if it has labels and all of them trust it; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalens.llm import common, textcols

BYTE_BUCKETS, PAIR_BUCKETS = 1 << 14, 1 << 12
BUCKETS = BYTE_BUCKETS + PAIR_BUCKETS
#: Added target n-grams for each kind, distributed as the raw ones.
PRIOR = {"bytes": BYTE_BUCKETS, "pairs": PAIR_BUCKETS}
#: Score below which a document goes, and the n-grams without evidence that are added to each kind's length, which keep short texts near 0.
THRESHOLD, PSEUDO_LENGTH = -0.3, 40
#: Share of the documents that importance resampling selects.
SHARE, SEED = 0.8, 6


PRIME = 1048573
_powers: dict[int, np.ndarray] = {}


def word_hash(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Bytes as digits to the base 257, modulo a prime below 2 ** 20."""
    n = len(buf)
    power, inverse = (modular_powers(x, n + 1) for x in (257, pow(257, -1, PRIME)))
    sums = np.zeros(n + 1, np.int64)
    np.cumsum(buf * inverse[:n] % PRIME, out=sums[1:])
    return (sums[ends] - sums[starts]) % PRIME * power[ends - 1] % PRIME if len(starts) else np.zeros(0, np.int64)


def modular_powers(base: int, n: int) -> np.ndarray:
    """base ** i modulo PRIME for i below n, or more of them."""
    got = _powers.get(base, np.ones(1, np.int64))
    while len(got) < n:
        got = np.concatenate([got, got * pow(base, len(got), PRIME) % PRIME])
    if len(got) <= 1 << 20:
        _powers[base] = got
    return got


def grams(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """By chunk: buckets of the byte trigrams, their bounds by document, buckets of the word pairs, their bounds."""
    for _, _, buf, bounds in textcols.chunks(texts):
        b = buf.astype(np.int64)
        code = (b[:-2] << 16) + (b[1:-1] << 8) + b[2:] if len(b) > 2 else np.empty(0, np.int64)
        code = ((code * 2654435761) & 0xFFFFFFFF) >> 18
        inside = np.ones(len(code), bool)
        for k in (1, 2):
            cut = bounds[1:-1] - k
            inside[cut[(cut >= 0) & (cut < len(code))]] = False
        first3 = np.concatenate([[0], np.cumsum(np.maximum(np.diff(bounds) - 2, 0))])
        starts, ends, first = textcols.words(buf, bounds)
        wh = word_hash(buf, starts, ends)
        pair = (wh[:-1] ^ wh[1:]) % PAIR_BUCKETS
        near = np.ones(len(pair), bool)
        cut = first[1:-1] - 1
        near[cut[(cut >= 0) & (cut < len(pair))]] = False
        first2 = np.concatenate([[0], np.cumsum(np.maximum(np.diff(first) - 1, 0))])
        yield code[inside], first3, pair[near], first2


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    out = np.zeros(len(bounds) - 1)
    some = bounds[1:] > bounds[:-1]
    if len(values):
        out[some] = np.add.reduceat(values, bounds[:-1][some])
    return out


def trusted_ids(labels: DataFrame) -> DataFrame:
    good = (F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)
    return labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(F.coalesce(good, F.lit(False))).alias("good")).where("good").select("doc_id")


def log_ratios(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """ln(target / raw) of each bucket: byte trigrams, then word pairs. A fixed number of counts comes to the driver, however many documents there are."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, BUCKETS), np.int64)
        for b in batches:
            good = b.column(1).to_numpy(zero_copy_only=False).astype(bool)
            lo = 0
            for code, f3, pair, f2 in grams(b.column(0)):
                g = good[lo : lo + len(f3) - 1]
                lo += len(g)
                for x, f, at, size in ((code, f3, 0, BYTE_BUCKETS), (pair, f2, BYTE_BUCKETS, PAIR_BUCKETS)):
                    total[0, at : at + size] += np.bincount(x, minlength=size)
                    total[1, at : at + size] += np.bincount(x[np.repeat(g, np.diff(f))], minlength=size)
        some = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[0][some]), pa.array(total[1][some])], ["bucket", "raw", "target"])

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    d = common.with_small(d, common.stored(trusted_ids(labels), "trusted").withColumn("good", F.lit(True)), "doc_id", "left")
    counts = d.select("text", F.coalesce("good", F.lit(False)).alias("good")).mapInArrow(count, "bucket int, raw long, target long")
    got = np.zeros((2, BUCKETS))
    for r in counts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect():
        got[:, r.bucket] = r.raw, r.target
    parts = []
    for raw, target, prior in ((got[0, :BYTE_BUCKETS], got[1, :BYTE_BUCKETS], PRIOR["bytes"]), (got[0, BYTE_BUCKETS:], got[1, BYTE_BUCKETS:], PRIOR["pairs"])):
        p = (raw + 1) / (raw.sum() + len(raw))
        parts.append(np.log((target + prior * p) / (target.sum() + prior) / p))
    return np.concatenate(parts)


def text_sums(texts: pa.Array, ratios: np.ndarray) -> np.ndarray:
    """By document: sum over trigrams, their number, sum over word pairs, their number."""
    out = [np.stack([sums(ratios[code], f3), np.diff(f3), sums(ratios[BYTE_BUCKETS + pair], f2), np.diff(f2)]) for code, f3, pair, f2 in grams(texts)]
    return np.concatenate(out, axis=1) if out else np.zeros((4, 0))


def normalised(s: np.ndarray) -> np.ndarray:
    return np.round(s[0] / (s[1] + PSEUDO_LENGTH) + s[2] / (s[3] + PSEUDO_LENGTH), 4) + 0.0


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, n_grams, score, keep) of every document: the log-likelihood ratio of its n-grams under the two multinomials, normalised by length; kept at threshold and above."""
    shared = docs.sparkSession.sparkContext.broadcast(log_ratios(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = text_sums(b.column(1), shared.value)
            score = normalised(s)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array((s[1] + s[3]).astype(np.int64)), pa.array(score), pa.array(score >= threshold)], ["doc_id", "n_grams", "score", "keep"])

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return d.mapInArrow(run, "doc_id long, n_grams long, score double, keep boolean")


def drop_bad(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs, all columns, without those that quality_scores rejects; no exchange, as each batch is filtered where it is scored."""
    shared = docs.sparkSession.sparkContext.broadcast(log_ratios(docs, labels))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(normalised(text_sums(b.column(at), shared.value)) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def uniform(column: Column, seed: int) -> Column:
    """A number above 0 and below 1 that depends on the column's text and seed alone."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(column.cast("string"), F.lit("")))), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)


def importance(docs: DataFrame, labels: DataFrame, share: float = SHARE, seed: int = SEED) -> DataFrame:
    """(doc_id, log_weight, sample_key, selected) of every document: the log ratio of the target's and the raw text's generative model, plus Gumbel noise that depends on doc_id and seed; the ceil(share * rows) highest keys, ties by doc_id, are the sample without replacement."""
    shared = docs.sparkSession.sparkContext.broadcast(log_ratios(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = text_sums(b.column(1), shared.value)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.round(s[0] + s[2], 4) + 0.0)], ["doc_id", "log_weight"])

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, log_weight double")
    d = d.withColumn("sample_key", F.round(F.col("log_weight") - F.log(-F.log(uniform(F.col("doc_id"), seed))), 6))
    d = common.stored(d, "weights")  # else the exchange by ranges would score all texts twice, once for its sample
    d = common.in_order(d.withColumn("last_first", -F.col("sample_key")), ["last_first", "doc_id"], "keys")
    k = F.ceil(F.lit(share) * d.count())
    return d.select("doc_id", "log_weight", "sample_key", (F.col("rank") < k).alias("selected"))


_MODEL_SQL = f"""
bytes AS (SELECT row_number() OVER () AS r, doc_id, text, list_transform(range(octet_length(encode(coalesce(text, '')))), lambda i: CAST('0x' || substr(hex(encode(text)), 2 * i + 1, 2) AS BIGINT)) AS b FROM documents),
words AS (SELECT r, list_transform(regexp_extract_all(coalesce(text, ''), '[^\\x00-\\x20]+'), lambda w: list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(range(octet_length(encode(w))), lambda i: CAST('0x' || substr(hex(encode(w)), 2 * i + 1, 2) AS BIGINT))), lambda a, x: (a * 257 + x) % 1048573)) AS h FROM bytes),
features AS (
  SELECT r, unnest(list_transform(range(1, len(b) - 1), lambda i: ((b[i] * 65536 + b[i + 1] * 256 + b[i + 2]) * 2654435761 % 4294967296) // 262144)) AS bucket FROM bytes
  UNION ALL
  SELECT r, unnest(list_transform(range(1, len(h)), lambda i: {BYTE_BUCKETS} + xor(h[i], h[i + 1]) % {PAIR_BUCKETS})) AS bucket FROM words),
good AS (SELECT doc_id FROM labels GROUP BY doc_id HAVING bool_and(coalesce(quality = 1 AND coalesce(toxic, 0) = 0, false))),
counts AS (SELECT bucket, bucket >= {BYTE_BUCKETS} AS pair, count(*) AS raw, count(g.doc_id) AS target FROM features JOIN bytes USING (r) LEFT JOIN good g ON g.doc_id = bytes.doc_id GROUP BY bucket),
totals AS (SELECT pair, CAST(sum(raw) AS DOUBLE) AS raws, CAST(sum(target) AS DOUBLE) AS targets, CASE WHEN pair THEN {PAIR_BUCKETS}.0::DOUBLE ELSE {BYTE_BUCKETS}.0::DOUBLE END AS size FROM counts GROUP BY pair),
probs AS (SELECT bucket, pair, target, targets, size, (raw + 1) / (raws + size) AS p FROM counts JOIN totals USING (pair)),
ratios AS (SELECT bucket, ln((target + size * p) / (targets + size) / p) AS ratio FROM probs),
scored AS (SELECT r, coalesce(sum(ratio) FILTER (bucket < {BYTE_BUCKETS}), 0) AS s3, count(*) FILTER (bucket < {BYTE_BUCKETS}) AS n3, coalesce(sum(ratio) FILTER (bucket >= {BYTE_BUCKETS}), 0) AS s2, count(*) FILTER (bucket >= {BYTE_BUCKETS}) AS n2 FROM features JOIN ratios USING (bucket) GROUP BY r),
every AS (SELECT doc_id, coalesce(s3, 0) AS s3, coalesce(n3, 0) AS n3, coalesce(s2, 0) AS s2, coalesce(n2, 0) AS n2 FROM bytes LEFT JOIN scored USING (r))
"""

QUALITY_SQL = f"""WITH {_MODEL_SQL},
final AS (SELECT doc_id, CAST(n3 + n2 AS BIGINT) AS n_grams, round(s3 / (n3 + {PSEUDO_LENGTH}) + s2 / (n2 + {PSEUDO_LENGTH}), 4) AS score FROM every)
SELECT doc_id, n_grams, score, score >= {THRESHOLD} AS keep FROM final"""

IMPORTANCE_SQL = f"""WITH {_MODEL_SQL},
weights AS (SELECT doc_id, round(s3 + s2, 4) AS log_weight, (CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT)::DOUBLE + 0.5) / {1 << 52}.0::DOUBLE AS u FROM every),
keys AS (SELECT doc_id, log_weight, round(log_weight - ln(-ln(u)), 6) AS sample_key FROM weights)
SELECT doc_id, log_weight, sample_key, row_number() OVER (ORDER BY sample_key DESC, doc_id) <= ceil({SHARE}::DOUBLE * count(*) OVER ()) AS selected FROM keys"""
