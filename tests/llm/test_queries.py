"""The queries over whole tables, beside versions in plain Python, and beside their SQL."""

import duckdb
import pytest

import __spark_entry__
from stratalens.llm import bpe
from tests.llm.brute import brute_groups, brute_languages, brute_private, brute_repeats

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet").toPandas()


def run(spark, name):
    return __spark_entry__.queries()[name](spark, FOLDER).collect()


@pytest.mark.parametrize("name", ["op2_quality_rules", "op5_sharding", "op6_importance_resampling", "op9_source_mixing"])
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    want = con.execute(__spark_entry__.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(str(tuple(r[n] for n in names)) for r in run(spark, name)) == sorted(map(str, want.fetchall()))


def test_op3(spark, docs):
    tiktoken = pytest.importorskip("tiktoken")
    ranks = bpe.read_ranks()
    e = tiktoken.Encoding("t", pat_str=r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+", mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r for r in run(spark, "op3_byte_bpe")}
    assert len(got) == len(docs)
    for i, t in zip(docs.doc_id, docs.text, strict=True):
        assert got[i].tokens == e.encode_ordinary(t) == bpe.encode_whole(t, ranks)
        assert got[i].round_trip and got[i].n_tokens == len(got[i].tokens)


def test_op4(spark, docs):
    want = brute_languages(list(zip(docs.doc_id, docs.text, docs.lang, strict=True)))
    assert sorted(map(tuple, run(spark, "op4_language_spans"))) == sorted(want)


def test_op7(spark, docs):
    got = {(r.doc_id, r.start_word, r.end_word, r.keep) for r in run(spark, "op7_suffix_array_dedup")}
    assert got == brute_repeats(list(zip(docs.doc_id, docs.text, strict=True)))


def test_op8(spark, docs):
    got = sorted((r.doc_id, r.kind, r.start, r.end, round(r.probability, 5)) for r in run(spark, "op8_pii_spans"))
    want = sorted(brute_private(list(zip(docs.doc_id, docs.text, strict=True))))
    assert [x[:4] for x in got] == [x[:4] for x in want]
    assert all(abs(a[4] - b[4]) < 1e-3 for a, b in zip(got, want, strict=True))


def test_op10(spark, docs):
    assert {r.doc_id: r.group_id for r in run(spark, "op10_minhash_near_dedup")} == brute_groups(docs)


def test_pipeline_runs_whole(spark):
    import corpus_pipeline

    rows = corpus_pipeline.run(spark, FOLDER).collect()
    assert len(rows) > 100 and all(r.round_trip for r in rows)
