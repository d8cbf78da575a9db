"""The corpus pipeline against a direct computation of every stage."""

import base64

import pytest
import tiktoken

import corpus_pipeline
from findery.llm import byte_bpe

from .test_against_brute_force import dedup_brute, jaccard_brute, leaks_brute


@pytest.fixture(scope="module")
def kept(spark, sf, tmp_path_factory):
    """What each stage keeps, read back from Parquet."""
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stages") / str(i))
        stage(spark, docs, sf).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def test_stages_keep_the_columns(kept, spark, sf):
    columns = spark.read.parquet(f"{sf}/documents.parquet").columns
    assert all(sorted(d.columns) == sorted(columns) for d in kept[:-1])


def test_every_stage(kept, spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    languages, lined, single, clean, encoded = [{r.doc_id: r for r in d.collect()} for d in kept]
    assert len(languages) >= 0.95 * docs.count()
    rows = list(languages.values())
    assert {i: r.text for i, r in lined.items()} == dedup_brute(rows)
    assert all(r.n_chars == len(r.text) for i, r in lined.items() if r.text != languages[i].text)
    pairs = jaccard_brute({i: r.text for i, r in lined.items()})
    root = {i: i for i in lined}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    assert set(single) == {i for i in lined if find(i) == i}
    tests = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    leaked = leaks_brute({i: r.text for i, r in single.items()}, tests)
    # proximity may find more than phrases, never less
    assert leaked <= set(single) - set(clean) and len(set(single) - set(clean)) <= len(leaked) + 0.05 * len(single)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(byte_bpe.DEFAULT_VOCABULARY, "rb"))}
    own = tiktoken.Encoding("own", pat_str=byte_bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert set(encoded) == set(clean)
    for r in encoded.values():
        assert r.tokens == own.encode_ordinary(r.text) and r.round_trip


def test_run(kept, spark, sf):
    got = {r.doc_id: r.tokens for r in corpus_pipeline.run(spark, sf).collect()}
    assert got == {r.doc_id: r.tokens for r in kept[-1].collect()}


def test_stages_take_an_empty_table(spark, sf):
    none = spark.read.parquet(f"{sf}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, sf).count() == 0


def test_stages_take_nulls(spark, sf):
    some = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "the same words and the same words", "en", "s", 33)], spark.read.parquet(f"{sf}/documents.parquet").schema)
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, some, sf).collect()
