"""Nulls, empty and long texts, repeats, empty tables and clashing names: every operator."""

import time

import pytest

from findery.llm import ann, byte_bpe, decontamination, html_extract, language_id, license_scan, line_dedup, lm_scoring, ngram_jaccard, toxicity

SCHEMA = "doc_id long, text string, id string, unit long, term string, h int, h2 struct<x:int>, `odd.name` int, k_id string, shard int, gone int"
LONG = "long words of a very long text go on " * 20_000


def _row(i, text):
    return (i, text, "x", 1, "t", 2, (3,), 4, "k", 5, 6)


@pytest.fixture(scope="module")
def docs(spark):
    texts = [(1, "alpha beta gamma delta epsilon zeta\nsecond line"), (1, "alpha beta gamma delta epsilon zeta\nsecond line"), (2, None), (3, ""), (4, "  \n\n "), (5, LONG), (None, "alpha beta gamma delta epsilon zeta\nother"), (6, "!!! ..."), (7, "one"), (8, "one")]
    return spark.createDataFrame([_row(i, t) for i, t in texts], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labelled(spark):
    rows = [(i, "der hund und die katze laufen schnell" if i % 2 else "the dog and the cat run fast", "de" if i % 2 else "en", i % 2) for i in range(8)]
    return spark.createDataFrame([*rows, (None, None, "en", None), (9, "", None, 1)], "doc_id long, text string, lang string, toxic int")


def test_line_dedup(docs, none):
    out = line_dedup.dedup_lines(docs, dropped_col="n").collect()
    by = {}
    for r in out:
        by.setdefault(r.doc_id, []).append((r.text, r.n))
    # rows with the same id and text are one document; the null id comes last
    assert by[1] == [("alpha beta gamma delta epsilon zeta\nsecond line", 0)] * 2
    assert by[None] == [("other", 1)]
    assert by[2] == [(None, 0)] and by[3] == [("", 0)] and by[4] == [("  \n\n ", 0)]
    assert by[7] == [("one", 0)] and by[8] == [("", 1)]
    assert by[5] == [(LONG, 0)]
    assert line_dedup.dedup_lines(docs).columns == docs.columns
    assert line_dedup.dedup_lines(none, dropped_col="n").count() == 0
    clash = line_dedup.dedup_lines(docs, length_col="h", dropped_col="GONE")
    assert clash.columns == [*docs.columns, "_GONE"]
    # the length is set only where lines went
    assert {(r.doc_id, r.h) for r in clash.collect() if r.doc_id in (5, 8, None)} == {(5, 2), (8, 0), (None, 5)}
    # with many buckets the result is the same
    again = line_dedup.dedup_lines(docs, dropped_col="n", bucket_lines=3).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.text or "", r.n)
    assert sorted(map(key, out)) == sorted(map(key, again))


def test_language_id(docs, none, labelled, spark):
    model = language_id.fit(labelled)
    assert model.languages == ["de", "en"]
    got = {r.doc_id: (r.pred_lang, r.n_words) for r in language_id.identify(docs, model).collect()}
    assert got[2] == got[3] == got[4] == got[6] == (None, 0)
    assert language_id.keep_identified(docs, model).columns == docs.columns
    assert language_id.identify(none, model).count() == 0
    empty = language_id.fit(labelled.where("false"))
    assert {r.pred_lang for r in language_id.identify(docs, empty).collect()} == {None}
    clash = docs.withColumnRenamed("h", "Pred_Lang").withColumnRenamed("gone", "confidence")
    out = language_id.identify(clash, model)
    assert out.columns == [*clash.columns, "_pred_lang", "_confidence", "n_words"] and out.count() == docs.count()
    # the very long text is English words in part; equal scores go to the first language
    tied = spark.createDataFrame([(1, "katze cat"), (2, "katze cat"), (3, "cat katze")], "doc_id long, text string")
    even = language_id.fit(spark.createDataFrame([(1, "katze cat", "de"), (2, "katze cat", "en")], "doc_id long, text string, lang string"))
    assert {r.pred_lang for r in language_id.identify(tied, even).collect()} == {"de"}


def test_lm_scoring(docs, none):
    got = {}
    for r in lm_scoring.score(docs, classes=4, min_count=2, sweeps=1).collect():
        got.setdefault(r.id, []).append((r.n_tokens, r.log_prob, r.perplexity))
    assert got[2] == [(None, None, None)] and got[3] == got[4] == got[6] == [(0, 0.0, None)]
    assert got[1][0] == got[1][1] and got[1][0][0] == 8 and got[5][0][0] == 180_000
    assert got[7] == got[8]
    assert lm_scoring.score(none, classes=4).count() == 0


def test_decontamination(docs, none, spark):
    tests = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta"), (2, None), (3, ""), (4, "one"), (None, "Alpha, beta; gamma delta epsilon!"), (1, "alpha beta gamma delta epsilon zeta")], "item_id long, text string")
    found = {(r.id, r.test, r.kind) for r in decontamination.find(decontamination.build_index(docs), tests).collect()}
    assert found == {(1, 1, "phrase"), (None, 1, "phrase"), (1, None, "phrase"), (None, None, "phrase")}
    kept = decontamination.decontaminate(docs, tests)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 4, 5, 6, 7, 8]
    assert decontamination.decontaminate(none, tests).count() == 0
    assert decontamination.decontaminate(docs, tests.where("false")).count() == docs.count()


def test_byte_bpe(docs, none, spark):
    vocabulary = byte_bpe.load()
    rows = byte_bpe.encode(docs, vocabulary, check_out="ok").collect()
    by = {r.doc_id: r for r in rows}
    assert by[2].tokens is None and by[2].n_tokens is None and by[2].ok is None
    assert by[3].tokens == [] and by[3].n_tokens == 0 and all(r.ok for r in rows if r.text is not None)
    back = byte_bpe.decode(byte_bpe.encode(docs, vocabulary), vocabulary)
    assert all(r.decoded == r.text for r in back.collect())
    assert byte_bpe.encode(none, vocabulary).count() == 0
    clash = docs.withColumnRenamed("h", "Tokens").withColumnRenamed("gone", "decoded")
    encoded = byte_bpe.encode(clash, vocabulary)
    assert encoded.columns == [*clash.columns, "_tokens", "n_tokens"]
    back = byte_bpe.decode(encoded, vocabulary, "_tokens")
    assert back.columns == [*encoded.columns, "_decoded"] and all(r._decoded == r.text for r in back.collect())
    odd = spark.createDataFrame([([None, 0, -1, 10**9],), (None,), ([],)], "tokens array<int>")
    first = vocabulary.tokens[0].decode("utf-8", "replace")
    assert [r.decoded for r in byte_bpe.decode(odd, vocabulary).collect()] == ["\ufffd" + first + "\ufffd\ufffd", None, ""]


def test_license_scan(docs, none, spark):
    templates = spark.createDataFrame([("t", "alpha beta gamma delta epsilon zeta"), ("u", None), (None, "alpha"), ("v", ""), ("w", "one")], "template string, body string")
    found = [(r.id, r.template, r.start, r.end, r.coverage) for r in license_scan.scan(docs, templates).collect()]
    assert sorted(found, key=str) == sorted([(1, "t", 0, 6, 1.0), (None, "t", 0, 6, 1.0)], key=str)
    assert license_scan.scan(none, templates).count() == 0
    assert license_scan.scan(docs, templates.where("false")).count() == 0


def test_toxicity(docs, none, labelled, spark):
    index = toxicity.build(labelled, labelled)
    got = {r.id: (r.score, r.evidence) for r in toxicity.classify(docs, index).collect()}
    assert got[2] == got[3] == got[4] == (index.base_rate, [])
    assert toxicity.classify(none, index).count() == 0
    bare = toxicity.build(none, labelled.where("false"))
    assert {r.score for r in toxicity.classify(docs, bare).collect()} == {0.0}


def test_ann(spark):
    nan = float("nan")
    rows = [(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 2), (2, [0.0, 1.0], 1), (3, None, 1), (4, [], 1), (5, [1.0, nan], 1), (None, [1.0, 1.0], 1), (6, [0.0, 0.0], 1), (7, [1.0], 1), (8, [1.0, 0.0], 1)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, id int")
    got = {}
    for r in ann.neighbours(vectors).orderBy("query", "rank").collect():
        got.setdefault(r.query, []).append(r.id)
    assert got == {1: [8, 6, 2], 2: [6, 1, 8], 6: [1, 2, 8], 8: [1, 6, 2]}
    assert ann.neighbours(vectors.where("false")).count() == 0
    assert ann.neighbours(vectors.where("vec_id = 2")).count() == 0


def test_ngram_jaccard(docs, none):
    rows = ngram_jaccard.similar_pairs(docs).collect()
    assert [(r.doc_a, r.doc_b, r.jaccard) for r in rows] == [(7, 8, 1.0)]
    got = {r.id: (r.class_id, r.n_links) for r in ngram_jaccard.classes(docs.unionByName(docs.where("doc_id = 7").selectExpr("2L AS doc_id", *[f"`{c}`" for c in docs.columns[1:]]))).collect()}
    # 2 has a null text and the text of 7 and 8; rows without an id have no row
    assert got == {1: (1, 0), 2: (2, 2), 3: (3, 0), 4: (4, 0), 5: (5, 0), 6: (6, 0), 7: (2, 2), 8: (2, 2)}
    kept = ngram_jaccard.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 1, 2, 3, 4, 5, 6, 7]
    assert ngram_jaccard.similar_pairs(none).count() == 0 and ngram_jaccard.classes(none).count() == 0 and ngram_jaccard.keep_one(none).count() == 0


def test_html_extract(spark):
    pages = spark.createDataFrame([(1, None), (2, ""), (3, "<html><body></body></html>"), (4, "<p>broken <b>markup"), (4, "<p>broken <b>markup"), (5, "<div>" * 3000 + "deep" + "</div>" * 3000)], "page_id long, html string")
    got = {r.page_id: r.content for r in html_extract.extract(pages).collect()}
    assert got == {1: None, 2: "", 3: "", 4: "broken markup", 5: "deep"}
    assert html_extract.extract(pages.where("false")).count() == 0
    clash = html_extract.extract(pages.withColumnRenamed("page_id", "Content"))
    assert clash.columns == ["Content", "html", "_content", "content_tag", "density_sum"] and clash.count() == 6


@pytest.mark.parametrize(
    ("page", "content"),
    [
        ("<html><head><title>t</title><p>Hello world", "Hello world"),
        ("<title>t</title>Bare text<p>more", "Bare text\nmore"),
        ("<head><script>if (a < b) x()</script><style>p > a {}</style><body><p>one two three", "one two three"),
        ("<p x='a>b'>kept</p>", "kept"),
        ("<p x=\">an odd quote</p>", "an odd quote"),
        ("a < b and c > d", "a < b and c > d"),
        ("<p>cut off <a hr", "cut off"),
    ],
)
def test_html_markup_that_browsers_take(page, content):
    assert html_extract.extract_one(page)[0] == content


@pytest.mark.parametrize("part", ["<a ", "<a \"", "<a =\"", "<p =\"x>", "<p><b>", "</p><b>", "<!-", "<script>", "<a ='\">", "</div><p>"])
def test_html_time_grows_with_the_length(part):
    began = time.perf_counter()
    html_extract.extract_one("<p><div>" + part * 20_000)
    assert time.perf_counter() - began < 10
