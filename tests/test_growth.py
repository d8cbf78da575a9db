"""What must not grow faster than the tables: plans and results of the findings of round 3."""

import random

import pytest
from pyspark.sql import functions as F

from findery.functions import text
from findery.operators import fusion, grams, graph, history, index, metrics, rank, scan
from findery.plans import queries


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    words = ["alphaBeta", "gammas", "delta_eps", "HTTPServer2", "zetas", "running", "the", "x1", "classes", "error", "IOErrors"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 9)))) for i in range(300)]
    rows += [(1000 + i, t) for i, t in rows[:40]] + [(7, "gammas zetas"), (2000, None), (2001, "")]
    return spark.createDataFrame(rows, "doc long, text string").repartition(5).cache()


def joined(docs):
    """Postings by their definition, as columns."""
    words = docs.select("doc", F.posexplode(text.identifiers(F.col("text"))).alias("at", "word"))
    terms = words.select("doc", "at", F.posexplode(text.identifier_terms(F.col("word"))).alias("part", "term"))
    return terms.groupBy("doc", "term").agg(F.count("*").alias("tf"), F.min(F.col("at") * 64 + F.col("part")).alias("first_pos"))


def test_postings_are_those_of_the_columns(docs):
    got = index.postings(docs).select("doc", "term", "tf", "first_pos").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, joined(docs).collect()))
    once = docs.where("doc <> 7")
    assert sorted(map(tuple, index.term_counts(once).where("term IS NOT NULL").collect())) == sorted(map(tuple, joined(once).groupBy("term").agg(F.count("*"), F.sum("tf")).collect()))
    assert {r["df"] for r in index.term_counts(docs).where("term IS NULL").collect()} == {joined(docs).select("doc").distinct().count()}


@pytest.mark.parametrize("name", ["term_df", "idf_table", "term_coverage", "replaced_postings"])
def test_no_document_is_shuffled_for_its_terms(name, spark, sf):
    assert "hashpartitioning(doc" not in plan(queries.QUERIES[name](spark, sf))


@pytest.fixture(scope="module")
def terms(spark):
    rng = random.Random(5)
    asked = [(f"q{i}", p, t) for i in range(300) for p, t in enumerate(rng.sample(["alphabeta", "alpha", "gamma", "delta_ep", "http", "server", "zeta", "runn", "none"], 4))]
    return spark.createDataFrame(asked, "query_id string, term_pos int, term string")


@pytest.mark.parametrize("times", [False, True])
def test_best_are_the_best_of_all(docs, terms, spark, times):
    body = index.postings(docs).cache()
    prior = docs.select("doc", F.when(F.col("doc") % 3 == 0, 0.3).otherwise(1.0).alias("prior")).distinct()
    known = prior.select("doc", F.col("doc").alias("ord"), "prior") if times else None
    want = rank.top_picks(rank.normalize(rank.bm25(terms, body, index.lengths(body), known)))
    given = docs.join(prior, "doc")
    found = rank.best_bm25(terms, index.vectors(given, index.term_numbers(terms)), prior="prior" if times else None)
    got = rank.top_picks(rank.normalize(found))
    exact = lambda df: sorted((r.query_id, r["rank"], r.doc, round(r.score, 12)) for r in df.collect())  # noqa: E731  (logarithms of Python and Java differ in the last bit)
    assert exact(got) == exact(want)
    assert found.groupBy("query_id", F.spark_partition_id()).count().agg(F.max("count")).first()[0] <= 10


def test_nearest_by_rounded_cosine(docs, terms):
    asked = terms.select("query_id", "term", (F.col("term_pos") + 1).cast("long").alias("tf"))
    top = lambda df: rank.ranked(df.withColumn("cosine", F.round("cosine", 6)), "cosine", "doc").where("rank <= 5")
    want = top(rank.tf_cosine(asked, index.postings(docs)))
    got = top(rank.best_cosine(asked, index.vectors(docs, index.term_numbers(asked)), 5))
    exact = lambda df: sorted((r.query_id, r["rank"], r.doc, r.cosine) for r in df.collect())
    assert exact(got) == exact(want)


def test_candidates_are_scored_where_they_are_read(spark, sf):
    assert "Exchange" not in plan(queries.QUERIES["candidate_bm25"](spark, sf))


def test_stored_and_read_vectors_agree(docs, terms):
    numbers = index.term_numbers(terms)
    read, stored = index.vectors(docs.where("doc <> 7"), numbers), index.posted_vectors(index.postings(docs.where("doc <> 7")), numbers)
    columns = ["doc", "n_terms", "squares", "t", "tf"]
    assert sorted(map(tuple, read.rows.select(columns).collect()), key=str) == sorted(map(tuple, stored.rows.select(columns).collect()), key=str)
    assert scan.frequencies(read.rows).count() > 3


def test_grams_are_those_of_the_columns(spark):
    rng = random.Random(7)
    some = lambda letters: "".join(rng.choices(letters, k=rng.randint(0, 30)))
    wide = "abñ\n\U0001f600"
    asked = spark.createDataFrame([(f"q{i}", some(wide)) for i in range(270)], "query_id string, text string")
    docs = spark.createDataFrame([(i, some(wide + "xy")) for i in range(60)] + [(99, None)], "doc long, text string")
    share = text.gram_overlap(F.col("a"), F.col("text"))
    want = asked.withColumnRenamed("text", "a").crossJoin(docs).select("query_id", "doc", share.alias("overlap")).where("overlap > 0")
    exact = lambda df: sorted(map(tuple, df.collect()))
    assert exact(rank.gram_overlap(asked, docs)) == exact(want)
    assert exact(rank.gram_overlap(asked, docs, least=0.5)) == exact(want.where("overlap >= 0.5"))
    many = "".join(chr(0x4E00 + i) for i in range(4200))
    block = grams._Questions(0, [many], 5)
    assert not block.packs and len(block.found("x" + many[7:20])) == 8
    assert "hashpartitioning" not in plan(rank.gram_overlap(asked, docs))


def test_shingles_meet_as_digests(spark, sf):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["a b  c d e f", "x a b c d e", "b\tc d\x0be f", None, "", "a b c d", "a b c d e a b c d e"])], "doc long, text string")
    rows = docs.where("text IS NOT NULL").select("doc", F.explode(F.array_distinct(text.shingles(F.col("text")))).alias("s"))
    want = rows.groupBy(F.md5("s").alias("shingle")).agg(F.count("*").alias("n_docs")).where("n_docs > 1")
    assert sorted(map(tuple, grams.shared_shingles(docs).collect())) == sorted(map(tuple, want.collect())) != []
    assert "shingle" not in plan(queries.QUERIES["shared_shingles"](spark, sf)).split("Exchange")[-1]


def test_spans_are_counted_uncut(spark, sf):
    rng = random.Random(9)
    made = [[(rng.randint(1, 8), rng.choice("xy"), a := rng.randint(1, 40), a + rng.randint(0, 9)) for _ in range(n)] for n in (30, 40)]
    gold, spans = (spark.createDataFrame(rows, "instance_id int, path string, a int, b int") for rows in made)
    cut = [{(i, p, line) for i, p, a, b in rows for line in range(a, b + 1)} for rows in made]
    got = {r.instance_id: (r.n_lines, r.n_covered, r.all_files) for r in metrics.line_coverage(gold, spans).collect()}
    files = {(i, p) for i, p, _ in cut[1]}
    assert got == {i: (sum(x[0] == i for x in cut[0]), sum(x[0] == i for x in cut[0] & cut[1]), all(x[:2] in files for x in cut[0] if x[0] == i)) for i in {x[0] for x in cut[0]}}
    r = metrics.region_precision(gold, spans).first()
    assert (r.n_gold, r.n_returned, r.precision) == (len(cut[0] & cut[1]), len(cut[1]), len(cut[0] & cut[1]) / len(cut[1]))
    for name in ("line_coverage", "region_precision"):
        assert "explode" not in plan(queries.QUERIES[name](spark, sf))


def test_a_large_folder_is_many_blocks(spark):
    files = [f"{d}/{i}" for d, n in (("a", 40), ("b", 2), ("c", 1)) for i in range(n)]
    df = graph.same_folder(spark.createDataFrame([(f,) for f in files], "path string"), block=5)
    assert sorted(map(tuple, df.collect())) == sorted((a, b) for a in files for b in files if a != b and a[0] == b[0])
    assert df.groupBy(F.spark_partition_id()).count().count() > 10


def test_a_walk_has_the_tasks_its_fan_out_needs(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(graph, "tasks_for", lambda df, rows: seen.append(rows) or index.tasks_for(df, rows, 50))
    edges = [(a, b) for a in range(40) for b in range(40) if a != b] + [(0, 99)]
    got = graph.pagerank(spark.createDataFrame([(1, 0, 1.0), (1, 77, 1.0)], "query_id int, node int, w double"), spark.createDataFrame(edges, "src int, dst int"), rounds=2)
    out = {}
    for a, b in edges:
        out.setdefault(a, []).append(b)
    want = {0: 0.5, 77: 0.5}
    for _ in range(2):
        new = {0: 0.15 * 0.5, 77: 0.15 * 0.5}
        for node, w in want.items():
            for to in out.get(node, [node]):
                new[to] = new.get(to, 0.0) + 0.85 * w / len(out.get(node, [node]))
        want = new
    assert {r.node: r.w for r in got.collect()} == pytest.approx(want)
    # half of the edges, then all that the 42 nodes of the first step take
    assert seen[0] == len(edges) / 2 and seen[1] == len(edges) + 2


def test_a_neighbourhood_reads_edges_once_a_hop(spark):
    rows = spark.createDataFrame([(1, "a", 3), (1, "b", 3), (1, "c", 3), (2, "a", 2), (2, "b", 2), (3, "x", 21)], "seq int, path string, n_files int")
    edges = history.cochange_edges(rows)
    assert sorted(map(tuple, edges.collect())) == sorted([(x, y) for x in "abc" for y in "abc" if x != y] + [("a", "b"), ("b", "a")])
    seeds = spark.createDataFrame([(1, "c", 1.0)], "query_id int, doc string, score double")
    assert {tuple(r) for r in fusion.neighbourhood(seeds, edges, cap=2).collect()} == {(1, "c", 0), (1, "a", 1)}
