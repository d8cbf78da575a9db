"""The engine's operators on the shared tables, each with its equivalent in SQL.

Documents stand for files, benchmark texts for questions, orders for commits and
parts for the files in them, conversations for messages and for the turns of runs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from findery.functions import text
from findery.operators import fusion, graph, grams, history, index, lines, metrics, pack, rank, scan
from findery.sources import corpus
from findery.sources.corpus import describe

from . import retrieval

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- SQL building blocks

_STOP_LIST = ", ".join(f"'{w}'" for w in text.STOP_WORDS)


def _stem(x: str) -> str:
    for pattern, to in text.STEM_RULES:
        x = f"regexp_replace({x}, '{pattern}', '{to.replace('$1', chr(92) + '1').replace('$2', chr(92) + '2')}')"
    return x


def _counts(x: str) -> str:
    return f"(length({x}) > 2 AND {x} NOT IN ({_STOP_LIST}))"


def _parts(w: str) -> str:
    marked = w
    for _ in range(2):
        marked = rf"regexp_replace({marked}, '([A-Z]+)([A-Z][a-z])', '\1_\2', 'g')"
    found = f"list_transform(regexp_extract_all({marked}, '[A-Z]?[a-z]+|[A-Z]+|[0-9]+'), lambda p: lower(p))"
    return f"list_transform(list_filter({found}, lambda p: {_counts('p')}), lambda p: {_stem('p')})"


def _postings(table: str, key: str, name: str, body: str = "text") -> str:
    """CTEs that end in ``name``(doc, term, tf, first_pos)."""
    return f"""
{name}_l AS (SELECT {key} AS doc, regexp_extract_all({body}, '{text.IDENTIFIER}') AS l FROM {table}),
{name}_w AS (SELECT doc, unnest(l) AS w, unnest(range(len(l))) AS pos FROM {name}_l),
{name}_d AS (SELECT w, {_stem('lower(w)')} AS s, {_counts('lower(w)')} AS whole, {_parts('w')} AS parts FROM (SELECT DISTINCT w FROM {name}_w)),
{name}_t AS (SELECT w, list_concat(CASE WHEN whole THEN [s] ELSE [] END, CASE WHEN len(parts) > 1 OR (len(parts) = 1 AND parts[1] <> s) THEN parts ELSE [] END) AS t FROM {name}_d),
{name}_o AS (SELECT doc, pos, unnest(t) AS term, unnest(range(len(t))) AS part FROM {name}_w JOIN {name}_t USING (w)),
{name} AS (SELECT doc, term, count(*) AS tf, min(pos * 64 + part) AS first_pos FROM {name}_o GROUP BY doc, term)"""


_QUESTIONS = _postings("benchmark", "item_id", "q") + f""",
terms AS (SELECT doc AS query_id, term, row_number() OVER (PARTITION BY doc ORDER BY first_pos) - 1 AS term_pos FROM q WHERE {_counts('term')})"""


def _bm25(postings: str, name: str, b: float = 0.75, terms: str = "terms") -> str:
    """CTEs that end in ``name``(query_id, doc, score, first)."""
    return f"""
{name}_n AS (SELECT doc, sum(tf) AS n FROM {postings} GROUP BY doc),
{name}_s AS (SELECT count(*) AS n_docs, avg(n) AS avg_len FROM {name}_n),
{name}_f AS (SELECT term, count(*) AS df FROM {postings} GROUP BY term),
{name}_c AS (
  SELECT query_id, doc, term_pos, ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - {b} + {b} * n / avg_len)) AS c
  FROM {terms} JOIN {name}_f USING (term) JOIN {postings} USING (term) JOIN {name}_n USING (doc), {name}_s
),
{name} AS (SELECT query_id, doc, sum(c ORDER BY term_pos) AS score, min(term_pos) AS first FROM {name}_c GROUP BY query_id, doc)"""


_PICKS = """
norm AS (SELECT query_id, doc, score / max(score) OVER (PARTITION BY query_id) AS score, first FROM bm),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first, doc) AS rank FROM norm),
picks AS (SELECT query_id, doc, score, rank FROM ranked WHERE rank <= 10 AND (rank <= 3 OR score >= 0.05))"""


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text")


def _scores(spark: SparkSession, sf_dir: str, most: int = 10) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Questions' terms, the corpus' (term, df) of them, and the scores of at least the
    ``most`` best documents of each."""
    terms = index.settled(rank.query_terms(_questions(spark, sf_dir)))
    found = index.vectors(_documents(spark, sf_dir), index.term_numbers(terms))
    counted = index.settled(scan.frequencies(found.rows))
    return terms, counted, rank.best_bm25(terms, found, most, counted=counted)


def _picks(scores: DataFrame) -> DataFrame:
    # some ten rows a question, read several times
    return index.settled(rank.top_picks(rank.normalize(scores)))


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = index.postings(_questions(spark, sf_dir).select(F.col("query_id").alias("doc"), F.col("question").alias("text")))
    return index.settled(asked.select(F.col("doc").alias("query_id"), "term", "tf"))


def _near(spark: SparkSession, sf_dir: str, most: int) -> DataFrame:
    asked = _asked(spark, sf_dir)
    found = rank.best_cosine(asked, index.vectors(_documents(spark, sf_dir), index.term_numbers(asked)), most)
    return rank.ranked(found.withColumn("cosine", F.round("cosine", 6)), "cosine", "doc").where(F.col("rank") <= most)


# ---- terms and ranking


@query(f"WITH {_postings('documents', 'doc_id', 'p')} SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS tf FROM p GROUP BY term")
def term_df(spark, sf_dir):
    return index.term_counts(_documents(spark, sf_dir)).where("term IS NOT NULL")


@query(f"WITH {_postings('documents', 'doc_id', 'p')}, n AS (SELECT count(DISTINCT doc) AS n FROM p) SELECT term, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf FROM (SELECT term, count(*) AS df FROM p GROUP BY term), n")
def idf_table(spark, sf_dir):
    counts = index.settled(index.term_counts(_documents(spark, sf_dir)))
    total = counts.where("term IS NULL").select(F.col("df").alias("n_docs"))
    stats = counts.where("term IS NOT NULL").crossJoin(F.broadcast(total))
    return stats.select("term", F.round(index.idf(F.col("n_docs"), F.col("df")), 6).alias("idf"))


@query(f"WITH {_postings('documents', 'doc_id', 'p')}, {_QUESTIONS}, {_bm25('p', 'bm')}, {_PICKS} SELECT query_id, doc AS doc_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM picks")
def bm25_topk(spark, sf_dir):
    _, _, scores = _scores(spark, sf_dir)
    return rank.top_picks(rank.normalize(scores)).select("query_id", F.col("doc").alias("doc_id"), "rank", F.round("score", 6).alias("score"))


_PRIOR = f"CASE WHEN regexp_matches(CASE WHEN lang = 'en' THEN 'src/' ELSE 'docs/' END || source, '{text.TEST_LIKE}') THEN 0.3 ELSE 1.0 END"


@query(f"""WITH {_postings('documents', 'doc_id', 'p')}, {_QUESTIONS}, {_bm25('p', 'raw')},
bm AS (SELECT query_id, doc, score * {_PRIOR} AS score, first FROM raw JOIN documents ON doc_id = doc), {_PICKS}
SELECT query_id, doc AS doc_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM picks""")
def bm25_prior_by_source(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    path = F.concat(F.when(F.col("lang") == "en", "src/").otherwise("docs/"), "source")
    known = docs.select(F.col("doc_id").alias("doc"), "text", text.path_prior(path).alias("prior"))
    terms = index.settled(rank.query_terms(_questions(spark, sf_dir)))
    scores = rank.best_bm25(terms, index.vectors(known, index.term_numbers(terms)), prior="prior")
    return rank.top_picks(rank.normalize(scores)).select("query_id", F.col("doc").alias("doc_id"), "rank", F.round("score", 6).alias("score"))


_MESSAGES = "msgs AS (SELECT conv_id, substring(string_agg(text, chr(10) ORDER BY turn), 1, 40000) AS text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations) WHERE r <= 25 GROUP BY conv_id)"


def _messages(spark, sf_dir) -> DataFrame:
    said = _table(spark, sf_dir, "conversations")
    seq = F.col("conv_id") * 100_000 + F.col("turn")
    rows = said.select(seq.alias("seq"), F.col("conv_id").alias("path"))
    return history.file_messages(rows, said.select(seq.alias("seq"), F.col("text").alias("message")))


@query(f"WITH {_MESSAGES} SELECT conv_id, text AS message FROM msgs")
def newest_messages(spark, sf_dir):
    return _messages(spark, sf_dir).select(F.col("path").alias("conv_id"), "message")


@query(f"WITH {_MESSAGES}, {_postings('msgs', 'conv_id', 'p')}, {_QUESTIONS}, {_bm25('p', 'bm', 0.5)}, {_PICKS} SELECT query_id, doc AS conv_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM picks")
def message_bm25(spark, sf_dir):
    said = _messages(spark, sf_dir).select(F.col("path").alias("doc"), F.col("message").alias("text"))
    terms = index.settled(rank.query_terms(_questions(spark, sf_dir)))
    scores = rank.best_bm25(terms, index.vectors(said, index.term_numbers(terms), unique=True), b=0.5)
    return rank.top_picks(rank.normalize(scores)).select("query_id", F.col("doc").alias("conv_id"), "rank", F.round("score", 6).alias("score"))


_FEEDBACK = """
fed AS (SELECT query_id, doc FROM picks WHERE rank <= 3),
fed_t AS (
  SELECT query_id, doc, p.term, tf * ln(1 + n_docs / (df + 1)) AS w, first_pos
  FROM fed JOIN p USING (doc) JOIN bm_f USING (term), bm_s WHERE NOT EXISTS (SELECT 1 FROM terms t WHERE t.query_id = fed.query_id AND t.term = p.term)
),
fed_r AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc ORDER BY round(w, 9) DESC, first_pos) AS r FROM fed_t),
more AS (SELECT query_id, term, row_number() OVER (PARTITION BY query_id ORDER BY term) - 1 AS term_pos FROM (SELECT DISTINCT query_id, term FROM fed_r WHERE r <= 20))"""


@query(f"WITH {_postings('documents', 'doc_id', 'p')}, {_QUESTIONS}, {_bm25('p', 'bm')}, {_PICKS}, {_FEEDBACK} SELECT query_id, CAST(term_pos AS INTEGER) AS term_pos, term FROM more")
def feedback_terms(spark, sf_dir):
    terms, counted, scores = _scores(spark, sf_dir)
    picks, docs = _picks(scores), _documents(spark, sf_dir)
    chosen = index.postings(docs.join(index.sized_broadcast(picks.select("doc").distinct(), 32), "doc", "left_semi"))
    n_docs = counted.where("t = -1").first()
    return rank.feedback_terms(picks, chosen, terms, n_docs["n"] if n_docs else 0, counts=index.term_counts(docs).where("term IS NOT NULL"))


@query(f"WITH {_postings('documents', 'doc_id', 'p')}, {_QUESTIONS}, v AS (SELECT DISTINCT term FROM p) SELECT query_id, count(v.term) AS matched, count(*) AS total, count(v.term) = 0 AS zero_match FROM terms LEFT JOIN v USING (term) GROUP BY query_id")
def term_coverage(spark, sf_dir):
    terms = rank.query_terms(_questions(spark, sf_dir))
    return index.coverage(terms, index.term_counts(_documents(spark, sf_dir)).where("term IS NOT NULL"))


@query(f"""WITH {_postings('documents', 'doc_id', 'p')}, {_postings('benchmark', 'item_id', 'b')},
na AS (SELECT doc AS query_id, sqrt(sum(tf * tf)) AS na FROM b GROUP BY doc), nb AS (SELECT doc, sqrt(sum(tf * tf)) AS nb FROM p GROUP BY doc),
d AS (SELECT b.doc AS query_id, p.doc AS doc, sum(b.tf * p.tf) AS dot FROM b JOIN p USING (term) GROUP BY b.doc, p.doc),
c AS (SELECT query_id, doc, round(dot / (na * nb), 6) AS cosine FROM d JOIN na USING (query_id) JOIN nb USING (doc)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, doc) AS rank FROM c)
SELECT query_id, doc AS doc_id, cosine, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5""")
def tf_cosine(spark, sf_dir):
    return _near(spark, sf_dir, 5).select("query_id", F.col("doc").alias("doc_id"), "cosine", "rank")


@query("""WITH g AS (SELECT item_id, list_distinct([substring(text, i, 5) for i in range(1, length(text) - 4)]) AS g FROM benchmark),
a AS (SELECT item_id, greatest(len(g), 1) AS n, unnest(g) AS gram FROM g),
b AS (SELECT doc_id, unnest(list_distinct([substring(text, i, 5) for i in range(1, length(text) - 4)])) AS gram FROM documents),
c AS (SELECT item_id, doc_id, count(*) / any_value(n) AS overlap FROM a JOIN b USING (gram) GROUP BY item_id, doc_id)
SELECT item_id AS query_id, doc_id, round(overlap, 6) AS overlap FROM c WHERE overlap >= 0.5""")
def gram_overlap(spark, sf_dir):
    asked = _questions(spark, sf_dir).select("query_id", F.col("question").alias("text"))
    found = rank.gram_overlap(asked, _documents(spark, sf_dir), least=0.5)
    return found.select("query_id", F.col("doc").alias("doc_id"), F.round("overlap", 6).alias("overlap"))


@query(f"""WITH s AS (SELECT page_id, unnest(list_filter(regexp_split_to_array(url, '[/{chr(92) * 2}.-]'), lambda x: x <> '')) AS v FROM pages)
SELECT DISTINCT page_id, term FROM (SELECT page_id, {_stem('lower(v)')} AS term FROM s UNION ALL SELECT page_id, unnest({_parts('v')}) FROM s)""")
def path_tokens_urls(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", F.explode(text.path_tokens(F.col("url"))).alias("term"))


@query("""WITH m AS (SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding) AS x FROM embeddings), c AS (SELECT label, i, avg(CAST(x AS DOUBLE)) AS x FROM m GROUP BY label, i),
v AS (SELECT vec_id, generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
d AS (SELECT c.label AS query_id, vec_id, sum(c.x * v.x) AS score FROM c JOIN v USING (i) GROUP BY c.label, vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM d)
SELECT query_id, vec_id, round(score, 5) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 12""")
def vector_topk(spark, sf_dir):
    vectors = _table(spark, sf_dir, "embeddings")
    at = vectors.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    centres = at.groupBy(F.col("label").alias("query_id")).agg(F.array_sort(F.collect_list(F.struct("i", "x")))["x"].alias("q"))
    found = rank.vector_top_k(centres, vectors.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")))
    return found.select("query_id", F.col("id").alias("vec_id"), F.round("score", 5).alias("score"), "rank")


# ---- history and graphs

_PAIRS = """
t AS (SELECT DISTINCT l_orderkey AS seq, l_partkey AS path FROM lineitem),
s AS (SELECT seq FROM t GROUP BY seq HAVING count(*) <= 20),
pairs AS (SELECT a.path AS path, b.path AS other, count(*) AS n, min(a.seq) AS first_seq FROM t a JOIN t b ON a.seq = b.seq AND a.path <> b.path JOIN s ON s.seq = a.seq GROUP BY a.path, b.path)"""


def _touched(spark, sf_dir) -> DataFrame:
    items = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("seq"), F.col("l_partkey").alias("part"))
    commits = items.repartition(index.tasks_for(items, items.count()), "seq").groupBy("seq").agg(F.collect_set("part").alias("files"))
    return history.touched(commits, code_only=False)


def _pairs(spark, sf_dir) -> DataFrame:
    return history.cochange_counts(_touched(spark, sf_dir))


@query(f"""WITH {_PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY n DESC, first_seq, other) AS rank FROM pairs WHERE n >= 2)
SELECT path, other, n, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10""")
def cochange_parts(spark, sf_dir):
    return history.top_cochange(_pairs(spark, sf_dir), least=2)


_BRIDGES = """strong AS (SELECT * FROM (SELECT path, other, n, row_number() OVER (PARTITION BY path ORDER BY n DESC, first_seq, other) AS rank FROM pairs) WHERE rank <= 10),
toward AS (SELECT * FROM (SELECT other AS test, path, n, row_number() OVER (PARTITION BY other ORDER BY n DESC, path) AS r FROM strong JOIN part tp ON tp.p_partkey = other JOIN part pp ON pp.p_partkey = path WHERE tp.p_size <= 10 AND pp.p_size > 10) WHERE r <= 50),
bridges AS (SELECT a.path AS path, b.path AS other, max(least(a.n, b.n) // 2) AS n FROM toward a JOIN toward b ON a.test = b.test AND a.path <> b.path WHERE least(a.n, b.n) // 2 >= 1 GROUP BY a.path, b.path)"""


@query(f"""WITH {_PAIRS}, {_BRIDGES}, u AS (SELECT path, other, n, rank FROM strong UNION ALL SELECT path, other, n, 1048576 FROM bridges),
m AS (SELECT path, other, max(n) AS n, min(rank) AS was FROM u GROUP BY path, other),
r AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY n DESC, was, other) AS rank FROM m)
SELECT path, other, CAST(n AS BIGINT) AS n, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10""")
def cochange_bridge(spark, sf_dir):
    strong = history.top_cochange(_pairs(spark, sf_dir), least=1)
    small = _table(spark, sf_dir, "part").where("p_size <= 10").select(F.col("p_partkey").alias("k"))
    marked = strong.join(small.withColumn("t", F.lit(True)), strong["other"] == F.col("k"), "left").drop("k").join(small.withColumn("s", F.lit(True)), strong["path"] == F.col("k"), "left").drop("k")
    # the role of a part isn't in its key, so it is looked up, and encoded in the sign
    key = lambda c, flag: F.when(F.col(flag), -F.col(c)).otherwise(F.col(c)).alias(c)
    signed = marked.select(key("path", "s"), key("other", "t"), "n", "rank")
    bridges = history.bridge_cochange(signed, lambda c: c < 0, least=1)
    return history.merge_bridges(strong, bridges)


_SEEDS = """
top AS (SELECT p_brand AS query_id, p_partkey AS node, p_retailprice AS price, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part),
seeds AS (SELECT query_id, node, price / max(price) OVER (PARTITION BY query_id) AS w, rank FROM top WHERE rank <= 10)"""


def _seeds(spark, sf_dir) -> DataFrame:
    parts = _table(spark, sf_dir, "part").select(F.col("p_brand").alias("query_id"), F.col("p_partkey").alias("doc"), F.col("p_retailprice").alias("score"))
    return rank.normalize(rank.ranked(parts, tie="doc").where("rank <= 10"))


def _edges(spark, sf_dir) -> DataFrame:
    return _pairs(spark, sf_dir).select(F.col("path").alias("src"), F.col("other").alias("dst"))


@query(f"""WITH {_PAIRS}, {_SEEDS},
reach AS (SELECT query_id, other AS doc, w, rank, node FROM seeds JOIN pairs ON node = path WHERE rank <= 6),
fresh AS (SELECT * FROM reach r WHERE NOT EXISTS (SELECT 1 FROM seeds s WHERE s.query_id = r.query_id AND s.node = r.doc)),
f AS (SELECT query_id, doc, min(rank) AS source_rank, count(DISTINCT rank) AS n_sources, arg_min(w, rank) AS weight, arg_min(node, rank) AS source FROM fresh GROUP BY query_id, doc)
SELECT query_id, doc, CAST(source_rank AS INTEGER) AS source_rank, CAST(n_sources AS INTEGER) AS n_sources, round(weight, 6) AS weight, source FROM f""")
def frontier_1hop(spark, sf_dir):
    docs = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc"), F.col("p_partkey").alias("ord"), F.lit(1.0).alias("prior"))
    found = rank.frontier(_seeds(spark, sf_dir), _edges(spark, sf_dir), docs)
    return found.select("query_id", "doc", "source_rank", F.size("linked").alias("n_sources"), F.round("weight", 6).alias("weight"), "source")


_GRAPH = "edges AS (SELECT path AS src, other AS dst FROM pairs), degree AS (SELECT src, count(*) AS degree FROM edges GROUP BY src)"


def _walk_sql(rounds: int = 3, alpha: float = 0.85) -> str:
    out = f"WITH {_PAIRS}, {_SEEDS}, {_GRAPH}, w0 AS (SELECT query_id, node, w / sum(w) OVER (PARTITION BY query_id) AS w FROM seeds)"
    for i in range(1, rounds + 1):
        out += f""", m{i} AS (
  SELECT query_id, coalesce(dst, node) AS node, {alpha} * w / coalesce(degree, 1) AS w FROM w{i - 1} LEFT JOIN (edges JOIN degree USING (src)) e ON e.src = node
  UNION ALL SELECT query_id, node, {1 - alpha} * w FROM w0), w{i} AS (SELECT query_id, node, sum(w) AS w FROM m{i} GROUP BY query_id, node HAVING sum(w) > 1e-12)"""
    return out + f" SELECT query_id, node, round(w, 8) AS w FROM w{rounds}"


def _weights(spark, sf_dir) -> DataFrame:
    return _seeds(spark, sf_dir).select("query_id", F.col("doc").alias("node"), F.col("score").alias("w"))


@query(_walk_sql())
def pagerank_3_rounds(spark, sf_dir):
    return graph.pagerank(_weights(spark, sf_dir), _edges(spark, sf_dir)).select("query_id", "node", F.round("w", 8).alias("w"))


@query(f"""WITH {_PAIRS}, {_SEEDS}, {_GRAPH},
given AS (SELECT query_id, node, w FROM seeds UNION ALL SELECT query_id, dst, 0.5 * w / degree FROM seeds JOIN edges e ON e.src = node JOIN degree d ON d.src = e.dst),
spread AS (SELECT query_id, node, sum(w) AS w FROM given GROUP BY query_id, node)
SELECT query_id, node, round(w / sum(w) OVER (PARTITION BY query_id), 8) AS w FROM spread""")
def propagate_beta(spark, sf_dir):
    return graph.propagate(_weights(spark, sf_dir), _edges(spark, sf_dir)).select("query_id", "node", F.round("w", 8).alias("w"))


@query(f"""WITH {_PAIRS}, {_SEEDS}, {_GRAPH},
h1 AS (SELECT query_id, dst AS node, sum(w / degree) AS w FROM seeds JOIN edges e ON e.src = node JOIN degree USING (src) GROUP BY query_id, dst),
h2 AS (SELECT query_id, dst AS node, sum(w / degree) AS w FROM h1 JOIN edges e ON e.src = node JOIN degree USING (src) GROUP BY query_id, dst),
u AS (SELECT query_id, node, 0.6 * w AS w FROM seeds UNION ALL SELECT query_id, node, 0.3 * w FROM h1 UNION ALL SELECT query_id, node, 0.1 * w FROM h2)
SELECT query_id, node, round(sum(w), 8) AS w FROM u GROUP BY query_id, node""")
def heat_2_steps(spark, sf_dir):
    return graph.heat(_weights(spark, sf_dir), _edges(spark, sf_dir)).select("query_id", "node", F.round("w", 8).alias("w"))


@query(f"""WITH {_PAIRS}, {_SEEDS},
h0 AS (SELECT query_id, node FROM seeds), h1 AS (SELECT DISTINCT query_id, other AS node FROM h0 JOIN pairs ON node = path EXCEPT SELECT * FROM h0),
h2 AS (SELECT DISTINCT query_id, other AS node FROM h1 JOIN pairs ON node = path EXCEPT (SELECT * FROM h0 UNION SELECT * FROM h1))
SELECT query_id, node, 0 AS hops FROM h0 UNION ALL SELECT query_id, node, 1 FROM h1 UNION ALL SELECT query_id, node, 2 FROM h2""")
def hops_from_seeds(spark, sf_dir):
    return graph.hops(_weights(spark, sf_dir), _edges(spark, sf_dir), 2)


@query("""WITH c AS (SELECT event_type AS path, user_id AS author, count(*) AS n, min(event_id) AS first_seq FROM events GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY n DESC, first_seq) AS r FROM c),
t AS (SELECT event_type AS path, count(*) AS n_commits, epoch_us(arg_min(ts, event_id)) // 1000000 AS last_ts FROM events GROUP BY event_type)
SELECT path, n_commits, CAST(last_ts AS BIGINT) AS last_ts, CAST(r AS INTEGER) AS place, author, n FROM r JOIN t USING (path) WHERE r <= 5""")
def meta_top_authors(spark, sf_dir):
    events = _table(spark, sf_dir, "events")
    commits = events.select(F.col("event_id").alias("seq"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).alias("ts"), F.col("user_id").alias("author"))
    meta = history.file_meta(events.select(F.col("event_id").alias("seq"), F.col("event_type").alias("path")), commits)
    return meta.select("path", "n_commits", "last_ts", F.posexplode("authors").alias("at", "a")).select("path", "n_commits", "last_ts", (F.col("at") + 1).alias("place"), "a.author", "a.n")


# ---- lines

_LINES = r"""ls AS (SELECT doc_id AS doc, CASE WHEN x[len(x)] = '' THEN x[1:len(x) - 1] ELSE x END AS l FROM (SELECT doc_id, regexp_split_to_array(text, '\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]') AS x FROM documents WHERE text IS NOT NULL))"""


@query(f"""WITH {_LINES}, c AS (SELECT doc, l, unnest(range(0, (len(l) - 1) // 40 + 1)) AS k FROM ls WHERE len(l) > 0),
t AS (SELECT doc, k * 40 + 1 AS start_line, least((k + 1) * 40, len(l)) AS end_line, array_to_string(l[k * 40 + 1:(k + 1) * 40], chr(10)) AS content FROM c)
SELECT doc AS doc_id, CAST(start_line AS INTEGER) AS start_line, CAST(end_line AS INTEGER) AS end_line, md5(content) AS content FROM t WHERE regexp_matches(content, '[^ \\t\\n\\x0B\\f\\r]')""".replace("\\\\", "\\"))
def chunk_40_lines(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").where("text IS NOT NULL")
    return lines.chunks(docs, 40, "doc_id").select(F.col("doc").alias("doc_id"), "start_line", "end_line", F.md5("content").alias("content"))


_HITS = f"""{_LINES}, rows AS (SELECT doc, unnest(l) AS content, unnest(range(1, len(l) + 1)) AS line FROM ls),
hits AS (SELECT DISTINCT query_id, doc, line FROM picks JOIN rows USING (doc) JOIN terms USING (query_id) WHERE contains(lower(content), term))"""


@query(f"WITH {_postings('documents', 'doc_id', 'p')}, {_QUESTIONS}, {_bm25('p', 'bm')}, {_PICKS}, {_HITS} SELECT query_id, doc AS doc_id, CAST(line AS INTEGER) AS line FROM hits")
def hit_lines(spark, sf_dir):
    terms, _, scores = _scores(spark, sf_dir)
    return lines.hit_lines(_documents(spark, sf_dir), _picks(scores), terms, "doc").withColumnRenamed("doc", "doc_id")


@query(f"""WITH {_postings('documents', 'doc_id', 'p')}, {_QUESTIONS}, {_bm25('p', 'bm')}, {_PICKS}, {_HITS},
w AS (SELECT query_id, doc, greatest(line - 3, 1) AS a, least(line + 3, len(l)) AS b FROM hits JOIN ls USING (doc)),
m AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY query_id, doc ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS new FROM w),
i AS (SELECT *, sum(new) OVER (PARTITION BY query_id, doc ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT query_id, doc AS doc_id, CAST(min(a) AS INTEGER) AS a, CAST(max(b) AS INTEGER) AS b FROM i GROUP BY query_id, doc, island""")
def window_blocks(spark, sf_dir):
    terms, _, scores = _scores(spark, sf_dir)
    picks = _picks(scores)
    docs = _documents(spark, sf_dir).join(index.sized_broadcast(picks.select("doc").distinct(), 32), "doc", "left_semi")
    hits = lines.hit_lines(docs, picks, terms, "doc")
    sizes = docs.select("doc", F.size(text.split_lines(F.col("text"))).alias("n_lines"))
    return lines.window_blocks(hits, sizes, radius=3, gap=1).withColumnRenamed("doc", "doc_id")


@query("""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')), ' '), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, unnest([array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)]) AS shingle FROM w)
SELECT md5(shingle) AS shingle, count(DISTINCT doc_id) AS n_docs FROM s GROUP BY shingle HAVING count(DISTINCT doc_id) > 1""")
def shared_shingles(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    if index.repeated(docs):  # a shingle counts once for all rows of a document
        rows = docs.where("text IS NOT NULL").select("doc", F.explode(F.array_distinct(text.shingles(F.col("text")))).alias("s"))
        return rows.groupBy(F.md5("s").alias("shingle")).agg(F.count_distinct("doc").alias("n_docs")).where("n_docs > 1")
    return grams.shared_shingles(docs)


# ---- metrics


@query("""WITH g AS (SELECT source, list(d.doc_id) AS gold FROM documents d JOIN labels USING (doc_id) WHERE toxic = 1 GROUP BY source),
r AS (SELECT source, list(doc_id ORDER BY n_chars DESC, doc_id) AS ret FROM documents GROUP BY source),
j AS (SELECT source, coalesce(gold, []) AS gold, ret FROM r LEFT JOIN g USING (source))
SELECT count(*) AS n, avg(list_has_all(ret[1:1], gold)::INT) AS at_1, avg(list_has_all(ret[1:20], gold)::INT) AS at_20, avg(list_has_all(ret[1:40], gold)::INT) AS at_40, avg(list_has_all(ret, gold)::INT) AS at_all FROM j""")
def recall_at_k(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    gold = docs.join(_table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id").distinct(), "doc_id", "left_semi").groupBy("source").agg(F.collect_list("doc_id").alias("gold_files"))
    order = F.array_sort(F.collect_list(F.struct((-F.col("n_chars")).alias("size"), "doc_id")))
    runs = docs.groupBy("source").agg(order["doc_id"].alias("returned_files")).join(gold, "source", "left").withColumn("gold_files", F.coalesce("gold_files", F.array().cast("array<bigint>")))
    return metrics.recall_at(runs, (1, 20, 40))


@query("SELECT doc_id AS instance_id, CASE WHEN toxic = 1 THEN 'gained' ELSE 'lost' END AS change FROM labels WHERE quality <> toxic")
def gained_lost(spark, sf_dir):
    labels = _table(spark, sf_dir, "labels")
    return metrics.gained_lost(labels.select(F.col("doc_id").alias("instance_id"), (F.col("quality") == 1).alias("found")), labels.select(F.col("doc_id").alias("instance_id"), (F.col("toxic") == 1).alias("found")))


@query("SELECT count(*) AS n, count(*) FILTER (WHERE quality = 0 AND toxic = 1) AS n01, count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS n10 FROM labels")
def discordant_pairs(spark, sf_dir):
    labels = _table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "instance_id")
    return metrics.discordant(labels.withColumn("x", F.col("quality")), labels.withColumn("x", F.col("toxic")), "x")


_SPANS = """span AS (SELECT l_orderkey AS instance_id, l_linestatus AS path, l_linenumber * 10 AS a, l_linenumber * 10 + CAST(l_quantity AS INTEGER) AS b, l_returnflag AS flag FROM lineitem),
gold AS (SELECT DISTINCT instance_id, path, unnest(range(a, b + 1)) AS line FROM span WHERE flag = 'R'),
got AS (SELECT DISTINCT instance_id, path, unnest(range(a, b + 1)) AS line FROM span WHERE flag <> 'R')"""


def _spans(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    a = (F.col("l_linenumber") * 10).alias("a")
    rows = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("instance_id"), F.col("l_linestatus").alias("path"), a, (F.col("l_linenumber") * 10 + F.col("l_quantity").cast("int")).alias("b"), "l_returnflag")
    return rows.where("l_returnflag = 'R'").drop("l_returnflag"), rows.where("l_returnflag <> 'R'").drop("l_returnflag")


@query(f"""WITH {_SPANS}, f AS (SELECT DISTINCT instance_id, path FROM got)
SELECT g.instance_id, count(*) AS n_lines, count(t.line) AS n_covered, min((f.path IS NOT NULL)::INT) = 1 AS all_files, round(count(t.line) / count(*), 6) AS line_recall
FROM gold g LEFT JOIN got t USING (instance_id, path, line) LEFT JOIN f USING (instance_id, path) GROUP BY g.instance_id""")
def line_coverage(spark, sf_dir):
    gold, spans = _spans(spark, sf_dir)
    return metrics.line_coverage(gold, spans).withColumn("line_recall", F.round("line_recall", 6))


@query(f"WITH {_SPANS} SELECT count(g.line) AS n_gold, count(*) AS n_returned, round(count(g.line) / count(*), 6) AS precision FROM got LEFT JOIN gold g USING (instance_id, path, line)")
def region_precision(spark, sf_dir):
    return metrics.region_precision(*_spans(spark, sf_dir)).withColumn("precision", F.round("precision", 6))


@query("""WITH v AS (SELECT l_discount / 0.1 AS r FROM lineitem), w AS (SELECT avg(r) AS mean, median(r) AS median FROM v)
SELECT CASE WHEN r <= 0 THEN 'none' WHEN r <= 0.25 THEN 'up_to_25' WHEN r <= 0.5 THEN 'up_to_50' WHEN r <= 0.75 THEN 'up_to_75' WHEN r < 1 THEN 'below_100' ELSE 'all' END AS bucket, count(*) AS n, round(any_value(mean), 6) AS mean, round(any_value(median), 6) AS median FROM v, w GROUP BY 1""")
def recall_buckets(spark, sf_dir):
    rows = _table(spark, sf_dir, "lineitem").select((F.col("l_discount") / 0.1).alias("r"))
    return metrics.summary(rows, "r").select("bucket", "n", F.round("mean", 6).alias("mean"), F.round("median", 6).alias("median"))


@query("""WITH l AS (SELECT event_type, list(value ORDER BY value) AS v FROM events GROUP BY event_type)
SELECT event_type, v[CAST(round_even(0.5 * (len(v) - 1), 0) AS BIGINT) + 1] AS p50, v[CAST(round_even(0.95 * (len(v) - 1), 0) AS BIGINT) + 1] AS p95 FROM l""")
def nearest_rank(spark, sf_dir):
    values = F.collect_list("value")
    return _table(spark, sf_dir, "events").groupBy("event_type").agg(metrics.nearest_rank(values, 50).alias("p50"), metrics.nearest_rank(values, 95).alias("p95"))


_TURNS = "turns AS (SELECT conv_id, turn, length(text) AS input_tokens, length(text) // 4 AS output_tokens FROM conversations WHERE text IS NOT NULL)"


def _turns(spark, sf_dir) -> DataFrame:
    return _table(spark, sf_dir, "conversations").where("text IS NOT NULL").select("conv_id", "turn", F.length("text").cast("long").alias("input_tokens"), F.floor(F.length("text") / 4).alias("output_tokens"))


@query(f"WITH {_TURNS}, c AS (SELECT *, sum(input_tokens) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS cumulative FROM turns) SELECT turn, count(*) AS n, median(cumulative) AS median FROM c GROUP BY turn")
def turn_growth(spark, sf_dir):
    return metrics.growth_by_turn(_turns(spark, sf_dir), ["conv_id"])


@query(f"""WITH {_TURNS}, c AS (SELECT *, least(coalesce(lag(input_tokens) OVER (PARTITION BY conv_id ORDER BY turn), 0), input_tokens) AS reused FROM turns)
SELECT conv_id, round((sum(input_tokens) * 3.0 + sum(output_tokens) * 15.0) / 1e6, 9) AS plain_cost, round((sum(input_tokens - reused) * 3.0 + sum(reused) * 0.3 + sum(output_tokens) * 15.0) / 1e6, 9) AS cached_cost FROM c GROUP BY conv_id""")
def prefix_cache_cost(spark, sf_dir):
    return metrics.cached_cost(_turns(spark, sf_dir), ["conv_id"]).select("conv_id", F.round("plain_cost", 9).alias("plain_cost"), F.round("cached_cost", 9).alias("cached_cost"))


@query("""WITH l AS (SELECT ln(n_chars) AS x, ln(length(text) - length(replace(text, ' ', ''))) AS y FROM documents WHERE n_chars > 0 AND length(text) - length(replace(text, ' ', '')) > 0)
SELECT round(regr_slope(y, x), 6) AS exponent, round(exp(regr_intercept(y, x)), 6) AS factor, round(regr_r2(y, x), 6) AS r2 FROM l""")
def loglog_fit(spark, sf_dir):
    rows = _table(spark, sf_dir, "documents").select("n_chars", (F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit("")))).alias("blanks"))
    return metrics.power_law(rows, "n_chars", "blanks").select(*[F.round(c, 6).alias(c) for c in ("exponent", "factor", "r2")])


@query("""WITH r AS (SELECT o_orderpriority AS arm, o_orderstatus = 'F' AS success, o_totalprice AS tokens, o_custkey % 30 AS turns, o_totalprice / 1000 AS cost FROM orders WHERE o_orderstatus <> 'P'),
a AS (SELECT arm, count(*) AS n, avg(success::INT) AS p, median(tokens) AS mt, avg(tokens) AS mean_t, median(turns) AS mu, avg(cost) FILTER (WHERE NOT success) AS f, avg(cost) FILTER (WHERE success) AS g FROM r GROUP BY arm)
SELECT arm, n, round(p, 6) AS success_rate, round(mt, 4) AS median_tokens, round(mean_t, 4) AS mean_tokens, CAST(mu AS DOUBLE) AS median_turns, round(CASE WHEN p > 0 THEN (1 - p) / p * coalesce(f, 0) + g END, 4) AS cost_to_success FROM a""")
def arm_summary(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "P", "api_error").otherwise("done")
    runs = _table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("arm"), (F.col("o_orderstatus") == "F").alias("success"), F.col("o_totalprice").alias("tokens"), (F.col("o_custkey") % 30).alias("turns_used"), (F.col("o_totalprice") / 1000).alias("cost"), status.alias("status"))
    digits = {"success_rate": 6, "median_tokens": 4, "mean_tokens": 4, "cost_to_success": 4}
    out = metrics.arm_summary(runs)
    return out.select(*[F.round(c, digits[c]).alias(c) if c in digits else F.col(c) for c in out.columns])


@query("""WITH o AS (SELECT doc_id, n_chars FROM documents WHERE lang <> 'fr'), n AS (SELECT doc_id, n_chars + (lang = 'es')::INT AS n_chars FROM documents WHERE lang <> 'de')
SELECT coalesce(o.doc_id, n.doc_id) AS path, CASE WHEN o.doc_id IS NULL THEN 'added' WHEN n.doc_id IS NULL THEN 'removed' ELSE 'modified' END AS change FROM o FULL JOIN n ON o.doc_id = n.doc_id
WHERE o.doc_id IS NULL OR n.doc_id IS NULL OR o.n_chars <> n.n_chars""")
def manifest_diff(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.lit(0).alias("mtime"), F.col("n_chars").alias("size"), "lang")
    new = docs.where("lang <> 'de'").withColumn("size", F.col("size") + (F.col("lang") == "es").cast("int"))
    return index.classify_changes(docs.where("lang <> 'fr'"), new)


# ---- the whole engine


def _corpus(spark, sf_dir) -> retrieval.Corpus:
    docs = _table(spark, sf_dir, "documents").where("text IS NOT NULL")
    files = docs.select(F.concat_ws("/", "source", F.concat("lang", F.lit("_"), F.col("doc_id").cast("string"), F.lit(".py"))).alias("path"), "text")
    return retrieval.build(describe(files))


@query()
def select_files(spark, sf_dir):
    return retrieval.select_files(_corpus(spark, sf_dir), _questions(spark, sf_dir))


@query()
def pack_bundles(spark, sf_dir):
    corpus, asked = _corpus(spark, sf_dir), _questions(spark, sf_dir)
    return pack.bundles(retrieval.pack_bundles(corpus, asked, retrieval.select_files(corpus, asked)))


# ---- fusion, neighbourhoods, slices, upkeep


@query(f"""WITH {_postings('documents', 'doc_id', 'p')}, {_QUESTIONS}, asked AS (SELECT DISTINCT term FROM terms), k AS (SELECT d.lang, p.* FROM p JOIN documents d ON d.doc_id = p.doc),
s AS (SELECT lang, doc, sum(tf) AS n FROM k GROUP BY lang, doc), a AS (SELECT lang, count(*) AS docs, avg(n) AS avg_len FROM s GROUP BY lang),
h AS (SELECT * FROM k JOIN asked USING (term)), f AS (SELECT lang, term, count(*) AS df FROM h GROUP BY lang, term),
c AS (SELECT lang, doc, term, ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / avg_len)) AS c FROM h JOIN f USING (lang, term) JOIN s USING (lang, doc) JOIN a USING (lang))
SELECT lang, doc AS doc_id, round(sum(c ORDER BY term), 6) AS score FROM c GROUP BY lang, doc""")
def candidate_bm25(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").where("lang IS NOT NULL").select(F.col("doc_id").alias("doc"), "text", F.col("lang").alias("query_id"))
    asked = rank.query_terms(_questions(spark, sf_dir)).select("term").distinct()
    terms = index.settled(asked.crossJoin(docs.select("query_id").distinct()))  # one a language
    found = fusion.candidate_bm25(terms, index.vectors(docs, index.term_numbers(asked)))
    return found.select(F.col("query_id").alias("lang"), F.col("doc").alias("doc_id"), F.round("score", 6).alias("score"))


@query(f"""WITH {_postings('documents', 'doc_id', 'p')}, {_QUESTIONS}, {_bm25('p', 'bm')}, {_PICKS}, {_postings('benchmark', 'item_id', 'b')},
na AS (SELECT doc AS query_id, sqrt(sum(tf * tf)) AS na FROM b GROUP BY doc), nb AS (SELECT doc, sqrt(sum(tf * tf)) AS nb FROM p GROUP BY doc),
d AS (SELECT b.doc AS query_id, p.doc AS doc, sum(b.tf * p.tf) AS dot FROM b JOIN p USING (term) GROUP BY b.doc, p.doc),
c AS (SELECT query_id, doc, round(dot / (na * nb), 6) AS cosine FROM d JOIN na USING (query_id) JOIN nb USING (doc)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, doc) AS rank FROM c),
u AS (SELECT query_id, doc, 0 AS i, rank FROM picks UNION ALL SELECT query_id, doc, 1, rank FROM r WHERE rank <= 10)
SELECT query_id, doc AS doc_id, round(sum(1.0::DOUBLE / (60 + rank) ORDER BY i), 9) AS score FROM u GROUP BY query_id, doc""")
def rank_fusion(spark, sf_dir):
    _, _, scores = _scores(spark, sf_dir)
    found = fusion.reciprocal_ranks(rank.top_picks(rank.normalize(scores)), _near(spark, sf_dir, 10))
    return found.select("query_id", F.col("doc").alias("doc_id"), F.round("score", 9).alias("score"))


@query(r"""WITH f AS (SELECT DISTINCT regexp_extract(url, '[^/]*$') AS path FROM pages WHERE regexp_extract(url, '[^/]*$') <> '' UNION SELECT DISTINCT regexp_extract(url, '[^/]*/[^/]*$') FROM pages WHERE regexp_extract(url, '[^/]*/[^/]*$') <> ''),
u AS (SELECT DISTINCT url AS frame FROM pages WHERE url <> '')
SELECT frame, arg_max(path, length(path)) AS path FROM u JOIN f ON ends_with(frame, path) GROUP BY frame""")
def stack_frames(spark, sf_dir):
    urls = _table(spark, sf_dir, "pages").select(F.col("url").alias("frame"))
    tails = urls.select(F.explode(F.array(F.regexp_extract("frame", r"[^/]*$", 0), F.regexp_extract("frame", r"[^/]*/[^/]*$", 0))).alias("path")).where("path <> ''").distinct()
    return fusion.resolve_frames(urls, tails)


@query(f"""WITH {_PAIRS}, {_SEEDS}, r0 AS (SELECT query_id, node AS doc, 0 AS hop, row_number() OVER (PARTITION BY query_id ORDER BY w DESC, node) AS place FROM seeds),
v1 AS (SELECT query_id, other AS doc, min(place) AS via FROM r0 JOIN pairs ON doc = path GROUP BY query_id, other),
n1 AS (SELECT v1.*, row_number() OVER (PARTITION BY query_id ORDER BY via, doc) AS r FROM v1 WHERE NOT EXISTS (SELECT 1 FROM r0 WHERE r0.query_id = v1.query_id AND r0.doc = v1.doc)),
s1 AS (SELECT query_id, count(*) AS size FROM r0 GROUP BY query_id), r1 AS (SELECT query_id, doc, 1 AS hop, r AS place FROM n1 JOIN s1 USING (query_id) WHERE size + r <= 800),
b1 AS (SELECT query_id, doc, hop FROM r0 UNION ALL SELECT query_id, doc, hop FROM r1),
v2 AS (SELECT query_id, other AS doc, min(place) AS via FROM r1 JOIN pairs ON doc = path GROUP BY query_id, other),
n2 AS (SELECT v2.*, row_number() OVER (PARTITION BY query_id ORDER BY via, doc) AS r FROM v2 WHERE NOT EXISTS (SELECT 1 FROM b1 WHERE b1.query_id = v2.query_id AND b1.doc = v2.doc)),
s2 AS (SELECT query_id, count(*) AS size FROM b1 GROUP BY query_id)
SELECT query_id, doc, hop FROM b1 UNION ALL SELECT query_id, doc, 2 FROM n2 JOIN s2 USING (query_id) WHERE size + r <= 800""")
def neighbourhood_2hops(spark, sf_dir):
    seeds = _weights(spark, sf_dir).select("query_id", F.col("node").alias("doc"), F.col("w").alias("score"))
    return fusion.neighbourhood(seeds, history.cochange_edges(_touched(spark, sf_dir)))


@query(f"WITH {_LINES} SELECT doc AS doc_id, CAST(len(l) AS INTEGER) AS n_lines, CASE WHEN len(l) >= 2 THEN md5(array_to_string(l[2:4], chr(10))) END AS content, len(l) >= 2 AND 4 < least(6, len(l)) AS cut FROM ls")
def line_slices(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("path"), "text")
    asked = docs.select("path", F.lit(2).alias("start"), F.lit(6).alias("stop"))
    found = lines.line_slices(docs, asked, most=3)
    return found.select(F.col("path").alias("doc_id"), "n_lines", F.md5(F.array_join("lines", "\n")).alias("content"), "cut")


@query("SELECT c_nationkey AS repo, count(*) AS n FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000) GROUP BY c_nationkey")
def missing_repositories(spark, sf_dir):
    tasks = _table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("repo"))
    present = _table(spark, sf_dir, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("repo"))
    return corpus.missing_repositories(tasks, present)


@query(f"""WITH {_postings('documents', 'doc_id', 'p')}, {_postings('benchmark', 'item_id', 'b')}
SELECT doc, term, tf, first_pos FROM p WHERE doc NOT IN (SELECT item_id FROM benchmark) UNION ALL SELECT doc, term, tf, first_pos FROM b""")
def replaced_postings(spark, sf_dir):
    fresh = _questions(spark, sf_dir).select(F.col("query_id").alias("doc"), F.col("question").alias("text"))
    updated = index.replace_documents(index.postings(_documents(spark, sf_dir)), fresh.select("doc"), index.postings(fresh))
    return updated.select("doc", "term", "tf", F.col("first_pos").cast("long").alias("first_pos"))


@query(f"""WITH {_postings('documents', 'doc_id', 'p')}, {_QUESTIONS}, {_bm25('p', 'bm')}, v AS (SELECT DISTINCT term FROM p),
c AS (SELECT query_id, count(v.term) AS matched, count(*) AS total FROM terms LEFT JOIN v USING (term) GROUP BY query_id), t AS (SELECT query_id, max(score) AS top FROM bm GROUP BY query_id)
SELECT query_id, total = 0 OR coalesce(top, 0) < 12 OR matched / total < 0.45 AS low_confidence FROM c LEFT JOIN t USING (query_id)""")
def low_confidence(spark, sf_dir):
    terms, counted, scores = _scores(spark, sf_dir, 1)
    best = scores.groupBy("query_id").agg(F.max("score").alias("top"))
    held = {r["t"] for r in counted.collect()}
    known = spark.createDataFrame([(t,) for t, i in index.term_numbers(terms).items() if i in held], "term string")
    rows = index.coverage(terms, known).join(best, "query_id", "left")
    return rows.select("query_id", index.low_confidence(F.coalesce("top", F.lit(0.0)), F.col("matched"), F.col("total")).alias("low_confidence"))


@query("""WITH f AS (SELECT DISTINCT url AS path, CASE WHEN contains(url, '/') THEN regexp_replace(url, '/[^/]*$', '') ELSE '.' END AS folder FROM pages WHERE url IS NOT NULL)
SELECT a.path AS src, b.path AS dst FROM f a JOIN f b ON a.folder = b.folder AND a.path <> b.path""")
def same_folder_pages(spark, sf_dir):
    return graph.same_folder(_table(spark, sf_dir, "pages").where("url IS NOT NULL").select(F.col("url").alias("path")).distinct())
