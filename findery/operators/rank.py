"""Ranking: weighted-field BM25, feedback, expansion over graphs, and the merging rules.

Every relation has a ``query_id``, so one job ranks all queries. ``tie`` is when a
document first got a score (term, phase, corpus order), which breaks equal scores.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from findery.functions import text

from . import grams, scan
from .index import Vectors, idf, repeated, settled, sized_broadcast


@dataclass(frozen=True)
class RankParams:
    k1: float = 1.2
    b: float = 0.75
    path_weight: float = 2.5
    comment_weight: float = 0.5
    picks: int = 10
    floor: float = 0.05
    sources: int = 6
    feedback_files: int = 3
    feedback_terms: int = 20
    strong_cochange: int = 5
    fill: int = 16
    eligible: float = 0.15
    path_hits: int = 6
    message_files: int = 3
    message_floor: float = 0.35


def query_terms(queries: DataFrame, query_id: str = "query_id", question: str = "question", keywords: str | None = None) -> DataFrame:
    """(query_id, term_pos, term) of each question."""
    terms = text.query_terms(F.col(question), F.col(keywords) if keywords else None)
    return queries.select(F.col(query_id).alias("query_id"), F.posexplode(terms).alias("term_pos", "term"))


def ordered_sum(parts: str) -> Column:
    """Sums ``c`` of an array of structs in the structs' order, so that equal inputs
    give equal bits whatever the partitioning."""
    return F.aggregate(F.array_sort(parts), F.lit(0.0), lambda s, x: s + x["c"])


def bm25(terms: DataFrame, posted: DataFrame, sizes: DataFrame, docs: DataFrame | None = None, paths: DataFrame | None = None, comments: DataFrame | None = None, params: RankParams = RankParams(), b: float | None = None, use_prior: bool = True) -> DataFrame:
    """(query_id, doc, score, tie): BM25 of the body field plus, where given, path hits
    and a comment field, times the document's prior.

    ``docs`` is (doc, ord, prior); without it all priors are 1 and ties go by doc.
    A path hit counts with the body's idf, and only for terms that the body has.
    """
    b = params.b if b is None else b
    few = sized_broadcast(terms.select("term").distinct(), 48)
    hits = posted.join(few, "term", "left_semi")
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    n = sizes.agg(F.count("*").alias("n"), F.coalesce(F.avg("n_terms"), F.lit(1.0)).alias("avg"))
    weights = terms.join(df, "term").crossJoin(F.broadcast(n)).select("query_id", "term_pos", "term", idf(F.col("n"), F.col("df")).alias("w"), "avg")
    weighed = sized_broadcast(weights, 96)
    body = hits.join(weighed, "term").join(sizes.select("doc", "n_terms"), "doc")
    k1 = params.k1
    value = F.col("w") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (F.lit(1 - b) + F.lit(b) * F.col("n_terms") / F.col("avg")))
    parts = body.select("query_id", "doc", F.struct("term_pos", F.lit(0).alias("phase"), value.alias("c")).alias("part"))
    if paths is not None:
        named = paths.select(F.col("path").alias("doc"), "term").join(weighed, "term")
        parts = parts.unionByName(named.select("query_id", "doc", F.struct("term_pos", F.lit(1).alias("phase"), (F.lit(params.path_weight) * F.col("w")).alias("c")).alias("part")))
    if comments is not None:
        own = comments.join(few, "term", "left_semi")
        counted = own.groupBy("term").agg(F.count("*").alias("df"))
        total = comments.agg(F.count_distinct("doc").alias("n"))
        heavy = terms.join(counted, "term").crossJoin(F.broadcast(total)).select("query_id", "term_pos", "term", idf(F.col("n"), F.col("df")).alias("w"))
        noted = own.join(sized_broadcast(heavy, 96), "term")
        parts = parts.unionByName(noted.select("query_id", "doc", F.struct("term_pos", F.lit(2).alias("phase"), (F.lit(params.comment_weight) * F.col("w") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1)).alias("c")).alias("part")))
    summed = parts.groupBy("query_id", "doc").agg(F.collect_list("part").alias("parts"))
    first = F.array_min(F.transform("parts", lambda p: F.struct(p["term_pos"], p["phase"])))
    scored = summed.select("query_id", "doc", ordered_sum("parts").alias("score"), first.alias("first"))
    if docs is None:
        return scored.select("query_id", "doc", "score", F.struct(F.col("first.term_pos"), F.col("first.phase"), F.col("doc").alias("ord")).alias("tie"))
    placed = scored.join(docs.select("doc", "ord", "prior"), "doc")
    score = F.col("score") * F.col("prior") if use_prior else F.col("score")
    return placed.select("query_id", "doc", score.alias("score"), F.struct(F.col("first.term_pos"), F.col("first.phase"), "ord").alias("tie"))


def _asked(terms: DataFrame, numbers: dict[str, int], weight) -> tuple[DataFrame, scan.Asked, int]:
    """(q, query_id), the questions' terms that some document may have, and the number of
    questions. ``terms`` is (query_id, term_pos, term, and x if the weight needs it)."""
    rows = terms.collect()  # questions, not documents
    ids = {x: i for i, x in enumerate(dict.fromkeys(r["query_id"] for r in rows))}
    known = [(ids[r["query_id"]], r["term_pos"], numbers[r["term"]], weight(r)) for r in rows if r["term"] in numbers and weight(r)]
    q, pos, t, w = (np.array([k[i] for k in known], np.float64 if i == 3 else np.int64) for i in range(4))
    schema = T.StructType([T.StructField("q", T.IntegerType()), T.StructField("query_id", terms.schema["query_id"].dataType)])
    named = terms.sparkSession.createDataFrame([(i, x) for x, i in ids.items()], schema)
    return named, scan.Asked(q, pos, t, w), len(ids)


def best_bm25(terms: DataFrame, found: Vectors, most: int = 10, params: RankParams = RankParams(), b: float | None = None, prior: str | None = None, order: str = "doc", counted: DataFrame | None = None) -> DataFrame:
    """(query_id, doc, score, tie) as ``bm25`` gives it, of at least the ``most`` best
    documents of each query: every task leaves out what can't be among them. ``prior``
    and ``order`` name columns of the vectors. ``counted`` has their frequencies, if they are known."""
    counts = {r["t"]: r["n"] for r in (scan.frequencies(found.rows) if counted is None else counted).collect()}
    n = counts.get(-1, 0)
    named, asked, _ = _asked(terms, found.numbers, lambda r: math.log(1.0 + (n - counts[t] + 0.5) / (counts[t] + 0.5)) if (t := found.numbers[r["term"]]) in counts else 0.0)
    top = scan.best(found.rows, asked, most, "bm25", params.k1, params.b if b is None else b, counts.get(-2, 0) / n if n else 1.0, prior, order)
    return top.join(F.broadcast(named), "q").select("query_id", "doc", "score", F.struct(F.col("first").alias("term_pos"), F.lit(0).alias("phase"), "ord").alias("tie"))


def best_cosine(a: DataFrame, found: Vectors, most: int = 10, digits: int = 6) -> DataFrame:
    """(query_id, doc, cosine) as ``tf_cosine`` gives it, of at least the ``most`` best
    documents of each query by the cosine rounded to ``digits``. ``a`` is (query_id, term, tf)."""
    named, asked, n = _asked(a.withColumn("term_pos", F.lit(0)), found.numbers, lambda r: r["tf"])
    # a question's norm is of all its terms, be they in a document or not
    norms = np.sqrt(np.bincount(asked.query, asked.w**2, n))
    top = scan.best(found.rows, asked, most, "cosine", norms=norms, slack=1.01 * 10.0**-digits)
    return top.join(F.broadcast(named), "q").select("query_id", "doc", F.col("score").alias("cosine"))


def normalize(scores: DataFrame, column: str = "score") -> DataFrame:
    """Scores divided by the query's largest, if that is positive."""
    top = F.max(column).over(Window.partitionBy("query_id"))
    return scores.withColumn(column, F.when(top > 0, F.col(column) / top).otherwise(F.col(column)))


def normalize_sum(scores: DataFrame, column: str = "score") -> DataFrame:
    total = F.sum(column).over(Window.partitionBy("query_id"))
    return scores.withColumn(column, F.when(total > 0, F.col(column) / total).otherwise(F.col(column)))


def ranked(scores: DataFrame, column: str = "score", tie: str = "tie", name: str = "rank") -> DataFrame:
    """Ranks from 1, best score first."""
    return scores.withColumn(name, F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(column), F.asc(tie))))


def top_picks(scores: DataFrame, params: RankParams = RankParams()) -> DataFrame:
    """The best ``picks``: beyond the third only those within ``floor`` of the best."""
    top = ranked(scores).where(F.col("rank") <= params.picks)
    best = F.max("score").over(Window.partitionBy("query_id"))
    return top.withColumn("best", best).where((F.col("rank") <= 3) | (F.col("score") >= params.floor * F.col("best"))).drop("best")


def feedback_terms(picks: DataFrame, posted: DataFrame, terms: DataFrame, n_docs: Column | int, docs: DataFrame | None = None, params: RankParams = RankParams(), counts: DataFrame | None = None) -> DataFrame:
    """(query_id, term_pos, term): the query's expansion by the most telling terms of
    the first few of its best documents (those of full prior), in order of spelling.
    With the corpus' ``counts`` (term, df), ``posted`` need only hold the picks."""
    source = picks.where(F.col("rank") <= params.sources)
    if docs is not None:
        source = source.join(docs.where("prior = 1.0").select("doc"), "doc", "left_semi")
    source = source.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).where(F.col("n") <= params.feedback_files)
    chosen = sized_broadcast(settled(source.select("query_id", "doc", "rank")), 64)
    own = settled(posted.join(chosen, "doc"))
    known = sized_broadcast(settled(own.select("term").distinct()), 48)
    df = counts.select("term", "df").join(known, "term", "left_semi") if counts is not None else posted.join(known, "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    weight = F.col("tf") * F.log(F.lit(1.0) + F.lit(n_docs) / (F.col("df") + 1))
    fresh = own.join(df, "term").join(terms.select("query_id", "term"), ["query_id", "term"], "left_anti")
    best = fresh.withColumn("w", weight).withColumn("r", F.row_number().over(Window.partitionBy("query_id", "doc").orderBy(F.desc("w"), "first_pos"))).where(F.col("r") <= params.feedback_terms)
    kept = best.select("query_id", "term").distinct()
    return kept.withColumn("term_pos", F.row_number().over(Window.partitionBy("query_id").orderBy("term")) - 1).select("query_id", "term_pos", "term")


def frontier(picks: DataFrame, edges: DataFrame, docs: DataFrame, folders: DataFrame | None = None, cochange: DataFrame | None = None, params: RankParams = RankParams()) -> DataFrame:
    """(query_id, doc, weight, source, source_rank, pos, linked): neighbours, one step
    from the query's sources, that are no picks and have full prior.

    ``edges`` is (src, dst), ``folders`` (doc, folder), ``cochange`` (src, dst, n, rank). A candidate belongs to the first source that reaches it; ``linked`` tells
    whether that or another source reaches it by an edge or by strong co-change.
    """
    source = picks.where(F.col("rank") <= params.sources).select("query_id", F.col("doc").alias("src"), F.col("score").alias("weight"), F.col("rank").alias("source_rank"))
    source = sized_broadcast(source, 96)
    kinds = [edges.select("src", "dst", F.lit(0).alias("kind"), F.lit(0).alias("pos"), F.lit(True).alias("link"))]
    if cochange is not None:
        kinds.append(cochange.select("src", "dst", F.lit(2).alias("kind"), F.col("rank").cast("int").alias("pos"), (F.col("n") >= params.strong_cochange).alias("link")))
    near = kinds[0]
    for more in kinds[1:]:
        near = near.unionByName(more)
    reached = source.join(near, "src")
    if folders is not None:
        # from the sources' folders outwards: never all pairs of a folder
        beside = source.join(folders.select(F.col("doc").alias("src"), "folder"), "src").join(folders.select(F.col("doc").alias("dst"), "folder"), "folder")
        reached = reached.unionByName(beside.select(*source.columns, "dst", F.lit(1).alias("kind"), F.lit(0).alias("pos"), F.lit(False).alias("link")))
    reached = reached.where("src <> dst").join(docs.where("prior = 1.0").select(F.col("doc").alias("dst"), "ord"), "dst")
    reached = reached.join(picks.select("query_id", F.col("doc").alias("dst")), ["query_id", "dst"], "left_anti")
    best = reached.groupBy("query_id", "dst").agg(F.min(F.struct("source_rank", "kind", "pos", "ord", "src", "weight")).alias("first"), F.array_sort(F.collect_set(F.when(F.col("link"), F.col("source_rank")))).alias("linked"))
    return best.select("query_id", F.col("dst").alias("doc"), "first.weight", F.col("first.src").alias("source"), "first.source_rank", F.struct("first.source_rank", "first.kind", "first.pos", "first.ord").alias("pos"), "linked")


def additions(pool: DataFrame, scores: DataFrame, feedback: DataFrame, path_hits: DataFrame | None = None, params: RankParams = RankParams()) -> DataFrame:
    """(query_id, doc, add_score, add_rank): which candidates join the picks, in order.

    First the best eligible ones whose path holds a telling term of the query
    (``path_hits``: query_id, doc), then for each source its best linked candidate,
    then its best own one, then the best until there are ``fill``. Scores combine
    the query's and the feedback's (both normalised) with the pool weight.
    """
    joined = pool.join(scores.select("query_id", "doc", F.col("score").alias("bm")), ["query_id", "doc"], "left").join(feedback.select("query_id", "doc", F.col("score").alias("fb")), ["query_id", "doc"], "left")
    known = joined.select("query_id", "doc", "weight", "source_rank", "pos", "linked", F.coalesce("bm", F.lit(0.0)).alias("bm"), F.coalesce("fb", F.lit(0.0)).alias("fb"))
    value = (F.lit(0.15) + F.col("bm") + 0.8 * F.col("fb")) * (F.lit(0.5) + 0.5 * F.col("weight"))
    own = Window.partitionBy("query_id")
    valued = known.select("*", value.alias("add_score"))
    rows = settled(valued.select("*", (F.col("add_score") >= params.eligible * F.max("add_score").over(own)).alias("eligible"), F.row_number().over(own.orderBy(F.desc("add_score"), "pos")).alias("place")))  # each phase reads it
    good = rows.where("eligible")
    phases = []
    if path_hits is not None:
        hit = good.join(path_hits.select("query_id", "doc").distinct(), ["query_id", "doc"], "left_semi")
        hit = hit.withColumn("r", F.row_number().over(own.orderBy("place"))).where(F.col("r") <= params.path_hits)
        phases.append(hit.select("query_id", "doc", F.struct(F.lit(0).alias("phase"), F.col("r").cast("long").alias("at")).alias("key")))
    linked = good.select("*", F.explode("linked").alias("by"))
    linked = linked.withColumn("r", F.row_number().over(Window.partitionBy("query_id", "by").orderBy("place"))).where("r = 1")
    phases.append(linked.select("query_id", "doc", F.struct(F.lit(1).alias("phase"), F.col("by").cast("long").alias("at")).alias("key")))
    owned = good.withColumn("r", F.row_number().over(Window.partitionBy("query_id", "source_rank").orderBy("place"))).where("r = 1")
    phases.append(owned.select("query_id", "doc", F.struct(F.lit(2).alias("phase"), F.col("source_rank").cast("long").alias("at")).alias("key")))
    phases.append(rows.select("query_id", "doc", F.struct(F.lit(3).alias("phase"), F.col("place").cast("long").alias("at")).alias("key")))
    chosen = phases[0]
    for more in phases[1:]:
        chosen = chosen.unionByName(more)
    firsts = chosen.groupBy("query_id", "doc").agg(F.min("key").alias("key")).withColumn("add_rank", F.row_number().over(own.orderBy("key")))
    kept = firsts.where((F.col("key.phase") < 3) | (F.col("add_rank") <= params.fill))
    return kept.join(rows.select("query_id", "doc", "add_score", "bm", "fb"), ["query_id", "doc"]).select("query_id", "doc", "add_score", "bm", "fb", "add_rank")


def telling_path_hits(terms: DataFrame, paths: DataFrame, n_files: int) -> DataFrame:
    """(query_id, doc): files whose path has a query term of over 3 characters that
    under a tenth of all paths have."""
    rare = paths.groupBy("term").agg(F.count_distinct("path").alias("n")).where((F.length("term") > 3) & (F.col("n") / F.lit(max(1, n_files)) < 0.10)).select("term")
    return terms.join(rare, "term", "left_semi").join(paths, "term").select("query_id", F.col("path").alias("doc")).distinct()


def message_top_up(messages: DataFrame, chosen: DataFrame, docs: DataFrame, params: RankParams = RankParams()) -> DataFrame:
    """(query_id, doc, r): up to three files of full prior, not chosen yet, that score
    well in the message field."""
    own = Window.partitionBy("query_id")
    good = messages.withColumn("best", F.max("score").over(own)).where(F.col("score") >= params.message_floor * F.col("best"))
    good = good.join(docs.where("prior = 1.0").select("doc"), "doc", "left_semi").join(chosen.select("query_id", "doc"), ["query_id", "doc"], "left_anti")
    return ranked(good, name="r").where(F.col("r") <= params.message_files).select("query_id", "doc", "r")


def tf_cosine(a: DataFrame, b: DataFrame) -> DataFrame:
    """(query_id, doc, cosine) of all pairs that share a term; ``a`` is (query_id, term,
    tf), ``b`` (doc, term, tf)."""
    na = a.groupBy("query_id").agg(F.sqrt(F.sum(F.col("tf") * F.col("tf")).cast("double")).alias("na"))
    few = sized_broadcast(a.select("query_id", "term", F.col("tf").alias("q")), 64)
    nb = b.groupBy("doc").agg(F.sqrt(F.sum(F.col("tf") * F.col("tf")).cast("double")).alias("nb"))
    dots = b.join(few, "term").groupBy("query_id", "doc").agg(F.sum(F.col("q") * F.col("tf")).alias("dot"))
    return dots.join(na, "query_id").join(nb, "doc").select("query_id", "doc", (F.col("dot") / (F.col("na") * F.col("nb"))).alias("cosine"))


def vector_top_k(queries: DataFrame, vectors: DataFrame, k: int = 12) -> DataFrame:
    """(query_id, id, score, rank): the ``k`` vectors of the largest dot product with
    each query vector; ``queries`` is (query_id, q), ``vectors`` (id, v)."""
    few = sized_broadcast(queries, 4096)
    dot = F.aggregate(F.zip_with("q", "v", lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    scored = vectors.crossJoin(few).select("query_id", "id", dot.alias("score"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)


def prefix_rerank(results: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Ranks with the files under a query's chosen folders first; order is kept."""
    marked = results.withColumn("prefix", text.top_folders(F.col("doc"))).join(prefixes.select("query_id", "prefix", F.lit(0).alias("late")).distinct(), ["query_id", "prefix"], "left")
    return marked.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.coalesce("late", F.lit(1)), "rank"))).drop("late", "prefix")


def gram_overlap(a: DataFrame, b: DataFrame, n: int = 5, least: float = 0.0) -> DataFrame:
    """(query_id, doc, overlap) of all pairs with a common character n-gram, and an overlap
    of at least ``least``: the share of the n-grams of ``a`` (query_id, text) that ``b``
    (doc, text) has. Documents in several rows have the sum of their rows' shares."""
    asked = a.select("query_id", "text").collect()  # questions, not documents
    named = a.sparkSession.createDataFrame([(i, r["query_id"]) for i, r in enumerate(asked)], T.StructType([T.StructField("q", T.IntegerType()), a.schema["query_id"]]))
    several = repeated(b)
    found = grams.overlaps([r["text"] or "" for r in asked], b, n, 0.0 if several else least)
    if several:
        found = found.groupBy("q", "doc").agg(F.sum("overlap").alias("overlap")).where(F.col("overlap") >= least)
    return found.join(F.broadcast(named), "q").select("query_id", "doc", "overlap")
