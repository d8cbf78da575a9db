"""Further rankings: ad-hoc BM25 over small candidate sets, reciprocal-rank fusion,
resolution of stack frames, and retrieval within the neighbourhood of telling files.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scan
from .index import Vectors, idf, settled, sized_broadcast
from .rank import ordered_sum


def candidate_bm25(terms: DataFrame, candidates: Vectors, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query_id, doc, score): plain BM25 whose statistics are those of each query's own
    candidates. ``candidates`` are vectors with a ``query_id``, ``terms`` is (query_id,
    term); a term that a query repeats counts as often. Each candidate's score is summed
    where it is read, in order of spelling."""
    counts: dict = {}
    for r in scan.frequencies(candidates.rows, "query_id").collect():  # terms of questions
        counts.setdefault(r["g"], {})[r["t"]] = r["n"]
    weights = {g: np.zeros(len(candidates.numbers)) for g in counts}
    for r in terms.groupBy("query_id", "term").agg(F.count("*").alias("times")).collect():
        own, t = counts.get(r["query_id"], {}), candidates.numbers.get(r["term"])
        if t in own:
            weights[r["query_id"]][t] = r["times"] * math.log(1.0 + (own[-1] - own[t] + 0.5) / (own[t] + 0.5))
    return scan.group_scores(candidates.rows, "query_id", weights, {g: own[-2] / own[-1] for g, own in counts.items()}, k1, b)


def reciprocal_ranks(*rankings: DataFrame, k: int = 60) -> DataFrame:
    """(query_id, doc, score): the sum over rankings (query_id, doc, rank) of 1 / (k + rank)."""
    parts = None
    for i, ranking in enumerate(rankings):
        own = ranking.select("query_id", "doc", F.struct(F.lit(i).alias("i"), (F.lit(1.0) / (k + F.col("rank"))).alias("c")).alias("part"))
        parts = own if parts is None else parts.unionByName(own)
    return parts.groupBy("query_id", "doc").agg(F.collect_list("part").alias("parts")).select("query_id", "doc", ordered_sum("parts").alias("score"))


def resolve_frames(frames: DataFrame, files: DataFrame) -> DataFrame:
    """(frame, path): the longest path of ``files`` (path) that a stack frame's file name
    ends with; of equally long ones there is only one. Every suffix of a frame is looked
    up, so this is an equi-join whose keys are paths."""
    n = F.length("frame")
    tried = frames.select("frame").distinct().where(n > 0).select("frame", F.explode(F.transform(F.sequence(F.lit(1), n), lambda i: F.substr("frame", i))).alias("path"))
    return tried.join(files.select("path"), "path").groupBy("frame").agg(F.max_by("path", F.length("path")).alias("path"))


def neighbourhood_seeds(terms: DataFrame, posted: DataFrame, n_docs: int, docs: DataFrame, anchors: DataFrame | None = None, rare: float = 0.02, most: int = 10) -> DataFrame:
    """(query_id, doc, score): each query's ``most`` files with the largest sum of idf of
    rare query terms (in under ``rare`` of all files), and its ``anchors`` (query_id, doc,
    strength), which come before them. Equal sums go by the corpus order of ``docs``."""
    few = terms.select("query_id", "term").distinct()
    hits = posted.join(sized_broadcast(few.select("term").distinct(), 32), "term", "left_semi").select("doc", "term")
    df = hits.groupBy("term").agg(F.count("*").alias("df")).where(F.col("df") / F.lit(n_docs) < rare)
    parts = few.join(df, "term").join(hits, "term").select("query_id", "doc", F.struct("term", idf(F.lit(float(n_docs)), F.col("df")).alias("c")).alias("part"))
    summed = parts.groupBy("query_id", "doc").agg(F.collect_list("part").alias("parts")).select("query_id", "doc", ordered_sum("parts").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "ord")
    top = summed.join(docs.select("doc", "ord"), "doc").withColumn("r", F.row_number().over(order)).where(F.col("r") <= most).select("query_id", "doc", "score")
    if anchors is not None:
        top = top.unionByName(anchors.select("query_id", "doc", (F.lit(1000.0) + F.col("strength")).alias("score")))
    return top.groupBy("query_id", "doc").agg(F.max("score").alias("score"))


def neighbourhood(seeds: DataFrame, edges: DataFrame, hops: int = 2, cap: int = 800) -> DataFrame:
    """(query_id, doc, hop): the files within ``hops`` steps of the seeds (query_id, doc,
    score) over ``edges`` (src, dst: imports and folders), at most ``cap`` a query, which
    is the operator's documented limit: nearer files first, within a step those reached
    from the seed (or file) of the higher place, then by path."""
    edges = settled(edges.select("src", "dst"))
    first = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc")
    region = settled(seeds.withColumn("place", F.row_number().over(first).cast("long")).select("query_id", "doc", F.lit(0).alias("hop"), "place"))
    front = region
    for hop in range(1, hops + 1):
        # at most ``cap`` a query: edges are read past them, and repeated ones don't matter
        reached = edges.join(sized_broadcast(front.select("query_id", F.col("doc").alias("src"), "place"), 64), "src").groupBy("query_id", "dst").agg(F.min("place").alias("via"))
        new = reached.withColumnRenamed("dst", "doc").join(region.select("query_id", "doc"), ["query_id", "doc"], "left_anti")
        size = region.groupBy("query_id").agg(F.count("*").alias("size"))
        order = Window.partitionBy("query_id").orderBy("via", "doc")
        placed = new.withColumn("r", F.row_number().over(order)).join(size, "query_id").where(F.col("size") + F.col("r") <= cap)
        front = settled(placed.select("query_id", "doc", F.lit(hop).alias("hop"), F.col("r").cast("long").alias("place")))
        region = region.unionByName(front)
    return region.select("query_id", "doc", "hop")


def within(scores: DataFrame, region: DataFrame, least: int = 30) -> DataFrame:
    """``scores`` (query_id, doc, ...) of the files in each query's region; a query whose
    region has under ``least`` files keeps all of its scores."""
    large = region.groupBy("query_id").agg((F.count("*") >= least).alias("large"))
    marked = scores.join(large, "query_id", "left").join(region.select("query_id", "doc", F.lit(True).alias("inside")), ["query_id", "doc"], "left")
    return marked.where(F.col("inside").isNotNull() | ~F.coalesce("large", F.lit(False))).drop("large", "inside")
