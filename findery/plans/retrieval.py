"""The whole retrieval: from files and questions to ranked files and packed bundles."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from findery.functions import text
from findery.operators import channels, graph, history, index, pack, rank


@dataclass
class Corpus:
    """The index of a set of files. All parts are DataFrames; ``save`` and ``load``
    keep them as Parquet."""

    files: DataFrame
    body: DataFrame
    sizes: DataFrame
    paths: DataFrame
    symbols: DataFrame
    authored: DataFrame
    messages: DataFrame | None = None
    cochange: DataFrame | None = None
    pages: DataFrame | None = None
    page_terms: DataFrame | None = None
    comments: DataFrame | None = None

    def save(self, path: str) -> None:
        for name, part in vars(self).items():
            if part is not None:
                part.write.mode("overwrite").parquet(f"{path}/{name}")

    @classmethod
    def load(cls, spark, path: str) -> Corpus:
        jpath = spark._jvm.org.apache.hadoop.fs.Path
        fs = jpath(path).getFileSystem(spark._jsc.hadoopConfiguration())
        return cls(**{name: spark.read.parquet(f"{path}/{name}") if fs.exists(jpath(f"{path}/{name}")) else None for name in cls.__dataclass_fields__})


def build(files: DataFrame, commits: DataFrame | None = None, pages: DataFrame | None = None, comments: bool = False) -> Corpus:
    """Indexes ``files`` (see ``sources.corpus.describe``), with their history and
    documentation where given."""
    docs = files.select(F.col("path").alias("doc"), "text")
    # kept for this session; ``save`` and ``load`` serve later ones
    body = index.settled(index.postings(docs))
    out = Corpus(files, body, index.settled(index.lengths(body)), index.settled(index.path_terms(files)), index.settled(index.definitions(files)), index.settled(graph.authored_edges(files)))
    if commits is not None:
        rows = history.touched(commits, files)
        strong = index.settled(history.top_cochange(history.cochange_counts(rows)))
        bridges = history.bridge_cochange(strong, lambda p: p.rlike(text.TEST_LIKE))
        out.cochange = index.settled(history.merge_bridges(strong, bridges))
        said = history.file_messages(rows, commits)
        out.messages = index.settled(index.postings(said.select(F.col("path").alias("doc"), F.col("message").alias("text")), field="message"))
    if pages is not None:
        out.pages = pages
        out.page_terms = index.settled(index.postings(pages.select(F.col("path").alias("doc"), "text"), field="docs"))
    if comments:
        noted = files.select(F.col("path").alias("doc"), text.comments(F.col("path"), F.col("text")).alias("text"))
        out.comments = index.postings(noted, field="comment")
    return out


def select_files(corpus: Corpus, queries: DataFrame, params: rank.RankParams = rank.RankParams(), expand: bool = True, use_anchors: bool = True, use_tests: bool = True) -> DataFrame:
    """(query_id, path, rank, score, channel) for ``queries`` (query_id, question).

    Ranked files come first, then what feedback, graph and history add, with the
    channels' files spliced in; ``score`` is normalised by the query's best.
    """
    files = corpus.files
    docs = files.select(F.col("path").alias("doc"), "ord", "prior")
    terms = index.settled(rank.query_terms(queries))
    raw = index.settled(rank.bm25(terms, corpus.body, corpus.sizes, docs, corpus.paths, corpus.comments, params))
    scores = index.settled(rank.normalize(raw))
    # lists of a few dozen rows a query; kept, as most of what follows reads them
    picks = index.settled(rank.top_picks(scores, params))
    chosen = picks.select("query_id", F.col("doc").alias("path"), F.col("rank").cast("long").alias("rank"), "score")
    linked = index.settled(graph.symmetric(corpus.authored))
    if expand:
        n_docs = corpus.sizes.count()
        more = index.settled(rank.feedback_terms(picks, corpus.body, terms, n_docs, docs, params))
        feedback = index.settled(rank.normalize(rank.bm25(more, corpus.body, corpus.sizes, docs, corpus.paths, corpus.comments, params)))
        folder = files.select(F.col("path").alias("doc"), F.col("parent").alias("folder"))
        partners = corpus.cochange.select(F.col("path").alias("src"), F.col("other").alias("dst"), "n", "rank") if corpus.cochange is not None else None
        pool = index.settled(rank.frontier(picks, linked, docs, folder, partners, params))
        hits = index.settled(rank.telling_path_hits(terms, corpus.paths, files.count()))
        added = index.settled(rank.additions(pool, scores, feedback, hits, params))
        raised = added.select("query_id", F.col("doc").alias("path"), (F.lit(1000) + F.col("add_rank")).cast("long").alias("rank"), F.greatest("bm", F.lit(0.3) + 0.5 * F.col("fb")).alias("score"))
        chosen = chosen.unionByName(raised)
        if corpus.messages is not None:
            told = rank.bm25(terms, corpus.messages, index.lengths(corpus.messages), docs, params=params, b=0.5)
            top = rank.message_top_up(told, chosen.select("query_id", F.col("path").alias("doc")), docs, params)
            extra = top.join(scores.select("query_id", "doc", "score"), ["query_id", "doc"], "left").join(feedback.select("query_id", "doc", F.col("score").alias("fb")), ["query_id", "doc"], "left")
            lifted = F.greatest(F.coalesce("score", F.lit(0.0)), F.lit(0.3) + 0.5 * F.coalesce("fb", F.lit(0.0)))
            chosen = chosen.unionByName(extra.select("query_id", F.col("doc").alias("path"), (F.lit(2000) + F.col("r")).cast("long").alias("rank"), lifted.alias("score")))
    chosen = index.settled(chosen)
    anchored = channels.anchors(queries, corpus.symbols) if use_anchors else None
    tested = channels.test_bridge(raw, files, linked) if use_tests else None
    told = None
    if corpus.pages is not None:
        pages = rank.bm25(terms, corpus.page_terms, index.lengths(corpus.page_terms), params=params)
        told = channels.docs_bridge(pages, corpus.pages, graph.python_modules(files))
    placed = channels.splice(chosen, anchored, tested, told)
    known = chosen.select("query_id", "path", "score").unionByName(scores.select("query_id", F.col("doc").alias("path"), "score")).groupBy("query_id", "path").agg(F.max("score").alias("score"))
    return placed.join(known, ["query_id", "path"], "left").select("query_id", "path", "rank", F.coalesce("score", F.lit(0.0)).alias("score"), "channel")


def truncate(selected: DataFrame, k: int) -> DataFrame:
    """The first ``k`` files of each query; 0 keeps all."""
    return selected.where(F.col("rank") <= k) if k else selected


def pack_bundles(corpus: Corpus, queries: DataFrame, selected: DataFrame, params: pack.PackParams = pack.PackParams(), count: Callable[[str], int] = pack.count_words) -> DataFrame:
    """Packs every query's selected files; see ``operators.pack``."""
    terms = rank.query_terms(queries)
    df = index.term_stats(corpus.body).join(terms.select("term").distinct(), "term", "left_semi")
    weights = pack.term_weights(terms.select("query_id", "term"), df, corpus.sizes.count())
    anchored = channels.anchors(queries, corpus.symbols).select("query_id", "path", "symbols")
    return pack.pack(selected, corpus.files, weights, anchored, params, count)


def confidence(corpus: Corpus, queries: DataFrame, params: rank.RankParams = rank.RankParams()) -> DataFrame:
    """(query_id, top_score, matched, total, zero_match, low_confidence)."""
    terms = rank.query_terms(queries)
    fields = [p for p in (corpus.body, corpus.comments, corpus.page_terms, corpus.messages) if p is not None]
    cover = index.coverage(terms, index.vocabulary(*fields, paths=corpus.paths))
    docs = corpus.files.select(F.col("path").alias("doc"), "ord", "prior")
    best = rank.bm25(terms, corpus.body, corpus.sizes, docs, corpus.paths, corpus.comments, params).groupBy("query_id").agg(F.max("score").alias("top"))
    rows = queries.select("query_id").join(cover, "query_id", "left").join(best, "query_id", "left").fillna({"matched": 0, "total": 0, "top": 0.0})
    return rows.select("query_id", F.col("top").alias("top_score"), "matched", "total", (F.col("matched") == 0).alias("zero_match"), index.low_confidence(F.col("top"), F.col("matched"), F.col("total")).alias("low_confidence"))


def ranks_of(selected: DataFrame, wanted: DataFrame) -> DataFrame:
    """(query_id, path, rank) of wanted files; null where one isn't listed."""
    return wanted.join(selected.select("query_id", "path", "rank"), ["query_id", "path"], "left")


def peaked(selected: DataFrame, share: float = 0.5) -> DataFrame:
    """(query_id, peaked): whether the first three files have ``share`` of the scores."""
    own = Window.partitionBy("query_id")
    return selected.withColumn("total", F.sum("score").over(own)).groupBy("query_id").agg((F.sum(F.when(F.col("rank") <= 3, F.col("score")).otherwise(0.0)) / F.max("total") >= share).alias("peaked"))
