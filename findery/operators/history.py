"""What a commit log says about files: messages, co-change and who worked on them.

``touched`` is (seq, path), one row for each file of each commit, newest commit first
by ``seq``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from findery.functions import text

from .index import settled, tasks_for


def touched(commits: DataFrame, files: DataFrame | None = None, code_only: bool = True) -> DataFrame:
    """(seq, path, n_files): the files of each commit that still exist; ``n_files``
    counts them before those that are no code are dropped."""
    rows = commits.select("seq", F.explode(F.array_distinct("files")).alias("path"))
    if files is not None:
        rows = rows.join(files.select("path"), "path", "left_semi")
    rows = rows.withColumn("n_files", F.count("*").over(Window.partitionBy("seq")))
    return rows.where(text.is_code(F.col("path"))) if code_only else rows


def file_messages(rows: DataFrame, commits: DataFrame, most: int = 25, max_chars: int = 40_000) -> DataFrame:
    """(path, message): the newest messages of each file, one below the other."""
    newest = rows.withColumn("r", F.row_number().over(Window.partitionBy("path").orderBy("seq"))).where(F.col("r") <= most)
    said = newest.select("path", "r", "seq").join(commits.select("seq", "message"), "seq")
    joined = said.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("r", "message"))).alias("m"))
    return joined.select("path", F.substring(F.array_join("m.message", "\n"), 1, max_chars).alias("message"))


def _file_sets(rows: DataFrame, max_files: int) -> DataFrame:
    return rows.where(F.col("n_files") <= max_files).groupBy("seq").agg(F.array_sort(F.collect_set("path")).alias("p"))


def cochange_edges(rows: DataFrame, max_files: int = 20) -> DataFrame:
    """(src, dst) of files that changed together in a commit of at most ``max_files``, both
    ways, once for each commit."""
    own = _file_sets(rows, max_files).select("p", F.explode("p").alias("src"))
    return own.select("src", F.explode("p").alias("dst")).where("src <> dst")


def cochange_counts(rows: DataFrame, max_files: int = 20) -> DataFrame:
    """(path, other, n, first_seq): in how many commits of at most ``max_files`` files
    two files changed together. Each commit's files are gathered once and paired in
    place, so a commit costs one shuffled row; pairs are counted in as many tasks as
    their number needs."""
    small = settled(_file_sets(rows, max_files))
    n = small.agg(F.sum(F.size("p") * (F.size("p") - 1) / 2)).first()[0] or 0
    pairs = small.select("seq", "p", F.posexplode("p").alias("i", "path")).select("seq", "path", F.explode(F.slice("p", F.col("i") + 2, F.greatest(F.size("p") - F.col("i") - 1, F.lit(0)))).alias("other"))
    counted = pairs.repartition(tasks_for(rows, n), "path", "other").groupBy("path", "other").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"))
    return counted.unionByName(counted.select(F.col("other").alias("path"), F.col("path").alias("other"), "n", "first_seq"))


def top_cochange(counts: DataFrame, least: int = 3, most: int = 10) -> DataFrame:
    """(path, other, n, rank): each file's strongest partners; equal counts go by the
    first common commit."""
    order = Window.partitionBy("path").orderBy(F.desc("n"), "first_seq", "other")
    return counts.where(F.col("n") >= least).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select("path", "other", "n", "rank")


def bridge_cochange(strong: DataFrame, is_test, least: int = 2, most: int = 50) -> DataFrame:
    """(path, other, n): production files that share a test as partner. ``is_test`` is
    a function of a path column; n is half the weaker of the two counts, at best."""
    toward = strong.where(is_test(F.col("other")) & ~is_test(F.col("path")))
    order = Window.partitionBy("other").orderBy(F.desc("n"), "path")
    toward = toward.withColumn("r", F.row_number().over(order)).where(F.col("r") <= most).select(F.col("other").alias("test"), "path", "n")
    second = toward.select("test", F.col("path").alias("other"), F.col("n").alias("m"))
    pairs = toward.join(second, "test").where("path <> other").withColumn("half", F.floor(F.least("n", "m") / 2))
    return pairs.where(F.col("half") >= least).groupBy("path", "other").agg(F.max("half").alias("n"))


def merge_bridges(strong: DataFrame, bridges: DataFrame, most: int = 10) -> DataFrame:
    """Partners with bridges merged in: the larger count of a pair, ranked anew."""
    both = strong.select("path", "other", "n", "rank").unionByName(bridges.select("path", "other", "n", F.lit(1 << 20).alias("rank")))
    best = both.groupBy("path", "other").agg(F.max("n").alias("n"), F.min("rank").alias("was"))
    order = Window.partitionBy("path").orderBy(F.desc("n"), "was", "other")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select("path", "other", "n", "rank")


def file_meta(rows: DataFrame, commits: DataFrame, authors: int = 5) -> DataFrame:
    """(path, n_commits, last_ts, authors): ``authors`` lists the most frequent ones."""
    joined = rows.select("seq", "path").join(commits.select("seq", "ts", "author"), "seq")
    counts = joined.groupBy("path", "author").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"))
    top = counts.withColumn("r", F.row_number().over(Window.partitionBy("path").orderBy(F.desc("n"), "first_seq"))).where(F.col("r") <= authors)
    named = top.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("r", "author", "n"))).alias("a"))
    total = joined.groupBy("path").agg(F.count("*").alias("n_commits"), F.min_by("ts", "seq").alias("last_ts"))
    return total.join(named, "path").select("path", "n_commits", "last_ts", F.transform("a", lambda x: F.struct(x["author"].alias("author"), x["n"].alias("n"))).alias("authors"))


def translation_table(commits: DataFrame, max_files: int = 20) -> DataFrame:
    """(message_term, path_term, p): how likely a path term is given a message term,
    by co-occurrence in commits of at most ``max_files`` files."""
    few = commits.where((F.size("files") > 0) & (F.size("files") <= max_files))
    said = few.select("seq", F.explode(F.array_distinct(text.tokenize(F.col("message")))).alias("message_term"))
    named = few.select("seq", F.explode(F.array_distinct(F.flatten(F.transform("files", text.path_tokens)))).alias("path_term"))
    counts = said.join(named, "seq").groupBy("message_term", "path_term").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("message_term"))
    return counts.select("message_term", "path_term", (F.col("n") / total).alias("p"))


def translate(terms: DataFrame, table: DataFrame, common: DataFrame | None = None, most: int = 15) -> DataFrame:
    """(query_id, term_pos, term): the path terms most likely for a query's terms;
    ``common`` (term) are left out."""
    found = terms.join(table, terms["term"] == table["message_term"]).groupBy("query_id", F.col("path_term").alias("term")).agg(F.sum("p").alias("p"))
    if common is not None:
        found = found.join(common.select("term"), "term", "left_anti")
    order = Window.partitionBy("query_id").orderBy(F.desc("p"), "term")
    return found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= most).select("query_id", (F.col("r") - 1).alias("term_pos"), "term")
