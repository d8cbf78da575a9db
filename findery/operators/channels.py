"""Further evidence for a ranking: symbols that a question names, tests, documentation.

Each channel finds candidate files with joins; how they enter the list depends on
what entered before, so the lists (of some forty files a query) are spliced by
``splice`` with one row a query.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from findery.functions import text

from .graph import resolve_modules
from .index import sized_broadcast

_CODE_SPANS = "(?s)(`{3}.*?`{3}|`[^`\\n]+`)"
_NAMES = "[A-Za-z_][A-Za-z0-9_]{3,}"
_DOTTED = r"\b(?:[A-Za-z_]\w*\.){2,}[A-Za-z_]\w*\b"
_DIRECTIVES = r"(?:auto(?:class|function|module)|(?:current)?module)::\s*([\w.]+)"


def question_symbols(queries: DataFrame) -> DataFrame:
    """(query_id, symbol, at, in_code): identifiers of at least four characters in each
    question, in order; ``in_code`` if any occurrence stands in a code span."""
    outside = F.split("question", _CODE_SPANS, -1)
    inside = F.regexp_extract_all("question", F.lit(_CODE_SPANS), F.lit(1))
    # a question is a series of plain text, code, plain text ...
    pieces = F.flatten(F.transform(outside, lambda x, i: F.array(F.struct(x.alias("s"), F.lit(False).alias("code")), F.struct(F.coalesce(F.get(inside, i), F.lit("")).alias("s"), F.lit(True).alias("code")))))
    rows = queries.select("query_id", F.posexplode(pieces).alias("p", "piece"))
    names = rows.select("query_id", "p", F.col("piece.code").alias("code"), F.posexplode(F.regexp_extract_all("piece.s", F.lit(_NAMES), F.lit(0))).alias("i", "symbol"))
    named = names.where(~F.lower("symbol").isin(*text.STOP_WORDS))
    return named.groupBy("query_id", "symbol").agg(F.min(F.struct("p", "i")).alias("at"), F.max("code").alias("in_code"))


def anchors(queries: DataFrame, definitions: DataFrame, most_files: int = 3) -> DataFrame:
    """(query_id, path, strength, n_files, anchor_rank, symbols): files that define a
    symbol the question names, if at most ``most_files`` do. Code spans and compound
    names make an anchor stronger."""
    known = definitions.where(F.col("n_files") <= most_files)
    named = known.join(sized_broadcast(question_symbols(queries), 96), "symbol")
    strength = F.when(F.col("in_code"), 2.0).otherwise(1.0) + F.when((F.col("symbol") != F.lower("symbol")) | F.col("symbol").contains("_"), 0.5).otherwise(0.0)
    rows = named.select("query_id", "path", "ord", "symbol", "at", "n_files", strength.alias("strength"))
    best = rows.groupBy("query_id", "path").agg(
        F.min(F.struct((-F.col("strength")).alias("s"), "at", "n_files")).alias("best"), F.min(F.struct("at", "ord")).alias("first"), F.array_sort(F.collect_set(F.struct("at", "symbol"))).alias("named")
    )
    order = Window.partitionBy("query_id").orderBy(F.asc("best.s"), F.asc("best.n_files"), "first")
    return best.select("query_id", "path", (-F.col("best.s")).alias("strength"), F.col("best.n_files").alias("n_files"), F.row_number().over(order).alias("anchor_rank"), F.col("named.symbol").alias("symbols"))


def test_bridge(scores: DataFrame, files: DataFrame, edges: DataFrame, most: int = 3) -> DataFrame:
    """(query_id, path, test, bridge_rank): product files that the best tests import,
    those that few tests import first. ``edges`` is symmetric, scores are raw."""
    is_test = F.col("path").rlike(text.TEST_LIKE) & text.suffix(F.col("path")).isin(".py", ".go", ".rs", ".js", ".ts")
    tests = files.where(is_test).select("path")
    found = scores.join(tests.withColumnRenamed("path", "doc"), "doc", "left_semi").where("score > 0")
    own = Window.partitionBy("query_id")
    top = found.withColumn("r", F.row_number().over(own.orderBy(F.desc("score"), "doc"))).where(F.col("r") <= most)
    top = top.withColumn("share", F.col("score") / F.max("score").over(own))
    near = edges.join(sized_broadcast(top.select("query_id", F.col("doc").alias("src"), "share", "r"), 96), "src").where(text.path_prior(F.col("dst")) == 1.0)
    best = near.groupBy("query_id", F.col("dst").alias("path")).agg(F.min(F.struct((-F.col("share")).alias("s"), "r", "src")).alias("best"))
    importers = edges.join(tests.withColumnRenamed("path", "dst"), "dst", "left_semi").groupBy(F.col("src").alias("path")).agg(F.count("*").alias("n"))
    worth = -F.col("best.s") / F.log(F.lit(2.0) + F.coalesce("n", F.lit(0)))
    rows = best.join(importers, "path", "left").select("query_id", "path", F.col("best.src").alias("test"), worth.alias("worth"))
    return rows.withColumn("bridge_rank", F.row_number().over(own.orderBy(F.desc("worth"), "path"))).drop("worth")


def docs_bridge(scores: DataFrame, pages: DataFrame, modules: DataFrame, most: int = 3) -> DataFrame:
    """(query_id, path, n_pages, docs_rank): product modules that the best pages of
    documentation name. ``pages`` is (path, text), ``modules`` (module, path)."""
    own = Window.partitionBy("query_id")
    top = scores.where("score > 0").withColumn("r", F.row_number().over(own.orderBy(F.desc("score"), "doc"))).where(F.col("r") <= most)
    few = top.select("query_id", F.col("doc").alias("path"), "r")
    named = F.array_union(F.regexp_extract_all("text", F.lit(_DOTTED), F.lit(0)), F.regexp_extract_all("text", F.lit(_DIRECTIVES), F.lit(1)))
    read = pages.join(few.select("path").distinct(), "path", "left_semi").select(F.col("path").alias("src"), F.explode(named).alias("ref"))
    hits = resolve_modules(read, modules).select(F.col("src").alias("page"), "path").distinct().where(text.path_prior(F.col("path")) == 1.0)
    counted = hits.join(few.withColumnRenamed("path", "page"), "page").groupBy("query_id", "path").agg(F.count("*").alias("n_pages"), F.min("r").alias("best_rank"))
    return counted.withColumn("docs_rank", F.row_number().over(own.orderBy(F.desc("n_pages"), "best_rank", "path"))).drop("best_rank")


def splice_lists(files: list[str], anchored: list[tuple[str, float]], tested: list[str], documented: list[str]) -> tuple[list[str], list[tuple[str, str]]]:
    """(list, [(file, channel)]). Strong anchors go to place 8 (from beyond place 10 or
    from outside, two at most), weak ones to place 13, files of tests to place 15
    (three) and of documentation to place 17 (two). Files put in at a place one by
    one end up in reverse order there."""
    out, why = list(files), []
    head: list[str] = []
    for path, strength in anchored:
        if strength >= 2.0 and len(head) < 2 and path not in head and path not in out[:10]:
            head.append(path)
    if head:
        rest = [p for p in out if p not in head]
        out = rest[:7] + head + rest[7:]
        why += [(p, "anchor_head") for p in head]
    weak = [p for p, strength in anchored if strength < 2.0]
    for channel, candidates, most, place in (("anchor_tail", weak, 2, 12), ("test", tested, 3, 14), ("docs", documented, 2, 16)):
        fresh = [p for p in dict.fromkeys(candidates) if p not in out][:most]
        for path in fresh:
            out.insert(min(len(out), place), path)
        why += [(p, channel) for p in fresh]
    return out, why


def splice(ranked: DataFrame, anchored: DataFrame | None = None, tested: DataFrame | None = None, documented: DataFrame | None = None) -> DataFrame:
    """(query_id, path, rank, channel): the lists of ``ranked`` (query_id, path, rank)
    with the channels' files in their places; ``channel`` is null for ranked files."""
    lists = ranked.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "path")))["path"].alias("files"))
    empty = F.array()

    def add(lists: DataFrame, found: DataFrame | None, order: str, name: str, value: Column) -> DataFrame:
        if found is None:
            return lists.withColumn(name, empty.cast("array<string>" if name != "anchored" else "array<struct<path:string,strength:double>>"))
        rows = found.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(order, value.alias("v"))))["v"].alias(name))
        return lists.join(rows, "query_id", "left")

    lists = add(lists, anchored, "anchor_rank", "anchored", F.struct("path", "strength"))
    lists = add(lists, tested, "bridge_rank", "tested", F.col("path"))
    lists = add(lists, documented, "docs_rank", "documented", F.col("path"))

    @F.pandas_udf("array<struct<path:string,channel:string>>")
    def place(files: pd.Series, anchored: pd.Series, tested: pd.Series, documented: pd.Series) -> pd.Series:
        def one(f, a, t, d):
            out, why = splice_lists(list(f), [(x["path"], x["strength"]) for x in (a if a is not None else [])], list(t) if t is not None else [], list(d) if d is not None else [])
            channels = dict(why)
            return [{"path": p, "channel": channels.get(p)} for p in out]

        return pd.Series([one(*row) for row in zip(files, anchored, tested, documented)])

    placed = lists.select("query_id", F.posexplode(place("files", "anchored", "tested", "documented")).alias("at", "x"))
    return placed.select("query_id", F.col("x.path").alias("path"), (F.col("at") + 1).alias("rank"), F.col("x.channel").alias("channel"))
