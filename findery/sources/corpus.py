"""Files as relations: scans, manifests, record files, and the sinks that go with them."""

from __future__ import annotations

import json
import os
import re
import subprocess

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from findery.functions import text

MAX_BYTES, MAX_LINE, MAX_DOC_BYTES, MAX_DOCS = 2_000_000, 3000, 500_000, 4000


def tracked_files(root: str) -> list[str] | None:
    """Tracked and untracked but not ignored files of a git work tree; None outside one."""
    try:
        out = subprocess.run(["git", "-C", root, "ls-files", "-z", "--cached", "--others", "--exclude-standard"], capture_output=True, check=True).stdout
    except (OSError, subprocess.CalledProcessError):
        return None
    return sorted({p for p in out.decode("utf-8", "replace").split("\0") if p and os.path.isfile(os.path.join(root, p))}, key=lambda p: p.split("/"))


def scan(spark: SparkSession, root: str) -> DataFrame:
    """(path, mtime, size, content) of all files below ``root``, but for git's own and,
    in a work tree, ignored ones. Contents are only read where they are used."""
    base = os.path.abspath(root)
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load("file://" + base)
    path = F.expr(f"substring(path, {len('file:' + base) + 2})")
    rows = rows.select(path.alias("path"), F.col("modificationTime").alias("mtime"), F.col("length").alias("size"), "content").where(~F.col("path").rlike(r"(^|/)\.(git|findery_cache)/"))
    kept = tracked_files(root)
    return rows if kept is None else rows.join(F.broadcast(spark.createDataFrame([(p,) for p in kept], "path string")), "path", "left_semi")


def manifest(scanned: DataFrame) -> DataFrame:
    """(path, mtime, size) of the code files; contents stay unread."""
    return scanned.where(text.is_code(F.col("path"))).select("path", "mtime", "size")


@F.pandas_udf(T.StringType())
def lossy_utf8(contents: pd.Series) -> pd.Series:
    """Bytes as UTF-8, what is none replaced by U+FFFD."""
    return contents.map(lambda b: bytes(b).decode("utf-8", "replace"), na_action="ignore")


def with_order(rows: DataFrame) -> DataFrame:
    """``ord``: the corpus order of paths, by their parts. An array of parts sorts the
    same way, so no global numbering is needed."""
    return rows.withColumn("ord", text.path_key(F.col("path")))


def code_files(scanned: DataFrame) -> DataFrame:
    """(path, ord, parent, suffix, text, prior, n_lines) of the files worth indexing:
    code, not vendored, neither large nor with very long lines, and not without terms."""
    path = F.col("path")
    rows = scanned.where(text.is_code(path) & ~text.is_vendored(path) & (F.col("size") <= MAX_BYTES))
    rows = rows.select("path", lossy_utf8("content").alias("text"))
    return describe(rows.where(F.coalesce(F.array_max(F.transform(text.split_lines(F.col("text")), F.length)), F.lit(0)) <= MAX_LINE).where(F.exists(text.identifiers(F.col("text")), lambda w: F.size(text.identifier_terms(w)) > 0)))


def describe(rows: DataFrame) -> DataFrame:
    """A table (path, text) with what the engine needs to know of each file."""
    path = F.col("path")
    return with_order(rows).select("path", "ord", text.parent(path).alias("parent"), text.suffix(path).alias("suffix"), "text", text.path_prior(path).alias("prior"), F.size(text.split_lines(F.col("text"))).alias("n_lines"))


def documentation(scanned: DataFrame, limit: int = MAX_DOCS) -> DataFrame:
    """(path, ord, text) of documentation pages: the first ``limit`` paths (the scan's
    documented bound), of these the ones that aren't too large."""
    path = F.col("path")
    rows = scanned.where(text.suffix(path).isin(".rst", ".txt", ".md") & ~path.rlike(r"(?i)(^|/)tests?/"))
    first = with_order(rows.select("path", "size")).orderBy("ord").limit(limit).where(F.col("size") <= MAX_DOC_BYTES).select("path", "ord")
    return scanned.join(F.broadcast(first), "path").select("path", "ord", lossy_utf8("content").alias("text"))


# ---- records


def blobs_at(spark: SparkSession, root: str, wanted: list[tuple[str, str]]) -> DataFrame:
    """(rev, path, text) of files as they were at a revision; null where there was none.
    ``wanted`` are (rev, path) pairs, such as the gold files of a set of tasks."""

    def show(rev: str, path: str) -> str | None:
        done = subprocess.run(["git", "-C", root, "show", f"{rev}:{path}"], capture_output=True)
        return None if done.returncode else done.stdout.decode("utf-8", "replace")

    return spark.createDataFrame([(rev, path, show(rev, path)) for rev, path in wanted], "rev string, path string, text string")


def path_aliases(root: str) -> dict[str, list[str]]:
    """Import aliases of a TypeScript project: prefix -> folders, from the ``paths`` of the
    root's ``tsconfig.json`` or ``tsconfig.base.json``. Comments and trailing commas are
    read over; a file that can't be read has none."""
    for name in ("tsconfig.json", "tsconfig.base.json"):
        try:
            with open(os.path.join(root, name), encoding="utf-8", errors="replace") as source:
                plain = re.sub(r"(?<!:)//[^\n]*", "", source.read())
            options = json.loads(re.sub(r",\s*(?=[}\]])", "", plain)).get("compilerOptions") or {}
        except (OSError, ValueError, AttributeError):
            continue
        base, bare, out = options.get("baseUrl") or ".", lambda x: x.removesuffix("/*"), {}
        for alias, folders in (options.get("paths") or {}).items():
            found = [bare(f) for f in folders if isinstance(f, str)] if isinstance(folders, list) else []
            if found:
                out[bare(alias)] = found if base == "." else [os.path.normpath(os.path.join(base, f)) for f in found]
        if out:
            return out
    return {}


def missing_repositories(tasks: DataFrame, present: DataFrame, key: str = "repo") -> DataFrame:
    """(repo, n): how many tasks need a repository that ``present`` (repo) lacks."""
    return tasks.groupBy(key).agg(F.count("*").alias("n")).join(present.select(key).distinct(), key, "left_anti")


def strided(rows: DataFrame, order: str, offset: int = 0, stride: int = 1, limit: int | None = None) -> DataFrame:
    """Every ``stride``-th row from ``offset`` on, in the order of a column. Numbers come
    from counts by partition of the sorted rows, not from one global window."""
    ordered = rows.orderBy(order)
    numbered = ordered.rdd.zipWithIndex().map(lambda x: (*x[0], x[1])).toDF([*rows.columns, "_at"]) if rows.columns else rows
    found = numbered.where((F.col("_at") >= offset) & ((F.col("_at") - offset) % stride == 0))
    if limit is not None:
        found = found.where((F.col("_at") - offset) / stride < limit)
    return found.drop("_at")


def json_records(spark: SparkSession, paths: list[str] | str, key: str = "instance_id", schema=None) -> DataFrame:
    """Records of one or several JSON-lines files; an id that occurs twice is an error."""
    rows = spark.read.json(paths, schema=schema) if schema else spark.read.json(paths)
    twice = rows.groupBy(key).count().where("count > 1").limit(5).collect()
    if twice:
        raise ValueError(f"repeated {key}: {[r[key] for r in twice]}")
    return rows


def pending(tasks: DataFrame, done: DataFrame, key: str = "instance_id") -> DataFrame:
    """The tasks that have no result yet."""
    return tasks.join(done.select(key), key, "left_anti")


def flat_record(rows: DataFrame) -> DataFrame:
    """Nested task records (org, repo, number, base, fix_patch, resolved_issues) as flat rows."""
    return rows.select(
        F.concat_ws("__", "org", F.concat_ws("-", "repo", F.col("number").cast("string"))).alias("instance_id"), F.concat_ws("/", "org", "repo").alias("repo"), F.col("base.sha").alias("base_commit"), F.col("fix_patch").alias("patch"),
        F.array_join(F.transform("resolved_issues", lambda i: F.concat_ws("\n", i["title"], i["body"])), "\n\n").alias("problem_statement"),
    )


def issue_filter(rows: DataFrame, least_chars: int = 200, most_files: int = 5) -> DataFrame:
    """Mined issues that serve as tasks: a body to go by and few enough gold files."""
    return rows.where((F.length("body") >= least_chars) & F.size("gold_files").between(1, most_files))


def closed_before(rows: DataFrame, base: str = "base_date", closed: str = "closed_at") -> DataFrame:
    """Issues closed strictly before the task's base date (ISO 8601 with zone)."""
    return rows.where(F.to_timestamp(closed) < F.to_timestamp(base))


def snippets(found: DataFrame) -> DataFrame:
    """(query_id, bundle): ranked chunks (query_id, rank, path, start_line, end_line, score,
    text) as one text, each under a heading with its place and score, in a fence."""
    block = F.concat(F.lit("### "), "path", F.lit(":"), "start_line", F.lit("-"), "end_line", F.format_string(" (score=%.3f)", "score"), F.lit("\n```\n"), "text", F.lit("\n```"))
    rows = found.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", block.alias("block")))).alias("b"))
    return rows.select("query_id", F.array_join("b.block", "\n\n").alias("bundle"))


def trajectories(tasks: DataFrame, packed: DataFrame, version: str, budget: int) -> DataFrame:
    """One-step trajectory records of retrieval runs: ``tasks`` (instance_id, repo_url,
    base_commit) with the files and spans of ``packed`` (query_id, path, spans)."""
    spans = F.transform("spans", lambda s: F.struct(s["a"].alias("start"), s["b"].alias("end")))
    found = packed.where(F.size("spans") > 0).groupBy(F.col("query_id").cast("string").alias("instance_id")).agg(F.array_sort(F.collect_list(F.struct("path", spans.alias("spans")))).alias("f"))
    files, by = F.coalesce("f.path", F.array().cast("array<string>")), F.map_from_entries(F.coalesce("f", F.array().cast("array<struct<path:string,spans:array<struct<start:int,end:int>>>>")))
    rows = tasks.withColumn("instance_id", F.col("instance_id").cast("string")).join(found, "instance_id", "left")
    step = F.struct(files.alias("files"), by.alias("spans"))
    data = F.struct(F.array(step).alias("pred_steps"), files.alias("pred_files"), by.alias("pred_spans"))
    return rows.select("instance_id", F.coalesce("repo_url", F.lit("")).alias("repo_url"), F.col("base_commit").alias("commit"), data.alias("traj_data"), F.lit("").alias("model_patch"), F.lit(version).alias("engine_version"), F.lit(budget).alias("engine_budget"))


def append_records(rows: DataFrame, path: str) -> None:
    """Appends results as JSON lines; ``pending`` then leaves out what is done."""
    rows.write.mode("append").json(path)


def payload(results: DataFrame) -> DataFrame:
    """(query_id, json): each query's files, regions, bundle and figures as one JSON text."""
    return results.select("query_id", F.to_json(F.struct(*[c for c in results.columns if c != "query_id"])).alias("json"))
