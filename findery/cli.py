"""The command line: one question over one tree, as a bundle, a file list or JSON.

Exit codes: 0 with results, 1 without any, 2 for arguments that make no sense.
"""

from __future__ import annotations

import argparse
import json
import math
import os
import sys
import time

from findery.operators import pack

#: How text is cut before its pieces are encoded, for ``--vocabulary``.
PATTERN = r"(?i:'s|'t|'re|'ve|'m|'ll|'d)|[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}{1,3}| ?[^\s\p{L}\p{N}]+[\r\n]*|\s*[\r\n]+|\s+(?!\S)|\s+"


def _arguments(argv: list[str] | None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="findery", description="Ranks the files of a source tree for a question and packs their best regions into a token budget.")
    p.add_argument("query")
    p.add_argument("path", nargs="?", default=".")
    p.add_argument("--budget", type=int, default=8192, help="tokens of the bundle")
    p.add_argument("--k", type=int, default=0, help="files to keep; 0 keeps all")
    p.add_argument("--pad-lines", type=int, default=5)
    p.add_argument("--len-exp", type=float, default=0.85)
    p.add_argument("--vocabulary", help="a byte-level BPE rank file to count tokens with")
    for flag in ("files-only", "json", "no-cache", "reindex", "no-history", "no-docs", "no-anchors", "no-testbridge", "explain"):
        p.add_argument(f"--{flag}", action="store_true")
    args = p.parse_args(argv)
    wrong = next((m for bad, m in ((args.budget <= 0, "--budget must be positive"), (args.k < 0, "--k must be >= 0"), (args.pad_lines < 0, "--pad-lines must be >= 0"), (not math.isfinite(args.len_exp), "--len-exp must be finite"), (not os.path.isdir(args.path), f"not a directory: {args.path}")) if bad), None)
    if wrong:
        p.error(wrong)  # exit code 2
    return args


def _session():
    from pyspark.sql import SparkSession

    made = SparkSession.getActiveSession()
    if made is None:
        made = SparkSession.builder.master("local[*]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
        made.sparkContext.setLogLevel("ERROR")
    return made


def main(argv: list[str] | None = None, out=None, err=None) -> int:
    out, err = out or sys.stdout, err or sys.stderr
    args = _arguments(argv)
    from .plans import cache, retrieval

    count = pack.bpe_counter(args.vocabulary, PATTERN) if args.vocabulary else pack.count_words
    spark, began = _session(), time.time()
    corpus, kind = cache.load_or_build(spark, args.path, cache.store_path(args.path), not args.no_history, not args.no_docs, not args.no_cache, args.reindex)
    n_files = corpus.files.count()
    indexed = time.time()
    asked = spark.createDataFrame([(1, args.query)], "query_id int, question string")
    sure = retrieval.confidence(corpus, asked).first()
    selected, packed = [], []
    if not sure["zero_match"]:
        chosen = retrieval.truncate(retrieval.select_files(corpus, asked, use_anchors=not args.no_anchors, use_tests=not args.no_testbridge), args.k)
        selected = sorted(chosen.collect(), key=lambda r: r["rank"])
        params = pack.PackParams(args.budget, args.pad_lines, args.len_exp)
        packed = sorted(retrieval.pack_bundles(corpus, asked, chosen, params, count).collect(), key=lambda r: r["position"])
    bundle = "\n\n".join(f"### {r['path']}\n{r['body']}" for r in packed)
    tokens = count(bundle) if bundle else 0
    stats = {
        "files_indexed": n_files, "index_ms": round((indexed - began) * 1000), "query_ms": round((time.time() - indexed) * 1000), "bundle_tokens": tokens, "cache": "hit" if kind == "unchanged" else "miss",
        "top_score": sure["top_score"], "matched_query_terms": sure["matched"], "total_query_terms": sure["total"],
    }
    if sure["low_confidence"]:
        stats["low_confidence"] = True
    if args.explain:
        print(json.dumps([{"path": r["path"], "rank": r["rank"], "score": r["score"], "channel": r["channel"]} for r in selected], indent=2), file=err)
    if args.json:
        files = [{"path": r["path"], "score_rank": i} for i, r in enumerate(packed)]
        print(json.dumps({"query": args.query, "files": files, "regions": {r["path"]: [[s["a"], s["b"]] for s in r["spans"]] for r in packed}, "bundle": bundle, "stats": stats}), file=out)
    elif packed:
        print("\n".join(r["path"] for r in packed) if args.files_only else bundle, file=out)
    note = " [low-confidence match]" if sure["low_confidence"] and not sure["zero_match"] else ""
    print(f"findery: {len(packed)} files, {tokens} tokens (indexed {n_files} files, index {stats['index_ms']}ms, query {stats['query_ms']}ms, cache {stats['cache']}){note}", file=err)
    if sure["zero_match"]:
        print("findery: none of the question's terms occurs in the tree", file=err)
    elif not packed:
        print("findery: the question's terms occur, but in no file that can be packed", file=err)
    return 0 if packed else 1
