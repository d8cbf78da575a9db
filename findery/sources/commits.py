"""Commit logs of git work trees."""

from __future__ import annotations

import logging
import re
import subprocess
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "seq int, ts long, author string, message string, files array<string>"
_MARK = "__C__"


def looks_like_path(line: str) -> bool:
    """A file name as git prints it: no blanks, and a dot or a slash in it."""
    return bool(line) and not re.search(r"\s", line) and ("/" in line or "." in line)


def split_body(body: str) -> tuple[str, list[str]]:
    """(message, files): the last block between blank lines lists files if all of its
    lines look like paths."""
    blocks = [b for b in re.split(r"\n\s*\n", body.strip("\n")) if b.strip()]
    if not blocks:
        return "", []
    names = [x.strip() for x in blocks[-1].split("\n") if x.strip()]
    if all(looks_like_path(x) for x in names):
        return "\n\n".join(blocks[:-1]), names
    return "\n\n".join(blocks), []


def parse_log(log: str) -> Iterator[tuple[int, int, str, str, list[str]]]:
    """Rows of the commit table, newest first."""
    for seq, entry in enumerate(x for x in log.split(_MARK) if x.strip()):
        head, _, body = entry.partition("\n")
        fields = head.split("\0")
        if len(fields) < 3:
            continue
        rest, files = split_body(body)
        yield seq, int(fields[0]) if fields[0].isdigit() else 0, fields[1], "\n".join(x for x in (fields[2], rest) if x), files


def git_commits(spark: SparkSession, root: str, most: int = 5000) -> DataFrame:
    """(seq, ts, author, message, files) of the newest ``most`` commits without merges;
    an empty table, with a warning, where there is no history."""
    rows: list = []
    try:
        done = subprocess.run(["git", "-C", root, "log", "--no-merges", "-n", str(most), f"--pretty=format:{_MARK}%at%x00%an%x00%s%n%b", "--name-only"], capture_output=True, check=True)
        rows = list(parse_log(done.stdout.decode("utf-8", "replace")))
    except (OSError, subprocess.CalledProcessError):
        pass
    if not rows:
        logging.getLogger(__name__).warning("no commit history at %s: ranking goes without it", root)
    return spark.createDataFrame(rows, SCHEMA)
