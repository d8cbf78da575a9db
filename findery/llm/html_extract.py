"""Main text of web pages by composite text density.

For every node of the DOM the density is the number of characters per tag of its
subtree, adjusted for links: multiplied by the logarithm of (characters per link
character times tags per link tag), to a base that grows with the share of link
characters in the node and in the whole body. Summing the densities of a node's
children favours nodes that hold a run of dense paragraphs. The least density on
the path from the node with the largest sum up to the body is the threshold; of
the nodes that reach it, the one with the largest sum is the content.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import fresh, map_arrow, text_slices

_OTHER = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)", re.S)
_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_VALUE = re.compile(r"=\s*$")
#: Levels of nesting after which elements no longer nest (as in browsers).
_DEEPEST = 512
#: What may stand in the head; anything else ends it.
_IN_HEAD = frozenset("title meta link script style base basefont bgsound noframes noscript template head html".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_SKIP = frozenset("script style noscript template textarea title head svg iframe select".split())
_RAW = frozenset("script style textarea title iframe".split())
_BLOCK = frozenset("address article aside blockquote body br center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table tbody td tfoot th thead tr ul".split())
#: Start tags that end an open paragraph.
_ENDS_P = _BLOCK - {"br", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "li", "dd", "dt"} | {"p"}
_SIBLINGS = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}), "td": ({"td", "th"}, {"tr"}), "th": ({"td", "th"}, {"tr"}), "option": ({"option"}, {"select"})}
_SPACE = re.compile(r"\s+")


def _tokens(source: str):
    """(text, closing, name, attributes, jump) in order: a text, or a tag (with no text).
    ``jump`` skips the content of the tag just given. Each mark is looked up in a sorted
    list, so time grows with the page's length, whatever its markup."""
    where = {c: [] for c in "<>\"'"}
    for found in re.finditer("[<>\"']", source):
        where[found[0]].append(found.start())
    size, at = len(source), 0
    ends: dict[str, list[tuple[int, int]]] = {}

    def after(mark: str, begin: int) -> int:
        k = bisect_left(where[mark], begin)
        return where[mark][k] if k < len(where[mark]) else -1

    def tag_end(begin: int) -> int:
        """Where the tag that began before ``begin`` ends; quoted values may hold its mark."""
        plain, here = after(">", begin), begin
        while True:
            close = after(">", here)
            if close < 0:
                return plain  # a quote that never ends: the first mark counts
            quotes = [q for q in (after('"', here), after("'", here)) if 0 <= q < close]
            if not quotes:
                return close
            q = min(quotes)
            here = q + 1
            if _VALUE.search(source, max(begin, q - 8), q):
                shut = after(source[q], q + 1)
                if shut < 0:
                    return plain
                here = shut + 1

    def jump(name: str) -> None:
        nonlocal at
        if name not in ends:
            ends[name] = [(m.start(), m.end()) for m in re.finditer(f"</{name}\\s*>", source, re.I)]
        k = bisect_left(ends[name], (at, 0))
        at = ends[name][k][1] if k < len(ends[name]) else size

    text = begin = 0
    while 0 <= (begin := after("<", begin)):
        other = _OTHER.match(source, begin)
        found = None if other else _NAME.match(source, begin)
        if not other and not found:
            begin += 1  # just a character
            continue
        if begin > text:
            yield source[text:begin], False, "", "", jump
        if other:
            at = other.end()
        else:
            end = tag_end(found.end())
            if end < 0:
                return  # the page ends within a tag
            at = end + 1
            yield None, found[1] == "/", found[2].lower(), source[found.end() : end], jump
        text = begin = at
    if text < size:
        yield source[text:], False, "", "", jump


class Dom:
    """Nodes in document order (so a parent has a smaller number than its children);
    node 0 is the body. ``texts`` holds (node, text) in order; a null text is a line break."""

    def __init__(self, source: str):
        self.parent, self.tag = [-1], ["body"]
        self.texts: list[tuple[int, str | None]] = []
        stack = [0]
        skip, skipping = 0, ""
        for text, closing, name, rest, jump in _tokens(source):
            if text is not None:
                if skipping == "head" and text.strip():
                    skipping = ""
                if not skipping:
                    self.texts.append((stack[-1], text))
                continue
            if skipping == "head" and not closing:
                if name in _RAW or name in ("noscript", "template"):
                    jump(name)
                    continue
                if name not in _IN_HEAD:
                    skipping = ""
            if skipping:
                if name == skipping:
                    skip += -1 if closing else 1
                    if skip == 0:
                        skipping = ""
                elif name == "body" and not closing:
                    skipping, skip = "", 0
                continue
            if name in ("html", "body"):
                continue
            if closing:
                for depth in range(len(stack) - 1, 0, -1):
                    if self.tag[stack[depth]] == name:
                        del stack[depth:]
                        break
                if name in _BLOCK:
                    self.texts.append((stack[-1], None))
                continue
            if name in _SKIP:
                if not rest.rstrip().endswith("/"):
                    if name in _RAW:
                        jump(name)
                    else:
                        skipping, skip = name, 1
                continue
            self._imply(stack, name)
            self.parent.append(stack[-1])
            self.tag.append(name)
            if name in _BLOCK:
                self.texts.append((stack[-1], None))
            if name not in _VOID and not rest.endswith("/") and len(stack) < _DEEPEST:
                stack.append(len(self.tag) - 1)

    def _imply(self, stack: list[int], name: str) -> None:
        """Closes what the start of ``name`` ends without an end tag."""
        if name in _ENDS_P:
            closes, until = {"p"}, {"table", "td", "th", "button", "div", "article", "section"}
        elif name in _SIBLINGS:
            closes, until = _SIBLINGS[name]
        else:
            return
        cut = 0
        for depth in range(len(stack) - 1, 0, -1):
            tag = self.tag[stack[depth]]
            if tag in until:
                break
            if tag in closes:
                cut = depth
        if cut:
            del stack[cut:]


def densities(dom: Dom) -> tuple[list[float], list[float]]:
    """Composite text density of each node, and the sum over its children."""
    n = len(dom.tag)
    chars, tags, link_chars, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
    in_link = [False] * n
    for i in range(1, n):
        in_link[i] = in_link[dom.parent[i]] or dom.tag[i] == "a"
    for node, text in dom.texts:
        if text is not None:
            size = len(_SPACE.sub(" ", html.unescape(text) if "&" in text else text).strip())
            chars[node] += size
            if in_link[node]:
                link_chars[node] += size
    for i in range(n - 1, 0, -1):
        up = dom.parent[i]
        chars[up] += chars[i]
        link_chars[up] += link_chars[i]
        tags[up] += tags[i] + 1
        link_tags[up] += link_tags[i] + (dom.tag[i] == "a")
    share = link_chars[0] / max(1, chars[0])
    density, total = [0.0] * n, [0.0] * n
    for i in range(n - 1, -1, -1):
        c, t, lc, lt = chars[i], max(1, tags[i]), link_chars[i], max(1, link_tags[i])
        if c:
            base = math.log(c / max(1, c - lc) * lc + share * c + math.e)
            inner = c / max(1, lc) * t / lt
            # a base of just 1 (no links at all) is the natural logarithm's
            density[i] = c / t * math.log(max(inner, 1.0)) / math.log(max(base, math.e))
        if i:
            total[dom.parent[i]] += density[i]
    return density, total


def content_node(density: list[float], total: list[float], parent: list[int]) -> int:
    best = max(range(len(total)), key=lambda i: (total[i], -i))
    threshold, i = density[best], best
    while i > 0:
        i = parent[i]
        threshold = min(threshold, density[i])
    good = [i for i in range(len(total)) if density[i] >= threshold]
    return max(good, key=lambda i: (total[i], -i))


def text_of(dom: Dom, top: int) -> str:
    """The text below ``top``: white space collapsed, a line for each block."""
    inside = [False] * len(dom.tag)
    inside[top] = True
    for i in range(1, len(inside)):
        if inside[dom.parent[i]]:
            inside[i] = True
    lines, line = [], []
    for node, text in [*dom.texts, (top, None)]:
        if not inside[node]:
            continue
        if text is None:
            if done := _SPACE.sub(" ", "".join(line)).strip():
                lines.append(done)
            line = []
        else:
            line.append(html.unescape(text) if "&" in text else text)
    return "\n".join(lines)


def extract_one(source: str) -> tuple[str, str, float]:
    """(content, tag of its node, density sum) of one page."""
    dom = Dom(source)
    density, total = densities(dom)
    top = content_node(density, total, dom.parent)
    return text_of(dom, top), dom.tag[top], total[top]


def extract(pages: DataFrame, html_col: str = "html", text_out: str = "content", tag_out: str = "content_tag", sum_out: str = "density_sum") -> DataFrame:
    """``pages`` with the main text of each page, the tag of the chosen node and its
    density sum.

    Defined results: a null page has null text, tag and sum; an empty one, or one
    without text, has an empty text. Equal sums go to the node first in the document
    (the outer one). Broken markup is read leniently; scripts, styles, comments and
    the head count neither as text nor as tags; the head ends at its end tag, at the
    body's start or at the first tag or text that can't stand in it. Elements more than
    512 deep don't nest any further. Pages of any length are read whole, in time that
    grows with their length. Rows are independent, so repeated rows repeat their result;
    an empty table gives an empty table. Output columns get underscores in front where
    ``pages`` has a column of the name (in any case of letters).
    """
    text_out, tag_out, sum_out = names = fresh(pages, text_out, tag_out, sum_out)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, html_col):
            made = [(None, None, None) if x is None else extract_one(x) for x in batch.column(html_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.string()), pa.array([m[2] for m in made], pa.float64())], names=[*batch.schema.names, *names])

    return map_arrow(pages, work, T.StructType([*pages.schema.fields, T.StructField(text_out, T.StringType()), T.StructField(tag_out, T.StringType()), T.StructField(sum_out, T.DoubleType())]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html")).select("page_id", "content", "content_tag", "density_sum")
