"""Import graphs from source text, and propagation over graphs.

An *authored* edge (src, dst) says that src imports dst; the graph used for ranking
is its symmetric view, so replacing a file's authored edges is all an update takes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from findery.functions import text

from .index import settled, tasks_for

_JS_TRIES = ("", ".js", ".ts", ".jsx", ".tsx", "/index.js", "/index.ts")


def python_modules(files: DataFrame) -> DataFrame:
    """(module, path): dotted names of Python files; a package's file also has the
    package's name. Of files with the same name the last in corpus order counts."""
    py = files.where(F.col("path").endswith(".py")).select("path", "ord", F.regexp_replace(F.regexp_replace("path", r"\.py$", ""), "/", ".").alias("module"))
    package = py.where(F.col("module").endswith(".__init__")).withColumn("module", F.regexp_replace("module", r"\.__init__$", ""))
    return py.unionByName(package).groupBy("module").agg(F.max_by("path", "ord").alias("path"))


def _prefixes(dotted: Column) -> Column:
    """A dotted name and all its prefixes, longest first."""
    parts = F.filter(F.split(dotted, r"\."), lambda p: p != "")
    return F.when(F.size(parts) > 0, F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))).otherwise(F.array().cast("array<string>"))


def resolve_modules(refs: DataFrame, modules: DataFrame) -> DataFrame:
    """(src, ref, path): each dotted reference's longest known prefix."""
    tried = refs.select("src", "ref", F.posexplode(_prefixes(F.col("ref"))).alias("at", "module"))
    return tried.join(modules, "module").groupBy("src", "ref").agg(F.min_by("path", "at").alias("path"))


def _python_refs(files: DataFrame) -> DataFrame:
    py = files.where(F.col("path").endswith(".py"))
    plain = py.select(F.col("path").alias("src"), F.explode(F.regexp_extract_all("text", F.lit(r"(?Udm)^[ \t]*import[ \t]+([^\n#]+)"), F.lit(1))).alias("names"))
    plain = plain.select("src", F.explode(F.split("names", ",")).alias("n")).select("src", F.regexp_extract(F.trim("n"), r"^([\w.]+)", 1).alias("ref"))
    # from X import a, b: X itself, and X.a where that is a module
    from_ = r"(?Udm)^[ \t]*from[ \t]+([.\w]+)[ \t]+import[ \t]+(\([^)]*\)|[^\n#]+)"
    pairs = py.select(F.col("path").alias("src"), F.explode(F.arrays_zip(F.regexp_extract_all("text", F.lit(from_), F.lit(1)).alias("m"), F.regexp_extract_all("text", F.lit(from_), F.lit(2)).alias("names"))).alias("z")).select("src", "z.m", "z.names")
    dots = F.length(F.regexp_extract("m", r"^(\.*)", 1))
    folder = F.when(F.col("src").contains("/"), F.split(text.parent(F.col("src")), "/")).otherwise(F.array().cast("array<string>"))
    base = F.slice(folder, F.lit(1), F.greatest(F.size(folder) - (dots - 1), F.lit(0)))
    rest = F.regexp_replace("m", r"^\.+", "")
    whole = F.when(dots == 0, F.col("m")).otherwise(F.array_join(F.filter(F.concat(base, F.array(rest)), lambda p: p != ""), "."))
    named = pairs.select("src", whole.alias("m"), F.explode(F.regexp_extract_all(F.regexp_replace("names", r"\bas\s+\w+", ""), F.lit(r"(\w+)"), F.lit(1))).alias("n"))
    joined = named.select("src", F.concat_ws(".", F.when(F.col("m") != "", F.col("m")), F.col("n")).alias("ref"))
    return plain.unionByName(joined).where("ref <> ''").distinct()


def _candidates(files: DataFrame, pattern: str, suffixes: tuple[str, ...]) -> DataFrame:
    own = files.where(text.suffix(F.col("path")).isin(*suffixes))
    return own.select(F.col("path").alias("src"), F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(pattern), F.lit(1)))).alias("ref"))


def authored_edges(files: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """(src, dst) of ``files`` (path, ord, text): imports of Python, JavaScript and
    TypeScript (relative ones), Rust and Go that lead to a file of the corpus. Given
    ``sources``, only those files are read for imports."""
    sources = files if sources is None else sources
    known = files.select(F.col("path").alias("dst"))
    modules = python_modules(files)
    python = resolve_modules(_python_refs(sources), modules).select("src", F.col("path").alias("dst"))
    js = _candidates(sources, r"""(?Ud)(?:from|require\(|import\(|import)\s*['"](\.{1,2}/[^'"]*)['"]""", (".js", ".ts", ".jsx", ".tsx"))
    base = text.normalize_path(F.concat_ws("/", text.parent(F.col("src")), F.col("ref")))
    tries = js.select("src", "ref", base.alias("base")).select("src", "ref", F.posexplode(F.array(*[F.concat(F.col("base"), F.lit(x)) for x in _JS_TRIES])).alias("at", "dst"))
    script = tries.join(known, "dst").groupBy("src", "ref").agg(F.min_by("dst", "at").alias("dst")).select("src", "dst")
    folder = F.when(F.col("src").rlike(r"(^|/)(mod|lib|main)\.rs$"), text.parent(F.col("src"))).otherwise(F.regexp_replace("src", r"\.rs$", ""))
    mods = _candidates(sources, r"(?Udm)^\s*(?:pub(?:\([^)]*\))?\s+)?mod\s+(\w+)\s*;", (".rs",))
    rust_tries = mods.select("src", F.explode(F.array(folder, text.parent(F.col("src")))).alias("at"), "ref")
    uses = _candidates(sources, r"(?Ud)\buse\s+(?:crate|super|self)::(\w+)", (".rs",))
    root = F.regexp_extract("src", r"^(.*?(?:^|/)src)/", 1)
    rust_tries = rust_tries.unionByName(uses.select("src", F.explode(F.array(F.when(root != "", root).otherwise(text.parent(F.col("src"))), text.parent(F.col("src")), folder)).alias("at"), "ref"))
    rust_paths = rust_tries.select("src", F.explode(F.array(F.concat_ws("/", "at", F.concat("ref", F.lit(".rs"))), F.concat_ws("/", "at", "ref", F.lit("mod.rs")))).alias("dst"))
    rust = rust_paths.select("src", text.normalize_path(F.col("dst")).alias("dst")).join(known, "dst").select("src", "dst")
    go = _candidates(sources, r'(?Ud)"([^"\s]+)"', (".go",)).select("src", F.element_at(F.split("ref", "/"), -1).alias("name"))
    packages = files.where(F.col("path").endswith(".go") & F.col("path").contains("/")).select(F.col("path").alias("dst"), text.parent_name(F.col("path")).alias("name"))
    golang = go.join(packages, "name").select("src", "dst")
    return python.unionByName(script).unionByName(rust).unionByName(golang).where("src <> dst").distinct()


def symmetric(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def replace_authored(edges: DataFrame, changed: DataFrame, files: DataFrame) -> DataFrame:
    """Authored edges with those of the ``changed`` files (path) read anew; an edge
    that the other side still authors stays in the symmetric view. Only the changed
    files' texts are read."""
    fresh = authored_edges(files, files.join(changed.select("path"), "path", "left_semi").select(files.columns))
    return edges.join(changed.select(F.col("path").alias("src")), "src", "left_anti").select("src", "dst").unionByName(fresh.select("src", "dst"))


def same_folder(files: DataFrame, block: int = 2048) -> DataFrame:
    """(src, dst) of files in the same folder. A folder's files are paired in blocks of
    about ``block`` squared, so that a large folder is the work of many tasks; there are as
    many tasks as the counted pairs need."""
    own = files.select("path", text.parent(F.col("path")).alias("folder"))
    sizes = settled(own.groupBy("folder").agg(F.count("*").alias("size")).where(F.col("size") > 1))
    pairs = sizes.agg(F.sum(F.col("size").cast("double") * F.col("size"))).first()[0] or 0.0
    tasks = int(min(20_000, 1 + pairs // (2 * block * block)))
    # parts by hash: as many as the folder needs
    placed = own.join(sizes, "folder").select("path", "folder", F.ceil(F.col("size") / block).cast("int").alias("parts")).withColumn("part", F.pmod(F.xxhash64("path"), F.col("parts")).cast("int"))
    others = F.sequence(F.lit(0), F.col("parts") - 1)
    a = placed.select("folder", F.col("path").alias("src"), F.col("part").alias("i"), F.explode(others).alias("j"))
    b = placed.select("folder", F.col("path").alias("dst"), F.explode(others).alias("i"), F.col("part").alias("j"))
    keys = ["folder", "i", "j"]
    return a.repartition(tasks, *keys).join(b.repartition(tasks, *keys), keys).where("src <> dst").select("src", "dst")


def combined(edges: DataFrame, files: DataFrame) -> DataFrame:
    return symmetric(edges).unionByName(same_folder(files)).distinct()


# ---- propagation: weights are (query_id, node, w)


def _degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src").agg(F.count("*").alias("degree"))


def _spread(edges: DataFrame) -> DataFrame:
    """(src, dst, degree), computed once for all rounds."""
    edges = settled(edges.select("src", "dst"))
    return settled(edges.join(_degrees(edges), "src"))


def pagerank(seeds: DataFrame, edges: DataFrame, alpha: float = 0.85, rounds: int = 3, least: float = 1e-12) -> DataFrame:
    """(query_id, node, w): a random walk that restarts at the seeds (query_id, node,
    w), ``rounds`` steps. A node without edges keeps what would have left it. Each step has
    as many tasks as the edges that it takes need: a walk's fan-out shows in no table's size."""
    total = F.sum("w").over(Window.partitionBy("query_id"))
    start = settled(seeds.withColumn("w", F.col("w") / total))
    edges = settled(edges.select("src", "dst"))
    degrees = settled(_degrees(edges))
    n_edges = edges.count()
    now = start
    for i in range(rounds):
        weighed = now.join(degrees.withColumnRenamed("src", "node"), "node", "left").select("query_id", "node", (F.lit(alpha) * F.col("w") / F.coalesce("degree", F.lit(1))).alias("w"), F.coalesce("degree", F.lit(1)).alias("degree"))
        weighed = settled(weighed)
        taken = weighed.agg(F.sum("degree")).first()[0] or 0
        tasks = tasks_for(edges, max(n_edges / 2, taken))
        moved = weighed.repartition(tasks, "node").join(edges.repartition(tasks, F.col("src")), F.col("node") == F.col("src"), "left")
        passed = moved.select("query_id", F.coalesce("dst", "node").alias("node"), "w")
        # each task first sums its own, so it holds no more groups than it takes edges
        summed = passed.unionByName(start.select("query_id", "node", (F.lit(1 - alpha) * F.col("w")).alias("w")))
        now = summed.groupBy("query_id", "node").agg(F.sum("w").alias("w")).where(F.col("w") > least)
        if i + 1 < rounds:
            now = settled(now)
    return now


def propagate(weights: DataFrame, edges: DataFrame, beta: float = 1.0, share: float = 0.5) -> DataFrame:
    """One step: each node keeps its weight and gives ``share`` of it to its neighbours,
    divided by their degree to the power ``beta``; then weights sum to 1 again."""
    edges, weights = settled(edges.select("src", "dst")), settled(weights.select("query_id", "node", "w"))
    degree = _degrees(edges)
    near = edges.join(degree.select(F.col("src").alias("dst"), "degree"), "dst")
    given = weights.join(near, weights["node"] == near["src"]).select("query_id", F.col("dst").alias("node"), (F.lit(share) * F.col("w") / F.pow("degree", F.lit(beta))).alias("w"))
    summed = weights.select("query_id", "node", "w").unionByName(given).groupBy("query_id", "node").agg(F.sum("w").alias("w"))
    return summed.withColumn("w", F.col("w") / F.sum("w").over(Window.partitionBy("query_id")))


def heat(weights: DataFrame, edges: DataFrame, coefficients: tuple[float, ...] = (0.6, 0.3, 0.1)) -> DataFrame:
    """A truncated heat kernel: the weighted sum of 0, 1, 2 ... steps of the walk."""
    spread = _spread(edges)
    step, out = settled(weights.select("query_id", "node", "w")), None
    for i, c in enumerate(coefficients):
        if i:
            step = step.join(spread, step["node"] == spread["src"]).groupBy("query_id", F.col("dst").alias("node")).agg(F.sum(F.col("w") / F.col("degree")).alias("w"))
        part = step.select("query_id", "node", (F.lit(c) * F.col("w")).alias("w"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("query_id", "node").agg(F.sum("w").alias("w"))


def hops(seeds: DataFrame, edges: DataFrame, most: int = 3) -> DataFrame:
    """(query_id, node, hops): the distance from the nearest seed (query_id, node)."""
    edges = settled(edges.select("src", "dst"))
    seen = settled(seeds.select("query_id", "node").distinct().withColumn("hops", F.lit(0)))
    front = seen
    for i in range(1, most + 1):
        reached = front.join(edges, front["node"] == edges["src"]).select("query_id", F.col("dst").alias("node")).distinct()
        front = reached.join(seen.select("query_id", "node"), ["query_id", "node"], "left_anti").withColumn("hops", F.lit(i))
        if i < most:
            front = settled(front)
        seen = seen.unionByName(front)
    return seen


def anchor_distance(seeds: DataFrame, edges: DataFrame, most: int = 3) -> DataFrame:
    """(query_id, node, score): one over one plus the hops."""
    return hops(seeds, edges, most).select("query_id", "node", (F.lit(1.0) / (1 + F.col("hops"))).alias("score"))
