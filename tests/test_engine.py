import io
import json
import subprocess

import pytest

from findery.operators import channels, graph, history, index, lines, metrics, pack
from findery import cli
from findery.plans import cache, retrieval
from findery.sources import commits, corpus
from findery.streaming import refresh

FILES = [
    ("app/routing.py", "from app.handlers import handle_request\n\nclass RouteTable:\n    def resolve_route(self, path):\n        return handle_request(path)\n"),
    ("app/handlers.py", "from . import utils\n\ndef handle_request(path):\n    return utils.render(path)\n"),
    ("app/utils.py", "def render(path):\n    return path\n"),
    ("app/other.py", "def unrelated_thing():\n    return 1\n"),
    ("tests/test_routing.py", "from app.routing import RouteTable\n\ndef test_resolve_route():\n    assert RouteTable().resolve_route('a')\n"),
    ("web/a.js", "import { b } from './b';\nexport function first() {}\n"),
    ("web/b.js", "export class Second {}\n"),
]


@pytest.fixture(scope="module")
def files(spark):
    return corpus.describe(spark.createDataFrame(FILES, "path string, text string")).cache()


@pytest.fixture(scope="module")
def questions(spark):
    return spark.createDataFrame([("q1", "How does `RouteTable` resolve a route for a request?"), ("q2", "where is rendering done"), ("q3", "zzz")], "query_id string, question string")


def test_import_graph(files):
    assert {(r.src, r.dst) for r in graph.authored_edges(files).collect()} == {("app/routing.py", "app/handlers.py"), ("app/handlers.py", "app/utils.py"), ("tests/test_routing.py", "app/routing.py"), ("web/a.js", "web/b.js")}


@pytest.fixture(scope="module")
def built(files, spark):
    log = spark.createDataFrame([(i, 100 - i, "ann", "fix routing and handlers", ["app/routing.py", "app/handlers.py"]) for i in range(4)], commits.SCHEMA)
    pages = spark.createDataFrame([("docs/guide.md", "rendering is done by app.utils.render")], "path string, text string")
    return retrieval.build(files, log, pages)


def test_select_and_pack(built, questions):
    chosen = retrieval.select_files(built, questions).collect()
    q1 = [r.path for r in sorted((r for r in chosen if r.query_id == "q1"), key=lambda r: r.rank)]
    assert q1[0] == "app/routing.py" and "tests/test_routing.py" in q1 and len(q1) == len(set(q1))
    assert "app/handlers.py" in q1
    assert "app/utils.py" in [r.path for r in chosen if r.query_id == "q2"]
    packed = pack.bundles(retrieval.pack_bundles(built, questions, retrieval.select_files(built, questions))).collect()
    bundle = next(r.bundle for r in packed if r.query_id == "q1")
    assert bundle.startswith("### app/routing.py\n") and "class RouteTable" in bundle
    sure = {r.query_id: r for r in retrieval.confidence(built, questions).collect()}
    assert sure["q3"].zero_match and sure["q3"].low_confidence and not sure["q1"].zero_match


def test_partitions_dont_matter(built, questions, spark):
    seen = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        seen.append(sorted((r.query_id, r.rank, r.path, r.score) for r in retrieval.select_files(built, questions).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert seen[0] == seen[1]


def test_incremental_equals_rebuild(files, spark):
    docs = files.selectExpr("path as doc", "text")
    old = index.postings(docs)
    changed = spark.createDataFrame([("app/utils.py", "def rendered_page(): return 2\n")], "doc string, text string")
    new = docs.where("doc <> 'app/utils.py'").unionByName(changed)
    got = index.replace_documents(old, ["app/utils.py"], index.postings(changed))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, index.postings(new).collect()))


def test_changes(spark):
    a = spark.createDataFrame([("a", 1, 1), ("b", 1, 1)], "path string, mtime int, size int")
    b = spark.createDataFrame([("a", 2, 1), ("c", 1, 1)], "path string, mtime int, size int")
    assert {(r.path, r.change) for r in index.classify_changes(a, b).collect()} == {("a", "modified"), ("b", "removed"), ("c", "added")}
    assert [index.refresh_kind(index.classify_changes(x, y)) for x, y in ((a, a), (a, b), (a.where("path = 'a'"), b.where("path = 'a'")))] == ["unchanged", "full", "incremental"]


def test_splice_reverses_at_a_place():
    base = [f"f{i}" for i in range(14)]
    out, _ = channels.splice_lists(base, [("f12", 2.5), ("new", 2.0), ("weak1", 1.0), ("weak2", 1.5)], [], [])
    assert out[7:9] == ["f12", "new"] and out[12:14] == ["weak2", "weak1"]
    assert channels.splice_lists(["a"], [], ["b", "c"], ["d"])[0] == ["a", "b", "c", "d"]


def test_blocks_and_windows():
    source = "import x\n\n@dec\nclass A:\n    def one(self):\n        pass\n\n    def two(self):\n        pass\n"
    assert lines.python_blocks(source) == [(1, 2), (3, 9), (5, 7), (8, 9)]
    assert lines.window_spans(200, [10, 50, 150], 10) == [(1, 20), (40, 60), (140, 160)]
    assert lines.window_spans_from(100, [30, 60], [25, 50, 70], 10) == [(25, 40), (50, 69)] and lines.window_spans_from(50, [], [3]) == [(1, 50)]
    assert lines.column_blocks("import x\n\n@d\ndef f():\n  pass\nclass A:\n  pass\n") == [(1, 2), (3, 3), (4, 5), (6, 7)]
    assert lines.ruby_starts("class A\n  def b\n  end\nend\n") == [1, 2]
    assert lines.window_spans(100, []) == [(1, 60)]


def test_pack_one_function():
    out = pack.pack_query([("a.py", "def alpha_widget(x):\n    return x + 1\n", 1.0)], {"alpha": 1.0, "widget": 1.0}, {}, pack.PackParams(), pack.count_words)
    assert out == [("a.py", [(1, 2)], "def alpha_widget(x):\n    return x + 1")]
    many = [(f"f{i:02}.py", f"def handler{i}():\n" + "    needle value here\n" * 60, 1.0) for i in range(25)]
    packed = pack.pack_query(many, {"needl": 1.0}, {}, pack.PackParams(budget=800), pack.count_words)
    assert [p for p, _, _ in packed] == [p for p, _, _ in many]
    assert pack.name_score("pack_regions", {"pack", "region"}) == 3.0 and pack.name_score("pack_regions", {"pack"}) == 1.0


def test_history(spark):
    log = spark.createDataFrame([(i, 50 - i, f"a{i % 2}", f"m{i}", ["x.py", "y.py", "tests/t.py"]) for i in range(4)], commits.SCHEMA)
    rows = history.touched(log)
    top = history.top_cochange(history.cochange_counts(rows))
    assert {(r.path, r.other, r.n) for r in top.collect()} == {(a, b, 4) for a in ("x.py", "y.py", "tests/t.py") for b in ("x.py", "y.py", "tests/t.py") if a != b}
    bridge = history.bridge_cochange(top, lambda p: p.startswith("tests/"))
    assert {(r.path, r.other, r.n) for r in bridge.collect()} == {("x.py", "y.py", 2), ("y.py", "x.py", 2)}
    assert history.file_messages(rows, log).where("path = 'x.py'").first().message == "m0\nm1\nm2\nm3"
    meta = history.file_meta(rows, log).where("path = 'x.py'").first()
    assert (meta.n_commits, meta.last_ts, [a.author for a in meta.authors]) == (4, 50, ["a0", "a1"])


def test_commit_bodies():
    assert commits.split_body("why\n\nsrc/a.py\nb.txt") == ("why", ["src/a.py", "b.txt"])
    assert commits.split_body("only words here") == ("only words here", [])


def test_scan_of_a_work_tree(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.py").write_text("def find_me(): pass\n")
    (tmp_path / "empty.py").write_text("")
    (tmp_path / "junk.py").write_text("ignored = 1\n")
    (tmp_path / ".gitignore").write_text("junk.py\n")
    (tmp_path / "notes.md").write_bytes(b"caf\xe9")
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=n", "-c", "user.email=e@x", *a], check=True, capture_output=True)
    run("init", "-q"), run("add", "."), run("commit", "-qm", "add find")
    seen = corpus.scan(spark, str(tmp_path))
    assert [r.path for r in corpus.code_files(seen).collect()] == ["src/a.py"]
    assert corpus.documentation(seen).first().text == "caf\ufffd"
    log = commits.git_commits(spark, str(tmp_path)).first()
    assert log.message == "add find" and "src/a.py" in log.files
    assert commits.git_commits(spark, "/nowhere").count() == 0


def test_metrics(spark):
    assert [metrics.mcnemar(*x) for x in ((1, 9), (0, 8), (0, 0), (5, 5))] == [0.021484375, 0.0078125, 1.0, 1.0]
    mean, low, high = metrics.paired_bootstrap([0, 0, 1, 0], [1, 1, 1, 0], 500, 1)
    assert mean == 0.5 and low <= mean <= high
    assert metrics.gold_hunks("--- a/x.py\n+++ b/x.py\n@@ -3,2 +3,4 @@\n@@ -9,0 +12 @@\n--- /dev/null\n+++ b/n.py\n@@ -0,0 +1,2 @@\n") == [("x.py", 3, 4)]
    line = spark.createDataFrame([(float(i), 2.0 * i * i + 3) for i in range(1, 9)], "x double, y double")
    assert metrics.polynomial(line, "x", "y", 2) == pytest.approx([3, 0, 2], abs=1e-6)
    source = spark.createDataFrame([("a.py", "def f():\n    pass\n\ndef g():\n    pass\n"), ("b.py", "def broken(")], "path string, text string")
    assert {(r.name, r.a, r.b) for r in metrics.functions_of(source).collect()} == {("f", 1, 2), ("g", 4, 5)}


def test_stream_upkeep(spark, tmp_path):
    schema = "path string, text string, seq long"
    feed, at = tmp_path / "feed", str(tmp_path / "index")
    spark.createDataFrame([("a.py", "alpha beta", 1), ("b.py", "gamma", 2), ("a.py", "alpha delta", 3)], schema).coalesce(1).write.parquet(str(feed))
    refresh.maintain(spark.readStream.schema(schema).parquet(str(feed)), at, str(tmp_path / "cp")).awaitTermination()
    spark.createDataFrame([("b.py", None, 4)], schema).coalesce(1).write.mode("append").parquet(str(feed))
    refresh.maintain(spark.readStream.schema(schema).parquet(str(feed)), at, str(tmp_path / "cp")).awaitTermination()
    assert {(r.doc, r.term) for r in refresh.read_index(spark, at).collect()} == {("a.py", "alpha"), ("a.py", "delta")}
    refresh.compact(spark, at)
    assert {(r.doc, r.term) for r in refresh.read_index(spark, at).collect()} == {("a.py", "alpha"), ("a.py", "delta")}
    spark.createDataFrame([("c.py", "omega", 5), ("a.py", "other", 6)], schema).coalesce(1).write.mode("append").parquet(str(feed))
    refresh.maintain(spark.readStream.schema(schema).parquet(str(feed)), at, str(tmp_path / "cp")).awaitTermination()
    assert {(r.doc, r.term) for r in refresh.read_index(spark, at).collect()} == {("a.py", "other"), ("c.py", "omega")}


def greedy_brute(files, weights, params):
    """Pass 2 of packing as it is defined: weigh and sort all that is left in each step."""
    best = {p: max(r, key=lambda x: x[3]) for p, r in files.items()}
    covered = frozenset().union(*[r[2] for r in best.values()])
    spent, out = sum(r[1] for r in best.values()), [r[0] for r in best.values()]
    rest = [r for rows in files.values() for r in rows if r is not best[r[4]]]
    weigh = lambda t: sum(weights[x] for x in sorted(t))
    while rest and spent < params.budget:
        rest.sort(key=lambda r: -((weigh(r[2] - covered) + 0.25 * weigh(r[2]) + 0.1) * 1.3 / r[1] ** params.length_exponent))
        top = rest.pop(0)
        if spent + top[1] > params.budget:
            if top[1] > 200:
                continue
            break
        spent, covered = spent + top[1], covered | top[2]
        out.append(top[0])
    return out


def test_packing_is_the_defined_greedy_choice():
    import random

    rng = random.Random(4)
    names = ["alpha", "beta", "gamma", "delta"]
    files, regions = [], {}
    for i in range(3):
        source, rows = "", []
        for j in range(30):
            own = rng.sample(names, rng.randint(1, 3))
            body = f"def f{j}():\n" + "".join(f"    {w} = 0\n" for w in own) + "    pass\n" * rng.randint(0, 3)
            a = source.count("\n") + 1
            source += body
            hits = len(own)
            tokens = len(body.split())
            gain = (sum({"alpha": 1.0, "beta": 2.0, "gamma": 0.5, "delta": 1.5}[w] for w in sorted(own)) + 0.5 * hits) * 1.3 / tokens**0.85
            rows.append(((f"{i}.py", a), tokens, frozenset(own), gain, f"{i}.py"))
        files.append((f"{i}.py", source, 1.0))
        regions[f"{i}.py"] = rows
    weights = {"alpha": 1.0, "beta": 2.0, "gamma": 0.5, "delta": 1.5}
    params = pack.PackParams(budget=260, pad_lines=0)
    got = {(p, a) for p, spans, _ in pack.pack_query(files, weights, {}, params, pack.count_words) for a, _ in spans}
    assert got == set(greedy_brute(regions, weights, params)) and len(got) > 6


def test_packing_many_regions_is_quick():
    import time

    files = [(f"f{i}.py", "\n".join(f"def fun{i}_{j}(alpha{j % 7}):\n    return beta{j % 5} + gamma{j % 11} * delta\n" for j in range(400)), 1.0 / (i + 1)) for i in range(16)]
    began = time.perf_counter()
    out = pack.pack_query(files, {w: 1.0 + k / 10 for k, w in enumerate(["alpha", "beta", "gamma", "delta", "fun", "return"])}, {}, pack.PackParams(), pack.count_words)
    assert len(out) == 16 and time.perf_counter() - began < 8


def test_import_edges_of_rust_and_go_and_replacing(spark):
    rows = [("src/lib.rs", "mod a;\nuse crate::b::X;"), ("src/a.rs", ""), ("src/b/mod.rs", ""), ("pkg/tool/t.go", ""), ("main.go", 'import "example/pkg/tool"'), ("x.py", "import y"), ("y.py", "")]
    files = corpus.describe(spark.createDataFrame(rows, "path string, text string"))
    edges = graph.authored_edges(files)
    assert {tuple(r) for r in edges.collect()} == {("src/lib.rs", "src/a.rs"), ("src/lib.rs", "src/b/mod.rs"), ("main.go", "pkg/tool/t.go"), ("x.py", "y.py")}
    new = corpus.describe(spark.createDataFrame([(p, "import x" if p == "y.py" else t) for p, t in rows], "path string, text string"))
    again = graph.replace_authored(edges, spark.createDataFrame([("y.py",)], "path string"), new)
    assert {tuple(r) for r in again.collect()} == {tuple(r) for r in graph.authored_edges(new).collect()}


def test_region_choice_within_files_of_functions(spark):
    files = spark.createDataFrame([("a.py", "def f():\n    pass\n\ndef g():\n    pass\n")], "path string, text string")
    spans = spark.createDataFrame([(1, "a.py", 2, 2)], "instance_id int, path string, a int, b int")
    assert {r.name for r in metrics.overlapping(metrics.functions_of(files), spans).collect()} == {"f"}


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "tsconfig.json").write_text('{// a comment\n"compilerOptions": {"baseUrl": "web", "paths": {"@/*": ["src/*"], "lib": ["vendor/lib"],},},}')
    assert corpus.path_aliases(str(tmp_path)) == {"@": ["web/src"], "lib": ["web/vendor/lib"]} and corpus.path_aliases(str(tmp_path / "no")) == {}
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=n", "-c", "user.email=e@x", *a], check=True, capture_output=True)
    run("init", "-q"), run("add", "."), run("commit", "-qm", "one")
    assert [r.text is None for r in corpus.blobs_at(spark, str(tmp_path), [("HEAD", "tsconfig.json"), ("HEAD", "none")]).orderBy("path").collect()] == [True, False]
    found = spark.createDataFrame([(1, 2, "b.py", 3, 4, 0.5, "y"), (1, 1, "a.py", 1, 2, 0.75, "x")], "query_id int, rank int, path string, start_line int, end_line int, score double, text string")
    assert corpus.snippets(found).first().bundle == "### a.py:1-2 (score=0.750)\n```\nx\n```\n\n### b.py:3-4 (score=0.500)\n```\ny\n```"
    tasks = spark.createDataFrame([("1", None, "abc"), ("2", "u", "def")], "instance_id string, repo_url string, base_commit string")
    packed = spark.createDataFrame([(1, "b.py", [(1, 2)]), (1, "a.py", [(3, 4)])], "query_id int, path string, spans array<struct<a:int,b:int>>")
    rows = {r.instance_id: r for r in corpus.trajectories(tasks, packed, "1", 100).collect()}
    assert rows["1"].traj_data.pred_files == ["a.py", "b.py"] and rows["1"].traj_data.pred_spans["b.py"][0].end == 2 and rows["2"].traj_data.pred_files == []
    corpus.append_records(tasks, str(tmp_path / "out")), corpus.append_records(tasks, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 4
    asked = spark.createDataFrame([("a", 0, 3), ("a", 2, 9), ("a", 5, 6)], "path string, start int, stop int")
    sliced = lines.line_slices(spark.createDataFrame([("a", "1\n2\n3\n4\n")], "path string, text string"), asked, most=2)
    assert {r.start: (r.lines, r.cut) for r in sliced.collect()} == {0: (None, False), 2: (["2", "3"], True), 5: (None, False)}


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "tree"
    root.mkdir()
    (root / "app.py").write_text("def run_server(port):\n    return port\n")
    (root / "util.py").write_text("import app\n\ndef helper():\n    return app.run_server(1)\n")
    (root / "NOTES.md").write_text("frobnicate quuxify glorp\n")
    return root


def test_command_line_contract(spark, tree):
    def call(*args):
        out, err = io.StringIO(), io.StringIO()
        return cli.main([*args, str(tree), "--no-cache"], out, err), out.getvalue(), err.getvalue()

    code, out, _ = call("--json", "run server port")
    got = json.loads(out)
    assert code == 0 and "app.py" in [f["path"] for f in got["files"]] and got["stats"]["files_indexed"] == 2 and got["bundle"].startswith("### ")
    code, out, err = call("--json", "frobnicate quuxify glorp")
    got = json.loads(out)
    assert code == 1 and (got["files"], got["regions"], got["bundle"]) == ([], {}, "") and got["stats"]["matched_query_terms"] > 0 and "can be packed" in err
    code, out, err = call("--json", "zzqxv yyqkw")
    assert code == 1 and json.loads(out)["stats"]["matched_query_terms"] == 0 and "none of the question" in err
    code, out, err = call("--files-only", "--explain", "run server port")
    assert code == 0 and "app.py" in out.split("\n") and "channel" in err
    for wrong in (["--budget", "0"], ["--k", "-1"], ["--len-exp", "nan"]):
        with pytest.raises(SystemExit) as ended:
            cli.main([*wrong, "q", str(tree)])
        assert ended.value.code == 2


def test_cache_kinds_and_incremental_equals_rebuild(spark, tree, tmp_path):
    at = "file://" + str(tmp_path / "store")
    kinds = [cache.load_or_build(spark, str(tree), at)[1] for _ in range(2)]
    (tree / "util.py").write_text("def helper():\n    return run_client(2, 3, 4)\n")
    updated, kind = cache.load_or_build(spark, str(tree), at)
    assert [*kinds, kind] == ["full", "unchanged", "incremental"]
    rebuilt, _ = cache.load_or_build(spark, str(tree), at, use_cache=False)
    for part in ("body", "sizes", "paths", "symbols", "authored"):
        a, b = getattr(updated, part), getattr(rebuilt, part)
        assert sorted(map(str, a.select(b.columns).collect())) == sorted(map(str, b.collect())), part
    (tree / "new.py").write_text("def added(): pass\n")
    assert cache.load_or_build(spark, str(tree), at)[1] == "full"
    assert cache.load_or_build(spark, str(tree), at, with_docs=False)[1] == "full" and cache.load_or_build(spark, str(tree), at, with_docs=False, reindex=True)[1] == "full"


def test_agent_run_analysis(spark):
    runs = spark.createDataFrame(
        [("i1", "a", ["x.py"], True, False, 4, None), ("i2", "a", ["x.py", "y.py"], False, True, 9, None), ("i3", "a", ["z.py"], False, False, 5, None), ("i4", "a", ["z.py"], False, True, 9, None), ("i5", "a", ["z.py"], True, False, 1, "api")],
        "instance_id string, arm string, gold_files array<string>, success boolean, hit_turn_cap boolean, turns_used int, error string",
    )
    touches = spark.createDataFrame([("i1", "a", "x.py", 1, 2), ("i2", "a", "x.py", 3, None), ("i2", "a", "y.py", None, None), ("i3", "a", "z.py", 2, 4)], "instance_id string, arm string, path string, seen int, read int")
    touched = metrics.run_touches(runs, touches, ["instance_id", "arm"])
    got = {r.instance_id: (r.any_seen, r.any_read, r.all_seen, r.all_read) for r in touched.collect()}
    assert got == {"i1": (True, True, True, True), "i2": (True, False, False, False), "i3": (True, True, True, True), "i4": (False,) * 4, "i5": (False,) * 4}
    c = metrics.convergence(touched).first()
    assert (c.n, c.n_success, c.n_turn_cap, c.n_failed_other, c.answer_turn_median, c.capped_seen, c.capped_read, c.capped_never, c.capped_first_seen) == (4, 1, 2, 1, 4.0, 1, 0, 1, [3])
    f = metrics.failures(touched).first()
    assert (f.n, f.n_failed, f.never_answered, f.answered_wrong, f.n_seen, f.n_read, f.n_never_seen, f.first_seen_median) == (4, 3, 2, 1, 2, 1, 1, 2.5)
    turns = spark.createDataFrame([("i1", 1, [("text", None, None), ("tool_use", "grep", "q"), ("tool_use", "read", "x.py")])], "instance_id string, turn int, content array<struct<type:string,name:string,input:string>>")
    assert [(r.turn, r.at, r.name) for r in metrics.tool_calls(turns, ["instance_id"]).collect()] == [(1, 1, "grep"), (1, 2, "read")]
    row = spark.createDataFrame([(["./src/x.py", "lib/y.py"], ["x.py", "src/x.py", "z.py", "a/lib/y.py"])], "p array<string>, g array<string>")
    assert row.select(metrics.gold_in("p", "g").alias("h")).first().h == ["x.py", "src/x.py", "a/lib/y.py"]


def test_payload_differences():
    a = {"files": [{"path": "a", "score_rank": 0}], "stats": {"index_ms": 1, "n": 2}}
    assert metrics.payload_differences(a, {"files": [{"path": "a", "score_rank": 0}], "stats": {"index_ms": 9, "n": 2}}) == []
    assert metrics.payload_differences(a, {"files": [{"path": "b", "score_rank": 0}, 1], "stats": {"n": 2.0}}) == ["$.files[0].path", "$.files.length", "$.stats.n"]
