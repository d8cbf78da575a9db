import pytest
from pyspark.sql import functions as F

from findery import functions
from findery.functions import text


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x"))).first()[0]


@pytest.mark.parametrize("word, want", [("validators", "validat"), ("dependencies", "dependenci"), ("routing", "rout"), ("classes", "class"), ("running", "runn"), ("monitor", "monit"), ("type", "type"), ("using", "using")])
def test_stem(spark, word, want):
    assert one(spark, word, text.stem) == want


@pytest.mark.parametrize("word, want", [("HTTPResponse", ["http", "respons"]), ("parseHTTPResponse2", ["pars", "http", "respons"]), ("XMLHttpRequest", ["xml", "http", "request"]), ("A", []), ("alreadylower", ["alreadylow"])])
def test_subtokens(spark, word, want):
    assert one(spark, word, text.subtokens) == want


def test_tokenize(spark):
    assert one(spark, "already lower", text.tokenize) == ["alreadi", "lower"]
    assert one(spark, "naïve_foo", text.identifiers) == ["na", "ve_foo"]
    assert one(spark, "", text.tokenize) == []


def test_sql_functions_agree(spark):
    functions.register(spark)
    sample = "parseHTTPResponse2 and XMLHttpRequest for some_running validators; already lower"
    assert spark.sql(f"SELECT term_list('{sample}')").first()[0] == one(spark, sample, text.tokenize)
    assert spark.sql("SELECT path_terms('src/http_server/RequestParser.py')").first()[0] == one(spark, "src/http_server/RequestParser.py", text.path_tokens)


@pytest.mark.parametrize("path, want", [("src/main.py", 1.0), ("tests/test_main.py", 0.3), ("src/t/z.py", 0.3), ("vendor/x.js", 1.0)])
def test_prior(spark, path, want):
    assert one(spark, path, text.path_prior) == want


def test_paths_and_lines(spark):
    assert one(spark, "a\r\nb", text.split_lines) == ["a", "b"]
    assert one(spark, "a\rb\x0bc\u2028", text.split_lines) == ["a", "b", "c"]
    assert one(spark, "", text.split_lines) == []
    assert one(spark, "foo.py", text.parent) == "."
    assert one(spark, "a/b/../c/./d", text.normalize_path) == "a/c/d"
    assert one(spark, "a/../..", text.normalize_path) == ".."
    assert one(spark, "a/..", text.normalize_path) == "."
    assert [r.p for r in spark.createDataFrame([("test.py",), ("test/a.py",)], "p string").orderBy(text.path_key(F.col("p"))).collect()] == ["test/a.py", "test.py"]
    assert [one(spark, p, text.suffix) for p in (".gitignore", "a/b.tar.gz", "x")] == ["", ".gz", ""]


def test_other_text(spark):
    assert one(spark, "a b  c d e f", text.shingles) == ["a b c d e", "b c d e f"]
    assert one(spark, "HTTPServer::RequestParser", text.snake_case) == "http_server/request_parser"
    assert one(spark, "thoughts\nFILES: `a.py`, b/c.py", text.files_line) == ["a.py", "b/c.py"]
    assert one(spark, "--- a/x\n+++ b/x\n+# note\n-\n", text.only_comments) is True
    assert one(spark, "a/b/c/d.py", text.top_folders) == "a/b"
    row = spark.createDataFrame([("a.py", '"""doc"""\nclass A:\n    def run(self): # why\n        pass')], "path string, text string")
    assert row.select(text.comments(F.col("path"), F.col("text"))).first()[0] == "doc\n why"
    assert row.select(text.definitions(F.col("path"), F.col("text"))).first()[0] == ["A", "run"]
