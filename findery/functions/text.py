"""Identifier tokenisation as Column expressions, all of them JVM-side.

A *term* is a stemmed lower-case word. Identifiers give their whole form and, where
they are compound, the forms of their parts.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

IDENTIFIER = "[A-Za-z_][A-Za-z0-9_]*"
CAMEL = "[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+"
STOP_WORDS = tuple("and def err for int let new nil not pub str the use var bool from func impl none null self that this true type void with class const error false import return string struct function".split())
#: Suffix rules of the stemmer, in order: (Java pattern, replacement).
STEM_RULES = (
    ("^(..+)ies$", "$1i"),
    ("sses$", "ss"),
    ("^(..+[^s])s$", "$1"),
    ("^(...+)(?:ing|ed)$", "$1"),
    ("^(?:(....+)er|(.....+)or)$", "$1$2"),
    ("^(....+)y$", "$1i"),
    ("^(....+)e$", "$1"),
)
#: Folders of files that are not the product itself (each with an optional plural).
_SIDE_FOLDERS = "__tests__ bench(?:es|marks?) demos? docs? docs_src e2e examples? fixtures? integration mocks? playground samples? scripts? specs? t testing tests? tutorials?".split()
TEST_LIKE = "(?i)(?:^|/)(?:" + "|".join(_SIDE_FOLDERS) + r")(?:/|$)|(?:^|/)(?:conftest|test_)|_test\.(?:go|js|py|rs|ts)$|\.(?:spec|test)\."
VENDORED = r"(?i)(vendor|vendored|third_party|node_modules|\.min\.(js|css)$|bundle\.js$)"
CODE_SUFFIXES = tuple("." + x for x in "cs go java js jsx kt py rs swift ts tsx".split())
#: Where a text breaks into lines.
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\u0085\u2028\u2029]"
#: Symbol definitions by file suffix; the group holds the name.
DEFINITIONS = {
    (".py",): r"(?Udm)^\s*(?:def|class)\s+(\w+)",
    (".go",): r"(?Udm)^func\s(?:\s*\([^)]*\))?\s*(\w+)",
    (".rs",): r"(?Udm)^(?:\s*pub\s)?\s*(?:fn|struct)\s+(\w+)",
    (".js", ".ts", ".jsx", ".tsx"): r"(?Udm)^(?:\s*export\s)?\s*(?:class|function)\s+(\w+)",
}


def stem(word: Column) -> Column:
    """Strips plural, verb and agent endings; every rule sees what the one before left.
    No rule touches a word that ends in another letter than these."""
    stripped = word
    for pattern, to in STEM_RULES:
        stripped = F.regexp_replace(stripped, pattern, to)
    return F.when(F.right(word, F.lit(1)).isin(*"sgdrye"), stripped).otherwise(word)


def _counts(word: Column) -> Column:
    """Whether a lower-case word is long enough and no stop word."""
    return (F.length(word) > 2) & ~word.isin(*STOP_WORDS)


def subtokens(identifier: Column) -> Column:
    """Stems of an identifier's parts (at underscores and changes of case)."""
    parts = F.transform(F.regexp_extract_all(identifier, F.lit(CAMEL), F.lit(0)), F.lower)
    return F.transform(F.filter(parts, _counts), stem)


def identifier_terms(identifier: Column) -> Column:
    """The terms of one identifier. A plain word, the usual case, skips the splitting."""
    lower = F.lower(identifier)
    whole = F.when(_counts(lower), F.array(stem(lower))).otherwise(F.array().cast("array<string>"))
    parts = subtokens(identifier)
    extra = F.when((F.size(parts) > 1) | (F.element_at(F.concat(parts, F.array(F.lit(""))), 1) != stem(lower)), parts).otherwise(F.array().cast("array<string>"))
    compound = F.concat(whole, F.when(F.size(parts) == 0, F.array().cast("array<string>")).otherwise(extra))
    return F.when(identifier.rlike("^[A-Z]?[a-z]+$"), whole).otherwise(compound)


def identifiers(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(IDENTIFIER), F.lit(0))


def tokenize(text: Column) -> Column:
    """All terms of a text in order, repeats kept."""
    return F.flatten(F.transform(identifiers(text), identifier_terms))


def query_terms(question: Column, keywords: Column | None = None) -> Column:
    """The distinct terms of a question (and of keywords), in order."""
    terms = tokenize(question)
    if keywords is not None:
        terms = F.concat(terms, F.flatten(F.transform(keywords, lambda k: F.concat(F.array(stem(F.lower(k))), subtokens(k)))))
    return F.filter(F.array_distinct(terms), _counts)


def path_tokens(path: Column) -> Column:
    """The set of terms of a path: stems of its pieces and of their parts."""
    pieces = F.filter(F.split(path, r"[/\\.\-]"), lambda p: p != "")
    return F.array_distinct(F.flatten(F.transform(pieces, lambda p: F.concat(F.array(stem(F.lower(p))), subtokens(p)))))


def split_lines(text: Column) -> Column:
    """Lines of a text; a line end at its end opens no further line."""
    lines = F.split(text, LINE_END)
    drop = F.element_at(lines, -1) == ""
    return F.when(drop, F.slice(lines, 1, F.greatest(F.size(lines) - 1, F.lit(0)))).otherwise(lines)


def parent(path: Column) -> Column:
    """The folder of a path, "." at the top."""
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit("."))


def parent_name(path: Column) -> Column:
    """The last part of the folder's path; empty at the top."""
    return F.when(path.contains("/"), F.element_at(F.split(parent(path), "/"), -1)).otherwise(F.lit(""))


def normalize_path(path: Column) -> Column:
    """Resolves "." and ".." by spelling alone; leading ".." stay, nothing left is "."."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))

    def step(done: Column, part: Column) -> Column:
        up = (part == "..") & (F.size(done) > 0) & (F.element_at(F.concat(F.array(F.lit("..")), done), -1) != "..")
        return F.when(up, F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(part)))

    joined = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")
    rooted = F.when(path.startswith("/"), F.concat(F.lit("/"), joined)).otherwise(joined)
    return F.when(rooted == "", F.lit(".")).otherwise(rooted)


def path_key(path: Column) -> Column:
    """What paths sort by: their parts, not their characters."""
    return F.split(path, "/")


def suffix(path: Column) -> Column:
    """The file suffix with its dot; a name that only starts with a dot has none."""
    return F.regexp_extract(F.element_at(F.split(path, "/"), -1), r"^.+(\.[^.]+)$", 1)


def is_code(path: Column) -> Column:
    return suffix(path).isin(*CODE_SUFFIXES)


def is_vendored(path: Column) -> Column:
    return path.rlike(VENDORED)


def path_prior(path: Column) -> Column:
    """0.3 for tests, examples and documentation, otherwise 1.0."""
    return F.when(path.rlike(TEST_LIKE), F.lit(0.3)).otherwise(F.lit(1.0))


def packaging_prior(path: Column) -> Column:
    """``path_prior`` with a middle tier for packaging files."""
    return F.when(path.rlike(TEST_LIKE), F.lit(0.3)).when(path.rlike(r"\.(gemspec|rake)$"), F.lit(0.5)).otherwise(F.lit(1.0))


def comments(path: Column, text: Column) -> Column:
    """Comments of a file: doc strings and # lines of Python, else /* */ and // ones."""
    quoted = F.regexp_extract_all(text, F.lit("(?s)(\"{3}|'{3})(.*?)\\1"), F.lit(2))
    hashed = F.regexp_extract_all(text, F.lit("(?md)#(.*)$"), F.lit(1))
    blocks = F.regexp_extract_all(text, F.lit(r"(?s)/\*(.*?)\*/"), F.lit(1))
    slashed = F.regexp_extract_all(text, F.lit("(?md)//(.*)$"), F.lit(1))
    return F.array_join(F.when(path.endswith(".py"), F.concat(quoted, hashed)).otherwise(F.concat(blocks, slashed)), "\n")


def definitions(path: Column, text: Column) -> Column:
    """The distinct symbols that a file defines, in order; none for other languages."""
    found = F.array().cast("array<string>")
    for suffixes, pattern in DEFINITIONS.items():
        found = F.when(suffix(path).isin(*suffixes), F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)))).otherwise(found)
    return found


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once: lambdas evaluate what they refer to
    from outside anew for each element, unless it is a variable."""
    return F.element_at(F.transform(F.array(value), body), 1)


def shingles(text: Column, n: int = 5) -> Column:
    """Runs of ``n`` words of a text, joined by blanks."""
    found = F.filter(F.split(squeeze(text), " "), lambda w: w != "")

    def runs(words: Column) -> Column:
        places = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.array_join(F.slice(words, i, n), " "))

    return bound(found, runs)


def char_grams(text: Column, n: int = 5) -> Column:
    """The set of character n-grams but for the last one of a text."""
    places = F.when(F.length(text) > n, F.sequence(F.lit(1), F.length(text) - n)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(places, lambda i: F.substring(text, i, F.lit(n))))


def gram_overlap(a: Column, b: Column, n: int = 5) -> Column:
    """Share of the n-grams of ``a`` that ``b`` has."""
    left = char_grams(a, n)
    return F.size(F.array_intersect(left, char_grams(b, n))) / F.greatest(F.size(left), F.lit(1))


def snake_case(name: Column) -> Column:
    """CamelCase as snake_case; "::" becomes a slash."""
    name = F.regexp_replace(F.regexp_replace(name, "::", "/"), "([A-Z]+)([A-Z][a-z])", "$1_$2")
    return F.lower(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1_$2"))


def has_word(text: Column, needle: Column) -> Column:
    """Whether ``needle`` stands in ``text`` with no identifier character on either side."""
    quoted = F.concat(F.lit(r"(?<![A-Za-z0-9_])\Q"), needle, F.lit(r"\E(?![A-Za-z0-9_])"))
    return F.regexp_like(text, quoted)


def top_folders(path: Column, n: int = 2) -> Column:
    parts = F.split(path, "/")
    return F.array_join(F.slice(parts, 1, F.least(F.lit(n), F.greatest(F.size(parts) - 1, F.lit(0)))), "/")


def files_line(text: Column) -> Column:
    """The paths of the last ``FILES:`` line of a reply, without markup."""
    lines = F.regexp_extract_all(text, F.lit(r"(?im)^[\s*`#>-]*FILES:?\**:?\s*(.*)$"), F.lit(1))
    last = F.when(F.size(lines) > 0, F.element_at(lines, -1)).otherwise(F.lit(""))
    return F.filter(F.transform(F.split(last, "[,;\\s]+"), lambda p: F.regexp_replace(p, "^[`*\"'\\[(]+|[`*\"'\\])]+$", "")), lambda p: p != "")


def only_comments(patch: Column) -> Column:
    """Whether the changed lines of a patch are all blank or comments."""
    changed = F.filter(F.split(patch, "\n"), lambda x: x.rlike(r"^[+-](?![+-]{2})"))
    return F.forall(changed, lambda x: x.rlike(r"^[+-]\s*(//.*|#.*|\*.*|/\*.*)?$"))


SQL_FUNCTIONS = {"term_stem": "stem", "term_parts": "subtokens", "term_list": "tokenize", "path_terms": "path_tokens"}

