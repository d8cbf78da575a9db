"""Scalar functions; ``register`` makes the text ones callable from SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession


def register(spark: SparkSession) -> None:
    """Registers ``term_stem``, ``term_parts``, ``term_list`` and ``path_terms`` as SQL
    functions: bodies of built-in expressions, no Python at run time."""
    lower_stop = "array(" + ", ".join(f"'{w}'" for w in text.STOP_WORDS) + ")"
    chain = "{x}"
    for pattern, to in text.STEM_RULES:
        chain = f"regexp_replace({chain}, '{pattern}', '{to}')"
    counts = f"(length({{x}}) > 2 AND NOT array_contains({lower_stop}, {{x}}))"
    parts = f"transform(filter(transform(regexp_extract_all({{w}}, '{text.CAMEL}', 0), p -> lower(p)), p -> {counts.format(x='p')}), p -> {chain.format(x='p')})"
    whole = f"if({counts.format(x='lower({w})')}, array({chain.format(x='lower({w})')}), CAST(array() AS ARRAY<STRING>))"
    terms = f"concat({whole}, if(size({parts}) > 1 OR (size({parts}) = 1 AND {parts}[0] <> {chain.format(x='lower({w})')}), {parts}, CAST(array() AS ARRAY<STRING>)))"
    for name, returns, body in (
        ("term_stem", "STRING", chain.format(x="w")),
        ("term_parts", "ARRAY<STRING>", parts.format(w="w")),
        ("term_list", "ARRAY<STRING>", f"flatten(transform(regexp_extract_all(w, '{text.IDENTIFIER}', 0), v -> {terms.format(w='v')}))"),
        ("path_terms", "ARRAY<STRING>", f"array_distinct(flatten(transform(filter(split(w, '[/\\\\\\\\.-]'), v -> v <> ''), v -> concat(array({chain.format(x='lower(v)')}), {parts.format(w='v')}))))"),
    ):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(w STRING) RETURNS {returns} RETURN {body}")


from . import text  # noqa: E402
