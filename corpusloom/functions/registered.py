"""Functions for SQL: temporary ones of a session, and a table function for passages."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from corpusloom.functions.text import CJK, TRACKING, WORD
from corpusloom.operators import chunks, near

_PAIRS = "array_distinct(flatten(transform(regexp_extract_all({0}, '(" + CJK + "{{2,}})', 1), r -> transform(sequence(1, length(r) - 1), k -> substring(r, k, 2)))))"
_OTHERS = f"length(regexp_replace(t, '{CJK}', ''))"
_NAMES = ", ".join(f"'{t}'" for t in TRACKING)
_QUERY = r"""array_join(transform(array_sort(filter(transform(filter(split(regexp_extract(trim(u), '^[^?#]*\\?([^#]*)', 1), '&'), p -> p <> ''), p -> named_struct('k', coalesce(try_url_decode(regexp_extract(p, '^([^=]*)', 1)), regexp_extract(p, '^([^=]*)', 1)),
  'v', coalesce(try_url_decode(regexp_extract(p, '^[^=]*=(.*)$', 1)), regexp_extract(p, '^[^=]*=(.*)$', 1)))), p -> lower(p.k) NOT IN ({names}) AND NOT startswith(lower(p.k), 'utm_'))), p -> replace(replace(url_encode(p.k), '*', '%2A'), '%7E', '~') || '=' || replace(replace(url_encode(p.v), '*', '%2A'), '%7E', '~')), '&')"""
FUNCTIONS = {
    "cjk_bigrams(t STRING) RETURNS ARRAY<STRING>": _PAIRS.format("t"),
    "search_tokens(t STRING) RETURNS ARRAY<STRING>": f"array_union(regexp_extract_all(lower(t), '({WORD})', 1), {_PAIRS.format('lower(t)')})".replace("\\p", "\\\\p"),
    "estimated_tokens(t STRING) RETURNS BIGINT": f"CASE WHEN length(t) > 0 THEN greatest(floor((length(t) - {_OTHERS}) / 1.5D + {_OTHERS} / 4D), 1) ELSE 0 END",
    "canonical_query(u STRING) RETURNS STRING": _QUERY.replace("{names}", _NAMES),
}


@udtf(returnType="ordinal int, passage string, headings array<string>, tokens int")
class ChunkDocument:
    """The passages of a text, for ``LATERAL chunk_document(text)``."""

    def eval(self, text: str):
        for n, (passage, headings, tokens, _, _) in enumerate(chunks.chunks_of(text)):
            yield n, passage, list(headings), tokens


def register(spark: SparkSession) -> None:
    """Makes the functions known to a session's SQL."""
    for head, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    spark.udf.register("simhash64", near.simhash64)
    spark.udtf.register("chunk_document", ChunkDocument)
