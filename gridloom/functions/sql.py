"""The text operators as SQL functions of a session; Spark inlines their bodies."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .text import SPACE, WORD

_PIECE = WORD + r"[^\p{L}\p{N}]*"


def _quoted(pattern: str) -> str:
    return "r'" + pattern.replace("'", "\\x27") + "'"


def _clean(c: str) -> str:
    return f"trim(regexp_replace(coalesce({c}, ''), {_quoted(SPACE)}, ' '))"


_FUNCTIONS = [
    f"tokenize_words(s STRING) RETURNS ARRAY<STRING> RETURN regexp_extract_all(coalesce(s, ''), {_quoted(WORD)}, 0)",
    f"word_pieces(s STRING) RETURNS ARRAY<STRING> RETURN regexp_extract_all(coalesce(s, ''), {_quoted(_PIECE)}, 0)",
    f"clean_text(s STRING) RETURNS STRING RETURN {_clean('s')}",
    "render_table_row(headers ARRAY<STRING>, cells ARRAY<STRING>) RETURNS STRING RETURN "
    f"regexp_replace(concat(array_join(filter(zip_with(headers, cells, (h, v) -> CASE WHEN h IS NOT NULL AND {_clean('v')} <> '' THEN concat(h, ' = ', {_clean('v')}) END), x -> x IS NOT NULL), '; '), '.'), '^[.]$', '')",
    # the windows of chunk_words as an array, which needs no join of a query with itself
    "word_windows(s STRING, chunk_size INT, chunk_overlap INT) RETURNS ARRAY<STRUCT<id: INT, text: STRING, source_text: STRING>> RETURN "
    f"element_at(transform(array(struct(regexp_extract_all(coalesce(s, ''), {_quoted(WORD)}, 0) AS words, regexp_extract_all(coalesce(s, ''), {_quoted(_PIECE)}, 0) AS pieces)), "
    "x -> CASE WHEN size(x.words) > 0 THEN transform(sequence(0, CAST(greatest(0, ceil((size(x.words) - chunk_size) / CAST(chunk_size - chunk_overlap AS DOUBLE))) AS INT)), "
    "k -> struct(k AS id, array_join(slice(x.words, k * (chunk_size - chunk_overlap) + 1, chunk_size), ' ') AS text, "
    f"regexp_replace(array_join(slice(x.pieces, k * (chunk_size - chunk_overlap) + 1, chunk_size), ''), {_quoted(f'^{SPACE}|{SPACE}$')}, '') AS source_text)) END), 1)",
    # a window of words is a slice; text without words gives no rows; over a table
    # Spark joins its rows with the table by text, so word_windows is for large ones
    "chunk_words(s STRING, chunk_size INT, chunk_overlap INT) RETURNS TABLE(id INT, text STRING, source_text STRING) RETURN "
    "SELECT k, array_join(slice(words, k * (chunk_size - chunk_overlap) + 1, chunk_size), ' '), "
    f"regexp_replace(array_join(slice(pieces, k * (chunk_size - chunk_overlap) + 1, chunk_size), ''), {_quoted(f'^{SPACE}|{SPACE}$')}, '') "
    f"FROM (SELECT words, pieces, explode(sequence(0, CAST(greatest(0, ceil((size(words) - chunk_size) / CAST(chunk_size - chunk_overlap AS DOUBLE))) AS INT))) AS k "
    f"FROM (SELECT regexp_extract_all(coalesce(s, ''), {_quoted(WORD)}, 0) AS words, regexp_extract_all(coalesce(s, ''), {_quoted(_PIECE)}, 0) AS pieces) WHERE size(words) > 0)",
]


def register(spark: SparkSession) -> None:
    """Makes tokenize_words, word_pieces, clean_text, render_table_row, word_windows
    and the table function chunk_words known to ``spark``."""
    for body in _FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {body}")
