"""The registered queries of the document operators, with the SQL that gives
the same rows."""

from __future__ import annotations

import json
import tempfile
from collections.abc import Callable
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import api, service
from ..functions import jsonschema, sql
from ..functions import text as t
from ..operators import blocks as b
from ..operators import chunking, geometry, layout, model_year
from ..schemas import BLOCK_JSON, PDF_BOX, PDF_CELL, PDF_TABLE, PDF_WORD
from ..sources import corpus, html, pdf, urls
from ..streaming import chunks as streaming
from . import fixtures

_SPACE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]+"
_WORD = r"[\p{L}\p{N}]+(?:[''’][\p{L}\p{N}]+)*"
_PIECE = _WORD + r"[^\p{L}\p{N}]*"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _clean_sql(c: str) -> str:
    return f"trim(regexp_replace(coalesce({c}, ''), '{_SPACE}', ' ', 'g'), ' ')"


def _strip_sql(c: str) -> str:
    return f"regexp_replace({c}, '^{_SPACE}|{_SPACE}$', '', 'g')"


def _count_sql(c: str) -> str:
    return f"len(regexp_extract_all({c}, '{_WORD}'))"


# text ---------------------------------------------------------------------


@query(f"SELECT doc_id, {_clean_sql('text')} AS cleaned FROM documents")
def clean_text_documents(spark, d):
    return read(spark, d, "documents").select("doc_id", t.clean(F.col("text")).alias("cleaned"))


@query(f"SELECT doc_id, {_count_sql('text')}::BIGINT AS words FROM documents")
def word_counts(spark, d):
    return read(spark, d, "documents").select("doc_id", t.word_count(F.col("text")).cast("long").alias("words"))


@query(f"SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '{_WORD}')) AS word FROM documents) GROUP BY word")
def word_tokens(spark, d):
    return read(spark, d, "documents").select(F.explode(t.tokens(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def _windows_sql(size: int, overlap: int) -> str:
    step = size - overlap
    return f"""
WITH w AS (SELECT doc_id, regexp_extract_all(text, '{_WORD}') AS words, regexp_extract_all(text, '{_PIECE}') AS pieces FROM documents),
k AS (SELECT *, unnest(range(0, (greatest(0, ceil((len(words) - {size}) / {step}::DOUBLE)) + 1)::BIGINT)) AS id FROM w WHERE len(words) > 0)
SELECT doc_id, id::INTEGER AS id, array_to_string(words[id * {step} + 1 : id * {step} + {size}], ' ') AS text,
       {_strip_sql(f"array_to_string(pieces[id * {step} + 1 : id * {step} + {size}], '')")} AS source_text FROM k"""


@query(_windows_sql(450, 60))
def chunk_words_450_60(spark, d):
    return chunking.chunk_words(read(spark, d, "documents").select("doc_id", "text"), "text", 450, 60)


@query(_windows_sql(30, 10))
def chunk_words_30_10(spark, d):
    return chunking.chunk_words(read(spark, d, "documents").select("doc_id", "text"), "text", 30, 10)


def _mapped(rows: DataFrame, f: Callable, columns: list[str], out: dict[str, str]) -> DataFrame:
    """``columns`` beside what ``f`` gives for the last column of ``rows``, as columns ``out``."""
    kinds = [f"{c} {rows.schema[c].dataType.simpleString()}" for c in columns] + [f"{n} {k}" for n, k in out.items()]

    def run(batches):
        # few rows at a time are Python objects
        for batch in (whole.slice(at, 256) for whole in batches for at in range(0, whole.num_rows, 256)):
            made = [f(x) for x in batch.column(len(columns)).to_pylist()]
            found = [pa.array([m[i] for m in made], pa.float64() if k == "double" else pa.string()) for i, k in enumerate(out.values())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], *found], names=[*columns, *out])

    return rows.toDF(*columns, "_input").mapInArrow(run, ", ".join(kinds))


@query("""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents)
SELECT doc_id, replace(ltrim(replace(string_agg(line, chr(1) ORDER BY pos), '-' || chr(1), ''), chr(1)), chr(1), ' ') AS joined FROM l GROUP BY doc_id""")
def join_wrapped_lines(spark, d):
    return read(spark, d, "documents").select("doc_id", t.join_wrapped(F.col("text")).alias("joined"))


# rows and blocks ------------------------------------------------------------


def _row_sql(pairs: list[tuple[str, str]]) -> str:
    return "concat_ws('; ', " + ", ".join(f"CASE WHEN {v} <> '' THEN '{h} = ' || {v} END" for h, v in pairs) + ") || '.'"


@query(f"SELECT n_nationkey, {_row_sql([('Name', 'n_name'), ('Region', 'n_regionkey::VARCHAR')])} AS line FROM nation")
def render_rows(spark, d):
    n = read(spark, d, "nation")
    return n.select("n_nationkey", t.render_row(F.array(F.lit("Name"), F.lit("Region")), F.array("n_name", F.col("n_regionkey").cast("string"))).alias("line"))


@query(
    "SELECT r_regionkey, 'World > ' || r_name || chr(10) || 'Nations' || chr(10) || string_agg('Nation = ' || n_name || '.', chr(10) ORDER BY n_nationkey) AS shown "
    "FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey, r_name"
)
def render_block_prefix(spark, d):
    n = read(spark, d, "nation").join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: F.array(x["n_name"]))
    tables = n.groupBy("r_regionkey", "r_name").agg(rows.alias("rows"))
    shown = t.render_block(F.lit("table"), F.lit(None), F.array(F.lit("World"), F.col("r_name")), F.lit("Nations"), F.array(F.lit("Nation")), F.col("rows"))
    return tables.select("r_regionkey", shown.alias("shown"))


@query("""
WITH h AS (SELECT p_type, p_partkey, CASE WHEN p_size % 10 = 0 THEN '' ELSE p_brand END AS h FROM part),
n AS (SELECT p_type, p_partkey, h, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) AS pos FROM h),
base AS (SELECT *, CASE WHEN h = '' THEN 'Column ' || pos ELSE h END AS base FROM n),
c AS (SELECT *, row_number() OVER (PARTITION BY p_type, lower(base) ORDER BY pos) AS nth FROM base)
SELECT p_type, pos::INTEGER AS pos, CASE WHEN nth = 1 THEN base ELSE base || ' (' || nth || ')' END AS header FROM c""")
def dedupe_headers(spark, d):
    p = read(spark, d, "part").withColumn("h", F.when(F.col("p_size") % 10 == 0, "").otherwise(F.col("p_brand")))
    return b.unique_header_rows(p, ["p_type"], ["p_partkey", "h"], "h")


def _nation_tables(spark, d) -> DataFrame:
    n = read(spark, d, "nation")
    row = F.array(F.col("n_nationkey").cast("string"), F.col("n_name"))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", row.alias("row")))), lambda x: x["row"])
    return n.groupBy("n_regionkey").agg(rows.alias("rows")).withColumn("headers", F.array(F.lit("Key"), F.lit("Name")))


@query("""
WITH r AS (SELECT n_regionkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey)::INTEGER AS row_no, n_nationkey::VARCHAR AS k, n_name FROM nation)
SELECT n_regionkey, row_no, 1 AS col_no, 'Key' AS header, k AS value FROM r UNION ALL SELECT n_regionkey, row_no, 2, 'Name', n_name FROM r""")
def cells_view(spark, d):
    return b.cells(_nation_tables(spark, d), ["n_regionkey"])


@query("""
WITH r AS (SELECT s_nationkey AS k, s_suppkey, [s_suppkey::VARCHAR, s_name, CASE WHEN s_acctbal < 0 THEN '' ELSE floor(s_acctbal)::INTEGER::VARCHAR END] AS row FROM supplier)
SELECT k, 3 AS width, list_transform(list(row ORDER BY s_suppkey), lambda x: array_to_string(x, '|')) AS lines, 'Column 1|Name|Column 3' AS headers FROM r GROUP BY k""")
def normalise_table(spark, d):
    s = read(spark, d, "supplier")
    row = F.array(F.col("s_suppkey").cast("string"), F.concat(F.lit(" "), F.col("s_name"), F.lit("\t")), F.when(F.col("s_acctbal") < 0, "").otherwise(F.floor("s_acctbal").cast("int").cast("string")))
    row = F.when(F.col("s_acctbal") < 0, F.slice(row, 1, 2)).otherwise(row)
    rows = F.concat(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", row.alias("row")))), lambda x: x["row"]), F.array(F.array(F.lit(" "))))
    tables = s.groupBy(F.col("s_nationkey").alias("k")).agg(rows.alias("rows")).withColumns({"headers": F.array(F.lit(""), F.lit("Name")), "caption": F.lit(""), "heading_path": F.array().cast("array<string>"), "source_name": F.lit("s")})
    done = b.normalise_tables(tables)
    return done.select("k", F.size("headers").alias("width"), F.transform("rows", lambda r: F.array_join(r, "|")).alias("lines"), F.array_join("headers", "|").alias("headers"))


@query("""
SELECT 'c' || c_nationkey AS corpus_id, c_custkey AS block_pos, 'Block ' || c_custkey || ': ' || CASE
  WHEN c_custkey % 11 = 0 THEN 'requires a non-empty string type' WHEN c_custkey % 7 = 0 THEN 'requires a string source_name'
  WHEN c_nationkey = 0 THEN 'page must be a positive integer or null' WHEN c_custkey % 5 = 0 THEN 'bbox boundaries are reversed'
  ELSE 'non-table block requires string text' END AS message
FROM customer WHERE c_custkey % 11 = 0 OR c_custkey % 7 = 0 OR c_nationkey = 0 OR c_custkey % 5 = 0 OR c_custkey % 3 = 0""")
def validate_violations(spark, d):
    k = F.col("c_custkey")
    none = lambda kind: F.lit(None).cast(kind)
    rows = read(spark, d, "customer").select(
        F.concat(F.lit("c"), F.col("c_nationkey").cast("string")).alias("corpus_id"), k.alias("block_pos"), F.when(k % 11 == 0, " ").otherwise("paragraph").alias("type"), F.when(k % 3 != 0, F.col("c_name")).alias("text"),
        F.when(k % 7 != 0, "s").alias("source_name"), F.lit("").alias("source_url"), F.col("c_nationkey").alias("page"), F.array().cast("array<string>").alias("heading_path"), none("string").alias("table_id"),
        none("string").alias("caption"), none("array<string>").alias("headers"), none("array<array<string>>").alias("rows"), F.when(k % 5 == 0, F.array(*map(F.lit, (2.0, 0.0, 1.0, 3.0)))).alias("bbox"),
    )
    return b.violations(rows)


def _talk(spark, d) -> DataFrame:
    """Conversations as blocks: system turns are headings, user turns paragraphs, answers tables of one row."""
    c = read(spark, d, "conversations")
    table = F.col("role") == "assistant"
    none = F.array().cast("array<string>")
    return c.select(
        F.col("conv_id").cast("string").alias("corpus_id"), F.col("turn").alias("block_pos"), F.when(table, "table").when(F.col("turn") % 3 == 0, "heading").otherwise("paragraph").alias("type"),
        F.when(~table, F.col("text")).alias("text"), F.lit("chat").alias("source_name"), F.lit("").alias("source_url"), (F.floor(F.col("turn") / 4) + 1).cast("int").alias("page"), none.alias("heading_path"),
        F.when(table, F.concat(F.lit("t"), F.col("turn").cast("string"))).alias("table_id"), F.when(table, "").alias("caption"), F.when(table, F.array(F.lit("Answer"))).alias("headers"),
        F.when(table, F.array(F.array("text"))).alias("rows"), F.lit(None).cast("array<double>").alias("bbox"),
    )


_TALK = """
WITH talk AS (SELECT conv_id::VARCHAR AS corpus_id, turn AS block_pos, CASE WHEN role = 'assistant' THEN 'table' WHEN turn % 3 = 0 THEN 'heading' ELSE 'paragraph' END AS type,
  text, (floor(turn / 4.0) + 1)::INTEGER AS page FROM conversations)"""


@query(
    _TALK
    + f""", w AS (SELECT *, lag(type) OVER o AS pt, lag({_clean_sql("text")}) OVER o AS px, lag(page) OVER o AS pp FROM talk WINDOW o AS (PARTITION BY corpus_id ORDER BY block_pos))
SELECT corpus_id, block_pos, CASE WHEN type = 'table' AND pt = 'heading' AND px <> '' AND pp = page THEN px ELSE '' END AS heading FROM w"""
)
def associate_headings(spark, d):
    rows = b.associate_headings(_talk(spark, d))
    return rows.select("corpus_id", "block_pos", F.array_join("heading_path", " > ").alias("heading"))


@query(
    _TALK
    + f""", a AS (SELECT *, lag(type) OVER o AS pt, lag({_clean_sql("text")}) OVER o AS px, lag(page) OVER o AS pp FROM talk WINDOW o AS (PARTITION BY corpus_id ORDER BY block_pos))
SELECT corpus_id, block_pos, px AS text FROM (SELECT corpus_id, block_pos - 1 AS block_pos, px, pt, pp, page, type FROM a) WHERE type = 'table' AND pt = 'heading' AND px <> '' AND pp = page"""
)
def retained_intro_blocks(spark, d):
    rows = b.associate_headings(_talk(spark, d))
    after = F.lead(F.struct("type", "page", "heading_path")).over(Window.partitionBy("corpus_id").orderBy("block_pos"))
    rows = rows.withColumn("next", after).withColumn("text", t.clean(F.col("text")))
    held = (F.col("next.type") == "table") & (F.col("next.page") == F.col("page")) & (F.col("type") == "heading") & (F.col("text") != "") & t.starts_with_path(F.col("next.heading_path"), F.array_append(t.clean_path(F.col("heading_path")), F.col("text")))
    return rows.filter(held).select("corpus_id", "block_pos", "text")


# chunking -------------------------------------------------------------------

_SUPPLIER = """
WITH RECURSIVE r AS (SELECT s_nationkey AS k, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS n, 'Supplier = ' || s_name || '; Key = ' || s_suppkey || '.' AS line FROM supplier),
c AS (SELECT *, {count} AS words FROM r),
p AS (SELECT k, n, line, 0 AS pack, {prefix} + words AS run FROM c WHERE n = 1
  UNION ALL SELECT c.k, c.n, c.line, CASE WHEN p.run + c.words > 30 THEN p.pack + 1 ELSE p.pack END, CASE WHEN p.run + c.words > 30 THEN {prefix} + c.words ELSE p.run + c.words END
  FROM p JOIN c ON c.k = p.k AND c.n = p.n + 1)"""
_SUPPLIER = _SUPPLIER.format(count=_count_sql("line"), prefix=2)


def _supplier_tables(spark, d) -> DataFrame:
    s = read(spark, d, "supplier")
    rows = F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", F.array("s_name", F.col("s_suppkey").cast("string")).alias("row")))), lambda x: x["row"])
    return s.groupBy("s_nationkey").agg(rows.alias("rows")).select(
        F.col("s_nationkey").cast("string").alias("corpus_id"), F.lit(0).cast("long").alias("block_pos"), F.lit("table").alias("type"), F.lit(None).cast("string").alias("text"), F.lit("tpch").alias("source_name"), F.lit("").alias("source_url"),
        F.lit(None).cast("int").alias("page"), F.array(F.lit("All suppliers")).alias("heading_path"), F.lit("suppliers").alias("table_id"), F.lit("").alias("caption"), F.array(F.lit("Supplier"), F.lit("Key")).alias("headers"), "rows",
        F.lit(None).cast("array<double>").alias("bbox"),
    )


@query(_SUPPLIER + " SELECT k::VARCHAR AS corpus_id, pack AS id, min(n)::INTEGER AS row_start, max(n)::INTEGER AS row_end, 'All suppliers' || chr(10) || string_agg(line, chr(10) ORDER BY n) AS source_text FROM p GROUP BY k, pack")
def pack_rows(spark, d):
    chunks = chunking.chunk_blocks(_supplier_tables(spark, d), 30, 0)
    return chunks.select("corpus_id", F.col("id").cast("int").alias("id"), "row_start", "row_end", "source_text")


@query("""
WITH RECURSIVE t AS (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL),
g AS (SELECT l_orderkey, l_linenumber, n, 2 AS c, 0 AS g, 4 AS words FROM t
  UNION ALL SELECT l_orderkey, l_linenumber, n, c + 1, CASE WHEN words + 2 > 6 THEN g + 1 ELSE g END, CASE WHEN words + 2 > 6 THEN 4 ELSE words + 2 END FROM g WHERE c < 6)
SELECT l_orderkey, l_linenumber, n AS lines, g::INTEGER AS grp, '1,' || string_agg(c::VARCHAR, ',' ORDER BY c) AS cols FROM g GROUP BY l_orderkey, l_linenumber, n, g""")
def column_groups(spark, d):
    names = {"Key": "l_orderkey", "Part": "l_partkey", "Flag": "l_returnflag", "Status": "l_linestatus", "Supplier": "l_suppkey", "Line": "l_linenumber"}
    cells = F.array(*[F.col(c).cast("string") for c in names.values()])
    tables = read(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.collect_list(cells).alias("rows"))
    found = chunking.column_groups(F.array(*map(F.lit, names)), F.col("rows"), F.lit(0), 6)
    rows = tables.select("l_orderkey", "l_linenumber", F.size("rows").cast("long").alias("lines"), F.posexplode(found).alias("grp", "cols"))
    return rows.withColumn("cols", F.array_join(F.transform("cols", lambda c: c.cast("string")), ","))


_GROUPS_FOR = f"""
WITH RECURSIVE talk AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, turn, {_clean_sql("text")} AS x, (floor(turn / 4.0) + 1)::INTEGER AS page FROM conversations),
w AS (SELECT *, {_count_sql("x")} AS words FROM talk),
f AS (SELECT conv_id, n, turn, page, x, 0 AS g, words AS run, page AS lo FROM w WHERE n = 1
  UNION ALL SELECT w.conv_id, w.n, w.turn, w.page, w.x, CASE WHEN cut THEN f.g + 1 ELSE f.g END, CASE WHEN cut THEN w.words ELSE f.run + w.words END, CASE WHEN cut THEN w.page ELSE f.lo END
  FROM f JOIN w ON w.conv_id = f.conv_id AND w.n = f.n + 1, LATERAL (SELECT (w.page > f.page + 1 OR w.page - f.lo + 1 > 2 OR (w.page <> f.page AND f.run >= LEAST)) AS cut))"""
_GROUPS, _GROUPS_40 = _GROUPS_FOR.replace("LEAST)", "100)"), _GROUPS_FOR.replace("LEAST)", "40)")


def _plain(spark, d) -> DataFrame:
    """Conversations as paragraphs; four turns are a page."""
    talk = _talk(spark, d).drop("text", "type", "rows", "headers", "table_id", "caption")
    texts = read(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("corpus_id"), F.col("turn").alias("block_pos"), "text")
    none = lambda kind: F.lit(None).cast(kind)
    return talk.join(texts, ["corpus_id", "block_pos"]).withColumns({"type": F.lit("paragraph"), "rows": none("array<array<string>>"), "headers": none("array<string>"), "table_id": none("string"), "caption": none("string")})


@query(_GROUPS + " SELECT conv_id::VARCHAR AS corpus_id, min(turn) AS first_turn, count(*) AS members FROM f GROUP BY conv_id, g")
def text_groups(spark, d):
    groups = chunking.text_groups(_plain(spark, d))
    return groups.select("corpus_id", F.col("members")[0]["block_pos"].alias("first_turn"), F.size("members").cast("long").alias("members"))


@query(
    _GROUPS_40
    + f""", j AS (SELECT conv_id, g, min(turn) AS first_turn, string_agg(x, chr(10) || chr(10) ORDER BY n) FILTER (WHERE x <> '') AS src FROM f GROUP BY conv_id, g),
e AS (SELECT conv_id, g, page, sum({_count_sql("x")}) OVER (PARTITION BY conv_id, g ORDER BY n) AS hi, {_count_sql("x")} AS c FROM f),
k AS (SELECT *, unnest(range(0, (greatest(0, ceil(({_count_sql("src")} - 40) / 30.0::DOUBLE)) + 1)::BIGINT)) AS id FROM j WHERE {_count_sql("src")} > 0)
SELECT k.conv_id::VARCHAR AS corpus_id, first_turn, k.id::INTEGER AS local_id, min(page) AS page, count(DISTINCT page) AS n_pages
FROM k JOIN e ON e.conv_id = k.conv_id AND e.g = k.g AND e.c > 0 AND e.hi > k.id * 30 AND e.hi - e.c < least(k.id * 30 + 40, {_count_sql("src")}) GROUP BY 1, 2, 3"""
)
def page_provenance(spark, d):
    found = chunking.text_chunks(_plain(spark, d), 40, 10, 100, 2)
    return found.select("corpus_id", F.col("_pos").alias("first_turn"), F.col("_local").alias("local_id"), "page", F.coalesce(F.size("pages"), F.lit(1)).cast("long").alias("n_pages"))


@query(
    _GROUPS_40
    + f""", j AS (SELECT conv_id, g, min(turn) AS first_turn, string_agg(x, chr(10) || chr(10) ORDER BY n) FILTER (WHERE x <> '') AS src FROM f GROUP BY conv_id, g),
e AS (SELECT conv_id, g, page, sum({_count_sql("x")}) OVER (PARTITION BY conv_id, g ORDER BY n) AS hi, {_count_sql("x")} AS c FROM f),
k AS (SELECT *, unnest(range(0, (greatest(0, ceil(({_count_sql("src")} - 40) / 30.0::DOUBLE)) + 1)::BIGINT)) AS id FROM j WHERE {_count_sql("src")} > 0)
SELECT k.conv_id::VARCHAR AS corpus_id, first_turn, k.id::INTEGER AS local_id, 'chat' AS source_name, NULL::VARCHAR AS source_url, 'text' AS block_type, CASE WHEN count(DISTINCT page) > 1 THEN min(page) END AS page_start, CASE WHEN count(DISTINCT page) > 1 THEN max(page) END AS page_end, NULL::VARCHAR AS table_id
FROM k JOIN e ON e.conv_id = k.conv_id AND e.g = k.g AND e.c > 0 AND e.hi > k.id * 30 AND e.hi - e.c < least(k.id * 30 + 40, {_count_sql("src")}) GROUP BY 1, 2, 3"""
)
def chunk_metadata(spark, d):
    found = chunking.text_chunks(_plain(spark, d), 40, 10, 100, 2)
    return found.select("corpus_id", F.col("_pos").alias("first_turn"), F.col("_local").alias("local_id"), "source_name", "source_url", "block_type", "page_start", "page_end", "table_id")


@query(f"""
SELECT conv_id::VARCHAR AS corpus_id, coalesce(string_agg(NULLIF(x, ''), chr(10) || chr(10) ORDER BY turn), '') || chr(10) AS text, len(coalesce(string_agg(NULLIF(x, ''), chr(10) || chr(10) ORDER BY turn), ''))::INTEGER AS characters
FROM (SELECT conv_id, turn, {_clean_sql('text')} AS x FROM conversations) GROUP BY conv_id HAVING count(*) FILTER (WHERE x <> '') > 0""")
def ordered_corpus_text(spark, d):
    return corpus.readable(_plain(spark, d))


@query(f"SELECT conv_id::VARCHAR AS corpus_id, turn AS block_pos FROM conversations WHERE {_clean_sql('text')} <> ''")
def usable_blocks(spark, d):
    return b.usable(_plain(spark, d)).select("corpus_id", "block_pos")


@query(f"SELECT doc_id AS block_pos, {_clean_sql('text')} AS text, {_clean_sql('source')} AS source_name, {_clean_sql('lang')} AS path FROM documents")
def text_blocks(spark, d):
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("block_pos"), F.lit("paragraph").alias("type"), "text", F.concat(F.lit(" "), "source", F.lit("\t")).alias("source_name"), F.array(F.lit(" "), F.concat("lang", F.lit("  "))).alias("heading_path"))
    none = {c: F.lit(None).cast(k) for c, k in (("headers", "array<string>"), ("rows", "array<array<string>>"), ("caption", "string"))}
    return b.normalise(docs.withColumns(none)).select("block_pos", "text", "source_name", F.array_join("heading_path", " > ").alias("path"))


# sources --------------------------------------------------------------------


@query(r"SELECT page_id, url, regexp_matches(url, '(?i)^https?://[^/?#\s@]+(?:[/?#]|$)') AS valid, lower(regexp_extract(url, '(?i)^https?://([^/?#:]*)', 1)) AS host FROM pages")
def valid_urls(spark, d):
    return read(spark, d, "pages").select("page_id", "url", urls.is_valid(F.col("url")).alias("valid"), urls.host(F.col("url")).alias("host"))


@query("SELECT url, min(page_id) AS page_id, lower(regexp_extract(url, '(?i)^https?://([^/?#:]*)', 1)) AS host FROM pages GROUP BY url")
def distinct_urls(spark, d):
    return urls.distinct_urls(read(spark, d, "pages"), "page_id").select("url", "page_id", urls.host(F.col("url")).alias("host"))


@query("SELECT (page_id // 10)::BIGINT AS list, substr(sha256('[' || string_agg('\"' || url || '\"', ',' ORDER BY page_id) || ']'), 1, 16) AS request_key FROM pages GROUP BY 1")
def request_key(spark, d):
    p = read(spark, d, "pages").withColumn("list", F.expr("page_id div 10"))
    return urls.request_keys(p, "list", "page_id")


@query("""
WITH j AS (SELECT n_regionkey, '[' || string_agg('["' || n_nationkey || '","' || n_name || '"]', ',' ORDER BY n_nationkey) || ']' AS rows FROM nation GROUP BY 1)
SELECT n_regionkey::VARCHAR AS corpus_id, substr(sha256('[{"caption":"","headers":["Key","Name"],"heading_path":[],"page":null,"rows":' || rows || ',"source_name":"tpch","source_url":"","table_id":"t","type":"table"}]'), 1, 16) AS content_key FROM j""")
def content_key(spark, d):
    rows = _nation_tables(spark, d).select(
        F.col("n_regionkey").cast("string").alias("corpus_id"), F.lit(0).alias("block_pos"), F.lit("").alias("caption"), "headers", F.array().cast("array<string>").alias("heading_path"), F.lit(None).cast("int").alias("page"), "rows",
        F.lit("tpch").alias("source_name"), F.lit("").alias("source_url"), F.lit("t").alias("table_id"), F.lit("table").alias("type"),
    )
    return corpus.content_keys(rows)


_ENTITIES = "{}"
for _code, _char in (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&#x27;", "''"), ("&#39;", "''"), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("&amp;", "&"), ("&amp", "&")):
    _ENTITIES = f"replace({_ENTITIES}, '{_code}', '{_char}')"


@query(f"SELECT page_id, {_clean_sql(_ENTITIES.format('regexp_extract(html, ' + repr('(?is)<title[^>]*>(.*?)</title>') + ', 1)'))} AS title FROM pages")
def html_titles(spark, d):
    return html.parse_pages(read(spark, d, "pages")).select("page_id", "title")


@query(f"SELECT page_id, {_clean_sql(_ENTITIES.format('regexp_extract(html, ' + repr('(?is)<h1[^>]*>(.*?)</h1>') + ', 1)'))} AS h1 FROM pages")
def html_h1(spark, d):
    heads = F.filter("found", lambda x: (x["type"] == "heading"))
    return html.parse_pages(read(spark, d, "pages")).select("page_id", F.coalesce(F.try_element_at(F.transform(heads, lambda x: x["text"]), F.when(F.col("title") != "", 2).otherwise(1)), F.lit("")).alias("h1"))


def _html_sql() -> str:
    """Blocks of the driver's pages: a paragraph that isn't closed before the next one holds all that follows in its article."""
    between = lambda tag: _clean_sql(_ENTITIES.format(f"regexp_extract(html, '(?is)<{tag}[^>]*>(.*?)</{tag}>', 1)"))
    bare = _ENTITIES.format("regexp_replace(raw, '<[^>]*>', ' ', 'g')")
    return f"""
WITH a AS (SELECT page_id, coalesce(url, '') AS url, {between('title')} AS title, {between('h1')} AS h1, string_split(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '<p>') AS parts FROM pages),
p AS (SELECT page_id, parts, unnest(range(2, len(parts) + 1)) AS o FROM a),
x AS (SELECT page_id, o, CASE WHEN contains(parts[o], '</p>') THEN string_split(parts[o], '</p>')[1] ELSE array_to_string(parts[o:], ' ') END AS raw FROM p),
u AS (SELECT page_id, 0 AS o, 'heading' AS type, title AS text, false AS under FROM a UNION ALL SELECT page_id, 1, 'heading', h1, false FROM a UNION ALL SELECT page_id, o, 'paragraph', {_clean_sql(bare)}, true FROM x),
b AS (SELECT page_id::VARCHAR AS corpus_id, (row_number() OVER (PARTITION BY page_id ORDER BY o) - 1)::BIGINT AS block_pos, o, type, text, CASE WHEN under THEN h1 ELSE '' END AS path, CASE WHEN title = '' THEN url ELSE title END AS source_name, url AS source_url, h1, title
  FROM u JOIN a USING (page_id) WHERE text <> ''),
s AS (SELECT *, CASE WHEN path = '' THEN text ELSE path || chr(10) || text END AS shown FROM b)"""


@query(_html_sql() + " SELECT corpus_id, block_pos, type, text, source_name, source_url, path FROM b")
def html_blocks(spark, d):
    return html.html_blocks(read(spark, d, "pages")).select("corpus_id", "block_pos", "type", "text", "source_name", "source_url", F.array_join("heading_path", " > ").alias("path"))


@query(_html_sql() + " SELECT a.page_id, a.title, coalesce(string_agg(shown, chr(10) ORDER BY block_pos), '') AS text FROM a LEFT JOIN s ON s.corpus_id = a.page_id::VARCHAR GROUP BY a.page_id, a.title")
def html_text(spark, d):
    return html.html_text(read(spark, d, "pages"))


_HTML_CHUNKS = f"""
, g AS (SELECT corpus_id, source_name, source_url, h1, o = 0 AND h1 <> '' AS alone, min(block_pos) AS pos, string_agg(text, chr(10) || chr(10) ORDER BY block_pos) AS src FROM b GROUP BY ALL),
w AS (SELECT *, regexp_extract_all(src, '{_WORD}') AS words, regexp_extract_all(src, '{_PIECE}') AS pieces FROM g),
k AS (SELECT *, unnest(range(0, (greatest(0, ceil((len(words) - 450) / 390::DOUBLE)) + 1)::BIGINT)) AS k FROM w WHERE len(words) > 0)
SELECT corpus_id, (row_number() OVER (PARTITION BY corpus_id ORDER BY pos, k) - 1)::BIGINT AS id, array_to_string(words[k * 390 + 1 : k * 390 + 450], ' ') AS text,
       {_strip_sql("array_to_string(pieces[k * 390 + 1 : k * 390 + 450], '')")} AS source_text, 'text' AS block_type, NULLIF(source_name, '') AS source_name, NULLIF(source_url, '') AS source_url,
       CASE WHEN NOT alone AND h1 <> '' AND k * 390 >= {_count_sql('h1')} THEN h1 END AS path FROM k"""


@query(_html_sql() + _HTML_CHUNKS)
def html_to_chunks(spark, d):
    chunks = chunking.chunk_blocks(html.html_blocks(read(spark, d, "pages")))
    return chunks.select("corpus_id", "id", "text", "source_text", "block_type", "source_name", "source_url", F.array_join("heading_path", " > ").alias("path"))


@query(_html_sql() + " SELECT corpus_id, string_agg(shown, chr(10) || chr(10) ORDER BY block_pos) || chr(10) AS text, len(string_agg(shown, chr(10) || chr(10) ORDER BY block_pos))::INTEGER AS characters FROM s GROUP BY corpus_id")
def web_corpus_text(spark, d):
    return corpus.readable(html.html_blocks(read(spark, d, "pages")))


@query(_windows_sql(30, 10).replace("SELECT doc_id, id", "SELECT doc_id, id"))
def chunk_words_in_sql(spark, d):
    sql.register(spark)
    read(spark, d, "documents").createOrReplaceTempView("gridloom_documents")
    return spark.sql("SELECT doc_id, w.id, w.text, w.source_text FROM (SELECT doc_id, word_windows(text, 30, 10) AS found FROM gridloom_documents) LATERAL VIEW explode(found) AS w")


@query(f"SELECT doc_id, {_count_sql('text')}::BIGINT AS words, 'Language = ' || {_clean_sql('lang')} || '; Source = ' || {_clean_sql('source')} || '.' AS line FROM documents")
def words_and_rows_in_sql(spark, d):
    sql.register(spark)
    read(spark, d, "documents").createOrReplaceTempView("gridloom_documents")
    return spark.sql("SELECT doc_id, CAST(size(tokenize_words(text)) AS BIGINT) AS words, render_table_row(array('Language', 'Source', 'None'), array(lang, source, ' ')) AS line FROM gridloom_documents")


# saved and streamed -----------------------------------------------------------


@query(_SUPPLIER + " SELECT k::VARCHAR AS corpus_id, pack AS id, min(n)::INTEGER AS row_start, max(n)::INTEGER AS row_end, 'All suppliers' || chr(10) || string_agg(line, chr(10) ORDER BY n) AS source_text FROM p GROUP BY k, pack")
def streamed_chunks(spark, d):
    """Whole corpora in two files, chunked as a stream in two batches and read back."""
    with tempfile.TemporaryDirectory() as folder:
        rows = _supplier_tables(spark, d)
        for i in (0, 1):
            rows.filter(F.col("corpus_id").cast("int") % 2 == i).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        streaming.stream_chunks(streaming.read_blocks(spark, f"{folder}/in", 1), f"{folder}/out", f"{folder}/state", size=30, overlap=0).awaitTermination()
        found = spark.read.parquet(f"{folder}/out").select("corpus_id", F.col("id").cast("int").alias("id"), "row_start", "row_end", "source_text")
        return spark.createDataFrame(found.collect(), found.schema)


@query("SELECT (n_nationkey // 5)::BIGINT AS block_pos, n_name AS name, n_regionkey::VARCHAR AS region, 'nations' AS source_name FROM nation")
def saved_corpus(spark, d):
    """Saved as JSON, found again by its request and loaded."""
    n = read(spark, d, "nation").withColumn("pos", F.expr("n_nationkey div 5"))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", F.array("n_name", F.col("n_regionkey").cast("string")).alias("r")))), lambda x: x["r"])
    none = lambda kind: F.lit(None).cast(kind)
    tables = n.groupBy("pos").agg(rows.alias("rows")).select(
        F.lit("c").alias("corpus_id"), F.col("pos").alias("block_pos"), F.lit("table").alias("type"), none("string").alias("text"), F.lit("nations").alias("source_name"), F.lit("").alias("source_url"), none("int").alias("page"),
        F.array().cast("array<string>").alias("heading_path"), F.lit("t").alias("table_id"), F.lit("").alias("caption"), F.array(F.lit("Name"), F.lit("Region")).alias("headers"), "rows", none("array<double>").alias("bbox"),
    )
    with tempfile.TemporaryDirectory() as folder:
        corpus.save_pointer(folder, corpus.save_corpus(tables, [{"kind": "table"}], folder, "request"))
        loaded = corpus.load_blocks(spark, corpus.cached(folder, "request").blocks_path)
        found = loaded.select("block_pos", F.explode("rows").alias("r"), "source_name").select("block_pos", F.col("r")[0].alias("name"), F.col("r")[1].alias("region"), "source_name")
        return spark.createDataFrame(found.collect(), found.schema)


@query(_SUPPLIER + " SELECT pack AS id, min(n)::INTEGER AS row_start, max(n)::INTEGER AS row_end FROM p WHERE k = (SELECT min(s_nationkey) FROM supplier) GROUP BY pack")
def chunks_file(spark, d):
    """One corpus chunked to a JSON file and read back."""
    rows = _supplier_tables(spark, d)
    least = rows.agg(F.min(F.col("corpus_id").cast("int"))).first()[0]
    with tempfile.TemporaryDirectory() as folder:
        api.build_chunks(spark, rows.filter(F.col("corpus_id") == str(least)), f"{folder}/chunks.json", chunk_size=30, chunk_overlap=0)
        values = json.loads(Path(folder, "chunks.json").read_text(encoding="utf-8"))
    return spark.createDataFrame([(v["id"], v["row_start"], v["row_end"]) for v in values], "id int, row_start int, row_end int")


# geometry -------------------------------------------------------------------


def _seconds(spark, d) -> DataFrame:
    e = read(spark, d, "events")
    return e.select("event_id", "user_id", "event_type", "value", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("x0")).withColumn("x1", F.col("x0") + F.col("value") * 100)


_SECONDS = "WITH RECURSIVE e AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) / 1e6 AS x0, epoch_us(ts) / 1e6 + value * 100 AS x1 FROM events)"


@query(
    _SECONDS
    + """, r AS (SELECT *, max(x1) OVER (PARTITION BY user_id ORDER BY x0, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM e)
SELECT event_id, user_id, sum(CASE WHEN reach IS NULL OR x0 - reach <= 3600 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY x0, event_id)::BIGINT AS grp FROM r"""
)
def gap_groups(spark, d):
    return geometry.gap_groups(_seconds(spark, d), ["user_id"], "x0", "x1", 3600.0, "event_id").select("event_id", "user_id", F.col("group").cast("long").alias("grp"))


@query(
    _SECONDS
    + """, n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY x0, event_id) AS n FROM e),
f AS (SELECT user_id, n, x0, x0 AS line FROM n WHERE n = 1 UNION ALL SELECT n.user_id, n.n, n.x0, CASE WHEN abs(n.x0 - f.line) <= 86400 THEN f.line ELSE n.x0 END FROM f JOIN n ON n.user_id = f.user_id AND n.n = f.n + 1)
SELECT user_id, line, count(*) AS members FROM f GROUP BY user_id, line"""
)
def anchor_lines(spark, d):
    lists = _seconds(spark, d).groupBy("user_id").agg(F.sort_array(F.collect_list("x0")).alias("xs"))
    lines = lists.select("user_id", F.explode(geometry.anchor_fold(F.col("xs"), 86400.0)).alias("line"))
    return lines.groupBy("user_id", "line").agg(F.count("*").alias("members"))


@query("""
WITH RECURSIVE n AS (SELECT user_id, value AS v, row_number() OVER (PARTITION BY user_id ORDER BY value) AS n FROM events),
f AS (SELECT user_id, n, v AS last, 0 AS k FROM n WHERE n = 1
  UNION ALL SELECT n.user_id, n.n, CASE WHEN abs(n.v - f.last) <= 1.0 THEN (f.last + n.v) / 2 ELSE n.v END, CASE WHEN abs(n.v - f.last) <= 1.0 THEN f.k ELSE f.k + 1 END FROM f JOIN n ON n.user_id = f.user_id AND n.n = f.n + 1)
SELECT user_id, k::INTEGER AS k, round(arg_max(last, n), 6) AS coordinate FROM f GROUP BY user_id, k""")
def unique_coordinates(spark, d):
    lists = read(spark, d, "events").groupBy("user_id").agg(F.collect_list("value").alias("v"))
    return lists.select("user_id", F.posexplode(geometry.unique_coordinates(F.col("v"))).alias("k", "c")).select("user_id", "k", F.round("c", 6).alias("coordinate"))


@query("""
WITH b AS (SELECT user_id, event_id, value - 5 AS lo, value + 5 AS hi FROM events WHERE event_type = 'purchase')
SELECT b.event_id AS box, count(*) AS words FROM events e JOIN b ON e.user_id = b.user_id AND e.value BETWEEN b.lo AND b.hi GROUP BY b.event_id""")
def words_in_box(spark, d):
    e = read(spark, d, "events").select("user_id", "event_id", "event_type", "value")
    boxes = e.filter("event_type = 'purchase'").select("user_id", F.col("event_id").alias("box"), (F.col("value") - 5).alias("x0"), (F.col("value") + 5).alias("x1"), F.lit(0.0).alias("top"), F.lit(0.0).alias("bottom"))
    inside = geometry.in_box(e.select("user_id", F.col("value").alias("cx"), F.lit(0.0).alias("cy")), boxes, ["user_id"], "cx", "cy", width=10.0)
    return inside.groupBy("box").agg(F.count("*").alias("words"))


@query("""
WITH s AS (SELECT o_custkey, o_totalprice - 1000 AS lo, o_totalprice + 1000 AS hi FROM orders WHERE o_orderstatus = 'F')
SELECT o_orderkey FROM orders o WHERE o_orderstatus <> 'F' AND NOT EXISTS (SELECT 1 FROM s WHERE s.o_custkey = o.o_custkey AND o.o_totalprice BETWEEN s.lo AND s.hi)""")
def outside_words(spark, d):
    o = read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
    spans = o.filter("o_orderstatus = 'F'").select("o_custkey", (F.col("o_totalprice") - 1000).alias("lo"), (F.col("o_totalprice") + 1000).alias("hi"))
    return geometry.outside(o.filter("o_orderstatus <> 'F'"), spans, "o_custkey", "o_totalprice", "lo", "hi", 2000.0).select("o_orderkey")


@query("""
SELECT event_id, caption::VARCHAR AS caption FROM (SELECT event_id, event_type, last_value(CASE WHEN event_type = 'view' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS caption FROM events) WHERE event_type = 'purchase'""")
def nearest_caption(spark, d):
    e = read(spark, d, "events")
    found = geometry.nearest_before(e, ["user_id"], ["ts", "event_id"], F.col("event_type") == "purchase", F.col("event_type") == "view", "event_id")
    return found.select("event_id", F.col("nearest").cast("string").alias("caption"))


_ANCHORS = [905.0, 1000.0, 1250.0, 1500.0]


@query(f"SELECT p_partkey, list_position(ds, list_min(ds))::INTEGER - 1 AS anchor FROM (SELECT p_partkey, [{', '.join(f'abs(p_retailprice - {a})' for a in _ANCHORS)}] AS ds FROM part)")
def nearest_anchor(spark, d):
    return geometry.nearest_anchor(read(spark, d, "part"), _ANCHORS, "p_retailprice").select("p_partkey", "anchor")


# brochures ------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, 'R21 113Y ' || floor(l_extendedprice)::BIGINT || ' Ft' AS compacted FROM lineitem")
def grouped_numbers(spark, d):
    li = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.floor("l_extendedprice").cast("long").alias("p"))
    spaced = F.concat(F.lit("R21 113Y "), F.replace(F.format_number("p", 0), F.lit(","), F.lit(" ")), F.lit(" Ft"))
    return _mapped(li.select("l_orderkey", "l_linenumber", spaced), lambda x: (layout.compact(x),), ["l_orderkey", "l_linenumber"], {"compacted": "string"})


@query("SELECT p_partkey, (replace(regexp_extract(replace(p_name || ' ' || p_retailprice, '.', ','), '-?[0-9]+(?:[.,][0-9]+)?'), ',', '.'))::DOUBLE AS number FROM part")
def first_number(spark, d):
    rows = read(spark, d, "part").select("p_partkey", F.replace(F.concat("p_name", F.lit(" "), F.col("p_retailprice").cast("string")), F.lit("."), F.lit(",")))
    return _mapped(rows, lambda x: (model_year.number(x),), ["p_partkey"], {"number": "double"})


@query("""
SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'STANDARD' WHEN 'O' THEN 'NOT_AVAILABLE' ELSE 'OPTION' END AS status,
       CASE WHEN o_orderstatus IN ('F', 'O') THEN 0.0 ELSE floor(o_totalprice) END::DOUBLE AS price FROM orders""")
def cell_status(spark, d):
    s, k = F.col("o_orderstatus"), F.col("o_orderkey") % 4
    standard = F.element_at(F.array(*map(F.lit, ("•", "alap •", " ● ", "·"))), (k + 1).cast("int"))
    missing = F.element_at(F.array(*map(F.lit, (" – ", "—", "*", "Nem elérhető"))), (k + 1).cast("int"))
    cell = F.when(s == "F", standard).when(s == "O", missing).otherwise(F.concat(F.floor("o_totalprice").cast("string"), F.lit(" Ft")))
    return _mapped(read(spark, d, "orders").select("o_orderkey", cell), lambda x: tuple(model_year.cell_status(x).values()), ["o_orderkey"], {"status": "string", "price": "double"})


@query("""
SELECT c_custkey, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'PHEV' WHEN c_mktsegment = 'BUILDING' THEN 'DIESEL' ELSE 'HYBRID' END AS kind FROM customer""")
def engine_kind(spark, d):
    seg = F.col("c_mktsegment")
    engine = F.when(seg == "MACHINERY", "1.6 Plug-in Hybrid").when(seg == "BUILDING", "1.5 Dízel").otherwise("1.2 Turbo Hybrid")
    return _mapped(read(spark, d, "customer").select("c_custkey", engine), lambda x: (model_year.engine_kind(x),), ["c_custkey"], {"kind": "string"})


@query("""
WITH c AS (SELECT p_partkey, p_brand, upper(array_to_string(regexp_extract_all(p_name, '[A-Za-z0-9]+'), '_')) AS code, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS pos FROM part),
n AS (SELECT *, row_number() OVER (PARTITION BY p_brand, code ORDER BY pos) AS nth FROM c)
SELECT p_brand, string_agg(CASE WHEN nth = 1 THEN code ELSE code || '_' || nth END, '|' ORDER BY pos) AS codes FROM n GROUP BY p_brand""")
def version_codes(spark, d):
    names = F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "p_name"))), lambda x: x["p_name"])
    lists = read(spark, d, "part").groupBy("p_brand").agg(names.alias("names"))
    return _mapped(lists, lambda names: ("|".join(model_year.version_codes([{"versionData": {"marketingName": n}} for n in names])),), ["p_brand"], {"codes": "string"})


def _customer_tables(spark, d) -> DataFrame:
    """Customers by nation as tables whose first column is the market segment."""
    c = read(spark, d, "customer")
    rows = F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", F.array("c_mktsegment", F.col("c_custkey").cast("string")).alias("r")))), lambda x: x["r"])
    return c.groupBy(F.col("c_nationkey").cast("string").alias("corpus_id")).agg(rows.alias("rows")).withColumns({"type": F.lit("table"), "block_pos": F.lit(0)})


@query("""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS n FROM customer)
SELECT c_nationkey::VARCHAR AS corpus_id, n::INTEGER AS row_no, lower(c_mktsegment) AS code, c_custkey::VARCHAR AS value FROM r WHERE lower(c_mktsegment) IN ('building', 'furniture')""")
def coded_rows(spark, d):
    return model_year.coded_rows(_customer_tables(spark, d), ["Building", "FURNITURE"]).select("corpus_id", "row_no", "code", F.col("row")[1].alias("value"))


@query("SELECT c_nationkey::VARCHAR AS corpus_id, bool_or(lower(c_mktsegment) = 'machinery') AND bool_or(c_custkey % 7 = 0) AS matches FROM customer GROUP BY 1")
def layout_signatures(spark, d):
    none = lambda kind: F.lit(None).cast(kind)
    tables = _customer_tables(spark, d).withColumn("rows", F.transform("rows", lambda r: F.array(r[0], F.when(r[1].cast("long") % 7 == 0, F.lit("Hetedik")).otherwise(F.lit("")))))
    return model_year.folded_signatures(tables.withColumns({"text": none("string"), "caption": none("string"), "headers": none("array<string>")}), ["machinery", "hetedik"])


_STATUS = "CASE WHEN o_orderpriority LIKE '1%' THEN 'STANDARD' WHEN o_orderpriority LIKE '2%' OR o_orderpriority LIKE '3%' THEN 'OPTION' ELSE 'NOT_AVAILABLE' END"


@query(f"SELECT o_custkey, arg_max(s, k) AS status, arg_max(o_totalprice, k) AS price FROM (SELECT *, (CASE s WHEN 'STANDARD' THEN 2 WHEN 'OPTION' THEN 1 ELSE 0 END) * 1e12 - o_orderkey AS k FROM (SELECT *, {_STATUS} AS s FROM orders)) GROUP BY 1")
def merge_status(spark, d):
    rows = read(spark, d, "orders").select("o_custkey", "o_orderkey", F.expr(_STATUS).alias("status"), F.col("o_totalprice").alias("price"))
    return geometry.merge_statuses(rows, ["o_custkey"], "o_orderkey")


@query("""
WITH v AS (SELECT r_name, row_number() OVER (ORDER BY r_regionkey) - 1 AS pos FROM region)
SELECT 'Nations' AS name, n_name AS option, pos::INTEGER AS position, upper(replace(r_name, ' ', '_')) AS version_code, CASE WHEN (n_nationkey + pos) % 3 = 0 THEN 'STANDARD' WHEN (n_nationkey + pos) % 3 = 1 THEN 'OPTION' ELSE 'NOT_AVAILABLE' END AS status,
       CASE WHEN (n_nationkey + pos) % 3 = 1 THEN n_nationkey * 10.0 ELSE 0.0 END::DOUBLE AS price FROM nation, v""")
def link_positions(spark, d):
    """A document of nations (options) by regions (versions) is linked, and its statuses come out as rows."""
    regions = [r.r_name for r in read(spark, d, "region").orderBy("r_regionkey").collect()]
    kinds = ("STANDARD", "OPTION", "NOT_AVAILABLE")
    options = [
        {"marketingName": n.n_name, "type": "OPTION", "versionStatus": [{"status": kinds[(n.n_nationkey + i) % 3], "priceGross": n.n_nationkey * 10.0 if (n.n_nationkey + i) % 3 == 1 else 0.0} for i in range(len(regions))]}
        for n in read(spark, d, "nation").orderBy("n_nationkey").collect()
    ]
    draft = {"id": 1, "name": "Nations", "versions": [{"id": i, "versionData": {"marketingName": r}} for i, r in enumerate(regions)], "options": options}
    return model_year.status_rows(model_year.typed(spark, [model_year.link(draft)]))


# documents of pages and brochures ----------------------------------------------


@query("SELECT * FROM (VALUES ('d', 0::BIGINT, 'table', 'Available accessories', 'Alpha kit|10000 Ft;Beta rack|20000 Ft', 1), ('d', 1, 'paragraph', 'Legal', NULL, 1), ('d', 2, 'paragraph', 'Caption here', NULL, 1), ('d', 3, 'table', 'Caption here', 'a|1', 1), ('d', 4, 'paragraph', 'second page', NULL, 2)) t(corpus_id, block_pos, type, shown, rows, page)")
def layout_tables(spark, d):
    words = fixtures.drawn(f"{fixtures.CARDS}|Caption@0,150,20,157|here@22,150,40,157|{fixtures.SMALL_WORDS}")
    kinds = {"words": PDF_WORD, "tables": PDF_TABLE, "cells": PDF_CELL, "images": PDF_BOX, "rects": PDF_BOX}
    box, rows = fixtures.SMALL
    values = {
        "words": [("d", 1, i, w.text, w.x0, w.top, w.x1, w.bottom, w.upright) for i, w in enumerate(words)] + [("d", 2, 0, "second", 0.0, 0.0, 9.0, 8.0, True), ("d", 2, 1, "page", 11.0, 0.0, 19.0, 8.0, None)],
        "tables": [("d", 1, 1, *map(float, box))], "cells": [("d", 1, 1, i, j, *map(float, c)) for i, row in enumerate(rows) for j, c in enumerate(row)],
        "images": [("d", 1, *map(float, p)) for p in fixtures.PICTURES], "rects": [("d", 1, *map(float, p)) for p in fixtures.RULE],
    }
    frames = {k: spark.createDataFrame(v, kinds[k]) for k, v in values.items()}
    pages = spark.createDataFrame([("d", 1, 300.0), ("d", 2, 300.0), ("e", 1, None)], "doc string, page int, width double")
    found = layout.layout_blocks(*(frames[k] for k in ("words", "tables", "cells", "images", "rects")), pages)
    return found.select("corpus_id", "block_pos", "type", F.coalesce("text", "caption").alias("shown"), F.array_join(F.transform("rows", lambda r: F.array_join(r, "|")), ";").alias("rows"), "page")


@query("SELECT * FROM (VALUES ('/a/x.pdf', 0::BIGINT, 'paragraph', 'Title'), ('/a/x.pdf', 1, 'table', 'Title'), ('/b/x.pdf', 0, 'paragraph', 'Title'), ('/b/x.pdf', 1, 'table', 'Title')) t(corpus_id, block_pos, type, shown)")
def pdf_rows(spark, d):
    files = spark.createDataFrame([("/a/x.pdf", bytearray(b"%PDF-")), ("/b/x.pdf", bytearray(b"%PDF-")), ("/empty.pdf", bytearray(b""))], "path string, content binary")
    pages = [[f"Title@0,10,20,17|{fixtures.SMALL_WORDS}", [fixtures.SMALL]]]
    found = pdf.extracted(files, lambda path: fixtures.FakeDocument(pages if path.stat().st_size else []))
    return found.select("corpus_id", "block_pos", "type", F.coalesce("text", "caption").alias("shown"))


@query("SELECT * FROM (VALUES (1, true, 2::BIGINT, 'pdf', 'sources/01_a.pdf', 2)) t(opened, same, blocks, kind, stored, pages)")
def cached_pdf_corpus(spark, d):
    """A file and a renamed copy of it: the second request is answered without reading."""
    opened: list[Path] = []

    def open_file(path: Path):
        opened.append(path)
        return fixtures.FakeDocument([["first@0,10,20,17", []], ["second@0,10,20,17", []]])

    with tempfile.TemporaryDirectory() as folder:
        for name in ("a.pdf", "copy.pdf"):
            Path(folder, name).write_bytes(b"%PDF-1.7 same")
        one, two = (pdf.prepare_pdf_corpus(spark, [str(Path(folder, n))], Path(folder, "out"), open_file=open_file) for n in ("a.pdf", "copy.pdf"))
        source = json.loads(one.sources_path.read_text(encoding="utf-8"))[0]
        found = (len(opened), one == two, len(json.loads(one.blocks_path.read_text(encoding="utf-8"))), source["kind"], source["stored_file"], source["pages"])
        assert (one.blocks_path.parent / source["stored_file"]).read_bytes() == b"%PDF-1.7 same"
    return spark.createDataFrame([found], "opened int, same boolean, blocks long, kind string, stored string, pages int")


@query("SELECT * FROM (VALUES (1, 'https://a.org', 'https://a.org/end', 'Specs', 'html', 10::BIGINT), (2, 'https://b.org', 'https://b.org', 'https://b.org', 'html', 10)) t(source, requested_url, final_url, title, kind, blocks)")
def web_corpora(spark, d):
    """Two fetched pages saved as one corpus; the second has no title."""
    pages = [("https://a.org", "https://a.org/end", fixtures.TABLE_PAGE), ("https://b.org", "https://b.org", "<h1>Head</h1><p>one</p><p>two</p><p>three</p>")]
    with tempfile.TemporaryDirectory() as folder:
        saved = api.web_corpus(spark, pages, folder, "request")
        sources = json.loads(saved.sources_path.read_text(encoding="utf-8"))
        blocks = len(corpus.load_blocks(spark, saved.blocks_path).collect())
    rows = [(x["source"], x["requested_url"], x["final_url"], x["title"], x["kind"], blocks) for x in sources]
    return spark.createDataFrame(rows, "source int, requested_url string, final_url string, title string, kind string, blocks long")


@query("SELECT * FROM (VALUES (0, 'one two three', 2), (1, 'three four', 2)) t(id, text, count)")
def chunk_answers(spark, d):
    block = {"type": "paragraph", "text": "one two three four", "source_name": "s"}
    answer = service.handle(spark, service.Limits(), "/v1/chunks", {"blocks": [block], "chunk_size": 3, "chunk_overlap": 1})
    return spark.createDataFrame([(c["id"], c["text"], answer["count"]) for c in answer["chunks"]], "id int, text string, count int")


_PRICE = "CASE WHEN v < 6 THEN [9990000, 10990000, 12190000][v // 2 + 1] ELSE [9990000, 10990000, 12190000][v - 5] END::DOUBLE"
_CODE = "CASE WHEN v < 6 THEN ['EDITION', 'GS', 'ULTIMATE'][v // 2 + 1] || ['_HYBRID_145_AT6', '_DIESEL_130_AT8'][v % 2 + 1] ELSE ['EDITION', 'GS', 'ULTIMATE'][v - 5] || '_PHEV_195_AT7' END"


@query(f"""
WITH n AS (SELECT n_nationkey::VARCHAR AS corpus_id, n_nationkey % 5 = 4 AS broken FROM nation), v AS (SELECT unnest(range(9)) AS v)
SELECT corpus_id, CASE WHEN NOT broken THEN 'Astra MY26B' END AS name, CASE WHEN NOT broken THEN v::INTEGER END AS position, CASE WHEN NOT broken THEN {_CODE} END AS code, CASE WHEN NOT broken THEN {_PRICE} END AS price FROM n JOIN v ON NOT broken OR v = 0""")
def model_year_documents(spark, d):
    """A brochure for each nation, a fifth of them without their first price table."""
    shown = json.dumps(fixtures.brochure())
    rows = read(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("corpus_id"), F.posexplode(F.from_json(F.lit(shown), f"array<{BLOCK_JSON}>")).alias("block_pos", "x"), (F.col("n_nationkey") % 5 == 4).alias("broken"))
    blocks = rows.filter("NOT broken OR block_pos > 0").select("corpus_id", F.col("block_pos").cast("long").alias("block_pos"), "x.*")
    built = model_year.documents(blocks)
    return built.select("corpus_id", "document.name", F.posexplode_outer("document.versions").alias("position", "v")).select("corpus_id", "name", "position", F.col("v.versionData.versionCode").alias("code"), F.col("v.versionData.priceGross").alias("price"))


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN 0 ELSE 1 END::INTEGER AS errors FROM nation")
def schema_column(spark, d):
    """Nations as JSON documents against a schema that allows names of every third."""
    n = read(spark, d, "nation")
    names = [r.n_name for r in n.filter("n_nationkey % 3 = 0").collect()]
    schema = {"type": "object", "required": ["name"], "properties": {"name": {"enum": names}, "key": {"type": "integer"}}}
    return n.select("n_nationkey", F.size(jsonschema.error_column(F.to_json(F.struct(F.col("n_name").alias("name"), F.col("n_nationkey").alias("key"))), schema)).alias("errors"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return QUERIES | fixtures.QUERIES


def oracle_sql() -> dict[str, str]:
    return ORACLES | fixtures.ORACLES
