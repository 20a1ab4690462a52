"""The structs that the engine's tables have, and the versions of its formats."""

from __future__ import annotations

from pyspark.sql import types as T

BLOCKS_VERSION = "1.0"
CHUNKS_VERSION = "1.1"
CORPUS_VERSION = "v1"
PDF_CORPUS_VERSION = "v16-layout"

_NAMED = {"STRING": T.StringType(), "BIGINT": T.LongType(), "INT": T.IntegerType(), "DOUBLE": T.DoubleType(), "BOOLEAN": T.BooleanType()}


def _kind(name: str) -> T.DataType:
    return T.ArrayType(_kind(name[6:-1])) if name.startswith("ARRAY<") else _NAMED[name]


def _struct(spec: str) -> T.StructType:
    """Of flat fields and arrays; made without a session, so workers can import this."""
    return T.StructType([T.StructField(n, _kind(k)) for n, k in (x.split(" ") for x in spec.split(", "))])


#: A block; ``block_pos`` is its place in the corpus.
BLOCK = _struct(
    "corpus_id STRING, block_pos BIGINT, type STRING, text STRING, source_name STRING, source_url STRING, page INT, "
    "heading_path ARRAY<STRING>, table_id STRING, caption STRING, headers ARRAY<STRING>, rows ARRAY<ARRAY<STRING>>, bbox ARRAY<DOUBLE>"
)
#: A chunk; fields that a kind of chunk lacks are null.
CHUNK = _struct(
    "corpus_id STRING, id BIGINT, text STRING, source_text STRING, block_type STRING, source_name STRING, source_url STRING, page INT, "
    "heading_path ARRAY<STRING>, page_start INT, page_end INT, pages ARRAY<INT>, table_id STRING, row_start INT, row_end INT, "
    "column_group ARRAY<STRING>, table_prefix STRING, table_row_texts ARRAY<STRING>"
)
SOURCE = _struct(
    "source STRING, kind STRING, requested_url STRING, final_url STRING, title STRING, characters BIGINT, filename STRING, bytes BIGINT, pages INT, stored_file STRING"
)
#: What the HTML parser gives for a page.
HTML_BLOCK = _struct("type STRING, text STRING, heading_path ARRAY<STRING>, table_id STRING, caption STRING, headers ARRAY<STRING>, rows ARRAY<ARRAY<STRING>>")
PDF_WORD = _struct("doc STRING, page INT, seq INT, text STRING, x0 DOUBLE, top DOUBLE, x1 DOUBLE, bottom DOUBLE, upright BOOLEAN")
PDF_TABLE = _struct("doc STRING, page INT, table_no INT, x0 DOUBLE, top DOUBLE, x1 DOUBLE, bottom DOUBLE")
PDF_CELL = _struct("doc STRING, page INT, table_no INT, row_no INT, cell_no INT, x0 DOUBLE, top DOUBLE, x1 DOUBLE, bottom DOUBLE")
PDF_BOX = _struct("doc STRING, page INT, x0 DOUBLE, top DOUBLE, x1 DOUBLE, bottom DOUBLE")
STATUS = "STRUCT<status: STRING, priceGross: DOUBLE>"
VERSION = "STRUCT<marketingName: STRING, priceGross: DOUBLE, engineLabel: STRING, transmissionLabel: STRING, trimLabel: STRING, versionCode: STRING>"
OPTION = f"STRUCT<marketingName: STRING, type: STRING, optionCode: STRING, description: STRING, versionStatus: ARRAY<{STATUS}>>"
MODEL_YEAR = f"name STRING, validFrom STRING, versions ARRAY<STRUCT<versionData: {VERSION}>>, options ARRAY<{OPTION}>"
#: A block as it is saved in JSON.
BLOCK_JSON = "STRUCT<type: STRING, text: STRING, source_name: STRING, source_url: STRING, page: INT, heading_path: ARRAY<STRING>, table_id: STRING, caption: STRING, headers: ARRAY<STRING>, rows: ARRAY<ARRAY<STRING>>, bbox: ARRAY<DOUBLE>>"
