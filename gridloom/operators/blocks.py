"""Blocks: normalisation, heading association, rendering, cells and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t


class BlockError(ValueError):
    """A block breaks the contract."""


def _base(header: Column, place: Column) -> Column:
    """A header's own name; a blank one is named by its place, from 1."""
    return F.coalesce(F.nullif(t.clean(header), F.lit("")), F.concat(F.lit("Column "), place.cast("string")))


def _fold(base: Column) -> Column:
    return F.replace(F.lower(base), F.lit("ß"), F.lit("ss"))


def _nth(base: Column, nth: Column) -> Column:
    return F.when(nth == 1, base).otherwise(F.concat(base, F.lit(" ("), nth.cast("string"), F.lit(")")))


def unique_headers(headers: Column) -> Column:
    """Blank headers become ``Column i``; a header that repeats gets ``(2)`` and so on.

    They are sorted, so that equal ones stand together; the work doesn't grow
    as the square of the width.
    """

    def runs(x):
        starts = F.filter(x["at"], lambda i: (i == 0) | (F.get(x["sorted"], i - 1)["fold"] != F.get(x["sorted"], i)["fold"]))
        named = lambda run: F.transform(run, lambda y, k: F.struct(y["at"].alias("at"), _nth(y["base"], k + 1).alias("name")))
        return t.let(starts, lambda s: F.flatten(F.transform(s, lambda i, k: named(F.slice(x["sorted"], i + 1, F.coalesce(F.get(s, k + 1), F.size(x["sorted"])) - i)))))

    # each list is computed once, as the input of the next step
    based = F.transform(headers, lambda h, i: F.struct(_base(h, i + 1).alias("base")))
    folded = F.transform(based, lambda x, i: F.struct(_fold(x["base"]).alias("fold"), i.alias("at"), x["base"].alias("base")))
    in_order = t.let(F.sort_array(folded), lambda x: F.struct(x.alias("sorted"), F.transform(x, lambda _, i: i).alias("at")))
    return F.transform(F.sort_array(t.let(in_order, runs)), lambda x: x["name"])


def unique_header_rows(headers: DataFrame, table: list[str], order: list[str], header: str) -> DataFrame:
    """``unique_headers`` of headers that are rows, for tables of any width:
    ``table``, pos (from 1) and header."""
    placed = headers.withColumn("pos", F.row_number().over(Window.partitionBy(*table).orderBy(*order)))
    based = placed.select(*table, "pos", _base(F.col(header), F.col("pos")).alias("_base"))
    nth = F.row_number().over(Window.partitionBy(*table, _fold(F.col("_base"))).orderBy("pos"))
    return based.select(*table, "pos", "_base", nth.alias("_nth")).select(*table, "pos", _nth(F.col("_base"), F.col("_nth")).alias("header"))


def normalise_tables(df: DataFrame) -> DataFrame:
    """Pads ``headers`` and ``rows`` to the table's width, cleans every cell,
    drops blank rows and makes headers unique."""
    width = F.greatest(F.size("headers"), F.coalesce(F.array_max(F.transform("rows", lambda r: F.size(r))), F.lit(0)))
    spots = F.when(width > 0, F.sequence(F.lit(1), width)).otherwise(F.array().cast("array<int>"))
    pad = lambda row: F.transform(spots, lambda i: t.clean(F.when(i <= F.size(row), F.element_at(row, i))))
    kept = F.filter("rows", lambda r: F.exists(r, lambda c: t.clean(c) != ""))
    return (
        df.withColumn("rows", F.coalesce("rows", F.array().cast("array<array<string>>")))
        .withColumn("headers", F.coalesce("headers", F.array().cast("array<string>")))
        .withColumns({"headers": unique_headers(F.transform(spots, lambda i: F.when(i <= F.size("headers"), F.element_at(F.col("headers"), i)))), "rows": F.transform(kept, pad)})
        .withColumns({"caption": t.clean(F.col("caption")), "heading_path": t.clean_path(F.col("heading_path")), "source_name": t.clean(F.col("source_name"))})
    )


def normalise(df: DataFrame) -> DataFrame:
    """Block rows with tables as ``normalise_tables`` makes them and texts
    cleaned, in one pass over ``df``."""
    table = F.col("type") == "table"
    done = normalise_tables(df.withColumn("_raw", F.struct("headers", "rows", "caption")))
    own = {c: F.when(table, F.col(c)).otherwise(F.col(f"_raw.{c}")) for c in ("headers", "rows", "caption")}
    return done.withColumns({**own, "text": F.when(table, F.col("text")).otherwise(t.clean(F.col("text")))}).drop("_raw")


def associate_headings(blocks: DataFrame) -> DataFrame:
    """A table takes the heading right before it into its path, unless caption or path say it already.

    Blocks travel as one struct: whatever is taken of the result, the shuffle
    is the same, so plans that use it twice share it.
    """
    place = ["source_name", "source_url", "page"]
    fields = [c for c in blocks.columns if c not in ("corpus_id", "block_pos")]
    whole = blocks.select("corpus_id", "block_pos", F.struct(*fields).alias("_block"))
    before = F.lag("_block").over(Window.partitionBy("corpus_id").orderBy("block_pos"))
    rows = whole.withColumn("_before", before).select("corpus_id", "block_pos", "_block.*", "_before")
    heading = t.clean(F.col("_before.text"))
    parent = t.clean_path(F.col("_before.heading_path"))
    full, own = F.array_append(parent, heading), t.clean_path(F.col("heading_path"))
    same = F.lit(True)
    for c in place:
        same = same & F.col(f"_before.{c}").eqNullSafe(F.col(c))
    takes = (
        (F.col("type") == "table") & (F.col("_before.type") == "heading") & (heading != "") & same
        & (t.clean(F.col("caption")) != heading) & ~t.starts_with_path(own, full) & ((F.size(own) == 0) | (own == parent))
    )
    return rows.withColumn("heading_path", F.when(F.coalesce(takes, F.lit(False)), full).otherwise(F.col("heading_path"))).drop("_before")


def rendered() -> Column:
    return t.render_block(*(F.col(c) for c in ("type", "text", "heading_path", "caption", "headers", "rows")))


def usable(blocks: DataFrame) -> DataFrame:
    return blocks.filter(t.strip(rendered()) != "")


def cells(tables: DataFrame, keys: list[str]) -> DataFrame:
    """One row per cell: ``keys``, row_no and col_no (from 1), header and value."""
    rows = tables.select(*keys, "headers", F.posexplode("rows").alias("row_no", "row"))
    return rows.select(*keys, "headers", "row_no", F.posexplode("row").alias("col_no", "value")).select(
        *keys, (F.col("row_no") + 1).alias("row_no"), (F.col("col_no") + 1).alias("col_no"), F.try_element_at("headers", F.col("col_no") + 1).alias("header"), "value"
    )


def violation() -> Column:
    """The first rule that a block breaks; null if it breaks none."""
    c = F.col
    page, box, headers, rows = c("page"), c("bbox"), c("headers"), c("rows")
    blank = lambda x: x.isNull() | (t.strip(x) == "")
    broken_row = F.array_position(F.transform(rows, lambda r: r.isNull() | (F.size(r) != F.size(headers))), True)
    null_row = F.array_position(F.transform(rows, lambda r: F.exists(r, lambda v: v.isNull())), True)
    first_bad = F.when(broken_row > 0, broken_row)
    first_null = F.when(null_row > 0, null_row)
    shape = F.concat(F.lit("table row "), first_bad.cast("string"), F.lit(" must have "), F.size(headers).cast("string"), F.lit(" cells"))
    nulls = F.concat(F.lit("table row "), first_null.cast("string"), F.lit(" cells must be strings"))
    table = c("type") == "table"
    finite = F.forall(box, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return (
        F.when(blank(c("type")), "requires a non-empty string type")
        .when(c("source_name").isNull(), "requires a string source_name")
        .when(page < 1, "page must be a positive integer or null")
        .when(F.exists("heading_path", lambda x: x.isNull()), "heading_path must be a string list")
        .when(box.isNotNull() & ((F.size(box) != 4) | ~finite), "bbox must contain four finite numbers")
        .when((box[0] > box[2]) | (box[1] > box[3]), "bbox boundaries are reversed")
        .when(table & blank(c("table_id")), "table requires a non-empty table_id")
        .when(table & (headers.isNull() | (F.size(headers) < 1) | F.exists(headers, blank)), "table headers must be non-empty strings")
        .when(table & rows.isNull(), "table rows must be a list")
        .when(table & first_bad.isNotNull() & (first_null.isNull() | (first_bad <= first_null)), shape)
        .when(table & first_null.isNotNull(), nulls)
        .when(~table & c("text").isNull(), "non-table block requires string text")
    )


def violations(blocks: DataFrame) -> DataFrame:
    """(corpus_id, block_pos, message) of every block that breaks a rule, with its first."""
    message = F.concat(F.lit("Block "), F.col("block_pos").cast("string"), F.lit(": "), violation())
    return blocks.select("corpus_id", "block_pos", message.alias("message")).filter("message IS NOT NULL")


def validated(blocks: DataFrame) -> DataFrame:
    """``blocks``, or the error of the first broken one."""
    first = violations(blocks).orderBy("corpus_id", "block_pos").first()
    if first:
        raise BlockError(first.message)
    return blocks


def corpus_text(blocks: DataFrame) -> DataFrame:
    """(corpus_id, text): the rendered blocks in order, a blank line between them."""
    parts = F.array_sort(F.collect_list(F.struct("block_pos", rendered().alias("text"))))
    return blocks.groupBy("corpus_id").agg(F.concat(t.strip(F.array_join(F.transform(parts, lambda p: p["text"]), "\n\n")), F.lit("\n")).alias("text"))
