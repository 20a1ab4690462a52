"""Chunks: windows of words for text, packs of whole rows for tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t
from . import blocks as b

SIZE, OVERLAP, LEAST, SPAN = 450, 60, 100, 2


def check(size: int, overlap: int, least: int = 0, span: int = 1) -> None:
    if size <= 0 or overlap < 0 or overlap >= size:
        raise ValueError("size must be positive, and overlap at least zero and below size")
    if least < 0:
        raise ValueError("min_text_size must be zero or greater")
    if span <= 0:
        raise ValueError("max_text_page_span must be greater than zero")


def windows(text: Column, size: int, overlap: int, more: Callable[[Column, Column], dict[str, Column]] = lambda lo, hi: {}) -> Column:
    """The windows of words of a text, an array of id, text and source_text,
    and of what ``more`` makes of the first word's number (from 0) and the
    number after the last.  Null if there are no words.

    Words and pieces are split once; a row that is exploded from this doesn't
    carry them, whose copies would grow as the square of the text.
    """
    check(size, overlap)
    step = size - overlap

    def cut(s):
        count = F.size(s["words"])
        many = F.greatest(F.lit(0), F.ceil((count - size) / F.lit(float(step)))).cast("int")

        def window(k):
            part = lambda c: F.slice(s[c], k * step + 1, F.lit(size))
            own = {"id": k, "text": F.array_join(part("words"), " "), "source_text": t.strip(F.array_join(part("pieces"), ""))}
            return F.struct(*[v.alias(n) for n, v in (own | more(k * step, F.least(k * step + size, count))).items()])

        return F.when(count > 0, F.transform(F.sequence(F.lit(0), many), window))

    return t.let(F.struct(t.tokens(text).alias("words"), t.pieces(text).alias("pieces")), cut)


def chunk_words(df: DataFrame, text: str, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """One row per window of words: the other columns, then id, text and source_text."""
    keep = [c for c in df.columns if c != text]
    return df.select(*keep, F.inline(windows(F.col(text), size, overlap)))


def row_packs(counts: Column, prefix_words: Column, size: int) -> Column:
    """The number of the pack of each row: a row begins a new one if the pack would exceed ``size``.

    Word counts add up over a pack's lines, so running sums stand for the text.
    """
    start = F.struct(F.lit(-1).alias("pack"), F.lit(0).cast("long").alias("run"), F.array().cast("array<int>").alias("out"))

    def packs(prefix):
        def step(acc, n):
            fresh = (acc["pack"] < 0) | (acc["run"] + n > size)
            pack = F.when(fresh, acc["pack"] + 1).otherwise(acc["pack"]).cast("int")
            run = F.when(fresh, prefix + n).otherwise(acc["run"] + n).cast("long")
            return F.struct(pack.alias("pack"), run.alias("run"), F.array_append(acc["out"], pack).alias("out"))

        return F.aggregate(counts, start, step, lambda acc: acc["out"])

    return t.let(prefix_words, packs)


def column_groups(headers: Column, rows: Column, prefix_words: Column, size: int) -> Column:
    """array<array<int>>: the columns (from 1) of each group of a table that is
    too wide; the first column is in every group.  One group for other tables."""
    cell = lambda h, v: F.when(t.clean(v) != "", t.word_count(h) + t.word_count(t.clean(v))).otherwise(F.lit(0))
    counted = F.transform(rows, lambda r: F.zip_with(headers, r, cell))
    width = F.size(headers)
    ints, first = "array<int>", F.array(F.lit(1))

    def groups(known):
        counts, prefix = known["counts"], known["prefix"]
        largest = F.array_max(F.transform(counts, lambda r: F.aggregate(r, F.lit(0), lambda a, x: a + x)))
        wide = (width > 1) & (F.coalesce(largest, F.lit(0)) + prefix > size)
        key = F.transform(counts, lambda r: r[0])
        start = F.struct(F.array().cast(f"array<{ints}>").alias("done"), F.array().cast(ints).alias("now"), key.alias("sums"))

        def step(acc, c):
            own = F.transform(counts, lambda r: F.element_at(r, c))
            sums = F.zip_with(acc["sums"], own, lambda a, x: a + x)
            over = (F.size(acc["now"]) > 0) & (F.array_max(sums) + prefix > size)
            return F.struct(
                F.when(over, F.array_append(acc["done"], F.concat(first, acc["now"]))).otherwise(acc["done"]).alias("done"),
                F.when(over, F.array(c)).otherwise(F.array_append(acc["now"], c)).cast(ints).alias("now"),
                F.when(over, F.zip_with(key, own, lambda a, x: a + x)).otherwise(sums).alias("sums"),
            )

        split = F.aggregate(F.sequence(F.lit(2), F.greatest(width, F.lit(2))), start, step, lambda acc: F.array_append(acc["done"], F.concat(first, acc["now"])))
        return F.when(wide, split).otherwise(F.array(F.when(width > 0, F.sequence(F.lit(1), width)).otherwise(F.array().cast(ints))))

    return t.let(F.struct(counted.alias("counts"), prefix_words.alias("prefix")), groups)


def _prefix_words() -> Column:
    return t.word_count(t.render_block(F.lit("table"), F.lit(""), F.col("heading_path"), F.col("caption"), F.col("headers"), F.lit(None).cast("array<array<string>>")))


def _metadata() -> dict[str, Column]:
    """Fields that a chunk takes from its block, null where blank."""
    return {
        "source_name": F.nullif(F.col("source_name"), F.lit("")), "source_url": F.nullif(F.col("source_url"), F.lit("")), "page": F.col("page"),
        "heading_path": F.when(F.size("heading_path") > 0, F.col("heading_path")),
    }


def table_chunks(tables: DataFrame, size: int) -> DataFrame:
    """Packs of whole rows of table blocks, wide tables in groups of columns."""
    grouped = tables.withColumn("_prefix", _prefix_words())
    grouped = grouped.withColumn("_groups", column_groups(F.col("headers"), F.col("rows"), F.col("_prefix"), size)).withColumn("_many", F.size("_groups"))
    grouped = grouped.select("*", F.posexplode("_groups").alias("_g", "_cols")).drop("_groups")
    pick = lambda a: F.transform("_cols", lambda i: F.element_at(a, i))
    grouped = grouped.withColumns(
        {
            "table_id": F.when(F.col("_many") > 1, F.concat("table_id", F.lit("-columns-"), (F.col("_g") + 1).cast("string"))).otherwise(F.col("table_id")),
            "rows": F.when(F.col("_many") > 1, F.transform("rows", pick)).otherwise(F.col("rows")),
            "headers": F.when(F.col("_many") > 1, pick(F.col("headers"))).otherwise(F.col("headers")),
        }
    )
    texts = grouped.withColumn("_texts", F.transform("rows", lambda r: t.render_row(F.col("headers"), r)))
    packs = texts.withColumn("_packs", row_packs(F.transform("_texts", t.word_count), F.col("_prefix"), size))
    each = packs.withColumn("_pack", F.explode(F.array_distinct("_packs"))).withColumn("_lo", F.array_position("_packs", F.col("_pack")).cast("int"))
    n = F.size(F.filter("_packs", lambda p: p == F.col("_pack")))
    each = each.withColumn("_hi", F.col("_lo") + n - 1).withColumn("_some", F.slice("rows", F.col("_lo"), F.col("_hi") - F.col("_lo") + 1))
    source = t.render_block(F.lit("table"), F.lit(""), F.col("heading_path"), F.col("caption"), F.col("headers"), F.col("_some"))
    prefix = F.concat_ws("\n", F.nullif(F.array_join("heading_path", " > "), F.lit("")), F.nullif(F.coalesce("caption", F.lit("")), F.lit("")))
    out = each.withColumn("source_text", source)
    return out.select(
        "corpus_id", F.col("block_pos").alias("_pos"), F.col("_g"), F.col("_pack").alias("_local"), F.array_join(t.tokens(F.col("source_text")), " ").alias("text"), "source_text", F.lit("table").alias("block_type"),
        *[v.alias(k) for k, v in _metadata().items()], F.lit(None).cast("int").alias("page_start"), F.lit(None).cast("int").alias("page_end"), F.lit(None).cast("array<int>").alias("pages"),
        "table_id", F.col("_lo").alias("row_start"), F.col("_hi").alias("row_end"), F.col("headers").alias("column_group"), prefix.alias("table_prefix"), F.slice("_texts", F.col("_lo"), F.col("_hi") - F.col("_lo") + 1).alias("table_row_texts"),
    )


def text_islands(blocks: DataFrame) -> DataFrame:
    """Adds ``island``: a new one begins at a table, and at a text block that
    can't join the block before it, whatever came earlier."""
    order = Window.partitionBy("corpus_id").orderBy("block_pos")
    rows = blocks.withColumns({"_clean": t.clean(F.col("text")), "_path": t.clean_path(F.col("heading_path"))})
    rows = rows.withColumn("_before", F.lag(F.struct("type", "_clean", "_path", "source_name", "source_url", "page")).over(order))
    p = lambda c: F.col(f"_before.{c}")
    full = F.array_append(p("_path"), p("_clean"))
    leads = (p("type") == "heading") & (p("_clean") != "")
    introduces = leads & (t.starts_with_path(F.col("_path"), full) | ((F.col("type") != "heading") & (F.col("_path") == p("_path"))))
    joins = F.when(F.col("type") == "heading", introduces).otherwise((F.col("_path") == p("_path")) | introduces)
    pages = F.when(F.col("page").isNull() | p("page").isNull(), F.col("page").isNull() & p("page").isNull()).otherwise(F.col("page").between(p("page"), p("page") + 1))
    together = (p("type") != "table") & (F.col("type") != "table") & p("source_name").eqNullSafe(F.col("source_name")) & p("source_url").eqNullSafe(F.col("source_url")) & joins & pages
    together = F.coalesce(together, F.lit(False))
    return (
        rows.withColumn("island", F.sum(F.when(together, 0).otherwise(1)).over(order)).withColumn("_crosses", ~p("page").eqNullSafe(F.col("page")))
        .drop("_before")
    )


def text_groups(blocks: DataFrame, size: int = SIZE, least: int = LEAST, span: int = SPAN) -> DataFrame:
    """One row per group of text blocks that are chunked together: corpus_id,
    island, group, and ``members`` in order.

    Within an island a fold decides: a group ends where its pages would exceed
    ``span``, and at a new page once it has ``least`` words.  Blocks right
    before a table that holds their text already leave their group.
    """
    least = min(size, least)
    order = Window.partitionBy("corpus_id").orderBy("block_pos")
    rows = text_islands(blocks)
    rows = rows.withColumns({"_first": t.word_count(b.rendered()), "_next": t.word_count(F.col("_clean"))})
    table = F.when((F.col("type") == "table") & (F.size("rows") > 0), F.struct("island", "source_name", "source_url", "page", t.clean(F.col("caption")).alias("caption"), "_path"))
    any_table = F.when(F.col("type") == "table", F.col("island"))
    ahead = order.rowsBetween(1, Window.unboundedFollowing)
    rows = rows.withColumns({"_table": F.first(table, ignorenulls=True).over(ahead), "_table_at": F.first(any_table, ignorenulls=True).over(ahead)})
    n = lambda c: F.col(f"_table.{c}")
    same = n("source_name").eqNullSafe(F.col("source_name")) & n("source_url").eqNullSafe(F.col("source_url")) & n("page").eqNullSafe(F.col("page"))
    holds = (F.col("_clean") == n("caption")) | ((F.col("type") == "heading") & t.starts_with_path(n("_path"), F.array_append("_path", F.col("_clean"))))
    retained = (n("island") == F.col("island") + 1) & (F.col("_table_at") == n("island")) & same & (F.col("_clean") != "") & holds
    rows = rows.filter("type <> 'table'").withColumn("_retained", F.coalesce(retained, F.lit(False)))
    member = F.struct("block_pos", "type", "text", "source_name", "source_url", "page", "heading_path", "_clean", "_first", "_next", "_crosses", "_retained", b.rendered().alias("_render"))
    islands = rows.groupBy("corpus_id", "island").agg(F.array_sort(F.collect_list(member), lambda x, y: (x["block_pos"] - y["block_pos"]).cast("int")).alias("members"))

    start = F.struct(F.lit(-1).alias("g"), F.lit(0).cast("long").alias("words"), F.lit(None).cast("int").alias("lo"), F.lit(None).cast("int").alias("hi"), F.array().cast("array<int>").alias("out"))

    def step(acc, m):
        lo, hi = F.least(acc["lo"], m["page"]), F.greatest(acc["hi"], m["page"])
        reached = (acc["words"] >= least) if least else F.lit(True)
        fresh = (acc["g"] < 0) | F.coalesce(hi - lo + 1 > span, F.lit(False)) | (m["_crosses"] & reached)
        g = F.when(fresh, acc["g"] + 1).otherwise(acc["g"]).cast("int")
        words = F.when(fresh, m["_first"]).otherwise(acc["words"] + m["_next"]).cast("long")
        return F.struct(g.alias("g"), words.alias("words"), F.when(fresh, m["page"]).otherwise(lo).alias("lo"), F.when(fresh, m["page"]).otherwise(hi).alias("hi"), F.array_append(acc["out"], g).alias("out"))

    folded = islands.withColumn("_out", F.aggregate("members", start, step, lambda acc: acc["out"])).withColumn("_last", F.array_max("_out"))
    folded = folded.withColumn("group", F.explode(F.array_distinct("_out")))
    own = F.transform(F.filter(F.arrays_zip(F.col("members").alias("m"), F.col("_out").alias("g")), lambda x: x["g"] == F.col("group")), lambda x: x["m"])
    folded = folded.withColumn("members", own)
    # only the last group before a table is still open when the table comes
    kept_until = F.aggregate("members", F.struct(F.lit(0).alias("i"), F.lit(0).alias("keep")), lambda a, m: F.struct((a["i"] + 1).alias("i"), F.when(m["_retained"], a["keep"]).otherwise(a["i"] + 1).alias("keep")), lambda a: a["keep"])
    folded = folded.withColumn("members", F.when(F.col("group") == F.col("_last"), F.slice("members", F.lit(1), kept_until)).otherwise(F.col("members")))
    return folded.filter(F.size("members") > 0).select("corpus_id", "island", "group", "members")


def text_chunks(blocks: DataFrame, size: int = SIZE, overlap: int = OVERLAP, least: int = LEAST, span: int = SPAN) -> DataFrame:
    """Windows of words over the groups of text blocks, with the metadata of the blocks that each window touches."""
    groups = text_groups(blocks, size, least, span)
    parts = F.transform("members", lambda m, i: F.when(i == 0, m["_render"]).otherwise(m["_clean"]))
    groups = groups.withColumn("_parts", parts).withColumn("_counts", F.transform("_parts", t.word_count))
    groups = groups.withColumn("_ends", F.aggregate("_counts", F.array().cast("array<int>"), lambda a, n: F.array_append(a, F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0)) + n)))
    groups = groups.withColumn("_source", F.array_join(F.filter("_parts", lambda p: p != ""), "\n\n"))
    # a window takes of its blocks what it tells of them, not their texts
    told = F.transform("members", lambda m: F.struct(m["source_name"].alias("source_name"), m["source_url"].alias("source_url"), m["page"].alias("page"), m["heading_path"].alias("heading_path")))
    groups = groups.select("corpus_id", F.col("members")[0]["block_pos"].alias("_pos"), "_source", F.arrays_zip(told.alias("m"), F.col("_counts").alias("n"), F.col("_ends").alias("e")).alias("_spans"))

    def touched(lo, hi):
        found = F.transform(F.filter("_spans", lambda x: (x["e"] > lo) & (x["e"] - x["n"] < hi) & (x["n"] > 0)), lambda x: x["m"])
        pages = lambda x: F.array_sort(F.array_distinct(F.filter(F.transform(x, lambda m: m["page"]), lambda p: p.isNotNull())))
        some = t.let(found, lambda x: F.when(F.size(x) > 0, x).otherwise(F.array(F.col("_spans")[0]["m"])))
        return {"_at": t.let(some, lambda x: F.struct(F.get(x, F.lit(0)).alias("head"), pages(x).alias("pages")))}

    each = groups.select("corpus_id", "_pos", F.inline(windows(F.col("_source"), size, overlap, touched)))
    each = each.select("*", F.col("_at.head").alias("_head"), F.col("_at.pages").alias("_pages"))
    several = F.size("_pages") > 1
    null = lambda kind: F.lit(None).cast(kind)
    return each.select(
        "corpus_id", "_pos", F.lit(0).alias("_g"), F.col("id").alias("_local"), "text", "source_text", F.lit("text").alias("block_type"),
        F.nullif(F.col("_head.source_name"), F.lit("")).alias("source_name"), F.nullif(F.col("_head.source_url"), F.lit("")).alias("source_url"), F.array_min("_pages").alias("page"),
        F.when(F.size("_head.heading_path") > 0, F.col("_head.heading_path")).alias("heading_path"),
        F.when(several, F.array_min("_pages")).alias("page_start"), F.when(several, F.array_max("_pages")).alias("page_end"), F.when(several, F.col("_pages")).alias("pages"),
        null("string").alias("table_id"), null("int").alias("row_start"), null("int").alias("row_end"), null("array<string>").alias("column_group"), null("string").alias("table_prefix"), null("array<string>").alias("table_row_texts"),
    )


def chunk_blocks(blocks: DataFrame, size: int = SIZE, overlap: int = OVERLAP, least: int = LEAST, span: int = SPAN) -> DataFrame:
    """Chunks of every corpus, numbered from 0 within it (``schemas.CHUNK``)."""
    check(size, overlap, least, span)
    rows = b.associate_headings(blocks)
    texts = text_chunks(rows, size, overlap, least, span)
    tables = table_chunks(rows.filter("type = 'table' AND size(rows) > 0"), size)
    order = Window.partitionBy("corpus_id").orderBy("_pos", "_g", "_local")
    every = texts.unionByName(tables).withColumn("id", (F.row_number().over(order) - 1).cast("long"))
    return every.select("corpus_id", "id", *[c for c in texts.columns if c not in ("corpus_id", "_pos", "_g", "_local")])


#: Ways to chunk, by name.
STRATEGIES = {"words": chunk_blocks}


def build_chunks(blocks: DataFrame, strategy: str = "words", size: int = SIZE, overlap: int = OVERLAP, least: int = LEAST, span: int = SPAN) -> DataFrame:
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown chunking strategy {strategy!r}; there are {', '.join(STRATEGIES)}")
    return STRATEGIES[strategy](b.validated(blocks), size, overlap, least, span)
