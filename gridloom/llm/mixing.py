"""Mixing sources to target weights by systematic sampling, in DataFrame
operations only.

Each document of a source expects target / source size copies.  The copies
are summed along the source's documents, a random offset is added, and a
document is taken once for each whole number that the sum passes at it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import boxed, cut, hot_join, word_count

#: Rows of one size that one window task orders at most, roughly.
RUN_ROWS = 1_000_000
WEIGHTS = (1, 2, 3)
MOST_COPIES = 3


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST_COPIES) -> DataFrame:
    """Adds ``target`` to ``sizes`` (source, source_size; a row per source).

    Sources in code-point order, null last, weigh ``weights``, repeating, and
    share the sum of all sizes.  No target exceeds ``most`` times its source's
    size; the excess goes to the others by weight until none is above.  The
    capped sources are the first ones by cap / weight, so one ordered pass
    finds the level of the others.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    nth = F.row_number().over(order)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (nth - 1) % len(weights) + 1)
    by_ratio = Window.orderBy(F.col("_cap") / F.col("_weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    all_rows = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(all_rows) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_weight").over(rest)
    return (
        sizes.withColumn("_weight", weight)
        .withColumn("_cap", F.col("source_size") * float(most))
        .withColumn("_level", level)
        .withColumn("_level", F.max(F.when(F.col("_level") * F.col("_weight") <= F.col("_cap"), F.col("_level"))).over(all_rows))
        .withColumn("target", F.coalesce(F.least("_cap", F.col("_level") * F.col("_weight")), F.col("_cap")))
        .drop("_weight", "_cap", "_level")
    )


def offset(source: str, seed: int) -> Column:
    """A number in [0, 1) from the seed and the source."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("null"))).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / float(2**32)


def mixed(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", size: Column | None = None, weights: tuple[float, ...] = WEIGHTS, most: float = MOST_COPIES, seed: int = 7) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target,
    copies and taken (copies times size).

    Documents are summed in the order of size, then doc_id, so that a source's
    taken size misses its target by about one document at most.  A place in
    that order is the number of smaller documents, from counts by size, and
    the place among those of one size; a size of more than RUN_ROWS documents
    is ordered in runs between some of its ids, whose counts are summed first.
    Sources of size zero have target zero.  Null texts have size zero; reruns
    agree.
    """
    # a null source is a key of its own
    key = F.struct(F.col("source").isNull().alias("n"), F.coalesce("source", F.lit("")).alias("s"))
    rows = cut(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), (word_count(text) if size is None else size.cast("long")).alias("size")).withColumn("_src", key))
    total = rows.count()
    many = F.ceil(F.col("n") / RUN_ROWS)
    hot = cut(rows.groupBy("_src", "size").agg(F.count("*").alias("n")).filter(F.col("n") > RUN_ROWS))
    if hot.isEmpty():
        rows = rows.withColumn("_run", F.lit(0))
    else:
        dealt = rows.join(F.broadcast(hot), ["_src", "size"]).groupBy("_src", "size", F.pmod(F.xxhash64("doc_id"), many).alias("deal"))
        drawn = dealt.agg(F.min_by("doc_id", F.xxhash64("doc_id", F.lit(1))).alias("at")).groupBy("_src", "size").agg(F.collect_list("at").alias("ends"))
        rows = rows.join(F.broadcast(cut(drawn)), ["_src", "size"], "left").withColumn("_run", F.coalesce(F.size(F.filter("ends", lambda e: e < F.col("doc_id"))), F.lit(0))).drop("ends")
    counts = cut(rows.groupBy("_src", "source", "size", "_run").agg(F.count("*").alias("_rows")))
    sources = targets(counts.groupBy("source").agg(F.sum(F.col("_rows") * F.col("size")).alias("source_size"))).withColumn("_start", offset("source", seed))
    sources = sources.withColumn("_each", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
    earlier = Window.partitionBy("_src").orderBy("size", "_run").rowsBetween(Window.unboundedPreceding, -1)
    ahead = counts.withColumn("_ahead", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
    plan = cut(ahead.drop("source").join(sources.withColumn("_src", key).drop("source"), "_src"))
    within = Window.partitionBy("_src", "size", "_run").orderBy("doc_id")
    placed = cut(rows.withColumn("_nth", F.row_number().over(within)))
    joined = hot_join(placed, plan, ["_src", "size", "_run"], "_rows", total)
    place = F.col("_ahead") + F.col("_nth")
    copies = F.floor(F.col("_start") + F.col("_each") * place) - F.floor(F.col("_start") + F.col("_each") * (place - 1))
    copies = F.least(copies, F.ceil("_each"))  # against rounding of far places
    return joined.withColumn("copies", copies.cast("long")).select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", **options) -> DataFrame:
    """``docs`` with each row as often as ``mixed`` takes it, columns unchanged.

    Rows are found again by id, hash of the text, source and size; rows that
    share all of these stand for each other, by their place among them.
    """
    size = options.pop("size", None)
    boxes = boxed(docs, _id=F.struct(F.col(doc_id).alias("id"), F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("text")), _source=F.col(source), _size=word_count(text) if size is None else size.cast("long"))
    plan = mixed(boxes, "_id", "_source", size=F.col("_size"), **options).filter("copies > 0")
    same_rows = lambda *keys: Window.partitionBy(*keys)
    plan = plan.select(F.col("doc_id").alias("_kid"), F.col("source").alias("_ksource"), F.col("size").alias("_ksize"), "copies")
    plan = plan.withColumn("_knth", F.row_number().over(same_rows("_kid", "_ksource", "_ksize").orderBy(F.desc("copies"))))
    left = boxes.withColumn("_nth", F.row_number().over(same_rows("_id", "_source", "_size").orderBy(F.lit(0))))
    same = F.col("_id.id").eqNullSafe(F.col("_kid.id")) & (F.col("_id.text") == F.col("_kid.text")) & F.col("_source").eqNullSafe(F.col("_ksource")) & (F.col("_size") == F.col("_ksize")) & (F.col("_nth") == F.col("_knth"))
    return left.join(plan, same).select("_row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy")).select("_row.*")
