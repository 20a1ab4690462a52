"""Exact dedup by deterministic block naming, in DataFrame operations only.

A text's UTF-8 bytes are cut into blocks of fixed size.  The distinct blocks
are sorted and their places are integer names; then adjacent pairs of names
are named in the same way, level by level, until each text has one name.  Two
texts share a level and a name if and only if they are equal.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import boxed, bytes_of, cut, hot_join

BLOCK_BYTES = 4096
#: Keys that are broadcast at most.
MOST_SENT = 500_000


def _block(i: str, size: int) -> str:
    return f"substring(_bin, {i} * {size} + 1, {size})"


def _key(block: str, salt: int, bits: int) -> str:
    return f"xxhash64({salt}, {block})" + (f" & {(1 << bits) - 1}L" if bits < 64 else "")


def _blocks(docs: DataFrame, text: str, size: int) -> DataFrame:
    return docs.withColumn("_bin", bytes_of(text)).withColumn("_n", F.expr(f"cast(greatest(1, ceil(octet_length(_bin) / {size})) as int)"))


def _named(distinct: DataFrame, by: list[str]) -> DataFrame:
    """Integer names in sorted order within each hash partition."""
    return distinct.sortWithinPartitions(*by).withColumn("_name", F.monotonically_increasing_id())


def compared(docs: DataFrame, text: str, names: DataFrame, salt: int, block_bytes: int, key_bits: int) -> DataFrame:
    """(_key, _block) of the blocks whose key comes again: only these travel whole."""
    again = names.filter("_copies > 1").select("_key")
    block = F.explode(F.expr(f"transform(sequence(0, _n - 1), i -> {_block('i', block_bytes)})")).alias("_block")
    blocks = _blocks(docs.select(F.col(text).alias("_text")), "_text", block_bytes).select(block).select(F.expr(_key("_block", salt, key_bits)).alias("_key"), "_block")
    return blocks.join(F.broadcast(again) if again.count() <= MOST_SENT else again, "_key", "left_semi")


def shared_keys(docs: DataFrame, text: str, names: DataFrame, salt: int, block_bytes: int, key_bits: int) -> DataFrame:
    """Keys that several distinct blocks have."""
    distinct = compared(docs, text, names, salt, block_bytes, key_bits).groupBy("_key", "_block").agg(F.count("*").alias("_copies"))
    return distinct.groupBy("_key").count().filter("count > 1")


def identities(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES, key_bits: int = 64) -> DataFrame:
    """One row per row of ``docs``: _rid (unique), doc_id, _sha (SHA-256 of the
    text), _level and _name, which are equal for equal texts only.

    Blocks have their names by a 64-bit key.  The distinct blocks of each key that
    comes again are compared whole (a key that comes once has one block), and if
    two of them share it, all is keyed anew with another salt: the names never
    rest on a hash being free of collisions.
    Empty and null texts are one empty block; an empty table gives no rows.
    """
    for salt in range(64):
        rows = cut(
            _blocks(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text")), "_text", block_bytes).select(
                F.monotonically_increasing_id().alias("_rid"), "doc_id", "_n", F.unhex(F.sha2("_bin", 256)).alias("_sha"),
                F.expr(f"transform(sequence(0, _n - 1), i -> {_key(_block('i', block_bytes), salt, key_bits)})").alias("_keys"),
            )
        )
        names = cut(_named(rows.select(F.explode("_keys").alias("_key")).groupBy("_key").agg(F.count("*").alias("_copies")), ["_key"]))
        if shared_keys(docs, text, names, salt, block_bytes, key_bits).isEmpty():
            break
    else:
        raise RuntimeError("no salt keeps the block keys apart")

    most, total = rows.agg(F.max("_n"), F.sum("_n")).first()
    here = hot_join(rows.select("_rid", "_n", F.posexplode("_keys").alias("_pos", "_key")), names, ["_key"], "_copies", total or 0).select("_rid", "_n", "_pos", "_name")
    done, level = [], 0
    while True:
        here = cut(here)
        done.append(here.filter(F.col("_n") <= 2**level).select("_rid", F.lit(level).alias("_level"), "_name"))
        if (most or 0) <= 2**level:
            break
        half = F.col("_pos") % 2
        pairs = cut(
            here.filter(F.col("_n") > 2**level)
            .groupBy("_rid", "_n", F.expr("_pos div 2").cast("int").alias("_pos"))
            .agg(F.max(F.when(half == 0, F.col("_name"))).alias("_a"), F.coalesce(F.max(F.when(half == 1, F.col("_name"))), F.lit(-1)).alias("_b"))
        )
        names = cut(_named(pairs.groupBy("_a", "_b").agg(F.count("*").alias("_copies")), ["_a", "_b"]))
        here = hot_join(pairs, names, ["_a", "_b"], "_copies", pairs.count()).select("_rid", "_n", "_pos", "_name")
        level += 1
    found = done[0]
    for part in done[1:]:
        found = found.unionByName(part)
    return rows.select("_rid", "doc_id", "_sha").join(found, "_rid")


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES, key_bits: int = 64) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest doc_id stays (null ids come below
    all; of repeated rows one stays).  Null texts equal empty ones.
    """
    ids = cut(identities(docs, doc_id, text, block_bytes, key_bits))
    groups = cut(ids.groupBy("_level", "_name").agg(F.max(F.struct("doc_id", "_rid")).alias("_best"), F.count("*").alias("group_size")))
    return hot_join(ids, groups, ["_level", "_name"], "group_size", ids.count()).select(
        "doc_id", F.col("_best.doc_id").alias("keep_id"), "group_size", (F.col("_best._rid") == F.col("_rid")).alias("kept"), F.lower(F.hex("_sha")).alias("text_sha256")
    )


def drop_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the rows that ``exact_dedup`` drops, columns unchanged.

    A row is found again by its id and text; of repeated rows one stays.
    """
    kept = exact_dedup(docs, doc_id, text).filter("kept").select(F.col("doc_id").alias("_kid"), F.col("text_sha256").alias("_ksha")).distinct()
    left = boxed(docs, _id=F.col(doc_id), _sha=F.sha2(bytes_of(text), 256))
    found = left.join(kept, F.col("_id").eqNullSafe(F.col("_kid")) & (F.col("_sha") == F.col("_ksha")), "left_semi")
    first = Window.partitionBy("_id", "_sha").orderBy(F.lit(0))
    return found.withColumn("_nth", F.row_number().over(first)).filter("_nth = 1").select("_row.*")
