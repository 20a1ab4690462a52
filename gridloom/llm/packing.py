"""Best-fit packing of documents into sequences of several permitted lengths.

A piece goes into the open bin that it fills best, whatever that bin's size;
if it fits in none, the size of least expected cost is opened; in the end each
bin shrinks to the least size that holds its contents.  How full a new bin is
expected to become decides between the sizes, so each shard is packed for
several expectations and the cheapest packing is kept.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, word_count

CAPACITIES = (512, 1024, 2048, 4096)
#: Pieces that one task packs, roughly.
SHARD_ROWS = 50_000
EXPECTED = (0.0, 0.5, 0.8, 0.95, 1.0)
#: A sequence of this length costs twice its tokens, as attention grows with the square.
DOUBLE = 16_384


def price(capacity: int) -> float:
    return capacity * (1 + capacity / DOUBLE)


def best_fit(sizes: list[int], capacities: tuple[int, ...], filled: float, cost: Callable[[int], float] = price) -> tuple[list[int], list[int], list[int]]:
    """Packs ``sizes`` in their order: the bin and the place in it of each, and the bins' contents.

    Bins are kept by room; a bit mask of the rooms in use gives the least room
    that suffices.  ``filled`` is the share of a new bin's rest that later
    pieces are expected to fill.
    """
    rooms: list[list[int]] = [[] for _ in range(max(capacities) + 1)]
    mask = 0
    bin_of, place, used, capacity = [], [], [], []
    opening: dict[int, int] = {}
    for n in sizes:
        fit = mask >> n
        if fit:
            room = n + (fit & -fit).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                mask &= ~(1 << room)
        else:
            if n not in opening:
                opening[n] = min((c for c in capacities if c >= n), key=lambda c: (cost(c) * (n + (1 - filled) * (c - n)) / c / n, c))
            b, room = len(used), opening[n]
            used.append(0)
            capacity.append(room)
        bin_of.append(b)
        place.append(used[b])
        used[b] += n
        room -= n
        if room:
            rooms[room].append(b)
            mask |= 1 << room
    return bin_of, place, used


def pack(sizes: list[int], capacities: tuple[int, ...] = CAPACITIES, cost: Callable[[int], float] = price) -> tuple[list[int], list[int], list[int]]:
    """The cheapest of the packings for several expectations: bin and place of
    each size, and the bins' capacities after downsizing."""
    best = None
    for filled in EXPECTED:
        bin_of, place, used = best_fit(sizes, capacities, filled, cost)
        down = [min(c for c in capacities if c >= u) for u in used]
        total = sum(map(cost, down))
        if best is None or total < best[0]:
            best = (total, bin_of, place, down)
    return best[1:]


def packed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: Column | None = None, capacities: tuple[int, ...] = CAPACITIES, marker: int = 1, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per piece: doc_id, piece (from 0), start and length (in words),
    bin_id, capacity, place (of the piece in its sequence) and copy (which of
    the rows of this id it comes from, by an arbitrary but fixed number).

    Each piece takes ``marker`` places besides its words.  A document longer
    than the largest capacity is cut into pieces that fill it, the last one
    excepted.  A document without words (null, empty) gives one piece of
    length 0 that is in no bin (bin_id null, capacity 0).  Pieces are dealt to
    shards by hash, so no document or source makes a shard large; the largest
    pieces of a shard are packed first.
    """
    top = max(capacities) - marker
    rows = cut(docs.select(F.col(doc_id).alias("doc_id"), F.monotonically_increasing_id().alias("copy"), (word_count(text) if length is None else length.cast("long")).alias("n")))
    pieces = rows.withColumn("piece", F.explode(F.expr(f"sequence(0L, greatest(0L, cast(ceil(n / {top}) as bigint) - 1))"))).select(
        "doc_id", "copy", "piece", (F.col("piece") * top).alias("start"), F.least(F.lit(top), F.col("n") - F.col("piece") * top).cast("long").alias("length")
    )
    many = rows.agg(F.sum(F.greatest(F.lit(1), F.ceil(F.col("n") / top)))).first()[0] or 0
    shards = max(1, -(-int(many) // shard_rows))
    sizes = tuple(sorted(capacities))

    def run(key, t):
        lengths, copies, nth = (np.array(t.column(c)) for c in ("length", "copy", "piece"))
        order = np.lexsort((nth, copies, -lengths))
        some = order[lengths[order] > 0]
        bin_of, place, capacity = pack((lengths[some] + marker).tolist(), sizes)
        shard = key[0].as_py()
        bins, caps, at = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
        bins[some] = (shard << 32) + np.array(bin_of, np.int64)
        caps[some] = np.array(capacity, np.int64)[np.array(bin_of, np.int64)] if bin_of else 0
        at[some] = place
        none = lengths <= 0
        out = t.drop_columns(["shard"])
        for name, v in (("bin_id", bins), ("capacity", caps), ("place", at)):
            out = out.append_column(name, pa.array(v, mask=none if name != "capacity" else None))
        return out

    kind = docs.schema[doc_id].dataType.simpleString()
    shard = F.pmod(F.xxhash64("copy", "piece"), F.lit(shards))
    return pieces.withColumn("shard", shard).groupBy("shard").applyInArrow(run, f"doc_id {kind}, copy long, piece long, start long, length long, bin_id long, capacity long, place long")
