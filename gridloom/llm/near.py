"""SimHash near-dedup as a pipeline stage: groups of texts whose word shingles
are 0.8 alike.

SimHash with pigeonring filtering (``simhash.links``) proposes the pairs within
its few bits, without loss.  At a similarity of 0.8 about ten of 64 bits differ,
which no ring of segments can look up, so bands of least hashes of the same
shingles propose those pairs.  All proposals are compared by their exact
shingle sets, and connected documents are a group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, hot_join, release, salted_join
from .simhash import _BITS, MOST_BITS, _hashes, components, keep_rows, keyed, links

SHINGLE_WORDS = 5
LEAST_ALIKE = 0.8
#: At similarity 0.8 a pair shares some band with probability 0.9997.
BANDS, BAND_ROWS = 20, 5
#: Members of a band's bucket up to which all pairs are compared.
BUCKET = 16
#: In larger buckets each member is first compared with the member of most company
#: (which edited copies of one text share), the least one and some drawn ones.
DRAWN = 3
#: Members of a larger bucket that one task looks at at once.
CROWD = 1000
#: Bits of 64 in which the SimHash of texts that are 0.8 alike differs at most:
#: ten are expected, with a deviation of three.
FAR_BITS = 26
_PIECE = 4096
_draw = np.random.default_rng(11)
_FACTORS = _draw.integers(1, 1 << 63, BANDS * BAND_ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFT = np.uint64(32)


def shingles(text: bytes, k: int = SHINGLE_WORDS) -> np.ndarray:
    """Distinct hashes of the k-word shingles."""
    parts = [np.unique(x) for x in _hashes(text, k)]
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def bands_of(hashes: np.ndarray) -> np.ndarray:
    """A signed 64-bit key of each band; of a text without words, zeros."""
    if not len(hashes):
        return np.zeros(BANDS, np.int64)
    least = np.full(len(_FACTORS), np.iinfo(np.uint64).max)
    for lo in range(0, len(hashes), _PIECE):
        h = hashes[lo : lo + _PIECE, None] * _FACTORS
        h ^= h >> _SHIFT
        h *= np.uint64(0xD6E8FEB86659FD93)
        np.minimum(least, h.min(axis=0), out=least)
    keys = np.zeros(BANDS, np.uint64)
    for column in least.reshape(BANDS, BAND_ROWS).T:
        keys = (keys ^ column) * np.uint64(0xA0761D6478BD642F)
        keys ^= keys >> _SHIFT
    return keys.view(np.int64)


def alike(a: bytes, b: bytes, k: int = SHINGLE_WORDS) -> float:
    x, y = shingles(a, k), shingles(b, k)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both) if len(x) or len(y) else 1.0


def fingerprint(hashes: np.ndarray) -> int:
    """The signed 64-bit SimHash of distinct shingles; zero without any."""
    votes = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), 1 << 18):
        bits = hashes[lo : lo + (1 << 18)].astype("<u8").view(np.uint8).reshape(-1, 8)
        votes += np.concatenate([np.bincount(bits[:, p], minlength=256) @ _BITS for p in range(8)])
    return int(((votes * 2 > len(hashes)).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(dtype=np.uint64).view(np.int64))


def _node():
    return F.conv(F.substring(F.hex("_key.sha"), 1, 15), 16, 10).cast("long")


def signatures(texts: DataFrame, k: int) -> DataFrame:
    """node, fp (SimHash) and keys (a key for each band) of ``texts`` (node, text)."""

    def run(batches):
        for b in batches:
            sets = [shingles(x or b"", k) for x in b.column(1).cast(pa.binary()).to_pylist()]
            keys = np.concatenate([bands_of(s) for s in sets]) if sets else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BANDS), pa.array(keys))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fingerprint(s) for s in sets], pa.int64()), lists], names=["node", "fp", "keys"])

    return texts.mapInArrow(run, "node long, fp long, keys array<long>")


def banded(signed: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Pairs (u, v) of nodes that share a band's bucket, and the members (band,
    key, node, n) of large buckets, if there are some.

    Small buckets give all pairs, large ones those that most likely join their
    members; ``left_over`` has the others.  A bucket that holds more than a thousandth
    of the rows is never sorted in one task: its members meet the broadcast
    hub, and the drawn pairs come from crowds of bounded size.
    """
    places = signed.select("node", F.posexplode("keys").alias("band", "key"))
    total = signed.count()
    counts = cut(places.groupBy("band", "key").agg(F.count("*").alias("n")).filter(f"n > {max(10_000, total // 1000)}"))
    hot = places.join(F.broadcast(counts), ["band", "key"])
    cold = places.join(F.broadcast(counts.select("band", "key")), ["band", "key"], "left_anti")
    bucket = Window.partitionBy("band", "key")
    near = F.collect_list("node").over(bucket.orderBy("node").rowsBetween(-(BUCKET - 1), -1))
    placed = cut(cold.withColumn("n", F.count("*").over(bucket)).withColumn("near", F.when(F.col("n") <= BUCKET, near)).filter("n > 1"))
    pairs = placed.filter(f"n <= {BUCKET}").select(F.explode("near").alias("u"), F.col("node").alias("v"))
    large = cut(placed.filter(f"n > {BUCKET}").select("band", "key", "node", "n").unionByName(hot.select("band", "key", "node", "n")))
    if large.isEmpty():
        return pairs.distinct(), None
    company = large.groupBy("node").agg(F.sum("n").alias("company"))
    ranked = large.join(company, "node")
    hubs = ranked.groupBy("band", "key").agg(F.count("*").alias("size"), F.max_by("node", F.struct("company", -F.col("node"))).alias("hub"), F.min("node").alias("least"))
    to_hubs = hot_join(large, cut(hubs), ["band", "key"], "size", large.count()).select(F.explode(F.array("hub", "least")).alias("u"), F.col("node").alias("v"))
    crowd = F.pmod(F.xxhash64("node", F.lit(3)), F.ceil(F.col("n") / CROWD))
    draw = Window.partitionBy("band", "key", "crowd").orderBy(F.xxhash64("node", "band"), "node").rowsBetween(-DRAWN, -1)
    drawn = large.withColumn("crowd", crowd).withColumn("us", F.collect_list("node").over(draw)).select(F.explode("us").alias("u"), F.col("node").alias("v"))
    return pairs.unionByName(to_hubs).unionByName(drawn).filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), large


def left_over(large: DataFrame, roots: DataFrame, signed: DataFrame) -> DataFrame:
    """Pairs of members of large buckets that aren't in one group yet.

    All members outside of a bucket's commonest group meet all members of
    other groups, a crowd at a time; SimHash drops those whose bits say that
    they can't be alike.  Where a bucket is one group there are none.
    """
    named = large.join(signed.select("node", "fp"), "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = cut(named)
    sizes = named.groupBy("band", "key", "root").agg(F.count("*").alias("size"))
    main = sizes.groupBy("band", "key").agg(F.max_by("root", F.struct("size", "root")).alias("main"), F.count("*").alias("groups"), F.sum("size").alias("members")).filter("groups > 1")
    open_ = cut(hot_join(named, cut(main), ["band", "key"], "members", named.count()))
    crowds = F.ceil(F.col("members") / CROWD).cast("int")
    some = open_.filter("root <> main").select("band", "key", F.col("node").alias("u"), F.col("root").alias("ur"), F.col("fp").alias("uf"), F.explode(F.sequence(F.lit(0), crowds - 1)).alias("crowd"))
    every = open_.select("band", "key", F.col("node").alias("v"), F.col("root").alias("vr"), F.col("fp").alias("vf"), F.pmod(F.xxhash64("node"), crowds).cast("int").alias("crowd"))
    met = some.join(every, ["band", "key", "crowd"]).filter((F.col("ur") != F.col("vr")) & (F.bit_count(F.col("uf").bitwiseXOR(F.col("vf"))) <= FAR_BITS))
    return met.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def simhash_pairs(signed: DataFrame, most: int) -> DataFrame:
    """Pairs (u, v) of nodes: those of one fingerprint with their least, and the
    least of fingerprints that differ in at most ``most`` bits."""
    classes = cut(signed.groupBy("fp").agg(F.min("node").alias("first"), F.count("*").alias("n")))
    own = hot_join(signed.select("node", "fp"), classes.filter("n > 1"), ["fp"], "n", signed.count()).filter("node <> first").select(F.col("first").alias("u"), F.col("node").alias("v"))
    first = classes.select("fp", "first")
    found = links(classes.select("fp"), most).join(first.toDF("u", "a"), "u").join(first.toDF("v", "b"), "v")
    return own.unionByName(found.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")))


def drop_near(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = SHINGLE_WORDS, least: float = LEAST_ALIKE, most: int = MOST_BITS) -> DataFrame:
    """``docs`` with one document of each group of texts whose sets of k-word
    shingles are at least ``least`` alike (intersection over union), linked
    over others too: that with the smallest id (null ids last, then by
    SHA-256); columns unchanged.  Texts without words are alike."""
    rows = keyed(docs, doc_id, text).withColumn("_node", _node())
    own = rows.select(F.col("_node").alias("node"), F.col("_text").alias("text"))
    signed = cut(signatures(own, k).dropDuplicates(["node"]))
    found, large = banded(signed)
    pairs = cut(found.unionByName(simhash_pairs(signed, most)).distinct())

    def compare(batches):
        for b in batches:
            x, y = (b.column(i).cast(pa.binary()).to_pylist() for i in (2, 3))
            good = pa.array([alike(p or b"", q or b"", k) >= least for p, q in zip(x, y, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["u", "v"]).filter(good)

    def linked(pairs: DataFrame) -> DataFrame:
        # only texts of some pair travel further
        texts = cut(own.dropDuplicates(["node"]).join(pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct(), "node", "left_semi"))
        release(docs.sparkSession)
        sided = salted_join(pairs, texts.toDF("u", "x"), "u", F.col("v")).join(texts.toDF("v", "y"), "v")
        return cut(sided.select("u", "v", "x", "y").mapInArrow(compare, "u long, v long"))

    edges = linked(pairs)
    roots = components(edges)
    if large is not None:
        more = cut(left_over(large, roots, signed).join(pairs, ["u", "v"], "left_anti"))
        if not more.isEmpty():
            roots = components(edges.unionByName(linked(more)))
    release(docs.sparkSession)
    keys = rows.select("_node", "_key").join(roots.withColumnRenamed("node", "_node"), "_node", "left").withColumn("root", F.coalesce("root", "_node"))
    return keep_rows(rows.drop("_node"), keys.groupBy("root").agg(F.min("_key").alias("_kept")).select("_kept"))
