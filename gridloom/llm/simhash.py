"""SimHash near-dedup with pigeonring filtering.

Two fingerprints of 64 bits that differ in at most d of them, cut into m
segments on a ring, have a segment from which every run of l consecutive
segments differs in at most l * d / m bits.  With d = 2 and m = 8 the first
three segments of that chain are equal, which gives the index key (24 bits at
8 places of the ring); the longer runs prune the pairs that share a key before
the whole Hamming distance is looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import boxed, bytes_of, cut, hot_join

SHINGLE_WORDS = 3
MOST_BITS = 2
SEGMENTS = 8
#: Members of an index bucket up to which its pairs are looked at directly.
BUCKET = 128
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_PIECE = 1 << 20
_SPACE = b" \t\n\x0b\x0c\r"


def _words(text: bytes) -> Iterator[list[bytes]]:
    """The words, in lists of about _PIECE bytes, so that a very long text is never split at once."""
    at = 0
    while at < len(text):
        end = min(len(text), at + _PIECE)
        while end < len(text) and text[end] not in _SPACE:
            end += 1
        yield text[at:end].lower().split()
        at = end


def _hashes(text: bytes, k: int) -> Iterator[np.ndarray]:
    """XXH64 (seed 42) of the k-word shingles; of all words, if they are fewer."""
    from xxhash import xxh64_intdigest as h

    last: list[bytes] = []
    several = False
    for part in _words(text):
        words = last + part
        if len(words) < k:
            last = words
            continue
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        n = len(words) - k + 1
        yield np.fromiter((h(joined[a:b], 42) for a, b in zip(starts[:n].tolist(), ends[k - 1 :].tolist(), strict=True)), np.uint64, n)
        several = True
        last = words[n:]
    if not several and last:
        yield np.array([h(b" ".join(last), 42)], np.uint64)


def _vote(hashes: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Set bits by owner and place, least significant first."""
    parts = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    base = owner * 256
    return np.concatenate([np.bincount(base + parts[:, p], minlength=n * 256).reshape(n, 256) @ _BITS for p in range(8)], axis=1)


def fingerprints_of(texts: list[bytes], k: int = SHINGLE_WORDS) -> np.ndarray:
    """Signed 64-bit SimHash of each UTF-8 text; zero without words."""
    out = np.zeros(len(texts), np.int64)
    weights = np.uint64(1) << np.arange(64, dtype=np.uint64)
    step = 256
    for lo in range(0, len(texts), step):
        some = texts[lo : lo + step]
        votes, totals = np.zeros((len(some), 64), np.int64), np.zeros(len(some), np.int64)
        held: list[np.ndarray] = []
        owners: list[np.ndarray] = []
        size = 0

        def settle() -> None:
            nonlocal size, votes, totals
            if held:
                every, owner = np.concatenate(held), np.concatenate(owners)
                votes += _vote(every, owner, len(some))
                totals += np.bincount(owner, minlength=len(some))
            held.clear()
            owners.clear()
            size = 0

        for i, text in enumerate(some):
            for part in _hashes(text, k):
                held.append(part)
                owners.append(np.full(len(part), i, np.int64))
                size += len(part)
                if size > 1_000_000:
                    settle()
        settle()
        out[lo : lo + step] = ((votes * 2 > totals[:, None]).astype(np.uint64) * weights).sum(axis=1, dtype=np.uint64).view(np.int64)
    return out


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = SHINGLE_WORDS) -> DataFrame:
    """One row per row of ``docs``: doc_id, fp (the fingerprint as a signed long)."""

    def run(batches):
        for b in batches:
            texts = [x or b"" for x in b.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fingerprints_of(texts, k))], names=["doc_id", "fp"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, fp long")


def links(fps: DataFrame, most: int = MOST_BITS, segments: int = SEGMENTS, bucket: int = BUCKET) -> DataFrame:
    """Pairs (u, v), u < v, of the distinct ``fp`` values that differ in at most ``most`` bits.

    A bucket of more than ``bucket`` fingerprints isn't paired directly: what
    is left of the ring can differ in ``most`` bits only, so one of most + 1
    parts of it is equal too, and the bucket is split by those parts (twice,
    if need be).  No pair is lost.
    """
    width = 64 // segments
    fixed = next(n for n in range(segments, 0, -1) if (n * most) // segments == 0)
    rows = fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(segments - 1))).alias("at")).withColumn(
        "rot", F.expr(f"shiftleft(fp, at * {width}) | CASE WHEN at = 0 THEN 0L ELSE shiftrightunsigned(fp, 64 - at * {width}) END")
    )
    left = 64 - fixed * width
    rows = rows.withColumn("key", F.array(F.col("at").cast("long"), F.shiftrightunsigned("rot", left)))
    found = []
    ranges = [(left, 0)]  # bits not yet in the key: (count, lowest place)
    rows = rows.withColumn("lo", F.lit(0)).withColumn("hi", F.lit(left))
    for depth in range(3):
        sizes = rows.groupBy("key").agg(F.count("*").alias("members"))
        rows = rows.join(sizes.filter("members > 1"), "key")
        if depth < 2:
            rows = cut(rows)
        light = rows.filter(F.col("members") <= bucket) if depth < 2 else rows
        a, b = light.select("key", F.col("rot").alias("x"), F.col("fp").alias("u")), light.select("key", F.col("rot").alias("y"), F.col("fp").alias("v"))
        d = F.col("x").bitwiseXOR(F.col("y"))
        chain = F.lit(True)
        for run in range(fixed + 1, segments + 1):
            budget = run * most // segments
            if run == segments or budget < (run + 1) * most // segments:  # a shorter run of equal budget says less
                chain = chain & (F.bit_count(F.shiftrightunsigned(d, 64 - run * width) if run < segments else d) <= budget)
        found.append(a.join(b, "key").filter((F.col("u") < F.col("v")) & chain).select("u", "v"))
        if depth == 2:
            break
        heavy = rows.filter(F.col("members") > bucket).drop("members")
        if heavy.isEmpty():
            break
        parts = most + 1
        cutting = f"transform(sequence(0, {parts - 1}), j -> named_struct('lo', cast(lo + (hi - lo) * j div {parts} as int), 'hi', cast(lo + (hi - lo) * (j + 1) div {parts} as int)))"
        heavy = heavy.withColumn("part", F.explode(F.expr(cutting)))
        value = F.expr("shiftrightunsigned(rot, part.lo) & (shiftleft(1L, part.hi - part.lo) - 1)")
        rest = F.when(F.col("part.lo") == F.col("lo"), F.struct(F.col("part.hi").alias("lo"), F.col("hi").alias("hi"))).otherwise(F.struct(F.col("lo").alias("lo"), F.col("part.lo").alias("hi")))
        rows = heavy.select("fp", "at", "rot", F.concat("key", F.array(F.col("part.lo").cast("long"), value)).alias("key"), rest["lo"].alias("lo"), rest["hi"].alias("hi"))
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    return pairs.distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.hash("u", "v"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root): each node of ``edges`` (u, v) with the least node it reaches.

    Large-star and small-star steps take turns until nothing changes; a step
    keeps only each neighbourhood's least node, found by partial aggregation,
    and sends it to the neighbours by ``hot_join``: the root of a large
    component is a neighbour of all its nodes.
    """
    edges = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct())
    state = _state(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("u", "m"))
        large = cut(hot_join(both, least, ["u"], "n", 2 * state[0]).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = hot_join(large, least, ["u"], "n", state[0])
        small = small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = cut(small.filter("u <> v").distinct())
        now = _state(edges)
        if now == state:
            break
        state = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def simhash_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = SHINGLE_WORDS, most: int = MOST_BITS) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits) and
    component_id, the smallest doc_id reachable over links of at most ``most``
    differing bits.

    Copies share a fingerprint and are linked as one; texts without words
    (null, empty) have fingerprint zero.  Null ids are never smallest, unless
    a group has no other.
    """
    rows = cut(fingerprints(docs, doc_id, text, k))
    classes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("members")))
    pairs = links(classes.select("fp"), most)
    roots = components(pairs)
    labelled = cut(classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    ids = labelled.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("fps"))
    named = cut(hot_join(labelled, ids, ["root"], "fps", labelled.count()).select("fp", "members", "component_id"))
    return hot_join(rows, named, ["fp"], "members", rows.count()).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``docs`` as ``_row`` beside ``_text`` and ``_key``: the row's id (nulls
    last) and the SHA-256 of its text, which tell rows of one id apart."""
    key = F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("id"), F.unhex(F.sha2(bytes_of(text), 256)).alias("sha"))
    return boxed(docs, _key=key, _text=F.col(text).cast("string"))


def keep_rows(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of ``keyed`` whose key is in ``kept`` (_kept), one of each key."""
    same = (F.col("_key.sha") == F.col("_kept.sha")) & F.col("_key.id").eqNullSafe(F.col("_kept.id"))
    found = rows.drop("_text").join(kept, same, "left_semi")
    first = Window.partitionBy("_key").orderBy(F.lit(0))
    return found.withColumn("_nth", F.row_number().over(first)).filter("_nth = 1").select("_row.*")


def drop_near(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with one document of each group, that with the smallest id
    (and least SHA-256, if that repeats; without any id, of the least SHA-256);
    columns unchanged."""
    rows = keyed(docs, doc_id, text)
    kept = simhash_groups(rows, "_key", "_text", **options).filter(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("_kept")).distinct()
    return keep_rows(rows, kept)
