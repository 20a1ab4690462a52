import hashlib
import itertools
import random

import xxhash
from pyspark.sql import functions as F

from gridloom.llm import exact, simhash

DOCS = "doc_id long, text string, source string, _row int, kept boolean"


def documents(spark):
    long = "".join(random.Random(1).choices("abcd é\n", k=20_000))
    texts = ["a", "a", "", None, long, long, long[:-1] + "z", "z" + long[1:], long[:4096], long[:4096] + long[:4096], "A", "a ", "ab" * 3000, "ba" * 3000]
    rows = [(i, t, "s", 1, True) for i, t in enumerate(texts)] + [(5, long, "s", 1, True), (None, "a", "s", 1, True), (None, None, "s", 1, True)]
    return spark.createDataFrame(rows, DOCS), rows


def expected(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[1] or "", []).append(r[0])
    top = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    return sorted(((r[0], top[r[1] or ""], len(groups[r[1] or ""]), hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in rows), key=str)


def test_exact_dedup_equals_brute_force(spark):
    docs, rows = documents(spark)
    for options in ({}, {"block_bytes": 16}, {"key_bits": 14, "block_bytes": 512}):
        got = exact.exact_dedup(docs, **options).collect()
        assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == expected(rows)
        assert sum(r.kept for r in got) == len({r[1] or "" for r in rows})


def test_only_blocks_whose_key_comes_again_travel_whole(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"text {i % 90}", "s", 1, True) for i in range(100)], DOCS)
    keys = docs.select(F.expr(exact._key("cast(text AS binary)", 0, 64)).alias("_key")).groupBy("_key").agg(F.count("*").alias("_copies"))
    for most in (500_000, 0):
        monkeypatch.setattr(exact, "MOST_SENT", most)
        assert {bytes(r._block).decode() for r in exact.compared(docs, "text", keys, 0, 4096, 64).collect()} == {f"text {i}" for i in range(10)}
        few = keys.withColumn("_key", F.expr("_key & 7")).groupBy("_key").agg(F.sum("_copies").alias("_copies"))
        assert exact.shared_keys(docs, "text", few, 0, 4096, 3).count() == 8 and exact.shared_keys(docs, "text", keys, 0, 4096, 64).isEmpty()
        assert exact.exact_dedup(docs, key_bits=13).filter("kept").count() == 90


def test_hot_copies_are_joined_whole(spark):
    docs = spark.createDataFrame([(i, "same" if i % 3 else str(i), "s", 1, True) for i in range(30_000)], DOCS)
    got = exact.exact_dedup(docs)
    assert got.count() == 30_000
    assert got.filter("text_sha256 = sha2('same', 256) AND group_size = 20000 AND keep_id = 29999").count() == 20_000


def test_drop_copies_keeps_columns_and_one_of_each(spark):
    docs, rows = documents(spark)
    kept = exact.drop_copies(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len({r[1] or "" for r in rows})
    assert exact.exact_dedup(docs.limit(0)).count() == 0 and exact.drop_copies(docs.limit(0)).count() == 0


def fingerprint(text, k=3):
    words = (text or "").encode().lower().split()
    parts = [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] if len(words) >= k else [b" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_and_groups_equal_brute_force(spark):
    pick = random.Random(7)
    words = [f"w{i}" for i in range(300)]
    base = [pick.choices(words, k=400) for _ in range(12)]
    texts = [" ".join(b) for b in base] + ["", None, " \t", "One", "one", "one two", "a b c"]
    for b in base:
        for _ in range(4):
            c = list(b)
            c[pick.randrange(400)] = "changed"
            texts.append("\n".join(c))
    rows = [(i, t, "s", 1, True) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, DOCS)
    prints = {i: fingerprint(t) for i, t, *_ in rows}
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(prints, 2):
        if (prints[a] ^ prints[b]).bit_count() <= 2:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = simhash.simhash_groups(docs).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{prints[i]:016x}", find(i)) for i in prints}
    kept = simhash.drop_near(docs)
    assert kept.columns == docs.columns and kept.count() == len({find(i) for i in prints})


def test_a_piecewise_text_has_the_same_fingerprint(monkeypatch):
    text = " ".join(random.Random(3).choices(["ab", "cde", "É", "f"], k=5000)).encode()
    whole = simhash.fingerprints_of([text])[0]
    monkeypatch.setattr(simhash, "_PIECE", 100)
    assert simhash.fingerprints_of([text])[0] == whole == (lambda f: f - (1 << 64) if f >> 63 else f)(fingerprint(text.decode()))


def test_links_lose_no_pair_when_buckets_split(spark):
    pick = random.Random(5)
    values = {b ^ m for b in (pick.getrandbits(64) for _ in range(3)) for m in [0, *(1 << i | 1 << pick.randrange(64) for i in range(64))]}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 2}
    fps = spark.createDataFrame([(v,) for v in signed], "fp long")
    for bucket in (128, 3):
        assert {(r.u, r.v) for r in simhash.links(fps, bucket=bucket).collect()} == want


def test_a_long_path_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "u long, v long")
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
