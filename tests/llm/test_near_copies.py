import random

from gridloom.llm import simhash

DOCS = "doc_id long, text string, _row int"


def text(pick, n=120):
    return " ".join("".join(pick.choices("abcdefghij", k=6)) for _ in range(n))


def test_every_group_keeps_one_document_whatever_the_ids(spark):
    pick = random.Random(2)
    x, y, *others = (text(pick) for _ in range(12))
    rows = [(None, t, 1) for t in others] + [(None, others[0].upper(), 1), (3, others[1], 1), (None, None, 1), (None, "", 1)]
    rows += [(5, x, 1), (5, y, 1), (2, y.upper(), 1), (5, x, 1)]
    docs = spark.createDataFrame(rows, DOCS)
    kept = simhash.drop_near(docs)
    assert kept.columns == docs.columns
    got = sorted(((r.text or "").lower(), r.doc_id) for r in kept.collect())
    want = {t.lower(): None for t in others} | {others[1]: 3, "": None, x: 5, y: 2}
    assert got == sorted(want.items())


def test_the_pipeline_drops_copies_of_0_8_and_keeps_the_rest(spark):
    import corpus_pipeline

    pick = random.Random(3)
    rows = []
    for i in range(100):
        words = text(pick, 300 if i % 2 else 100).split()
        rows.append((i, " ".join(words), 1))
        edits = (3, 6) if i % 2 else (1, 2)
        copy = list(words)
        for j in pick.sample(range(len(words) // 10), edits[i // 2 % 2]):
            copy[10 * j] = "changed"
        rows.append((1000 + i, "\n".join(copy), 1))
        far = [w if pick.random() > 0.1 else "other" for w in words]
        rows.append((2000 + i, " ".join(far), 1))
    rows += [(3000, "", 1), (3001, None, 1), (3002, "a b", 1), (3003, "A  B", 1)]
    docs = spark.createDataFrame(rows, DOCS)
    kept = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()}
    assert kept == {*range(100), *range(2000, 2100), 3000, 3002}


def test_large_groups_of_copies_are_one(spark):
    """Copies that are 0.8 like their model but not like each other; two such groups."""
    from gridloom.llm import near

    pick = random.Random(5)
    rows = []
    for g in range(2):
        words = text(pick, 250).split()
        rows.append((g, " ".join(words), 1))
        for i in range(400):
            copy = list(words)
            for j in pick.sample(range(25), 4):
                copy[10 * j] = f"changed{pick.random()}"
            rows.append((1000 * (g + 1) + i, " ".join(copy), 1))
    alike = [near.alike(rows[0][1].encode(), r[1].encode()) for r in rows[1:401]]
    assert min(alike) >= 0.8 and near.alike(rows[1][1].encode(), rows[2][1].encode()) < 0.8
    rows += [(9000 + i, text(pick), 1) for i in range(50)]
    docs = spark.createDataFrame(rows, DOCS)
    assert {r.doc_id for r in near.drop_near(docs).collect()} == {0, 1, *range(9000, 9050)}


def test_the_stages_as_a_chain(spark, monkeypatch):
    """Nulls, empty texts, repeated rows and ids, an empty table and clashing names through all five stages."""
    import corpus_pipeline
    from gridloom.llm import near

    pick = random.Random(6)
    words = text(pick, 200).split()
    close = " ".join([*words[:100], "other", *words[101:]])
    good = [(1, " ".join(words), "a"), (2, " ".join(words), "a"), (None, " ".join(words), "b"), (3, close, "a"), (3, text(pick), None), (3, text(pick), "b"), (None, text(pick), "b"), (None, text(pick), None), (4, "", "a"), (5, None, "a"), (6, "one", "a"), (6, "one", "a")]
    good += [(100 + i, text(pick, 30), "abc"[i % 3]) for i in range(40)]
    schema = "doc_id long, text string, source string, _row int, kept boolean, score double, copies int, shard int, _key string"
    docs = spark.createDataFrame([(*r, 1, True, 0.1, 2, 3, "k") for r in good], schema)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    monkeypatch.setattr(corpus_pipeline, "table", lambda spark, folder, name: labels)
    # without labels every score is one half
    everything = corpus_pipeline.quality.keep_good(docs, labels, threshold=0.5)
    assert everything.columns == docs.columns and sorted(map(str, everything.collect())) == sorted(map(str, docs.collect()))
    assert corpus_pipeline.keep_quality(spark, docs, "").count() == 0

    once = corpus_pipeline.drop_exact_copies(spark, everything, "")
    best = {}
    for i, t, *_ in good:
        best[t or ""] = max(best.get(t or "", -1), -1 if i is None else i)
    assert once.columns == docs.columns
    assert sorted((r.text or "", -1 if r.doc_id is None else r.doc_id) for r in once.collect()) == sorted(best.items())

    left = corpus_pipeline.drop_near_copies(spark, once, "")
    kept, rest = [], sorted(best.items(), key=lambda x: (x[1] < 0, x[1]))
    for t, i in rest:  # groups here are of two, so the first of each stays
        if not any(near.alike(t.encode(), u.encode()) >= 0.8 for u, _ in kept):
            kept.append((t, i))
    assert left.columns == docs.columns
    assert sorted((r.text or "", -1 if r.doc_id is None else r.doc_id) for r in left.collect()) == sorted(kept)

    mixed = corpus_pipeline.mix_sources(spark, left, "")
    assert mixed.columns == docs.columns
    have = {}
    for r in mixed.collect():
        have[r.text or ""] = have.get(r.text or "", 0) + 1
    assert set(have) <= {t for t, _ in kept} and max(have.values()) <= 3
    sizes, taken = {}, {}
    for r in left.collect():
        sizes[r.source] = sizes.get(r.source, 0) + len((r.text or "").split())
    for r in mixed.collect():
        taken[r.source] = taken.get(r.source, 0) + len((r.text or "").split())
    from gridloom.llm import mixing

    for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect():
        assert abs(taken.get(r.source, 0) - r.target) <= 200

    packed = corpus_pipeline.pack_sequences(spark, mixed, "")
    assert packed.agg({"length": "sum"}).first()[0] == sum(taken.values())
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), "").count() == 0


def test_groups_in_one_bucket_are_found_whole(spark, monkeypatch):
    """Buckets that hold chains and several groups, against all pairs."""
    from gridloom.llm import near

    monkeypatch.setattr(near, "BUCKET", 2)
    monkeypatch.setattr(near, "DRAWN", 1)
    monkeypatch.setattr(near, "CROWD", 7)
    pick = random.Random(8)
    rows = []
    for g in range(3):
        words = text(pick, 120).split()
        for i in range(40):
            rows.append((100 * g + i, " ".join(words), 1))
            words = list(words)
            words[pick.randrange(120)] = f"new{pick.random()}"
            if i % 13 == 12:
                for j in pick.sample(range(120), 9):
                    words[j] = f"far{pick.random()}"
    sets = [set(near.shingles(t.encode()).tolist()) for _, t, _ in rows]
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                group[max(root(i), root(j))] = min(root(i), root(j))
    want = {rows[i][0] for i in range(len(rows)) if root(i) == i}
    assert 3 < len(want) < 60
    assert {r.doc_id for r in near.drop_near(spark.createDataFrame(rows, DOCS)).collect()} == want
