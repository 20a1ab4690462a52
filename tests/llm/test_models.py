import random

import numpy as np
import pytest

from gridloom.llm import ann, quality, toxicity

DOCS = "doc_id long, text string, score double, _id long"


def corpus(spark, n=400):
    pick = random.Random(2)
    rows, labels = [], []
    for i in range(n):
        words = ["".join(pick.choices("abcdefgh", k=pick.randint(2, 8))) for _ in range(pick.randint(20, 60))]
        bad, toxic = i % 5 == 0, i % 4 == 0
        if toxic:
            for _ in range(3):
                words.insert(pick.randrange(len(words)), "grobian")
        text = " ".join(words) + "." if not bad else " ".join(w.upper() + "!!" for w in words)
        rows.append((i, text, 0.5, 9))
        labels.append((i, int(not bad), int(toxic)))
    rows += [(n, None, 0.5, 9), (n + 1, "", 0.5, 9), (None, "no id", 0.5, 9), (0, rows[0][1], 0.5, 9), (n + 2, "long words " * 200_000, 0.5, 9)]
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_and_toxicity_hold_out(spark):
    docs, labels = corpus(spark)
    truth = {r.doc_id: r for r in labels.collect()}
    for got, label in ((quality.classify(docs, labels).collect(), "quality"), (toxicity.score(docs, labels).collect(), "toxic")):
        assert len(got) == docs.count()
        assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
        held = [r for r in got if r.held_out and r.doc_id in truth]
        assert len(held) > 40
        assert np.mean([r.predicted == truth[r.doc_id][label] for r in held]) > 0.95
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and 250 < kept.count() < 340


def test_models_without_labels_or_rows(spark):
    docs, labels = corpus(spark, 20)
    none = labels.limit(0)
    assert {r.score for r in quality.classify(docs, none).collect()} == {0.5}
    assert {r.score for r in toxicity.score(docs, none).collect()} == {0.5}
    assert quality.classify(docs.limit(0), labels).count() == 0 and toxicity.score(docs.limit(0), labels).count() == 0


def test_trees_walk_as_they_were_grown():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(800, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    forest = quality.fit(x, y)
    assert ((forest.score(x) > 0.5) == y).mean() > 0.97

    def walk(row):
        total = forest.base
        for i in forest.roots:
            while forest.left[i] != i:
                i = forest.left[i] if row[forest.feature[i]] <= forest.limit[i] else forest.right[i]
            total += forest.value[i]
        return total

    assert np.allclose(forest.raw(x[:50]), [walk(r) for r in x[:50]])


def test_the_grammar_reads_clauses():
    lexicon = toxicity.Lexicon({"grob$": 3.0})
    events = lambda text: dict(zip(toxicity.EVENTS, toxicity.clause_features(text, lexicon)[:6], strict=True))
    assert events("ein grob wort")["insult"] == 1
    assert events("you are a grob")["aimed"] == 1
    assert events("you are not grob")["negated"] == 1
    assert events('she said you grob')["reported"] == 1
    assert events("i will kill you")["threat"] == 1 and events("i will not kill you")["idle_threat"] == 1
    assert events("you. grob")["insult"] == 1  # a clause ends the target
    assert not any(events("").values())


def test_search_finds_nearly_all_and_breaks_ties_by_id(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(1500, 16))
    v[700:760] = v[0]
    bad = [(5000, None), (5020, [0.0] * 16), (5040, [float("nan")] * 16), (5060, [1.0, None] * 8), (5080, [1.0] * 3), (5100, [float("inf")] * 16)]
    table = spark.createDataFrame([*((i, x.tolist()) for i, x in enumerate(v)), *bad], "vec_id long, embedding array<double>")
    got = ann.search(table, block=400).collect()
    found = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        found.setdefault(r.query_id, []).append(r)
    assert set(found) == {*range(0, 1500, 20)}
    hits = 0
    for q, rows in found.items():
        s = v @ v[q]
        s[q] = -np.inf
        best = np.lexsort((np.arange(1500), -s))[:20]
        hits += len({r.vec_id for r in rows} & set(best.tolist()))
        assert [r.rank for r in rows] == list(range(1, 21))
        assert np.allclose([r.score for r in rows], v[[r.vec_id for r in rows]] @ v[q], rtol=1e-12)
        assert [(-r.score, r.vec_id) for r in rows] == sorted((-r.score, r.vec_id) for r in rows)
    assert hits >= 0.95 * 20 * len(found)
    assert [r.vec_id for r in found[0]] == list(range(700, 720))
    assert ann.search(table.limit(0)).count() == 0
    few = spark.createDataFrame([(0, [1.0, 2.0]), (20, [2.0, 1.0]), (3, [0.5, 0.5])], "vec_id long, embedding array<double>")
    assert sorted((r.query_id, r.rank, r.vec_id) for r in ann.search(few).collect()) == [(0, 1, 20), (0, 2, 3), (20, 1, 0), (20, 2, 3)]


def test_codes_find_the_nearest_among_blocks_far_larger_than_what_is_reranked(spark):
    rng = np.random.default_rng(8)
    v = rng.normal(size=(6000, 32))
    table = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.search(table, every=60, rerank=100, block=3000, most_fitted=4000).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q, ids in got.items():
        s = v @ v[q]
        s[q] = -np.inf
        hits += len(ids & set(np.argsort(-s)[:20].tolist()))
    assert len(got) == 100 and hits >= 0.9 * 2000
    # the codes alone rank far better than chance
    books = ann.fit(v / np.linalg.norm(v, axis=1, keepdims=True))
    near = ann.decode(ann.encode(v[:200] / np.linalg.norm(v[:200], axis=1, keepdims=True), books), books)
    assert (near * v[:200]).sum(axis=1).mean() > 0.8 * np.linalg.norm(v[:200], axis=1).mean()


def test_rows_of_one_id_and_of_other_lengths(spark):
    rows = [(20, [1.0, 0.0]), (20, [0.0, 1.0]), (1, [2.0, 1.0]), (2, [1.0, 3.0]), (40, [1.0, 1.0, 1.0]), (3, [1.0, 0.0, 0.0]), (60, [5.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in ann.search(table).collect())
    want = [(20, 1, 1, 2.0), (20, 2, 2, 1.0), (20, 3, 20, 0.0), (20, 1, 2, 3.0), (20, 2, 1, 1.0), (20, 3, 20, 0.0), (40, 1, 3, 1.0)]
    assert got == sorted(want)


def test_long_texts_score_alike_whatever_the_pieces(monkeypatch):
    pick = random.Random(9)
    words = ["".join(pick.choices("abcdé", k=pick.randint(1, 6))) for _ in range(300)] + ["grob", "you", "not", "kill", "said"]
    for joint in (" ", "\n", " \n\n"):
        text = "".join(w + (joint if i % 9 == 0 else pick.choice([" ", ". ", "  "])) for i, w in enumerate(pick.choices(words, k=4000)))
        lexicon = toxicity.Lexicon({"grob$": 3.0})
        whole = quality.statistics(text.encode()), toxicity.clause_features(text, lexicon)
        monkeypatch.setattr(quality, "_PIECE", 300)
        monkeypatch.setattr(quality, "_HELD", 64)
        monkeypatch.setattr(toxicity, "_PIECE", 300)
        assert np.allclose(quality.statistics(text.encode()), whole[0], rtol=1e-12)
        assert np.allclose(toxicity.clause_features(text, lexicon), whole[1])
        monkeypatch.undo()


def test_labelled_rows_are_bounded(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(500)] + [(2, "same")] * 500 + [(3, None), (None, "x"), (0, "y")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (None, 1), (5, None), (1, 0)], "doc_id long, quality int")
    def some(most):
        return sorted((r._id, r.text, r.y) for r in quality.labelled(docs, labels, "quality", 1000, 999, most).collect())
    assert len(some(10)) == 10 and some(10) == some(10)
    assert len(some(1000)) == 502 and (2, "same", 0) in some(1000) and (3, "", 1) in some(1000)
    assert quality.train(docs, labels, parts=1000, held=999, most=20) is not None


def test_trees_split_as_brute_force_does():
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(300, 3)), 1)
    y = (x[:, 1] + 0.3 * rng.normal(size=300) > 0.2).astype(float)
    forest = quality.fit(x, y, trees=1, depth=1, rate=1.0, least=12, ridge=3.0)
    p = y.sum() + 0.5
    p = p / (len(y) + 1)
    g, h = p - y, np.full(len(y), p * (1 - p))
    best = None
    for j in range(3):
        for cut in np.unique(np.quantile(x[:, j], np.linspace(0, 1, 49)[1:-1])):
            left = x[:, j] <= cut
            if 12 <= left.sum() <= len(y) - 12:
                gain = sum(g[s].sum() ** 2 / (h[s].sum() + 3.0) for s in (left, ~left))
                best = max(best or (-1,), (gain, j, cut))
    root = forest.roots[0]
    left = x[:, forest.feature[root]] <= forest.limit[root]
    assert sum(g[s].sum() ** 2 / (h[s].sum() + 3.0) for s in (left, ~left)) == pytest.approx(best[0])
    for side, child in ((left, forest.left[root]), (~left, forest.right[root])):
        assert forest.value[child] == pytest.approx(-g[side].sum() / (h[side].sum() + 3.0))


def test_the_composed_grammar_is_the_cascade():
    pick = random.Random(3)
    sides, judge, turned = toxicity.grammar()
    for _ in range(200):
        state, one, two, three = 0, sides.start, judge.start, turned.start
        for x in pick.choices(toxicity.SYMBOLS, k=40):
            one, said, w = sides.step(one, x)
            two, judged, v = judge.step(two, said)
            three, event, u = turned.step(three, judged)
            assert (toxicity.EVENT[state][x], toxicity.WEIGHT[state][x]) == (event, w * v * u)
            state = toxicity.NEXT[state][x]


def test_inflections_apostrophes_and_order():
    lexicon = toxicity.Lexicon({})
    events = lambda text: {k: v for k, v in zip(toxicity.EVENTS, toxicity.clause_features(text, lexicon)[:6], strict=True) if v}
    assert events("I am going to be killing you") == {"threat": 1} == events("he killed them") == events("ich werde dich töten") == events("te voy a matar")
    assert events("don’t be an idiot") == {"negated": 1}
    assert events("idiot, that is what you are") == {"aimed": 1} == events("you idiot") and events("an idiot. you are") == {"insult": 1}
    assert events("they killed time") == {} and events("he said i will kill you") == {"idle_threat": 1}


def test_triggers_miss_no_event(monkeypatch):
    """With and without the automaton texts have the same features."""
    pick = random.Random(12)
    lexicon = toxicity.Lexicon({"grob$": 3.0, "schla": 2.0, "x²y": 4.0})
    marks = ["", ".", "!", "'s", "’s", '"', "-", "(", "_", "9", "²"]
    known = ["grob", "Grobe", "schlamm", "KILLED", "you", "not", "x²yz", "idiot", "said", "töten", "dich", "abc", "grobschlacht"]
    for _ in range(300):
        text = " ".join(pick.choice(marks) + pick.choice(known if pick.random() < 0.2 else ["abc", "def"]) + pick.choice(marks) for _ in range(pick.randint(1, 12)))
        found = toxicity.clause_features(text, lexicon)
        monkeypatch.setattr(toxicity.Triggers, "within", lambda self, text: True)
        assert toxicity.clause_features(text, lexicon) == found
        monkeypatch.undo()
