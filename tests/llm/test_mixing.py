import math

import pytest

from gridloom.llm import mixing

DOCS = "doc_id long, text string, source string, copies int, _size long"


def filled(sizes, most=3):
    """Targets by brute force: cap, reshare, repeat."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), {}
    while True:
        rest = [s for s in order if s not in capped]
        if not rest:
            return {s: float(most * sizes[s]) for s in order}
        left = total - sum(capped.values())
        shares = {s: left * weight[s] / sum(weight[r] for r in rest) for s in rest}
        above = [s for s in rest if shares[s] > most * sizes[s]]
        if not above:
            return capped | shares
        capped |= {s: float(most * sizes[s]) for s in above}


@pytest.mark.parametrize(
    "sizes",
    [{"a": 100, "b": 10, "c": 1}, {"a": 5}, {"b": 1000, "a": 3, "é": 7, None: 9, "z": 0}, {f"s{i}": (i * i * 37) % 501 for i in range(30)}],
)
def test_targets_fill_like_water(spark, sizes):
    rows = mixing.targets(spark.createDataFrame([*sizes.items()], "source string, source_size long")).collect()
    got = {r.source: r.target for r in rows}
    want = filled(sizes)
    assert got.keys() == want.keys()
    assert all(math.isclose(got[s], want[s], rel_tol=1e-9, abs_tol=1e-9) for s in want)
    assert math.isclose(sum(got.values()), sum(sizes.values()), rel_tol=1e-9)


def test_taken_comes_near_the_target_and_reruns_agree(spark):
    rows = [(i, "w " * (i % 97 + 1), ["a", "b", "b", "b", None][i % 5], 0, 0) for i in range(1500)]
    docs = spark.createDataFrame(rows, DOCS)
    first, again = (sorted(map(tuple, mixing.mixed(d).collect())) if False else mixing.mixed(d).collect() for d in (docs, docs.repartition(7)))
    key = lambda r: (r.doc_id, r.source or "")
    assert sorted(map(tuple, first), key=str) == sorted(map(tuple, again), key=str)
    for s in {r.source for r in first}:
        own = [r for r in first if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 97
        assert all(0 <= r.taken <= 3 * r.size for r in own)
    assert len({key(r) for r in first}) == 1500


def test_runs_give_the_same_amounts(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "w " * (i % 50 + 1), "a" if i % 3 else "b", 0, 0) for i in range(900)], DOCS)
    monkeypatch.setattr(mixing, "RUN_ROWS", 100)
    rows = mixing.mixed(docs).collect()
    for s in "ab":
        own = [r for r in rows if r.source == s]
        expected = own[0].target / own[0].source_size * len(own)
        assert abs(sum(r.copies for r in own) - expected) <= 1


def test_nulls_empty_texts_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, None, None, 7, 8), (None, "", "a", 7, 8), (3, " \t\n", "a", 7, 8), (4, "one two", None, 7, 8), (4, "one two", None, 7, 8)], DOCS)
    rows = mixing.mixed(docs).collect()
    assert sorted((r.size, r.taken) for r in rows)[:3] == [(0, 0)] * 3
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert sum(r.taken for r in rows) == 2 * mixed.filter("text = 'one two'").count()
    assert mixing.mixed(docs.limit(0)).count() == 0 and mixing.mix(docs.limit(0)).count() == 0


def test_runs_change_nothing(spark, monkeypatch):
    """A size that holds most rows is ordered in runs between its ids; null ids and repeated rows among them."""
    rows = [(i * 7919 % 1000 if i % 20 else None, "w " * (5 if i % 4 else i % 30), "ab"[i % 7 == 0], 0, 0) for i in range(1200)]
    docs = spark.createDataFrame(rows, DOCS)
    whole = sorted(map(tuple, mixing.mixed(docs).collect()), key=str)
    monkeypatch.setattr(mixing, "RUN_ROWS", 50)
    assert sorted(map(tuple, mixing.mixed(docs).collect()), key=str) == whole
