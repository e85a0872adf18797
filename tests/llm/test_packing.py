import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skeinflow.llm import packing as P

CHUNKS = "id string, source_id string, content string, tokens int, budget int"
JOBS = "job_id int, source_id string, budget int"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 50), max_size=60), st.integers(50, 90))
def test_every_item_once_within_the_budget(sizes, budget):
    bins = P.evolve(sizes, budget, [], seed=3, offspring=6)
    assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in b) <= budget for b in bins)


def test_breeding_beats_or_equals_best_fit():
    rng = random.Random(5)
    for _ in range(5):
        sizes = [rng.randint(20, 60) for _ in range(120)]
        plain = P.best_fit(sorted(range(120), key=lambda i: -sizes[i]), sizes, 150, [])
        best = P.evolve(sizes, 150, [], seed=1, offspring=40)
        assert len(best) <= len(plain)


def triplets(n, seed):
    """3 n items that fill n bins of 1000 exactly, three each."""
    rng, out = random.Random(seed), []
    for _ in range(n):
        a = rng.randint(380, 490)
        b = rng.randint(250, (1000 - a) // 2)
        out += [a, b, 1000 - a - b]
    rng.shuffle(out)
    return out


def near_halves(n, seed):
    rng = random.Random(seed)
    return [rng.choice([rng.randint(330, 345), rng.randint(495, 520), rng.randint(150, 180)]) for _ in range(n)]


@pytest.mark.parametrize(("sizes", "optimum"), [(triplets(60, 60), 60), (triplets(120, 120), 120), (triplets(200, 3), 200)])
def test_breeding_comes_near_the_optimum_where_best_fit_does_not(sizes, optimum):
    plain = P.best_fit(sorted(range(len(sizes)), key=lambda i: -sizes[i]), sizes, 1000, [])
    best = P.evolve(sizes, 1000, [], seed=1)
    assert len(plain) > 1.1 * optimum and len(best) <= 1.03 * optimum and P.lower_bound(sizes, 1000) == optimum


def test_breeding_beats_best_fit_on_near_halves():
    sizes = near_halves(300, 5)
    plain = P.best_fit(sorted(range(len(sizes)), key=lambda i: -sizes[i]), sizes, 1000, [])
    assert len(P.evolve(sizes, 1000, [], seed=1)) < len(plain)


def test_islands_beat_best_fit(spark):
    """The whole operator on a hard source: fewer selections than best fit makes."""
    sizes = triplets(100, 9)
    chunks = spark.createDataFrame([(f"c{i}", "s", "", x, 0) for i, x in enumerate(sizes)], CHUNKS)
    packed = P.pack(chunks, spark.createDataFrame([(1, "s", 1000)], JOBS))
    made = P.selections(packed).collect()
    plain = P.best_fit(sorted(range(len(sizes)), key=lambda i: -sizes[i]), sizes, 1000, [])
    assert len(made) <= 103 < len(plain) and all(r.total_tokens <= 1000 for r in made) and sum(r.chunks for r in made) == 300


def least_bins(sizes, budget):
    best = len(sizes)

    def put(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(sizes):
            best = len(rooms)
            return
        for i, r in enumerate(rooms):
            if r >= sizes[k]:
                put(k + 1, [*rooms[:i], r - sizes[k], *rooms[i + 1 :]])
        put(k + 1, [*rooms, budget - sizes[k]])

    put(0, [])
    return best


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=7), st.integers(20, 30))
def test_lower_bound(sizes, budget):
    assert P.lower_bound(sizes, budget) <= least_bins(sizes, budget)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=2, max_size=40), st.integers(30, 60), st.integers(0, 40))
def test_exchange_keeps_all_items_and_budgets(sizes, budget, loose):
    order = list(range(len(sizes)))
    bins = P.best_fit(order[loose:], sizes, budget, [])
    filled = sum(sizes[i] for b in bins for i in b)
    left = P.exchange(bins, order[:loose], sizes, budget)
    assert sorted([*left, *(i for b in bins for i in b)]) == order and all(sum(sizes[i] for i in b) <= budget for b in bins)
    assert sum(sizes[i] for b in bins for i in b) >= filled


def test_crossover_keeps_injected_bins_whole():
    sizes, rng = [5] * 12, random.Random(2)
    a = [[0, 1], [2, 3], [4, 5], [6, 7], [8, 9], [10, 11]]
    b = [[0, 2], [1, 3], [4, 6], [5, 7], [8, 10], [9, 11]]
    child = P.crossover(a, b, sizes, 10, rng)
    assert sorted(i for x in child for i in x) == list(range(12)) and any(sorted(x) in a for x in child)


def test_jobs(spark):
    rng = random.Random(1)
    rows = [(f"c{i}", "s", "x" * 40, rng.randint(1, 300), 0) for i in range(400)]
    rows += rows[:20] + [("null", "s", "y" * 41, None, 0), ("neg", "s", "y" * 8, -5, 0), ("empty", "s", "", 0, 0), ("void", "s", None, None, 0), ("big", "s", "", 2500, 0), ("even", "s", "", 2000, 0), ("fits", "s", "", 1000, 0), ("other", "t", "", 5, 0), ("none", None, "", 5, 0), (None, "s", "", 5, 0)]
    jobs = spark.createDataFrame([(1, "s", 1000), (2, "t", 3), (3, "nowhere", 10), (4, "s", None), (5, None, 10), (6, "s", 0)], JOBS)
    packed = P.pack(spark.createDataFrame(rows, CHUNKS), jobs, shard_rows=90).collect()
    ids = {r.chunk_id for r in packed if r.job_id == 1}
    assert ids == {r[0] for r in rows if r[1] == "s" and r[0]}
    assert {r.job_id for r in packed} == {1, 2}
    tokens = {}
    for r in packed:
        tokens[r.job_id, r.chunk_id] = tokens.get((r.job_id, r.chunk_id), 0) + r.tokens
    assert tokens[1, "null"] == 11 and tokens[1, "neg"] == 2 and tokens[1, "empty"] == 0 and tokens[1, "void"] == 0 and tokens[1, "big"] == 2500 and tokens[2, "other"] == 5
    used = {}
    for r in packed:
        used[r.job_id, r.selection] = used.get((r.job_id, r.selection), 0) + r.tokens
    assert all(v <= (1000 if j == 1 else 3) for (j, _), v in used.items())
    assert len([1 for j, _ in used if j == 1]) <= -(-sum(v for (j, _), v in used.items() if j == 1) // 1000) + 2
    df = spark.createDataFrame(packed)
    assert {(r.job_id, r.chunk_id) for r in P.divided(df).collect()} == {(1, "big"), (1, "even"), (2, "other")}


def test_empty(spark):
    jobs = spark.createDataFrame([(1, "s", 1000)], JOBS)
    assert P.pack(spark.createDataFrame([], CHUNKS), jobs).collect() == []
