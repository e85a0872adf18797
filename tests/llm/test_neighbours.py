import numpy as np
import pytest

from skeinflow.llm import neighbours as N

SCHEMA = "id string, embedding array<float>, key string, block int"


def made(n, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, 64))
    x[n // 2 :] = x[: n - n // 2] + 0.2 * x[n // 2 :]
    return (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)


@pytest.mark.parametrize("own", [True, False])
@pytest.mark.parametrize("least", [-2.0, 0.3, 0.9])
def test_tiles_give_the_k_best(own, least):
    a, b = made(2500), made(1300, 1)
    heaps = N.Heaps(len(a), 10, least)
    N.join_blocks(heaps, a, None if own else b, 10, 7)
    s = a.astype(float) @ (a if own else b).astype(float).T
    if own:
        np.fill_diagonal(s, -9)
    want, got = -np.sort(-s, axis=1)[:, :10], -np.sort(-heaps.value, axis=1)[:, :10]
    assert np.abs(np.where(want >= least, want, -9) - np.where(got >= least, got, -9)).max() < 1e-6
    best = heaps.other[np.arange(len(a)), heaps.value.argmax(axis=1)]
    assert (best[want[:, 0] > max(least, -1)] == s.argmax(axis=1)[want[:, 0] > max(least, -1)] + 7).all()


def grouped(n, groups, seed=0):
    """Vectors around a few centres, some of them nearly alike, and a dense lot of such."""
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((groups, 64))[np.arange(n) % groups] + rng.standard_normal((n, 64))
    x[: n // 3] = x[n // 3 : 2 * (n // 3)] + 0.3 * rng.standard_normal((n // 3, 64))
    x[-n // 10 :] = x[-1] + 0.1 * rng.standard_normal((n // 10, 64))
    return (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)


@pytest.mark.parametrize("least", [0.6, 0.9, 0.99])
def test_pairs_out_of_reach_are_not_multiplied(least):
    x = grouped(6000, 8)
    centres = N.learn_centres(x, 16)
    cell, axes = N._cells(x, centres), np.linalg.qr(np.random.default_rng(5).standard_normal((64, 20)))[0].astype(np.float32)
    made_, all_, found = 0, 0, 0
    for p in range(4):
        a, heaps = x[cell == p], N.Heaps((cell == p).sum(), 10, least)
        for q in range(len(centres)):
            d = centres[p] - centres[q]
            b = x[cell == q]
            if p != q:
                made_, all_ = made_ + N.join_apart(heaps, a, b, 10, q << 32, least, d / np.linalg.norm(d), axes), all_ + len(a) * len(b)
        s = a.astype(float) @ x[cell != p].astype(float).T
        want, got = -np.sort(-s, axis=1)[:, :10], -np.sort(-heaps.value, axis=1)[:, :10]
        assert np.abs(np.where(want >= least, want, -9) - np.where(got >= least, got, -9)).max() < 1e-6
        found += (want >= least).sum()
    assert made_ < (0.5 if least >= 0.9 else 1.01) * all_ and (found or least > 0.95)
    same = N.Heaps(len(x), 10, least)
    N.join_apart(same, x, x[::-1], 10, 0, least, np.zeros(64, np.float32), axes)  # in one cell, with a dense lot
    assert np.abs(np.where((w := -np.sort(-(x.astype(float) @ x.T), axis=1)[:, :10]) >= least, w, -9) - -np.sort(-same.value, axis=1)[:, :10]).max() < 1e-6


def test_copies_make_no_blocks(spark, monkeypatch):
    seen, join = [], N.block_join
    monkeypatch.setattr(N, "block_join", lambda distinct, rows, *a: seen.append(rows) or join(distinct, rows, *a))
    df = spark.createDataFrame([(f"c{i}-{j}", v.tolist(), "k", 1) for i, v in enumerate(made(50)) for j in range(20)], SCHEMA)
    assert N.nearest(df, least=0.99).count() == 10_000 and seen == [50]


@pytest.mark.parametrize("block_rows", [100, 16_384])
def test_near_vectors_in_cells_against_brute_force(spark, block_rows):
    x = grouped(3000, 6, 3)
    rows = spark.createDataFrame([(f"c{i:04d}", v.tolist(), "k", 1) for i, v in enumerate(x)], SCHEMA)
    s = x.astype(float) @ x.astype(float).T
    np.fill_diagonal(s, -9)
    got = {}
    for r in N.nearest(rows, least=0.9, block_rows=block_rows).orderBy("chunk_id", "rank").collect():
        got.setdefault(r.chunk_id, []).append(r.similarity)
    for i in range(len(x)):
        want = -np.sort(-s[i])[:10]
        want = want[want >= 0.9]
        assert len(got.get(f"c{i:04d}", [])) == len(want) and np.allclose(got.get(f"c{i:04d}", []), want, atol=1e-6)


def test_heaps_over_many_blocks():
    """Thresholds carried from block to block lose no neighbour."""
    x = made(4000)
    heaps = N.Heaps(1000, 10, -2.0)
    N.join_blocks(heaps, x[:1000], None, 10)
    for at in range(1000, 4000, 700):
        N.join_blocks(heaps, x[:1000], x[at : at + 700], 10, at)
    s = x[:1000].astype(float) @ x.astype(float).T
    np.fill_diagonal(s, -9)
    assert np.abs(np.sort(-s, axis=1)[:, :10] - np.sort(-heaps.value, axis=1)[:, :10]).max() < 1e-6


def test_pairs_that_leave_the_tasks_do_not_grow_with_the_blocks(spark):
    df = spark.createDataFrame([(f"c{i}", v.tolist(), "k", 1) for i, v in enumerate(made(400))], SCHEMA)
    distinct = N.keyed(df).groupBy("key").agg({"vector": "min"}).withColumnRenamed("min(vector)", "vector")
    found = {rows: N.block_join(distinct, 400, block_rows=rows)[1] for rows in (200, 25)}
    assert [f.count() for f in found.values()] == [4000, 4000]
    total = [round(f.agg({"similarity": "sum"}).first()[0], 4) for f in found.values()]
    assert total[0] == total[1]


def test_schemes():
    assert N._open("file:/tmp")[1] == "/tmp"


def test_quantisation_bound():
    x = made(400)
    q, s, e = N.quantise(x)
    y = q.astype(np.float64) * s
    assert (np.abs(x.astype(np.float64) @ x.T - y @ y.T) <= (e[:, None] + e[None, :] * (1 + e[:, None]))).all()


def test_against_brute_force_with_copies(spark):
    x = made(300)
    rows = [(f"c{i:03d}", (v * (1 + i % 3)).tolist(), "k", 1) for i, v in enumerate(x)]
    rows += [(f"d{i:03d}", x[0].tolist(), "k", 1) for i in range(40)] + rows[:5]
    rows += [("n", None, "k", 1), ("z", [0.0] * 64, "k", 1), ("s", [1.0] * 63, "k", 1), ("i", [float("inf")] + [1.0] * 63, "k", 1), ("q", [None] + [1.0] * 63, "k", 1), (None, x[1].tolist(), "k", 1)]
    got = {}
    for r in N.nearest(spark.createDataFrame(rows, SCHEMA), block_rows=90).orderBy("chunk_id", "rank").collect():
        got.setdefault(r.chunk_id, []).append((r.neighbour_id, r.similarity))
    ids = [f"c{i:03d}" for i in range(300)] + [f"d{i:03d}" for i in range(40)]
    e = np.vstack([x, np.repeat(x[:1], 40, 0)]).astype(float)
    s = np.round(e @ e.T, 6)
    assert set(got) == set(ids)
    for i, a in enumerate(ids):
        want = sorted((-s[i, j], b) for j, b in enumerate(ids) if j != i)[:10]
        assert max(abs(v + w) for (_, v), (w, _) in zip(got[a], want, strict=True)) < 1e-5
        assert a not in [b for b, _ in got[a]]
        if a in ("c000", "d007"):
            assert [b for b, _ in got[a]] == [b for _, b in want]


def test_pairs_and_empty(spark):
    df = spark.createDataFrame([("b", [1.0] * 64, "", 0), ("a", [2.0] * 64, "", 0), ("c", [1.0] * 32 + [-1.0] * 32, "", 0)], SCHEMA)
    assert [tuple(r) for r in N.similar_pairs(N.nearest(df, least=0.9)).collect()] == [("a", "b")]
    assert N.nearest(df.limit(0)).collect() == []
