import numpy as np
import pytest

from fieldloom.llm import vectors as vc


def world(n=3000, dim=32, seed=1):
    """Clusters of near vectors, loners, copies up to length, and vectors that take no part."""
    rng = np.random.default_rng(seed)
    rows, i = [], 0
    for _ in range(n // 20):
        c = rng.normal(size=dim)
        for _ in range(rng.integers(1, 12)):
            v = c + rng.normal(size=dim) * 0.25
            rows.append((i, (v * rng.uniform(0.5, 2)).tolist()))
            i += 1
    base = rows[0][1]
    for k in range(9):
        rows.append((i, [x * (k + 1) for x in base]))
        i += 1
    rows += [(i, None), (i + 1, [0.0] * dim), (i + 2, [float("nan")] * dim), (i + 3, [1.0, 2.0]), (i + 4, [None] * dim)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, id string, cos int")


def matrix(rows, dim=32):
    good = [(i, v) for i, v in rows if v is not None and len(v) == dim and all(x is not None and x == x for x in v) and any(v)]
    x = np.array([v for _, v in good])
    return np.array([i for i, _ in good]), x / np.linalg.norm(x, axis=1, keepdims=True)


def test_top_k_against_brute_force(spark):
    rows = world()
    ids, x = matrix(rows)
    s = np.round(x @ x.T, 6)
    np.fill_diagonal(s, -2)
    want = set()
    for a in range(len(ids)):
        order = sorted(range(len(ids)), key=lambda b: (-s[a, b], ids[b]))[:5]
        want |= {(ids[a], ids[b]) for b in order if s[a, b] >= 0.88}
    got = {(r.id, r.neighbour) for r in vc.top_k(frame(spark, rows), 5, 0.88, vc.Forest(candidates=512, leaf=256, range_rows=800)).collect()}
    assert len(want & got) / len(want) > 0.97
    assert len(want & got) / len(got) > 0.97


def test_pairs_meet_in_many_ranges(spark):
    """Pairs little above the floor, in a table cut into 40 ranges in each routing tree: three routes lose a sixth of them."""
    rng = np.random.default_rng(4)
    one = rng.normal(size=(1200, 32))
    two = one + rng.normal(size=one.shape) * 0.48
    x = np.concatenate([one, two])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    cos = (x[:1200] * x[1200:]).sum(axis=1)
    want = {(i, i + 1200) for i in np.nonzero((cos >= 0.88) & (cos < 0.92))[0]}
    forest = vc.Forest(range_rows=60)
    got = {(r.id, r.neighbour) for r in vc.top_k(frame(spark, list(enumerate(x.tolist()))), 5, 0.88, forest).collect()}
    assert len(want) > 500 and len(want & got) / len(want) > 0.95
    assert [vc.routes_for(n, 0.88, vc.Forest()) for n in (900, 50_000, 200_000, 2_000_000, 17_000_000)] == [3, 3, 3, 7, 13]


def test_clusters_against_brute_force(spark):
    rows = world(seed=2)
    ids, x = matrix(rows)
    near = x @ x.T >= 0.88
    lab = vc._labels(len(ids), *np.nonzero(near))
    sizes = np.bincount(lab, minlength=len(ids))
    want = {(ids[lab[i]], ids[i]) for i in range(len(ids)) if sizes[lab[i]] >= 5}
    got = {(r.cluster_id, r.vec_id) for r in vc.clusters(frame(spark, rows), 0.88, 5, vc.Forest(candidates=512, leaf=256, range_rows=800)).collect()}
    assert len(want & got) / len(want) > 0.97 and len(got - want) <= 0.02 * len(want)


def test_search_finds_far_neighbours(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=16).tolist()) for i in range(2000)]
    ids, x = matrix(rows, 16)
    got = {}
    for r in vc.search(frame(spark, rows), F.col("id") % 100 == 0, 5, vc.Forest(routes=4, candidates=3000, range_rows=1000)).collect():
        got.setdefault(r.id, set()).add(r.neighbour)
    hit = 0
    for q in range(0, 2000, 100):
        s = x @ x[q]
        s[q] = -2
        hit += len(got[q] & set(ids[np.argsort(-s)[:5]]))
    assert hit / 100 >= 0.9


def test_search_counts_copies(spark):
    """A third of the rows are one vector: each copy that is a query has its rows, and copies are neighbours."""
    from pyspark.sql import functions as F

    rng = np.random.default_rng(6)
    rows = [(i, [1.0, 2.0, 3.0, 4.0] if i % 3 == 2 else rng.normal(size=4).tolist()) for i in range(300)]
    got = {}
    for r in vc.search(frame(spark, rows), F.col("id") % 10 == 0, 5).orderBy("id", "rank").collect():
        got.setdefault(r.id, []).append((r.rank, r.neighbour, round(r.cos, 3)))
    ids, x = matrix(rows, 4)
    assert sorted(got) == list(range(0, 300, 10))
    assert got[50] == [(i + 1, 3 * i + 2, 1.0) for i in range(5)]
    for q, found in got.items():
        s = np.round(x @ x[q], 3)
        s[q] = -2
        assert [c for _, _, c in found] == pytest.approx(sorted(s, reverse=True)[:5], abs=2e-3)
    two = vc.search(frame(spark, [(1, [1.0, 0.0]), (2, [2.0, 0.0])]), F.col("id") == 2, 5).collect()
    assert [(r.id, r.rank, r.neighbour) for r in two] == [(2, 1, 1)]


def test_partition_setting_changes_nothing(spark):
    df = frame(spark, world(seed=3))
    got = {}
    try:
        for n in ("4", "200"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            got[n] = {(r.id, r.neighbour) for r in vc.top_k(df, 5, 0.88, vc.Forest(candidates=256, leaf=64, range_rows=800)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(got["4"] & got["200"]) / len(got["4"] | got["200"]) > 0.97
    assert [vc.ranges(n, vc.Forest()) for n in (0, 900, 20_000, 200_000, 2_000_000)] == [1, 1, 1, 12, 120]


@pytest.mark.parametrize("rows", [[], [(1, None), (2, [0.0, 0.0])], [(1, [1.0, 0.0])], [(1, [1.0, 0.0]), (2, [2.0, 0.0])]])
def test_small_tables(spark, rows):
    df = frame(spark, rows)
    n = 2 if len(rows) == 2 and rows[0][1] else 0
    assert vc.top_k(df).count() == n
    assert vc.clusters(df, least=2).count() == n


def test_many_copies_of_one_vector(spark):
    rows = [(i, [1.0, 2.0, 3.0, float(i % 2)]) for i in range(4000)]
    got = vc.top_k(frame(spark, rows), 5, 0.88)
    assert got.count() == 20_000 and got.where("id = 11 and rank = 5").first().neighbour == 9
    assert vc.clusters(frame(spark, rows)).select("cluster_id").distinct().count() == 1


def test_leaves_cover_all():
    keys = np.sort(np.random.default_rng(0).integers(0, 1 << 20, 5000).astype(np.int64) << 30)
    keys[:3000] = keys[0]
    keys.sort()
    seen = np.zeros(5000, bool)
    for a, b in vc.leaves(keys, 64):
        assert b - a <= 64 or (keys[a:b] == keys[a]).all()
        seen[a:b] = True
    assert seen[:3000].all()


def test_trees_ascend_together():
    keys = np.sort(np.random.default_rng(1).integers(0, 1 << vc.BITS, 1000))
    other = np.sort(np.random.default_rng(2).integers(0, 1 << vc.BITS, 1000))
    depth, lo, hi = vc.ascend([keys, other], [keys[:50], other[50:100]], 40)
    for i in range(50):
        n = [sum(int(((k >> (vc.BITS - d)) == (q >> (vc.BITS - d))).sum()) for k, q in ((keys, keys[i]), (other, other[50 + i]))) for d in (depth[i], depth[i] + 1)]
        assert n[0] >= 40 > n[1] and n[0] == hi[0][i] - lo[0][i] + hi[1][i] - lo[1][i]
    assert (vc.ascend([keys], [keys[:3]], 5000)[0] == 0).all()


@pytest.mark.parametrize("k", [1, 5])
def test_best_of_each_row(k):
    s = np.round(np.random.default_rng(3).random((40, 30)), 1).astype(np.float32)
    a, b = vc._best(s, k, 0.5)
    for i in range(40):
        assert sorted(b[a == i]) == sorted([j for j in np.argsort(-s[i], kind="stable") if s[i, j] >= np.float32(0.5)][:k])


def crowd(n=4000, dim=32):
    """Vectors that are all near each other."""
    rng = np.random.default_rng(8)
    c = rng.normal(size=dim)
    return [(i, (c / np.linalg.norm(c) + rng.normal(size=dim) * np.sqrt((1 / 0.91 - 1) / dim)).tolist()) for i in range(n)]


def test_crowded_queries_ascend(spark):
    rows = crowd()
    ids, x = matrix(rows)
    s = x @ x.T
    np.fill_diagonal(s, -2)
    want = {(ids[a], ids[b]) for a in range(len(ids)) for b in np.argsort(-s[a])[:5]}
    got = {(r.id, r.neighbour) for r in vc.top_k(frame(spark, rows), 5, 0.88, vc.Forest(candidates=256, range_rows=3000)).collect()}
    assert len(want & got) / len(want) > 0.9
    exact = {(r.id, r.neighbour) for r in vc.top_k(frame(spark, rows), 5, 0.88, exact=True).collect()}
    assert len(want & exact) / len(want) > 0.999
    assert vc.clusters(frame(spark, rows), 0.88, 5, vc.Forest(leaf=64, range_rows=3000)).select("cluster_id").distinct().count() == 1


def test_exact_in_many_blocks(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(vc, "BLOCK_ROWS", 100)
    df = frame(spark, world(800, seed=5))
    near = {(r.id, r.neighbour) for r in vc.top_k(df, 5, 0.88).collect()}
    assert {(r.id, r.neighbour) for r in vc.top_k(df, 5, 0.88, exact=True).collect()} == near
    a, b = (sorted((r.id, r.rank, round(r.cos, 3)) for r in vc.search(df, F.col("id") % 10 == 0, 3, exact=e).collect()) for e in (True, False))
    assert a == b


def test_rows_with_one_hash_string():
    x = np.tile(np.array([[1.0, 0, 0]]), (3000, 1)) + np.random.default_rng(1).normal(size=(3000, 3)) * 0.01
    x[::2, 1] += 1
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    of, bridge = vc._crowd(x, np.arange(3000).astype(np.uint64), 0.88)
    assert set(of) == {0, 1} and not len(bridge)
    of, bridge = vc._crowd(x, np.arange(3000).astype(np.uint64), 0.5)
    assert set(of) == {0} and not len(bridge)


def test_pivot_rounds_against_one_by_one(spark):
    """The rounds give what taking the records one by one in hash order gives."""
    from pyspark.sql import functions as F

    rng = np.random.default_rng(9)
    edges = {tuple(sorted(map(int, rng.choice(120, 2, replace=False)))) for _ in range(200)}
    df = spark.createDataFrame([(a, b, float(round(0.88 + 0.1 * rng.random(), 3))) for a, b in sorted(edges)], "a long, b long, cos double")
    df = df.withColumn("ha", F.xxhash64("a")).withColumn("hb", F.xxhash64("b"))
    cos = {(r.a, r.b): r.cos for r in df.collect()}
    cos |= {(b, a): c for (a, b), c in cos.items()}
    nodes = sorted({a for a, _ in cos})
    order = {r.id: (r.h, r.id) for r in spark.createDataFrame([(n,) for n in nodes], "id long").select("id", F.xxhash64("id").alias("h")).collect()}
    free, pivots = set(nodes), set()
    for n in sorted(nodes, key=order.get):
        if n in free:
            pivots.add(n)
            free -= {n} | {b for a, b in cos if a == n}
    want = {n: n if n in pivots else min((-cos[n, p], p) for p in pivots if (n, p) in cos)[1] for n in nodes}
    assert {r.id: r.pivot for r in vc.pivot_rounds(df).collect()} == want


def test_pivots_absorb_neighbours():
    s = np.array([[1, 0.9, 0.2], [0.9, 1, 0.95], [0.2, 0.95, 1]])
    sim = (s >= 0.88) & ~np.eye(3, dtype=bool)
    assert vc.pivots(sim, s, np.array([5, 1, 9], np.uint64)).tolist() == [1, 1, 1]
    assert vc.pivots(sim, s, np.array([1, 5, 9], np.uint64)).tolist() == [0, 2, 2] or vc.pivots(sim, s, np.array([1, 5, 9], np.uint64)).tolist() == [0, 0, 2]


def test_describe(spark):
    rows = [(i, [1.0, 0.02 * i, 0.0]) for i in range(7)] + [(50, [0.0, 0.0, 1.0])]
    df = frame(spark, rows)
    (r,) = vc.describe(df.withColumnRenamed("id", "name"), vc.clusters(df), "name").collect()
    assert (r.cluster_id, r.n_members, r.medoid, len(r.typical)) == (0, 7, 3, 3)
    assert vc.describe(df.withColumnRenamed("id", "name"), vc.clusters(df.limit(0)), "name").count() == 0
    (r,) = vc.describe(df.withColumnRenamed("id", "name"), vc.pivot_clusters(df), "name").collect()
    assert (r.n_members, r.medoid) == (7, 3)
