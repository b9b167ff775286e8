import math

import numpy as np

from foldspark.llm import topk


def brute(rows, queries, k):
    use = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in use:
        if queries(q):
            scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in use if i != q and len(w) == len(v))[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    return sorted(out)


def test_matches_brute_force(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0, 0.2, 40)]) for i in range(700)]
    rows += [(1000 + i, rows[3][1]) for i in range(8)]  # ties
    rows += [(2000, None), (2001, [None] * 40), (2002, [math.nan] * 40), (2003, [math.inf] * 40), (2004, [0.5] * 7), (2050, [0.25] * 7), (2100, [0.1] * 3), (None, [0.1] * 40), (2150, [])]
    v = topk.quantize(spark.createDataFrame([(*r, 1, 5) for r in rows], "vec_id long, embedding array<float>, rank int, dim int").repartition(3))
    found = sorted(tuple(r) for r in topk.top_k(v, v.where("vec_id % 50 = 0"), 5).collect())
    assert found == brute(rows, lambda q: q % 50 == 0, 5)


def test_beyond_doubles_and_empty(spark):
    rows = [(0, [3.0e14, 1.0]), (1, [3.0e5, 1.0]), (2, [3.0e5, 2.0]), (3, [-1.0e300, 4.0]), (4, [1.0e16, 0.5]), (5, [1.0e307, 1.0]), (50, [1.0, 1.0]), (51, [1.0, 2.0**-8])]
    v = topk.quantize(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    found = sorted(tuple(r) for r in topk.top_k(v, v, 3).collect())
    assert {r[0] for r in found} == {0, 1, 2, 3, 4, 50, 51}  # 256 * 1e307 is no double
    within = lambda x: min(max(x, -(1 << 63)), (1 << 63) - 1)
    use = [(i, [math.floor(256 * x) for x in e]) for i, e in rows if i != 5]
    want = []
    for q, a in use:
        scored = sorted((-within(sum(x * y for x, y in zip(a, e, strict=True))), i) for i, e in use if i != q)[:3]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    assert found == sorted(want)
    assert topk.top_k(v.limit(0), v.limit(0), 5).count() == 0


def test_repeated_queries_and_candidates(spark):
    rows = [(0, [1.0, 0.0])] * 2 + [(0, [0.0, 1.0]), (1, [0.5, 0.25]), (2, [0.25, 0.5]), (2, [0.25, 0.5])]
    v = topk.quantize(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    found = sorted(tuple(r) for r in topk.top_k(v, v.where("vec_id = 0"), 2).collect())
    assert found == sorted([(0, 1, 1, 256 * 128), (0, 2, 2, 256 * 64), (0, 1, 2, 256 * 128), (0, 2, 2, 256 * 128)])


def test_every_chunk_is_bounded_by_the_seeds(spark, monkeypatch):
    rng = np.random.default_rng(4)
    monkeypatch.setattr(topk, "SEEDS", 50)
    rows = [(i, [float(x) for x in rng.normal(0, 1, 32)]) for i in range(600)]
    v = topk.quantize(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5))
    found = sorted(tuple(r) for r in topk.top_k(v, v.where("vec_id % 50 = 0"), 5).collect())
    assert found == brute(rows, lambda q: q % 50 == 0, 5)


def test_small_blocks_prune_and_stay_exact():
    rng = np.random.default_rng(1)
    q, c = rng.integers(-99, 99, (64, 9)).astype(float), rng.integers(-99, 99, (64, 500)).astype(float)
    c[:, :20] *= 3
    full = q.T @ c
    floor = np.sort(full, axis=1)[:, -5]
    for j, ids, score in topk.search_block(np.arange(9) - 100, q, np.arange(500), c, 5, floor):
        want = sorted(range(500), key=lambda i: (-full[j, i], i))[:5]
        assert ids.tolist() == want and score.tolist() == full[j, want].tolist()
