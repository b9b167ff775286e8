import hashlib
import math
from collections import defaultdict

import numpy as np

from foldspark.llm import codes


def brute(rows, parts=16, entries=64, rounds=2):
    """rows: (vec_id, embedding, label), vectors of one length, ids apart."""
    use = [(i, [math.floor(256 * float(x)) for x in v], k) for i, v, k in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not use:
        return []
    w = len(use[0][1]) // parts
    cuts = [[tuple(v[p * w : (p + 1) * w]) for p in range(parts)] for _, v, _ in use]
    first = sorted(range(len(use)), key=lambda n: use[n][0])[:entries]
    books = [[list(cuts[n][p]) for n in first] for p in range(parts)]

    def nearest(p, part):
        return min((sum((a - b) ** 2 for a, b in zip(part, e, strict=True)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        new = []
        for p in range(parts):
            own = defaultdict(list)
            for c in cuts:
                own[nearest(p, c[p])[1]].append(c[p])
            new.append([[sum(x) // len(x) for x in zip(*own[k], strict=True)] if k in own else e for k, e in enumerate(books[p])])
        books = new
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    found, by = [], defaultdict(int)
    for (i, _, k), c in zip(use, cuts, strict=True):
        best = [nearest(p, c[p]) for p in range(parts)]
        found.append((i, "".join(f"{e:02x}" for _, e in best), sum(d for d, _ in best), k))
        by[k] += found[-1][2]
    return sorted((i, code, min(e, 2**63 - 1), min(by[k], 2**63 - 1), sha) for i, code, e, k in found)


def run(spark, rows, kind="float"):
    df = spark.createDataFrame([(*r, "x", 3) for r in rows], f"vec_id long, embedding array<{kind}>, label int, code string, dim int").repartition(3)
    return sorted(tuple(r) for r in codes.compress(df).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect())


def test_matches_brute_force(spark):
    rng = np.random.default_rng(0)
    rows = [(i * 3 % 601, [float(np.float32(x)) for x in rng.normal(0, 0.3, 32)], int(rng.integers(4))) for i in range(300)]
    rows += [(700 + i, rows[5][1], None) for i in range(90)]  # ties, and a label of nulls
    rows += [(900, None, 1), (901, [None] * 32, 1), (902, [math.nan] * 32, 1), (903, [math.inf] + [0.0] * 31, 1), (-1, [0.0] * 31 + [None], 2)]
    assert run(spark, rows) == brute(rows)


def test_fewer_vectors_than_entries_and_unused_entries(spark):
    rows = [(i, [0.25] * 16, 0) for i in range(10)] + [(20, [0.5] * 16, 1)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []
    assert run(spark, [(1, None, 1), (2, [math.nan] * 16, 0)]) == []


def test_beyond_64_bits(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(0, 10.0 ** (i % 15), 16)], i % 2) for i in range(90)]
    assert run(spark, rows, "double") == brute(rows)


def test_lengths_apart_and_repeated_rows(spark):
    rng = np.random.default_rng(2)
    short = [(i, [float(np.float32(x)) for x in rng.normal(0, 1, 16)], None) for i in range(80)]
    long = [(1000 + i, [float(np.float32(x)) for x in rng.normal(0, 1, 48)], None) for i in range(80)]
    both = run(spark, short + long + [(5000, [], None), (5001, [1.0, 2.0, 3.0], 7)])
    strip = lambda rows: [(r[0], r[1], r[2], r[4]) for r in rows]  # noqa: E731  null labels meet
    assert strip(both)[:160] == sorted(strip(brute(short)) + strip(brute(long)))
    assert both[-1][1:3] == ("00" * 16, 0) and both[-2][1:3] == ("00" * 16, 0)
    assert len(run(spark, short + short)) == 160


def test_bounds_hold_and_few_pairs_are_measured():
    rng = np.random.default_rng(3)
    entries, q = rng.integers(-200, 200, (64, 4)), rng.integers(-300, 300, (500, 4))
    found, distance, measured = codes.Cells(entries).nearest(q)
    full = ((q[:, None] - entries[None]) ** 2).sum(axis=2)
    assert found.tolist() == full.argmin(axis=1).tolist() and distance.tolist() == full.min(axis=1).tolist()
    assert 500 <= measured < 0.4 * full.size
