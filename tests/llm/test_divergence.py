import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from foldspark.llm import divergence

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(rows, least=10, top=10):
    docs, counts, totals, groups = Counter(), defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        found = TERM.findall((text or "").translate(LOWER))
        groups[lang].add(source)
        docs.update((lang, t) for t in set(found))
        counts[lang, source].update(found)
        totals[lang].update(found)
    out = []
    for lang, sources in groups.items():
        kept = [t for t in totals[lang] if docs[lang, t] >= least]

        def shares(c, kept=kept):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (n + 2 * len(kept)) for t in kept}

        q, p = shares(totals[lang]), {s: shares(counts[lang, s]) for s in sources}
        f = lambda x, y: (x - y) ** 2 // (x + y)
        for s in sources:
            pairs = sorted((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in sources if o != s)
            terms = sorted((-f(p[s][t], q[t]), t.encode()) for t in kept if counts[lang, s][t] and p[s][t] > q[t])[:top]
            for part, found in (("pair", pairs), ("term", terms)):
                out += [(lang, s, part, i.decode(), -v, n + 1) for n, (v, i) in enumerate(found)]
    return sorted(out)


def run(spark, rows, **options):
    df = spark.createDataFrame([(t, a, b, 5, "x", 2) for t, a, b in rows], "text string, lang string, source string, n long, term string, docs int").repartition(3)
    return sorted(tuple(r) for r in divergence.audit(df, **options).select("lang", "source", "part", "item", "value", "rank").collect())


def corpus(seed, n=600):
    rng = random.Random(seed)
    words = [w + "abcdefgh"[i % 8] * (i % 4) for i, w in enumerate(["Term", "straße", "naïve", "x", "Überall", "la", "DE", "ordinaire"] * 12)] + ["rare" + chr(97 + i) * 3 for i in range(26)]
    rows = []
    for _ in range(n):
        lang, source = rng.choice(["en", "de", None, ""]), rng.choice(["hot"] * 5 + ["a", "b", "c", None, "d"])
        own = words if source != "b" else words[: len(words) // 2]
        rows.append((rng.choice([" ", "-", "1", "\x00", ". "]).join(rng.choices(own, k=rng.randint(0, 30))), lang, source))
    return rows + [(None, "en", "silent"), ("", "fr", "one"), ("a b c", "fr", "two"), ("only here", "it", "alone"), ("y " * 50_000 + "z" * 70_000, "en", "long")] + [("same same words", "es", "s1")] * 12 + [("same words Same", "es", "s2")] * 3


@pytest.mark.parametrize("width", [None, 1 << 16, 8])
def test_matches_brute_force_whatever_the_sketch(spark, width):
    rows = corpus(1)
    assert run(spark, rows, width=width) == brute(rows)


def test_other_limits(spark):
    rows = corpus(2, 200)
    assert run(spark, rows, min_docs=3, top=4) == brute(rows, 3, 4)
    assert run(spark, rows, min_docs=10_000) == brute(rows, 10_000)


def test_empty_tables_and_texts(spark):
    assert run(spark, []) == []
    assert run(spark, [(None, None, None)]) == []
    assert run(spark, [(None, "en", "a"), ("", "en", "b"), ("...", "en", "a")]) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]


def test_sketch_never_underestimates_and_drops_rare_terms(spark):
    rows = corpus(3) + [(" ".join("rare" + chr(97 + i) + chr(97 + j) for j in range(26)), "en", "a") for i in range(26)]
    df = spark.createDataFrame(rows, "text string, lang string, source string").repartition(4)
    docs = Counter((lang or "", t) for text, lang, _ in rows for t in set(TERM.findall((text or "").translate(LOWER))))
    bits = divergence.frequent_cells(df, 10, 1 << 16)
    passed = 0
    for (lang, term), n in docs.items():
        cells = divergence.cells_of(pa.array([term.encode()], pa.large_binary()), np.array([0]), pa.array([lang]), np.array([0]), 1 << 16)[:, 0]
        may = all(bits[r, c >> 3] >> (7 - (c & 7)) & 1 for r, c in enumerate(cells))
        assert may or n < 10
        passed += may and n < 10
    rare = sum(n < 10 for n in docs.values())
    assert rare > 600 and passed < 0.1 * rare
