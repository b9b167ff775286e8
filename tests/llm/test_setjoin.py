import random
import re

import numpy as np
import pyarrow as pa
import pytest

from foldspark.llm import setjoin, words
from foldspark.llm.components import components


def brute(rows, k, num, den):
    sets = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0d]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        sets.append((i, {tuple(w)} if 0 < len(w) < k else {tuple(w[j : j + k]) for j in range(len(w) - k + 1)}))
    label = list(range(len(sets)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a][1] & sets[b][1])
            if both and den * both >= num * len(sets[a][1] | sets[b][1]):
                label[find(a)] = find(b)
    least = {}
    for n, (i, _) in enumerate(sets):
        least[find(n)] = min(i, least.get(find(n), i))
    return sorted((i, len(s), least[find(n)]) for n, (i, s) in enumerate(sets))


def mutated(rng, base, n):
    w = base.split(" ")
    for _ in range(n):
        w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


@pytest.mark.parametrize(("k", "num", "den"), [(4, 85, 100), (5, 80, 100)])
def test_components_match_brute_force(spark, k, num, den):
    rng = random.Random(k)
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "One two"), (4, "one TWO"), (5, "İ one"), (6, "one two three four"), (6, "one two three four"), (7, "x" * 5000)]
    n = 100
    for _ in range(12):
        base = " ".join(rng.choice("abcdefghij") * rng.randrange(1, 4) for _ in range(rng.randrange(6, 150)))
        for _ in range(rng.randrange(1, 12)):
            rows.append((n, mutated(rng, base, rng.randrange(0, 3 + len(base) // 60))))
            n += rng.randrange(1, 3)
    chain = " ".join(f"c{i}" for i in range(120))  # links that reach further than any one pair
    for i in range(15):
        rows.append((n + i, " ".join(chain.split(" ")[i * 3 : 60 + i * 3])))
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n int, set_id string").repartition(3)
    found = sorted(tuple(r) for r in setjoin.jaccard_components(docs, k, num, den).collect())
    assert found == brute(rows, k, num, den)


def test_no_similar_pair_lacks_a_shared_signature():
    rng = np.random.default_rng(5)
    enum = setjoin.PartEnum(85, 100)
    for size in (1, 2, 6, 7, 13, 40, 100, 333, 1000):
        for _ in range(40):
            a = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64))
            kept = a[: len(a) - rng.integers(0, max(1, len(a) * 15 // 100) + 1)]
            room = int(len(kept) * 100 / 85 - len(a))
            b = np.unique(np.concatenate((kept, rng.integers(0, 2**63, max(0, room), dtype=np.uint64))))
            both = len(np.intersect1d(a, b))
            if 100 * both >= 85 * (len(a) + len(b) - both):
                assert set(enum.signatures(a).tolist()) & set(enum.signatures(b).tolist())


def test_keep_one_keeps_all_others_and_columns(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(3, text, "a"), (1, text, "b"), (1, text, "b"), (2, None, "c"), (2, None, "c"), (5, "other words are here today", "d")]
    kept = setjoin.keep_one(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 2, 5] and kept.columns == ["doc_id", "text", "lang"]


def near_copies(n, seed=3):
    """A group of copies of one text, each with up to six words changed, as (id, text)."""
    rng = random.Random(seed)
    base = " ".join(f"w{i}" for i in range(120))
    return [(i, mutated(rng, base, rng.randrange(7))) for i in range(n)]


def test_candidates_of_a_hot_group_grow_in_proportion(spark, monkeypatch):
    """Pairs that are verified, in the first pass and in the second, whose members are all close and not all similar."""
    real, rows = setjoin.cut, {}

    def counted(df, name):
        out = real(df, name)
        if name in ("join-pairs", "join-more"):
            rows[name] = out.count()
        return out

    monkeypatch.setattr(setjoin, "cut", counted)
    found = {}
    for n in (300, 1200):
        got = sorted(tuple(r) for r in setjoin.jaccard_components(spark.createDataFrame(near_copies(n), "doc_id long, text string").repartition(4), 4, 85, 100).collect())
        assert n > 300 or got == brute(near_copies(n), 4, 85, 100)
        found[n] = dict(rows)
    assert found[1200]["join-pairs"] < 6 * found[300]["join-pairs"], found
    assert found[1200]["join-more"] < 6 * max(found[300]["join-more"], 100), found


def test_parities_differ_in_no_more_bits_than_sets_in_elements(spark):
    rng = np.random.default_rng(8)
    rows = []
    for n in (0, 1, 40, 3072, 3073, 9000):
        x = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        for change in (0, 1, 9, 700):
            y = np.unique(np.concatenate((x[min(change, len(x)) :], rng.integers(0, 2**63, change, dtype=np.uint64))))
            rows.append((setjoin.parity(x).tolist(), setjoin.parity(y).tolist(), len(np.setxor1d(x, y))))
    table = spark.createDataFrame(rows, "x array<long>, y array<long>, apart long")
    found = table.select(setjoin._apart(table.x, table.y).alias("bits"), "apart").collect()
    assert all(r.bits <= r.apart for r in found) and sum(r.bits for r in found) > 0.5 * sum(r.apart for r in found if r.apart < 100)


def test_links_over_rows_without_an_id(spark):
    """The set that links two others is held by a row with a null id alone."""
    words = [f"c{i}" for i in range(120)]
    rows = [(5, " ".join(words[:100])), (None, " ".join(words[7:107])), (9, " ".join(words[14:114])), (None, "x y"), (None, "x y"), (None, None)]
    found = setjoin.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85, 100).collect()
    assert sorted(((r.doc_id, r.component_id) for r in found), key=repr) == sorted([(5, 5), (None, 5), (9, 5), (None, None), (None, None), (None, None)], key=repr)


def test_keep_one_knows_rows_by_id_and_text(spark):
    one, other = (" ".join(f"{c}{i}" for i in range(30)) for c in "ab")
    rows = [(None, one), (None, one), (None, other), (4, other), (4, one), (4, "third text of this id here"), (4, "third text of this id here"), (None, None), (6, "")]
    table = spark.createDataFrame([(*r, 1, "k", 2) for r in rows], "doc_id long, text string, kept int, _id string, root int")
    kept = setjoin.keep_one(table)
    assert kept.columns == table.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted([(4, one), (4, other), (4, "third text of this id here"), (None, None), (6, "")], key=repr)


def test_long_texts(spark):
    text = " ".join(f"w{i}" for i in range(60_000))
    rows = [(1, text), (2, text.replace("w77 ", "x ")), (3, "z " * 200_000)]
    found = setjoin.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85, 100).collect()
    assert sorted(tuple(r) for r in found) == [(1, 59_997, 1), (2, 59_997, 1), (3, 1, 3)]


def test_empty_table(spark):
    assert setjoin.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_words_match_a_plain_split():
    texts = [None, "", "A b\tC", "é\x0bÉ  x", "  lead", "trail ", "a b c"]
    found = {}
    for a, b, h, n in words.batches_of_words(pa.array(texts)):
        for i in range(a, b):
            found[i] = h[n[i - a] : n[i - a + 1]].tolist()
    one = {w: next(words.batches_of_words(pa.array([w])))[2][0] for w in ("a", "b", "c", "é", "É", "x", "lead", "trail", "a b")}
    want = [[], [], ["a", "b", "c"], ["é", "É", "x"], ["lead"], ["trail"], ["a b", "c"]]
    assert [found[i] for i in range(len(texts))] == [[one[w] for w in ws] for ws in want]
    sliced = pa.array(texts).slice(2, 3)
    assert sum(len(h) for _, _, h, _ in words.batches_of_words(sliced)) == 7


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(100, 140)] + [(7, 5), (7, 7), (5, 7)], "a long, b long")
    assert {r.id: r.root for r in components(edges).collect()} == {**{i: 100 for i in range(100, 141)}, 5: 5, 7: 5}
    assert components(edges.limit(0)).count() == 0


def test_hashing_words_takes_little_memory():
    """A batch's texts are hashed in slices, so that two workers fit beside an executor's heap."""
    import tracemalloc

    column = pa.array(["some words of a text " * 50] * 8_000)  # 8 MB
    next(words.batches_of_words(column))
    tracemalloc.start()
    n = sum(len(h) for _, _, h, _ in words.batches_of_words(column))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 8_000 * 250 and peak < 30e6
