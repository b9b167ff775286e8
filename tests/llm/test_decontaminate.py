import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa

from foldspark.llm import decontaminate as d
from foldspark.llm.words import batches_of_words


def sentence(rng, n):
    return " ".join(rng.choice("abcdefgh") + rng.choice("klmnop") * rng.randrange(1, 4) + str(rng.randrange(40)) for _ in range(n)) + "."


def fixture():
    rng = random.Random(4)
    items = [(i, sentence(rng, rng.randrange(8, 30)) + " " + sentence(rng, rng.randrange(3, 20))) for i in range(60)] + [(100, None), (101, "  ")]
    docs, want = [], set()
    for n in range(80):
        parts = [sentence(rng, 40) for _ in range(rng.randrange(0, 8))]
        if n % 3 == 0:
            i, text = items[rng.randrange(60)]
            parts.insert(rng.randrange(len(parts) + 1), text.upper() if n % 2 else text)
            want.add((n, i))
        docs.append((n, "\n".join(parts)))
    return items, [*docs, (900, None), (901, "")], want


def test_planted_items_are_found_and_others_left(spark):
    items, docs, want = fixture()
    found = d.leaks(spark.createDataFrame([(*x, "c") for x in docs], "doc_id long, text string, item_id string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in found.collect()} == want
    kept = d.drop_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == sorted({i for i, _ in docs} - {i for i, _ in want})


def test_retrieval_matches_plain_bm25():
    items, docs, _ = fixture()
    index = d.Index(items)
    every = [next(batches_of_words(pa.array([t])))[2] for _, t in items[:60]]
    mean = np.mean([len(w) for w in every])
    df = Counter(t for w in every for t in set(w.tolist()))

    def score(query, w):
        tf, norm = Counter(w.tolist()), d.K1 * (1 - d.B + d.B * len(w) / mean)
        return sum(math.log(1 + (len(every) - df[t] + 0.5) / (df[t] + 0.5)) * tf[t] * (d.K1 + 1) / (tf[t] + norm) for t in query if t in tf)

    own = [score(set(w.tolist()), w) for w in every]
    for _, text in docs[:30]:
        for _, _, h, n in batches_of_words(pa.array([text])):
            got = {(s, index.ids[i]) for s, i in index.retrieve(h, n)}
            starts = range(0, max(1, len(h) - (index.window - index.step)), index.step)
            want = {(s, items[i][0]) for s in starts for i, w in enumerate(every) if score(set(h[s : s + index.window].tolist()), w) >= d.RETRIEVE * own[i] * (1 - 1e-12)}
            assert got == want


def found_in(items, texts):
    index = d.Index(items)
    return [{index.ids[i] for _, _, h, n in batches_of_words(pa.array([t])) for _, i, _, _ in index.leaks(h, n)} for t in texts]


def test_one_changed_word_or_one_long_part_is_still_a_leak():
    rng = random.Random(9)
    items = [(i, sentence(rng, rng.randrange(12, 28)) + (" " + sentence(rng, rng.randrange(12, 28)) if i % 2 else "")) for i in range(30)]
    texts, want = [], []
    for i, text in items:
        words = text.split()
        texts += [" ".join([*words[:k], "changed" + "." * words[k].endswith("."), *words[k + 1 :]]) for k in range(len(words))]
        texts += [p for p in d.question_answer(text) if p]
        want += [{i}] * (len(words) + 1 + i % 2)
    texts = [sentence(rng, 150) + "\n" + t + "\n" + sentence(rng, 150) for t in texts]
    assert found_in(items, texts) == want


def test_an_item_with_a_long_insertion_is_still_a_leak():
    rng = random.Random(10)
    text = sentence(rng, 40)
    words = text.split()
    assert found_in([(1, text)], [" ".join([*words[:20], sentence(rng, 12), *words[20:]])]) == [{1}]


def test_items_with_short_parts_are_found():
    items = [(1, "What is the capital of France? Paris."), (2, "Who sings? The tall man from the harbour choir."), (3, "Really? Yes."), (4, "One two three.")]
    texts = ["It says: what is the capital of France? Paris. And more words follow here.", "Who sings? The tall man from the harbour choir.", "well really? yes. indeed", "so one two three. four", "the capital of Spain is what it is"]
    assert found_in(items, texts) == [{1}, {2}, {3}, {4}, set()]


def test_fewest_edits():
    w = lambda t: np.array([ord(c) for c in t], dtype=np.uint64)
    for part, text, share in (("abcde", "xxabcdexx", 1.0), ("abcde", "xabxdex", 0.8), ("abcde", "xabcxde", 0.8), ("abcde", "abde", 0.8), ("abcde", "edcba", 0.2), ("a", "", 0.0), ("", "abc", 0.0)):
        assert d.aligned(w(part), w(text)) == share


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b c")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert d.leaks(docs, items).count() == 0 and d.leaks(docs.limit(0), spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")).count() == 0
    assert d.leaks(docs, spark.createDataFrame([(1, " ")], "item_id long, text string")).count() == 0


def test_rows_are_known_by_id_and_text(spark):
    """Null and repeated ids: the row that holds an item goes, a clean one with its id stays; columns named like the operator's are kept."""
    items, docs, want = fixture()
    leak = next(t for i, t in docs if i == min(i for i, _ in want))
    rows = [(None, leak), (None, "clean"), (7, leak), (7, "clean"), (7, "clean"), (8, None)]
    table = spark.createDataFrame([(*r, 1, "h", "r") for r in rows], "doc_id long, text string, _id int, _hash string, row string")
    kept = d.drop_leaks(table, spark.createDataFrame(items, "item_id long, text string"))
    assert kept.columns == table.columns and sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted([(None, "clean"), (7, "clean"), (7, "clean"), (8, None)], key=repr)


def test_several_indexes_and_classes_of_lengths(spark, monkeypatch):
    rng = random.Random(6)
    items = [(i, sentence(rng, 20) + " " + sentence(rng, 6)) for i in range(40)] + [(100 + i, " ".join(sentence(rng, 30) for _ in range(n))) for i, n in enumerate((6, 7, 40, 41))] + [(None, sentence(rng, 25)), (3, sentence(rng, 25))]
    docs = [(n, " ".join([sentence(rng, 60), t, sentence(rng, 60)])) for n, (_, t) in enumerate(items)] + [(999, " ".join(sentence(rng, 60) for _ in range(50)))]
    monkeypatch.setattr(d, "ITEMS", 7)
    monkeypatch.setattr(d, "INDEXES", 3)
    table = spark.createDataFrame(docs, "doc_id long, text string")
    assert len(list(d._indexes(spark.createDataFrame(items, "item_id long, text string")))) > 6
    found = d.leaks(table, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted(((r.doc_id, r.item_id) for r in found), key=repr) == sorted(((n, i) for n, (i, _) in enumerate(items)), key=repr)
    assert d.leaks(table.limit(0), spark.createDataFrame(items, "item_id long, text string")).count() == 0 and d.leaks(table, spark.createDataFrame([], "item_id long, text string")).count() == 0
