import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from foldspark.llm import bpe, packing

TOKENIZER, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def test_ids_match_the_library():
    rng = random.Random(0)
    alphabet = list(" \n\t'sterdvlmA1é!.  漢٣　\x1c_") + ["<|endoftext|>", "'ll", "'ve ", "don't"]
    texts = ["", *("".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 25))) for _ in range(6000)), "word " * 30_000]
    encoder = bpe.BatchEncoder(TOKENIZER, RANKS)
    want = [e.ids for e in Tokenizer.from_file(TOKENIZER).encode_batch(texts, add_special_tokens=False)]
    for _ in range(2):  # the second time from memory
        assert [x.tolist() for x in encoder.encode(texts)] == want


def test_plan_uses_every_piece_once_and_fits():
    rng = random.Random(1)
    for _ in range(60):
        counts = Counter(rng.randrange(1, 65) for _ in range(rng.randrange(0, 400)))
        patterns = packing.plan(dict(counts), 64)
        used = Counter()
        for items, times in patterns:
            assert 0 < sum(items) <= 64
            for n in items:
                used[n] += times
        assert used == counts
        total = sum(n * c for n, c in counts.items())
        assert sum(t for _, t in patterns) <= max(-(-total // 64) + 1, 1.25 * total / 64 + 1)


def test_two_replace_the_smallest():
    # greedy puts 60 and 3 together; 2 and 2 fill the gap that 3 leaves
    assert packing.plan({60: 1, 3: 1, 2: 2}, 64)[0] == ([60, 2, 2], 1)


def test_documents(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(["a", "bc", "def", "ghij"]) for _ in range(rng.randrange(0, 90)))) for i in range(300)] + [(1000, None), (1001, ""), (1002, "x y " * 500), (5, "same"), (5, "same")]
    docs = spark.createDataFrame([(*r, 3) for r in rows], "doc_id long, text string, length int")
    found = packing.pack_documents(docs, 64).toPandas()
    whole = Tokenizer.from_file(TOKENIZER)
    want = []
    for i, t in rows:
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 0]
        first = (len(ids) - 1) % 64 + 1
        for n, end in enumerate(range(first, len(ids) + 1, 64)):
            start = max(0, end - 64)
            want.append((i, n, start, end - start, zlib.crc32(np.array(ids[start:end], "<u4").tobytes())))
    assert sorted(zip(found.doc_id, found.piece, found.start, found.length, found.ids_crc32, strict=True)) == sorted(want)
    for _, own in found.sort_values("offset").groupby("sequence_id"):
        assert own.offset.tolist() == (own.length.cumsum() - own.length).tolist() and own.length.sum() <= 64
    assert found.sequence_id.nunique() <= 1.1 * found.length.sum() / 64 + 1
    assert packing.pack_documents(docs.limit(0), 64).count() == 0


def test_groups_follow_the_counts(spark):
    """Few pieces to a group: many groups of one length; full pieces are sequences of their own."""
    rng = random.Random(6)
    lengths = [rng.choice([3, 7, 20, 64]) for _ in range(600)]
    pieces = spark.createDataFrame([(i, 0, 0, n, 0) for i, n in enumerate(lengths)], packing._PIECES)
    stored = packing.cut(pieces, "test-pieces")
    few, many = (packing.pack(stored, 64, n).toPandas() for n in (10, 10**9))
    for found in (few, many):
        assert sorted(found.length) == sorted(lengths)
        for _, own in found.sort_values("offset").groupby("sequence_id"):
            assert own.offset.tolist() == (own.length.cumsum() - own.length).tolist() and own.length.sum() <= 64
        assert found.sequence_id[found.length == 64].is_unique and (found.sequence_id[found.length == 64] < 0).all()
    assert few.sequence_id.nunique() == many.sequence_id.nunique()
    full = packing.pack(packing.cut(pieces.where("length = 64"), "test-full"), 64)
    assert full.count() == lengths.count(64) == full.select("sequence_id").distinct().count()
