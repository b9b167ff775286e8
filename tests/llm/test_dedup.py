import hashlib
import random
from collections import defaultdict

import pytest

from foldspark.llm import dedup

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, largest=True):
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(LOWER)].append(i)
    out = []
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = (max if largest else min)(known) if known else None
        sha, stays = hashlib.sha256(t.encode()).hexdigest(), True
        for i in sorted(ids, key=lambda i: i != keep):
            out.append((i, keep, len(ids), stays and i == keep, sha))
            stays = stays and i != keep
    return sorted(out, key=repr)


def frame(spark, rows, parts=5):
    return spark.createDataFrame([(i, t, "x", 1, b"x") for i, t in rows], "doc_id long, text string, head string, part int, sha binary").repartition(parts)


def found(spark, rows, **options):
    return sorted((tuple(r) for r in dedup.exact_groups(frame(spark, rows), **options).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=repr)


def corpus(seed):
    rng = random.Random(seed)
    texts = [" ".join(rng.choice(["alpha", "Beta", "GAMMA", "née", "Éa"]) for _ in range(rng.randint(0, 6))) for _ in range(120)]
    prefix = "the same first words of a licence that very many texts share, "
    texts += [prefix + str(n) for n in range(60)] + ["x" * 300_000, "X" * 300_000, "x" * 299_999 + "y"]
    rows = [(i, rng.choice([t, t.upper(), t.swapcase()])) for i, t in enumerate(rng.choices(texts, k=700))]
    rows += [(5000 + i, "A hot text that a third of all rows hold") for i in range(400)]
    rows += [(i, None) for i in range(9000, 9007)] + [(9100, ""), (None, "Only without an id"), (None, None), (None, "alpha"), (7, "Again"), (7, "again"), (7, "AGAIN"), (7, "other")]
    return rows


@pytest.mark.parametrize("partitions", [1, 4, 37])
def test_matches_brute_force_in_few_and_many_ranges(spark, partitions):
    rows = corpus(partitions)
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        assert found(spark, rows) == brute(rows)
        assert found(spark, rows, keep="smallest") == brute(rows, largest=False)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_one_text_only_lies_in_several_ranges(spark):
    rows = [(i, "one text" if i % 2 else "ONE text") for i in range(3000)]
    rows += [(4000, "One Text")] * 500  # repeated rows: one of them stays
    assert found(spark, rows) == brute(rows)


def test_small_batches(spark):
    rows = corpus(9)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
        assert found(spark, rows) == brute(rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_empty_table_and_wrong_option(spark):
    assert found(spark, []) == []
    with pytest.raises(ValueError):
        dedup.exact_groups(frame(spark, []), keep="any")


def test_only_ascii_letters_are_lowered(spark):
    rows = [(1, "\u00c9"), (2, "\u00e9"), (3, "\u212a"), (4, "K"), (5, "k"), (6, "a b"), (7, "a  b")]  # a Kelvin sign is no K
    assert [r[2] for r in found(spark, rows)] == [1, 1, 1, 2, 2, 1, 1]
