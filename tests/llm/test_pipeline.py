import os

import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def test_stages_match_the_operators(spark, tmp_path):
    import corpus_pipeline as p
    from foldspark.llm import decontaminate, packing, quality, secrets
    from tests_brute import components

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = []
    for n, (name, stage) in enumerate(p.STAGES):
        out = str(tmp_path / str(n))
        stage(spark, docs, SF).write.parquet(out)
        after = spark.read.parquet(out)
        if n < 4:
            assert after.columns == docs.columns, name
        kept.append({r.doc_id for r in after.select("doc_id").collect()})
        if n == 1:
            texts = [(r.doc_id, r.text) for r in docs.collect()]
            assert kept[1] == {c for _, _, c in components(texts, 5, 80, 100)}
        if n == 2:
            found = decontaminate.leaks(docs, spark.read.parquet(f"{SF}/benchmark.parquet"))
            assert kept[1] - kept[2] == {r.doc_id for r in found.collect()} and kept[2] < kept[1]
        if n == 3:
            assert kept[3] == kept[2] and secrets.scan(after).where("n_assign + n_access + n_hex + n_random > 0").count() == 0
        docs = after
    assert kept[4] == kept[3] and len(kept[0]) > len(kept[1])
    good = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()}
    assert len(good & kept[0]) >= 0.97 * len(good) and quality and packing


def test_nulls_repeats_empty_tables_and_extra_columns(spark, tmp_path):
    """Small tables with every odd row: the run's pieces are those of the rows that the stages' own operators keep."""
    import corpus_pipeline as p
    from foldspark.llm import quality

    plain = lambda c: " ".join(f"{c}{i} word here." for i in range(12))
    item = "What is the name of the tall tower by the river in that old town? It is called the iron lady of the north."
    rows = [(i, plain(f"x{i}y"), "en", "good") for i in range(60)] + [(100 + i, "BUY!! ### $$$ NOW!! *** %%% " * 5, "en", "bad") for i in range(60)]
    rows += [(None, plain("n"), None, None), (None, plain("n"), None, None), (None, None, "en", "good"), (7, plain("other"), "en", "good"), (300, "", "en", "good"), (301, f"{plain('l')} {item} {plain('m')}", "en", "good")]
    rows += [(302, plain("secret") + " password = hunter2hunter2", "en", "good"), (303, plain("long ") * 4000, "en", "good"), (304, plain("x1y"), "en", "good")]
    table = spark.createDataFrame([(*r, len(r[1] or ""), "h", "k", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, hash string, kept string, row int")
    table.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i < 60)) for i in [*range(40), *range(100, 140)]], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item), (None, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, stage in p.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path)).cache()
        assert docs.columns == table.columns, name
        seen.append(sorted(((r.doc_id, r.text) for r in docs.collect()), key=repr))
    good = {(r.doc_id, r.keep) for r in quality.op2_empirical_bayes(spark, str(tmp_path)).collect()}
    assert {i for i, _ in seen[0]} == {i for i, keep in good if keep} and not any(i in range(100, 160) for i, _ in seen[0] if i is not None)
    ids = [i for i, _ in seen[1]]
    assert ids.count(7) == 2 and 304 not in ids and [t for i, t in seen[1] if i is None].count(plain("n")) == 1  # rows are told apart by id and text
    assert [r for r in seen[1] if r not in seen[2]] == [(301, rows[-4][1])]
    assert dict(seen[3])[302].endswith("[SECRET]")
    found = p.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id for r in found if r.piece == 0), key=repr) == sorted((i for i, _ in seen[3]), key=repr)
    empty = str(tmp_path / "empty")
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(str(tmp_path / f"{name}.parquet")).limit(0).write.parquet(f"{empty}/{name}.parquet")
    assert p.run(spark, empty).count() == 0
