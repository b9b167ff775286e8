import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from foldspark.llm import quality

GOOD, BAD = "This is a plain sentence, and another one follows it here. It ends.", "BUY!! NOW!! ### $$$ CHEAP!! *** %%%"


def tables(spark):
    rows = [(i, f"{BAD if i % 4 == 0 or (i % 10 == 7) else GOOD} {i}", "en", f"h{i % 10}", 1.0) for i in range(400)]
    rows += [(1000, None, None, None, None), (1001, "", "en", "new", 1.0), (1002, GOOD, "en", "h7", 0.0), (1002, GOOD, "en", "h7", 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, posterior double")
    labels = spark.createDataFrame([(i, int(BAD not in t), None) for i, t, *_ in rows[:200]] + [(3, None, None), (None, 1, None)], "doc_id long, quality int, text string")
    return docs, labels


def test_scores_and_sites(spark):
    docs, labels = tables(spark)
    found = {r.doc_id: r for r in quality.score(docs, labels).collect()}
    assert len(found) == 403 and quality.score(docs, labels).count() == 404
    for i in range(400):
        assert (found[i]._posterior >= 0.5) == (i % 4 != 0 and i % 10 != 7)
    assert found[7]._path_rate < 0.5 < found[1]._path_rate  # a bad site and a good one
    total = np.mean([r._evidence for r in found.values() if r._evidence is not None])
    assert abs(found[1001]._path_rate - total) < 0.05 and found[1001]._evidence is None  # a new site is like the whole
    assert found[1000]._posterior > 0
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} >= {1, 2, 3}


def test_matches_brute_force(spark, tmp_path):
    """The query on a table with nulls, repeated rows and labels, ties, a very long text; sites by loops over rows."""
    docs, labels = tables(spark)
    docs = docs.drop("posterior").unionByName(spark.createDataFrame([(None, GOOD, "en", "h1"), (2000, GOOD * 20_000, None, "h2"), (2001, BAD, "de", "h2")], "doc_id long, text string, lang string, source string"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    rows = docs.collect()
    said = {}
    for r in labels.collect():
        if r.doc_id is not None and r.quality is not None:
            said.setdefault(r.doc_id, []).append(r.quality)
    x = quality.features(pa.array([r.text for r in rows], pa.string()))
    known = [n for n, r in enumerate(rows) if r.doc_id in said]
    w, bias = quality.fit(x[known], np.array([float(np.mean(said[rows[n].doc_id]) >= 0.5) for n in known]))
    logit = lambda p: np.log(min(max(p, 1e-6), 1 - 1e-6) / (1 - min(max(p, 1e-6), 1 - 1e-6)))
    evidence = [1 / (1 + np.exp(-np.clip(x[n] @ w + bias, -30, 30))) if r.text else None for n, r in enumerate(rows)]
    sites = {}
    for r, e in zip(rows, evidence, strict=True):
        sites.setdefault((r.source or "", r.lang or ""), []).extend([] if e is None else [e])
    hosts = {h: [e for (g, _), es in sites.items() if g == h for e in es] for h, _ in sites}

    def shrink(groups):
        groups = [g for g in groups if g]
        every = [e for g in groups for e in g]
        within = sum((e - np.mean(g)) ** 2 for g in groups for e in g) / (len(every) - len(groups))
        between = (sum(len(g) * (np.mean(g) - np.mean(every)) ** 2 for g in groups) - (len(groups) - 1) * within) / (len(every) - sum(len(g) ** 2 for g in groups) / len(every))
        return min(max(within / between, 1.0), 1e6) if between > 1e-12 else 1e6

    rate = np.mean([e for e in evidence if e is not None])
    to_all, to_host = shrink(hosts.values()), shrink(sites.values())
    want = []
    for r, e in zip(rows, evidence, strict=True):
        h, own = hosts[r.source or ""], sites[r.source or "", r.lang or ""]
        host_rate = (sum(h) + to_all * rate) / (len(h) + to_all)
        path_rate = (sum(own) + to_host * host_rate) / (len(own) + to_host)
        posterior = 1 / (1 + np.exp(-((0 if e is None else logit(e) - logit(rate)) + logit(path_rate))))
        want.append((r.doc_id, e, host_rate, path_rate, posterior, posterior >= 0.5))
    found = quality.op2_empirical_bayes(spark, str(tmp_path)).collect()
    clean = lambda rs: sorted((tuple(None if v is None else round(float(v), 6) for v in r) for r in rs), key=repr)
    assert clean(found) == clean(want)


def test_names_may_clash_and_ids_repeat(spark):
    docs, labels = tables(spark)
    clash = docs.withColumns({"_evidence": docs.doc_id, "row": docs.lang, "h": docs.lang, "evidence": docs.source, "_host": docs.lang})
    kept = quality.keep_good(clash, labels)
    assert kept.columns == clash.columns and kept.where("_evidence <> doc_id").count() == 0
    assert kept.count() == quality.keep_good(docs, labels).count()
    assert [c for c in quality.score(clash, labels).columns if c == "_evidence"] == ["_evidence"]
    many = docs.unionByName(docs.where("doc_id = 5").withColumn("posterior", F.explode(F.array_repeat(F.lit(1.0), 500))))
    assert np.allclose(quality.train(many, labels)[0], quality.train(docs, labels)[0])


def test_without_labels_or_rows(spark):
    docs, labels = tables(spark)
    assert {round(r._evidence, 6) for r in quality.score(docs, labels.limit(0)).where("_evidence is not null").collect()} == {0.5}
    assert quality.score(docs.limit(0), labels).count() == 0


def test_features():
    x = quality.features(pa.array([None, "", "AB cd!! !!", "For For For", "é"]))
    assert not x[:2].any() and x[2, 0] == 0.2 and x[2, 5] == 0.4 and x[3, -3] == 2 / 3 and x[4, 9] == 1


def test_fit_separates():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 3))
    y = (x @ [2, -1, 0] + 0.3 > 0).astype(float)
    w, b = quality.fit(x, y)
    assert (((x @ w + b) > 0) == y).mean() > 0.97
