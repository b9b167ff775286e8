"""Quality classifier with hierarchical empirical Bayes over hosts and paths.

A logistic model of byte-class shares gives each document its evidence. Sums of the documents' probabilities, grouped
by host and by path, become posteriors that shrink towards the level above (path to host, host to the whole corpus),
the more the fewer documents a site has; how much follows from the variance between and within sites. A document's
evidence is combined with its path's posterior, so that a borderline page of a good site is kept and one of a bad site
is not.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from foldspark.llm.common import cut, sized
from foldspark.llm.words import batches_of_words, slices, text_bytes

#: Labelled rows that the model is fitted to at most, those with the smallest hashes of their ids.
MAX_LABELLED = 20_000
#: Bytes counted apart: upper case, digits, space, line feed, end marks, bang, bar, symbols, brackets, not ASCII.
_CLASSES = [range(65, 91), range(48, 58), b" ", b"\n", b".,;:?", b"!", b"|", b"#$%&*@^~+", b"<>{}[]()\\/=_\"", range(128, 256)]
N_FEATURES = len(_CLASSES) + 3
_CLASS_OF = np.zeros(256, dtype=np.uint8)
for _n, _bytes in enumerate(_CLASSES, 1):
    _CLASS_OF[list(_bytes)] = _n


def features(column: pa.Array) -> np.ndarray:
    """A row for each text: shares of the byte classes, of words that repeat the one before, bytes a word, and the length's logarithm. Zeros for null and empty texts."""
    offsets, data = text_bytes(column)
    n = np.diff(offsets)
    out = np.zeros((len(n), N_FEATURES))
    for a, b in slices(offsets):  # a few MB of text at a time
        kind, own = _CLASS_OF[data[offsets[a] : offsets[b]]], offsets[a : b + 1] - offsets[a]
        upto = np.zeros(len(kind) + 1, dtype=np.int32)
        for c in range(1, len(_CLASSES) + 1):
            np.cumsum(kind == c, out=upto[1:], dtype=np.int32)
            out[a:b, c - 1] = np.diff(upto[own]) / np.maximum(n[a:b], 1)
    for a, b, words, first in batches_of_words(column):
        same = np.zeros(len(words) + 1, dtype=np.int64)
        np.cumsum(words[1:] == words[:-1], out=same[1 : len(words)])
        ends = np.maximum(first[1:] - 1, first[:-1])
        out[a:b, -3] = (same[ends] - same[first[:-1]]) / np.maximum(np.diff(first), 1)
    gaps = out[:, 2] + out[:, 3]
    out[:, -2] = np.where(n > 0, np.minimum(1 / np.maximum(gaps, 0.02), 50) / 50, 0)
    out[:, -1] = np.log1p(n) / 10
    return out


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> tuple[np.ndarray, float]:
    """Weights and intercept of a logistic model by Newton's steps. With labels of one kind only: no weights."""
    rate = (y.sum() + 0.5) / (len(y) + 1)
    if len(set(y.tolist())) < 2:
        return np.zeros(x.shape[1]), float(np.log(rate / (1 - rate))) if len(y) else 0.0
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    penalty = np.full(z.shape[1], ridge)
    penalty[-1] = 0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty + 1e-9), z.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1] / scale, float(w[-1] - (w[:-1] * mean / scale).sum())


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> tuple[np.ndarray, float]:
    """The document model from ``labels`` (doc_id, quality 0 or 1). Several labels of a document count by majority, null ones not at all."""
    chosen = (
        labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.avg("quality") >= 0.5).cast("double").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    )
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("hash"), "text").join(F.broadcast(cut(chosen, "quality-labels")), "doc_id").select("doc_id", "hash", "label", "text")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = features(b.column(3))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), N_FEATURES).cast(pa.list_(pa.float64()))], names=["doc_id", "hash", "label", "x"])

    # one row for each labelled id, however many carry it: that of the smallest hash
    each = known.mapInArrow(rows, "doc_id long, hash long, label double, x array<double>").groupBy("doc_id").agg(F.min_by(F.struct("label", "x"), "hash").alias("r"))
    table = each.select("r.*").orderBy("doc_id").toPandas()
    return fit(np.array(table["x"].tolist()).reshape(-1, N_FEATURES), table["label"].to_numpy(float))


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.ln(p / (1 - p))


def _shrink(rows: DataFrame, n: str, s: str) -> float:
    """Documents that the level above counts for: variance within sites over variance between them (one-way analysis of variance)."""
    r = rows.agg(F.sum(n).alias("n"), F.sum(s).alias("s"), F.sum("s2").alias("s2"), F.sum(F.col(s) * F.col(s) / F.col(n)).alias("b"), F.sum(F.col(n).cast("double") * F.col(n)).alias("nn"), F.count(F.lit(1)).alias("h")).first()
    if not r.n or r.h < 2 or r.n <= r.h:
        return 1e6
    within = max(r.s2 - r.b, 0.0) / (r.n - r.h)
    between = (r.b - r.s * r.s / r.n - (r.h - 1) * within) / max(r.n - r.nn / r.n, 1e-9)
    return float(min(max(within / between, 1.0), 1e6)) if between > 1e-12 else 1e6


_ADDED = ("_evidence", "_host_rate", "_path_rate", "_posterior")


def _scored(docs: DataFrame, labels: DataFrame, host: str, path: str, max_labelled: int, kept: list[str]) -> DataFrame:
    """(row, evidence, host_rate, path_rate, posterior), row being a struct of the columns ``kept``: no name of theirs can clash."""
    weights, bias = train(docs, labels, max_labelled)
    h, p = F.coalesce(F.col(host).cast("string"), F.lit("")), F.coalesce(F.col(path).cast("string"), F.lit(""))
    rows = docs.select(F.struct(*kept).alias("row"), h.alias("h"), p.alias("p"), *([] if "text" in kept else ["text"]))

    def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = b.column("row").field("text") if "text" in kept else b.column("text")
            z = features(text) @ weights + bias
            empty = np.array([not t for t in _text_sizes(text)], dtype=bool)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))), mask=empty)], names=["row", "h", "p", "evidence"])

    scored = rows.mapInArrow(evidence, StructType([*rows.schema.fields[:3], StructField("evidence", DoubleType())]))
    if "text" not in kept:
        scored = cut(scored, "quality-evidence")
    paths = cut(scored.groupBy("h", "p").agg(F.count("evidence").alias("n"), F.coalesce(F.sum("evidence"), F.lit(0.0)).alias("s"), F.coalesce(F.sum(F.col("evidence") * F.col("evidence")), F.lit(0.0)).alias("s2")), "quality-paths")
    some = paths.where("n > 0")
    hosts = some.groupBy("h").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"), F.sum("s2").alias("s2"))
    total = some.agg(F.sum("s") / F.sum("n")).first()[0]
    rate = 0.5 if total is None else float(total)
    to_all, to_host = _shrink(hosts, "hn", "hs"), _shrink(some, "n", "s")
    sites = paths.join(hosts.drop("s2"), "h", "left").withColumn("host_rate", (F.coalesce("hs", F.lit(0.0)) + to_all * rate) / (F.coalesce("hn", F.lit(0)) + to_all))
    sites = cut(sites.select("h", "p", "host_rate", ((F.col("s") + to_host * F.col("host_rate")) / (F.col("n") + to_host)).alias("path_rate")), "quality-sites")
    weight = F.when(F.col("evidence").isNotNull(), _logit(F.col("evidence")) - _logit(F.lit(rate))).otherwise(0.0)  # least and greatest pass over nulls
    posterior = weight + _logit(F.col("path_rate"))
    return scored.join(sized(sites), ["h", "p"]).select("row", "evidence", "host_rate", "path_rate", (1 / (1 + F.exp(-posterior))).alias("posterior"))


def score(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", max_labelled: int = MAX_LABELLED, keep: list[str] | None = None) -> DataFrame:
    """``docs``, or its columns ``keep``, with _evidence (the model's probability), _host_rate, _path_rate and _posterior.

    Null hosts and paths are sites of their own. A null or empty text is no evidence: its posterior is its path's rate;
    a text of any length is one document. Repeated rows count each time. Without labels every probability is a half; an
    empty table gives an empty result. Columns of ``docs`` that are named like the four are replaced, all others kept.
    Where ``keep`` leaves the text out, the evidence is stored, and texts are read once for it.
    """
    kept = [c for c in (docs.columns if keep is None else keep) if c not in _ADDED]
    found = _scored(docs, labels, host, path, max_labelled, kept)
    return found.select("row.*", *(F.col(c[1:]).alias(c) for c in _ADDED))


def _text_sizes(column: pa.Array) -> list[int]:
    """Bytes of each text, 0 for null."""
    return np.diff(text_bytes(column)[0]).tolist()


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.5, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """The rows of ``docs`` whose posterior is at least ``least``, with all their columns."""
    return _scored(docs, labels, "source", "lang", max_labelled, docs.columns).where(F.col("posterior") >= least).select("row.*")


def op2_empirical_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence, site rates, posterior and decision for every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    found = score(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), keep=["doc_id"])
    return found.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("_evidence").alias("evidence"), F.col("_host_rate").alias("host_rate"), F.col("_path_rate").alias("path_rate"),
        F.col("_posterior").alias("posterior"), (F.col("_posterior") >= 0.5).alias("keep"),
    )


QUERIES = {"op2_empirical_bayes": op2_empirical_bayes}
SQL: dict[str, str] = {}
