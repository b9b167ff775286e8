"""Audit of how sources of a language diverge in their terms, with counts prefiltered by a sketch.

A first pass counts, in how many documents each term occurs, into count-min sketches, a task each; they are merged and
never underestimate, so a term of which any cell stays below the least number of documents cannot be kept and is left
out of the second pass before anything is shuffled. Survivors are counted exactly by language, source and term. Sums
over all kept terms for a pair of sources are then worked out from the terms that occur: for those that one source lacks,
by a histogram of the other's probabilities; for those that both have, by a join of the sparse counts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foldspark.llm.common import cut, sized
from foldspark.llm.words import U, mix, slices, text_bytes, word_hashes

#: Rows of a sketch, cells that are given out together, and limits of a row's cells (a bit a cell is broadcast: at most 32 MB in all).
DEPTH, CELLS, WIDTHS = 4, 1 << 16, (1 << 16, 1 << 26)
MIN_DOCS, TOP, SCALE = 10, 10, 1_000_000_000
#: Bytes of text whose terms are counted at once; a longer text is a slice of its own.
SLICE = 1 << 21
#: A seed for each row of a sketch.
_ROWS = mix(np.arange(1, DEPTH + 1, dtype=U) * U(0xD1342543DE82EF95))
_TERM = np.zeros(256, dtype=bool)
_TERM[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def terms_of(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(text, place in the dictionary) of each term of consecutive texts, and the dictionary: letters and what is not ASCII, A-Z lower-cased."""
    mask = _TERM[data]
    first, last = mask.copy(), mask.copy()
    first[1:] &= ~mask[:-1]
    last[:-1] &= ~mask[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    first[edges] = mask[edges]
    last[edges - 1] = mask[edges - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    ends = np.concatenate(([0], np.cumsum(end - start)))
    packed = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(_LOWER[data[mask]])])
    found = packed.dictionary_encode()
    return np.searchsorted(offsets, start, "right") - 1, found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary


def _names(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    found = pc.fill_null(column, "").dictionary_encode()
    return found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary


def counted(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
    """Of runs of whole documents: (document's row, term, occurrences) of each term in each document, and the terms."""
    offsets, data = text_bytes(batch.column("text"))
    for a, b in slices(offsets, SLICE):
        own = offsets[a : b + 1]
        row, code, dictionary = terms_of(own - own[0], data[own[0] : own[-1]])
        n = max(1, len(dictionary))
        each, times = np.unique(row * n + code, return_counts=True)
        yield a + each // n, each % n, times, dictionary


def cells_of(dictionary: pa.Array, term: np.ndarray, langs: pa.Array, lang: np.ndarray, width: int) -> np.ndarray:
    """(depth, pairs): the cell of each (language, term) in each row of a sketch of ``width`` cells, a power of two."""
    dictionary = dictionary.cast(pa.large_binary())
    offsets = np.frombuffer(dictionary.buffers()[1], np.int64)[dictionary.offset : dictionary.offset + len(dictionary) + 1]
    data = np.frombuffer(dictionary.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    hashes, _ = word_hashes(offsets - offsets[0], data)  # a term has no white space, so it is one word
    seeds = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in langs.to_pylist()], dtype=U)
    x = mix(hashes[term] + mix(seeds[lang]))
    return np.stack([mix(x + seed) & U(width - 1) for seed in _ROWS]).astype(np.int64)


def _by_language(batch: pa.RecordBatch) -> Iterator[tuple]:
    """(languages, dictionary, language, term, documents) of runs of documents."""
    lang, langs = _names(batch.column("lang"))
    for row, term, _, dictionary in counted(batch):
        n = max(1, len(dictionary))
        pair, docs = np.unique(lang[row] * n + term, return_counts=True)
        yield langs, dictionary, pair // n, pair % n, docs


def _sketch(width: int, most: int):
    """One sketch a task, cells stopped at ``most``, given out as the cells that are not 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros((DEPTH, width), np.min_scalar_type(most))
        for b in batches:
            for langs, dictionary, lang, term, docs in _by_language(b):
                for r, cells in enumerate(cells_of(dictionary, term, langs, lang, width)):
                    at, inverse = np.unique(cells, return_inverse=True)
                    more = np.bincount(inverse, weights=docs, minlength=len(at)) if len(at) else np.zeros(0)
                    sketch[r, at] = np.minimum(sketch[r, at] + more, most)
        size = min(CELLS, width)
        for n, block in enumerate(sketch.reshape(-1, size)):
            at = np.flatnonzero(block)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), pa.array([at.astype(np.uint16).tobytes()], pa.binary()), pa.array([block[at].tobytes()], pa.binary())], names=["block", "at", "n"])

    return run


def _merge(width: int, most: int):
    """Blocks of all sketches, added up: a bit a cell that says whether it reaches ``most``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, np.ndarray] = {}
        for b in batches:
            for block, at, n in zip(*(b.column(x).to_pylist() for x in ("block", "at", "n")), strict=True):
                own = blocks.setdefault(block, np.zeros(min(CELLS, width), np.int64))
                own[np.frombuffer(at, np.uint16)] += np.frombuffer(n, np.min_scalar_type(most))
        for block, own in blocks.items():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([np.packbits(own >= most).tobytes()], pa.binary())], names=["block", "bits"])

    return run


def _width(rows: int) -> int:
    """Cells of a sketch's row: four for each document, within ``WIDTHS``; a power of two."""
    return min(WIDTHS[1], max(WIDTHS[0], 1 << max(0, 4 * rows - 1).bit_length()))


def frequent_cells(docs: DataFrame, min_docs: int, width: int) -> np.ndarray:
    """(depth, width / 8): the bits of the merged sketch's cells that reach ``min_docs``."""
    tasks = docs.select("text", "lang").mapInArrow(_sketch(width, min_docs), "block int, at binary, n binary")
    found = tasks.repartition("block").mapInArrow(_merge(width, min_docs), "block int, bits binary").collect()
    size = min(CELLS, width) // 8
    bits = np.zeros((DEPTH * width // (8 * size), size), np.uint8)
    for r in found:
        bits[r.block] = np.frombuffer(r.bits, np.uint8)
    return bits.reshape(DEPTH, -1)


def _exact(bits: np.ndarray, width: int):
    """(lang, source, term, n, docs) sums of runs of documents for the terms that can be kept; a row without a term for each (lang, source)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["lang", "source", "term", "n", "docs"]
        for b in batches:
            if not b.num_rows:
                continue
            (lang, langs), (source, sources) = _names(b.column("lang")), _names(b.column("source"))
            groups, group = np.unique(lang * len(sources) + source, return_inverse=True)
            of_lang, of_source = groups // len(sources), groups % len(sources)
            none = np.zeros(len(groups), np.int64)
            yield pa.RecordBatch.from_arrays([langs.take(pa.array(of_lang)), sources.take(pa.array(of_source)), pa.nulls(len(groups), pa.string()), pa.array(none), pa.array(none)], names=names)
            for row, term, times, dictionary in counted(b):
                n = max(1, len(dictionary))
                pair, at = np.unique(lang[row] * n + term, return_inverse=True)
                may = np.ones(len(pair), bool)
                for r, cells in enumerate(cells_of(dictionary, pair % n, langs, pair // n, width)):
                    may &= (bits[r, cells >> 3] >> (7 - (cells & 7)).astype(np.uint8)) & 1 == 1
                stays = may[at]
                both, inverse, docs = np.unique(group[row[stays]] * n + term[stays], return_inverse=True, return_counts=True)
                total = np.bincount(inverse, weights=times[stays], minlength=len(both)).astype(np.int64) if len(both) else np.zeros(0, np.int64)
                g = both // n
                yield pa.RecordBatch.from_arrays(
                    [langs.take(pa.array(of_lang[g])), sources.take(pa.array(of_source[g])), dictionary.take(pa.array(both % n)).cast(pa.string()), pa.array(total), pa.array(docs.astype(np.int64))], names=names
                )

    return run


def term_counts(docs: DataFrame, min_docs: int = MIN_DOCS, width: int | None = None) -> DataFrame:
    """(lang, source, term, n, docs): exact occurrences and documents of the terms that the sketch cannot rule out, and a row with a null term for each (lang, source)."""
    own = docs.select(*(F.col(c).cast("string").alias(c) for c in ("text", "lang", "source")))
    width = width or _width(docs.count())
    rows = own.mapInArrow(_exact(frequent_cells(own, min_docs, width), width), "lang string, source string, term string, n long, docs long")
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _p(n: str, total: str, terms: str) -> str:
    """SQL of 1 + floor(SCALE * (n + 2) / (total + 2 * terms)), in whole numbers."""
    return f"(1 + (cast({SCALE} as decimal(10, 0)) * cast({n} + 2 as decimal(20, 0))) div cast({total} + 2 * {terms} as decimal(20, 0)))"


def _f(p: str, q: str) -> str:
    """SQL of floor((p - q)^2 / (p + q)); both are at most SCALE + 1, so 64 bits hold it."""
    return f"((({p}) - ({q})) * (({p}) - ({q})) div (({p}) + ({q})))"


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, width: int | None = None) -> DataFrame:
    """(lang, source, part, item, value, rank): each source's distance to the others of its language, and the terms that it uses more than its language does.

    ``docs`` has text, lang and source (nulls are empty; other columns are left alone). A language keeps the terms that
    at least ``min_docs`` of its documents hold. Part ``pair`` has every other source of the language, also for sources
    without terms, and value 0 where the language keeps none; part ``term`` the ``top`` kept terms by their share of the
    distance to the language. Ties go by the item's bytes. Repeated rows are rows like others; an empty table gives an
    empty result. ``width`` is the cells of a sketch's row, a power of two; the result does not depend on it.
    """
    counts = cut(term_counts(docs, min_docs, width), "divergence-counts")
    terms = counts.where("term is not null").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n")).where(F.col("docs") >= min_docs)
    kept = cut(counts.where("term is not null").join(terms.drop("docs"), ["lang", "term"]).select("lang", "source", "term", "n", "lang_n"), "divergence-kept")
    # a row for each language, and one for each (lang, source)
    langs = kept.select("lang", "term", "lang_n").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("lang_n").alias("lang_total"))
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("own"))
    groups = counts.select("lang", "source").distinct().join(sized(sums), ["lang", "source"], "left").join(sized(langs), "lang", "left")
    groups = groups.select("lang", "source", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "own", "v", "lang_total")))
    groups = cut(groups.withColumn("p0", F.expr(f"case when v > 0 then {_p('0', 'total', 'v')} end")), "divergence-groups")
    rows = kept.join(sized(groups), ["lang", "source"]).withColumn("p", F.expr(_p("n", "total", "v")))
    rows = cut(rows.withColumn("q", F.expr(_p("lang_n", "lang_total", "v"))).select("lang", "source", "term", "p", "q", "p0"), "divergence-shares")

    a = groups.select("lang", F.col("source").alias("a"), F.col("p0").alias("pa0"), F.col("own").alias("own_a"), "v")
    b = groups.select("lang", F.col("source").alias("b"), F.col("p0").alias("pb0"), F.col("own").alias("own_b"))
    # as if no term were in both: what neither has, and what each has that the other is held to lack ...
    neither = a.join(b, "lang").where("a < b").select("lang", "a", "b", F.expr(f"case when v > 0 then (v - own_a - own_b) * {_f('pa0', 'pb0')} else 0 end").alias("value"))
    histogram = rows.groupBy("lang", F.col("source").alias("a"), "p").agg(F.count(F.lit(1)).alias("m"))
    alone = histogram.join(sized(b), "lang").where("a <> b").select("lang", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.expr(f"m * {_f('p', 'pb0')}").alias("value"))
    # ... set right for those that are in both: sparse counts, a row for each source that has the term
    left = rows.select("lang", "term", F.col("source").alias("a"), F.col("p").alias("pa"), F.col("p0").alias("pa0"))
    right = rows.select("lang", "term", F.col("source").alias("b"), F.col("p").alias("pb"), F.col("p0").alias("pb0"))
    both = left.join(right, ["lang", "term"]).where("a < b").select("lang", "a", "b", F.expr(f"{_f('pa', 'pb')} - {_f('pa', 'pb0')} - {_f('pa0', 'pb')} + {_f('pa0', 'pb0')}").alias("value"))
    pairs = neither.unionByName(alone.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))).unionByName(both.groupBy("lang", "a", "b").agg(F.sum("value").alias("value")))
    pairs = pairs.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    ways = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    pairs = pairs.select("lang", "value", ways.alias("way")).select("lang", "way.source", F.lit("pair").alias("part"), "way.item", "value")
    more = rows.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr(_f("p", "q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).cast("int")
    return pairs.withColumn("rank", rank).unionByName(more.withColumn("rank", rank).where(F.col("rank") <= top))


def op13_sketch_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of all ``documents``. Odd rows: see ``audit``."""
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op13_sketch_counts": op13_sketch_counts}
SQL = {
    "op13_sketch_counts": r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms, row_number() OVER () AS n FROM documents),
t AS (SELECT n, lang, source, unnest(terms) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM t GROUP BY ALL HAVING count(DISTINCT t.n) >= 10),
l AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL),
s AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS total FROM g LEFT JOIN c ON c.lang = g.lang AND c.source = g.source GROUP BY ALL),
p AS (SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n, CAST(1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 2) // (s.total + 2 * l.v) AS HUGEINT) AS p,
        CAST(1 + 1000000000::HUGEINT * (k.n + 2) // (l.total + 2 * l.v) AS HUGEINT) AS q
      FROM s JOIN l ON l.lang = s.lang JOIN kept k ON k.lang = s.lang LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms) QUALIFY part = 'pair' OR rank <= 10
""",
}
