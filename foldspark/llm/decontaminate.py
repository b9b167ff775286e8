"""Benchmark decontamination: BM25 over an inverted index of test items, with block-max WAND.

Each document is cut into overlapping passages that cover the whole text. A passage is a query; the index holds the
test items, its posting lists cut into blocks with the largest impact of each. Terms that a passage shares with no item
cost nothing, and where the block maxima of a passage's terms cannot reach the threshold, no posting of the block is
touched. Passages overlap so that an item is whole in one of them. All items at or over the threshold are retrieved; then question and answer are aligned with the passage's neighbourhood,
and either part alone is enough if it is long. An item's threshold is never over what a text that passes the alignment
scores at least, so retrieval loses none.

An item's question is its text up to its last sentence, its answer the last sentence. An item of one sentence is all
question. The threshold is a share of the item's own score, or less where a part alone or fewer words are enough.
"""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldspark.llm.common import cut, sized
from foldspark.llm.words import U, batches_of_words, mix

K1, B = 1.2, 0.75
#: Postings of a block; items and words of one index (about, or one item), and indexes that one pass over the documents holds.
BLOCK, ITEMS, WORDS, INDEXES = 16, 2048, 1 << 18, 8
#: Words up to which items share the first class of lengths; each further class has items up to four times as long.
SHORT = 128
#: Retrieved: share of the item's own score. Verified: share of a part's words left by the fewest edits that make it a run of the text's words, or of its 5-grams found, and distinct 5-grams that a part needs to count alone.
RETRIEVE, OVERLAP, ALONE = 0.6, 0.8, 8
GRAM = 5
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def _grams(words: np.ndarray, k: int = GRAM) -> np.ndarray:
    """One hash for each run of ``k`` words, in order; of fewer words, one for all of them."""
    k = min(k, len(words))
    if not k:
        return words
    g = words[: len(words) - k + 1]
    for j in range(1, k):
        g = mix(g * U(0x9FB21C651E98DF25) + words[j : len(words) - k + 1 + j])
    return g


def _spare(n: int) -> int:
    """Edits that ``n`` words may have."""
    return n - math.ceil(OVERLAP * n - 1e-9)


def _lost(words: np.ndarray, own: dict[int, float]) -> float:
    """No less than the score that ``words`` can lose with their spare edits: each costs a word, the dearest ones first."""
    left, lost = _spare(len(words)), 0.0
    for x, n in sorted(((own[t] / n, n) for t, n in Counter(words.tolist()).items()), reverse=True):
        lost, left = lost + x * min(n, left), left - min(n, left)
    return lost


def aligned(part: np.ndarray, words: np.ndarray) -> float:
    """Share of ``part``'s words left by the fewest edits (a word changed, left out or put in) that make it a run of ``words``."""
    if not len(part):
        return 0.0
    at = np.arange(len(words) + 1)
    edits = np.zeros(len(words) + 1, dtype=np.int64)
    for i, w in enumerate(part):
        new = edits + 1
        np.minimum(new[1:], edits[:-1] + (words != w), out=new[1:])
        edits = np.minimum.accumulate(new - at) + at
    return (len(part) - int(edits.min())) / len(part)


def question_answer(text: str) -> tuple[str, str]:
    parts = _SENTENCE.split(text.strip())
    return (" ".join(parts[:-1]), parts[-1]) if len(parts) > 1 else (text, "")


class Index:
    """Items (id, text) by term. Items without words are left out."""

    def __init__(self, items: list[tuple[int, str | None]]) -> None:
        parts = [(i, *question_answer(t or "")) for i, t in items]
        words = [[self._words(p) for p in (q, a)] for _, q, a in parts]
        keep = [n for n, (q, a) in enumerate(words) if len(q) + len(a)]
        every = {n: np.concatenate(words[n]) for n in keep}
        long = {n: [len(np.unique(_grams(p))) >= ALONE for p in words[n]] for n in keep}
        mean = sum(map(len, every.values())) / len(every) if every else 1.0
        counts = {n: Counter(w.tolist()) for n, w in every.items()}
        df = Counter(t for c in counts.values() for t in c)
        impacts, least = {}, {}
        for n, c in counts.items():
            norm = K1 * (1 - B + B * len(every[n]) / mean)
            own = {t: math.log(1 + (len(every) - df[t] + 0.5) / (df[t] + 0.5)) * tf * (K1 + 1) / (tf + norm) for t, tf in c.items()}
            # impacts as shares of what the item needs: a score of 1 retrieves, whatever the item
            need = RETRIEVE * sum(own.values())
            impacts[n] = {t: x / need for t, x in own.items()}
            enough = [every[n], *(p for p, alone in zip(words[n], long[n], strict=True) if alone)]
            least[n] = min(1.0, *((sum(own[t] for t in set(p.tolist())) - _lost(p, own)) / need for p in enough))
        keep.sort(key=lambda n: (least[n], len(every[n])))  # a block's items need about as much, so that one item's need does not open it for all
        self.ids = [parts[n][0] for n in keep]
        self.parts = [words[n] for n in keep]
        self.long = [long[n] for n in keep]
        self.length = np.array([len(every[n]) for n in keep], dtype=np.int64)
        rows = [(t, d, x) for d, n in enumerate(keep) for t, x in impacts[n].items()]
        #: What an item needs of a score: 1, or less where a verified text can have less.
        self.least = np.array([least[n] for n in keep])
        self.terms = np.sort(np.array(list(df), dtype=U))
        term = np.searchsorted(self.terms, np.array([r[0] for r in rows], dtype=U))
        item = np.array([r[1] for r in rows], dtype=np.int64)
        impact = np.array([r[2] for r in rows])
        self.n_blocks = -(-len(keep) // BLOCK)
        self.most = np.zeros((len(self.terms), self.n_blocks), dtype=np.float32)  # the block maxima, a little above
        np.maximum.at(self.most, (term, item // BLOCK), impact * 1.00001)
        order = np.lexsort((item, term))
        posting = np.bincount(term * self.n_blocks + item // BLOCK, minlength=len(self.terms) * self.n_blocks)
        self.posting_start = np.concatenate(([0], np.cumsum(posting)))  # of each term and block
        self.posting_item, self.posting_impact = (item % BLOCK)[order], impact[order]
        longest = int(self.length.max(initial=2))
        longest += _spare(longest)  # words may be put in
        self.step, self.window = max(1, longest // 2), longest + max(1, longest // 2)
        self.filter = np.zeros(1 << 20, dtype=bool)
        self.filter[(self.terms >> U(44)).astype(np.int64)] = True

    @staticmethod
    def _words(text: str) -> np.ndarray:
        return next((h for _, _, h, _ in batches_of_words(pa.array([text]))), np.zeros(0, U))

    def _shared(self, words: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first word of each passage, passage, term): the distinct terms that passages of consecutive texts share with any item."""
        maybe = np.flatnonzero(self.filter[(words >> U(44)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.terms, words[maybe]), max(0, len(self.terms) - 1))
        hit = self.terms[at] == words[maybe] if len(self.terms) else np.zeros(0, bool)
        place, term = maybe[hit], at[hit]
        each = np.maximum(1, -(-(np.diff(n) - (self.window - self.step)) // self.step))  # passages of each text
        before = np.concatenate(([0], np.cumsum(each)))
        text = np.searchsorted(n, place, "right") - 1
        within = place - n[text]
        last = np.minimum(within // self.step, each[text] - 1)
        first = np.maximum(0, -(-(within - self.window + 1) // self.step))
        times = last - first + 1
        passage = np.repeat(before[text] + first - np.cumsum(times) + times, times) + np.arange(times.sum())
        key = np.unique(passage * max(1, len(self.terms)) + np.repeat(term, times))
        starts = np.repeat(n[:-1] - before[:-1] * self.step, each) + np.arange(before[-1]) * self.step
        return starts, key // max(1, len(self.terms)), key % max(1, len(self.terms))

    def retrieve(self, words: np.ndarray, n: np.ndarray, least: np.ndarray | None = None) -> Iterator[tuple[int, int]]:
        """(first word of a passage, item): every item whose score reaches ``least``, or 1, for a passage.

        A passage goes into a block of items only if the block's maxima of its terms add up to the least of the block.
        """
        need = np.full(self.n_blocks * BLOCK, np.inf)
        need[: len(self.length)] = 1 if least is None else least
        needs = need.reshape(-1, BLOCK).min(axis=1) if len(need) else need
        starts, passage, term = self._shared(words, n)
        if not len(passage):
            return
        begin = np.flatnonzero(np.concatenate(([True], passage[1:] != passage[:-1])))
        end = np.append(begin[1:], len(passage))
        for a in range(0, len(begin), 4096):
            b = min(a + 4096, len(begin))
            bound = np.add.reduceat(self.most[term[begin[a] : end[b - 1]]], begin[a:b] - begin[a], axis=0)
            row, block = np.nonzero(bound >= needs)
            if not len(row):
                continue
            row += a
            count = end[row] - begin[row]
            pair = np.repeat(np.arange(len(row)), count)
            at = np.repeat(begin[row] - np.cumsum(count) + count, count) + np.arange(count.sum())
            key = term[at] * self.n_blocks + block[pair]
            low = self.posting_start[key]
            size = self.posting_start[key + 1] - low
            post = np.repeat(low - np.cumsum(size) + size, size) + np.arange(size.sum())
            score = np.bincount(np.repeat(pair, size) * BLOCK + self.posting_item[post], self.posting_impact[post], len(row) * BLOCK)
            for x in np.flatnonzero(score >= need.reshape(-1, BLOCK)[block].ravel() - 1e-9):
                yield int(starts[passage[begin[row[x // BLOCK]]]]), int(block[x // BLOCK] * BLOCK + x % BLOCK)

    def overlap(self, item: int, words: np.ndarray) -> tuple[float, float]:
        """Of question and answer, the share of the words that align with a run of ``words``, or of the 5-grams that are there if that is more: a long insertion costs these least."""
        out = []
        for part in self.parts[item]:
            grams = float(np.isin(np.unique(_grams(part)), _grams(words, min(GRAM, len(part)))).mean()) if len(part) else 0.0
            out.append(grams if grams == 1 else max(grams, aligned(part, words)))
        return out[0], out[1]

    def _can_hold(self, item: int, words: np.ndarray) -> bool:
        """Whether ``words`` hold as many of the words of the item, or of a long part, as alignment asks: far cheaper than to align."""
        there = [np.isin(p, words) for p in self.parts[item]]
        return any(len(x) - int(x.sum()) <= _spare(len(x)) for x in (np.concatenate(there), *(x for x, long in zip(there, self.long[item], strict=True) if long)))

    def leaks(self, words: np.ndarray, n: np.ndarray) -> list[tuple[int, int, float, float]]:
        """(text, item, question overlap, answer overlap) of the items that consecutive texts hold; text i's words are words[n[i]:n[i + 1]]."""
        best: dict[tuple[int, int], tuple[float, float]] = {}
        for start, item in self.retrieve(words, n, self.least):
            text = int(np.searchsorted(n, start, "right")) - 1
            near = words[max(n[text], start - self.step) : min(n[text + 1], start + self.window + self.step)]
            if not self._can_hold(item, near):
                continue
            q, a = self.overlap(item, near)
            if (q, a) > best.get((text, item), (-1.0, -1.0)) and (self._verified(item, q, a) or aligned(np.concatenate(self.parts[item]), near) >= OVERLAP):
                best[text, item] = (q, a)
        return [(*k, *best[k]) for k in sorted(best)]

    def _verified(self, item: int, q: float, a: float) -> bool:
        question, answer = self.long[item]
        if q >= OVERLAP and (a >= OVERLAP or not len(self.parts[item][1]) or question):
            return True
        return a >= OVERLAP and answer


def _indexes(benchmark: DataFrame) -> Iterator[Index]:
    """Indexes that together hold all items, each with items of one class of lengths, so that its passages fit them, and bounded in items and words."""
    n_words = F.size(F.split(F.trim("text"), r"\s+"))
    length = F.when(n_words <= SHORT, 0).otherwise(F.ceil(F.log(4.0, n_words / SHORT))).cast("int")
    items = benchmark.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").withColumn("length", length)
    for c in items.groupBy("length").agg(F.count(F.lit(1)).alias("n"), F.sum(n_words).alias("words")).orderBy("length").collect():  # a row for each class
        n = max(math.ceil(c.n / ITEMS), math.ceil(c.words / WORDS))
        own = items.where(F.col("length") == c.length)
        for p in range(n):
            yield Index([(r.item_id, r.text) for r in (own if n == 1 else own.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == p)).toLocalIterator()])


_FOUND = "doc_id long, text_hash long, item_id long, question_overlap double, answer_overlap double"


def _leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``leaks`` with the text's hash: a row is known by its id, which may be null or repeated, and its text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("item_id", pa.int64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64())])
    out, indexes = docs.sparkSession.createDataFrame([], _FOUND), _indexes(benchmark)
    while some := list(itertools.islice(indexes, INDEXES)):
        shared = docs.sparkSession.sparkContext.broadcast(some)

        def find(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, texts, found = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
                for a, _, hashes, n in batches_of_words(batch.column(2)):
                    found += [(ids[a + i], texts[a + i], index.ids[k], q, r) for index in shared.value for i, k, q, r in index.leaks(hashes, n)]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), schema.types, strict=True)], schema=schema)

        out = out.unionByName(rows.mapInArrow(find, _FOUND))
    return out


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, question_overlap, answer_overlap): the items that each whole text holds, once each.

    Null and empty texts and items, of any length, hold and match nothing; null ids stay null; repeated rows and items
    give repeated results; without documents or items there are none. Other columns are left alone.
    """
    return _leaks(docs, benchmark).drop("text_hash")


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows that hold an item, and no others: a row is known by its id and text."""
    found = cut(_leaks(docs, benchmark).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct(), "leaks")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc"), F.xxhash64("text").alias("hash"))
    return rows.join(sized(found), F.col("doc").eqNullSafe(F.col("_id")) & (F.col("hash") == F.col("_hash")), "left_anti").select("row.*")


def op5_block_max_wand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every test item that a document holds."""
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {"op5_block_max_wand": op5_block_max_wand}
SQL: dict[str, str] = {}
