"""N-gram Jaccard join by PartEnum signatures.

Sets whose sizes fall into the same or neighbouring bands and whose Jaccard similarity reaches the threshold differ in
at most k elements, k following from the bands. The feature domain is hashed into groups of three partitions, so many
groups that one of them must hold at most one of k differences; then two of its three partitions are equal, and the
signature that enumerates those two is shared. No similar pair is missed, whatever the data.

Sets that share a signature form a bucket. A bucket is not expanded into pairs: each member is held against the
bucket's PIVOTS smallest sets, and links found so become components. Where members of a bucket are still in different
components, they are joined exactly by their rarest shingles with positions (no similar pair of sets can lack a shared
shingle there) and by parities of their elements, which bound how far two sets are apart before anything of theirs is
fetched; again every candidate is verified on whole sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foldspark.llm.common import cut, sized
from foldspark.llm.components import components
from foldspark.llm.words import U, batches_of_words, mix, shingles


#: Sets of a bucket that its other members are held against.
PIVOTS = 2


class PartEnum:
    """Signatures for Jaccard similarity num/den."""

    def __init__(self, num: int, den: int, largest: int = 1 << 40) -> None:
        self.num, self.den = num, den
        self._spare: dict[int, int] = {}
        ends = [0]
        while ends[-1] < largest:
            ends.append(max(ends[-1] + 1, (ends[-1] + 1) * den // num))
        self.ends = np.array(ends)  # band i holds sizes ends[i - 1] + 1 to ends[i]

    def differences(self, instance: int) -> int:
        """Elements that a similar pair can differ in, both in band instance - 1 or one in it and one in band ``instance``."""
        return int((self.ends[instance - 1] + self.ends[instance]) * (self.den - self.num) // (self.den + self.num))

    def spare(self, instance: int) -> int:
        """Groups beyond the k // 2 + 1 that are needed: as many as make signatures fewest, those of sets with more empty pairs included."""
        needed, least = self.differences(instance) // 2 + 1, int(self.ends[max(0, instance - 2)]) + 1

        def cost(spare: int) -> float:
            groups = needed + spare
            mean = groups * 3 * math.exp(-2 * least / (3 * groups))  # groups with a pair of empty partitions
            term = within = math.exp(-mean)
            for i in range(1, spare + 1):
                term *= mean / i
                within += term
            return groups * (2 - within)

        return min(range(12 + needed // 8), key=cost)

    def _enumerate(self, s: np.ndarray, instance: int, seed: int, spare: int) -> tuple[np.ndarray, np.ndarray]:
        """(signatures, which of them stand for two empty partitions), a row for each way to choose two of three."""
        groups = self.differences(instance) // 2 + 1 + spare
        h = mix(s + U(seed))
        parts = np.zeros(3 * groups, dtype=U)
        np.add.at(parts, (h % U(3 * groups)).astype(np.int64), mix(h + U(1)))
        parts = parts.reshape(groups, 3)
        label = mix(np.arange(groups, dtype=U) * U(64) + U(instance * 2**32 + seed))
        both = [(parts[:, a] * U(0x9FB21C651E98DF25) + mix(parts[:, b] + U(17 * a + b)), (parts[:, a] == 0) & (parts[:, b] == 0)) for a, b in ((0, 1), (0, 2), (1, 2))]
        return np.array([mix(x + label) for x, _ in both]), np.array([e for _, e in both])

    def signatures(self, s: np.ndarray) -> np.ndarray:
        """Of a set of distinct hashes.

        A similar pair agrees on two partitions in at least 1 + spare groups. If one of the sets has empty pairs in no
        more than ``spare`` groups, the two agree on a pair that is not empty, so empty pairs, which unlike sets share
        too, give no signature. Sets with more of them also get a second, independent enumeration, shared by them alone.
        """
        band = int(np.searchsorted(self.ends, len(s)))
        out = []
        for instance in (band, band + 1):
            if self.differences(instance) == 0:
                out.append(mix(mix(s).sum(keepdims=True) + U(instance)))
                continue
            if instance not in self._spare:
                self._spare[instance] = self.spare(instance)
            spare = self._spare[instance]
            found, empty = self._enumerate(s, instance, 1, spare)
            out.append(found[~empty])
            if empty.any(axis=0).sum() > spare:
                out.append(self._enumerate(s, instance, 2, 0)[0].ravel())
        return np.concatenate(out)


def _set_id(s: np.ndarray) -> int:
    return int(mix(mix(s + U(5)).sum(keepdims=True) * U(7) + U(len(s))).view(np.int64)[0])


def _sets(column: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray]]:
    for a, b, hashes, n in batches_of_words(column):
        for i in range(a, b):
            yield i, shingles(hashes[n[i - a] : n[i - a + 1]], k)


def _rows(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, text): what tells rows apart is both the id, which may be null or repeated, and the text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")


def set_table(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, text_hash, n_shingles, set_id) of each row; equal sets have equal ids (64-bit digests), rows without words have none."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, ids = [0] * batch.num_rows, [None] * batch.num_rows
            for i, s in _sets(batch.column(2), k):
                if len(s):
                    n[i], ids[i] = len(s), _set_id(s)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(ids, pa.int64())], names=["doc_id", "text_hash", "n_shingles", "set_id"])

    return _rows(docs).mapInArrow(rows, "doc_id long, text_hash long, n_shingles long, set_id long")


def _signature_rows(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(sig, set_id); a task gives each set's signatures once, however many copies it reads."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enum, seen = PartEnum(num, den), set()
        for batch in batches:
            sigs, ids, size = [], [], 0
            for _, s in _sets(batch.column(0), k):
                if not len(s) or (i := _set_id(s)) in seen:
                    continue
                seen.add(i)
                sigs.append(enum.signatures(s))
                ids.append(i)
                size += len(sigs[-1])
                if size > 200_000:
                    yield _two(sigs, ids)
                    sigs, ids, size = [], [], 0
            if sigs:
                yield _two(sigs, ids)

    return docs.select("text").mapInArrow(rows, "sig long, set_id long")


def _two(sigs: list[np.ndarray], ids: list[int]) -> pa.RecordBatch:
    each = np.fromiter(map(len, sigs), np.int64, len(sigs))
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs).view(np.int64)), pa.array(np.repeat(np.array(ids, np.int64), each))], names=["sig", "set_id"])


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (sig, set_id): each bucket's PIVOTS smallest sets beside each larger member. One bucket's pivots are kept between batches."""
    sig, pivots, last = None, np.zeros(0, np.int64), None
    for batch in batches:
        if not batch.num_rows:
            continue
        s, i = (batch.column(n).to_numpy() for n in ("sig", "set_id"))
        own = np.ones(len(s), dtype=bool)  # a set that several tasks have seen comes again
        own[1:] = (s[1:] != s[:-1]) | (i[1:] != i[:-1])
        own[0] = last != (s[0], i[0])
        last, s, i = (s[-1], i[-1]), s[own], i[own]
        if not len(s):
            continue
        old = len(pivots) if s[0] == sig else 0
        s, i = np.concatenate((np.full(old, s[0]), s)), np.concatenate((pivots[:old], i))
        at = np.arange(len(s))
        new = np.concatenate(([True], s[1:] != s[:-1]))
        first = np.maximum.accumulate(np.where(new, at, 0))
        sig, pivots = s[-1], i[first[-1] : first[-1] + PIVOTS]
        rows = [np.flatnonzero((at >= old) & (at - first > p)) for p in range(PIVOTS)]
        if len(rows[0]):
            a = np.concatenate([i[first[r] + p] for p, r in enumerate(rows)])
            r = np.concatenate(rows)
            yield pa.RecordBatch.from_arrays([pa.array(s[r]), pa.array(a), pa.array(i[r])], names=["bucket", "a", "b"])


def stars(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(bucket, a, b): a is one of the bucket's PIVOTS smallest sets, b each larger one."""
    return _signature_rows(docs, k, num, den).repartition("sig").sortWithinPartitions("sig", "set_id").mapInArrow(_stars, "bucket long, a long, b long")


def parity(e: np.ndarray) -> np.ndarray:
    """Which of 512 to 4096 bits, more for larger sets, an odd number of elements fall on, as 64-bit words.

    Elements that two sets share cancel out, so their parities differ in no more bits than the sets do in elements. The
    longer of two parities folds to the length of the shorter by the exclusive or of its halves.
    """
    words = 8
    while words < 64 and words * 64 < len(e):
        words *= 2
    odd = np.bincount((mix(e + U(11)) % U(64 * words)).astype(np.int64), minlength=64 * words) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _apart(x: Column, y: Column) -> Column:
    """Bits in which two parities differ."""

    def folded(p: Column) -> Column:
        half = F.least(F.size(x), F.size(y))
        return F.when(F.size(p) > half, F.zip_with(F.slice(p, 1, half), F.slice(p, half + 1, half), lambda a, b: a.bitwiseXOR(b))).otherwise(p)

    return F.aggregate(F.zip_with(folded(x), folded(y), lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda n, m: n + m)


def _can_be_similar(x: str, y: str, num: int, den: int) -> Column:
    """What the sizes n<x>, n<y> and the parities bits<x>, bits<y> of two sets leave open: similar sets are no more than a share of both apart."""
    nx, ny = F.col(f"n{x}"), F.col(f"n{y}")
    return (nx * den >= ny * num) & (ny * den >= nx * num) & (_apart(F.col(f"bits{x}"), F.col(f"bits{y}")) * (num + den) <= (nx + ny) * (den - num))


def elements(docs: DataFrame, table: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """(id, n, bits, elements): the shingles of each set in ``ids``, and their parities, worked out from one document that has it."""
    one = table.join(sized(ids.withColumnRenamed("id", "set_id")), "set_id", "left_semi").groupBy("set_id").agg(F.min(F.struct("doc_id", "text_hash")).alias("r"))
    wanted = cut(one.select("r.*").distinct(), "join-wanted")
    texts = _rows(docs).join(sized(wanted.toDF("_id", "_hash")), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left_semi").select("text")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                found = [(_set_id(s), len(s), parity(s), s.tobytes()) for _, s in _sets(batch.column(0).slice(at, 256), k) if len(s)]
                if found:
                    i, n, bits, e = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(n, pa.int64()), pa.array(bits, pa.list_(pa.int64())), pa.array(e, pa.binary())], names=["id", "n", "bits", "elements"])

    return texts.mapInArrow(rows, "id long, n long, bits array<long>, elements binary").dropDuplicates(["id"])


def verify(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) with den * intersection >= num * union. Only for pairs that sizes and parities leave open are elements fetched."""
    left = sets.select(F.col("id").alias("a"), F.col("elements").alias("ea"))
    right = sets.select(F.col("id").alias("b"), F.col("elements").alias("eb"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, dtype=bool)
            for r, (x, y) in enumerate(zip(batch.column("ea"), batch.column("eb"), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
                if den * min(len(x), len(y)) < num * max(len(x), len(y)):
                    continue
                both = np.sort(np.concatenate((x, y)))
                shared = int((both[1:] == both[:-1]).sum())
                keep[r] = den * shared >= num * (len(both) - shared)
            out = batch.filter(pa.array(keep))
            if out.num_rows:
                yield pa.RecordBatch.from_arrays([out.column("a"), out.column("b")], names=["a", "b"])

    x, y = (sets.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"), F.col("bits").alias(f"bits{c}")) for c in "ab")
    close = pairs.join(x, "a").join(y, "b").where(_can_be_similar("a", "b", num, den)).select("a", "b")
    return close.join(left, "a").join(right, "b").select("a", "b", "ea", "eb").mapInArrow(check, "a long, b long")


def contested_pairs(sets: DataFrame, labels: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b): all pairs of ``sets`` in different components that can be similar by their rarest shingles, their places and their parities.

    Shingles are ordered by how many of ``sets`` hold them. Similar sets share one of their first n - ceil(n * num / den) + 1;
    shingles that one set alone holds take places but need no row. At each shingle only sets outside its commonest
    component are held against others, and the join gives out only pairs whose parities differ in no more bits than
    similar sets can in elements: in a group of near copies that are not similar, hardly any.
    """

    def unfold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                e = [np.frombuffer(x.as_buffer(), np.int64) for x in part.column("elements")]
                if e:
                    n = part.column("n").to_numpy()
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(e)), pa.array(np.repeat(part.column("id").to_numpy(), n)), pa.array(np.repeat(n, n))], names=["e", "id", "n"])

    # shingles that many sets hold are met by aggregates and joins, which Spark splits, not by windows
    every = sets.select("id", "n", "elements").mapInArrow(unfold, "e long, id long, n long")
    held = every.join(every.groupBy("e").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "e")
    own = Window.partitionBy("id")
    placed = held.withColumn("at", F.col("n") - F.count(F.lit(1)).over(own) + F.row_number().over(own.orderBy("c", "e")) - 1)
    first = placed.where(F.col("at") < F.col("n") - F.ceil(F.col("n") * num / den) + 1).select("e", "id", "n", "at")
    rows = cut(first.join(labels, "id", "left").withColumn("root", F.coalesce("root", "id")), "join-prefixes")
    roots = rows.groupBy("e", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("e").agg(F.max_by("root", F.struct("n", "root")).alias("most"), F.count(F.lit(1)).alias("roots")).where("roots > 1").drop("roots")
    rows = rows.join(roots, "e").join(sets.select("id", "bits"), "id")
    rows = cut(rows, "join-apart")
    x, y = (rows.select("e", *(F.col(c).alias(c + s) for c in ("id", "n", "at", "root", "bits")), *extra) for s, extra in (("x", ["most"]), ("y", [])))
    can = 1 + F.least(F.col("nx") - 1 - F.col("atx"), F.col("ny") - 1 - F.col("aty"))
    similar = (
        (F.col("rootx") != F.col("rooty")) & ((F.col("idx") < F.col("idy")) | (F.col("rooty") == F.col("most")))
        & (can * (num + den) >= (F.col("nx") + F.col("ny")) * num) & _can_be_similar("x", "y", num, den)
    )
    return x.where("rootx <> most").join(y, "e").where(similar).select(F.least("idx", "idy").alias("a"), F.greatest("idx", "idy").alias("b")).distinct()


def jaccard_rows(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, text_hash, n_shingles, root, component_id) of each row of ``docs`` (doc_id, text): see ``jaccard_components``.

    ``root`` tells components apart where ids are null or repeated; it is null for rows without words.
    """
    docs = docs.select("doc_id", "text")
    table = cut(set_table(docs, k), "join-sets")
    star = cut(stars(docs, k, num, den), "join-stars")
    pairs = cut(star.select("a", "b").distinct(), "join-pairs")
    ids = lambda p: p.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    sets = cut(elements(docs, table, ids(pairs), k), "join-elements")
    links = cut(verify(pairs, sets, num, den), "join-links")
    labels = components(links)
    root = lambda c: labels.select(F.col("id").alias(c), F.col("root").alias(f"root_{c}"))
    held = star.join(root("a"), "a", "left").join(root("b"), "b", "left").select("bucket", "a", "b", F.coalesce("root_a", "a").alias("ra"), F.coalesce("root_b", "b").alias("rb"))
    # a bucket of PIVOTS + 1 sets is settled by its pairs; larger ones are contested unless all their members are in one component
    settled = PIVOTS * (PIVOTS + 1) // 2
    open_ = held.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("ra") != F.col("rb")).alias("apart")).where((F.col("n") > settled) & F.col("apart")).select("bucket")
    contested = cut(ids(star.join(open_, "bucket", "left_semi")), "join-contested")
    rest = cut(sets.join(sized(contested), "id", "left_semi"), "join-rest")
    more = cut(contested_pairs(rest, labels, num, den), "join-more")
    links = links.unionByName(cut(verify(more, rest, num, den), "join-links"))
    labels = components(links)
    own = table.where("set_id is not null").groupBy(F.col("set_id").alias("id")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("rows"))
    shared = own.join(labels, "id", "left").where("rows > 1 or root is not null").select("id", "doc_id", F.coalesce("root", "id").alias("root"))
    shared = cut(shared, "join-shared")
    least = shared.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    member = cut(shared.join(least, "root").select(F.col("id").alias("set_id"), "root", "component_id"), "join-members")
    return table.join(sized(member), "set_id", "left").select("doc_id", "text_hash", "n_shingles", F.coalesce("root", "set_id").alias("root"), F.coalesce("component_id", "doc_id").alias("component_id"))


def jaccard_components(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of ``docs`` (doc_id, text).

    Rows whose sets of k-word shingles are similar (den * intersection >= num * union) are linked; component_id is the
    smallest doc_id reachable. Null and empty texts and texts without words are linked with nothing. Repeated rows and
    equal sets are one component. A null doc_id counts as larger than any other; a component of such rows alone has a
    null component_id. Texts of any length are one set. An empty table gives an empty result.
    """
    return jaccard_rows(docs, k, num, den).select("doc_id", "n_shingles", "component_id")


def keep_one(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` with one row of each component: the one with the smallest doc_id, null ids last, then the smallest hash of its text.

    Rows are told apart by id and text; of rows that repeat both, one stays. Rows without words stay, all of them.
    """
    found = cut(jaccard_rows(docs, k, num, den).where("root is not null").select("root", F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")), "join-result")
    place = F.struct(F.col("_id").isNull().alias("last"), "_id", "_hash")
    groups = found.groupBy("root").agg(F.count(F.lit(1)).alias("rows"), F.min(place).alias("kept")).where("rows > 1")
    copies = cut(found.join(sized(groups), "root").select("_id", "_hash", (place == F.col("kept")).alias("kept")).distinct(), "join-copies")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc"), F.xxhash64("text").alias("hash"))
    marked = rows.join(sized(copies), F.col("doc").eqNullSafe(F.col("_id")) & (F.col("hash") == F.col("_hash")), "left")
    return marked.where("kept is null").unionByName(marked.where("kept").dropDuplicates(["_id", "_hash"])).select("row.*")


def op4_partenum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents over 4-word shingles at 85 hundredths."""
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), 4, 85, 100)


_SHINGLED = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
      ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' '))) END AS s FROM w),
"""
SQL: dict[str, str] = {
    "op4_partenum": f"""{_SHINGLED.replace("WITH w", "WITH RECURSIVE w", 1)}
e AS (SELECT doc_id, unnest(s) AS e FROM s),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM e x JOIN e y ON x.e = y.e AND x.doc_id <> y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b WHERE 100 * n >= 85 * (len(x.s) + len(y.s) - n)),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, least(doc_id, coalesce((SELECT min(b) FROM reach WHERE a = doc_id), doc_id)) AS component_id FROM s
""",
}
QUERIES = {"op4_partenum": op4_partenum}
