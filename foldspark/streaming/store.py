"""States of projections in buckets by key, written as changes: a batch writes the rows that it changed, and no others."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from foldspark.sources.tables import sized

#: A version: batch, edit by hand within the batch.
Version = tuple[int, int]


@dataclass
class _Bucket:
    """The folders that a bucket is read from, oldest first: its last whole copy, and what changed since."""

    folders: list[str] = field(default_factory=list)
    whole: int = 0
    changes: int = 0


class SnapshotStore:
    """States in ``path``/name, for each projection a folder for each version: ``v=batch.edit`` with changes, ``v=batch.edit.full`` with all rows.

    Rows (key, exists, fields) lie in ``buckets`` by the hash of their key. A version has, of each bucket that it
    touches, either the rows that changed (``part=n-delta``, where a row that is gone has ``exists`` false) or the whole
    bucket (``part=n-full``). Readers take the newest row of each key, and of a bucket only what follows its last whole
    copy; a lookup reads one bucket. A bucket is written whole again by the next version once ``max_deltas`` have piled
    up on it, or more bytes than twice its own. A version counts when Spark has finished it. What the version before the
    newest batch does not need any more is removed.
    """

    #: Bytes of changes from which their size is compared with the bucket's.
    LEAST = 1 << 20

    def __init__(self, spark: SparkSession, path: str, buckets: int = 32, max_deltas: int = 8) -> None:
        self.spark, self.path, self.n_buckets, self.max_deltas = spark, path.rstrip("/"), buckets, max_deltas
        self._jvm = spark._jvm.org.apache.hadoop.fs
        self._fs = self._jvm.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    # what there is

    def _glob(self, pattern: str) -> list[tuple[list[str], int]]:
        """(last four parts of the path, bytes) of what matches."""
        found = self._fs.globStatus(self._jvm.Path(f"{self.path}/{pattern}")) or []
        return [(s.getPath().toString().split("/")[-4:], s.getLen()) for s in found]

    @staticmethod
    def _version(folder: str) -> Version:
        batch, edit, *_ = folder.removeprefix("v=").split(".")
        return int(batch), int(edit)

    def _finished(self, name: str) -> dict[Version, str]:
        """Folders of finished versions, in order."""
        return dict(sorted((self._version(p[-2]), p[-2]) for p, _ in self._glob(f"{name}/v=*/_SUCCESS")))

    def versions(self, name: str) -> list[Version]:
        """(batch, edit) of the finished versions, in order."""
        return list(self._finished(name))

    def batches(self, name: str) -> list[int]:
        return sorted({n for n, _ in self.versions(name)})

    def _about(self, name: str) -> dict | None:
        path = self._jvm.Path(f"{self.path}/{name}/about.json")
        if not self._fs.exists(path):
            return None
        stream = self._fs.open(path)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _live(self, name: str, finished: dict[Version, str], upto: Version) -> dict[int, _Bucket]:
        known = {v: f for v, f in finished.items() if v <= upto}
        last_full = max((v for v, f in known.items() if f.endswith(".full")), default=(-1, 0))
        out: dict[int, _Bucket] = {}
        files = sorted(((self._version(p[1]), p[1], p[2], size) for p, size in self._glob(f"{name}/v=*/part=*/*.parquet")), key=lambda x: x[:3])
        for version, folder, part, size in files:
            if version not in known or known[version] != folder or version < last_full:
                continue
            n, kind = part.removeprefix("part=").split("-")
            bucket, path = out.setdefault(int(n), _Bucket()), f"{self.path}/{name}/{folder}/{part}"
            if path not in bucket.folders:
                if kind == "full":
                    bucket.folders, bucket.whole, bucket.changes = [], 0, 0
                bucket.folders.append(path)
            if kind == "full":
                bucket.whole += size
            else:
                bucket.changes += size
        return out

    # reading

    def read(self, name: str, before: int | None = None, keys: DataFrame | None = None) -> DataFrame | None:
        """(key, fields) as the newest version has them, or the newest before batch ``before``; None if there is none.

        With ``keys`` (a column ``key``) only those rows, from the buckets that can hold them.
        """
        finished, about = self._finished(name), self._about(name)
        known = [v for v in finished if before is None or v[0] < before]
        if not known or about is None:
            return None
        live = self._live(name, finished, known[-1])
        if keys is not None:
            wanted = {r[0] for r in keys.select(self._bucket(about).alias("b")).distinct().collect()}
            live = {n: b for n, b in live.items() if n in wanted}
        rows = self._rows(about, live)
        if keys is not None:
            own = keys.select(F.col("key").alias("_key")).distinct()
            rows = rows.join(sized(own), F.col("key").eqNullSafe(F.col("_key")), "left_semi")
        return rows

    def _rows(self, about: dict, live: dict[int, _Bucket]) -> DataFrame:
        public = StructType.fromJson(about["schema"])
        folders = [f for b in live.values() for f in b.folders]
        if not folders:
            return self.spark.createDataFrame([], public)
        stored = StructType.fromJson(about["schema"]).add("exists", "boolean").add("_batch", "long").add("_edit", "integer")
        rows = self.spark.read.schema(stored).parquet(*folders)
        if any(len(b.folders) > 1 for b in live.values()):
            others = [c for c in stored.names if c not in ("key", "_batch", "_edit")]
            rows = rows.groupBy("key").agg(F.max_by(F.struct(*others), F.struct("_batch", "_edit")).alias("r")).select("key", "r.*")
        return rows.where("exists").select(*public.names)

    @staticmethod
    def _bucket(about: dict) -> Column:
        kind = StructType.fromJson(about["schema"])["key"].dataType
        return F.pmod(F.xxhash64(F.col("key").cast(kind)), F.lit(about["buckets"])).cast("int")

    def find(self, name: str, key: object) -> Row | None:
        """The row of ``key``, or None: one bucket is read, and the filter reaches the scan."""
        about = self._about(name)
        if about is None:
            return None
        one = self.spark.range(1).select(F.lit(key).cast(StructType.fromJson(about["schema"])["key"].dataType).alias("key"))
        n = one.select(self._bucket(about)).first()[0]
        finished = self._finished(name)
        live = self._live(name, finished, next(reversed(finished))) if finished else {}
        rows = self._rows(about, {n: live[n]} if n in live else {})
        return next(iter(rows.where(F.col("key").eqNullSafe(F.lit(key))).take(1)), None)

    def count(self, name: str) -> int:
        state = self.read(name)
        return 0 if state is None else state.count()

    # writing

    def _begin(self, name: str, schema: StructType) -> dict:
        """What is known of the rows; the number of buckets stays as it was at first."""
        about = self._about(name)
        fields = StructType([f for f in schema if f.name != "exists"]).jsonValue()
        if about is None or about["schema"] != fields:
            about = {"buckets": self.n_buckets if about is None else about["buckets"], "schema": fields}
            stream = self._fs.create(self._jvm.Path(f"{self.path}/{name}/about.json"), True)
            try:
                stream.write(bytearray(json.dumps(about).encode()))
            finally:
                stream.close()
        return about

    def _put(self, name: str, version: Version, rows: DataFrame, about: dict, kind: Column, whole: bool = False) -> None:
        """Write a version; rows meet by bucket, so each bucket is one file."""
        n = self._bucket(about)
        stored = rows.withColumns({"_batch": F.lit(version[0]).cast("long"), "_edit": F.lit(version[1]).cast("int"), "part": F.concat(n.cast("string"), F.lit("-"), kind)})
        folder = f"{self.path}/{name}/v={version[0]}.{version[1]}" + (".full" if whole else "")
        stored.repartition("part").write.mode("overwrite").partitionBy("part").parquet(folder)
        self._sweep(name, version)

    def _sweep(self, name: str, version: Version) -> None:
        """Remove what no version from the one before this batch on reads."""
        finished = self._finished(name)
        earlier = [v for v in finished if v[0] < version[0]]
        if not earlier:
            return
        needed = {f for v in (earlier[-1], *(v for v in finished if v[0] >= version[0])) for b in self._live(name, finished, v).values() for f in b.folders}
        parts = self._glob(f"{name}/v=*/part=*")
        for p, _ in parts:
            if self._version(p[2]) < earlier[-1] and f"{self.path}/{name}/{p[2]}/{p[3]}" not in needed:
                self._fs.delete(self._jvm.Path(f"{self.path}/{name}/{p[2]}/{p[3]}"), True)
        left = {f.split("/")[-2] for f in needed}
        for v, folder in finished.items():
            if v < earlier[-1] and folder not in left:
                self._fs.delete(self._jvm.Path(f"{self.path}/{name}/{folder}"), True)

    def _forget(self, name: str, batch_id: int) -> None:
        for p, _ in self._glob(f"{name}/v={batch_id}.*"):
            self._fs.delete(self._jvm.Path(f"{self.path}/{name}/{p[-1]}"), True)

    def write(self, name: str, batch_id: int, state: DataFrame) -> None:
        """The whole state after a batch. A batch that runs again replaces what it wrote before, and edits of that."""
        self._forget(name, batch_id)
        about = self._begin(name, state.schema)
        self._put(name, (batch_id, 0), state.withColumn("exists", F.lit(True)), about, F.lit("full"), whole=True)

    def apply(self, name: str, batch_id: int, changes: DataFrame) -> None:
        """What a batch changed: (key, exists, fields), a row for each key. A batch that runs again replaces what it wrote before."""
        self._forget(name, batch_id)
        self._change(name, (batch_id, 0), changes)

    def _change(self, name: str, version: Version, changes: DataFrame) -> None:
        about, finished = self._begin(name, changes.schema), self._finished(name)
        live = self._live(name, finished, next(reversed(finished))) if finished else {}
        due = {n: b for n, b in live.items() if len(b.folders) > self.max_deltas or b.changes > max(self.LEAST, 2 * b.whole)}
        kind, rows = F.lit("delta"), changes
        if due:
            n = self._bucket(about)
            changed = changes.where(n.isin(list(due)))
            rest = self._rows(about, due).join(changed.select(F.col("key").alias("_key")), F.col("key").eqNullSafe(F.col("_key")), "left_anti")
            rows = changes.unionByName(rest.withColumn("exists", F.lit(True)))
            kind = F.when(n.isin(list(due)), "full").otherwise("delta")
        self._put(name, version, rows, about, kind)

    def _edit(self, name: str, changes: DataFrame) -> None:
        batch, edit = next(reversed(self.versions(name)), (0, 0))
        self._change(name, (batch, edit + 1), changes)

    def add_range(self, name: str, rows: DataFrame) -> None:
        """Add rows (key and fields); a key that is there is an error, as is one that comes twice."""
        there = self.read(name, keys=rows.select("key"))
        every = rows.select("key") if there is None else there.select("key").unionByName(rows.select("key"))
        if every.groupBy("key").count().where("count > 1").limit(1).count():
            raise ValueError("a key is there already, or comes twice")
        self._edit(name, rows.withColumn("exists", F.lit(True)))

    def remove_range(self, name: str, keys: DataFrame) -> None:
        """Remove the rows whose key is in column ``key`` of ``keys``; keys that are not there do no harm."""
        there = self.read(name, keys=keys.select("key"))
        if there is not None:
            fields = [F.col("key"), *(F.lit(None).cast(f.dataType).alias(f.name) for f in there.schema if f.name != "key")]
            self._edit(name, there.select(*fields, F.lit(False).alias("exists")))

    def remove_by_key(self, name: str, key: object) -> None:
        about = self._about(name)
        if about is not None and self.find(name, key) is not None:
            kind = StructType.fromJson(about["schema"])["key"].dataType
            self.remove_range(name, self.spark.range(1).select(F.lit(key).cast(kind).alias("key")))

    def clear(self, name: str | None = None) -> None:
        """Remove one projection's versions, or all."""
        self._fs.delete(self._jvm.Path(self.path if name is None else f"{self.path}/{name}"), True)
