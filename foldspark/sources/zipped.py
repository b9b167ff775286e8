"""JSON lines in zips, as a data source for batches and streams, and a writer of such zips."""

from __future__ import annotations

import fnmatch
import io
import posixpath
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

#: Bytes of an entry, unpacked, that one task gives out; it skips what lies before. Lines given out together.
SPAN, BATCH = 256 << 20, 4096
LINES = "path string, line bigint, text string"


@dataclass
class Span(InputPartition):
    """The lines of a zip's entry that begin from byte ``begin`` to before ``end``."""

    path: str
    begin: int
    end: int


def _system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path there."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _files(path: str) -> list[tuple[str, int]]:
    """(path, time of change) of the zips at ``path``, in order of path: a zip, a folder, or a folder with a pattern of names, in any file system that Arrow opens."""
    folder, _, pattern = path.rpartition("/")
    named = any(c in pattern for c in "*?[")
    system, inner = _system(folder if named else path)
    if named:
        found = [f for f in system.get_file_info(fs.FileSelector(inner, allow_not_found=True)) if fnmatch.fnmatchcase(f.base_name, pattern)]
    else:
        info = system.get_file_info(inner)
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(inner, allow_not_found=True))
    return sorted((f.path, f.mtime_ns or 0) for f in found if f.type == fs.FileType.File and f.path.endswith(".zip"))


def _open(path: str, root: str) -> tuple[zipfile.ZipFile, str | None]:
    """The zip and the name of its first JSON entry."""
    packed = zipfile.ZipFile(_system(root.rpartition("/")[0] or root)[0].open_input_file(path))
    return packed, next((n for n in packed.namelist() if n.endswith(".json")), None)


def _spans(paths: list[str], root: str, span: int) -> list[Span]:
    """Sizes come from the zips' directories; nothing is unpacked."""
    out = []
    for path in paths:
        packed, name = _open(path, root)
        with packed:
            size = packed.getinfo(name).file_size if name else 0
        out += [Span(path, at, min(at + span, size)) for at in range(0, size, span)]
    return out


def _read(span: Span, root: str) -> Iterator[pa.RecordBatch]:
    """The entry is unpacked as a stream; of the lines before the span only the number is kept."""
    packed, name = _open(span.path, root)
    with packed, packed.open(name) as entry:
        at = line = 0
        held: list[tuple[str, int, str]] = []
        for raw in entry:
            begins = at
            at += len(raw)
            if begins >= span.end:
                break
            text = raw.strip()
            if begins == 0 and text.startswith(b"\xef\xbb\xbf"):
                text = text[3:].strip()
            if not text:
                continue
            if begins >= span.begin:
                held.append((span.path, line, text.decode("utf-8")))
                if len(held) == BATCH:
                    yield _batch(held)
                    held = []
            line += 1
        if held:
            yield _batch(held)


def _batch(rows: list[tuple[str, int, str]]) -> pa.RecordBatch:
    path, line, text = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(path, pa.string()), pa.array(line, pa.int64()), pa.array(text, pa.string())], names=["path", "line", "text"])


class ZippedLines(DataSource):
    """``zipped_lines``: (path, line, text) of the first ``*.json`` entry of each zip at ``path``; blank lines do not count. ``span``: bytes of an entry for each task.

    As a stream it gives each zip once, in order of time and path.
    """

    @classmethod
    def name(cls) -> str:
        return "zipped_lines"

    def schema(self) -> str:
        return LINES

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Batch(self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Stream(self.options)


class _Batch(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.root, self.span = options["path"], int(options.get("span", SPAN))

    def partitions(self) -> list[Span]:
        return _spans([p for p, _ in _files(self.root)], self.root, self.span)

    def read(self, partition: Span | None) -> Iterator[pa.RecordBatch]:
        return iter(()) if partition is None else _read(partition, self.root)  # none: there are no zips


class _Stream(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.root, self.span = options["path"], int(options.get("span", SPAN))

    def initialOffset(self) -> dict:
        return {"time": -1, "path": ""}

    def _in_order(self) -> list[tuple[int, str]]:
        return sorted((t, p) for p, t in _files(self.root))

    def latestOffset(self) -> dict:
        time, path = max(self._in_order(), default=(-1, ""))
        return {"time": time, "path": path}

    def partitions(self, start: dict, end: dict) -> list[Span]:
        place = lambda offset: (offset["time"], offset["path"])
        return _spans([p for t, p in self._in_order() if place(start) < (t, p) <= place(end)], self.root, self.span)

    def read(self, partition: Span | None) -> Iterator[pa.RecordBatch]:
        return iter(()) if partition is None else _read(partition, self.root)  # none: there are no zips

    def commit(self, end: dict) -> None:
        pass


def write_zips(rows: DataFrame, path: str, file: str, order: str, text: str) -> DataFrame:
    """Write column ``text`` of ``rows`` as zips at ``path``, one for each value of ``file`` (a number), lines in ``order``; gives (name, lines) of each, and writes when that is read.

    A task writes its zips whole under their final names, so one that runs again writes the same.
    """
    out = pa.schema([("name", pa.string()), ("lines", pa.int64())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, inner = _system(path)
        system.create_dir(inner, recursive=True)
        current, packed, entry, sink, lines = None, None, None, None, 0

        def close() -> pa.RecordBatch:
            entry.close()
            packed.close()
            sink.close()
            return pa.RecordBatch.from_arrays([pa.array([f"part-{current:08d}.zip"]), pa.array([lines], pa.int64())], schema=out)

        for batch in batches:
            for n, line in zip(batch.column("f").to_pylist(), batch.column("t").to_pylist(), strict=True):
                if n != current:
                    if current is not None:
                        yield close()
                    current, lines = n, 0
                    sink = system.open_output_stream(posixpath.join(inner, f"part-{n:08d}.zip"))
                    packed = zipfile.ZipFile(_Unseekable(sink), "w", zipfile.ZIP_DEFLATED)
                    entry = packed.open("events.json", "w", force_zip64=True)
                entry.write(line.encode() + b"\n")
                lines += 1
        if current is not None:
            yield close()

    dealt = rows.select(F.col(file).cast("long").alias("f"), F.col(order).alias("o"), F.col(text).alias("t")).repartition("f").sortWithinPartitions("f", "o")
    return dealt.mapInArrow(write, "name string, lines bigint")


class _Unseekable(io.RawIOBase):
    """A sink that is written from its beginning to its end only."""

    def __init__(self, sink: pa.NativeFile) -> None:
        self._sink = sink

    def writable(self) -> bool:
        return True

    def write(self, data: bytes) -> int:
        self._sink.write(bytes(data))
        return len(data)
