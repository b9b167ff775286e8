"""Zips of JSON lines, as batches, as streams and as written."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from foldspark.sources import log as logs
from foldspark.sources.zipped import ZippedLines, write_zips


def pack(path, lines, entry="events.json"):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("notes.txt", "no")
        z.writestr(entry, lines)


@pytest.mark.parametrize("span", [1, 37, 1 << 20])
def test_spans_give_each_line_once(spark, tmp_path, span):
    pack(tmp_path / "a.zip", "﻿" + "\n".join(["one", "", "  ", "two €", "x" * 100, "three"]))
    pack(tmp_path / "b.zip", "only\r\n\r\nmore\r\n")
    pack(tmp_path / "c.zip", "")
    pack(tmp_path / "d.zip", "no JSON", "events.txt")
    (tmp_path / "other.txt").write_text("no")
    spark.dataSource.register(ZippedLines)
    for path in (str(tmp_path), f"file://{tmp_path}"):
        rows = spark.read.format("zipped_lines").option("path", path).option("span", span).load()
        found = sorted((r.path.rpartition("/")[2], r.line, r.text) for r in rows.collect())
        assert found == [("a.zip", 0, "one"), ("a.zip", 1, "two €"), ("a.zip", 2, "x" * 100), ("a.zip", 3, "three"), ("b.zip", 0, "only"), ("b.zip", 1, "more")]
    assert rows.rdd.getNumPartitions() >= 2
    (tmp_path / "none").mkdir()
    assert spark.read.format("zipped_lines").option("path", str(tmp_path / "none")).load().count() == 0
    assert spark.read.format("zipped_lines").option("path", f"file://{tmp_path}/[ab]*.zip").load().count() == 6


def test_written_zips_come_back(spark, tmp_path):
    rows = spark.range(1000).select((F.col("id") % 3).alias("f"), F.col("id").alias("n"), F.to_json(F.struct(F.lit("A.B.Thing, C").alias("$type"), "id")).alias("t")).repartition(5)
    written = {r.name: r.lines for r in write_zips(rows, f"file://{tmp_path}/out", "f", "n", "t").collect()}
    assert written == {"part-00000000.zip": 334, "part-00000001.zip": 333, "part-00000002.zip": 333}
    log = logs.read_json_zip(spark, str(tmp_path / "out"), page_size=10, span=999).orderBy("checkpoint", "event_seq").collect()
    ids = [json.loads(r.body)["id"] for r in log]
    assert ids == [n for f in range(3) for n in range(f, 1000, 3)] and {r.event_type for r in log} == {"Thing"}
    assert log[334].checkpoint == 6 * 11 + 1 and log[334].event_seq == 0  # the second file begins a page


def test_stream_gives_each_zip_once(spark, tmp_path):
    folder, seen = tmp_path / "in", []
    folder.mkdir()
    line = lambda n: json.dumps({"$type": "X.Y, Z", "n": n})

    def run():
        rows = logs.stream_json_zip(spark, str(folder))
        rows.writeStream.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).foreachBatch(lambda b, n: seen.extend((n, json.loads(r.text)["n"], r.event_type) for r in b.collect())).start().awaitTermination()

    pack(folder / "b.zip", line(1) + "\n" + line(2))
    run()
    pack(folder / "a.zip", line(3))
    run()
    run()
    assert sorted(seen) == [(0, 1, "Y"), (0, 2, "Y"), (1, 3, "Y")]
