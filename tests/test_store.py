"""Look-ups by two keys, swapped tables, unreadable tables, and a stream with late rows."""

import datetime as dt
import os

from kinfold.operators import store
from kinfold.streaming.ingest import windowed_counts


def test_lookups_open_few_files(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.range(4096).selectExpr("id * 7919 % 4096 AS number", "concat('P', id * 31 % 4096) AS protein_id", "id")
    store.indexed(rows, path, ["protein_id", "number"], files=64)
    assert len(spark.read.parquet(path).inputFiles()) == 64
    for key, value in [("number", v) for v in (0, 77, 4095)] + [("protein_id", f"P{v}") for v in (3, 999, 4000)]:
        got = store.find(spark, path, key, value)
        assert [r[key] for r in got.collect()] == [value]
        assert len(got.inputFiles()) <= 16, (key, value, len(got.inputFiles()))
    assert store.find(spark, path, "number", 99_999).count() == store.find(spark, path, "protein_id", "none").count() == 0


def test_index_with_nulls_and_few_values(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([(None, 1), ("a", None), ("a", 2), ("b", 2)], "s string, n int")
    store.indexed(rows, path, ["s", "n"], files=3)
    assert sorted(map(tuple, store.find(spark, path, "n", 2).collect())) == [("a", 2), ("b", 2)]
    assert store.find(spark, path, "s", "a").count() == 2
    store.indexed(rows.limit(0), path, ["s", "n"])
    assert store.find(spark, path, "s", "a").count() == 0


def test_replaced_table_reads_itself(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(10).write.parquet(path)
    assert store.replace(spark.read.parquet(path).where("id < 4"), path).count() == 4
    assert store.replace(spark.range(3), str(tmp_path / "new")).count() == 3
    assert sorted(p for p in os.listdir(tmp_path)) == ["new", "t"]


def test_a_table_that_cant_be_read_is_made_anew(spark, tmp_path):
    build = lambda: spark.range(5)
    assert store.memoized(spark, "m", {}, build, str(tmp_path)).count() == 5
    (folder,) = tmp_path.iterdir()
    for f in folder.glob("*.parquet"):
        f.write_bytes(b"broken")
        (folder / f".{f.name}.crc").unlink(missing_ok=True)
    assert store.memoized(spark, "m", {}, build, str(tmp_path)).count() == 5


def test_windows_of_a_stream_with_late_rows(spark, tmp_path):
    at = lambda h, m=0: dt.datetime(2024, 1, 1, h, m)
    schema = "ts timestamp, kind string"

    def run():
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        q = windowed_counts(stream, "ts", "kind").writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()

    for rows in ([(at(1), "a"), (at(1, 30), "a"), (at(2), "b")], [(at(9), "a"), (at(1, 40), "a")], [(at(1, 50), "a"), (at(8, 5), "b"), (at(15), "a")], [(at(20), "a")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        run()
    got = {(r["start"].hour, r["key"]): r["n"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    # 1:40 came before the watermark passed its window; 1:50 came after it, and is not counted; open windows are not out yet
    assert got == {(1, "a"): 3, (2, "b"): 1, (8, "b"): 1, (9, "a"): 1, (15, "a"): 1}
