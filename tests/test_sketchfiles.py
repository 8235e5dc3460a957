import os
from decimal import Decimal

import pyarrow as pa
import pytest

from kmerloom.functions.params import SketchParams
from kmerloom.operators.sketch import sketch
from kmerloom.sources.sketchfiles import SketchFiles, SketchFileWriter, file_of, write_sketch_files
from kmerloom.sources.store import NESTED, decode, encoded, read_sketches


def rows(*names, bad=()):
    kinds = [("name", pa.string()), ("k", pa.int32()), ("threshold", pa.decimal128(20, 0)), ("hashes", pa.list_(pa.int64())), ("simplicities", pa.list_(pa.int32()))]
    return pa.RecordBatch.from_pylist([{"name": n, "k": 5, "threshold": 9, "hashes": [3, 1], "simplicities": [7] if n in bad else [7, 8]} for n in names], schema=pa.schema(kinds))


def files(folder):
    return sorted(os.path.relpath(os.path.join(d, f), folder) for d, _, names in os.walk(folder) for f in names) + sorted(x for x in os.listdir(folder) if x.startswith("."))


def test_files_are_those_of_the_encoder(spark, tmp_path):
    df = spark.createDataFrame([(str(tmp_path / f"g{k}.fa"), "ACGTTGCA" * 20 + "ACGATTAG"[k:]) for k in range(5)] + [(str(tmp_path / "e.fa"), "NN")], "name string, seq string")
    made = sketch(df, SketchParams(7, 2))
    want = {r["name"]: bytes(r["content"]) for r in encoded(made).collect()}
    write_sketch_files(spark, made, str(tmp_path / "out"))
    write_sketch_files(spark, made)
    for name, content in want.items():
        for path in (file_of(name, str(tmp_path / "out")), file_of(name, None)):
            with open(path, "rb") as f:
                assert f.read() == content
    assert len(files(tmp_path)) == 12 and files(tmp_path / "out") == sorted(f"{os.path.basename(n)}.sketch" for n in want)
    assert read_sketches(spark, str(tmp_path / "out")).drop("path").exceptAll(spark.createDataFrame([], NESTED).drop("path")).count() == 6


def test_nothing_is_there_before_the_commit(tmp_path):
    writer = SketchFileWriter(str(tmp_path))
    first, again = writer.write(iter([rows("a", "b")])), writer.write(iter([rows("a", "b")]))  # a task and its retry
    assert not [f for f in os.listdir(tmp_path) if f.endswith(".sketch")]
    writer.commit([again, None])
    assert files(tmp_path) == ["a.sketch", "b.sketch"] and first.files != again.files
    with open(tmp_path / "a.sketch", "rb") as f:
        assert [list(x) for x in decode(f.read())[3:]] == [[1, 3], [8, 7]]


def test_a_failing_task_leaves_nothing(tmp_path):
    writer = SketchFileWriter(str(tmp_path))
    done = writer.write(iter([rows("a")]))
    with pytest.raises(IndexError):
        writer.write(iter([rows("b", "c", bad=("c",))]))
    assert len(files(tmp_path)) == 2  # what the first task has staged, and its folder
    writer.abort([done, None])
    assert files(tmp_path) == []
    alone = SketchFileWriter(None)
    with pytest.raises(IndexError):
        alone.write(iter([rows(str(tmp_path / "b"), str(tmp_path / "c"), bad=(str(tmp_path / "c"),))]))
    assert files(tmp_path) == []


def test_a_failing_job_leaves_nothing(spark, tmp_path):
    spark.dataSource.register(SketchFiles)
    nested = "name string, k int, threshold decimal(20,0), hashes array<bigint>, simplicities array<int>"
    df = spark.createDataFrame([(f"s{k}", 5, Decimal(9), [1, 2], [1, 2] if k < 7 else [1]) for k in range(8)], nested).repartition(4)
    with pytest.raises(Exception):
        df.write.format("sketch_files").mode("append").option("folder", str(tmp_path)).save()
    assert files(tmp_path) == []
    same = spark.createDataFrame([(f"{x}/s", 5, Decimal(9), [1], [1]) for x in "ab"], nested)
    with pytest.raises(Exception, match="several sketches"):
        same.write.format("sketch_files").mode("append").option("folder", str(tmp_path)).save()
    assert files(tmp_path) == []
    with pytest.raises(Exception, match="a sketch needs"):
        same.drop("k").write.format("sketch_files").mode("append").save()
