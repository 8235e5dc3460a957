import random

import pytest
from pyspark.sql import functions as F

from kmerloom.functions.params import SketchParams
from kmerloom.operators.sketch import sketch
from kmerloom.streaming.least_counts import stream_min_count

PARAMS = SketchParams(9, 3, min_count=3)
READS = "name string, seq string"


def reads(seed):
    rng = random.Random(seed)
    genome = "".join(rng.choices("ACGT", k=300))
    out = [(rng.choice("ab"), genome[k : k + 60]) for k in (rng.randrange(240) for _ in range(30))]
    return out + [("a", None), (None, genome[:80]), (None, genome[:80]), (None, genome[40:120]), ("a", "")]


def run(spark, folder, out, state, params=PARAMS, **options):
    stream = spark.readStream.schema(READS).option("maxFilesPerTrigger", 1).json(str(folder))
    query = stream_min_count(stream, params, **options).writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(state)).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()


def rows(df):
    return sorted(map(tuple, df.select("name", "hash", "s").collect()), key=str)


@pytest.mark.parametrize("parts", [1, 2])
def test_what_leaves_is_the_batch_result(spark, tmp_path, parts):
    """Also when the stream is stopped and begun again between batches."""
    all_reads = reads(parts)
    folder, out, state = tmp_path / "in", tmp_path / "out", tmp_path / "state"
    folder.mkdir()
    for k in range(parts):
        some = all_reads[k::parts]
        spark.createDataFrame(some, READS).coalesce(1).write.mode("append").json(str(folder))
        run(spark, folder, out, state)
    got = spark.read.parquet(str(out))
    want = sketch(spark.createDataFrame(all_reads, READS), PARAMS).hashes
    assert rows(got) == rows(want) and want.count() > 10
    assert got.groupBy("name", "hash").count().where("count > 1").count() == 0


def test_counts_expire(spark, tmp_path):
    import time

    folder, params = tmp_path / "in", SketchParams(9, 1, min_count=2)
    folder.mkdir()
    for _ in range(2):  # the same windows again, after their counts have gone
        spark.createDataFrame([("a", "ACGGATTCAGA")], READS).coalesce(1).write.mode("append").json(str(folder))
        stream = stream_min_count(spark.readStream.schema(READS).json(str(folder)), params, expire_ms=1)
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="1 second").start()
        until = time.monotonic() + 60
        while not any(p["numInputRows"] for p in query.recentProgress) and time.monotonic() < until:
            time.sleep(0.2)
        query.stop()
    assert spark.read.schema("name string, hash long, s int").parquet(str(tmp_path / "out")).count() == 0
