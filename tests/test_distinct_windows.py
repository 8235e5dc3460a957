import random

from pyspark.sql import functions as F

from kmerloom.functions.params import SketchParams
from kmerloom.operators import kmers as K


def test_distinct_windows(spark, monkeypatch):
    """Names of one piece, of several rows, and of several pieces, with repeats; only those of several leave the kernel as hashes."""
    r = random.Random(4)
    parts = ["".join(r.choices("ACGT", k=40)) for _ in range(5)]
    rows = [(f"n{i}", "N".join(r.choices(parts, k=5))) for i in range(20)]
    rows += [("twice", parts[0]), ("twice", parts[0] + parts[1]), ("long", "".join(parts) * 60_000), (None, parts[2] * 2), ("short", "ACG"), ("none", None)]
    df = spark.createDataFrame(rows, "name string, seq string")
    once = K.kmers(df, SketchParams(21, 1)).groupBy("name")
    want = sorted(map(repr, once.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("hash").alias("n_distinct")).collect()))
    assert sorted(map(repr, K.distinct_windows(df, 21).collect())) == want and len(want) == 23
    shuffled = []
    monkeypatch.setattr(K, "kmers", lambda seqs, *a, f=K.kmers: shuffled.append({r[0] for r in seqs.select("name").collect()}) or f(seqs, *a))
    assert K.distinct_windows(df, 21).count() == 23 and shuffled == [{"twice", "long"}]


def test_memory_of_a_batch_is_bounded():
    """What the kernel takes at once does not follow the rows that Spark puts in a batch."""
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(["a"] * 400), pa.array([0] * 400), pa.array([b"ACGT" * 5000] * 400, pa.binary())], names=["name", "start", "seq"])
    sizes = [len(data) for _, _, data, _ in K._slices(batch, K.BATCH_BASES)]
    assert max(sizes) <= 1 << 19 and sum(sizes) >= 400 * 20000
