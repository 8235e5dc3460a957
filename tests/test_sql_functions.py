import random

import pytest
from pyspark.sql import functions as F

from kmerloom.functions import columns as C
from kmerloom.functions.params import SketchParams
from kmerloom.functions.sql import register
from kmerloom.operators.kmers import kmers, windows


def test_sql_functions_agree_with_columns(spark):
    register(spark)
    df = spark.createDataFrame([("a", "".join(random.Random(1).choices("ACGTacgt", k=200)) + "N")], "name string, seq string")
    df.createOrReplaceTempView("seqs")
    windows(df, 21).createOrReplaceTempView("kmers")
    got = spark.sql("SELECT revcomp(kmer) a, kmer_code(kmer) b, kmer_canonical(kmer) c, kmer_simplicity(kmer) d, kmer FROM kmers")
    k = F.col("kmer")
    want = spark.table("kmers").select(C.revcomp(k), C.kmer_code(k), C.canonical(k), C.simplicity(k), "kmer")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    rows = spark.sql("SELECT name, t.hash, t.s FROM seqs, LATERAL kmer_sketch(seq, 11, 3) t").collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, kmers(df, SketchParams(11, 3)).select("name", "hash", "s").collect()))
    whole = spark.sql("SELECT name, hash, s FROM kmer_sketches(TABLE(SELECT name, seq FROM seqs), 11, 3)").collect()
    assert sorted(map(tuple, whole)) == sorted(map(tuple, rows))
    (r,) = spark.sql("SELECT sketch_jaccard(4, 392) j, sketch_naive_distance(4, 392, 21) d, sketch_jaccard(0, 5) z, sketch_naive_distance(0, 5, 21) o, jukes_cantor(0.8D) f, jukes_cantor(0D) n").collect()
    assert r["j"] == pytest.approx(0.010204, abs=1e-6) and r["d"] == pytest.approx(0.169567, abs=1e-6) and (r["z"], r["o"], r["f"], r["n"]) == (0, 1, 1, 0)


def test_hashes_and_distances_in_sql(spark):
    from kmerloom.functions import formula
    from kmerloom.functions.params import MIX_1, MIX_2

    register(spark)
    rng = random.Random(5)
    codes = [0, 1, (1 << 63) - 1, 1 << 62, *(rng.getrandbits(63) for _ in range(200))]
    spark.createDataFrame([(c,) for c in codes], "code long").createOrReplaceTempView("codes")
    word = (1 << 64) - 1
    for r in spark.sql("SELECT code, kmer_mix_hash(code) AS h FROM codes").collect():
        p = (r["code"] ^ MIX_1) * (MIX_1 ^ MIX_2)
        assert r["h"] & word == (p & word) ^ (p >> 64)
    rows = []
    for _ in range(200):
        uni = rng.randrange(1, 2000)
        inter = rng.randrange(0, uni + 1)
        s = [rng.randrange(100, 300) for _ in range(uni)]
        t = [x + rng.randrange(0, 30) for x in s[:inter]]
        rows.append((inter, uni, sum(s), sum(x * x for x in s), sum(t), sum(x * x for x in t), 21))
    names = ("inter", "uni", "su", "su2", "si", "si2", "k")
    df = spark.createDataFrame(rows, ", ".join(f"{n} {'int' if n == 'k' else 'long'}" for n in names))
    df.createOrReplaceTempView("moments")
    c = [F.col(n) for n in names]
    x, j = formula.homoplasy(*c), formula.jaccard(F.col("inter"), F.col("uni"))
    some = F.col("inter") > 0
    naive = formula.naive_distance(j, F.col("k"))
    want = df.select(F.when(some, x).otherwise(0.0), *(F.when(some, formula.calibrated(naive, x, F.col("k"), jc)).otherwise(1.0) for jc in (False, True))).collect()
    args = ", ".join(names)
    got = spark.sql(f"SELECT sketch_homoplasy({args}), sketch_distance({args}), sketch_distance_jc({args}) FROM moments").collect()
    for a, b in zip(got, want, strict=True):
        assert tuple(a) == pytest.approx(tuple(b), abs=1e-9)
    assert any(0 < r[0] < 0.99 for r in want)
