import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kmerloom.functions.params import BASE_CODES, MIX_1, MIX_2, SketchParams, scale_of, seed_of
from kmerloom.operators.kmers import chunked, hash_windows, kmers, kmers_by_columns
from kmerloom.operators.sketch import nested, pooled_sketch, sketch


def brute(seq: str, k: int, multiplier: int = MIX_1 ^ MIX_2):
    """(place, hash, simplicity) by whole numbers."""
    out, pair = [], dict(zip("ACGT", "TGCA", strict=True))
    for i in range(len(seq) - k + 1):
        w = seq[i : i + k].upper()
        if set(w) <= set("ACGT"):
            a = b = 0
            for x, y in zip(w, (pair[c] for c in reversed(w)), strict=True):
                a, b = a << 3 | BASE_CODES[x], b << 3 | BASE_CODES[y]
            p = (min(a, b) ^ MIX_1) * multiplier % (1 << 128)
            out.append((i, p % (1 << 64) ^ p >> 64, sum(w.count(c) ** 2 for c in "ACGT")))
    return out


def kernel(seq: str, k: int):
    place, _, _, h, s = hash_windows(np.frombuffer(seq.encode(), np.uint8), k, MIX_1 ^ MIX_2)
    return list(zip(place.tolist(), h.tolist(), s.tolist(), strict=True))


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ACGTacgtNU ", max_size=130), st.sampled_from([1, 2, 3, 11, 20, 21, 22, 31, 41, 42]))
def test_kernel_is_whole_number_arithmetic(seq, k):
    assert kernel(seq, k) == brute(seq, k)


def test_reverse_complement_and_case_do_not_matter():
    seq = "".join(random.Random(1).choices("ACGT", k=300))
    rc = seq[::-1].translate(str.maketrans("ACGT", "TGCA"))
    for k in (5, 21, 30):
        assert sorted(x[1:] for x in kernel(seq, k)) == sorted(x[1:] for x in kernel(rc.lower(), k))


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_columns_agree_with_the_kernel(spark):
    text = "".join(random.Random(2).choices("ACGTacgtN", weights=[9] * 8 + [1], k=900))
    df = spark.createDataFrame([("a", text), ("b", "ACGT"), ("c", None), ("d", "")], "name string, seq string")
    for p in (SketchParams(11, 4), SketchParams(21, 1), SketchParams(21, 3), SketchParams(7, "2/3"), SketchParams(21, 2, seed=12345, max_simplicity=120), SketchParams(22, 1), SketchParams(31, 2), SketchParams(41, 3), SketchParams(42, 1, seed=987654321987654321)):
        got = rows(kmers(df, p).select("name", "hash", "s"))
        assert got == rows(kmers_by_columns(df, p).select("name", "hash", "s"))
        limit = p.max_simplicity or 10**9
        expected = sorted(("a", h - (h >> 63 << 64), s) for _, h, s in brute(text, p.k, p.multiplier) if h < p.threshold and s <= limit)
        assert got == expected + [x for x in got if x[0] == "b"]


def test_chunks_lose_and_repeat_nothing(spark):
    text = "".join(random.Random(3).choices("ACGT", k=1000))
    df = spark.createDataFrame([("a", text)], "name string, seq string")
    for size in (1, 7, 64, 5000):
        pieces = chunked(df, "name", "seq", 21, size).collect()
        assert sorted(p["start"] + i for p in pieces for i in range(len(p["seq"]) - 20)) == list(range(980))


def test_parameters():
    assert seed_of(None) == MIX_1 and seed_of(7) == 8 and seed_of("0x10") == 16 and seed_of((1 << 64) - 1) == 0
    assert scale_of("1/1000") == (1, 1000) and scale_of(50) == (1, 50)
    assert SketchParams(scale=1000).threshold == ((1 << 64) - 1) // 1000
    for bad in ({"k": 0}, {"k": 43}, {"scale": 0}, {"scale": "3/2"}):
        with pytest.raises(ValueError):
            SketchParams(**bad)


def test_sketches(spark):
    rng = random.Random(4)
    one = "".join(rng.choices("ACGT", k=500))
    df = spark.createDataFrame([("a", one), ("a", one[:200]), ("b", one[100:300]), ("e", "NNN")], "name string, seq string")
    full, thin = sketch(df, SketchParams(15, 2)), sketch(df, SketchParams(15, 8))
    assert set(rows(thin.hashes)) <= set(rows(full.hashes))
    assert [(r["name"], r["n"] == 0) for r in full.meta.orderBy("name").collect()] == [("a", False), ("b", False), ("e", True)]
    twice = sketch(df, SketchParams(15, 2, min_count=2)).hashes
    once = {h for n, h, _ in rows(full.hashes) if n == "a"}
    from collections import Counter

    count = Counter(h - (h >> 63 << 64) for part in (one, one[:200]) for _, h, _ in brute(part, 15) if h < SketchParams(15, 2).threshold)
    assert {h for n, h, _ in rows(twice) if n == "a"} == {h for h, c in count.items() if c > 1} and once == set(count)
    pool = pooled_sketch(df, SketchParams(15, 2))
    assert {r["hash"] for r in pool.hashes.collect()} == {h for _, h, _ in rows(full.hashes)}
    for r in nested(full).collect():
        assert [h % (1 << 64) for h in r["hashes"]] == sorted(h % (1 << 64) for h in r["hashes"]) and len(r["hashes"]) == len(r["simplicities"])


def test_stream_sketch_merges_batches(spark, tmp_path):
    from kmerloom.streaming import stream_sketch

    rng = random.Random(5)
    parts = ["".join(rng.choices("ACGT", k=200)) for _ in range(3)]
    for k, seq in enumerate(parts):
        spark.createDataFrame([("a", seq)], "name string, seq string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("name string, seq string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stream_sketch(stream, SketchParams(11, 4)).writeStream.format("memory").queryName("sketches").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    whole = sketch(spark.createDataFrame([("a", s) for s in parts], "name string, seq string"), SketchParams(11, 4))
    assert rows(spark.table("sketches").select("name", "hash", "s")) == rows(whole.hashes)
