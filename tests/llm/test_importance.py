import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kmerloom.llm.importance import bucket_counts, features, gains, resample, shifted

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return WORD.findall((text or "").translate(FOLD))


def buckets_of(text, n=10_000):
    w = words_of(text)
    return Counter(zlib.crc32(" ".join(w[i : i + k]).encode()) % n for k in (1, 2, 3) for i in range(len(w) - k + 1))


def brute(rows, target, percent=5, least=20):
    source, goal = Counter(), Counter()
    for _, t in rows:
        source += buckets_of(t)
    for t in target:
        goal += buckets_of(t)
    s_all, t_all = sum(source.values()), sum(goal.values())
    gain = [math.floor(1000 * math.log((goal[b] + 1) * (s_all + 10000) / ((source[b] + 1) * (t_all + 10000)))) for b in range(10000)]
    out = []
    for i, t in rows:
        own = buckets_of(t)
        weight = sum(gain[b] * c for b, c in own.items())
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, sum(own.values()), weight, score, None, len(words_of(t))])
    fit = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0]))
    for k, r in enumerate(fit[: percent * len(fit) // 100]):
        r[4] = k + 1
    return sorted(map(tuple, out), key=str)


def result(df):
    return sorted(map(tuple, df.select("doc_id", "n_features", "weight", "score", "rank", "n_words").collect()), key=str)


@given(st.binary(max_size=200), st.integers(0, 3000), st.binary(max_size=70))
def test_shifts_join_checksums(a, zeros, b):
    b = b + bytes(zeros)
    v = shifted(np.array([zlib.crc32(a)], np.uint32), np.array([len(b)])) ^ np.uint32(zlib.crc32(b))
    assert int(v[0]) == zlib.crc32(a + b)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=30), st.text(alphabet="aZ9 é-\n_", max_size=60)), max_size=6), st.integers(1, 40))
def test_features(rows, piece):
    rows = [None if t is None else t.encode("utf-8", "ignore").decode() for t in rows] + ["x" * 300 + " Y " + "z" * 257, "a" * 200]
    want = [buckets_of(t, 997) for t in rows]
    for size in (piece, 1 << 20):
        got, n = [Counter() for _ in rows], np.zeros(len(rows), np.int64)
        for bucket, row, words in features(pa.array(rows, pa.string()), 997, size):
            n += words
            for b, r in zip(bucket.tolist(), row.tolist(), strict=True):
                got[r][b] += 1
        assert got == want and n.tolist() == [len(words_of(t)) for t in rows]


def corpus(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"{c}{k}" for c in ("med", "law", "art", "é") for k in range(60)]
    return [(i, " ".join(rng.choices(vocabulary[60 * (i % 4) :][:60], k=rng.choice([3, 19, 20, 21, 60])))) for i in range(n)]


@pytest.mark.parametrize("percent", [5, 37, 100])
def test_against_brute_force(spark, frame, percent):
    rows = corpus(1, 300)
    rows += [(1000 + k, rows[7][1]) for k in range(100)]  # a large group of copies
    target = [t for i, t in corpus(2, 40) if i % 4 == 0]
    bench = spark.createDataFrame([(t,) for t in target], "text string")
    got = resample(frame(rows, clash=True).repartition(5), bench, percent=percent)
    assert result(got) == brute(rows, target, percent)
    ranks = sorted(r["rank"] for r in got.collect() if r["rank"])
    assert ranks == list(range(1, len(ranks) + 1)) and ranks


def test_it_draws_what_is_like_the_target(spark, frame):
    rows, target = corpus(3, 800), spark.createDataFrame([(t,) for i, t in corpus(4, 200) if i % 4 == 1], "text string")
    got = [r["doc_id"] for r in resample(frame(rows), target, percent=20).where("rank is not null").collect()]
    assert sum(i % 4 == 1 for i in got) > 0.95 * len(got)


def test_odd_rows(spark, frame, odd_rows):
    bench = spark.createDataFrame([("x y one two",), (None,)], "text string")
    got = result(resample(frame(odd_rows, clash=True), bench, percent=60, least_words=1))
    assert [r[:4] + r[5:] for r in got] == [r[:4] + r[5:] for r in brute(odd_rows, ["x y one two"], 60, 1)]
    drawn = [r for r in got if r[4]]
    fit = [r for r in got if r[5] >= 1]
    assert len(drawn) == 60 * len(fit) // 100 and min(r[3] for r in drawn) >= max(r[3] for r in fit if not r[4])


def test_no_rows(spark, frame):
    bench = spark.createDataFrame([("a b",)], "text string")
    assert resample(frame([]), bench).count() == 0
    assert result(resample(frame([(1, "a b " * 30)]), bench.limit(0), percent=100)) == brute([(1, "a b " * 30)], [], 100)
    assert bucket_counts(bench.where("false"), "text", 10).tolist() == [0] * 10 and gains(np.zeros(3, int), np.zeros(3, int)).tolist() == [0, 0, 0]
