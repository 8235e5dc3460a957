import random
from collections import Counter, defaultdict

import pytest

from kmerloom.llm.common import Scratch
from kmerloom.llm.mixing import apply_mix, mix, mixed, with_targets


def targets_of(sizes, weights=(5, 2, 1), most=3):
    """min(most * size, level * weight), at the level at which they add up to all sizes, found by halving."""
    order = sorted(sizes, key=lambda x: (x[0] is None, (x[0] or "").encode()))
    total, low, high = sum(n for _, n in order), 0.0, 1e12
    at = lambda level: [min(most * n, level * weights[k % len(weights)]) for k, (_, n) in enumerate(order)]
    for _ in range(200):
        level = (low + high) / 2
        low, high = (level, high) if sum(at(level)) < total else (low, level)
    return [(s, n, t) for (s, n), t in zip(order, at(high), strict=True)]


@pytest.mark.parametrize("seed", range(4))
def test_targets_by_rounds(spark, seed):
    rng = random.Random(seed)
    sizes = [(s, int(10 ** rng.uniform(0, 6)) if rng.random() < 0.9 else 0) for s in (None, "", "é", "z", "Z", "\U0001f642", "\uffee", *(f"s{k}" for k in range(40)))]
    rng.shuffle(sizes)
    got = with_targets(Scratch(spark, "test"), spark.createDataFrame(sizes, "_source string, source_size long")).orderBy("_k").collect()
    want = targets_of(sizes)
    assert [(r["_source"], r["source_size"]) for r in got] == [w[:2] for w in want] and [r["_k"] for r in got] == list(range(len(want)))
    assert [r["target"] for r in got] == pytest.approx([w[2] for w in want], rel=1e-6)


def test_targets():
    got = targets_of([("b", 100), (None, 1000), ("a", 10), ("c", 0)])
    assert [(s, n) for s, n, _ in got] == [("a", 10), ("b", 100), ("c", 0), (None, 1000)]
    assert [t for _, _, t in got] == pytest.approx([30, 300, 0, 780])
    assert targets_of([("x", 5)])[0][2] == pytest.approx(5)


def rows_of(seed, n=300):
    rng = random.Random(seed)
    rows = [(i, " ".join(f"t{i}.{k}" for k in range(rng.choice([0, 1, 5, 70, 200]))), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(n)]
    return [*rows, (None, None, "z"), (5, "x y", "tiny"), (5, "x y", "tiny"), (900, "one two", "A")]


@pytest.mark.parametrize(("block", "shards"), [(7, 5), (64, 64), (1000, 3)])
def test_sums_and_limits(frame, block, shards):
    rows = rows_of(1)
    df = frame(rows, clash=True)
    got = mix(df, block=block, shards=shards, rows_a_bucket=40).collect()
    assert len(got) == len(rows)
    size = defaultdict(int)
    for _, t, s in rows:
        size[s] += len((t or "").split())
    target = {s: t for s, _, t in targets_of(list(size.items()))}
    target = {s: round(t, 6) for s, t in target.items()}
    assert Counter((r["doc_id"], r["size"], r["source_size"], round(r["target"], 6)) for r in got) == Counter((i, len((t or "").split()), size[s], target[s]) for i, t, s in rows)
    taken = defaultdict(int)
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[round(r["target"], 6), r["source_size"]] += r["taken"]
    for s in size:
        assert abs(taken[target[s], size[s]] - target[s]) <= 1
    again = mix(df.repartition(3), block=block, shards=shards, rows_a_bucket=40).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_slots_are_dealt_over_shards(frame):
    documents, pieces = mixed(frame(rows_of(2)), block=10, shards=8, rows_a_bucket=50)
    per = Counter(r["_shard"] for r in pieces.collect())
    assert len(per) == 8 and max(per.values()) < 1.5 * min(per.values())
    assert documents.count() == len(rows_of(2))


def test_applied_texts(frame):
    rows = [(i, "  ".join(f"t{i}.{k}" for k in range(40)), "ab"[i % 2]) for i in range(40)]
    df = frame(rows, clash=True)
    want = {r["doc_id"]: r["taken"] for r in mix(df, block=16).collect()}
    out = apply_mix(df, block=16)
    assert out.columns == df.columns
    got, texts = defaultdict(int), dict((i, t) for i, t, _ in rows)
    for r in out.collect():
        words = r["text"].split()
        got[r["doc_id"]] += len(words)
        assert set(words) <= set(texts[r["doc_id"]].split()) and len(set(words)) == len(words) and r["n_chars"] == len(r["text"])
        assert len(words) < 40 or r["text"] == texts[r["doc_id"]]
    assert {i: n for i, n in want.items() if n} == dict(got)


def test_long_text(frame):
    """One document of megabytes has most of its source; its words are taken to the word, and texts are cut from the whole of it."""
    long = " ".join(f"w{k}" for k in range(400_000))
    df = frame([(1, long, "a"), (2, "x y z", "a"), (3, "p q " * 50_000, "b")])
    sizes = [("a", 400_003), ("b", 100_000)]
    got = {r["doc_id"]: r for r in mix(df).collect()}
    for s, n, t in targets_of(sizes):
        own = [r for r in got.values() if r["source_size"] == n]
        assert abs(sum(r["taken"] for r in own) - t) <= 1 and all(r["taken"] <= 3 * r["size"] for r in own), s
    taken, places = Counter(), {w: k for k, w in enumerate(long.split())}
    for r in apply_mix(df).collect():
        words = r["text"].split()
        taken[r["doc_id"]] += len(words)
        if r["doc_id"] == 1:
            at = [places[w] for w in words]
            assert at == sorted(set(at))
    assert taken == {i: r["taken"] for i, r in got.items() if r["taken"]}


def test_odd_rows(frame, odd_rows):
    got = mix(frame(odd_rows, clash=True)).collect()
    assert len(got) == len(odd_rows) and sum(r["taken"] for r in got) == sum(r["size"] for r in got)
    assert mix(frame([])).count() == 0 and apply_mix(frame([])).count() == 0
    assert mix(frame([(1, None), (2, "")])).count() == 2
