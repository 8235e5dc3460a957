import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from kmerloom.llm.exact_dedup import deduplicated, exact_dedup


def bare(text):
    return (text or "").translate({ord(c): None for c in " \t\n\x0b\x0c\r"})


def brute(rows):
    groups = defaultdict(list)
    for k, (i, t, *_) in enumerate(rows):
        groups[bare(t)].append((-len(t or ""), i is None, i or 0, k))
    out = []
    for t, members in groups.items():
        best = min(members)
        keep = None if best[1] else best[2]
        out += [(None if m[1] else m[2], keep, len(members), m == best, hashlib.sha256(t.encode()).hexdigest()) for m in members]
    return sorted(out, key=str)


def result(df):
    return sorted(map(tuple, df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=str)


@pytest.mark.parametrize("clash", [False, True])
def test_odd_rows(frame, odd_rows, clash):
    df = frame(odd_rows, clash).coalesce(1)
    assert result(exact_dedup(df)) == brute(odd_rows)


@pytest.mark.parametrize("hash_of", [F.xxhash64, lambda b: F.lit(0).cast("long") + F.octet_length(b) * 0, lambda b: F.pmod(F.crc32(b), F.lit(3)).cast("long")])
def test_small_blocks_and_colliding_hashes(frame, hash_of):
    rng = random.Random(1)
    texts = ["".join(rng.choices("ab é", k=rng.choice([0, 3, 7, 8, 9, 31, 64]))) for _ in range(60)]
    rows = [(i, rng.choice(texts)) for i in range(150)]
    assert result(exact_dedup(frame(rows), block_bytes=4, hash_of=hash_of)) == brute(rows)


def test_names_are_the_same_for_any_partitioning(frame, odd_rows):
    df = frame(odd_rows[:6] + odd_rows[9:])
    one = exact_dedup(df.coalesce(1)).select("doc_id", "level", "name").orderBy("doc_id").collect()
    assert one == exact_dedup(df.repartition(5)).select("doc_id", "level", "name").orderBy("doc_id").collect()


def test_keeping_rows(frame, odd_rows):
    kept = deduplicated(frame(odd_rows, clash=True))
    got = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str)
    best = {}
    for i, t in odd_rows:
        key = (-len(t or ""), i is None, i or 0)
        if bare(t) not in best or key < best[bare(t)][0]:
            best[bare(t)] = key, (i, t)
    assert len(got) == len(best) and {g[0] for g in got} == {b[1][0] for b in best.values()}
    assert kept.columns == frame([], clash=True).columns


def test_empty_table(frame):
    assert exact_dedup(frame([])).count() == 0 and deduplicated(frame([])).count() == 0
