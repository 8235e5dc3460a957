import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from kmerloom.llm.trie import NODE, prefix_trie

WORD = re.compile("[^\x20\x09-\x0d]+")
TURNS = "conv_id long, turn long, role string, text string"


def brute(rows, every=20, heads=4):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % heads
        donor = c - (abs(c) % every if c >= 0 else -(abs(c) % every))
        whole = own.get(donor, [])[:h] + turns[h:]
        for d in range(len(whole) + 1):
            members[tuple(whole[:d])].append(c)
        ends[tuple(whole)].append(c)
    children = defaultdict(list)
    for path in members:
        if path:
            children[path[:-1]].append(path)
    leaves, saved = {}, {}
    for path in sorted(members, key=len, reverse=True):
        kids = children[path]
        leaves[path] = sum(leaves[k] for k in kids) or 1
        saved[path] = sum(saved[k] for k in kids) + (len(members[path]) - 1) * (len(WORD.findall(path[-1][1])) if path else 0)
    return sorted(
        (
            (min(m), len(path), min(members[path[:-1]]) if path else None, len(m), len(children[path]), leaves[path], saved[path], hashlib.sha256(",".join(map(str, sorted(ends[path]))).encode()).hexdigest())
            for path, m in members.items()
        ),
        key=str,
    )


def result(df):
    assert [f"{n} {t.replace('bigint', 'long')}" for n, t in df.dtypes] == NODE.split(", ")
    return sorted(map(tuple, df.collect()), key=str)


def talk(seed, n, turns, words):
    rng = random.Random(seed)
    return [(c, k, rng.choice(["user", "bot"]), rng.choice(words)) for c in rng.sample(range(3 * n), n) for k in range(rng.randrange(turns + 1))]


@pytest.mark.parametrize("seed, n, turns, words", [(1, 60, 6, ["a", "b b", " c\tc\nc "]), (2, 40, 3, ["x"]), (3, 25, 5, [f"w{k} " * 3 for k in range(9)])])
def test_against_brute_force(spark, seed, n, turns, words):
    rows = talk(seed, n, turns, words)
    got = prefix_trie(spark.createDataFrame(rows, TURNS).repartition(3))
    assert result(got) == brute(rows)


def test_copies_long_ones_and_negative_ids(spark):
    rows = [(c, k, "u", f"turn {k}") for c in range(-30, 40) for k in range(3)]  # one conversation very often
    rows += [(1000, k, "u", f"long {k}") for k in range(400)] + [(2011, 1, "u", "only"), (2000, 1, "u", "given")]
    rows += [(5000 + k, 1, "u", "a b c") for k in range(3)]  # one turn, and a donor of one turn
    assert result(prefix_trie(spark.createDataFrame(rows, TURNS).repartition(4))) == brute(rows)


def test_odd_rows(spark):
    rows = [
        (1, None, "u", "first"), (1, 2, None, None), (1, 2, "", ""), (1, 2, "", "a"), (1, 3, "u", "ab"), (2, None, "u", "first"), (2, 1, "ua", "b"), (3, 1, "u", "ab"), (3, 1, "u", "ab"),
        (None, 1, "u", "lost"), (4, 5, "u", "x" * 200_000), (4, 6, "u", "y " * 100_000), (24, 5, "u", "x" * 200_000),
    ]
    df = spark.createDataFrame([(*r, 1, "n", 0) for r in rows], TURNS + ", depth int, t string, w long").repartition(3)
    assert result(prefix_trie(df)) == brute(rows)
    assert result(prefix_trie(df, heads=1)) == brute(rows, heads=1)


@pytest.mark.parametrize("rows", [[], [(None, 1, "u", "a")]])
def test_no_conversation(spark, rows):
    assert prefix_trie(spark.createDataFrame(rows, TURNS)).count() == 0


@pytest.mark.parametrize("rows", [[(7, 1, "u", "a b")], [(11, 1, "u", "a"), (11, 2, "b", "c"), (11, 3, "b", "c")]])
def test_one_conversation(spark, rows):
    assert result(prefix_trie(spark.createDataFrame(rows, TURNS))) == brute(rows)
