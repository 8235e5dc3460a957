import random

import pytest

from kmerloom.operators.trees import BadTree, robinson_foulds, splits_of

KNOWN = [
    ("((a,b),(c,d));", "((a,c),(b,d));", 2, 1.0),
    ("((a,b),(c,d));", "(a,b,(c,d));", 0, 0.0),  # rooted and unrooted
    ("((a,b),(c,d));", "(a,b,c,d);", 1, 0.5),  # a star has no split
    ("(((a,b),c),(d,e));", "(((a,c),b),(d,e));", 2, 0.5),
    ("(((a:1,b:2)x:0.5,c)90,('d d',e)[note]);", "((e,'d d'),((b,a),c));", 0, 0.0),
    ("(a,b,c);", "(c,(a,b));", 0, None),
    ("((a,b),(c,d));", "((a,b),(c,e));", None, None),
]


def test_known_trees(spark):
    trees = [(f"{k}{x}", t) for k, pair in enumerate(KNOWN) for x, t in zip("ab", pair)]
    df = spark.createDataFrame([*trees, ("null", None)], "tree string, newick string")
    pairs = spark.createDataFrame([(f"{k}a", f"{k}b") for k in range(len(KNOWN))] + [("0b", "0a"), ("0b", "0a"), ("0a", "none"), ("0a", "null"), ("1a", "1a")], "a string, b string")
    got = sorted((r["a"], r["b"], r["rf"], r["nrf"]) for r in robinson_foulds(df, pairs).collect())
    want = [(f"{k}a", f"{k}b", rf, nrf) for k, (_, _, rf, nrf) in enumerate(KNOWN)] + [("0b", "0a", 2, 1.0)] * 2 + [("1a", "1a", 0, 0.0)]
    assert got == sorted(want)


def drawn(rng, taxa):
    """(Newick, splits as sets) of a random tree."""
    parts, sides = [(t, {t}) for t in taxa], []
    while len(parts) > 1:
        some = [parts.pop(rng.randrange(len(parts))) for _ in range(min(len(parts), rng.choice([2, 2, 3])))]
        parts.append((f"({','.join(t for t, _ in some)}){rng.choice(['', ':1e-2', 'n1:3'])}", set().union(*(s for _, s in some))))
        sides.append(parts[-1][1])
    low = min(taxa)
    return parts[0][0] + ";", {frozenset(s if low in s else set(taxa) - s) for s in sides if 2 <= len(s) <= len(taxa) - 2}


def test_random_trees(spark):
    rng = random.Random(9)
    taxa = [f"t{k}" for k in range(12)]
    made = [drawn(rng, taxa) for _ in range(20)]
    for text, sides in made:
        assert splits_of(text)[0] == 12 and len(splits_of(text)[2]) == len(sides)
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(made)], "tree long, newick string").repartition(3)
    pairs = spark.createDataFrame([(i, j) for i in range(20) for j in range(20)], "a long, b long")
    got = {(r["a"], r["b"]): (r["rf"], r["nrf"]) for r in robinson_foulds(df, pairs).collect()}
    assert got == {(i, j): (len(x ^ y), len(x ^ y) / 18) for i, (_, x) in enumerate(made) for j, (_, y) in enumerate(made)}


@pytest.mark.parametrize("text", ["", "a;", "(a,b", "(a,b))", "(a,,b);", "(a,a);", "((a,b)(c,d));", "a(b,c);", "(a,b)];", "()"])
def test_what_is_no_tree(text):
    with pytest.raises(BadTree):
        splits_of(text)


def test_deep_trees_are_read():
    n = 20_000
    text = "(" * (n - 1) + "t0," + ",".join(f"t{k})" for k in range(1, n)) + ";"
    assert len(splits_of(text)[2]) == n - 3
