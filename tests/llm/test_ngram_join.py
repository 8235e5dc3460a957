import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kmerloom.llm.common import Scratch
from kmerloom.llm.ngram_join import block_links, least_labels, ngram_join, one_of_each


def shingles(text, w):
    x = (text or "").encode().lower().split()
    return frozenset(tuple(x[i : i + w]) for i in range(len(x) - w + 1)) if len(x) >= w else frozenset([tuple(x)] if x else [])


def brute(rows, w, percent):
    sets = [shingles(t, w) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted(((i, len(sets[k]), least.get(find(k)) if sets[k] else i) for k, (i, _) in enumerate(rows)), key=str)


def result(df):
    return sorted(map(tuple, df.select("doc_id", "n_shingles", "component_id").collect()), key=str)


def corpus(seed, n=160):
    """Groups of near copies of all degrees around the threshold, a passage that many share, subsets, short texts."""
    rng = random.Random(seed)
    words = [f"v{k}" for k in range(3000)]
    passage = rng.choices(words, k=30)
    bases = [rng.choices(words, k=rng.choice([3, 4, 5, 9, 25, 60, 150])) for _ in range(12)]
    rows = []
    for i in range(n):
        t = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 4])):
            at = rng.randrange(len(t))
            t[at] = rng.choice([rng.choice(words), t[at].upper()])
        if rng.random() < 0.3:
            t = t[: max(1, int(len(t) * rng.choice([0.8, 0.86, 0.9])))]
        if rng.random() < 0.2:
            t += passage
        rows.append((i * 7 % 1009, rng.choice([" ", "\n", " \t"]).join(t)))
    return rows


@pytest.mark.parametrize(("seed", "w", "percent", "rounds", "chunk"), [(1, 4, 85, 3, 8 << 20), (2, 4, 85, 0, 3000), (3, 5, 80, 1, 3000), (4, 2, 60, 3, 1000)])
def test_against_all_pairs(frame, seed, w, percent, rounds, chunk):
    rows = corpus(seed)
    rows += [(2000 + k, t) for k, (_, t) in enumerate(rows[:10])]
    got = ngram_join(frame(rows), width=w, percent=percent, rounds=rounds, chunk_bytes=chunk, block=(7, 1000))
    assert result(got) == brute(rows, w, percent)


def test_one_large_group(frame):
    rng = random.Random(9)
    base = [f"u{k}" for k in range(120)]
    rows = []
    for i in range(250):
        t = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 4, 6])):
            t[rng.randrange(120)] = f"n{rng.randrange(40)}"
        rows.append((i, " ".join(t)))
    assert result(ngram_join(frame(rows), width=4, percent=85)) == brute(rows, 4, 85)


def test_odd_rows(frame, odd_rows):
    assert result(ngram_join(frame(odd_rows, clash=True), width=4, percent=85)) == brute(odd_rows, 4, 85)
    assert ngram_join(frame([])).count() == 0


def test_one_of_each(frame):
    rows = corpus(5, 80)
    kept = one_of_each(frame(rows, clash=True))
    assert kept.columns == frame([], clash=True).columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for _, _, c in brute(rows, 5, 80)})


def test_one_of_each_goes_by_rows_and_not_by_ids(frame):
    base = [f"w{k}" for k in range(100)]
    near, nearer = " ".join([*base[:99], "x"]), " ".join([*base[:98], "y", "z"])
    rows = [(1, " ".join(base)), (5, near), (5, "another text that is like no other one"), (None, nearer), (None, near), (None, "a text without an id"), (5, ""), (5, None), (7, near)]
    got = [(r["doc_id"], r["text"]) for r in one_of_each(frame(rows)).collect()]
    assert sorted(got, key=str) == sorted([rows[0], rows[2], rows[5], rows[6], rows[7]], key=str)
    without = [(None, near), (None, nearer), (None, near)]
    assert len(one_of_each(frame(without)).collect()) == 1
    assert one_of_each(frame([])).count() == 0


@pytest.mark.parametrize(("seed", "w", "percent", "rounds"), [(1, 4, 85, 2), (4, 2, 60, 2), (6, 4, 85, 0)])
def test_every_link_is_counted(frame, odd_rows, seed, w, percent, rounds):
    rows = corpus(seed)
    rows += [(2000 + k, t) for k, (_, t) in enumerate(rows[:10])] + [(3000 + k, t) for k, (_, t) in enumerate(odd_rows)]
    got = ngram_join(frame(rows), width=w, percent=percent, rounds=rounds, chunk_bytes=3000, block=(20, 1 << 20))
    assert result(got) == brute(rows, w, percent)
    sets = {i: shingles(t, w) for i, t in rows}
    want = {i: sum(j != i and bool(a & b) and 100 * len(a & b) >= percent * len(a | b) for j, b in sets.items()) for i, a in sets.items()}
    assert {r["doc_id"]: r["n_links"] for r in got.collect()} == want and max(want.values()) > 5


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10**6), st.integers(50, 95), st.integers(1, 30))
def test_answers_of_blocks_follow_from_a_home(seed, percent, columns):
    """Every answer is derived, whatever the home is, and skipping loses none."""
    rng = random.Random(seed)
    x = np.array(rng.sample(range(40), rng.randrange(1, 30)))

    def some(n):
        kept = [[t for t in x.tolist() if rng.random() < 0.9] + rng.sample(range(40, 60), rng.randrange(4)) for _ in range(n)]
        return [np.array(k or [rng.randrange(40)]) for k in kept]

    y, z = some(rng.randrange(1, 8)), some(rng.randrange(1, 8))
    alone = lambda sets: np.array([len(s) + rng.randrange(3) for s in sets])
    ny, nz = alone(y), alone(z)
    links, added = block_links(x, y, ny, z, nz, percent, columns)
    both = [[len(set(a.tolist()) & set(b.tolist())) for b in z] for a in y]
    assert links.tolist() == [[(100 + percent) * o >= percent * int(p + q) for o, q in zip(row, nz)] for row, p in zip(both, ny)]
    assert added.tolist() == [len(set(a.tolist()) - set(x.tolist())) for a in y]


def test_labels_of_links():
    rng = np.random.default_rng(2)
    for _ in range(40):
        links = rng.random((rng.integers(1, 9), rng.integers(1, 9))) < 0.2
        row, col = least_labels(links)
        for i, j in zip(*np.nonzero(links), strict=True):
            assert row[i] == col[j] >= 0
        assert (row[~links.any(1)] == -1).all() and (row <= np.arange(len(row))).all()


def test_both_ways_of_skipping_are_taken(frame, monkeypatch):
    """Groups of near copies are answered inside homes; homes meet in lists, some pairs are skipped for their distance and some compared."""
    counted = {}
    save = Scratch.save

    def counting(self, df, name, by=None):
        out = save(self, df, name, by)
        counted[name] = out
        if name in ("inside", "pairs", "near", "between"):
            counted[name] = out.count()
        return out

    monkeypatch.setattr(Scratch, "save", counting)
    rng = random.Random(3)
    rows, i = [], 0
    for _ in range(6):  # families whose bases share three quarters of their words: no links between most of their members
        base = [f"b{rng.randrange(10**6)}" for _ in range(120)]
        for v in range(3):
            kin = base[: 120 - 9 * v] + [f"k{rng.randrange(10**6)}" for _ in range(9 * v)]
            for _ in range(12):
                t = list(kin)
                for _ in range(rng.choice([1, 2])):
                    t[rng.randrange(120)] = f"n{rng.randrange(50)}"
                rows.append((i := i + 1, " ".join(t)))
    line = [f"c{k}" for k in range(460)]  # a long chain of neighbours, whose ends have nothing in common: no home has all, and some link across homes
    rows += [(1000 + k, " ".join(line[k : k + 120])) for k in range(0, 340, 4)]
    for f in range(8):  # three texts of which any two have a half in common: too little for a home, and they meet in lists without a link
        half = [[f"h{f}.{part}.{k}" for k in range(60)] for part in range(3)]
        rows += [(2000 + 3 * f + part, " ".join(half[part] + half[(part + 1) % 3])) for part in range(3)]
    got = ngram_join(frame(rows), width=2, percent=85, rounds=1)
    assert result(got) == brute(rows, 2, 85)
    assert counted["inside"] > len(rows) and counted["pairs"] > counted["near"] > 0
