import random
from collections import Counter

import numpy as np

from kmerloom.llm.quality import COUNTS, RULES, counts_of, fit, pattern_of, posterior, quality_rules, votes

WS = " \t\n\x0b\x0c\r"


def naive(text):
    text = text or ""
    words = text.encode().split()
    n = len(words)
    windows = Counter(tuple(words[i : i + 5]) for i in range(n - 4))
    covered = {i + j for i in range(n - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(5)}
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if line.strip(WS):
            dup += line in seen
            seen.add(line)
    return n, sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def test_counts(odd_rows):
    rng = random.Random(1)
    texts = [t for _, t in odd_rows] + ["".join(rng.choices(["a", "b", " ", "\n", "é", "#", " "], k=k)) for k in range(120)] + ["a b c d e " * 3, "1 2 3 4 5 x 1 2 3 4 5"]
    for t in texts:
        assert counts_of(t or "")[:5] == naive(t)


def test_long_words_take_linear_time():
    import time

    began = time.monotonic()
    assert counts_of("# " + "x" * 1_000_000 + " a|b")[9] == 2
    assert time.monotonic() - began < 5


def test_verdicts(frame, odd_rows):
    rng = random.Random(2)
    good = [" ".join(rng.choices([f"word{k}" for k in range(400)], k=80)) + "." for _ in range(60)]
    bad = ["$$ ## !! " * 10, "BUY NOW " * 40, "x", "| a | b |\n" * 30]
    rows = [(i, t) for i, t in enumerate(good + bad)]
    got = {r["doc_id"]: r for r in quality_rules(frame(rows, clash=True)).collect()}
    for i, t in rows:
        r = got[i]
        assert tuple(r[c] for c in COUNTS[:5]) == naive(t)
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
        assert r["kept"] == (i < len(good))
    odd = quality_rules(frame(odd_rows, clash=True)).collect()
    assert len(odd) == len(odd_rows) and not any(r["kept"] and r["base_failed"] for r in odd)
    assert quality_rules(frame([])).count() == 0


def test_em_finds_accuracies():
    rng = np.random.default_rng(3)
    y = rng.random(5000) < 0.8
    right = (0.95, 0.9, 0.85, 0.8)
    v = np.stack([np.where(rng.random(5000) < p, y, ~y) * 2 - 1 for p in right], 1)
    share, p = fit(Counter(pattern_of(tuple(r)) for r in v.tolist()), rules="abcd", kinds=["abcd"])
    assert abs(share[-1] - 0.8) < 0.04 and abs(p[1][0, 2] - 0.95) < 0.03
    assert ((posterior(v + 1, share, p) > 0.5) == y).mean() > 0.95
    assert len(votes(counts_of(""))) == len(RULES)
