import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from kmerloom.llm.lm import Attention, Words, classes_by, hubs_of, lm_score, neighbours, round_of, sliced, summed


def held(i):
    return zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2


def base(rows):
    words = [[*(t or "").encode().lower().split(), None] for _, t in rows]
    count = Counter(w for (i, _), ws in zip(rows, words, strict=True) if not held(i) for w in ws)
    n, v = sum(count.values()), len(count)
    return [(i, held(i), len(ws), sum(count[w] > 0 for w in ws), n, sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws)) for (i, _), ws in zip(rows, words, strict=True)]


@pytest.mark.parametrize("chunk", [8 << 20, 2000])
def test_base_counts_and_score(frame, odd_rows, chunk):
    rng = random.Random(1)
    rows = odd_rows + [(100 + k, " ".join(rng.choices(["the", "cat", "Sat", "on", "a", "mat", f"w{k}"], k=k % 40))) for k in range(150)]
    got = sorted(lm_score(frame(rows, clash=True), steps=60, chunk_bytes=chunk).collect(), key=lambda r: (str(r["doc_id"]), r["n_tokens"]))
    want = sorted(base(rows), key=lambda r: (str(r[0]), r[2]))
    for r, w in zip(got, want, strict=True):
        assert (r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == w[:5]
        assert r["base_score"] == pytest.approx(w[5], rel=1e-9) and r["score"] < 0
    assert lm_score(frame([]), steps=5).count() == 0


def test_model_beats_counts_on_held_out_rows(frame):
    rng = random.Random(2)
    follow = {k: rng.sample(range(30), 2) for k in range(30)}

    def text():
        w, out = rng.randrange(30), []
        for _ in range(60):
            out.append(f"word{chr(97 + w % 26)}{w}")
            w = rng.choice(follow[w])
        return " ".join(out)

    rows = [(k, text()) for k in range(400)]
    out = [r for r in lm_score(frame(rows), steps=600).collect() if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out) + 0.2 * sum(r["n_tokens"] for r in out)


def model():
    rng = np.random.default_rng(0)
    of = rng.integers(0, 5, 40)
    return Attention(40, 5, of, width=8, window=6), rng


def test_gradients():
    m, rng = model()
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    x, y = rng.integers(0, 41, (3, 6)), rng.integers(0, 5, (3, 6))

    def loss():
        return -m.log_of(x, y).mean()

    grads = m.gradients(x, y)
    for name, g in grads.items():
        whole = np.zeros_like(m.p[name])
        if name == "embed":
            whole[g[0]] = g[1]
        else:
            whole = g
        for _ in range(4):
            at = tuple(rng.integers(0, s) for s in whole.shape)
            at = (int(x[0, 0]), at[1]) if name == "embed" else at
            keep = m.p[name][at]
            m.p[name][at] = keep + 1e-5
            up = loss()
            m.p[name][at] = keep - 1e-5
            down = loss()
            m.p[name][at] = keep
            assert whole[at] == pytest.approx((up - down) / 2e-5, abs=2e-4)


def test_each_token_once_and_causally():
    m, rng = model()
    ids = rng.integers(0, 40, 60)
    bounds = np.array([0, 1, 4, 10, 17, 60])
    all_ = m.class_log10(ids, bounds, stride=4, batch=3)
    for k in range(5):
        row = ids[bounds[k] : bounds[k + 1]]
        for t in range(len(row)):  # the window that scores place t starts at the last multiple of 4 at least 2 before it
            start = 0 if t < 6 else (t - 2) // 4 * 4
            x = np.concatenate([[40], row[:-1]])[start : start + 6]
            want = m.log_of(x[None], m.class_of[row[start : start + len(x)]][None])[t - start]
            assert all_[bounds[k] + t] == pytest.approx(want / math.log(10), abs=1e-4)
    changed = ids.copy()
    changed[40:] = 0
    assert np.allclose(m.class_log10(changed, bounds, 4, 3)[:40], all_[:40], atol=1e-5)


def test_classes():
    def classes(ids, n):
        count = np.bincount(ids, minlength=n)
        table = np.bincount(neighbours(ids, hubs_of(count)), minlength=n * 256).reshape(n, 256)
        return classes_by(count, table.astype(np.float32))

    of = classes(np.array([1, 2, 1, 3, 1, 2]), 10)
    assert of[0] == 0 and (of[[1, 2, 3]] > 0).all() and classes(np.zeros(0, np.int64), 4).tolist() == [0] * 4


def test_probabilities_of_all_words_add_up_to_one():
    """A closed vocabulary: every word of one or two of four subwords, half of them seen, the end of the text, and what the tokenizer drops."""
    n_ids = 5
    rng = np.random.default_rng(3)
    m = Attention(n_ids, 3, np.array([0, 1, 1, 2, 2]), width=8, window=8)
    spell = [(a,) for a in range(4)] + [(a, b) for a in range(4) for b in range(4)]
    times = rng.integers(0, 6, len(spell)) * rng.integers(0, 2, len(spell))
    times[0] = 1
    subword, heads, lasts = np.zeros((3, n_ids), np.int64)
    for w, c in zip(spell, times, strict=True):
        heads[w[0]] += c
        lasts[w[-1]] += c
        for x in w:
            subword[x] += c
    ends = 7
    for x in (subword, heads, lasts):
        x[-1] = ends
    words = Words(m, subword, heads, lasts, int(times.sum()) + ends, int((times == 1).sum()))
    before = [2, 0, 1]  # the words so far, one id each

    def after(word, seen):
        ids, size = np.array([*before, *word, 4]), np.array([1, 1, 1, len(word), 1])
        return 10 ** words.log10(ids, size, np.array([0, 5]), np.array([0, 0, 0, seen, ends]))[3]

    end = 10 ** words.log10(np.array([*before, 4]), np.array([1, 1, 1, 1]), np.array([0, 4]), np.array([0, 0, 0, ends]))[3]
    listed = end + after((), 0) + sum(after(w, c) for w, c in zip(spell, times, strict=True))
    # longer words: of every id that does not end the text, the probability of going on, squared and summed by two steps
    longer = 0.0
    deep = 7
    paths = {(a,): None for a in range(4)}
    for n in range(2, deep + 1):
        paths = {(*w, b): None for w in paths for b in range(4)}
        if n > 2 and n <= 5:
            longer += sum(after(w, 0) for w in paths)
        if n == 5:
            break
    assert listed + longer <= 1 + 1e-9
    assert listed + longer > 0.93  # the rest: still longer words, ends inside words, ids that begin no word


@pytest.mark.parametrize("n", [0, 1, 64, 65, 300])
def test_sums_by_parts(spark, n):
    from kmerloom.llm.lm import _PARTS

    rows = [r for k in range(n) for r in sliced(k, [np.array([k, 1.0]), np.array([0.5])]).to_pylist()]
    got = summed(spark.createDataFrame([(r["_slice"], r["_part"], bytearray(r["_sum"])) for r in rows], _PARTS), n)
    assert [x.tolist() for x in got] == ([[n * (n - 1) / 2, n], [n / 2]] if n else [])


def test_rounds_double():
    sizes = np.bincount([round_of(k) for k in range(64)])
    assert sizes.tolist() == [1, 7, 8, 16, 32]


def test_windows_have_every_training_id_once():
    from kmerloom.llm.lm import training_windows

    ids = np.arange(100, 175)
    bounds = np.array([0, 1, 33, 75])
    x, y = training_windows(ids, bounds, 999, 32)
    assert sorted(y[y >= 0].tolist()) == ids.tolist()
    for inputs, follow in zip(x, y, strict=True):
        for a, b in zip(inputs, follow, strict=True):
            assert b < 0 or a == (999 if b - 100 in bounds else b - 1)


@pytest.mark.parametrize("chunk", [8 << 20, 30_000])
def test_long_and_late_texts_are_learned(frame, chunk):
    rng = random.Random(4)
    many = [(k, f"short {k}") for k in range(1600)]
    follow = {k: (7 * k + 3) % 31 for k in range(31)}

    def long(n):  # beyond the 20,000 bytes that once were the longest text to learn from; only long texts have these words
        w, out = rng.randrange(31), []
        for _ in range(n):
            out.append(f"word{chr(97 + w % 26)}{w}")
            w = follow[w] if rng.random() < 0.9 else rng.randrange(31)
        return " ".join(out)

    ids = [k for k in range(5000, 5200) if not held(k)][:12] + [k for k in range(5000, 5200) if held(k)][:2]
    out = [r for r in lm_score(frame(many + [(k, long(4000)) for k in ids]), steps=400, chunk_bytes=chunk).collect() if r["held_out"] and r["doc_id"] >= 5000]
    assert len(out) == 2 and sum(r["score"] - r["base_score"] for r in out) > 0.5 * sum(r["n_tokens"] for r in out)


def test_base_columns_need_no_model(frame, odd_rows, monkeypatch):
    """lm_base learns nothing and has the same columns as op8."""
    from kmerloom.llm import lm, queries

    def fails(*_):
        raise AssertionError("a model was learned")

    want = lm_score(frame(odd_rows), steps=5).drop("score").collect()
    monkeypatch.setattr(lm, "learned", fails)
    monkeypatch.setattr(lm, "word_encoder", fails)
    got = lm_score(frame(odd_rows), learn=False)
    assert got.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score"] and sorted(map(repr, got.collect())) == sorted(map(repr, want))
    assert lm_score(frame([]), learn=False).count() == 0
    assert queries.lm_base(got.sparkSession, "/root/testdata/sf0.001").count() == got.sparkSession.read.parquet("/root/testdata/sf0.001/documents.parquet").count()


def test_places_are_scored_once(monkeypatch):
    """Of windows after a row's first only the places that are used go through the layers, with the same result as in a whole window."""
    m, rng = model()
    ids, bounds = rng.integers(0, 40, 6 + 4 * 10), np.array([0, 46])
    whole = m.log_of(np.append(40, ids[:-1])[np.arange(0, 41, 4)[:, None] + np.arange(6)], m.class_of[ids][np.arange(0, 41, 4)[:, None] + np.arange(6)]).reshape(-1, 6) / np.log(10)
    rows = []
    monkeypatch.setattr(m, "odds", lambda g, f=m.odds: rows.append(len(g)) or f(g))
    got = m.class_log10(ids, bounds, stride=4, batch=3)
    assert np.allclose(got, np.concatenate([whole[0], whole[1:, 2:].reshape(-1)]), atol=1e-5) and sum(rows) == len(ids)
