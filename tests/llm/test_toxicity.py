import os
import random
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

from kmerloom.llm.toxicity import example, label_model, patterns, toxicity, train, without_toxic


def corpus(n=1500, seed=3):
    rng = random.Random(seed)
    plain = [f"{a}{b}{c}" for a in ("ta", "mo", "ri", "su") for b in ("len", "dor", "kip", "van") for c in ("", "a", "es", "ing", "um")]
    rows = []
    for i in range(n):
        words = rng.choices(plain, k=rng.choice([5, 20, 60, 200]))
        bad = rng.random() < 0.12
        for _ in range(rng.choice([1, 2, 4]) if bad else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["scum", "idiot", "zorgle" + rng.choice(["a", "en", "ic", "os", "ut"]), "Zorgle" + rng.choice(["ix", "ab", "ok"])]))
        rows.append((i, " ".join(words), int(bad)))
    return rows


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_held_out_accuracy(spark, frame):
    rows = corpus()
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity(frame([r[:2] for r in rows]), labels).collect()}
    out = [(got[i]["predicted"], y) for i, _, y in rows if held(i)]
    assert all(got[i]["held_out"] == held(i) and 0 <= got[i]["score"] <= 1 and got[i]["predicted"] == (got[i]["score"] >= 0.5) for i, _, _ in rows)
    assert sum(p == y for p, y in out) >= 0.98 * len(out) and sum(p and y for p, y in out) >= 0.95 * sum(y for _, y in out)
    kept = without_toxic(frame([r[:2] for r in rows], clash=True), labels)
    assert kept.columns == frame([], clash=True).columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if not r["predicted"]}


def test_held_out_labels_are_not_used(spark, frame):
    rows = corpus(400)
    docs = frame([r[:2] for r in rows])
    a = toxicity(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    b = toxicity(docs, spark.createDataFrame([(i, 1 - y if held(i) else y) for i, _, y in rows], "doc_id long, toxic int"))
    assert a.orderBy("doc_id").collect() == b.orderBy("doc_id").collect()


@pytest.mark.parametrize("labels", [[], [(1, 1)], [(None, 0), (3, None), (4, 1), (4, 0)]])
def test_odd_rows(spark, frame, odd_rows, labels):
    df = toxicity(frame([*odd_rows, (20, "you idiot, scum")], clash=True), spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = df.collect()
    assert len(got) == len(odd_rows) + 1 and [r["predicted"] for r in got if r["doc_id"] == 20] == [1]
    assert toxicity(frame([]), spark.createDataFrame(labels, "doc_id long, toxic int")).count() == 0


def test_long_texts_are_read_whole(spark, frame):
    """What is toxic at the end of a text of megabytes counts, and length alone does not."""
    rows = corpus(600)
    plain = " ".join(t for _, t, y in rows if not y)
    plain = " ".join([plain] * (3_000_000 // len(plain)))
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    docs = [r[:2] for r in rows] + [(9000, plain), (9001, plain + " you idiot scum" * (len(plain) // 60))]
    got = {r["doc_id"]: r["predicted"] for r in toxicity(frame(docs), labels).where("doc_id >= 9000").collect()}
    assert got == {9000: 0, 9001: 1}


def test_label_model_finds_accuracies():
    rng = np.random.default_rng(1)
    y = rng.random(4000) < 0.2
    right = (0.9, 0.8, 0.75, 0.95)
    votes = np.stack([np.where(rng.random(4000) < p, y, ~y) * 2 - 1 for p in right] + [np.zeros(4000, int)], 1)
    q, p, w = label_model(votes.astype(np.int8), 0.2)
    assert ((q > 0.5) == y).mean() > 0.95 and abs(p[1][0, 2] - 0.9) < 0.06
    copied = np.hstack([votes[:, :1]] * 4 + [votes[:, 1:]]).astype(np.int8)
    _, _, w = label_model(copied, 0.2)
    assert w[0] < 0.5 < w[4]


def test_patterns_see_whole_texts():
    assert patterns("") == (-1, 0, 0, 0, 0)
    assert patterns("A QUIET TEXT IN CAPITAL LETTERS ONLY")[1] == 1 and patterns("x" * 10_000 + "!" * 1_000)[0] == 1
    assert patterns("so f**k it")[2] == 1 and patterns("idioooot")[3] == 1 and patterns("you are a loser")[4] == 1 and patterns("the plain text")[2:] == (0, 0, 0)


def test_labels_that_voters_do_not_contradict_stay():
    """Votes come from other parts of the sample, so chance finds of a row's own label do not overturn others; the posteriors train as well as labels."""
    rows = corpus(3000, 8)
    train_on = [example(y, t) for i, t, y in rows if not held(i)]
    out = {}
    for with_model in (True, False):
        score = train(train_on, with_model=with_model).scorer()
        got = [(score(t) >= 0.5, y) for i, t, y in rows if held(i)]
        out[with_model] = sum(p and y for p, y in got), sum(p and not y for p, y in got)
    assert out[True][0] >= out[False][0] and out[True][1] <= out[False][1]


def test_real_labels_held_out():
    """The posteriors do no worse than the labels themselves on the rows that were never learned from."""
    folder = "/root/testdata/sf0.1"
    if not os.path.isdir(folder):
        pytest.skip("no tables here")
    labels = {r["doc_id"]: r["toxic"] for r in pq.read_table(f"{folder}/labels.parquet").to_pylist()}
    rows = [(r["doc_id"], r["text"] or "", labels[r["doc_id"]]) for r in pq.read_table(f"{folder}/documents.parquet", columns=["doc_id", "text"]).to_pylist() if r["doc_id"] in labels]
    train_on = [example(y, t) for i, t, y in rows if not held(i)]
    out = []
    for with_model in (True, False):
        score = train(train_on, with_model=with_model).scorer()
        got = [(score(t) >= 0.5, y) for i, t, y in rows if held(i)]
        out.append((sum(bool(p and y) for p, y in got), sum(bool(p and not y) for p, y in got)))
    assert out[0][0] >= max(out[1][0], 89) and out[0][1] <= min(out[1][1], 1)


def test_training_without_a_class():
    assert train([example(0, "a b"), example(0, "c")]).scorer()("x") < 0.5 < train([]).scorer()("moron")
