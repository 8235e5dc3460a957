import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kmerloom.functions.params import SketchParams
from kmerloom.operators import distance as D
from kmerloom.operators import links as L
from kmerloom.operators.sketch import sketch


def texts(n, seed=5):
    r = random.Random(seed)
    parts = ["".join(r.choices("ACGT", k=60)) for _ in range(8)]
    rows = [(f"n{i}", "N".join(r.choices(parts, k=r.randint(1, 4)))) for i in range(n)]
    return [*rows, *((f"copy{i}", rows[0][1]) for i in range(5)), ("none", "ACG")]


@pytest.mark.parametrize("jukes_cantor, limit", [(False, None), (True, None), (False, 0.03)])
def test_sums_of_all_links(spark, monkeypatch, jukes_cantor, limit):
    monkeypatch.setattr(L, "_CLASSES", 7)
    made = sketch(spark.createDataFrame(texts(40), "name string, seq string"), SketchParams(11, 3))
    made = type(made)(made.hashes, made.meta.withColumn("idx", F.xxhash64("name")))
    pairs = D.measured(D.linked_pairs(made), jukes_cantor).where(f"distance < {limit or 2}").collect()
    want = {name: [0, 0, None, None, 0, None, None] for name, _ in texts(40)}
    for p in pairs:
        for name in (p["name_a"], p["name_b"]):
            w, d = want[name], int(np.floor(p["distance"] * 1e6 + 0.5))
            w[0] += 1
            for at, v in ((1, p["sum_su2"]), (4, d)):
                w[at : at + 3] = w[at] + v, v if w[at + 1] is None else min(w[at + 1], v), v if w[at + 2] is None else max(w[at + 2], v)
    rows = L.link_sums(made, ("sum_su2", "distance"), limit, jukes_cantor).collect()
    got = {r["name"]: [x or 0 if i in (1, 4) else x for i, x in enumerate(r[3:])] for r in rows}
    assert got == want and len(rows) == len(want) and got["none"][0] == 0 < got["n0"][0]
    assert len({r["class_idx"] for r in rows if r["name"] == "n0" or r["name"].startswith("copy")}) == 1


@pytest.mark.parametrize("strip", [1, 50, 1 << 20])
@pytest.mark.parametrize("same", [False, True])
def test_strips(monkeypatch, strip, same):
    """Whatever fits a strip, and for a class that fits none."""
    monkeypatch.setattr(L, "_STRIP", strip)
    r = np.random.default_rng(1)

    def block(n, seed):
        sets = [np.sort(r.choice(30, r.integers(0, 12), replace=False)) for _ in range(n)]
        one = {c: np.ones(n, np.int64) for c in ("k", "m", "n", "sum_s", "sum_s2")}
        return L._Block(pa.table({"idx": np.arange(n), **one, "hashes": [x.tolist() for x in sets], "simplicities": pa.array([(x * 7 % 5 + seed).tolist() for x in sets], pa.list_(pa.int32()))}))

    a = block(25, 3)
    b = a if same else block(30, 4)
    want = {}
    for x, h, s in zip(a.owner, a.hash, a.of_hash, strict=True):
        for y, g, t in zip(b.owner, b.hash, b.of_hash, strict=True):
            if h == g and (not same or x > y):
                w = want.setdefault((int(x), int(y)), [0] * 5)
                for i, v in enumerate((1, min(s, t), min(s, t) ** 2, max(s, t), max(s, t) ** 2)):
                    w[i] += int(v)
    got = {(int(p[0]), int(p[1])): [int(v) for v in p[2:]] for part in L._met(a, b, same) for p in zip(*part, strict=True)}
    assert got == want and want


def test_kept_hashes_are_read_back(spark):
    """With keep the totals, and whatever else reads the sketch, come from a table and not from the kernel."""
    made = sketch(spark.createDataFrame(texts(6), "name string, seq string"), SketchParams(11, 3), keep=True)
    plan = made.meta._jdf.queryExecution().toString()
    assert "MapInArrow" not in plan and made.hashes.inputFiles() and made.meta.agg(F.sum("n")).first()[0] == made.hashes.count() > 0


def test_copies_of_a_class_follow_memory():
    """Each class is sent once for every block: classes with few shared hashes, as of 1 GB of documents, make no more blocks than the cores ask for."""
    assert L.block_count(421_350, 10_819_363, 8) == 6
    assert L.block_count(10, 30, 8) == 1 and L.block_count(10, L._ROWS * 9, 8) == 9 and L.block_count(L._CLASSES * 11, 30, 8) == 11
