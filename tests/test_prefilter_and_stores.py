import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kmerloom.functions.params import SketchParams
from kmerloom.operators import distance as D
from kmerloom.operators.kmers import kmers
from kmerloom.operators.prefilter import count_sketch, counted, estimated, likely
from kmerloom.operators.sketch import sketch
from kmerloom.sources.store import read_store, write_store

SEQS = "name string, seq string"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 40), max_size=400), st.sampled_from([4, 64, 4096]))
def test_estimates_are_never_low(keys, size):
    keys = np.array(keys, np.uint64)
    cells = np.zeros(size, np.uint8)
    for part in np.array_split(keys, 3):
        counted(cells, part, 4)
    distinct, n = np.unique(keys, return_counts=True)
    assert (estimated(cells, distinct, 4) >= np.minimum(n, 255)).all()
    if size == 4096 and len(distinct):
        assert (estimated(cells, distinct, 4) == np.minimum(n, 255)).mean() > 0.9


def reads(n, errors):
    """Reads of a short genome, of which many have a wrong base: most hashes occur once."""
    rng = random.Random(n)
    genome = "".join(rng.choices("ACGT", k=3000))
    out = []
    for k in range(n):
        at = rng.randrange(2900)
        read = list(genome[at : at + 100])
        for _ in range(errors):
            read[rng.randrange(100)] = rng.choice("ACGT")
        out.append(("ab"[k % 2], "".join(read)))
    return out


@pytest.mark.parametrize("least", [1, 2, 5, 300])
def test_what_is_counted_stays_the_same(spark, least):
    df = spark.createDataFrame([*reads(900, 3), (None, "ACGTACGTTGCA" * 9), ("a", None)], SEQS).repartition(5)
    params = SketchParams(15, 2, min_count=least)
    want = sorted(map(tuple, sketch(df, params).hashes.collect()), key=str)
    for room in (16, 1 << 12, 1 << 22):
        assert sorted(map(tuple, sketch(df, params, prefilter=room).hashes.collect()), key=str) == want


def test_most_rare_hashes_are_not_shuffled(spark):
    df = spark.createDataFrame(reads(900, 10), SEQS).repartition(5)
    found = kmers(df, SketchParams(15, 2))
    left = likely(found, 3, 1 << 20)
    assert left.count() * 2 < found.count() and left.dtypes == found.dtypes
    rare = found.groupBy("name", "hash").count().where("count < 3")
    assert left.join(rare, ["name", "hash"]).count() < 0.02 * rare.count()  # collisions
    assert count_sketch(found.where("false"), 64, 4).sum() == 0


def genomes(prefix, n, seed):
    rng = random.Random(seed)
    base = "".join(random.Random(1).choices("ACGT", k=2000))
    out = []
    for k in range(n):
        seq = list(base)
        for _ in range(60 * k):
            seq[rng.randrange(2000)] = rng.choice("ACGT")
        out.append((f"{prefix}{k}", "".join(seq)))
    return [*out, (f"{prefix}none", "NN")]


def exchanges(df):
    return re.findall(r"Exchange (hashpartitioning|rangepartitioning|SinglePartition)\(?([^,)]*)", df._jdf.queryExecution().executedPlan().toString())


def test_stores_in_buckets_meet_where_they_lie(spark, tmp_path):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        params = SketchParams(15, 4)
        made = [sketch(spark.createDataFrame(genomes(x, 4, s), SEQS), params) for x, s in (("a", 2), ("b", 3))]
        for name, buckets in (("with", 6), ("without", None)):
            for k, one in enumerate(made):
                write_store(one, f"{tmp_path}/{name}{k}", buckets)
            read = [read_store(spark, f"{tmp_path}/{name}{k}") for k in (0, 1)]
            for one, back in zip(made, read):
                assert sorted(map(tuple, one.hashes.select("name", "hash", "s").collect())) == sorted(map(tuple, back.hashes.select("name", "hash", "s").collect()))
            pairs = D.pairs_between(*read)
            assert any("hash#" in column for _, column in exchanges(pairs)) == (buckets is None)
            got = sorted((r["name_a"], r["name_b"], r["shared"], r["total"], round(r["distance"], 9)) for r in D.measured(pairs).collect())
            both = D.measured(D.linked_pairs(sketch(spark.createDataFrame(genomes("a", 4, 2) + genomes("b", 4, 3), SEQS), params)))
            want = sorted((*sorted((r["name_a"], r["name_b"])), r["shared"], r["total"], round(r["distance"], 9)) for r in both.collect() if r["name_a"][0] != r["name_b"][0])
            assert got == want and len(got) == 16
        (one,) = [read_store(spark, f"{tmp_path}/with0")]
        assert not any("hash#" in column for _, column in exchanges(one.hashes.groupBy("hash").agg(F.count("*"))))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_store_is_written_again(spark, tmp_path):
    for k, buckets in enumerate((3, None, 2)):
        one = sketch(spark.createDataFrame(genomes("x", k + 1, k), SEQS), SketchParams(15, 4))
        write_store(one, f"{tmp_path}/s", buckets)
        assert read_store(spark, f"{tmp_path}/s").hashes.count() == one.hashes.count()
    with pytest.raises(ValueError, match="from itself"):
        write_store(read_store(spark, f"{tmp_path}/s"), f"{tmp_path}/s")
    assert read_store(spark, f"{tmp_path}/s").hashes.count() == one.hashes.count()


@pytest.mark.parametrize("limit, k, jukes_cantor", [(0.05, 21, False), (0.3, 11, True)])
def test_near_pairs(spark, limit, k, jukes_cantor):
    """Many sketches that all share a common part, and a few that are near one another."""
    rng = random.Random(k)
    part = "".join(rng.choices("ACGT", k=30))
    rows = [(f"s{x}", part + "".join(rng.choices("ACGT", k=rng.choice([400, 900, 4000])))) for x in range(25)]
    for x in range(10):
        seq = list(rows[x % 3][1])
        for _ in range(4 * x):
            seq[rng.randrange(len(seq))] = rng.choice("ACGT")
        rows.append((f"n{x}", "".join(seq)))
    rows += [("copy", rows[0][1]), ("none", "NN")]
    made = sketch(spark.createDataFrame(rows, SEQS), SketchParams(k, 4))
    columns = ["name_a", "name_b", "inter", "uni", "distance"]
    linked = [tuple(r) for r in D.measured(D.linked_pairs(made), jukes_cantor).select(columns).collect()]
    want = sorted(r for r in linked if r[4] < limit)
    assert sorted(tuple(r) for r in D.near_pairs(made, limit, jukes_cantor).select(columns).collect()) == want and want
    if limit < 0.3:
        assert D.near_candidates(made, limit).count() * 3 < len(linked)


def test_limits_are_checked(spark):
    made = sketch(spark.createDataFrame([("a", "ACGT" * 9)], SEQS), SketchParams(9, 1))
    for bad in (0, 1.5):
        with pytest.raises(ValueError):
            D.near_pairs(made, bad)
    assert D.near_pairs(made, 0.5).count() == 0
