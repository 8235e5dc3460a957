import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from kmerloom.functions import columns as C
from kmerloom.operators import kmers as K
from kmerloom.plans.queries import QUERIES

SEQS = "name string, seq string"


def odd_texts():
    r = random.Random(3)
    rows = [(f"n{i}", "".join(r.choices("ACGTacgtN é", [9] * 4 + [2] * 4 + [1, 0.3, 0.3], k=r.randint(0, 400)))) for i in range(30)]
    return [*rows, ("none", None), (None, "ACGTACGTACGTTTGACA"), ("long", "".join(r.choices("ACGT", k=3000)))]


@pytest.mark.parametrize("column, made", [("code", C.kmer_code), ("rc", C.revcomp), ("canonical", C.canonical), ("s", C.simplicity)])
@pytest.mark.parametrize("k", [1, 11, 21])
def test_each_window_is_the_same_as_columns(spark, column, made, k):
    df = spark.createDataFrame(odd_texts(), SEQS)
    want = Counter(map(tuple, K.windows(df, k).select("name", "kmer", made(F.col("kmer"))).collect()))
    got = K.each_window(df, k, column, batch_bases=200)
    assert Counter(map(tuple, got.collect())) == want and got.columns == ["name", "kmer", column]


def test_k_of_each_window(spark):
    with pytest.raises(ValueError):
        K.each_window(spark.createDataFrame(odd_texts(), SEQS), 22, "code")


@pytest.mark.parametrize("name", ["kmer_code", "revcomp", "canonical", "simplicity"])
def test_window_queries_return_every_window(spark, name):
    """A row per window with its document's name, not one per k-mer or document."""
    df = QUERIES[name](spark, "/root/testdata/sf0.001")
    assert df.columns[:2] == ["name", "kmer"]
    k = df.select(F.length("kmer")).first()[0]
    text = F.regexp_extract_all(F.translate("text", "".join(map(chr, range(97, 123))) + "".join(map(chr, range(65, 91))) + " ", ("ACGT" * 14)[:53]), F.lit("[ACGT]+"), F.lit(0))
    runs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.explode(text).alias("run"))
    assert df.count() == runs.agg(F.sum(F.greatest(F.length("run") - (k - 1), F.lit(0)))).first()[0]
