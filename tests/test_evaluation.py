import pytest
from pyspark.sql import functions as F

from kmerloom.operators.mutants import mutate, replicas
from kmerloom.plans import evaluation as E
from kmerloom.plans import reports as R


def test_mutants(spark):
    seq = "ACGT" * 250
    df = spark.createDataFrame([("a", seq), ("b", "")], "name string, seq string")
    snp = {r["name"]: r for r in mutate(df, 0.1, indels=False).collect()}
    assert len(snp["a"]["seq"]) == 1000 and sum(x != y for x, y in zip(snp["a"]["seq"], seq, strict=True)) == snp["a"]["n_changed"] == 100
    assert snp["a"]["true_d"] == 0.1
    mixed = {r["name"]: r["seq"] for r in mutate(df, 0.3).collect()}
    assert mixed["a"] == {r["name"]: r["seq"] for r in mutate(df.repartition(3), 0.3).collect()}["a"] and set(mixed["a"]) <= set("ACGT") and mixed["a"] != seq
    assert sorted(r["name"] for r in replicas(df.limit(1), 3).collect()) == ["a_0", "a_1", "a_2"]


def test_mutants_of_long_records(spark, monkeypatch):
    """Pieces and blocks don't show: positions, places and letters are those of the rule, counted base by base."""
    import hashlib
    import random

    monkeypatch.setattr("kmerloom.operators.mutants._PIECE", 37)
    rng = random.Random(1)
    rows = [(f"s{k}", "".join(rng.choices("ACGTacgtN", k=n))) for k, n in enumerate((0, 1, 36, 37, 38, 500))]
    for indels in (False, True):
        got = {r["name"]: (r["seq"], r["n_changed"]) for r in mutate(spark.createDataFrame(rows, "name string, seq string"), 0.4, indels=indels, block=16).collect()}
        for name, seq in rows:
            seq = seq.upper()
            digest = [hashlib.md5(f"{name}:{k}:42".encode()).hexdigest() for k in range(len(seq))]
            chosen = set(sorted(range(len(seq)), key=lambda k: (digest[k], k))[: int(len(seq) * 0.4)])
            out = ""
            for k, base in enumerate(seq):
                if k not in chosen:
                    out += base
                    continue
                draw = lambda at, n, d=digest[k]: int(d[at : at + 8], 16) % n
                kind = draw(16, 20) if indels else 0
                others = [x for x in "ACGT" if x != base]
                out += others[draw(24, 3)] if kind < 18 else "ACGT"[draw(8, 4)] + base if kind == 18 else ""
            if seq:
                assert got[name] == (out, len(chosen))


def test_melt_means_and_labels(spark):
    wide = spark.createDataFrame([("Mash", 21.0, 1.0, None), ("skani", 11.0, float("nan"), 4.0), (None, None, None, None)], "Tool string, k double, `ERR_d=0_1` double, `ERR_d=0_2` double")
    assert E.melt(wide, ["Tool", "k"]).count() == 6
    means = wide.select(E.row_mean(["ERR_d=0_1", "ERR_d=0_2"]).alias("m")).collect()
    assert [r["m"] for r in means] == [1.0, 4.0, None]
    labels = [r["l"] for r in wide.select(E.label(F.col("Tool"), F.col("k")).alias("l")).collect()]
    assert labels == ["Mash", "skani (k=11)", "Unknown"]
    spelled = spark.createDataFrame([("mash ", 21.0), ("FASTANI", None), ("skani", None), ("own", 3.0)], "Tool string, k double")
    assert [r["l"] for r in spelled.select(E.label(F.col("Tool"), F.col("k"), {**E.PLAIN_TOOLS, "own": "Own"}).alias("l")).collect()] == ["Mash", "FastANI", "skani", "Own"]
    order = spark.createDataFrame([(x,) for x in ("zeta", "Mash", "skani (k=21)", "skani (k=5)", "FastANI")], "l string")
    assert [r["l"] for r in order.orderBy(*E.sort_keys(F.col("l"))).collect()] == ["FastANI", "skani (k=5)", "skani (k=21)", "Mash", "zeta"]


def test_ani_and_scores(spark):
    got = {(r["a"], r["b"]): r["dist"] for r in E.ani_symm(spark.createDataFrame([("x", "y", 90.0), ("y", "x", 80.0), ("x", "z", 120.0), ("z", "z", 50.0)], "a string, b string, ani double")).collect()}
    assert got[("x", "y")] == got[("y", "x")] == pytest.approx(0.15) and got[("x", "z")] == got[("z", "x")] == 0 and got[("z", "z")] == 0
    assert set(got) == {(a, b) for a in "xyz" for b in "xyz"} - {("y", "z"), ("z", "y")} and got[("x", "x")] == got[("y", "y")] == 0
    named = E.ani_symm(spark.createDataFrame([("x", "y", 90.0)], "a string, b string, ani double"), names=spark.createDataFrame([("w",), ("x",)], "name string"))
    assert {(r["a"], r["b"]): round(r["dist"], 9) for r in named.collect()} == {("x", "y"): 0.1, ("y", "x"): 0.1, ("x", "x"): 0, ("y", "y"): 0, ("w", "w"): 0}
    both = E.symmetric_closure(spark.createDataFrame([("x", "y", 0.1), ("y", "x", 0.2), ("x", "z", 0.3)], "a string, b string, dist double"))
    assert {(r["a"], r["b"]): r["dist"] for r in both.collect()}[("z", "x")] == 0.3 and both.count() == 4
    expected = spark.createDataFrame([("m", 0.1), ("n", 0.2), ("o", 0.4)], "name string, true_d double")
    predicted = spark.createDataFrame([("ref", "m", 0.12), ("n", "ref", 0.5)], "a string, b string, distance double")
    scores = {r["name"]: r["error"] for r in E.score_accuracy(expected, predicted).collect()}
    assert scores["m"] == pytest.approx(0.02) and scores["n"] is None and scores["o"] is None


def test_clades_and_reports(spark):
    clades = spark.createDataFrame([("c", ["x", "y", "z"]), ("d", ["x", "q"])], "clade string, taxa array<string>")
    have = spark.createDataFrame([("x",), ("y",), ("z",), ("x",)], "name string")
    assert [tuple(r) for r in E.clade_subset(clades, have).collect()] == [("c", ["x", "y", "z"])]
    names = spark.createDataFrame([(0, "p"), (1, "q")], "idx int, name string")
    lines = [r["line"] for r in R.phylip_text(names, spark.createDataFrame([("p", "q", 0.25)], "a string, b string, distance double")).orderBy("line_no").collect()]
    assert lines == ["2", "p 0.000000 0.250000", "q nan 0.000000"]


def test_reading_times(spark, tmp_path):
    (tmp_path / "t.csv").write_text("\ufeffTool,Threads,K-mer,Scale,Sketch,Runtime,Memory\nA,1,21,1000,nan,2.5,2097152\nskani,2,-,nan,nan,1,1024\n", encoding="utf-8")
    rows = [tuple(r) for r in E.derived(E.read_times(spark, str(tmp_path / "t.csv"))).select("Tool", "k_label", "memory_GB", "ReverseScale", "Sketch").orderBy("Runtime").collect()]
    assert rows == [("skani", "N/A", 1024 / 1024**2, None, None), ("A", "21", 2.0, 0.001, None)]


def test_tables_are_written_and_read_again(spark, tmp_path):
    rows = spark.createDataFrame([("genome", 21, "Mash", 1000, "SNP_ONLY", 1.5, 2.5, 0.01, None), ("genome", None, "FastANI", 1000, "SNP_ONLY", 3.0, None, float("nan"), 0.5)],
                                 "Genome string, k int, Tool string, C_rate int, Mode string, t1 double, t2 double, e1 double, e2 double")
    table = E.accuracy_table(rows, [1, 8], [0.1, 0.45])
    E.write_table(table, str(tmp_path / "accuracy"))
    (part,) = (tmp_path / "accuracy").glob("*.csv")
    assert part.read_text().splitlines()[0] == "Genome,k,Tool,C_rate,Mode,Time_N=1,Time_N=8,ERR_d=0.100,ERR_d=0.450"
    assert "genome,-,FastANI,1000,SNP_ONLY,3.0,nan,nan,0.5" in part.read_text()
    again = E.read_accuracy(spark, str(tmp_path / "accuracy"))
    assert again.columns[-2:] == ["ERR_d=0_100", "ERR_d=0_450"]
    assert sorted(map(tuple, again.collect()), key=str) == sorted([("genome", 21.0, "Mash", 1000.0, "SNP_ONLY", 1.5, 2.5, 0.01, None), ("genome", None, "FastANI", 1000.0, "SNP_ONLY", 3.0, None, None, 0.5)], key=str)
    assert E.melt(again, ["Tool", "k"]).where("Err is not null").count() == 2
    trees = spark.createDataFrame([("Mash", "All", 21, 4.0, 0.25), ("Mash", "Rosid", 21, None, None)], "Tool string, Taxon string, K int, RF double, nRF double")
    E.write_table(E.tree_table(trees), str(tmp_path / "trees"))
    (part,) = (tmp_path / "trees").glob("*.csv")
    assert part.read_text().splitlines() == ["Tool,Taxon,K,RF,nRF", "mash,All,21,4.0,0.25", "mash,Rosid,21,NaN,NaN"]
    assert sorted(map(tuple, E.read_trees(spark, str(tmp_path / "trees")).collect())) == [("mash", "All", 21, 4.0, 0.25, None, None), ("mash", "Rosid", 21, None, None, None, None)]
    (tmp_path / "more.csv").write_text("Tool,Taxon,K,RF,nRF,Scale,Sketch\nMash,All,21,2,0.5,nan,10000\n")
    assert [tuple(r) for r in E.read_trees(spark, str(tmp_path / "more.csv")).collect()] == [("Mash", "All", 21, 2.0, 0.5, None, 10000.0)]
    runs = spark.createDataFrame([("Mash", 4, 21, 1000, 1.234, 2048), ("FastANI", 1, None, None, 60.0, 99)], "t string, p int, k int, s int, e double, m int")
    assert [tuple(r) for r in E.run_table(runs).collect()] == [("mash", "4", "21", "1000", "1.23", "2048"), ("fastani", "1", "-", "-", "60.00", "99")]


def test_length_of_a_file(spark):
    texts = [(">a b\r\n ACGT \r\nAC\n>second\nGG", 4 + 2 + 7 + 2), (">only a header", 0), ("", 0), (">a\n\n\nA", 1)]
    df = spark.createDataFrame(texts, "content string, n long")
    assert [r["m"] for r in df.select(E.file_length(F.col("content")).alias("m")).collect()] == [n for _, n in texts]
