import gzip
import random

import pytest

from kmerloom.sources.datasource import FastaSource, SequenceReader, listed, register
from kmerloom.sources.sequences import read_sequences

from .test_ranges import fastq, members_of


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    register(spark)
    folder = tmp_path_factory.mktemp("reads")
    rng = random.Random(11)
    (folder / "a.fq").write_bytes(fastq(rng, 900))
    (folder / "b.fq.gz").write_bytes(b"".join(members_of(fastq(rng, 3000), rng, 20_000, 40_000)))
    (folder / "c.fq.gz").write_bytes(gzip.compress(fastq(rng, 500)))
    (folder / "_hidden.fq").write_bytes(b"@x\nA\n+\nI\n")
    return folder


def test_it_reads_what_the_reader_reads(spark, folder):
    want = read_sequences(spark, f"{folder}/*.fq*", columns=("path", "name", "comment", "seq", "qual")).where("path not like '%hidden%'").orderBy("path", "name", "seq").collect()
    for split in (0, 20_000):
        df = spark.read.format("fastq").option("split", split).schema("path string, name string, comment string, seq string, qual string").load(str(folder))
        assert df.orderBy("path", "name", "seq").collect() == want
        assert df.rdd.getNumPartitions() == 3 if not split else df.rdd.getNumPartitions() > 6


def test_conditions_reach_the_files(spark, folder):
    df = spark.read.format("sequences").schema("path string, length long").load(f"{folder}/*").where("length >= 30 AND length < 150 AND path LIKE '%/a.fq' AND length % 2 = 0")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert df.rdd.getNumPartitions() == 1 and "qual" not in plan and ">= 30" not in plan and "% 2" in plan
    want = read_sequences(spark, f"{folder}/a.fq", columns=("path", "length")).where("length >= 30 AND length < 150 AND length % 2 = 0")
    assert sorted(df.collect()) == sorted(want.collect()) and want.count()


def test_quality_is_not_made_unless_asked_for(monkeypatch, folder):
    from pyspark.sql.types import StructType

    reader = SequenceReader(StructType.fromDDL("name string, length long"), {"path": f"{folder}/a.fq"})
    (part,) = reader.partitions()
    batch = next(reader.read(part))
    assert batch.schema.names == ["name", "length"]
    with pytest.raises(ValueError, match="no such column"):
        SequenceReader(StructType.fromDDL("bases string"), {})
    with pytest.raises(ValueError, match="is not a"):
        SequenceReader(StructType.fromDDL("length string"), {})


def test_a_file_that_no_guess_fits_is_an_error_unless_whole(spark, tmp_path):
    register(spark)
    (tmp_path / "x.fq").write_bytes(b"@a\nAC\n+\nII\njunk@b\nAC\n+\nII\n" * 200)  # records that begin inside lines
    df = spark.read.format("fastq").schema("name string").load(str(tmp_path))
    assert df.count() == 400
    with pytest.raises(Exception, match="option split"):
        spark.read.format("fastq").option("split", 500).schema("name string").load(str(tmp_path)).count()
    assert read_sequences(spark, str(tmp_path), whole_up_to=10, split=500).count() == 400


def test_listing(folder, tmp_path):
    names = [p.rsplit("/", 1)[1] for p, _ in listed(str(folder))]
    assert names == ["a.fq", "b.fq.gz", "c.fq.gz"] == [p.rsplit("/", 1)[1] for p, _ in listed(f"file:{folder}/?.fq*")]
    assert listed(f"{folder}/a.fq") == [(f"file:{folder}/a.fq", (folder / "a.fq").stat().st_size)]
    for bad in (f"{folder}/none.fq", f"{folder}/*.none", str(tmp_path)):
        with pytest.raises(FileNotFoundError):
            listed(bad)
    assert "qual" not in FastaSource({}).schema()
