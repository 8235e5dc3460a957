import gzip
import random

import pytest
from hypothesis import given
from hypothesis import strategies as st

from kmerloom.sources.sequences import BadRecord, fasta_text, is_sequence_file, opened, parse, parse_texts, read_fasta_lines, read_sequences, unpacked


def test_fasta_forms():
    data = b"; junk\r\n>one first  comment\r\nACGT\r\n\r\nac gt\r\n>two\nNNN\n>three\n"
    assert list(parse(data)) == [("one", "first  comment", "ACGTac gt", None), ("two", "", "NNN", None), ("three", "", "", None)]
    assert list(parse(b"")) == [] and list(parse(b"no record")) == []
    assert list(parse(b"junk >a\nAC\n")) == [("a", "", "AC", None)]


def test_fastq_forms():
    data = b"@r1 x\nACGT\nAC\n+ again\n@@+I\n>I\n@r2\nA\n+\n@\n"
    assert list(parse(data)) == [("r1", "x", "ACGTAC", "@@+I>I"), ("r2", "", "A", "@")]
    cut = b"@a\nAC\n+\nII\n@b\nACGT\n+\nII\n"
    assert [r[0] for r in parse(cut)] == ["a"]
    with pytest.raises(BadRecord):
        list(parse(cut, strict=True))


def test_gzip_goes_by_content(tmp_path):
    packed = gzip.compress(b">a\nACGT\n" * 50)
    assert opened(packed) == b">a\nACGT\n" * 50 and opened(b">a") == b">a"
    assert opened(packed[: len(packed) // 2]) == opened(packed[: len(packed) // 2])  # a damaged end is no error


def test_reading_files(spark, tmp_path):
    (tmp_path / "a.fa").write_bytes(b">x c\nACGT\nAC\n>y\nGG\n")
    (tmp_path / "b.dat").write_bytes(gzip.compress(b"@q\nAC\n+\nII\n"))
    (tmp_path / "e.fa").write_bytes(b"")
    got = read_sequences(spark, str(tmp_path)).orderBy("path", "rec_idx").collect()
    assert [(r["rec_idx"], r["name"], r["comment"], r["seq"], r["qual"]) for r in got] == [(0, "x", "c", "ACGTAC", None), (1, "y", "", "GG", None), (0, "q", "", "AC", "II")]
    lines = read_fasta_lines(spark, str(tmp_path / "a.fa")).orderBy("name").collect()
    assert [(r["name"], r["comment"], r["seq"]) for r in lines] == [("x", "c", "ACGTAC"), ("y", "", "GG")]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        read_sequences(spark, str(tmp_path / "none.fa")).count()
    with pytest.raises(ValueError):
        read_sequences(spark, str(tmp_path), mode="DROP")


def test_write_and_read_again(spark):
    df = spark.createDataFrame([("a", "ACGT"), ("b", "")], "name string, seq string")
    text = "\n".join(r["value"] for r in fasta_text(df).collect())
    back = parse_texts(spark.createDataFrame([("p", text)], "path string, content string"))
    assert [(r["name"], r["seq"]) for r in back.collect()] == [("a", "ACGT"), ("b", "")]


def test_endings():
    assert is_sequence_file("x/A.FASTQ.gz") and is_sequence_file("a.fa") and not is_sequence_file("a.sketch")


DATA = b"; junk\r\n>one first  comment\r\nACGT\r\n\r\nac gt\r\n>two\nNNN\n@r1 x\nACGT\nAC\n+ again\n@@+I\n>I\njunk@r2\nA\n+\n@\n>end\nAC"


@given(st.lists(st.sampled_from([b">", b"@", b"+", b"\n", b"\r\n", b"a", b"ACGT", b" ", b"II", b">n c\nAC\n", b"@q\nAC\n+\nI@\n"]), max_size=25), st.integers(1, 9))
def test_a_stream_is_read_as_its_bytes_are(parts, step):
    for data in (b"".join(parts), DATA):
        chunks = [data[k : k + step] for k in range(0, len(data), step)]
        assert list(parse(chunks)) == list(parse(data))
        packed = gzip.compress(data[: len(data) // 2]) + gzip.compress(data[len(data) // 2 :]) + b"\0\0"
        assert b"".join(unpacked([packed[k : k + step] for k in range(0, len(packed), step)])) == data
        cut = packed[: len(packed) * 2 // 3]
        assert data.startswith(b"".join(unpacked([cut[k : k + step] for k in range(0, len(cut), step)])))


def test_large_files_are_streamed(spark, tmp_path):
    """A FASTQ above the limit, in several gzip members and with several lines a record, gives what a small one gives."""
    rng = random.Random(3)
    want = []
    with open(tmp_path / "big.fq.gz", "wb") as f:
        for part in range(3):
            text = []
            for k in range(4000):
                seq = "".join(rng.choices("ACGTN", k=rng.randrange(1, 300)))
                qual = "".join(rng.choices("@+>I#", k=len(seq)))
                want.append((f"r{part}.{k}", seq, qual))
                cut = rng.randrange(len(seq))
                text.append(f"@r{part}.{k} c\n{seq[:cut]}\n{seq[cut:]}\n+\n{qual[:cut]}\n{qual[cut:]}\n" if 0 < cut and qual[cut] != "" else f"@r{part}.{k} c\n{seq}\n+\n{qual}\n")
            f.write(gzip.compress("".join(text).encode()))
    (tmp_path / "small.fa").write_bytes(b">s\nACGT\n")
    small = read_sequences(spark, str(tmp_path)).orderBy("path", "rec_idx").collect()
    streamed = read_sequences(spark, str(tmp_path), whole_up_to=100, step=1000).orderBy("path", "rec_idx").collect()
    assert small == streamed and [(r["name"], r["seq"], r["qual"]) for r in streamed[:-1]] == want
    (tmp_path / "bad.fq").write_bytes(b"@a\nAC\n+\nII\n" * 50 + b"@b\nACGT\n+\nII\n")
    assert read_sequences(spark, str(tmp_path / "bad.fq"), whole_up_to=10).count() == 50
    with pytest.raises(Exception, match="quality of b"):
        read_sequences(spark, str(tmp_path / "bad.fq"), whole_up_to=10, mode="FAILFAST").count()


def test_streaming_holds_little():
    import tracemalloc

    record = b"@r\n" + b"ACGT" * 50 + b"\n+\n" + b"I" * 200 + b"\n"
    packed = gzip.compress(record * 2000)  # 800 KB; as many members as make 160 MB
    tracemalloc.start()
    n = sum(1 for _ in parse(unpacked(packed for _ in range(200))))
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert n == 400_000 and peak < 40 << 20
