import gzip
import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kmerloom.sources.ranges import Range, chained, cut, first_member, open_file, planned, text_from, walked, is_packed
from kmerloom.sources.sequences import BadRecord, Scan, Stream, lenient, parse, read_sequences, unpacked


def serial(path):
    with open(path, "rb") as f:
        return list(parse(unpacked([f.read()])))


def by_ranges(path, split, step=1 << 20):
    """(records of all ranges in order, ranges, walks that a wrong guess cost) as planned and read_ranges do it."""
    with open(path, "rb") as f:
        size = len(f.read())
    ranges, todo, again = cut(path, size, split), list(range(-(-max(size, 1) // split))), 0
    while todo:
        for k in todo:
            ranges[k] = walked(ranges[k], step)
        _, wrong = chained(ranges)
        todo = []
        if wrong:
            ranges[wrong.k], todo, again = wrong, [wrong.k], again + 1
    done, got = chained(ranges)[0], []
    for r in done:
        if r.count or r.bad:
            with open_file(path) as file:
                own = [(h, s, q) for _, h, s, q in lenient(Scan(Stream(text_from(file, (r.member, r.inner), is_packed(file), step)), r.stop), False)]
            assert len(own) == r.count and r.first == len(got)
            got += own
    return got, done, again


def plain(records):
    return [((name + " " + comment if comment else name).encode(), seq.encode("latin-1"), None if qual is None else qual.encode("latin-1")) for name, comment, seq, qual in records]


def fastq(rng, n, several=False):
    """Records whose quality lines look like anything else, @ and + and > first of all."""
    out = []
    for k in range(n):
        seq = "".join(rng.choices("ACGTN", k=rng.choice([0, 1, 2, 30, 150])))
        qual = "".join(rng.choices("@+>I#", k=len(seq)))
        if several and len(seq) > 4:
            cut = rng.randrange(1, len(seq))
            out.append(f"@r{k} c\n{seq[:cut]}\n{seq[cut:]}\n+\n{qual[:cut]}\n{qual[cut:]}\n")
        else:
            out.append(f"@r{k} c\n{seq}\n+{rng.choice(['', '@x'])}\n{qual}\n")
    return "".join(out).encode()


@pytest.mark.parametrize("several", [False, True])
@pytest.mark.parametrize("split", [1 << 10, 1 << 14, 1 << 20])
def test_fastq_split_anywhere(tmp_path, several, split):
    path = str(tmp_path / "a.fq")
    rng = random.Random(split)
    with open(path, "wb") as f:
        f.write(fastq(rng, {1 << 10: 600, 1 << 14: 3000}.get(split, 12_000), several))
    got, done, again = by_ranges(path, split)
    assert got == plain(serial(path)) and sum(1 for r in done if r.count) > 1
    assert several or again == 0  # records of four lines are never guessed wrong


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from([b">", b"@", b"+", b"\n", b"\r\n", b"a", b"ACGT", b" ", b"II", b">n c\nAC\n", b"@q\nAC\n+\nI@\n", b"junk", b"@a\n\n+\n\n"]), max_size=40), st.integers(1, 30), st.integers(1, 9), st.booleans())
def test_any_bytes_are_read_as_from_the_start(tmp_path_factory, parts, split, step, packed):
    data = b"".join(parts)
    path = str(tmp_path_factory.mktemp("r") / "x")
    with open(path, "wb") as f:
        cut = len(data) // 3
        f.write(b"".join(map(gzip.compress, (data[:cut], data[cut : 2 * cut], data[2 * cut :]))) if packed else data)
    want = [(h, s, q) for _, h, s, q in lenient(Scan(Stream([((0, -1), data)])), False)]
    assert by_ranges(path, split, step)[0] == want


def members_of(data, rng, least, most):
    at, out = 0, []
    while at < len(data):
        n = rng.randrange(least, most)
        out.append(gzip.compress(data[at : at + n], 1))
        at += n
    return out


@pytest.mark.parametrize("form", ["fasta", "fastq"])
def test_members_are_found_and_split(tmp_path, form):
    rng = random.Random(7)
    data = fastq(rng, 5000) if form == "fastq" else "".join(f">r{k} x\n{''.join(rng.choices('ACGT', k=rng.choice([0, 60, 5000])))}\n" for k in range(400)).encode()
    parts = members_of(data, rng, 20_000, 60_000)
    path = str(tmp_path / "a.gz")
    with open(path, "wb") as f:
        f.write(b"".join(parts))
    starts = [sum(map(len, parts[:k])) for k in range(len(parts))]
    with open_file(path) as file:
        assert [first_member(file, a + 1, starts[-1] + 9, 1000) for a in starts[:-1]] == starts[1:]
    got, done, again = by_ranges(path, 1 << 15)
    assert got == plain(serial(path)) and sum(1 for r in done if r.count) >= 4 and again <= (form == "fasta") * len(done)


def test_one_member_stays_in_one_range(tmp_path):
    path = str(tmp_path / "a.gz")
    inner = gzip.compress(b"@fake\nA\n+\nI\n")  # a member's bytes inside a record, stored as they are
    data = b">a\n" + inner.replace(b"\n", b"x") * 50 + b"\n>b\nAC\n"
    deflate = zlib.compressobj(0, zlib.DEFLATED, 31)
    with open(path, "wb") as f:
        f.write(deflate.compress(data) + deflate.flush())
    got, done, again = by_ranges(path, 100)
    assert got == [(h, s, q) for _, h, s, q in Scan(Stream([((0, -1), data)]))]
    assert [r.k for r in done if r.count] == [0] and first_member(open_file(path), 10, 10**6, 1 << 16)  # it has what looks like members


def test_reading_a_bad_record_stops_the_file(spark, tmp_path):
    good = b"@a long name\nACGT\n+\nIIII\n"
    (tmp_path / "bad.fq").write_bytes(good * 100 + b"@b\nACGT\n+\nII\n" + good * 100)
    (tmp_path / "good.fq").write_bytes(good * 100)
    got = read_sequences(spark, str(tmp_path), whole_up_to=10, split=200)
    assert sorted((r["path"].rsplit("/", 1)[1], r["n"], r["top"]) for r in got.groupBy("path").agg(F.count("*").alias("n"), F.max("rec_idx").alias("top")).collect()) == [("bad.fq", 100, 99), ("good.fq", 100, 99)]
    with pytest.raises(Exception, match="quality of b has 14"):
        read_sequences(spark, str(tmp_path), whole_up_to=10, split=200, mode="FAILFAST").count()


def test_every_range_has_a_task_of_its_own(spark, tmp_path):
    rng = random.Random(5)
    for k in range(3):
        (tmp_path / f"{k}.fq").write_bytes(fastq(rng, 400))
    (tmp_path / "g.fq.gz").write_bytes(b"".join(members_of(fastq(rng, 4000), rng, 20_000, 40_000)))
    small = read_sequences(spark, str(tmp_path)).orderBy("path", "rec_idx").collect()
    got = read_sequences(spark, str(tmp_path), whole_up_to=1000, split=20_000)
    assert got.orderBy("path", "rec_idx").collect() == small
    tasks = got.withColumn("task", F.spark_partition_id()).groupBy("path").agg(F.countDistinct("task").alias("n"), F.collect_set("task").alias("tasks")).collect()
    assert all(r["n"] >= (4 if "gz" in r["path"] else 2) for r in tasks) and len({t for r in tasks for t in r["tasks"]}) == sum(r["n"] for r in tasks)
    ranges = planned(spark, [(f"file:{tmp_path}/0.fq", (tmp_path / "0.fq").stat().st_size)], 20_000, 1 << 20)
    assert [r.first for r in ranges] == [sum(x.count for x in ranges[:k]) for k in range(len(ranges))]


def test_only_what_is_asked_for(spark, tmp_path):
    (tmp_path / "a.fq").write_bytes(b"@a x\nACGT\n+\nIIII\n" * 30)
    for limit in (1 << 20, 10):
        got = read_sequences(spark, str(tmp_path), columns=("length", "name"), whole_up_to=limit, split=100)
        assert got.columns == ["length", "name"] and [tuple(r) for r in got.collect()] == [(4, "a")] * 30
    with pytest.raises(ValueError, match="no such column"):
        read_sequences(spark, str(tmp_path), columns=("bases",))
    assert Range("p", 0, 0, 1).count == 0 and issubclass(BadRecord, ValueError)
