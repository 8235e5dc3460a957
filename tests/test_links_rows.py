"""Sketches made where rows are read, and what link_sums() writes."""

from kmerloom.functions.params import SketchParams
from kmerloom.operators import links as L
from kmerloom.operators.sketch import by_name, sketch, sketch_rows

from .test_links import texts

COLUMNS = ("idx", "name", "k", "n", "sum_s", "sum_s2", "hashes", "simplicities")


def _rows(spark, more=()):
    rows = [(i, *x) for i, x in enumerate([*texts(30), ("null", None), ("empty", ""), *more])]
    return spark.createDataFrame(rows, "idx long, name string, seq string")


def _sorted(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


def test_rows_have_the_same_sketches(spark):
    """Short rows, long rows and rows of one name give what the shuffled sketch gives."""
    p = SketchParams(11, 3)
    for rows, longest in ((_rows(spark), 1 << 18), (_rows(spark), 100), (_rows(spark, [("n0", "ACGTTGCAACGGT"), (None, "ACGTTGCAACGGT")]), 1 << 18)):
        want = _sorted(by_name(sketch(rows, p, names=rows.select("idx", "name"))))
        assert _sorted(sketch_rows(rows, p, longest)) == want and len(want) == rows.count() and max(r[3] for r in want) > 9


def test_blocks_are_written_once(spark, monkeypatch):
    """However many blocks there are, each class and shared hash is in one of them, and pairs of blocks are not shuffled."""
    monkeypatch.setattr(L, "_CLASSES", 5)
    made, kept = L.saved, {}

    def saved(df, what):
        kept[what] = made(df, what)
        return kept[what]

    monkeypatch.setattr(L, "saved", saved)
    sums = L.link_sums(sketch_rows(_rows(spark), SketchParams(11, 3)), ("inter",))
    blocks, classes = kept["links-blocks"].collect(), kept["links-classes"].count()
    assert len(blocks) > 4 and sum(len(r["idx"]) for r in blocks) <= classes == len({x for r in blocks for x in r["idx"]}) + classes - sum(len(r["idx"]) for r in blocks)
    assert sum(len(r["hashes"]) for r in blocks) == kept["links-hashes"].count() == sum(x for r in blocks for x in r["sizes"])
    assert "CartesianProduct" in sums._jdf.queryExecution().executedPlan().toString()
    assert sums.where("n_links > 0").count() > 20


def test_repeated_rows_are_one_sketch(spark):
    """A row that stands twice doubles no hash."""
    rows = _rows(spark)
    twice = rows.union(rows.where("name = 'n1'"))
    found = {(r["name"], r["inter_high"]) for r in L.link_sums(sketch_rows(twice, SketchParams(11, 3)), ("inter",)).collect()}
    n = sketch_rows(rows, SketchParams(11, 3)).where("name = 'n1'").select("n").first()[0]
    assert ("n1", n) in found
