import os

import pytest

pytest.importorskip("corpus_pipeline")
import corpus_pipeline  # noqa: E402
from kmerloom.llm.queries import ORACLE_SQL, QUERIES  # noqa: E402

from .conftest import table  # noqa: E402

DATA = "/root/testdata/sf0.001"


def test_stages_on_a_small_corpus(spark, frame, tmp_path):
    base = " ".join(f"w{k}" for k in range(120))
    near = base.replace("w60 ", "q ")
    rows = [(i, f"plain text number {i} " + " ".join(f"p{i}.{k}" for k in range(30)), "ab"[i % 2]) for i in range(40)]
    rows += [(100, base, "a"), (101, base + " ", "b"), (102, near, "a"), (103, "you idiot scum moron " + base[::-1], "a")]
    frame(rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, 0)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, seen = frame(rows), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, str(tmp_path)).collect(), docs.schema)
        seen.append((name, {r["doc_id"] for r in docs.collect()}))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = set(range(40)) | {100, 101, 102}
    assert seen[0] == ("toxicity", ids) and seen[1] == ("exact dedup", ids - {100})  # 101 is the longer of the two
    assert seen[2] == ("n-gram join", ids - {100, 102}) and seen[3][1] <= seen[2][1]
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in packed} == seen[3][1] and max(r["sequence_id"] for r in packed) >= 0


@pytest.mark.parametrize("rows", ["odd", "none"])
def test_stages_on_odd_rows_and_none(spark, frame, odd_rows, tmp_path, rows):
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = frame(odd_rows if rows == "odd" else [], clash=True)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), docs.schema)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count() and (rows == "odd") == (packed.count() > 0)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the tables are not here")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_over_whole_tables(spark, name):
    import duckdb

    df = QUERIES[name](spark, DATA)
    got = table(df)
    of, key = ("conversations", "conv_id") if name == "op13_prefix_trie" else ("documents", "doc_id")
    n = duckdb.sql(f"select count(distinct {key}) from '{DATA}/{of}.parquet'").fetchall()[0][0]
    assert name == "op13_prefix_trie" or len({r[key] for r in df.select(key).collect()}) == n
    if name in ORACLE_SQL:
        for t in ("documents", "benchmark", "conversations"):
            duckdb.sql(f"create or replace view {t} as select * from '{DATA}/{t}.parquet'")
        sql = duckdb.sql(ORACLE_SQL[name])
        rows = [tuple(r[sql.columns.index(c)] for c in sorted(sql.columns)) for r in sql.fetchall()]
        assert sorted(sql.columns) == sorted(df.columns) and got == sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))
