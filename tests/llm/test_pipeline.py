import re
from pathlib import Path

import pytest

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark, hard, nothing):
    import corpus_pipeline
    from test_contentsort import normal

    from rewardloom.session import stage

    rows, df = hard
    kept, counts = df, []
    for name, step in corpus_pipeline.STAGES:
        before = kept
        kept = stage(step(spark, kept, FOLDER), "test-stage")
        counts.append(kept.count())
        if name != "best_fit_packing":
            assert kept.columns == df.columns
        if name == "language_id":
            assert {r.text for r in before.select("text").distinct().collect()} - {r.text for r in kept.collect()} >= {None, "", "12 34 --"}
        if name == "exact_dedup":
            assert len({normal(r.text) for r in before.collect()}) == counts[-1]
        if name == "simhash_dedup":
            assert counts[-1] <= counts[-2]
    for name, step in corpus_pipeline.STAGES:
        assert step(spark, nothing, FOLDER).collect() == []


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="test tables are not here")
def test_run_and_registration(spark):
    import __spark_entry__ as entry
    import corpus_pipeline

    out = corpus_pipeline.run(spark, FOLDER)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert out.count() > 0
    names = entry.queries()
    assert "pipeline" in names and {int(m[1]) for n in names if (m := re.match(r"op(\d+)_", n))} == set(range(1, 14))


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="test tables are not here")
def test_queries_with_sql_agree(spark):
    from check import compare, connect

    from rewardloom.llm.queries import QUERIES, SQL

    duck = connect(FOLDER)
    for name, sql in SQL.items():
        df = QUERIES[name](spark, FOLDER)
        rows = [tuple(r) for r in df.collect()]
        cursor = duck.execute(sql)
        assert compare(df.columns, rows, [d[0] for d in cursor.description], cursor.fetchall()) == "", name
