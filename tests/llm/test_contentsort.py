import hashlib
import re
from collections import defaultdict

from hard import smallest

from rewardloom.llm import contentsort


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def grouped(rows):
    out = defaultdict(list)
    for r in rows:
        out[normal(r[1])].append(r)
    return {k: sorted(v, key=lambda r: (-len(r[1] or ""), smallest(r[0]))) for k, v in out.items()}


def test_groups(hard, nothing):
    rows, df = hard
    got = contentsort.duplicate_groups(df).collect()
    wanted = []
    for content, members in grouped(rows).items():
        digest = hashlib.sha256(content.encode()).hexdigest()
        wanted += [(r[0], members[0][0], len(members), k == 0, digest) for k, r in enumerate(members)]
    assert sorted(map(tuple, got), key=repr) == sorted(wanted, key=repr)
    assert contentsort.duplicate_groups(nothing).collect() == []


def test_one_row_of_each_content_stays(hard, nothing):
    rows, df = hard
    kept = contentsort.keep_distinct(df)
    assert kept.columns == df.columns
    first = [members[0][:2] for members in grouped(rows).values()]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted(first, key=repr)
    assert contentsort.keep_distinct(nothing).collect() == []


def test_hot_content_is_dealt_to_many_tasks(spark):
    rows = spark.range(3000).selectExpr("id AS doc_id", "IF(id % 3 = 0, 'same text', concat('text ', id)) AS text")
    got = contentsort.duplicate_groups(rows)
    assert got.where("group_size = 1000 AND keep_id = 0").count() == 1000
    assert got.where("kept").count() == 2001


def test_neighbours_decide_where_no_content_is_hot(spark):
    """Copies of every number below the bound of a hot content: no group comes from a merge of digests."""
    rows = spark.range(4000).selectExpr("id AS doc_id", "concat('text ', CAST(floor(sqrt(id)) AS INT)) AS text")
    runs = contentsort.content_runs(rows)
    assert runs.where("_hot").isEmpty() and contentsort.merged_heads(runs).isEmpty()
    got = contentsort.duplicate_groups(rows)
    assert got.where("kept").count() == 64 and got.agg({"group_size": "max"}).first()[0] == 125  # 62 * 62 .. 63 * 63 - 1


def test_runs_of_a_hot_content_are_merged(spark, monkeypatch):
    monkeypatch.setattr(contentsort, "HOT_COPIES", 10)
    rows = spark.range(3000).selectExpr("id AS doc_id", "IF(id % 3 = 0, concat('same', repeat(' ', CAST(id % 5 AS INT)), 'text'), concat('text ', id)) AS text")
    runs = contentsort.content_runs(rows)
    assert runs.where("_hot").count() == 1000 and [r._runs for r in contentsort.merged_heads(runs).collect()] == [1000]
    got = contentsort.duplicate_groups(rows)
    assert got.where("group_size = 1000 AND keep_id = 9").count() == 1000 and got.where("kept").count() == 2001
