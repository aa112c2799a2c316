import math
import re
from collections import defaultdict

import pytest
from hard import smallest

from rewardloom.llm import mixture


def plain_targets(sizes, cap=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + k % 3 for k, s in enumerate(order)}
    target, open_, rest = {}, set(order), sum(sizes.values())
    while open_:
        level = rest / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > cap * sizes[s] + 1e-9}
        if not full:
            return target | {s: level * weight[s] for s in open_}
        for s in full:
            target[s] = cap * sizes[s]
            rest -= target[s]
        open_ -= full
    return target


def size_of(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_targets_stop_and_reshare(spark):
    for sizes in ({"a": 10, "b": 0, "c": 500, "d": 40, None: 3}, {"a": 5}, {"x": 1, "y": 1, "z": 10**6}, {"a": 0, "b": 0}):
        rows = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r.source: r.target for r in mixture.source_targets(rows).collect()}
        assert got == pytest.approx(plain_targets(sizes))


def test_report(hard, nothing):
    rows, df = hard
    got = mixture.mix_report(df).collect()
    assert sorted(((r.doc_id, r.size) for r in got), key=lambda r: (smallest(r[0]), r[1])) == sorted(
        ((r[0], size_of(r[1])) for r in rows), key=lambda r: (smallest(r[0]), r[1])
    )
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += size_of(r[1])
    wanted = plain_targets(sizes)
    assert {(r.source_size, round(r.target, 6)) for r in got} == {(sizes[s], round(wanted[s], 6)) for s in sizes}
    taken, most = defaultdict(int), defaultdict(int)
    for r in got:
        assert r.taken <= 3 * r.size and (not r.size or r.taken % r.size == 0)
        taken[r.source_size] += r.taken
        most[r.source_size] = max(most[r.source_size], r.size)
    for s in sizes:
        assert abs(taken[sizes[s]] - wanted[s]) <= most[sizes[s]] * math.ceil(wanted[s] / max(1, sizes[s])) + 1
    assert sorted(map(tuple, mixture.mix_report(df.repartition(5)).collect()), key=repr) == sorted(map(tuple, got), key=repr)
    assert mixture.mix_report(nothing).collect() == []


def test_mixed_rows_are_repeated_whole(hard, nothing):
    rows, df = hard
    mixed = mixture.mix(df)
    assert mixed.columns == df.columns
    words = sum(size_of(r.text) for r in mixed.collect())
    assert words == sum(r.taken for r in mixture.mix_report(df).collect())
    assert mixture.mix(nothing).collect() == []
