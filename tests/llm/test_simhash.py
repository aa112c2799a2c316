import random
import re

import pytest
import xxhash
from hard import smallest

from rewardloom.llm import simhash as sh
from rewardloom.llm.components import components


def plain_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups_of(values, distance=4):
    """Smallest member of each value's component, by comparing all pairs."""
    values, parent = sorted(set(values)), {}

    def root(x):
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= distance and root(a) != root(b):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return {v: root(v) for v in values}


def test_components(spark):
    rng = random.Random(4)
    chain = [(k, k + 1) for k in range(100, 160)]
    links = chain + [(500, rng.randrange(501, 600)) for _ in range(80)] + [(7, 7), (9, 8), (9, 8), (160, 3)]
    rng.shuffle(links)
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{k: 3 for k in range(100, 161)}, 3: 3, **{k: 500 for a, b in links if a == 500 for k in (a, b)}, 8: 8, 9: 8}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


@pytest.mark.parametrize("crowded", [4096, 20])
def test_links_connect_what_all_pairs_connect(spark, crowded):
    rng, values = random.Random(5), set()
    for _ in range(6):
        cluster = [rng.getrandbits(64)]
        for _ in range(60):
            x = rng.choice(cluster)
            for b in rng.sample(range(64), rng.randrange(1, 6)):
                x ^= 1 << b
            cluster.append(x)
        values |= set(cluster)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    rows = spark.createDataFrame([(signed(x),) for x in values], "fingerprint long")
    links = sh.fingerprint_links(rows, crowded)
    roots = {r.node: r.root for r in components(links).collect()}
    mine, wanted = {}, {}
    for x, root in groups_of(values).items():
        wanted.setdefault(root, set()).add(x)
        mine.setdefault(roots.get(signed(x), signed(x)), set()).add(x)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, wanted.values()))


def test_groups(hard, nothing):
    rows, df = hard
    got = sh.near_duplicates(df).collect()
    prints = [(r[0], plain_fingerprint(r[1] or "")) for r in rows]
    group = groups_of(p for _, p in prints)
    first = {}
    for doc_id, p in prints:
        if doc_id is not None:
            first[group[p]] = min(first.get(group[p], doc_id), doc_id)
    wanted = [(doc_id, f"{p:016x}", first.get(group[p])) for doc_id, p in prints]
    order = lambda r: (smallest(r[0]), r[1])
    assert sorted(map(tuple, got), key=order) == sorted(wanted, key=order)
    assert sh.near_duplicates(nothing).collect() == []


def test_one_row_of_each_group_stays(hard, nothing):
    rows, df = hard
    kept = sh.keep_representatives(df)
    assert kept.columns == df.columns
    group = groups_of(plain_fingerprint(r[1] or "") for r in rows)
    left = kept.collect()
    assert sorted(group[plain_fingerprint(r.text or "")] for r in left) == sorted(set(group.values()))
    assert {tuple(r)[:5] for r in left} <= set(rows)
    assert sh.keep_representatives(nothing).collect() == []
