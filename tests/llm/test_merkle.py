import hashlib
import random
import zlib

from hard import frame, smallest

from rewardloom.llm import merkle


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    doc_id, _, lang, source, n_chars = row
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def tree(nodes):
    """The end of a tree and each node's siblings on the way to it, as (left, right) per level."""
    steps = [[] for _ in nodes]
    places = list(range(len(nodes)))
    while len(nodes) > 1:
        for k, at in enumerate(places):
            first = at - at % 8
            steps[k].append(("".join(nodes[first:at]), "".join(nodes[at + 1 : first + 8])))
        nodes = [h(*nodes[i : i + 8]) for i in range(0, len(nodes), 8)]
        places = [at // 8 for at in places]
    return nodes[0], steps


def manifest(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append((smallest(row[0]), leaf(row, row[1]), row))
    langs = sorted(groups, key=lambda lang: (lang is not None, (lang or "").encode()))
    inner = {lang: tree([x[1] for x in sorted(groups[lang], key=lambda x: x[:2])]) for lang in langs}
    root, outer = tree([inner[lang][0] for lang in langs])
    out = []
    for k, lang in enumerate(langs):
        for (_, own, row), steps in zip(sorted(groups[lang], key=lambda x: x[:2]), inner[lang][1]):
            path = steps + outer[k]
            folded = own
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0 and row[1] is not None:
                folded = leaf(row, "".join(c.lower() if "A" <= c <= "Z" else c for c in row[1]))
            for left, right in path:
                folded = h(left, folded, right)
            out.append((row[0], own, inner[lang][0], root, h(*[x for step in path for x in step]), folded, folded == root))
    return sorted(out, key=repr)


def report(df):
    return sorted((tuple(r) for r in merkle.manifest_report(df).collect()), key=repr)


def test_awkward_rows(hard, nothing):
    rows, df = hard
    assert report(df) == manifest(rows)
    assert report(nothing) == []


def test_trees_of_every_shape(spark):
    """Sizes around the powers of a run and of a block, one tree that takes three rounds of blocks of 8, many groups."""
    rng = random.Random(5)
    sizes = {"a": 1, "b": 2, "B": 8, "é": 9, "c": 64, "d": 65, None: 7, "": 3, "big": 700, **{f"g{k}": rng.randrange(1, 4) for k in range(20)}}
    rows = [(k, f"Text {k}", lang, "s", k) for k, lang in enumerate(lang for lang, n in sizes.items() for _ in range(n))]
    rng.shuffle(rows)
    assert report(frame(spark, rows, clashing=False)) == manifest(rows)


def test_small_blocks_give_the_same_digests(spark, monkeypatch):
    rows = [(k, f"Text {k % 50}", "en" if k % 3 else "fr", None, k) for k in range(900)]
    monkeypatch.setattr(merkle, "LEVELS", 1)
    monkeypatch.setattr(merkle, "BLOCK", 8)
    assert report(frame(spark, rows, clashing=False)) == manifest(rows)


def test_one_group_and_one_row(spark):
    for n in (1, 513):
        rows = [(k, "A b", "en", "s", 3) for k in range(n)]
        assert report(frame(spark, rows)) == manifest(rows)


def test_any_change_is_seen(spark):
    rows = [(k, f"text {k}", "en", "s", 3) for k in range(30)]
    before = report(frame(spark, rows))[0][3]
    for k, change in ((3, (3, "text 4", "en", "s", 3)), (9, (9, "text 9", "en", None, 3))):
        assert report(frame(spark, [*rows[:k], change, *rows[k + 1 :]]))[0][3] != before
