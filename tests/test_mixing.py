"""Ranking, mixing, splitting, sampling plans, held-out check."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from rewardloom import session
from rewardloom.config import MixConfig, SamplingConfig, TaskSource
from rewardloom.operators import expand, leak, mix, rank
from rewardloom.operators.rank import hash_key, id_key, keep_first, with_rank
from rewardloom.sources.datasets import load_mix, read_source


def md5_order(seed, ids):
    return sorted(ids, key=lambda i: hashlib.md5(f"{seed}:{i}".encode()).hexdigest())


def test_rank_does_not_depend_on_partitions(spark):
    ids = spark.range(3000)
    expected = {i: k for k, i in enumerate(md5_order(5, range(3000)))}
    for df in (ids.repartition(1), ids.repartition(13)):
        got = {r.id: r.rank for r in with_rank(df, hash_key(5, "id")).collect()}
        assert got == expected


def test_id_key_keeps_signed_order(spark):
    values = [-(2**63), -5, -1, 0, 1, 9, 2**40, 2**63 - 1]
    df = spark.createDataFrame([(v,) for v in values], "v bigint")
    assert [r.v for r in df.orderBy(id_key("v")).collect()] == values


def test_short_id_key_refuses_larger_ids(spark):
    df = spark.createDataFrame([(2**32,)], "v bigint")
    with pytest.raises(Exception, match="does not fit"):
        df.select(id_key("v", 32)).collect()
    with pytest.raises(ValueError):
        id_key("v", 20)


@pytest.mark.parametrize("k", [0, 1, 5, 499, 500, 1000])
def test_keep_first_is_exact(spark, k):
    ids = [i * i - 40 * i for i in range(500)]
    ids = sorted(set(ids))
    df = spark.createDataFrame([(i,) for i in ids], "v bigint").repartition(7)
    got = sorted(r.v for r in keep_first(df, id_key("v"), F.least(F.lit(k), F.col("_rows"))).collect())
    assert got == ids[:k]


@pytest.mark.parametrize("few", [1 << 20, 3])
@pytest.mark.parametrize("spread", [1, 10**15])
def test_cut_of_ids_takes_three_passes(spark, monkeypatch, few, spread):
    """Dense ids and ids over the whole range, by numbering a few rows and by digits alone."""
    passes = []
    staged = rank.stage
    monkeypatch.setattr(rank, "FEW_ROWS", few)
    monkeypatch.setattr(rank, "stage", lambda df, name: passes.append(name) or staged(df, name))
    ids = [(k * 37 % 4000 - 2000) * spread + (10**12 if spread == 1 else 0) for k in range(4000)]
    df = spark.createDataFrame([(i, "a" if i % 2 else "b") for i in ids] + [(5, "one"), (7, None)], "v bigint, part string").repartition(5)
    got = keep_first(df, id_key("v"), F.ceil(F.col("_rows") / 3), by=F.col("part")).collect()
    wanted = {("one", 5)}
    for part in ("a", "b"):
        mine = sorted(i for i in ids if part == ("a" if i % 2 else "b"))
        wanted |= {(part, i) for i in mine[: -(-len(mine) // 3)]}
    assert {(r.part, r.v) for r in got} == wanted
    assert len(passes) <= (2 if spread == 1 else 4)


@pytest.mark.parametrize("few", [1 << 20, 3])
def test_cuts_take_two_passes_wherever_the_mass_lies(spark, monkeypatch, few):
    """Nearly all ids in one short range, far from the others, and ids that a double cannot tell apart."""
    staged, passes = rank.stage, []
    monkeypatch.setattr(rank, "FEW_ROWS", few)
    monkeypatch.setattr(rank, "stage", lambda df, name: passes.append(name) or staged(df, name))
    for ids in ([-(2**62), *range(5 * 10**17, 5 * 10**17 + 6000), 2**62], [*range(40), *range(2**60, 2**60 + 3000)]):
        df = spark.createDataFrame([(i,) for i in ids], "v bigint").repartition(6)
        for share in (0.0001, 0.7):
            passes.clear()
            got = sorted(r.v for r in keep_first(df, id_key("v"), F.ceil(F.lit(share) * F.col("_rows"))).collect())
            assert got == ids[: math.ceil(share * len(ids))]
            assert few == 3 or passes == ["cut-bounds", "cuts"]


def test_a_sketch_that_breaks_its_promise_is_noticed(spark, monkeypatch):
    monkeypatch.setattr(rank, "ACCURACY", 3)  # ranks that are off by a third of the rows, far beyond the grid
    by_digits, used = rank._cut_by_digits, []
    monkeypatch.setattr(rank, "_cut_by_digits", lambda *args: used.append(1) or by_digits(*args))
    df = spark.range(5000).repartition(4)
    assert sorted(r.id for r in keep_first(df, id_key("id"), F.lit(1234).cast("bigint")).collect()) == list(range(1234))
    assert used


def test_fraction_head_with_a_dominant_source(spark):
    rows = [("hot" if i % 3 else f"s{i % 30}", i * 7) for i in range(3000)]
    df = spark.createDataFrame(rows, "source string, id bigint").repartition(9)
    fractions = {"hot": 0.1, "s0": 0.5, "s3": 1.0, "s6": 0.0}
    got = {(r.source, r.id) for r in mix.fraction_head(df, "source", "id", fractions).collect()}
    expected = set()
    for name, f in fractions.items():
        mine = sorted(i for s, i in rows if s == name)
        expected |= {(name, i) for i in mine[: int(f * len(mine))]}
    assert got == expected
    with pytest.raises(ValueError):
        mix.fraction_head(df, "source", "id", {"hot": 1.5})


def test_split_sizes_and_subset(spark):
    for n in (1, 9, 10, 101):
        df = mix.split_train_test(spark.range(n), 3, 0.1, "id")
        tests = {r.id for r in df.where("split = 'test'").collect()}
        assert tests == set(md5_order(3, range(n))[: math.ceil(0.1 * n)])
    assert {r.id for r in mix.random_subset(spark.range(50), 1, 7, "id").collect()} == set(md5_order(1, range(50))[:7])
    assert mix.random_subset(spark.range(5), 1, 7, "id").count() == 5
    assert [r.id for r in mix.shuffled(spark.range(40), 2, "id").collect()] == md5_order(2, range(40))


def test_split_names(spark):
    df = spark.createDataFrame([("train_sft",), ("latest_train",), ("my_test",), ("test_of_train",)], "s string")
    assert [r.v for r in df.select(mix.route_split(F.col("s")).alias("v")).collect()] == ["train", "train", "test", "train"]
    with pytest.raises(Exception, match="neither train nor test"):
        spark.createDataFrame([("validation",)], "s string").select(mix.route_split(F.col("s"))).collect()


def test_sources_on_disk(spark, tmp_path):
    for name, n in (("a", 20), ("b", 10)):
        for split in ("train", "test"):
            rows = spark.range(n).select("id", F.concat(F.lit(name), F.col("id").cast("string")).alias("text"), F.lit(1).alias("extra"))
            rows.write.parquet(str(tmp_path / name / split))
    sources = (TaskSource("a", str(tmp_path / "a"), 0.25), TaskSource("b", str(tmp_path / "b"), 0.5))
    rows = load_mix(spark, MixConfig(sources, columns_to_keep=("text", "absent")))
    assert rows.columns == ["source", "split", "row_id", "text"]
    counts = {(r.source, r.split): r["count"] for r in rows.groupBy("source", "split").count().collect()}
    assert counts == {("a", "train"): 5, ("a", "test"): 20, ("b", "train"): 5, ("b", "test"): 10}
    assert {r.row_id for r in rows.where("source = 'a' and split = 'train'").collect()} == set(range(5))
    again = load_mix(spark, MixConfig(sources, columns_to_keep=("text",)))
    assert [tuple(r) for r in rows.collect()] == [tuple(r) for r in again.collect()]
    assert read_source(spark, sources[0]).where("split = 'test'").count() == 20


def test_mix_checks():
    a, b = TaskSource("a", "x"), TaskSource("b", "y", -0.1)
    for wrong in ((), (b,), (a, a)):
        with pytest.raises(ValueError):
            MixConfig(wrong)
    with pytest.raises(ValueError):
        MixConfig((a,), configs=("one", "two"))
    with pytest.raises(ValueError):
        MixConfig((TaskSource("a", "x", splits=()),))


def test_concatenate_is_strict(spark):
    left = spark.createDataFrame([(1,), (2,)], "id bigint")
    right = left.withColumn("more", F.lit(1))
    with pytest.raises(Exception):
        mix.concatenate([left, right]).collect()
    assert mix.concatenate([left, right], allow_missing=True).count() == 4


def test_images(spark):
    df = spark.createDataFrame([(1, b"x"), (2, None)], "id int, image binary")
    assert mix.missing_images(df).first().asDict() == {"rows": 2, "missing_images": 1}
    with pytest.raises(Exception, match="without an image"):
        mix.require_images(df).collect()
    assert mix.require_images(df.where("id = 1")).count() == 1


# ---- sampling plans -------------------------------------------------------------------------------------------


def test_sampler_shape(spark):
    rows = expand.repeat_plan(spark.range(7), "id", 42, copies=2, batch_size=3, repeats=4).orderBy("position").collect()
    order = md5_order(42, range(7))
    expected = [i for chunk in (order[:3], order[3:6]) for _ in range(4) for i in chunk for _ in range(2)]
    assert [r.prompt_id for r in rows] == expected
    assert [r.position for r in rows] == list(range(48))


def test_train_plan_places_and_reuses(spark):
    cfg = SamplingConfig(3, per_device_batch_size=4, num_processes=3, gradient_accumulation_steps=3, num_iterations=2)
    rows = expand.train_plan(spark.range(24), "id", cfg).orderBy("position").collect()
    order = md5_order(42, range(24))
    first = [r.prompt_id for r in rows if r.step == 0]
    assert first == [i for i in order[:4] for _ in range(3)]
    assert [r.prompt_id for r in rows if r.step == 3] == first
    assert [r.prompt_id for r in rows if r.step == 6] == [i for i in order[12:16] for _ in range(3)]
    assert {(r.step, r.global_step, r.is_reuse, r.generated_at) for r in rows} >= {(0, 0, False, 0), (4, 1, True, 1), (6, 2, False, 6)}
    assert [r.device for r in rows if r.step == 0] == [0] * 4 + [1] * 4 + [2] * 4


def test_group_size_must_divide_the_step():
    with pytest.raises(ValueError, match=r"\[2, 4, 8\]"):
        SamplingConfig(3, per_device_batch_size=8)


# ---- held-out check -------------------------------------------------------------------------------------------


def test_leaks_found_over_whole_texts(spark):
    secret = "one two three four five six seven eight nine"
    filler = " ".join(f"w{i}" for i in range(5000))
    train = [(1, f"{filler} ONE two  three\nfour five six seven eight"), (2, filler), (3, "one two three four five six seven"), (4, "")]
    train += [(i, f"boiler plate text that every page of this site holds {i}") for i in range(10, 400)]
    docs = spark.createDataFrame(train, "id bigint, text string")
    held = spark.createDataFrame([(secret,), ("short",)], "text string")
    assert [r.id for r in leak.leaked_ids(docs, held, "id", "text").collect()] == [1]
    held = held.union(spark.createDataFrame([("boiler plate text that every page of this",)], "text string"))
    clean = {r.id for r in leak.clean_rows(docs, held, "id", "text").collect()}
    assert clean == {2, 3, 4}


def test_leaks_beyond_the_broadcast_bound(spark, monkeypatch):
    monkeypatch.setattr(session, "NEAR_ROWS", 0)
    docs = spark.createDataFrame([(1, "a b c d e f g h i"), (2, "z")], "id bigint, text string")
    held = spark.createDataFrame([("b c d e f g h i",)], "text string")
    assert [r.id for r in leak.leaked_ids(docs, held, "id", "text").collect()] == [1]


def test_cuts_over_a_union(spark):
    left = spark.range(50).select("id", F.lit("a").alias("source"), F.lit("train").alias("split"))
    rows = mix.concatenate([left, left.withColumn("source", F.lit("b"))])
    cut = mix.fraction_head(rows, "source", "id", {"a": 0.5, "b": 1.0})
    split = mix.split_train_test(cut, 1, 0.1, "source", "id")
    assert split.where("split = 'test'").count() == 8 and split.count() == 75
    assert expand.repeat_plan(cut.select("id").distinct(), "id", 1, copies=2, batch_size=7).count() == 98


def test_prepared_tasks(spark, tmp_path):
    from rewardloom.plans.tasks import prepare_tasks

    rows = spark.range(300).select("id", F.array(F.lit(3), F.col("id")).alias("nums"), (F.col("id") + 3).alias("target"))
    rows.write.parquet(str(tmp_path / "c" / "train"))
    cfg = MixConfig((TaskSource("c", str(tmp_path / "c"), 0.5, splits=("train",)),))
    tasks = prepare_tasks(spark, cfg, "countdown", test_size=0.1).collect()
    assert len(tasks) == 150 and sum(t.split == "test" for t in tasks) == 15
    assert all(f"[3, {t.row_id}]" in t.prompt and t.target == t.row_id + 3 for t in tasks)
    assert [t.row_id for t in tasks] != sorted(t.row_id for t in tasks)
    assert prepare_tasks(spark, cfg, "countdown", debug=True).count() == 100


def test_filter_words_and_size():
    assert leak.filter_words(0) == 1024 and leak.filter_words(20_000_000) == 1 << 23
    assert leak.filter_words(10**12) == leak.MOST_WORDS


def test_gram_filter_passes_every_known_gram_and_few_others(spark):
    known = spark.range(30_000).select(F.xxhash64("id").alias("gram"))
    others = spark.range(200_000).select(F.lit(1).alias("row"), F.xxhash64(F.col("id") + 10**9).alias("gram"))
    own = known.select(F.lit(0).alias("row"), "gram")
    passed = {r.row: r["count"] for r in leak.maybe_known(own.unionAll(others), known, 30_000).groupBy("row").count().collect()}
    assert passed[0] == 30_000 and passed.get(1, 0) < 200
    few = leak.maybe_known(own.unionAll(others), known, 30_000, most=1024)  # a filter that is far too small loses nothing
    assert few.where("row = 0").count() == 30_000


def test_leak_check_by_filter_finds_the_same_rows(spark):
    held = spark.createDataFrame([(f"h{k} " + " ".join(f"w{k}x{j}" for j in range(20)),) for k in range(300)], "text string")
    rows = []
    for k in range(600):
        body = [f"t{k}y{j}" for j in range(40)]
        if k % 3 == 0:
            body[10:18] = [f"W{k // 2}x{j}" for j in range(5, 13)]  # eight words of a held-out item, in capitals
        elif k % 3 == 1:
            body[10:17] = [f"w{k // 2}x{j}" for j in range(5, 12)]  # only seven
        rows.append((k, " ".join(body)))
    train = spark.createDataFrame(rows, "id bigint, text string").repartition(5)
    wanted = [k for k in range(0, 600, 3)]
    for near in (None, 0):
        assert sorted(r.id for r in leak.leaked_ids(train, held, "id", "text", near=near).collect()) == wanted


def test_no_training_gram_is_exchanged_by_the_filter(spark):
    train = spark.createDataFrame([(1, "a b c d e f g h i")], "id bigint, text string")
    hashes = train.select("id", F.explode(leak.grams(F.col("text"), 8, hashed=True)).alias("gram"))
    known = spark.range(5_000).select(F.xxhash64("id").alias("gram"))
    text = leak.maybe_known(hashes, known, 5_000)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in text and "Exchange hashpartitioning" not in text and "SortMergeJoin" not in text


def test_mix_problems(spark):
    from rewardloom.operators.checks import mix_problems, weight_problem

    rows = [(1, "a", 0.5, None), (1, "b", 1.0, None), (2, "a", 0.5, None), (2, "a", 0.5, None), (3, "a", 1.5, None), (4, None, None, None), (5, "a", 0.5, "x"),
            (5, "b", 0.5, None), (6, "a", 0.5, "x"), (6, "b", 0.0, "y"), (7, "a", None, None), (None, "a", 0.1, None)]
    df = spark.createDataFrame(rows, "mix_id int, source string, fraction double, config string")
    got = {r.mix_id: (r.sources, r.problem) for r in mix_problems(df, config="config").collect()}
    wide, twice, some = "a fraction outside [0, 1]", "a source twice", "configs for some sources only"
    assert got == {1: (2, None), 2: (2, twice), 3: (1, wide), 4: (0, "no source"), 5: (2, some), 6: (2, None), 7: (1, wide), None: (1, None)}
    for mix_id, (_, problem) in got.items():  # the same verdict as the configuration's own
        mine = [r for r in rows if r[0] == mix_id and r[1]]
        configs = tuple(r[3] for r in mine if r[3]) or None
        try:
            MixConfig(tuple(TaskSource(r[1], "x", -1.0 if r[2] is None else r[2]) for r in mine), configs=configs)
            assert problem is None
        except ValueError:
            assert problem is not None
    counts = spark.createDataFrame([(2, 2), (2, 3), (2, 0), (2, None)], "r int, w int")
    assert [r.p for r in counts.select(weight_problem(F.col("r"), F.col("w")).alias("p")).collect()] == [None, "3 weights for 2 rewards", None, None]
