"""Chat building, rendering and task shaping."""

import pytest
from pyspark.sql import functions as F

from rewardloom.functions import chat
from rewardloom.operators.shaping import shape_for_task

TURNS = [("user", "hi"), ("assistant", "ho"), ("tool", "x"), ("user", "bye")]


def frame(spark, **columns):
    schema = ", ".join(f"{name} array<struct<role:string,content:string>>" for name in columns)
    return spark.createDataFrame([tuple(columns.values())], schema)


def one(df, column):
    return df.select(column.alias("v")).first().v


def test_default_template(spark):
    df = frame(spark, m=[("system", "s"), *TURNS])
    text = one(df, chat.render(F.col("m"), chat.default_template("</s>"), add_generation_prompt=True))
    assert text == "<|system|>\ns</s>\n<|user|>\nhi</s>\n<|assistant|>\nho</s>\n<|user|>\nbye</s>\n<|assistant|>\n"


def test_think_template_uses_the_last_system_text(spark):
    df = frame(spark, m=[("system", "one"), ("user", "hi"), ("system", "two"), ("assistant", "<think>x</think>y")])
    text = one(df, chat.render(F.col("m"), chat.think_template("<b>"), add_generation_prompt=True))
    assert text == "<b>two<｜User｜>hi<｜Assistant｜><think>x</think>y<｜end▁of▁sentence｜><｜Assistant｜>"


def test_continue_final_message(spark):
    df = spark.createDataFrame([([44, 19, 35], 98)], "nums array<bigint>, target bigint")
    prompt = one(
        df,
        chat.render(
            chat.countdown_messages(F.col("nums"), F.col("target")), chat.chatml_template(), continue_final_message=True
        ),
    )
    assert prompt.startswith("<|im_start|>system\nYou are a helpful assistant.")
    assert "Using the numbers [44, 19, 35], create an equation that equals 98." in prompt
    assert prompt.endswith("<|im_end|>\n<|im_start|>assistant\nLet me solve this step by step.\n<think>")
    with pytest.raises(ValueError):
        chat.render(F.col("m"), chat.chatml_template(), add_generation_prompt=True, continue_final_message=True)


def test_values_are_not_rescanned(spark):
    df = spark.createDataFrame([("{b}", "B")], "a string, b string")
    assert one(df, chat.fill("{a}-{b}-{a}", a=F.col("a"), b=F.col("b"))) == "{b}-B-{b}"


def test_empty_system_turn(spark):
    template = chat.chatml_template()
    plain, led = frame(spark, m=TURNS), frame(spark, m=[("system", "s"), *TURNS])
    assert one(plain, F.size(chat.insert_empty_system(F.col("m"), template))) == 5
    assert one(led, F.size(chat.insert_empty_system(F.col("m"), template))) == 5
    silent = chat.ChatTemplate("silent", {"user": ""}, {"user": ""}, "", mentions_system=False)
    assert one(plain, F.size(chat.insert_empty_system(F.col("m"), silent))) == 4


def test_message_list_check(spark):
    assert one(frame(spark, m=TURNS), chat.is_message_list(F.col("m"))) is True
    assert one(frame(spark, m=[("user", None)]), chat.is_message_list(F.col("m"))) is False
    assert one(frame(spark, m=[]), chat.is_message_list(F.col("m"))) is True
    assert one(frame(spark, m=None), chat.is_message_list(F.col("m"))) is False


def test_bootstrap(spark):
    df = frame(spark, m=[("user", "q"), ("assistant", "Let me")], n=[("user", "q")])
    assert one(df, chat.conversational_completion(F.col("m"), F.lit(" think")))[0].content == "Let me think"
    assert one(df, F.size(chat.without_bootstrap(F.col("m")))) == 1
    assert one(df, chat.conversational_completion(F.col("n"), F.lit("x")))[0].content == "x"


def test_solutions(evaluate):
    cases = ["7", "<answer>7</answer>", " <answer>7</answer>\n", "<answer>7"]
    assert evaluate(chat.wrap_solution, cases) == ["<answer>7</answer>.", *cases[1:3], "<answer><answer>7</answer>."]
    assert evaluate(chat.hash_answer, ["a #### 42 ", "none", "#### 1 #### 2"]) == ["42", None, "1"]


def test_math_messages(evaluate):
    show = lambda m: F.concat_ws("|", F.transform(m, lambda x: F.concat_ws(":", x["role"], x["content"])))
    assert evaluate(lambda t: show(chat.math_messages(t, "S", "Do {problem}!")), ["1+1"]) == ["system:S|user:Do 1+1!"]
    assert evaluate(lambda t: show(chat.math_messages(t, None, " now", append=True)), ["1+1"]) == ["user:1+1 now"]
    assert evaluate(lambda t: show(chat.math_messages(t)), ["1+1"]) == ["user:1+1"]


def test_visual_sft_system_choice(spark):
    df = spark.createDataFrame([("p", "t", "s", None), ("p", "t", "s", "own")], "p string, t string, s string, y string")
    build = lambda given=None, **k: chat.visual_sft(F.col("p"), F.col("t"), F.col("s"), given, **k)
    system = lambda m: m[0]["content"][0]["text"]
    assert [r.v for r in df.select(system(build(F.col("y"))).alias("v")).collect()] == [chat.VISUAL_SYSTEM, "own"]
    assert {r.v for r in df.select(system(build(F.col("y"), system_prompt="arg")).alias("v")).collect()} == {"arg"}
    assert one(df, build()[2]["content"][0]["text"]) == "t\n\ns"


def test_preference_shapes(spark):
    chosen = [("user", "q"), ("assistant", "good")]
    rejected = [("user", "q"), ("assistant", "bad")]
    t = chat.chatml_template()
    df = shape_for_task(frame(spark, chosen=chosen, rejected=rejected), "dpo", t)
    row = df.first()
    assert row.text_prompt == "<|im_start|>system\n<|im_end|>\n<|im_start|>user\nq<|im_end|>\n"
    assert row.text_chosen == "<|im_start|>assistant\ngood<|im_end|>\n"
    assert row.text_rejected == "<|im_start|>assistant\nbad<|im_end|>\n"
    given = shape_for_task(frame(spark, prompt=[("user", "p")], chosen=chosen, rejected=rejected), "orpo", t, False).first()
    assert given.text_prompt == "<|im_start|>user\np<|im_end|>\n"
    assert given.text_chosen.startswith("<|im_start|>user\nq")


def test_shape_checks(spark):
    t = chat.chatml_template()
    good = frame(spark, chosen=TURNS, rejected=TURNS)
    with pytest.raises(ValueError, match="not one of"):
        shape_for_task(good, "ppo", t)
    with pytest.raises(ValueError, match="missing: rejected"):
        shape_for_task(good.drop("rejected"), "rm", t)
    with pytest.raises(ValueError, match="message lists"):
        shape_for_task(good.withColumn("chosen", F.lit("x")), "dpo", t)
    with pytest.raises(Exception, match="role and content"):
        shape_for_task(frame(spark, chosen=[("user", None)], rejected=TURNS), "dpo", t).collect()


def test_judge_request(spark):
    df = spark.createDataFrame([("said", "gold")], "c string, s string")
    system, user = one(df, chat.judge_request(F.col("c"), F.col("s"), "rubric"))
    assert system.content == "rubric"
    assert user.content == "Given answer:\nsaid\n\nReference:\ngold\n\nReply with 1.0 if they agree and 0.0 if they do not."
    _, user = one(df, chat.judge_request(F.col("c"), F.col("s"), layout="{solution}|{completion}"))
    assert user.content == "gold|said"


def test_a_turn_without_content_is_an_empty_turn(spark):
    df = frame(spark, m=[("user", "hi"), ("assistant", None), ("user", "bye")])
    text = one(df, chat.render(F.col("m"), chat.default_template("</s>")))
    assert text == "<|user|>\nhi</s>\n<|assistant|>\n</s>\n<|user|>\nbye</s>\n"
