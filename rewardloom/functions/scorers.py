"""Rule-based rewards as column expressions over the completion text.

Every function takes text columns and returns a ``double`` column. Patterns are written so that no input, however
long, makes the regex engine recurse or rescan: bounded pieces are cut out with index functions first.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from rewardloom.config import CODE_LANGUAGES, RewardConfig
from rewardloom.functions.text import (
    PY_SPACE,
    SPACE_CLASS,
    after,
    after_last,
    before,
    between,
    exactly_once,
    let,
    strip,
    word_grams,
    words,
)

# Tags counted by the tag rewards, each with its line ends.
THINK_TAGS = ("<think>\n", "\n</think>\n", "\n<answer>\n", "\n</answer>")
REASONING_TAGS = ("<reasoning>\n", "\n</reasoning>\n", "\n<answer>\n", "\n</answer>")
# Step markers; the numbered form counts at the start of the text only.
STEP_MARKERS = r"(?d)(Step [0-9]+:|\A[0-9]+\.|\n-|\n\*|First,|Second,|Next,|Finally,)"
FULL_MARKS_AT_STEPS = 3
# Characters removed before comparing answers as plain text (ASCII punctuation).
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
ARTICLES = ("a", "an", "the")


def flag(condition: Column, worth: float = 1.0) -> Column:
    """``worth`` where the condition holds, else 0.0 (null counts as no)."""
    return F.when(condition, F.lit(float(worth))).otherwise(F.lit(0.0))


def completion_text(df_schema, name: str = "completion", last: bool = False) -> Column:
    """One message's content of a conversational completion, or the plain text; decided by type.

    Most rewards read the first message; code is read from the last one.
    """
    if isinstance(df_schema[name].dataType, ArrayType):
        return F.try_element_at(F.col(name), F.lit(-1 if last else 1))["content"]
    return F.col(name)


# ---- extraction -----------------------------------------------------------------------------------------------


def extract_answer(text: Column) -> Column:
    """Stripped text inside the first answer tags, or the whole stripped text; null gives ''."""
    return F.coalesce(strip(F.coalesce(between(text, "<answer>", "</answer>"), text)), F.lit(""))


def last_answer(text: Column) -> Column:
    """Text after the last opening tag up to the next closing tag, stripped."""
    return strip(before(F.substring_index(text, "<answer>", -1), "</answer>"))


def extract_code(text: Column) -> Column:
    """Body of the last fenced Python block, '' without one."""
    blocks = F.regexp_extract_all(text, F.lit(r"(?sd)```python\n(.*?)```"), F.lit(1))
    return F.coalesce(F.try_element_at(blocks, F.lit(-1)), F.lit(""))


# ---- layout rewards -------------------------------------------------------------------------------------------


def format_reward(text: Column) -> Column:
    """Starts with a closed think block directly followed by a closed answer block; the end is free."""
    rest = F.try_element_at(
        F.split(F.substr(text, F.lit(len("<think>") + 1)), "</think>" + SPACE_CLASS + "*+<answer>", 2), F.lit(2)
    )
    return flag(text.startswith("<think>") & F.contains(rest, F.lit("</answer>")))


def tag_count_reward(text: Column) -> Column:
    return sum((flag(exactly_once(text, tag), 0.25) for tag in THINK_TAGS), F.lit(0.0))


def reasoning_steps_reward(text: Column) -> Column:
    return F.least(F.lit(1.0), F.regexp_count(text, F.lit(STEP_MARKERS)) / F.lit(FULL_MARKS_AT_STEPS))


def countdown_format_reward(text: Column) -> Column:
    """Prefilled think block closed once, then one line end and an answer block that ends the text."""
    tail = after(text, "</think>")
    closed = tail.endswith("</answer>") | tail.endswith("</answer>\n")
    return flag(~F.contains(before(text, "</think>"), F.lit("<think>")) & tail.startswith("\n<answer>") & closed)


def code_format_reward(text: Column, language: str = "python") -> Column:
    """Think block, then an answer block holding a fenced block of ``language``."""
    if language not in CODE_LANGUAGES:
        raise ValueError(f"language must be one of {', '.join(CODE_LANGUAGES)}")
    fence = "```"
    opened = F.substr(text, F.lit(len("<think>\n") + 1))
    body = after(opened, "\n</think>\n<answer>\n")
    # ``body`` starts at the earliest place the answer block may start, so any later start is covered too.
    code = after(body, fence + language)
    closing = after(code, fence)
    closed = F.contains(closing, F.lit("\n</answer>\n")) | closing.endswith("\n</answer>")
    return flag(text.startswith("<think>\n") & closed)


def strict_format_reward(text: Column) -> Column:
    """Reasoning and answer blocks with one-line bodies and nothing else."""
    pattern = r"(?d)\A<reasoning>\n[^\n]*\n</reasoning>\n<answer>\n[^\n]*\n</answer>\n\n?\z"
    return flag(text.rlike(pattern), 0.5)


def soft_format_reward(text: Column) -> Column:
    """Reasoning then answer block at the start, each on one line; white space between may hold line ends.

    Either both blocks are on the first line, and then the first place where one ends and the other begins decides, as
    every later one has less text after it; or the first line ends with the reasoning block.
    """
    first = F.substring_index(text, "\n", 1)
    rest = F.substr(text, F.length(first) + F.lit(2))
    body = F.substr(first, F.lit(len("<reasoning>") + 1))
    inline = F.try_element_at(F.split(body, "</reasoning>" + SPACE_CLASS + "*+<answer>", 2), F.lit(2))
    following = F.ltrim(rest, F.lit(PY_SPACE))
    answer = F.substring_index(following, "\n", 1)
    over_lines = F.rtrim(body, F.lit(PY_SPACE)).endswith("</reasoning>") & answer.startswith("<answer>") & F.contains(answer, F.lit("</answer>"))
    found = F.coalesce(F.contains(inline, F.lit("</answer>")), F.lit(False)) | over_lines
    cheap = text.startswith("<reasoning>") & F.contains(text, F.lit("</answer>"))
    return F.when(cheap, flag(found, 0.5)).otherwise(F.lit(0.0))


def xml_count_reward(text: Column) -> Column:
    """An eighth per tag seen once, less a little for every character after the closing tag."""
    opened, middle, answer, closed = REASONING_TAGS
    trailing_line = F.length(after_last(text, "\n</answer>\n")) * F.lit(0.001)
    trailing = (F.length(after_last(text, closed)) - F.lit(1)) * F.lit(0.001)
    return (
        flag(exactly_once(text, opened), 0.125)
        + flag(exactly_once(text, middle), 0.125)
        + F.when(exactly_once(text, answer), F.lit(0.125) - trailing_line).otherwise(F.lit(0.0))
        + F.when(exactly_once(text, closed), F.lit(0.125) - trailing).otherwise(F.lit(0.0))
    )


# ---- text statistics ------------------------------------------------------------------------------------------


def repetition_penalty_reward(text: Column, ngram_size: int = 3, max_penalty: float = -1.0) -> Column:
    """Share of repeated word n-grams times a non-positive penalty."""
    if max_penalty > 0:
        raise ValueError("max_penalty must not be positive")

    def scaled(grams: Column) -> Column:
        return (F.lit(1.0) - F.size(F.array_distinct(grams)) / F.size(grams)) * F.lit(float(max_penalty))

    def score(w: Column) -> Column:
        return F.when(F.size(w) < ngram_size, F.lit(0.0)).otherwise(let(word_grams(w, ngram_size), scaled))

    return let(words(F.lower(text)), score)


def cosine_reward(length: Column, correct: Column, gold_ok: Column, cfg: RewardConfig = RewardConfig()) -> Column:
    """Cosine schedule over the length, without a clamp; an unreadable gold answer gives 1.0."""

    def schedule(low: float, high: float) -> Column:
        wave = F.lit(1.0) + F.cos(length / F.lit(float(cfg.cosine_max_len)) * F.pi())
        return F.lit(low) + F.lit(0.5 * (high - low)) * wave

    right = schedule(cfg.cosine_min_value_correct, cfg.cosine_max_value_correct)
    wrong = schedule(cfg.cosine_max_value_wrong, cfg.cosine_min_value_wrong)
    return F.when(~gold_ok, F.lit(1.0)).when(correct, right).otherwise(wrong)


def length_reward(length: Column, shortest: Column, longest: Column, right: Column) -> Column:
    """Rank of a length between the batch extremes; wrong answers gain nothing from being short."""
    share = F.lit(0.5) - (length - shortest) / F.nullif(longest - shortest, F.lit(0))
    return F.when(longest == shortest, F.lit(0.0)).when(right, share).otherwise(F.least(F.lit(0.0), share))


# ---- answer rewards -------------------------------------------------------------------------------------------


def accuracy_reward(gold_ok: Column, correct: Column) -> Column:
    return F.when(~gold_ok, F.lit(0.25)).otherwise(flag(correct))


def normalized_text(text: Column) -> Column:
    """Lower case without punctuation, articles and extra white space."""
    bare = F.translate(F.lower(text), PUNCTUATION, "")
    no_articles = F.regexp_replace(bare, r"(?U)\b(" + "|".join(ARTICLES) + r")\b", " ")
    return strip(F.regexp_replace(no_articles, SPACE_CLASS + "+", " "))


def text_match_reward(text: Column, solution: Column) -> Column:
    return flag(normalized_text(text) == normalized_text(solution))


def exact_answer_reward(text: Column, answer: Column) -> Column:
    return flag(last_answer(text).eqNullSafe(answer), 2.0)


def integer_answer_reward(text: Column) -> Column:
    return flag(last_answer(text).rlike(r"\A[0-9]+\z"), 0.5)


def zero_reward() -> Column:
    """The logging reward: scores nothing, its effect is the rollout log."""
    return F.lit(0.0)
