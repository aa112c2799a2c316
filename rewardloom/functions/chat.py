"""Chat messages as ``array<struct<role, content>>`` columns: building, checking, rendering."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rewardloom.functions.text import let, strip

MESSAGES = T.ArrayType(
    T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())])
)

# Prompt texts that must equal the ones models were trained with.
COUNTDOWN_SYSTEM = (
    "You are a helpful assistant. You first thinks about the reasoning process in the mind and then provides the user "
    "with the answer."
)
COUNTDOWN_TASK = (
    "Using the numbers {numbers}, create an equation that equals {target}. You can use basic arithmetic operations "
    "(+, -, *, /) one or multiple times but each number can only be used once. Show your work in <think> </think> "
    "tags. And return the final equation in <answer> </answer> tags, for example <answer> (1 + 2) / 3 </answer>. "
    "Think step by step inside <think> tags."
)
COUNTDOWN_TASK_WITH_RESULT = (
    "Using the numbers {numbers}, create an equation that equals {target}. You can use basic arithmetic operations "
    "(+, -, *, /) and each number can only be used once. Show your work in <think> </think> tags. And return the "
    "final equation and answer in <answer> </answer> tags, for example <answer> (1 + 2) / 3 = 1 </answer>."
)
ASSISTANT_PREFILL = "Let me solve this step by step.\n<think>"
REASONING_SYSTEM = "\nRespond in the following format:\n<reasoning>\n...\n</reasoning>\n<answer>\n...\n</answer>\n"
VISUAL_SYSTEM = (
    "A conversation between User and Assistant. The user asks a question, and the Assistant solves it. The assistant "
    "first thinks about the reasoning process in the mind and then provides the user with the answer. The reasoning "
    "process and answer are enclosed within <think> </think> and <answer> </answer> tags, respectively, i.e., "
    "<think> reasoning process here </think><answer> answer here </answer>"
)


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.cast("string").alias("content"))


def messages_of(*items: Column) -> Column:
    return F.array(*items)


# ---- templates ------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class ChatTemplate:
    """Text around each role's content. Roles without an entry render to nothing."""

    name: str
    opening: dict[str, str]
    closing: dict[str, str]
    generation_prompt: str
    system_first: bool = False
    start: str = ""
    mentions_system: bool = True


def default_template(eos: str = "</s>") -> ChatTemplate:
    roles = ("user", "system", "assistant")
    return ChatTemplate(
        "default",
        {role: f"<|{role}|>\n" for role in roles},
        {role: f"{eos}\n" for role in roles},
        "<|assistant|>\n",
    )


def chatml_template() -> ChatTemplate:
    roles = ("system", "user", "assistant", "tool")
    return ChatTemplate(
        "chatml",
        {role: f"<|im_start|>{role}\n" for role in roles},
        {role: "<|im_end|>\n" for role in roles},
        "<|im_start|>assistant\n",
    )


def think_template(bos: str = "<｜begin▁of▁sentence｜>") -> ChatTemplate:
    """The last system text comes first, unmarked; only assistant turns are closed."""
    return ChatTemplate(
        "think",
        {"user": "<｜User｜>", "assistant": "<｜Assistant｜>"},
        {"user": "", "assistant": "<｜end▁of▁sentence｜>"},
        "<｜Assistant｜>",
        system_first=True,
        start=bos,
    )


def _by_role(role: Column, texts: dict[str, str]) -> Column:
    chosen = F.lit("")
    for name, value in texts.items():
        chosen = F.when(role == name, F.lit(value)).otherwise(chosen)
    return chosen


def _last_system(messages: Column) -> Column:
    systems = F.filter(messages, lambda m: m["role"] == "system")
    return F.coalesce(F.try_element_at(systems, F.lit(-1))["content"], F.lit(""))


def render(
    messages: Column,
    template: ChatTemplate,
    add_generation_prompt: bool = False,
    continue_final_message: bool = False,
) -> Column:
    """Text of a conversation. With ``continue_final_message`` the last turn stays open for the model. A turn without
    content is an empty turn."""
    if add_generation_prompt and continue_final_message:
        raise ValueError("a prompt either opens a new turn or continues the last one")
    known = F.filter(messages, lambda m: m["role"].isin(*template.opening))

    def turn(m: Column, index: Column | None = None, last: Column | None = None) -> Column:
        closing = _by_role(m["role"], template.closing)
        if last is not None:
            closing = F.when(index == last, F.lit("")).otherwise(closing)
        return F.concat(_by_role(m["role"], template.opening), F.coalesce(m["content"], F.lit("")), closing)

    if continue_final_message:
        body = let(known, lambda k: F.array_join(F.transform(k, lambda m, i: turn(m, i, F.size(k) - 1)), ""))
    else:
        body = F.array_join(F.transform(known, lambda m: turn(m)), "")
    parts = [F.lit(template.start)]
    if template.system_first:
        parts.append(_last_system(messages))
    parts.append(body)
    if add_generation_prompt:
        parts.append(F.lit(template.generation_prompt))
    return F.concat(*parts)


def insert_empty_system(messages: Column, template: ChatTemplate) -> Column:
    """Prepend an empty system turn when the template knows system turns and none leads."""
    if not template.mentions_system:
        return messages
    return F.when(F.get(messages, F.lit(0))["role"] != "system", F.concat(F.array(message("system", F.lit(""))), messages)).otherwise(
        messages
    )


def is_message_list(messages: Column) -> Column:
    """Every item has a role and a content."""
    return F.coalesce(F.forall(messages, lambda m: m["role"].isNotNull() & m["content"].isNotNull()), F.lit(False))


def has_message_type(data_type: T.DataType) -> bool:
    if not isinstance(data_type, T.ArrayType) or not isinstance(data_type.elementType, T.StructType):
        return False
    return {"role", "content"} <= set(data_type.elementType.names)


# ---- formatters -----------------------------------------------------------------------------------------------


def number_list(nums: Column) -> Column:
    """``[44, 19, 35]``."""
    return F.concat(F.lit("["), F.array_join(F.transform(nums, lambda n: n.cast("string")), ", "), F.lit("]"))


def fill(template: str, **values: Column) -> Column:
    """Put columns into the named places of a fixed text, by concatenation so that values are never rescanned."""
    parts, rest = [], template
    while rest:
        places = [(rest.find("{" + name + "}"), name) for name in values if "{" + name + "}" in rest]
        if not places:
            parts.append(F.lit(rest))
            break
        at, name = min(places)
        if at:
            parts.append(F.lit(rest[:at]))
        parts.append(values[name].cast("string"))
        rest = rest[at + len(name) + 2 :]
    return F.concat(*parts) if parts else F.lit("")


def countdown_messages(nums: Column, target: Column, task: str = COUNTDOWN_TASK) -> Column:
    return messages_of(
        message("system", F.lit(COUNTDOWN_SYSTEM)),
        message("user", fill(task, numbers=number_list(nums), target=target)),
        message("assistant", F.lit(ASSISTANT_PREFILL)),
    )


def math_messages(
    problem: Column, system: str | None = None, instruction: str | None = None, append: bool = False
) -> Column:
    """User turn with an optional instruction (filled in or appended) after an optional system turn."""
    text = problem
    if instruction is not None:
        text = F.concat(problem, F.lit(instruction)) if append else fill(instruction, problem=problem)
    turns = [message("user", text)]
    if system is not None:
        turns.insert(0, message("system", F.lit(system)))
    return messages_of(*turns)


def grade_school_messages(question: Column) -> Column:
    return messages_of(message("system", F.lit(REASONING_SYSTEM)), message("user", question))


def hash_answer(answer: Column) -> Column:
    """Stripped text between the first and the second ``####`` mark, null without a mark."""
    return F.when(F.contains(answer, F.lit("####")), strip(F.split(answer, "####")[1]))


def wrap_solution(solution: Column) -> Column:
    """Put a solution into answer tags, with the full stop models were trained with, unless it already is."""
    bare = strip(solution)
    tagged = bare.startswith("<answer>") & bare.endswith("</answer>")
    return F.when(tagged, solution).otherwise(F.concat(F.lit("<answer>"), solution, F.lit("</answer>.")))


# ---- multimodal -----------------------------------------------------------------------------------------------


def part(kind: str, text: Column | None = None) -> Column:
    value = F.lit(None).cast("string") if text is None else text
    return F.struct(F.lit(kind).alias("type"), value.alias("text"))


def parts_message(role: str, *parts: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), F.array(*parts).alias("content"))


def multimodal_base(problem: Column, system_prompt: str) -> Column:
    """Image place and prompt text as one bare list of parts."""
    return F.array(part("image"), part("text", fill(system_prompt, problem=problem)))


def multimodal_instruct(problem: Column, system_prompt: str | None = None) -> Column:
    turns = [
        parts_message("user", part("image"), part("text", problem)),
        parts_message("assistant", part("text", F.lit(ASSISTANT_PREFILL))),
    ]
    if system_prompt is not None:
        turns.insert(0, parts_message("system", part("text", F.lit(system_prompt))))
    return F.array(*turns)


def visual_sft(
    problem: Column, thinking: Column, solution: Column, system: Column | None = None, system_prompt: str | None = None
) -> Column:
    """System turn (argument, else the row's, else the default), question with image, worked answer."""
    chosen = F.lit(VISUAL_SYSTEM) if system is None else F.coalesce(system, F.lit(VISUAL_SYSTEM))
    if system_prompt:
        chosen = F.lit(system_prompt)
    return F.array(
        parts_message("system", part("text", chosen)),
        parts_message("user", part("text", problem), part("image")),
        parts_message("assistant", part("text", F.concat(thinking, F.lit("\n\n"), solution))),
    )


def render_parts(messages: Column, template: ChatTemplate, image_mark: str, add_generation_prompt: bool = False) -> Column:
    """Render multimodal turns; an image part becomes ``image_mark``."""
    flat = F.transform(
        messages,
        lambda m: F.struct(
            m["role"].alias("role"),
            F.array_join(
                F.transform(
                    m["content"], lambda p: F.when(p["type"] == "image", F.lit(image_mark)).otherwise(p["text"])
                ),
                "",
            ).alias("content"),
        ),
    )
    return render(flat, template, add_generation_prompt)


# ---- prompt and completion ------------------------------------------------------------------------------------


def bootstrap(prompt: Column) -> Column:
    """Content of a trailing assistant turn, '' otherwise."""
    final = F.try_element_at(prompt, F.lit(-1))
    return F.when(final["role"] == "assistant", final["content"]).otherwise(F.lit(""))


def without_bootstrap(prompt: Column) -> Column:
    final = F.try_element_at(prompt, F.lit(-1))
    return F.when(final["role"] == "assistant", F.slice(prompt, F.lit(1), F.size(prompt) - 1)).otherwise(prompt)


def conversational_completion(prompt: Column, completion: Column) -> Column:
    return F.array(message("assistant", F.concat(bootstrap(prompt), completion)))


def preference_texts(
    chosen: Column, rejected: Column, template: ChatTemplate, prompt: Column | None = None, insert_system: bool = True
) -> dict[str, Column]:
    """Prompt, chosen and rejected texts of a preference pair.

    A valid ``prompt`` is used whole with whole answers; otherwise the prompt is ``chosen`` without its last turn and
    the answers are the last turns.
    """
    head = F.slice(chosen, F.lit(1), F.size(chosen) - 1)
    last_chosen, last_rejected = F.slice(chosen, F.lit(-1), F.lit(1)), F.slice(rejected, F.lit(-1), F.lit(1))
    if prompt is not None:
        given = is_message_list(prompt)
        head = F.when(given, prompt).otherwise(head)
        last_chosen = F.when(given, chosen).otherwise(last_chosen)
        last_rejected = F.when(given, rejected).otherwise(last_rejected)
    if insert_system:
        head = insert_empty_system(head, template)
    return {
        "text_prompt": render(head, template),
        "text_chosen": render(last_chosen, template),
        "text_rejected": render(last_rejected, template),
    }


# Rubric and layout of the request are the caller's; these short ones are our own.
JUDGE_RUBRIC = "Decide whether the student's answer and the correct solution state the same result."
JUDGE_LAYOUT = "Given answer:\n{completion}\n\nReference:\n{solution}\n\nReply with 1.0 if they agree and 0.0 if they do not."


def judge_request(completion: Column, solution: Column, rubric: str = JUDGE_RUBRIC, layout: str = JUDGE_LAYOUT) -> Column:
    """Request messages for an external judge, one request per completion."""
    ask = fill(layout, completion=completion, solution=solution)
    return messages_of(message("system", F.lit(rubric)), message("user", ask))
