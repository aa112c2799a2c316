"""Chat building and rendering.

Message lists are made row by row: the lines of a document become its turns, so lists of very different lengths occur
and no turns are gathered across rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rewardloom.catalog.registry import SQL_SPACE as SP
from rewardloom.catalog.registry import literal, register, table
from rewardloom.catalog.rewards import sql_strip
from rewardloom.catalog.standins import WITH_ROLLOUTS, rollouts
from rewardloom.functions import chat
from rewardloom.functions.scorers import completion_text
from rewardloom.operators.shaping import shape_for_task

CHATML, DEFAULT, THINK = chat.chatml_template(), chat.default_template(), chat.think_template()

# ---- stand-in: messages ---------------------------------------------------------------------------------------

LINES = """lines AS (SELECT doc_id, i, n, content, CASE WHEN i = 0 AND doc_id % 3 = 0 THEN 'system'
  WHEN (i + doc_id) % 7 = 6 THEN 'tool' WHEN i % 2 = 0 THEN 'user' ELSE 'assistant' END AS role
 FROM (SELECT doc_id, unnest(range(len(l))) AS i, len(l) AS n, unnest(l) AS content
  FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)))"""


def messages(spark: SparkSession, folder: str, *extra: Column) -> DataFrame:
    def turn(line: Column, i: Column) -> Column:
        role = (
            F.when((i == 0) & (F.col("doc_id") % 3 == 0), "system")
            .when((i + F.col("doc_id")) % 7 == 6, "tool")
            .when(i % 2 == 0, "user")
            .otherwise("assistant")
        )
        return F.struct(role.alias("role"), line.alias("content"))

    docs = table(spark, folder, "documents")
    return docs.select("doc_id", F.transform(F.split("text", "\n"), turn).alias("messages"), *extra)


def _around(template: chat.ChatTemplate, side: str) -> str:
    texts = getattr(template, side)
    return "CASE role " + " ".join(f"WHEN '{r}' THEN {literal(t)}" for r, t in texts.items()) + " ELSE '' END"


def render_sql(
    template: chat.ChatTemplate, source: str = "lines", where: str = "TRUE", generation: bool = False, key: str = "doc_id"
) -> str:
    """(key, text) of the rendered turns of a long table."""
    known = "role IN (" + ", ".join(f"'{r}'" for r in template.opening) + f") AND {where}"
    piece = f"{_around(template, 'opening')} || content || {_around(template, 'closing')}"
    body = f"coalesce(string_agg({piece}, '' ORDER BY i) FILTER (WHERE {known}), '')"
    system = f"coalesce(arg_max(content, i) FILTER (WHERE role = 'system' AND {where}), '') || " if template.system_first else ""
    tail = f" || {literal(template.generation_prompt)}" if generation else ""
    return f"SELECT {key}, {literal(template.start)} || {system}{body}{tail} AS text FROM {source} GROUP BY {key}"


def _rendered(name: str, template: chat.ChatTemplate, generation: bool) -> None:
    @register(name, f"WITH {LINES} {render_sql(template, generation=generation)}")
    def query(spark: SparkSession, folder: str) -> DataFrame:
        shown = chat.render(F.col("messages"), template, add_generation_prompt=generation)
        return messages(spark, folder).select("doc_id", shown.alias("text"))


_rendered("render_default_template", DEFAULT, generation=True)
_rendered("render_think_template", THINK, generation=True)
_rendered("render_chatml_template", CHATML, generation=False)


@register(
    "render_conversation_turns",
    f"SELECT conv_id, turn, {_around(CHATML, 'opening')} || text || {_around(CHATML, 'closing')} AS text FROM conversations",
)
def render_conversation_turns(spark: SparkSession, folder: str) -> DataFrame:
    """Turns stored one per row are rendered where they lie."""
    one = F.array(F.struct("role", F.col("text").alias("content")))
    return table(spark, folder, "conversations").select("conv_id", "turn", chat.render(one, CHATML).alias("text"))


# ---- system turn, checks, unwrapping --------------------------------------------------------------------------


@register(
    "insert_empty_system",
    f"""WITH {LINES}, filled AS (SELECT doc_id, i, role, content FROM lines UNION ALL
 SELECT doc_id, -1, 'system', '' FROM lines WHERE i = 0 AND role <> 'system')
 SELECT doc_id, count(*) AS turns, arg_min(role, i) AS first_role, arg_min(content, i) AS first_content FROM filled GROUP BY doc_id""",
)
def insert_empty_system(spark: SparkSession, folder: str) -> DataFrame:
    filled = messages(spark, folder).select(
        "doc_id", chat.insert_empty_system(F.col("messages"), CHATML).alias("m")
    )
    return filled.select(
        "doc_id",
        F.size("m").cast("bigint").alias("turns"),
        F.get("m", F.lit(0))["role"].alias("first_role"),
        F.get("m", F.lit(0))["content"].alias("first_content"),
    )


@register(
    "message_list_check",
    f"WITH {LINES} SELECT doc_id, bool_and(content <> '') AS is_valid FROM lines GROUP BY doc_id",
)
def message_list_check(spark: SparkSession, folder: str) -> DataFrame:
    """Blank lines become missing contents, which make a list invalid."""
    holed = F.transform(
        "messages",
        lambda m: F.struct(m["role"].alias("role"), F.nullif(m["content"], F.lit("")).alias("content")),
    )
    return messages(spark, folder).select("doc_id", chat.is_message_list(holed).alias("is_valid"))


@register("unwrap_completion", f"WITH {LINES} SELECT doc_id, content AS completion FROM lines WHERE i = 0")
def unwrap_completion(spark: SparkSession, folder: str) -> DataFrame:
    """First message's content of a conversational completion."""
    df = messages(spark, folder).withColumnRenamed("messages", "completion")
    return df.select("doc_id", completion_text(df.schema).alias("completion"))


@register(
    "assistant_bootstrap",
    f"""WITH {LINES}, last AS (SELECT * FROM lines WHERE i = n - 1)
 SELECT r.rollout_id, CASE WHEN l.role = 'assistant' THEN l.content ELSE '' END || r.completion AS completion,
 l.n - CASE WHEN l.role = 'assistant' THEN 1 ELSE 0 END AS prompt_turns
 FROM last l JOIN (SELECT doc_id AS rollout_id, lang || ':' || source AS completion FROM documents) r ON l.doc_id = r.rollout_id""",
)
def assistant_bootstrap(spark: SparkSession, folder: str) -> DataFrame:
    """A trailing assistant turn leaves the prompt and starts the completion."""
    turns = messages(spark, folder, F.concat_ws(":", "lang", "source").alias("done"))
    prompt = F.col("messages")
    return turns.select(
        F.col("doc_id").alias("rollout_id"),
        F.get(chat.conversational_completion(prompt, F.col("done")), F.lit(0))["content"].alias("completion"),
        F.size(chat.without_bootstrap(prompt)).cast("bigint").alias("prompt_turns"),
    )


@register(
    "prompt_completion_text",
    f"""WITH {LINES}, longer AS (SELECT doc_id, i, role, content FROM lines UNION ALL
 SELECT doc_id, n, 'assistant', 'Done.' FROM lines WHERE i = 0) {render_sql(CHATML, 'longer')}""",
)
def prompt_completion_text(spark: SparkSession, folder: str) -> DataFrame:
    """Prompt turns and completion turns rendered as one text for a reward model."""
    reply = F.array(chat.message("assistant", F.lit("Done.")))
    shown = chat.render(F.concat("messages", reply), CHATML)
    return messages(spark, folder).select("doc_id", shown.alias("text"))


# ---- task shaping ---------------------------------------------------------------------------------------------

_FILLED = f"""{LINES}, filled AS (SELECT doc_id, i, role, content FROM lines UNION ALL
 SELECT doc_id, -1, 'system', '' FROM lines WHERE i = 0 AND role <> 'system')"""


@register("shape_sft", f"WITH {_FILLED} {render_sql(DEFAULT, 'filled')}")
def shape_sft(spark: SparkSession, folder: str) -> DataFrame:
    return shape_for_task(messages(spark, folder), "sft", DEFAULT).select("doc_id", "text")


@register("shape_generation", f"WITH {_FILLED} {render_sql(CHATML, 'filled', generation=True)}")
def shape_generation(spark: SparkSession, folder: str) -> DataFrame:
    return shape_for_task(messages(spark, folder), "generation", CHATML).select("doc_id", "text")


def _preferences(spark: SparkSession, folder: str, *extra: Column) -> DataFrame:
    """Chosen is the document's list, rejected the same with a changed last turn."""
    last = F.element_at("messages", -1)
    head = F.slice("messages", F.lit(1), F.size("messages") - 1)
    changed = F.struct(last["role"].alias("role"), F.concat(last["content"], F.lit(" (no)")).alias("content"))
    rows = messages(spark, folder, *extra)
    return rows.select(
        "doc_id",
        F.col("messages").alias("chosen"),
        F.concat(head, F.array(changed)).alias("rejected"),
        *[c for c in rows.columns if c not in ("doc_id", "messages")],
    )


_CHANGED = "rejected AS (SELECT doc_id, i, n, role, CASE WHEN i = n - 1 THEN content || ' (no)' ELSE content END AS content FROM lines)"


def _joined(**texts: str) -> str:
    """Rendered texts side by side."""
    parts = [f"{name}_t AS ({sql})" for name, sql in texts.items()]
    first, *rest = texts
    joins = "".join(f" JOIN {name}_t ON {first}_t.doc_id = {name}_t.doc_id" for name in rest)
    columns = ", ".join(f"{name}_t.text AS text_{name}" for name in texts)
    return ", ".join(parts) + f" SELECT {first}_t.doc_id, {columns} FROM {first}_t{joins}"


def _with_system(source: str) -> str:
    return (
        f"(SELECT doc_id, i, role, content FROM {source} UNION ALL "
        f"SELECT doc_id, -1, 'system', '' FROM {source} WHERE i = 0 AND role <> 'system')"
    )


@register(
    "shape_reward_model",
    f"WITH {LINES}, {_CHANGED}, "
    + _joined(
        chosen=render_sql(CHATML, _with_system("lines")), rejected=render_sql(CHATML, _with_system("rejected"))
    ),
)
def shape_reward_model(spark: SparkSession, folder: str) -> DataFrame:
    return shape_for_task(_preferences(spark, folder), "rm", CHATML).select("doc_id", "text_chosen", "text_rejected")


_HEAD = (
    "(SELECT doc_id, i, role, content, n FROM lines UNION ALL SELECT doc_id, -1, 'system', '', n FROM lines "
    "WHERE i = 0 AND n > 1 AND role <> 'system')"
)


@register(
    "shape_preference",
    f"WITH {LINES}, {_CHANGED}, "
    + _joined(
        prompt=render_sql(CHATML, _HEAD, "i < n - 1"),
        chosen=render_sql(CHATML, "lines", "i = n - 1"),
        rejected=render_sql(CHATML, "rejected", "i = n - 1"),
    ),
)
def shape_preference(spark: SparkSession, folder: str) -> DataFrame:
    """Prompt is the list without its last turn; only the prompt gets a system turn."""
    shaped = shape_for_task(_preferences(spark, folder), "dpo", CHATML)
    return shaped.select("doc_id", "text_prompt", "text_chosen", "text_rejected")


@register(
    "shape_preference_given_prompt",
    f"WITH {LINES}, {_CHANGED}, asked AS (SELECT doc_id, 0 AS i, 'user' AS role, source AS content FROM documents), "
    + _joined(
        prompt=render_sql(CHATML, _with_system("asked")),
        chosen=render_sql(CHATML, "lines"),
        rejected=render_sql(CHATML, "rejected"),
    ),
)
def shape_preference_given_prompt(spark: SparkSession, folder: str) -> DataFrame:
    """A given prompt is used whole, with whole answers."""
    prompt = F.array(chat.message("user", F.col("source"))).alias("prompt")
    shaped = shape_for_task(_preferences(spark, folder, prompt), "orpo", CHATML)
    return shaped.select("doc_id", "text_prompt", "text_chosen", "text_rejected")


# ---- formatters -----------------------------------------------------------------------------------------------


def _fill_sql(template: str, **values: str) -> str:
    for name, value in values.items():
        template = template.replace("{" + name + "}", "\x00" + value + "\x00")
    pieces = template.split("\x00")
    return " || ".join(literal(p) if k % 2 == 0 else f"CAST({p} AS VARCHAR)" for k, p in enumerate(pieces))


_NUMBERS = "'[' || CAST(n1 AS VARCHAR) || ', ' || CAST(n2 AS VARCHAR) || ', ' || CAST(n3 AS VARCHAR) || ']'"


def _countdown_sql(task: str, template: chat.ChatTemplate) -> str:
    o, c = template.opening, template.closing
    return (
        f"{literal(o['system'] + chat.COUNTDOWN_SYSTEM + c['system'] + o['user'])} || "
        f"{_fill_sql(task, numbers=_NUMBERS, target='n1 + n2 - n3')} || "
        f"{literal(c['user'] + o['assistant'] + chat.ASSISTANT_PREFILL)}"
    )


def _countdown(spark: SparkSession, folder: str, task: str, template: chat.ChatTemplate) -> DataFrame:
    df = rollouts(spark, folder)
    target = F.col("n1") + F.col("n2") - F.col("n3")
    nums = F.array("n1", "n2", "n3")
    prompt = chat.render(chat.countdown_messages(nums, target, task), template, continue_final_message=True)
    return df.select("rollout_id", prompt.alias("prompt"), target.alias("target"), chat.number_list(nums).alias("nums"))


@register(
    "format_countdown",
    f"{WITH_ROLLOUTS} SELECT rollout_id, {_countdown_sql(chat.COUNTDOWN_TASK, CHATML)} AS prompt, n1 + n2 - n3 AS target, "
    f"{_NUMBERS} AS nums FROM rollouts",
)
def format_countdown(spark: SparkSession, folder: str) -> DataFrame:
    return _countdown(spark, folder, chat.COUNTDOWN_TASK, CHATML)


@register(
    "format_countdown_with_result",
    f"{WITH_ROLLOUTS} SELECT rollout_id, {_countdown_sql(chat.COUNTDOWN_TASK_WITH_RESULT, DEFAULT)} AS prompt, "
    "n1 + n2 - n3 AS target FROM rollouts",
)
def format_countdown_with_result(spark: SparkSession, folder: str) -> DataFrame:
    return _countdown(spark, folder, chat.COUNTDOWN_TASK_WITH_RESULT, DEFAULT).drop("nums")


_MATH_SYSTEM = "Solve the task."
_INSTRUCTION = "Problem: {problem}\nGive the result in a box."


def _two_turns(system: str, user_sql: str) -> str:
    o, c = CHATML.opening, CHATML.closing
    return f"{literal(o['system'] + system + c['system'] + o['user'])} || {user_sql} || {literal(c['user'])}"


@register(
    "format_math",
    f"SELECT doc_id, {_two_turns(_MATH_SYSTEM, _fill_sql(_INSTRUCTION, problem='text'))} AS prompt FROM documents",
)
def format_math(spark: SparkSession, folder: str) -> DataFrame:
    built = chat.math_messages(F.col("text"), _MATH_SYSTEM, _INSTRUCTION)
    return table(spark, folder, "documents").select("doc_id", chat.render(built, CHATML).alias("prompt"))


@register(
    "format_math_appended",
    f"SELECT doc_id, {literal(CHATML.opening['user'])} || text || ' Think first.' || {literal(CHATML.closing['user'])} AS prompt FROM documents",
)
def format_math_appended(spark: SparkSession, folder: str) -> DataFrame:
    """The instruction follows the problem, without a system turn."""
    built = chat.math_messages(F.col("text"), None, " Think first.", append=True)
    return table(spark, folder, "documents").select("doc_id", chat.render(built, CHATML).alias("prompt"))


_SOLUTION = "CASE doc_id % 3 WHEN 0 THEN ' <answer>' || text || '</answer>' || chr(10) ELSE text END"
_WRAPPED = (
    f"CASE WHEN regexp_matches(s, '^{SP}*<answer>') AND regexp_matches(s, '</answer>{SP}*$') THEN s "
    "ELSE '<answer>' || s || '</answer>.' END"
)


def _solved(spark: SparkSession, folder: str) -> DataFrame:
    tagged = F.concat(F.lit(" <answer>"), "text", F.lit("</answer>\n"))
    docs = table(spark, folder, "documents")
    return docs.select("doc_id", "text", "source", F.when(F.col("doc_id") % 3 == 0, tagged).otherwise(F.col("text")).alias("s"))


@register("wrap_solution", f"SELECT doc_id, {_WRAPPED} AS solution FROM (SELECT doc_id, {_SOLUTION} AS s FROM documents)")
def wrap_solution(spark: SparkSession, folder: str) -> DataFrame:
    return _solved(spark, folder).select("doc_id", chat.wrap_solution(F.col("s")).alias("solution"))


_SHOW = "Look at the image. {problem}"


@register(
    "format_multimodal_base",
    f"SELECT doc_id, '<image>' || {_fill_sql(_SHOW, problem='text')} AS prompt, {_WRAPPED} AS solution, md5(text) AS image "
    f"FROM (SELECT doc_id, text, {_SOLUTION} AS s FROM documents)",
)
def format_multimodal_base(spark: SparkSession, folder: str) -> DataFrame:
    """Image place and text; the image bytes pass through (shown by their digest)."""
    parts = chat.multimodal_base(F.col("text"), _SHOW)
    shown = F.array_join(F.transform(parts, lambda p: F.when(p["type"] == "image", "<image>").otherwise(p["text"])), "")
    rows = _solved(spark, folder).withColumn("image", F.col("text").cast("binary"))
    return rows.select(
        "doc_id", shown.alias("prompt"), chat.wrap_solution(F.col("s")).alias("solution"), F.md5("image").alias("image")
    )


_IMAGE_AND_TEXT = "('<image>' || text)"


@register(
    "format_multimodal_instruct",
    f"SELECT doc_id, {_two_turns(_MATH_SYSTEM, _IMAGE_AND_TEXT)}"
    f" || {literal(CHATML.opening['assistant'] + chat.ASSISTANT_PREFILL + CHATML.closing['assistant'])} AS prompt, {_WRAPPED} AS solution "
    f"FROM (SELECT doc_id, text, {_SOLUTION} AS s FROM documents)",
)
def format_multimodal_instruct(spark: SparkSession, folder: str) -> DataFrame:
    built = chat.multimodal_instruct(F.col("text"), _MATH_SYSTEM)
    return _solved(spark, folder).select(
        "doc_id",
        chat.render_parts(built, CHATML, "<image>").alias("prompt"),
        chat.wrap_solution(F.col("s")).alias("solution"),
    )


_VISUAL_SYSTEM = f"coalesce(system, {literal(chat.VISUAL_SYSTEM)})"


@register(
    "format_visual_sft",
    f"SELECT doc_id, {literal(CHATML.opening['system'])} || {_VISUAL_SYSTEM} || {literal(CHATML.closing['system'] + CHATML.opening['user'])}"
    f" || text || '<image>' || {literal(CHATML.closing['user'] + CHATML.opening['assistant'])} || lang || chr(10) || chr(10) || source || "
    f"{literal(CHATML.closing['assistant'] + CHATML.generation_prompt)} AS texts "
    "FROM (SELECT *, CASE WHEN doc_id % 2 = 0 THEN 'Use the picture.' END AS system FROM documents)",
)
def format_visual_sft(spark: SparkSession, folder: str) -> DataFrame:
    """Nested rows with an optional system text of their own, rendered with a generation prompt."""
    docs = table(spark, folder, "documents")
    nested = docs.select(
        "doc_id",
        F.struct(
            F.when(F.col("doc_id") % 2 == 0, "Use the picture.").alias("system"),
            F.col("lang").alias("thinking"),
            F.col("text").alias("problem"),
            F.col("source").alias("solution"),
        ).alias("messages"),
    )
    m = F.col("messages")
    built = chat.visual_sft(m["problem"], m["thinking"], m["solution"], m["system"])
    return nested.select("doc_id", chat.render_parts(built, CHATML, "<image>", True).alias("texts"))


_HASHED = (
    "CASE o_orderkey % 4 WHEN 0 THEN o_orderpriority WHEN 1 THEN o_orderpriority || ' ####  ' || CAST(o_orderkey % 1000 AS VARCHAR) || '  #### again' "
    "ELSE 'Total #### ' || CAST(o_orderkey % 1000 AS VARCHAR) END"
)


@register(
    "format_grade_school",
    f"""SELECT o_orderkey, {_two_turns(chat.REASONING_SYSTEM, "('Total of order ' || o_orderpriority)")} AS prompt,
 CASE WHEN contains(a, '####') THEN {sql_strip("split_part(a, '####', 2)")} END AS answer
 FROM (SELECT *, {_HASHED} AS a FROM orders)""",
)
def format_grade_school(spark: SparkSession, folder: str) -> DataFrame:
    """Question prompt and the answer behind the mark; null without one."""
    key = (F.col("o_orderkey") % 1000).cast("string")
    raw = (
        F.when(F.col("o_orderkey") % 4 == 0, F.col("o_orderpriority"))
        .when(F.col("o_orderkey") % 4 == 1, F.concat("o_orderpriority", F.lit(" ####  "), key, F.lit("  #### again")))
        .otherwise(F.concat(F.lit("Total #### "), key))
    )
    built = chat.grade_school_messages(F.concat(F.lit("Total of order "), F.col("o_orderpriority")))
    return table(spark, folder, "orders").select(
        "o_orderkey", chat.render(built, CHATML).alias("prompt"), chat.hash_answer(raw).alias("answer")
    )


@register(
    "judge_requests",
    f"{WITH_ROLLOUTS} SELECT rollout_id, {literal(chat.JUDGE_RUBRIC)} AS system_text, 'Given answer:' || chr(10) || completion || chr(10) || chr(10) || "
    "'Reference:' || chr(10) || solution || chr(10) || chr(10) || 'Reply with 1.0 if they agree and 0.0 if they do not.' AS user_text FROM rollouts",
)
def judge_requests(spark: SparkSession, folder: str) -> DataFrame:
    """Request rows for an external judge; the call itself is not made here."""
    built = rollouts(spark, folder).select(
        "rollout_id", chat.judge_request(F.col("completion"), F.col("solution")).alias("m")
    )
    return built.select(
        "rollout_id",
        F.get("m", F.lit(0))["content"].alias("system_text"),
        F.get("m", F.lit(1))["content"].alias("user_text"),
    )
