"""Chat formatting over typed content parts. Built-in column functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
#: Placeholder and expanded tokens per unit (an image tile, a second of audio, a page) of each attachment kind.
ATTACHMENTS = {"image": ("<|image|>", 256), "audio": ("<|audio|>", 25), "document": ("<|document|>", 600)}
#: Strings that a text must not be able to forge: this template's own and those of other common templates.
CONTROL = (START, END, *(mark for mark, _ in ATTACHMENTS.values()), "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]")
PART = "struct<kind:string,text:string,ref:string,units:int>"


def escape(text: Column) -> Column:
    r"""Reversible: a backslash is doubled, and a control string gets a backslash after its first character."""
    out = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    for mark in CONTROL:
        out = F.replace(out, F.lit(mark), F.lit(mark[0] + "\\" + mark[1:]))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def text_part(text: Column) -> Column:
    """A content of one text part."""
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("units")))


def flatten(parts: Column) -> Column:
    """The visitor: parts in order become one text, each attachment a placeholder; a kind it does not know gives its text."""

    def visit(part: Column) -> Column:
        out = escape(part["text"])
        for kind, (mark, _) in ATTACHMENTS.items():
            out = F.when(part["kind"] == kind, F.lit(mark)).otherwise(out)
        return out

    return F.array_join(F.transform(F.coalesce(parts, F.array().cast(f"array<{PART}>")), visit), "")


def attachments(parts: Column) -> Column:
    """kind, ref and expanded token count of every attachment, in the order of the placeholders."""
    held = F.filter(F.coalesce(parts, F.array().cast(f"array<{PART}>")), lambda p: p["kind"].isin(*ATTACHMENTS))

    def expanded(part: Column) -> Column:
        each = F.lit(0)
        for kind, (_, tokens) in ATTACHMENTS.items():
            each = F.when(part["kind"] == kind, F.lit(tokens)).otherwise(each)
        return F.struct(part["kind"].alias("kind"), part["ref"].alias("ref"), (F.coalesce(part["units"], F.lit(1)) * each).cast("long").alias("tokens"))

    return F.transform(held, expanded)


def format_chats(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """conv_id, formatted, loss_spans, attachments, attachment_tokens of each conversation.

    ``turns(conv_id, turn, role, parts)``. A turn is START, its role, a line end, its flattened content, END and a line
    end. ``loss_spans`` are (start, length) in code points of the formatted text: the content of every turn of
    ``loss_role``, without markers. A conversation is one row of the result and so has to fit a row; its turns are
    placed by a running sum and then collected, both in the same exchange.

    Turns are ordered by turn, role and content; repeated turns stay. Null role or part text: empty. Null parts: no
    content. Null conv_id: one conversation. Line ends in a role are escaped too. Empty table: empty result. Other
    columns are ignored.
    """
    role = F.replace(escape(F.col("role")), F.lit("\n"), F.lit("\\\n"))
    rows = turns.select(
        "conv_id",
        "turn",
        F.concat(F.lit(START), role, F.lit("\n")).alias("_open"),
        flatten(F.col("parts")).alias("_body"),
        (F.coalesce(F.col("role"), F.lit("")) == loss_role).alias("_loss"),
        attachments(F.col("parts")).alias("_held"),
    )
    order = Window.partitionBy("conv_id").orderBy("turn", "_open", "_body")
    piece = F.concat("_open", "_body", F.lit(END + "\n"))
    rows = rows.withColumn("_piece", piece).withColumn("_at", F.row_number().over(order))
    before = F.coalesce(F.sum(F.length("_piece")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("_start", (before + F.length("_open")).cast("int"))
    span = F.when(F.col("_loss"), F.struct(F.col("_start").alias("start"), F.length("_body").alias("length")))
    row = F.struct(F.col("_at").alias("at"), F.col("_piece").alias("piece"), span.alias("span"), F.col("_held").alias("held"))
    chats = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(row)).alias("_rows"))
    held = F.flatten("_rows.held")
    return chats.select(
        "conv_id",
        F.array_join("_rows.piece", "").alias("formatted"),
        F.filter("_rows.span", lambda s: s.isNotNull()).alias("loss_spans"),
        held.alias("attachments"),
        F.aggregate(held, F.lit(0).cast("long"), lambda n, h: n + h["tokens"]).alias("attachment_tokens"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text as array<struct<role, text>>, escapes undone. Placeholders stay as they are."""
    pieces = F.split(formatted, r"<\|im_end\|>\n")
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)
    head = r"(?s)\A<\|im_start\|>((?:[^\\\n]|\\.)*+)\n"

    def turn(piece: Column) -> Column:
        role = F.regexp_extract(piece, head, 1)
        body = F.substr(piece, F.length(role) + len(START) + 2)
        return F.struct(unescape(role).alias("role"), unescape(body).alias("text"))

    return F.transform(pieces, turn)


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, escapes undone, nothing between the spans."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, s["start"] + 1, s["length"]))), "")


def chat_digest(conversations: DataFrame) -> DataFrame:
    """Digests read back from the formatted output of ``conversations`` and of conversation -1."""
    spark = conversations.sparkSession
    probe = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, F.lit("user")).otherwise(F.lit("assistant")).alias("role"),
        F.lit(probe).alias("text"),
    )
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(extra)
    out = format_chats(rows.select("conv_id", "turn", "role", text_part(F.col("text")).alias("parts")))
    turns = read_turns(F.col("formatted"))
    said = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learned = loss_text(F.col("formatted"), F.col("loss_spans"))
    return out.select(
        "conv_id",
        F.size(turns).cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length(learned).cast("long").alias("loss_chars"),
        F.sha2(learned, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def _escaped_sql(text: str) -> str:
    out = rf"replace({text}, '\', '\\')"
    for mark in CONTROL:
        out = rf"replace({out}, '{mark}', '{mark[0]}\{mark[1:]}')"
    return out


CHAT_SQL = rf"""
WITH turns AS (
 SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
 UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized AS (
 SELECT *, length({_escaped_sql('text')}) + length(replace({_escaped_sql('role')}, chr(10), '\' || chr(10))) + {len(START) + len(END) + 2} AS chars
 FROM turns)
SELECT conv_id, count(*) AS n_turns,
 sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
 coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
 sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
 sum(chars)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""
