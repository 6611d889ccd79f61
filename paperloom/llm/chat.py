"""Chat formatting with typed content parts, in DataFrame functions only.

A visitor turns the parts of a message into text and placeholders in order, records each attachment's reference and the
tokens that its placeholder will expand to, and the template marks turns. Control strings inside texts are escaped
reversibly, so the output can be read back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
MARKS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"


def escape(text: Column) -> Column:
    """``text`` without any control string; `unescape` restores it exactly."""
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;|"), F.lit("<|")), F.lit("&amp;"), F.lit("&"))


def escape_role(role: Column) -> Column:
    """``role`` as one line without any control string; `unescape_role` restores it exactly."""
    return F.replace(escape(role), F.lit("\n"), F.lit("&#10;"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("&#10;"), F.lit("\n")))


def expanded(part: Column, patch: int = 14, audio_rate: int = 25, page_tokens: int = 256) -> Column:
    """Tokens that a non-text part's placeholder stands for: patches, audio frames, or pages. Unknown sizes count 0."""
    size = F.ceil(part["width"] / patch) * F.ceil(part["height"] / patch)
    count = F.when(part["kind"] == "image", size).when(part["kind"] == "audio", F.ceil(part["seconds"] * audio_rate)).when(part["kind"] == "document", part["pages"] * page_tokens)
    return F.coalesce(count, F.lit(0)).cast("long")


def visit(parts: Column) -> tuple[Column, Column]:
    """The escaped text of ``parts`` with placeholders in order, and the attachments as (at, kind, ref, tokens)."""

    def flat(p: Column) -> Column:
        out = F.when(p["kind"].isNull() | (p["kind"] == "text"), escape(F.coalesce(p["text"], F.lit(""))))
        for kind, text in MARKS.items():
            out = out.when(p["kind"] == kind, F.lit(text))
        return out.otherwise(F.lit(""))

    media = F.filter(F.transform(parts, lambda p, i: F.struct(i.alias("at"), p["kind"].alias("kind"), p["ref"].alias("ref"), expanded(p).alias("tokens"))), lambda a: a["kind"].isin(*MARKS))
    return F.array_join(F.transform(parts, flat), ""), media


def format_chats(messages: DataFrame) -> DataFrame:
    """(conv_id, n_turns, formatted, attachments) of ``messages`` (conv_id, turn, role, parts), one row a conversation.

    Turns go by ``turn``, null first, ties by role and then text; repeated rows stay. Null roles count as empty, line ends in roles are escaped, null parts
    as no parts, unknown kinds of part as nothing. The turns of a conversation meet in one row, since they are one text.
    """
    text, media = visit(F.coalesce("parts", F.array().cast(f"array<{PART}>")))
    rows = messages.select("conv_id", F.struct(F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), text.alias("text"), media.alias("media")).alias("m"))
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("m")).alias("turns"))
    one = lambda t: F.concat(F.lit(START), escape_role(t["role"]), F.lit("\n"), t["text"], F.lit(END + "\n"))
    return turns.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.array_join(F.transform("turns", one), "").alias("formatted"),
        F.flatten(F.transform("turns", lambda t, i: F.transform(t["media"], lambda a: F.struct(i.alias("turn"), a["at"].alias("at"), a["kind"].alias("kind"), a["ref"].alias("ref"), a["tokens"].alias("tokens"))))).alias("attachments"),
    )


def read_back(formatted: Column) -> Column:
    """The turns of a formatted text as array<struct<role, text>>, unescaped; placeholders stay as marks."""
    whole = F.filter(F.split(formatted, r"<\|im_end\|>\n"), lambda s: s != "")
    return F.transform(whole, lambda s: F.struct(
        unescape_role(F.substring_index(F.substr(s, F.lit(len(START) + 1)), "\n", 1)).alias("role"),
        unescape(F.substr(s, F.instr(s, "\n") + 1)).alias("text"),
    ))


def digest(formatted: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), all read back from ``formatted``.

    The loss mask covers the text of each assistant turn.
    """
    turns = formatted.select("conv_id", F.length("formatted").cast("long").alias("formatted_chars"), read_back(F.col("formatted")).alias("turns"))
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["role"] == "assistant"), lambda t: t["text"]), "")
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    turns = turns.select("conv_id", "formatted_chars", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), loss.alias("loss"))
    return turns.select("conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


def text_messages(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) rows as messages of one text part; a null text is an empty one."""
    part = F.struct(F.lit("text").alias("kind"), F.coalesce("text", F.lit("")).alias("text"), *(F.lit(None).cast(t).alias(n) for n, t in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))))
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.array(part).alias("parts"))
