"""Columns of a chat: the messages that ask a model, and the text of what it sends back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The frame of a question with sources, and what stands for none.
SOURCES_HEAD = "【参考资料】\n"
QUESTION_HEAD = "\n\n【用户问题】\n"
NO_SOURCES = "（未检索到知识库相关内容）"

MESSAGE = "array<struct<role:string,content:string>>"


def messages(question: Column, history: Column, sources: Column, mode: Column, rag_prompt: str, chat_prompt: str) -> Column:
    """array<struct<role, content>>: system, the turns of ``history`` (array of struct question, answer; old to new), the question.

    In rag mode the question comes with ``sources`` (array of texts), a blank line between them.  Null or no sources are told as such; a null
    history is empty; null texts are empty; a null or unknown mode is rag.
    """
    said = lambda role, text: F.struct(F.lit(role).alias("role"), F.coalesce(text, F.lit("")).alias("content"))
    asked = F.coalesce(question, F.lit(""))
    chat = F.coalesce(F.lower(mode) == "chat", F.lit(False))
    held = F.when(F.coalesce(F.size(sources), F.lit(0)) > 0, F.array_join(F.transform(sources, lambda s: F.coalesce(s, F.lit(""))), "\n\n")).otherwise(NO_SOURCES)
    framed = F.concat(F.lit(SOURCES_HEAD), held, F.lit(QUESTION_HEAD), asked)
    turns = F.flatten(F.transform(history, lambda t: F.array(said("user", t["question"]), said("assistant", t["answer"]))))
    first = F.array(said("system", F.when(chat, chat_prompt).otherwise(rag_prompt)))
    return F.concat(first, F.coalesce(turns, F.array().cast(MESSAGE)), F.array(said("user", F.when(chat, asked).otherwise(framed))))


def content_text(content: Column) -> Column:
    """Text of a part of an answer, given as VARIANT: a string itself, a list's strings and ``text`` fields in a row, an object's ``text``; empty for all else.

    A ``text`` that isn't a string is taken as JSON writes it, null as empty.
    """
    field = lambda v: F.coalesce(F.try_variant_get(v, "$.text", "string"), F.lit(""))
    kind = lambda v: F.schema_of_variant(v)
    one = lambda v: F.when(kind(v) == "STRING", F.try_variant_get(v, "$", "string")).when(kind(v).startswith("OBJECT"), field(v)).otherwise("")
    parts = F.transform(F.try_variant_get(content, "$", "array<variant>"), one)
    return F.coalesce(F.when(kind(content).startswith("ARRAY"), F.array_join(parts, "")).otherwise(one(content)), F.lit(""))
