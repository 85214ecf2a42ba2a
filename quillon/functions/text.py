"""Plain text and chat message expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.fixed_values import PREVIEW_LIMIT, SYSTEM_PROMPT, WHITESPACE, WHITESPACE_CLASS


def strip(text: Column) -> Column:
    """Without white space at either end, Unicode white space included."""
    return F.btrim(text, F.lit(WHITESPACE))


def ensure_question(question: Column) -> Column:
    """Stripped, and ending in a question mark."""
    bare = strip(question)
    return F.when(bare.endswith("?"), bare).otherwise(F.concat(bare, F.lit("?")))


def ensure_question_unstripped(question: Column) -> Column:
    """Ending in a question mark unless empty; white space is kept."""
    return F.when((question == "") | question.endswith("?"), question).otherwise(
        F.concat(question, F.lit("?"))
    )


def preview_text(text: Column, limit: int = PREVIEW_LIMIT) -> Column:
    """One line for a report: white space collapsed, cut with an ellipsis; null gives ''."""
    line = F.regexp_replace(strip(text), f"[{WHITESPACE_CLASS}]+", " ")
    cut = F.when(F.char_length(line) <= limit, line).otherwise(
        F.concat(F.substring(line, 1, limit), F.lit("..."))
    )
    return F.coalesce(cut, F.lit(""))


def message(role: str | Column, content: Column) -> Column:
    """One chat message."""
    role_col = F.lit(role) if isinstance(role, str) else role
    return F.struct(role_col.alias("role"), content.alias("content"))


def chat_messages(content: Column, role: str | Column = "assistant") -> Column:
    """A message list of one turn."""
    return F.array(message(role, content))


def last_message_text(messages: Column) -> Column:
    """Content of the last message of a list; '' for an empty or missing list."""
    return F.coalesce(F.try_element_at(messages, F.lit(-1))["content"], F.lit(""))


def build_prompt(
    question: Column, schema_text: Column | None = None, system_prompt: str = SYSTEM_PROMPT
) -> Column:
    """System message plus user message with the question and, if given, the schema.

    A null ``schema_text`` leaves the schema section out of that row.
    """
    parts = [F.concat(F.lit("### Question\n"), question)]
    if schema_text is not None:
        parts.append(F.concat(F.lit("### Schema\n"), schema_text))
    return F.array(
        message("system", F.lit(system_prompt)), message("user", F.concat_ws("\n", *parts))
    )


def prompt_record(
    question: Column, schema: Column, schema_text: Column, answer: Column, source: Column,
    db_id: Column, system_prompt: str = SYSTEM_PROMPT,
) -> list[Column]:
    """The five columns of a prompt record."""
    return [
        build_prompt(question, schema_text, system_prompt).alias("prompt"),
        answer.alias("solution"),
        schema.alias("schema"),
        source.alias("source"),
        db_id.alias("db_id"),
    ]
