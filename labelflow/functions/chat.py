"""Chat messages (F4) and their text rendering.

A message list is ``array<struct<role string, content array<struct<type string, value string>>>>``.
The model's own chat template is not reproduced (no model here); rendering uses neutral role
markers so that the text is stable and tokenizable.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MEDIA_MARK = "<|{type}|>"
ROLE_OPEN = "<|{role}|>\n"
TURN_END = "<|end|>\n"
GENERATION_PROMPT = "<|assistant|>\n"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def part(type_, value) -> Column:
    return F.struct(F.lit(type_).alias("type") if isinstance(type_, str) else type_.alias("type"),
                    _c(value).cast("string").alias("value"))


def message(role: str, *parts: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), F.array(*parts).alias("content"))


def user_message(media, text, mode: str = "image") -> Column:
    """The user turn: one media part (``image`` or ``video``) then the prompt text."""
    return message("user", part(mode, media), part("text", text))


def assistant_message(answer) -> Column:
    return message("assistant", part("text", answer))


def messages_col(media, text, answer=None, mode: str = "image") -> Column:
    """``[user(media, text)]`` plus ``assistant(answer)`` for training rows and exemplars."""
    msgs = [user_message(media, text, mode)]
    if answer is not None:
        msgs.append(assistant_message(answer))
    return F.array(*msgs)


def render_part(p: Column) -> Column:
    return F.when(p["type"] == "text", p["value"]) \
            .otherwise(F.concat(F.lit("<|"), p["type"], F.lit("|>")))


def render_message(m: Column) -> Column:
    return F.concat(F.lit("<|"), m["role"], F.lit("|>\n"),
                    F.array_join(F.transform(m["content"], render_part), ""), F.lit(TURN_END))


def render_chat(messages, generation_prompt: bool = False) -> Column:
    """messages → one text; ``generation_prompt`` appends the assistant opener (scoring
    rows). The reference also appends it to training rows (defect B10); default off here."""
    body = F.array_join(F.transform(_c(messages), render_message), "")
    return F.concat(body, F.lit(GENERATION_PROMPT)) if generation_prompt else body


def render_turn(role, text) -> Column:
    """F5 for one stored message row ``(role, text)``: the same segment ``render_message``
    produces for a one-part text message."""
    return F.concat(F.lit("<|"), _c(role), F.lit("|>\n"), F.coalesce(_c(text), F.lit("")),
                    F.lit(TURN_END))
