"""Prompt text expressions.

Plain ``concat`` of literals and columns: one substitution of the item text, so braces or
quotes inside the text are kept as they are. A NULL text prints as ``None``, as Python's
string formatting does.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from labelflow import constants as K
from labelflow.functions.labels import negative_name, positive_name


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _mode(mode) -> Column:
    return F.lit(mode) if isinstance(mode, str) and mode in ("image", "video") else _c(mode)


def question(dataset, mode="image") -> Column:
    """The instruction after the text: modality word, positive name twice, negative once."""
    pos, neg = positive_name(dataset), negative_name(dataset)
    return F.concat(F.lit(K.PROMPT_TEXT_CLOSE), _mode(mode), F.lit(K.PROMPT_QUESTION), pos,
                    F.lit(K.PROMPT_RESPOND), pos, F.lit(K.PROMPT_OR), neg,
                    F.lit(K.PROMPT_ONE_WORD))


def prompt_col(text="text", dataset="dataset", mode="image") -> Column:
    """F1 (training, always ``image``) and F2 (scoring, ``image`` or the ``mode`` value)."""
    return F.concat(F.lit(K.PROMPT_TEXT_OPEN), F.coalesce(_c(text), F.lit("None")),
                    question(dataset, mode))


def demo_line_col(description="description", text="text", label_name="label",
                  dataset="dataset", mode="video") -> Column:
    """one exemplar sentence of the text-block few-shot prompt, ending with its class name."""
    pos, neg = positive_name(dataset), negative_name(dataset)
    return F.concat(
        F.lit(K.DEMO_OPEN), F.coalesce(_c(description), F.lit("None")),
        F.lit(K.DEMO_TEXT), F.coalesce(_c(text), F.lit("None")),
        F.lit(K.DEMO_TEXT_CLOSE), _mode(mode), F.lit(K.PROMPT_QUESTION), pos,
        F.lit(K.PROMPT_RESPOND), pos, F.lit(K.PROMPT_OR), neg, F.lit(K.PROMPT_ONE_WORD),
        F.lit(K.DEMO_ANSWER_SEP), F.coalesce(_c(label_name), F.lit("None")),
        F.lit(K.DEMO_ANSWER_SEP))


def frame_path_col(frames="frames", idx="frame_idx") -> Column:
    """``{frames}/{i}.png``."""
    return F.format_string("%s/%d.png", _c(frames), _c(idx))
