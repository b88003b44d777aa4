"""SQL text for the DuckDB oracle, generated from the same fixed values as the Spark side."""

from __future__ import annotations

from labelflow import constants as K


def lit(s: str) -> str:
    """A SQL string literal; newlines become ``chr(10)``."""
    parts = s.split("\n")
    quoted = ["'" + p.replace("'", "''") + "'" for p in parts]
    return " || chr(10) || ".join(quoted)


def pos_sql(ds: str = "dataset") -> str:
    whens = " ".join(f"WHEN {ds} = {lit(d)} THEN {lit(n[1])}" for d, n in K.LABEL_NAMES.items())
    return f"(CASE {whens} END)"


def neg_sql(ds: str = "dataset") -> str:
    whens = " ".join(f"WHEN {ds} = {lit(d)} THEN {lit(n[0])}" for d, n in K.LABEL_NAMES.items())
    return f"(CASE {whens} END)"


def class_name_sql(ds: str = "dataset", label: str = "label") -> str:
    whens = " ".join(f"WHEN {ds} = {lit(d)} AND {label} = {k} THEN {lit(v)}"
                     for d, n in K.LABEL_NAMES.items() for k, v in n.items())
    return f"(CASE {whens} END)"


def question_sql(ds: str = "dataset", mode: str = "'image'") -> str:
    p, n = pos_sql(ds), neg_sql(ds)
    return (f"{lit(K.PROMPT_TEXT_CLOSE)} || {mode} || {lit(K.PROMPT_QUESTION)} || {p} || "
            f"{lit(K.PROMPT_RESPOND)} || {p} || {lit(K.PROMPT_OR)} || {n} || {lit(K.PROMPT_ONE_WORD)}")


def prompt_sql(text: str = "text", ds: str = "dataset", mode: str = "'image'") -> str:
    return f"({lit(K.PROMPT_TEXT_OPEN)} || coalesce({text}, 'None') || {question_sql(ds, mode)})"


def demo_line_sql(description: str, text: str, label_name: str, ds: str = "dataset",
                  mode: str = "'video'") -> str:
    p, n = pos_sql(ds), neg_sql(ds)
    return (f"({lit(K.DEMO_OPEN)} || coalesce({description}, 'None') || {lit(K.DEMO_TEXT)} || "
            f"coalesce({text}, 'None') || {lit(K.DEMO_TEXT_CLOSE)} || {mode} || "
            f"{lit(K.PROMPT_QUESTION)} || {p} || {lit(K.PROMPT_RESPOND)} || {p} || "
            f"{lit(K.PROMPT_OR)} || {n} || {lit(K.PROMPT_ONE_WORD)} || {lit(K.DEMO_ANSWER_SEP)} || "
            f"coalesce({label_name}, 'None') || {lit(K.DEMO_ANSWER_SEP)})")


def parse_sql(resp: str = "response", ds: str = "dataset") -> str:
    norm = f"regexp_replace(lower(trim({resp})), '^[.,!?;:''\"]+|[.,!?;:''\"]+$', '', 'g')"
    return (f"(CASE WHEN {norm} = {pos_sql(ds)} THEN 1 WHEN {norm} = {neg_sql(ds)} THEN 0 "
            f"ELSE NULL END)")


def split_hash_sql(col: str) -> str:
    return f"('0x' || substr(md5('42:' || CAST({col} AS VARCHAR)), 1, 8))::BIGINT"
