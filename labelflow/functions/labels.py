"""Label and dataset-profile expressions.

All are plain Column expressions built from the fixed class-name table, so they run inside
whole-stage codegen and need neither a join nor a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelflow.constants import LABEL_NAMES


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def label_int(label) -> Column:
    """``int(label)`` that accepts ``"1"``, ``"1.0"`` and numbers; NULL stays NULL.

    ANSI ``cast('1.0' as int)`` raises, so go through double first. Text that is no whole
    number gives NULL; :func:`malformed_label` tells it from an absent label."""
    return _c(label).cast("string").try_cast("double").try_cast("int")


def malformed_label(label) -> Column:
    """True where a label is given but is no number (``abc``, ``NaN``): such a row belongs into
    quarantine, it is not an unlabelled one."""
    return _c(label).isNotNull() & (F.trim(_c(label).cast("string")) != "") \
        & label_int(label).isNull()


def positive_name(dataset) -> Column:
    """Name of the positive class (key 1) for a dataset column; NULL for an unknown dataset."""
    d = _c(dataset)
    out = F.lit(None).cast("string")
    for name, names in LABEL_NAMES.items():
        out = F.when(d == name, F.lit(names[1])).otherwise(out)
    return out


def negative_name(dataset) -> Column:
    d = _c(dataset)
    out = F.lit(None).cast("string")
    for name, names in LABEL_NAMES.items():
        out = F.when(d == name, F.lit(names[0])).otherwise(out)
    return out


def class_name_col(dataset, label) -> Column:
    """J3 as an expression: ``label_dict[dataset][label]``; NULL when the pair is unknown."""
    d, lab = _c(dataset), _c(label)
    out = F.lit(None).cast("string")
    for name, names in LABEL_NAMES.items():
        for k, v in names.items():
            out = F.when((d == name) & (lab == k), F.lit(v)).otherwise(out)
    return out


def class_names_df(spark: SparkSession) -> DataFrame:
    """The class-name dictionary as a 4-row dimension ``(dataset, label, name)``."""
    rows = [(d, k, v) for d, names in LABEL_NAMES.items() for k, v in names.items()]
    return spark.createDataFrame(rows, "dataset string, label int, name string")


def class_name(df: DataFrame, dataset: str = "dataset", label: str = "label",
               out: str = "label_name", strict: bool = True) -> DataFrame:
    """Attach the class name of ``label``. The reference fails with KeyError on an unknown
    label; ``strict`` raises the same way (NULL labels pass through as NULL)."""
    name = class_name_col(dataset, label)
    if strict:
        name = F.when(F.col(label).isNotNull() & name.isNull(),
                      F.raise_error(F.concat(F.lit("unknown label "), F.col(label).cast("string"),
                                             F.lit(" for dataset "),
                                             F.coalesce(F.col(dataset), F.lit("NULL"))))
                      .cast("string")).otherwise(name)
    return df.withColumn(out, name)


def resolve_profile(path) -> Column:
    """The dataset whose key is a substring of the path; the last matching key wins, as in
    the reference's loop over the dictionary. Raises when no key matches (the reference leaves
    the name unset and fails at its next use)."""
    p = _c(path)
    out = F.raise_error(F.concat(F.lit("no dataset profile matches path "),
                                 F.coalesce(p, F.lit("NULL")))).cast("string")
    for name in LABEL_NAMES:  # later keys are tested first by wrapping last
        out = F.when(p.contains(name), F.lit(name)).otherwise(out)
    return out


def resolve_profile_name(path: str) -> str:
    """S6 for a driver-side path string (one configuration value, not data)."""
    found = None
    for name in LABEL_NAMES:
        if name in path:
            found = name
    if found is None:
        raise ValueError(f"no dataset profile matches path {path!r}")
    return found
