"""Column names and fixed values, kept apart from the operators.

Operators take column names as arguments; these records only hold the
defaults used by the queries in ``strandline.plans``.
"""

from __future__ import annotations

from dataclasses import dataclass

# Reserved ids of an encoded code.
PAD_ID = 0
MASK_ID = 1
UNSEEN_ID = 2
EMPTY_ID = 3
FIRST_CODE_ID = 4

# Spellings of a missing value in text sources.
NULL_TOKENS = ("", ".", ".A", "#N/A", "#NA", "N/A", "NA", "NULL", "null", "NaN", "nan")

# Labels used in result tables.
MISSING_LABEL = "<MISSING>"
MISSING_LEVEL = "__MISSING__"
UNSEEN_LEVEL = "__OOV__"
OTHER_LABEL = "<UNSEEN_OR_OTHER>"
OUT_OF_RANGE_LABEL = "<NONFINITE_OR_OUT_OF_RANGE>"

# Outcome leaves, in bit order.
LEAVES = ("none", "ap", "biliary", "sepsis_or_organ", "other")

# Fixed value: two-sided 95% point of the standard normal distribution.
Z95 = 1.959963984540054


@dataclass(frozen=True)
class Encounter:
    """Names of the columns of an encounter table with integer days."""

    key: str = "enc_id"
    entity: tuple[str, ...] = ("year", "entity_id")
    start: str = "start_day"
    stay: str = "stay"
    month: str = "month"
    year: str = "year"
    weight: str = "weight"
    planned: str = "planned_status"
    cause: str = "cause_code"


@dataclass(frozen=True)
class Stay:
    """Names of the columns of an encounter table with timestamps."""

    entity: str = "subject_id"
    key: str = "stay_id"
    begin: str = "begin_ts"
    end: str = "end_ts"
    from_place: str = "from_place"
    to_place: str = "to_place"
