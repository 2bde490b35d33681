"""The actions a plan may name, and what running them involves."""

from __future__ import annotations

import inspect
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from burnish.errors import CleaningError, need_choice
from burnish.operators.columns import cast_column, drop_column, rename_column
from burnish.operators.formats import apply_regex, normalize_format, standardize_text
from burnish.operators.missing import MEASURED, fill_missing
from burnish.operators.outliers import bounds_needed, clip_outliers
from burnish.operators.references import fix_referential_integrity, merge_tables
from burnish.operators.rows import drop_duplicates, drop_rows_by_condition
from burnish.operators.stats import DATE_VOTES, WHOLE, Need

Parameters = Mapping[str, object]


def _nothing(df: DataFrame, p: Parameters) -> list[Need]:
    return []


def _fill_needs(df: DataFrame, p: Parameters) -> list[Need]:
    kind = MEASURED.get(str(p.get("strategy", "mean")))
    return [Need(str(p["column"]), kind)] if kind and not p.get("partition_by") else []


def _cast_needs(df: DataFrame, p: Parameters) -> list[Need]:
    column = str(p["column"])
    checked = p["dtype"] in ("int", "integer") and p.get("on_fraction", "fail") == "fail"
    whole = column in df.columns and isinstance(df.schema[column].dataType, T.IntegralType)
    return [Need(column, WHOLE)] if checked and not whole else []


def _format_needs(df: DataFrame, p: Parameters) -> list[Need]:
    column = str(p["column"])
    voted = p.get("format_type") == "date" and p.get("by_column") and column in df.columns
    time = voted and isinstance(df.schema[column].dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))
    return [Need(column, DATE_VOTES)] if voted and not time else []


def _clip_needs(df: DataFrame, p: Parameters) -> list[Need]:
    return [] if p.get("bounds") or p.get("partition_by") else bounds_needed(str(p["column"]), str(p.get("method", "iqr")))


@dataclass(frozen=True)
class Action:
    """How to apply an action, whether it can change the number of rows, and what it must know first.

    The result of a ``heavy`` action is worth keeping before the table is read more than once. An action that ``edits``
    puts other values into the one column it names.
    """

    apply: Callable[..., DataFrame]
    keeps_rows: Callable[[Parameters], bool] = lambda p: True
    needs: Callable[[DataFrame, Parameters], list[Need]] = _nothing
    streams: Callable[[Parameters], bool] = lambda p: True
    heavy: bool = False
    edits: bool = False

    def accepts(self, name: str) -> bool:
        return name in inspect.signature(self.apply).parameters


ACTIONS: dict[str, Action] = {
    "fill_missing": Action(
        fill_missing,
        keeps_rows=lambda p: p.get("strategy") != "drop",
        needs=_fill_needs,
        streams=lambda p: p.get("strategy") not in ("forward_fill", "backward_fill") and not p.get("partition_by"),
        edits=True,
    ),
    "drop_duplicates": Action(drop_duplicates, keeps_rows=lambda p: False, streams=lambda p: False, heavy=True),
    "cast_column": Action(cast_column, needs=_cast_needs, edits=True),
    "rename_column": Action(rename_column),
    "normalize_format": Action(normalize_format, needs=_format_needs, edits=True),
    "apply_regex": Action(apply_regex, edits=True),
    "drop_column": Action(drop_column),
    "drop_rows_by_condition": Action(drop_rows_by_condition, keeps_rows=lambda p: False),
    "clip_outliers": Action(
        clip_outliers,
        keeps_rows=lambda p: p.get("method") != "drop",
        needs=_clip_needs,
        streams=lambda p: not p.get("partition_by"),
        edits=True,
    ),
    "standardize_text": Action(standardize_text, edits=True),
    "fix_referential_integrity": Action(
        fix_referential_integrity, keeps_rows=lambda p: p.get("action") == "flag", heavy=True
    ),
    "merge_tables": Action(
        merge_tables, keeps_rows=lambda p: False, streams=lambda p: p.get("how", "left") in ("left", "inner"), heavy=True
    ),
}

# What a run supplies by itself; a plan cannot set these.
SUPPLIED = ("df", "stats", "tables", "limits")


def checked(step: Mapping[str, object]) -> tuple[str, Action, dict[str, object]]:
    """The action of a step and its parameters, if the action exists and takes them."""
    if not isinstance(step, Mapping):
        raise CleaningError(f"a step is an object with action_type and parameters, not {step!r}")
    name, given = step.get("action_type"), step.get("parameters") or {}
    if not isinstance(name, str) or not isinstance(given, Mapping):
        raise CleaningError(f"a step is an object with action_type and parameters, not {step!r}")
    parameters = dict(given)
    need_choice("action", name, ACTIONS)
    action = ACTIONS[str(name)]
    known = inspect.signature(action.apply).parameters
    wrong = [p for p in parameters if p not in known or p in SUPPLIED]
    absent = [
        n for n, p in known.items() if p.default is p.empty and n not in parameters and n not in SUPPLIED
    ]
    if wrong or absent:
        raise CleaningError(f"bad parameters for {name!r}: unknown {wrong}, missing {absent}")
    return str(name), action, parameters
