"""Running a plan over a table.

The steps of a plan fold into one lazy DataFrame. Only statistics need jobs of their own: those of all steps
that can be known at the same point are taken in one pass, over a result that was written once if a shuffle
lies before it. A step that fails leaves the data as it was.

What the steps did is observed on the way: each step adds its metrics to the plan, and one action over the result
fills them all. If the result was written or counted by then, its own action did. (Spark counts a row again if a lost
executor makes it repeat a shuffle's task, so after such a loss the record may count more than there is; the data does
not change.)
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from burnish.errors import need_choice
from burnish.functions.numbers import present
from burnish.operators.missing import MEASURED
from burnish.operators.outliers import outlier_bounds
from burnish.operators.scratch import settle
from burnish.operators.stats import Need, measure
from burnish.plans.actions import Action, checked

# A step that removes a larger share of the rows than this is reported.
MAX_LOSS = 0.30

Step = Mapping[str, object]
Score = Callable[[DataFrame], float]

AUDIT_SCHEMA = (
    "step int, action_type string, parameters string, success boolean, message string, rows_before bigint, "
    "rows_after bigint, row_loss boolean, score_before double, score_after double, score_delta double, "
    "cells_changed bigint, cells_filled bigint, cells_emptied bigint, rows_removed bigint, rows_added bigint, "
    "rows_flagged bigint, lower_bound double, upper_bound double, fill_value string, columns_added array<string>, "
    "columns_removed array<string>"
)
# Holds a column's values from before the step that edits it, until both are compared.
_BEFORE = "__before_step"


@dataclass
class StepRecord:
    """What one step did. Counts are null where nothing is counted, or where a step has none of the kind."""

    step: int
    action_type: str
    parameters: str
    success: bool
    message: str
    rows_before: int | None = None
    rows_after: int | None = None
    row_loss: bool | None = None
    score_before: float | None = None
    score_after: float | None = None
    score_delta: float | None = None
    #: cells that hold something else now; among them those that held nothing before, or hold nothing now
    cells_changed: int | None = None
    cells_filled: int | None = None
    cells_emptied: int | None = None
    rows_removed: int | None = None
    rows_added: int | None = None
    #: rows marked as having no parent
    rows_flagged: int | None = None
    lower_bound: float | None = None
    upper_bound: float | None = None
    fill_value: str | None = None
    columns_added: list[str] | None = None
    columns_removed: list[str] | None = None


@dataclass
class PlanResult:
    """The cleaned table, the record of the steps, and the statistics they used.

    The counts in the records come from an action over ``df``, or over what was written from it; if there was none yet,
    asking for the records runs one that only counts.
    """

    df: DataFrame
    stats: dict[Need, object] = field(default_factory=dict)
    aborted: bool = False
    max_loss: float = MAX_LOSS
    #: the statistics that each step used, by its place in the plan
    used: list[dict[Need, object]] = field(default_factory=list)
    _records: list[StepRecord] = field(default_factory=list)
    _start: Observation | None = None
    _seen: dict[int, Observation] = field(default_factory=dict)

    @property
    def records(self) -> list[StepRecord]:
        """What each step did."""
        if self._start is not None:
            self._fill_in()
        return self._records

    def audit(self) -> DataFrame:
        """The record as a table, one row per step."""
        rows = [tuple(asdict(r).values()) for r in self.records]
        return self.df.sparkSession.createDataFrame(rows, AUDIT_SCHEMA)

    def _fill_in(self) -> None:
        # Metrics of an action that has ended arrive by way of the queue of listeners.
        self.df.sparkSession.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        if not all(_filled_in(seen) for seen in (self._start, *self._seen.values())):
            self.df.agg(F.count(F.lit(1))).collect()
        rows = int(self._start.get["rows"])
        for record in self._records:
            record.rows_before = record.rows_after = rows
            found = self._seen[record.step].get if record.step in self._seen else {}
            for name, value in found.items():
                setattr(record, "rows_after" if name == "rows" else name, int(value))
            record.row_loss = _too_many_lost(rows, record.rows_after, self.max_loss)
            if record.success:
                record.rows_removed = max(0, rows - record.rows_after)
                record.rows_added = max(0, record.rows_after - rows)
                record.message += _effect(record)
                rows = record.rows_after
            else:
                record.rows_after = rows
        self._start = None


def _filled_in(seen: Observation) -> bool:
    return seen._jo is not None and seen._jo.future().isCompleted()


def _too_many_lost(before: int, after: int, most: float) -> bool:
    return bool(before) and (before - after) / before > most


def run_plan(
    df: DataFrame,
    steps: Sequence[Step],
    tables: Mapping[str, DataFrame] | None = None,
    order_by: Sequence[str] | None = None,
    stats: Mapping[Need, object] | None = None,
    audit: bool = False,
    score: Score | None = None,
    max_loss: float = MAX_LOSS,
    on_loss: str = "flag",
    exact: bool = True,
) -> PlanResult:
    """Apply the steps one after the other.

    ``order_by`` serves the steps that depend on row order and name none. ``audit`` records what each step did, in one
    pass over the plan and without writing anything. ``score`` rates the table after each step. ``stats`` are used as they are, others are taken when needed. With ``on_loss='abort'`` a step
    that removes too many rows is undone and ends the run; only this has to write the result of each such step. Without ``exact`` quartiles and medians are
    approximate, which saves passes over very large tables.
    """
    need_choice("on_loss", on_loss, ("flag", "abort"))
    counting = audit or score is not None or on_loss == "abort"
    result = PlanResult(df, max_loss=max_loss)
    if counting:
        result._start = Observation()
        result.df = df.observe(result._start, F.count(F.lit(1)).alias("rows"))
    given, known = dict(stats or {}), {}
    rows = result.df.count() if on_loss == "abort" else None
    rating = round(score(result.df), 4) if score else None
    heavy = False
    for number, step in enumerate(steps, 1):
        shown = step if isinstance(step, Mapping) else {}
        record = StepRecord(
            number, str(shown.get("action_type")), json.dumps(shown.get("parameters") or {}, default=str), False, "",
            score_before=rating, score_after=rating, score_delta=0.0 if score else None,
        )
        result._records.append(record)
        result.used.append({})
        try:
            name, action, parameters = checked(step)
            if action.accepts("order_by") and order_by and not parameters.get("order_by"):
                parameters["order_by"] = list(order_by)
            known = {**known, **given}
            wanted = action.needs(result.df, parameters)
            needs = [n for n in wanted if n not in known]
            if needs:
                if heavy:
                    result.df, heavy = settle(result.df), False
                ahead = _ahead(result.df, steps[number:], _writes(parameters), known)
                found = measure(result.df, needs + ahead, exact)
                known.update(found)
                result.stats.update(found)
            result.used[-1] = {n: known[n] for n in wanted}
            seen = Observation() if counting else None
            new = _applied(action, result.df, parameters, _supplied(action, tables, known), seen)
            keeps = action.keeps_rows(parameters)
            heavy = heavy or action.heavy
            if on_loss == "abort" and not keeps:
                new, heavy = settle(new), False
                rows, before = int(seen.get["rows"]), rows
        except Exception as failure:  # whatever a plan asks for, a step that cannot be done leaves the data alone
            record.message = f"{type(failure).__name__}: {failure}"
            continue
        if seen is not None and seen._jo is not None:
            result._seen[number] = seen
        if on_loss == "abort" and not keeps and _too_many_lost(before, rows, max_loss):
            record.message = f"aborted: would remove more than {max_loss:.0%} of the rows"
            result.aborted = True
            break
        if counting:
            _note(record, result.df, new, parameters, known)
        record.success, record.message = True, _describe(name, parameters)
        result.df = new
        known = {n: v for n, v in known.items() if keeps and n.column not in _writes(parameters)}
        if score:
            if heavy:
                result.df, heavy = settle(result.df), False
            record.score_after = round(score(result.df), 4)
            record.score_delta = round(record.score_after - rating, 4)
            rating = record.score_after
    return result


def _applied(action: Action, df: DataFrame, parameters: dict, supplied: dict, seen: Observation | None) -> DataFrame:
    """The step's result; with ``seen``, what can be counted of its effect is observed there."""
    if seen is None:
        return action.apply(df, **parameters, **supplied)
    if not action.keeps_rows(parameters):
        return action.apply(df, **parameters, **supplied).observe(seen, F.count(F.lit(1)).alias("rows"))
    if action.edits:
        column = str(parameters["column"])
        kept = df.withColumn(_BEFORE, F.col(f"`{column}`")) if column in df.columns else df
        new = action.apply(kept, **parameters, **supplied)
        return new.observe(seen, *_edits(new, column)).drop(_BEFORE)
    new = action.apply(df, **parameters, **supplied)
    added = [c for c in new.columns if c not in df.columns]
    if parameters.get("action") == "flag" and "child_column" in parameters:
        flag = added[0] if added else f"{parameters['child_column']}_valid"
        return new.observe(seen, F.count_if(F.col(f"`{flag}`") == 0).alias("rows_flagged"))
    return new


def _edits(df: DataFrame, column: str) -> list[Column]:
    """How many cells an edit changed, filled and emptied. Numbers are compared as such, other types as text."""
    old, new = present(df, _BEFORE), present(df, column)
    kinds = [df.schema[c].dataType for c in (_BEFORE, column)]
    if all(isinstance(k, T.NumericType) for k in kinds):
        same = old.cast("double").eqNullSafe(new.cast("double"))
    else:
        same = old.cast("string").eqNullSafe(new.cast("string"))
    return [
        F.count_if(~same).alias("cells_changed"),
        F.count_if(old.isNull() & new.isNotNull()).alias("cells_filled"),
        F.count_if(old.isNotNull() & new.isNull()).alias("cells_emptied"),
    ]


def _note(record: StepRecord, old: DataFrame, new: DataFrame, parameters: Mapping[str, object], known: dict[Need, object]) -> None:
    """What is known of a step without counting: the columns that came and went, the bounds, the value filled in."""
    record.columns_added = [c for c in new.columns if c not in old.columns]
    record.columns_removed = [c for c in old.columns if c not in new.columns]
    column = str(parameters.get("column"))
    if parameters.get("partition_by"):
        return  # every group has values of its own
    if record.action_type == "clip_outliers":
        method, threshold = str(parameters.get("method", "iqr")), parameters.get("threshold", 1.5)
        low, high = parameters.get("bounds") or outlier_bounds(old, column, method, threshold, known)
        record.lower_bound, record.upper_bound = (None if v is None else float(v) for v in (low, high))
    if record.action_type == "fill_missing":
        strategy = str(parameters.get("strategy", "mean"))
        value = known.get(Need(column, MEASURED[strategy])) if strategy in MEASURED else parameters.get("fill_value")
        value = "unknown" if strategy == "unknown" else value
        record.fill_value = None if value is None or strategy not in (*MEASURED, "constant", "unknown") else str(value)


def _effect(record: StepRecord) -> str:
    """What a step did, in words."""
    parts = [
        f"{count} {what}"
        for count, what in (
            (record.rows_removed, "rows removed"),
            (record.rows_added, "rows added"),
            (record.rows_flagged, "rows flagged"),
            (record.cells_changed, "cells changed"),
            (record.cells_filled, "cells filled"),
            (record.cells_emptied, "cells emptied"),
        )
        if count
    ]
    parts += [f"fill value {record.fill_value}"] if record.fill_value is not None else []
    if record.lower_bound is not None or record.upper_bound is not None:
        parts.append(f"bounds {record.lower_bound} to {record.upper_bound}")
    parts += [f"columns added {', '.join(record.columns_added)}"] if record.columns_added else []
    parts += [f"columns removed {', '.join(record.columns_removed)}"] if record.columns_removed else []
    return f": {'; '.join(parts)}" if parts else ": nothing changed"


def _supplied(action: Action, tables: Mapping[str, DataFrame] | None, known: dict[Need, object]) -> dict[str, object]:
    offered = {"tables": tables, "stats": known}
    return {k: v for k, v in offered.items() if action.accepts(k)}


def _writes(parameters: Mapping[str, object]) -> set[str]:
    """The columns a row-preserving step may change."""
    names = ("column", "old_name", "new_name", "child_column")
    return {str(parameters[n]) for n in names if n in parameters}


def _ahead(df: DataFrame, later: Sequence[Step], written: set[str], known: Mapping[Need, object]) -> list[Need]:
    """Statistics of later steps that have the same value now: nothing before them changes rows or their column."""
    found: list[Need] = []
    for step in later:
        try:
            _, action, parameters = checked(step)
            needs = action.needs(df, parameters)
        except Exception:  # it will be reported when its turn comes
            continue
        found += [n for n in needs if n.column in df.columns and n.column not in written and n not in known]
        if not action.keeps_rows(parameters):
            break
        written = written | _writes(parameters)
    return found


def _describe(name: str, parameters: Mapping[str, object]) -> str:
    shown = ", ".join(f"{k}={v!r}" for k, v in parameters.items() if k != "order_by")
    return f"{name}({shown})"
