"""Cleaning a stream with the steps that look at one row at a time.

Statistics cannot be taken from a stream, so they are taken from a static table first.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

from burnish.errors import CleaningError
from burnish.operators.stats import Need
from burnish.plans.actions import checked
from burnish.plans.runner import Step, run_plan


def freeze_stats(history: DataFrame, steps: Sequence[Step]) -> dict[Need, object]:
    """The statistics that the steps need, taken by running them on a static table of the same kind.

    A plan that measures a column anew after it was edited has two values for one statistic: see ``freeze_steps``.
    """
    found: dict[Need, object] = {}
    for used in freeze_steps(history, steps):
        twice = [n for n, v in used.items() if n in found and found[n] != v]
        if twice:
            raise CleaningError(f"{twice} differ between steps; freeze_steps keeps them apart")
        found.update(used)
    return found


def freeze_steps(history: DataFrame, steps: Sequence[Step], tables: Mapping[str, DataFrame] | None = None) -> list[dict[Need, object]]:
    """The statistics of each step as it saw the table, taken by running the steps on a static table of the same kind."""
    result = run_plan(history, steps, tables=tables)
    failed = [r.message for r in result.records if not r.success]
    if failed:
        raise CleaningError(f"no statistics: {failed[0]}")
    return result.used


def clean_stream(
    stream: DataFrame,
    steps: Sequence[Step],
    tables: Mapping[str, DataFrame] | None = None,
    stats: Mapping[Need, object] | Sequence[Mapping[Need, object]] | None = None,
) -> DataFrame:
    """Apply a plan to a stream; a step that needs more than a row, or an unknown statistic, is an error.

    ``stats`` are those of each step, as ``freeze_steps`` gives them, or one mapping for all steps.
    """
    shared = stats is None or isinstance(stats, Mapping)
    if not shared and len(stats) != len(steps):
        raise CleaningError(f"statistics of {len(stats)} steps for a plan of {len(steps)}")
    for step, known in zip(steps, [stats or {}] * len(steps) if shared else stats, strict=True):
        name, action, parameters = checked(step)
        if not action.streams(parameters):
            raise CleaningError(f"{name} needs the whole table and cannot run on a stream")
        unknown = [n for n in action.needs(stream, parameters) if n not in known]
        if unknown:
            raise CleaningError(f"{name} on a stream needs statistics: {unknown}")
        done = run_plan(stream, [step], tables=tables, stats=known)
        if not done.records[0].success:
            raise CleaningError(done.records[0].message)
        stream = done.df
    return stream
