"""Errors raised while an operation is being put together, before any data moves."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame


class CleaningError(ValueError):
    """A cleaning operation was asked for something it cannot do."""


def need_column(df: DataFrame, *names: str) -> None:
    """Fail unless every name is a top-level column of ``df``."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise CleaningError(f"no such column {missing}; available: {df.columns}")


def need_choice(what: str, value: object, choices: Iterable[str]) -> None:
    """Fail unless ``value`` is one of ``choices``."""
    allowed = list(choices)
    if value not in allowed:
        raise CleaningError(f"unknown {what} {value!r}; choose from {allowed}")
