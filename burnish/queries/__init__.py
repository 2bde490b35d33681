"""Every operator as a query on the test tables, with the SQL that must give the same rows."""

from burnish.queries import (  # noqa: F401
    aggregates,
    columns_and_rows,
    groups,
    growing,
    injection,
    marks,
    plans,
    quality,
    relations,
    scores,
    values,
)
from burnish.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
