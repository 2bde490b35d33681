"""Reading steps out of free text, such as the replies of an assistant."""

from __future__ import annotations

import inspect
import json
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from burnish.errors import CleaningError, need_column
from burnish.functions.text import strip
from burnish.plans.actions import ACTIONS

# A fenced block, and the fields of a step.
FENCE_PATTERN = r"```(?:json)?\s*([\s\S]*?)```"
# Steps of a plan that may come to the driver.
MAX_STEPS = 1_000
STEP_SCHEMA = "array<struct<action_type: string, parameters: map<string, string>>>"


def parse_actions(df: DataFrame, text: str) -> DataFrame:
    """Add ``action_type`` and ``parameters`` read from a JSON object in a text column, bare or in a fence.

    Both are null where the text holds no such object. Nested parameters arrive as JSON text.
    """
    need_column(df, text)
    whole = strip(F.col(f"`{text}`"))
    fenced = whole.contains("```") & whole.rlike(FENCE_PATTERN)
    body = F.when(fenced, strip(F.regexp_extract(whole, FENCE_PATTERN, 1))).otherwise(whole)
    # As the only element of an array an object must be followed by nothing else.
    listed = F.concat(F.lit("["), F.col("__body"), F.lit("]"))
    parsed = F.from_json(listed, STEP_SCHEMA, {"allowSingleQuotes": "false"})
    found, step = F.size("__steps") == 1, F.col("__steps")[0]
    nothing = F.create_map().cast("map<string,string>")
    return (
        df.withColumn("__body", body)
        .withColumn("__steps", F.when(F.col("__body").startswith("{"), parsed))
        .withColumns(
            {
                "action_type": F.when(found, F.coalesce(step["action_type"], F.lit(""))),
                "parameters": F.when(found, F.coalesce(step["parameters"], nothing)),
            }
        )
        .drop("__body", "__steps")
    )


def reply_plans(parsed: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per group of parsed replies: replies, steps, and known_steps, those that name an action there is.

    Each group is a plan of its own. Replies stay in Spark until one plan is chosen from these counts.
    """
    need_column(parsed, "action_type", *by)
    known = F.coalesce(F.col("action_type").isin(*ACTIONS), F.lit(False))
    return parsed.groupBy(*[F.col(f"`{c}`") for c in by]).agg(
        F.count("*").alias("replies"), F.count("action_type").alias("steps"), F.count_if(known).alias("known_steps")
    )


def best_plan(parsed: DataFrame, by: Sequence[str], order_by: Sequence[str], most: int = MAX_STEPS) -> list[dict[str, object]]:
    """The steps of the group with the most known steps (then the smallest key), of which only this group is collected."""
    plans = reply_plans(parsed, by).where(F.col("known_steps") > 0)
    best = plans.orderBy(F.desc("known_steps"), *[F.col(f"`{c}`").asc_nulls_last() for c in by]).limit(1).collect()
    if not best:
        return []
    chosen = reduce(Column.__and__, [F.col(f"`{c}`").eqNullSafe(F.lit(best[0][c])) for c in by])
    return steps_from(parsed.where(chosen), order_by, most)


def steps_from(parsed: DataFrame, order_by: Sequence[str], most: int = MAX_STEPS) -> list[dict[str, object]]:
    """The parsed steps as a plan that ``run_plan`` takes, in the given order; rows without a step are left out.

    A parameter gets the type that its action declares: text stays text, and lists, objects, numbers and truth values are
    read from their JSON. A plan is short, so it comes to the driver; more than ``most`` steps are no plan but an error.
    """
    need_column(parsed, "action_type", "parameters", *order_by)
    ordered = parsed.where("action_type IS NOT NULL").orderBy(*[F.col(f"`{c}`") for c in order_by])
    rows = ordered.select("action_type", "parameters").limit(most + 1).collect()
    if len(rows) > most:
        raise CleaningError(f"more than {most} steps: choose the replies of one plan")
    return [{"action_type": r["action_type"], "parameters": _typed(r["action_type"], r["parameters"] or {})} for r in rows]


def _typed(action: str, parameters: dict[str, str | None]) -> dict[str, object]:
    declared = inspect.signature(ACTIONS[action].apply).parameters if action in ACTIONS else {}
    out: dict[str, object] = {}
    for name, text in parameters.items():
        kind = str(declared[name].annotation) if name in declared else "object"
        if text is None or kind in ("str", "str | None"):
            out[name] = text
            continue
        try:
            out[name] = json.loads(text)
        except ValueError:
            out[name] = text
    return out
