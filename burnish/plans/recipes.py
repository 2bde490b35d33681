"""Ready-made plans for tables of people, contacts and orders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from burnish.plans.runner import PlanResult, Step, run_plan
from burnish.quality.scores import ORDER_CONTENT as CONTENT_OF_ORDER


def step(action_type: str, **parameters: object) -> Step:
    """One step of a plan."""
    return {"action_type": action_type, "parameters": parameters}


# The placeholder for unknown addresses.
UNKNOWN_EMAIL = "unknown@example.com"
ORDER_CONTENT = list(CONTENT_OF_ORDER)

# The steps of the three ready-made plans, which must lead to the same tables.
CUSTOMERS = (
    step("drop_duplicates"),
    step("normalize_format", column="salary", format_type="strip_currency"),
    step("fill_missing", column="age", strategy="median"),
    step("cast_column", column="age", dtype="int"),
    step("fill_missing", column="salary", strategy="median"),
    step("fill_missing", column="email", strategy="constant", fill_value=UNKNOWN_EMAIL),
    step("standardize_text", column="name", operations=["title"]),
    step("standardize_text", column="department", operations=["strip"]),
)

CONTACTS = (
    step("normalize_format", column="phone", format_type="phone"),
    step("normalize_format", column="birth_date", format_type="date"),
    step("normalize_format", column="email", format_type="email"),
    step("normalize_format", column="zip_code", format_type="zip_code"),
    step("normalize_format", column="country", format_type="text_case", output_format="upper"),
    step("standardize_text", column="first_name", operations=["title"]),
    step("standardize_text", column="last_name", operations=["title"]),
)

ORDERS = (
    step(
        "fix_referential_integrity",
        child_column="customer_id", parent_table="customers", parent_column="customer_id", action="drop",
    ),
    step("drop_duplicates", subset=ORDER_CONTENT),
    step("clip_outliers", column="price", method="iqr", threshold=1.5),
    step("clip_outliers", column="quantity", method="iqr", threshold=1.5),
    step(
        "merge_tables",
        right_table="customers", left_on="customer_id", right_on="customer_id", how="left", columns=["segment"],
    ),
)


def plan_customers(df: DataFrame, **options: object) -> PlanResult:
    """Clean a table of people."""
    return run_plan(df, CUSTOMERS, **options)


def plan_contacts(df: DataFrame, **options: object) -> PlanResult:
    """Clean a table of contacts."""
    return run_plan(df, CONTACTS, **options)


def plan_orders(
    df: DataFrame, customers: DataFrame, order_by: Sequence[str] = ("order_id",), **options: object
) -> PlanResult:
    """Clean a table of orders and add the customers' segment; of equal orders the first in the order stays."""
    return run_plan(df, ORDERS, tables={"customers": customers}, order_by=order_by, **options)


def truth_customers(df: DataFrame, order_by: Sequence[str] = ("id",)) -> DataFrame:
    """What a perfectly cleaned table of people looks like: equal rows under different ids count as copies, too."""
    content = [c for c in df.columns if c != "id"]
    steps = (
        step("drop_duplicates", subset=content),
        step("normalize_format", column="salary", format_type="strip_currency"),
        step("cast_column", column="age", dtype="int"),
        step("standardize_text", column="name", operations=["title"]),
        step("standardize_text", column="department", operations=["strip"]),
        step("fill_missing", column="age", strategy="median"),
        step("fill_missing", column="email", strategy="constant", fill_value=UNKNOWN_EMAIL),
        step("fill_missing", column="salary", strategy="median"),
    )
    return run_plan(df, steps, order_by=order_by).df


def truth_orders(df: DataFrame, customers: DataFrame, order_by: Sequence[str] = ("order_id",)) -> DataFrame:
    """What perfectly cleaned orders look like; the bounds are those of the rows that are left."""
    return plan_orders(df, customers, order_by).df
