"""How well a linear model explains revenue, as a measure of how usable a cleaned table is."""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burnish.functions.numbers import numeric
from burnish.operators.joining import equi_join
from burnish.operators.ordered import ranked_values

# With fewer rows no model is fitted; null categories are encoded as this text.
MIN_ROWS = 10
NULL_CATEGORY = "nan"
# Up to this many labels are looked up in the row instead of joined.
SHORT_LIST = 100

FEATURES = ("price", "quantity", "product_enc", "segment_enc")


def label_encode(df: DataFrame, column: str, output: str) -> DataFrame:
    """Add the alphabetical rank of a text column, null counting as the text ``nan``; 0 if there is no such column.

    A short list of labels is looked up in the row; a long one is ranked and joined.
    """
    if column not in df.columns:
        return df.withColumn(output, F.lit(0).cast("long"))
    label = F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(NULL_CATEGORY))
    labels = df.select(label.alias("__value")).distinct()
    few = [r[0] for r in labels.limit(SHORT_LIST + 1).collect()]
    if len(few) <= SHORT_LIST:
        place = F.array_position(F.array(*map(F.lit, sorted(few))), label) if few else F.lit(0)
        return df.withColumn(output, (place - 1).cast("long"))
    codes = ranked_values(labels, "__value", output)
    return equi_join(df.withColumn("__label", label), codes, "__label", "__value", "left", null_safe=False).drop(
        "__label", "__value"
    )


def downstream_r2(df: DataFrame) -> float:
    """R² of price × quantity fitted by price, quantity and the encoded product and segment; 0 if it cannot be.

    The correlations of all pairs come out of one aggregate; the model itself is a system of four equations.
    """
    if "price" not in df.columns or "quantity" not in df.columns:
        return 0.0
    kept = [c for c in ("product", "segment") if c in df.columns]
    rows = df.select(
        numeric(df, "price").alias("price"), numeric(df, "quantity").alias("quantity"), *kept
    ).where("price IS NOT NULL AND quantity IS NOT NULL")
    rows = label_encode(label_encode(rows, "product", "product_enc"), "segment", "segment_enc")
    rows = rows.withColumn("revenue", F.col("price") * F.col("quantity"))
    names = [*FEATURES, "revenue"]
    pairs = list(combinations(range(len(names)), 2))
    spread = [F.var_pop(F.col(n).cast("double")).alias(f"v{i}") for i, n in enumerate(names)]
    links = [
        F.covar_pop(F.col(names[i]).cast("double"), F.col(names[j]).cast("double")).alias(f"c{i}_{j}") for i, j in pairs
    ]
    row = rows.agg(F.count("*").alias("n"), *spread, *links).first()
    if row["n"] < MIN_ROWS:
        return 0.0
    last = len(names) - 1
    if not row[f"v{last}"]:
        return 1.0
    moving = [i for i in range(last) if row[f"v{i}"]]
    scale = np.sqrt(np.array([row[f"v{i}"] for i in range(len(names))], dtype=float))
    matrix = np.eye(len(names))
    for i, j in pairs:
        if scale[i] and scale[j]:
            matrix[i, j] = matrix[j, i] = row[f"c{i}_{j}"] / (scale[i] * scale[j])
    inner, outer = matrix[np.ix_(moving, moving)], matrix[moving, last]
    r2 = float(outer @ np.linalg.pinv(inner) @ outer) if moving else 0.0
    return min(1.0, max(0.0, r2)) if np.isfinite(r2) else 0.0

