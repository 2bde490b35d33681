"""Mixing sources to target weights by Poisson replication.

A source of ``n`` documents that shall make up the share ``w`` of ``total`` output rows has the mean repetition rate
``total * w / n``. Each document draws its number of copies from the Poisson distribution of that mean: a number
between 0 and 1 hashed from the seed and its id is looked up in the cumulative distribution, so the draw is the same
whichever executor makes it. The copies are then put in the order of another hash, which shuffles them globally.

Means above ``PART`` are drawn as a sum of several smaller ones, since the distribution would underflow.

Defined results: a null source is a source of its own. A source without a weight, or with one that is null, not
finite or below zero, gets none and so gives no rows. A row without an id draws by a hash of all its columns, so
that different ones draw and are placed apart; rows that share an id, or are equal without one, draw the same number. Empty input or no weight above zero gives no rows. The number of the copy comes in a column ``copy``
(``copy_`` and so on if the documents have one).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from burnish.llm.common import attach, col, fresh, query, row_hash, settle, table

#: Largest mean that is drawn at once.
PART = 16.0
#: Where the cumulative distribution ends: beyond PART + 12 standard deviations nothing is left in double precision.
LAST = 80
SEED = 20240
#: Share of a source as a power of its size: between 1, as the corpus is, and 0, all sources alike.
FLATTEN = 0.5

Weights = dict[str | None, float]


def uniform(*parts: Column | str | int) -> Column:
    """A double in [0, 1) from the first 52 bits of the MD5 of the parts, joined by colons."""
    text = F.concat_ws(":", *[F.lit(str(p)) if not isinstance(p, Column) else F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def _cumulative(mean: Column) -> Column:
    """P(X <= k) for k from 0 to LAST, of a Poisson variable of this mean."""
    start = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("c"))
    step = lambda s, k: F.struct(
        (s["p"] * mean / k).alias("p"),
        F.concat(s["c"], F.array(F.element_at(s["c"], -1) + s["p"] * mean / k)).alias("c"),
    )
    return F.aggregate(F.sequence(F.lit(1), F.lit(LAST)), start, step, lambda s: s["c"])


def rates(docs: DataFrame, source_col: str, weights: Weights | None, total: int | None) -> tuple[DataFrame, int]:
    """Per source: key, rows, mean of a part, number of parts, and a part's cumulative distribution; and the row count."""
    counts = settle(docs.select(col(source_col).cast("string").alias("source")).groupBy("source").agg(F.count(F.lit(1)).alias("n_rows")))
    rows = counts.agg(F.sum("n_rows")).first()[0] or 0
    total = rows if total is None else total
    if weights is None:
        weight = F.pow(F.col("n_rows").cast("double"), F.lit(FLATTEN))
    else:
        good = {k: float(w) for k, w in weights.items() if w is not None and math.isfinite(w) and w > 0}
        weight = F.lit(0.0)
        for name, value in good.items():
            weight = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(value)).otherwise(weight)
    weighed = counts.withColumn("weight", weight)
    whole = weighed.agg(F.sum("weight")).first()[0] or 1.0
    mean = F.col("weight") / F.lit(float(whole)) * F.lit(float(total)) / F.col("n_rows")
    parts = F.greatest(F.lit(1), F.ceil(F.col("mean") / PART)).cast("int")
    out = weighed.withColumn("mean", mean).withColumn("parts", parts).withColumn("cumulative", _cumulative(F.col("mean") / F.col("parts")))
    key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    return settle(out.select(key.alias("key"), "n_rows", "mean", "parts", "cumulative")), rows


def mix(
    docs: DataFrame,
    weights: Weights | None = None,
    total: int | None = None,
    seed: int = SEED,
    source_col: str = "source",
    id_col: str = "doc_id",
) -> DataFrame:
    """``docs`` repeated so that sources have the shares given by ``weights``, in a global random order.

    ``total`` is the mean number of rows of the result, that of ``docs`` by default. Without ``weights`` a source's
    share goes with its size to the power FLATTEN.
    """
    per_source, rows = rates(docs, source_col, weights, total)
    names = {n: fresh(docs, n) for n in ("key", "n_rows", "mean", "parts", "cumulative", "copies", "copy", "place")}
    per_source = per_source.select(*[F.col(n).alias(names[n]) for n in per_source.columns])
    keyed = docs.withColumn(names["key"], F.coalesce(F.concat(F.lit("s"), col(source_col).cast("string")), F.lit("n")))
    met = attach(keyed, per_source, names["key"], names["n_rows"], rows)
    # Rows without an id draw, and are placed, by all they hold. The number drawn is bound once, as the variable of a
    # function over the one element of an array: within the filter it would be hashed anew for every step of the curve.
    nameless = F.when(col(id_col).isNull(), row_hash(docs))
    draw = lambda part: F.transform(
        F.array(uniform(seed, F.coalesce(col(id_col).cast("string"), nameless.cast("string")), part)),
        lambda u: F.size(F.filter(F.col(names["cumulative"]), lambda c: c <= u)),
    )[0]
    copies = F.aggregate(F.sequence(F.lit(1), F.col(names["parts"])), F.lit(0), lambda n, part: n + draw(part))
    drawn = met.where(F.col(names["mean"]) > 0).withColumn(names["copies"], copies).where(F.col(names["copies"]) > 0)
    spread = drawn.withColumn(names["copy"], F.explode(F.sequence(F.lit(1), F.col(names["copies"]))))
    place = F.xxhash64(F.lit(seed), col(id_col), F.col(names["copy"]), nameless)
    placed = spread.select(*[col(c) for c in docs.columns], names["copy"], place.alias(names["place"]))
    return placed.orderBy(names["place"], names["copy"]).drop(names["place"])


ORACLE = f"""
WITH RECURSIVE n AS (SELECT source, count(*) AS n_rows FROM documents GROUP BY source),
m AS (
    SELECT source, mean, greatest(1, ceil(mean / {PART}))::INT AS parts
    FROM (SELECT source, pow(n_rows, {FLATTEN}) / sum(pow(n_rows, {FLATTEN})) OVER () * sum(n_rows) OVER () / n_rows AS mean FROM n)
),
pmf AS (
    SELECT source, parts, mean / parts AS part_mean, 0 AS k, exp(-mean / parts) AS p, exp(-mean / parts) AS below FROM m
    UNION ALL
    SELECT source, parts, part_mean, k + 1, p * part_mean / (k + 1), below + p * part_mean / (k + 1) FROM pmf WHERE k < {LAST}
),
c AS (SELECT source, any_value(parts) AS parts, list(below ORDER BY k) AS cumulative FROM pmf GROUP BY source),
drawn AS (
    SELECT d.*, list_sum(list_transform(range(1, parts + 1), lambda part: len(list_filter(cumulative, lambda x:
        x <= ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '') || ':' || part), 1, 13))::BIGINT / {float(1 << 52)}))))::INT AS copies
    FROM documents d JOIN c ON d.source IS NOT DISTINCT FROM c.source
)
SELECT doc_id, text, lang, source, n_chars, unnest(range(1, copies + 1))::INT AS copy FROM drawn
"""


@query("op7_mixing", ORACLE)
def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))
