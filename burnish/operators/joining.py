"""Equality joins that stay even when one key holds a large share of the rows.

A side is broadcast only after its bytes were added up. Otherwise the keys that hold very many rows are looked
up; if there are any, the rows of each are spread over as many tasks as its count asks for, and the other side's rows
are repeated to meet them. Everything else is an ordinary join. Where only the presence of a key matters, different keys
are compared instead of rows, and rows whose key is certain to be there are not shuffled at all.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from burnish.errors import CleaningError
from burnish.operators.keyfilter import hash_of, marked, packed_filter
from burnish.operators.scratch import settle, settled

# Bytes to reckon with for a value of fixed size, or besides the bytes of a text.
FIXED_WIDTH = 16
_FIXED = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


@dataclass(frozen=True)
class JoinLimits:
    """When to broadcast a side, how many rows of one key a task may get, and how large the list of hot keys may be."""

    broadcast_bytes: int = 64 * 1024 * 1024
    hot_rows: int = 1_000_000
    list_bytes: int = 64 * 1024 * 1024


LIMITS = JoinLimits()


def is_small(df: DataFrame, limit: int) -> bool:
    """Whether all values of ``df`` take at most ``limit`` bytes: counted, not estimated.

    The number of rows settles it for large tables; only for few rows is the length of their text added up.
    """
    rows = df.count()
    if rows * FIXED_WIDTH * max(1, len(df.columns)) > limit:
        return False
    sized = [f for f in df.schema.fields if not isinstance(f.dataType, _FIXED)]
    if not sized or not rows:
        return True
    fixed = F.lit(FIXED_WIDTH * (len(df.columns) - len(sized)))
    return df.agg(F.sum(sum((_width(f) for f in sized), fixed))).first()[0] <= limit


def _width(field: T.StructField) -> Column:
    value = F.col(f"`{field.name}`")
    text = value if isinstance(field.dataType, (T.StringType, T.BinaryType)) else F.to_json(F.struct(value))
    return F.coalesce(F.octet_length(text), F.lit(0)) + FIXED_WIDTH


def hot_keys(df: DataFrame, key: str, limits: JoinLimits = LIMITS) -> DataFrame | None:
    """Rows (key, salts) for the keys with more than ``hot_rows`` rows, salts being the tasks that each is spread over.

    None if there is no such key. There are at most rows / ``hot_rows`` of them; if their text makes the list larger
    than what may be broadcast, only keys with twice as many rows are listed, and so on.
    """
    if df.isStreaming:
        return None
    counted = df.groupBy(F.col(f"`{key}`").alias("key")).count().where(F.col("count") > limits.hot_rows)
    hot = settle(counted.select("key", F.ceil(F.col("count") / limits.hot_rows).cast("int").alias("salts")))
    if hot.isEmpty():
        return None
    least = 2
    while not is_small(hot, limits.list_bytes) and not (fewer := hot.where(F.col("salts") > least)).isEmpty():
        hot, least = fewer, 2 * least
    return hot


def same_key_type(left: DataFrame, left_key: str, right: DataFrame, right_key: str) -> None:
    """Refuse to compare text with numbers, which Spark would try to convert."""
    kinds = [left.schema[left_key].dataType, right.schema[right_key].dataType]
    if len({isinstance(k, T.StringType) for k in kinds}) > 1:
        raise CleaningError(f"key types differ: {left_key} is {kinds[0].simpleString()}, {right_key} {kinds[1].simpleString()}")


def equi_join(
    left: DataFrame,
    right: DataFrame,
    left_key: str,
    right_key: str,
    how: str,
    null_safe: bool = True,
    limits: JoinLimits = LIMITS,
) -> DataFrame:
    """Join on one key; ``how`` is inner, left, right or outer. No column name may occur on both sides."""
    on = _match(left_key, right_key, null_safe)
    if is_small(right, limits.broadcast_bytes):
        core = left.join(F.broadcast(right), on, "left" if how in ("left", "outer") else "inner")
        if how in ("inner", "left"):
            return core
        # Keys that were met are keys of the right side, so there are no more of them than it has rows.
        keys = right.select(F.col(f"`{right_key}`").alias("__key"))
        met = left.join(F.broadcast(keys), _match(left_key, "__key", null_safe), "left_semi")
        met = met.select(F.col(f"`{left_key}`").alias("__key")).distinct()
        alone = right.join(F.broadcast(met), _match(right_key, "__key", null_safe), "left_anti")
        return core.unionByName(alone, allowMissingColumns=True)

    hot_left, hot_right = hot_keys(left, left_key, limits), hot_keys(right, right_key, limits)
    if hot_left is None and hot_right is None:
        return left.join(right, on, how)
    # A row that is repeated to meet salted rows finds no partner in some of its copies, so only the side
    # that is never repeated may keep its unmatched rows in the same join.
    if how == "inner" or (how == "left" and hot_right is None) or (how == "right" and hot_left is None):
        return _salted(left, right, left_key, right_key, on, how, hot_left, hot_right)
    core = _salted(left, right, left_key, right_key, on, "inner", hot_left, hot_right)
    if how in ("left", "outer"):
        core = _append_unmatched(core, left, left_key, right, right_key, null_safe, limits)
    if how in ("right", "outer"):
        core = _append_unmatched(core, right, right_key, left, left_key, null_safe, limits)
    return core


def lookup(
    df: DataFrame,
    keys: DataFrame,
    df_key: str,
    key: str,
    how: str,
    null_safe: bool = False,
    limits: JoinLimits = LIMITS,
) -> DataFrame:
    """Semi, anti or left join of a table to the different values of the one column of ``keys``.

    The size is taken before the values are made distinct: an upper bound that needs no shuffle. Many keys are compared
    with the different keys of the table, without its rows; then only rows that may lack theirs are looked at.
    """
    on = _match(df_key, key, null_safe)
    small = is_small(keys, limits.broadcast_bytes)
    if small and how != "left":
        return df.join(F.broadcast(keys), on, how)  # a repeated key makes no difference here
    keys = keys.distinct()
    if small:
        return df.join(F.broadcast(keys), on, how)
    if df.isStreaming:
        return df.join(keys, on, how)
    return _by_absent_keys(settled(df), keys, df_key, key, how, null_safe, limits)


def _by_absent_keys(
    df: DataFrame, keys: DataFrame, df_key: str, key: str, how: str, null_safe: bool, limits: JoinLimits
) -> DataFrame:
    """The same by way of the keys of ``df`` that ``keys`` lacks.

    Few absent keys are broadcast. Otherwise they make a packed filter: rows that are not in it have their key for
    certain and stay where they are, and only the others are shuffled, to meet the absent keys themselves.
    """
    value = F.col(f"`{df_key}`")
    own = df.select(value.alias("__own")).distinct()
    own = own if null_safe else own.where("__own IS NOT NULL")
    absent = settle(own.join(keys, _match("__own", key, null_safe), "left_anti").withColumnRenamed("__own", "__absent"))
    lacks = _match(df_key, "__absent", null_safe)
    known = df if null_safe else df.where(value.isNotNull())
    keyless = [] if null_safe else [df.where(value.isNull())]
    if is_small(absent, limits.broadcast_bytes):
        certain, alone = known.join(F.broadcast(absent), lacks, "left_anti"), known.join(F.broadcast(absent), lacks, "left_semi")
    else:
        filter_ = packed_filter(absent.select(hash_of([F.col("__absent")]).alias("__h")))
        mark = marked(known, [value], filter_, "__maybe")
        possible = mark.where("__maybe")
        hot = hot_keys(possible, df_key, limits)
        # The optimizer moves semi and anti joins to where no row has been filtered yet, but no inner join (absent keys are
        # distinct, so it gives the same rows), and no anti join whose condition needs the mark.
        lacks = lacks & F.col("__maybe")
        meet = lambda kind: (
            possible.join(absent, lacks, kind) if hot is None else _salted(possible, absent, df_key, "__absent", lacks, kind, hot, None)
        )
        certain = mark.where("NOT __maybe").unionByName(meet("left_anti")).drop("__maybe")
        alone = meet("inner").drop("__maybe", "__absent")
    if how == "left_semi":
        return certain
    for more in keyless:
        alone = alone.unionByName(more)
    if how == "left_anti":
        return alone
    kind = keys.schema[key].dataType
    return certain.withColumn(key, value.cast(kind)).unionByName(alone.withColumn(key, F.lit(None).cast(kind)))


def _match(left_key: str, right_key: str, null_safe: bool) -> Column:
    one, two = F.col(f"`{left_key}`"), F.col(f"`{right_key}`")
    return one.eqNullSafe(two) if null_safe else one == two


def _append_unmatched(
    core: DataFrame, side: DataFrame, key: str, other: DataFrame, other_key: str, null_safe: bool, limits: JoinLimits
) -> DataFrame:
    """Add the rows of ``side`` whose key the other side lacks."""
    keys = other.select(F.col(f"`{other_key}`").alias("__key"))
    alone = lookup(side, keys, key, "__key", "left_anti", null_safe, limits)
    return core.unionByName(alone, allowMissingColumns=True)


def _salted(
    left: DataFrame, right: DataFrame, left_key: str, right_key: str, on: Column, how: str,
    hot_left: DataFrame | None, hot_right: DataFrame | None,
) -> DataFrame:
    """Join with the rows of hot keys spread out: each pair of rows still meets exactly once."""
    one, two = _salt(left), _salt(right)
    if hot_left is not None:
        left = _with_salts(left, left_key, hot_left).withColumn("__la", F.pmod(one, F.col("__salts"))).drop("__salts")
        right = _repeated(_with_salts(right, right_key, hot_left), "__ra")
        on = on & (F.col("__la") == F.col("__ra"))
    if hot_right is not None:
        right = _with_salts(right, right_key, hot_right).withColumn("__rb", F.pmod(two, F.col("__salts"))).drop("__salts")
        left = _repeated(_with_salts(left, left_key, hot_right), "__lb")
        on = on & (F.col("__lb") == F.col("__rb"))
    return left.join(right, on, how).drop("__la", "__ra", "__lb", "__rb")


def _with_salts(df: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """The rows with the number of tasks for their key; the list of hot keys was checked to be small."""
    listed = hot.select(F.col("key").alias("__hot"), F.col("salts").alias("__salts"))
    met = df.join(F.broadcast(listed), F.col(f"`{key}`").eqNullSafe(F.col("__hot")), "left").drop("__hot")
    return met.withColumn("__salts", F.coalesce("__salts", F.lit(1)))


def _repeated(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn(name, F.explode(F.sequence(F.lit(0).cast("long"), F.col("__salts") - F.lit(1).cast("long")))).drop("__salts")


def _salt(df: DataFrame) -> Column:
    """A number that a row gets again if its task is repeated, and that copies of a row do not share."""
    cells = [F.col(f"`{f.name}`") for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
    return F.xxhash64(*cells) + F.spark_partition_id()
