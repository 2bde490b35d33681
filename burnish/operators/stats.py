"""Column statistics that hold at any size: every pass ends in a bounded number of rows."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from burnish.errors import need_column
from burnish.functions.formats import date_votes
from burnish.functions.numbers import numeric, present
from burnish.operators.keyfilter import hash_of, marked, packed_filter
from burnish.operators.scratch import settle, settled

# Up to this many different values, Spark's exact percentile fits well into one task's memory. Few rows in
# total need no counting by value beforehand.
MAX_DISTINCT = 200_000
FEW_ROWS = 1_000_000
# Rank error of an approximate percentile is n / ACCURACY.
ACCURACY = 10_000
# Hashes of repeated rows are broadcast up to this size, beyond it as a packed filter.
REPEATS_BYTES = 16 * 1024 * 1024
# Rows that guide the search for a rank, and how far around it the search looks, as a share of the rows.
GUIDE_ROWS = 1_000_000
MARGIN = 0.004
IDLE_ROUNDS = 6

MEAN, STD, MIN, MAX, MEDIAN, QUARTILES, MODE, WHOLE, DATE_VOTES = (
    "mean", "std", "min", "max", "median", "quartiles", "mode", "whole", "date_votes",
)
_PROBABILITIES = {MEDIAN: (0.5,), QUARTILES: (0.25, 0.75)}


_PLAIN = {
    MEAN: F.avg,
    STD: F.stddev_samp,
    MIN: F.min,
    MAX: F.max,
    WHOLE: lambda x: F.count_if(x % 1 != 0) == 0,
}
# Statistics of the text of a column instead of its numbers.
_OF_TEXT = {DATE_VOTES: date_votes}


@dataclass(frozen=True)
class Need:
    """A statistic of one column that an operator has to know before it can be applied."""

    column: str
    kind: str


def measure(df: DataFrame, needs: Sequence[Need], exact: bool = True) -> dict[Need, object]:
    """Values for all needs: one fused pass, another one for quantiles, and one per mode."""
    needs = list(dict.fromkeys(needs))
    need_column(df, *[n.column for n in needs])
    plain = [n for n in needs if n.kind in _PLAIN or n.kind in _OF_TEXT]
    asked: dict[str, list[float]] = {}
    for need in needs:
        asked.setdefault(need.column, []).extend(_PROBABILITIES.get(need.kind, ()))
    asked = {c: ps for c, ps in asked.items() if ps}
    found: dict[Need, object] = {}
    if plain or asked:
        extra = [
            _PLAIN[n.kind](numeric(df, n.column))
            if n.kind in _PLAIN
            else _OF_TEXT[n.kind](F.col(f"`{n.column}`").cast("string"))
            for n in plain
        ]
        got, values = quantiles(df, asked, exact, extra)
        found.update(zip(plain, values))
        for need in needs:
            if need.kind in _PROBABILITIES:
                parts = tuple(got[need.column][p] for p in _PROBABILITIES[need.kind])
                found[need] = parts[0] if need.kind == MEDIAN else parts
    found.update({n: mode(df, n.column) for n in needs if n.kind == MODE})
    return found


def mode(df: DataFrame, column: str) -> object:
    """The most frequent value, the smallest one in a tie; None if all are null or NaN.

    Counts are combined before the shuffle and only the winner reaches the driver.
    """
    value = present(df, column)
    top = (
        df.where(value.isNotNull())
        .groupBy(value.alias("value"))
        .count()
        .orderBy(F.desc("count"), F.asc("value"))
        .limit(1)
        .collect()
    )
    return top[0]["value"] if top else None


def quantiles(
    df: DataFrame, asked: Mapping[str, Sequence[float]], exact: bool = True, extra: Sequence[Column] = ()
) -> tuple[dict[str, dict[float, float | None]], list[object]]:
    """Quantiles by linear interpolation between neighbours, per column and probability, and extra aggregates.

    One pass counts the rows and the different values of all columns and takes the extra aggregates. Columns
    with few different values are answered together in a second pass; for the others the neighbours of each
    rank are narrowed down by approximate percentiles until few values are left, so no task ever holds a
    whole column.
    """
    asked = {c: sorted(set(ps)) for c, ps in asked.items()}
    cols = list(asked)
    need_column(df, *cols)
    x = {c: numeric(df, c) for c in cols}
    others = [a.alias(f"e{i}") for i, a in enumerate(extra)]
    if not exact:
        row = df.agg(*[F.percentile_approx(x[c], asked[c], ACCURACY) for c in cols], *others).first()
        near = {c: dict(zip(asked[c], row[i] or [None] * len(asked[c]))) for i, c in enumerate(cols)}
        return near, list(row[len(cols) :])

    counts = [F.count(x[c]) for c in cols] + [F.approx_count_distinct(x[c]) for c in cols]
    head = df.agg(*counts, *others).first()
    rows, distinct = dict(zip(cols, head)), dict(zip(cols, head[len(cols) :]))
    out: dict[str, dict[float, float | None]] = {c: dict.fromkeys(asked[c]) for c in cols if not rows[c]}
    narrow = [c for c in cols if rows[c] and distinct[c] <= MAX_DISTINCT]
    if narrow:
        if max(rows[c] for c in narrow) <= FEW_ROWS:
            row = df.agg(*[F.percentile(x[c], F.array(*map(F.lit, asked[c]))) for c in narrow]).first()
            out.update({c: dict(zip(asked[c], row[i])) for i, c in enumerate(narrow)})
        else:
            out.update(_by_counting(df.select(*[x[c].alias(c) for c in narrow]), {c: asked[c] for c in narrow}))
    wide = [c for c in cols if c not in out]
    if wide:
        out.update(_by_narrowing(df.select(*[x[c].alias(c) for c in wide]), rows, {c: asked[c] for c in wide}))
    return out, list(head[2 * len(cols) :])


def _by_counting(df: DataFrame, asked: Mapping[str, Sequence[float]]) -> dict[str, dict[float, float]]:
    """Quantiles of columns with few different values, from how often each value occurs.

    Values are counted by many tasks, so that the final one per column gets each value once.
    """
    shares = sorted({p for ps in asked.values() for p in ps})
    counted = unpivot(df, "x").where("x IS NOT NULL").groupBy("column_name", "x").agg(F.count("*").alias("n"))
    rows = counted.groupBy("column_name").agg(F.percentile("x", F.array(*map(F.lit, shares)), F.col("n")).alias("q")).collect()
    return {r["column_name"]: {p: v for p, v in zip(shares, r["q"]) if p in asked[r["column_name"]]} for r in rows}


@dataclass
class _Search:
    """The interval of a column's values in which two neighbouring ranks are known to lie."""

    column: str
    position: float
    ranks: tuple[int, int]
    inside: int
    offset: int = 0
    low: float | None = None
    high: float | None = None
    margin: float = MARGIN
    found: tuple[float, float] | None = None
    done: bool = False
    #: rounds that did not make the interval smaller; after some of them it is halved by value
    idle: int = 0
    upper: bool = False

    def holds(self) -> Column:
        x = F.col(f"`{self.column}`")
        return x.isNotNull() if self.low is None else x.between(self.low, self.high)

    def shares(self) -> list[float]:
        """Where the ranks should be among the values inside, with some room on both sides."""
        first, last = ((r - self.offset) / self.inside for r in self.ranks)
        return [max(0.0, first - self.margin), min(1.0, last + 1 / self.inside + self.margin)]

    def ends(self, guide: Sequence[float] | None, least: float, most: float) -> tuple[float, float]:
        """Where to look next: as the sample says, to the very ends where it reaches them, or in one half by value."""
        if self.idle > IDLE_ROUNDS:
            middle = least + (most - least) / 2
            return (math.nextafter(middle, math.inf), most) if self.upper else (least, middle)
        low, high = guide or (least, most)
        shares = self.shares()
        return (least if shares[0] <= 0 else low), (most if shares[1] >= 1 else high)

    def narrow(self, low: float, high: float, below: int, within: int, distinct: int, last: float | None, after: float | None) -> None:
        first, end = self.offset + below, self.offset + below + within
        if self.ranks[0] == end - 1 and self.ranks[1] == end:  # one at the end of it, the other behind
            self.found, self.done = (last, after), True
            return
        if self.ranks[0] < first or self.ranks[1] >= end:
            self.idle, self.upper = self.idle + 1, not self.upper
            self.margin = min(1.0, self.margin * 4)  # missed: look in a wider interval
            return
        if within == self.inside:
            self.idle, self.margin = self.idle + 1, self.margin / 64
        self.done = low == high or distinct <= MAX_DISTINCT
        self.found = (low, low) if low == high else None
        self.offset, self.inside, self.low, self.high = first, within, low, high


def _by_narrowing(
    df: DataFrame, rows: Mapping[str, int], asked: Mapping[str, Sequence[float]]
) -> dict[str, dict[float, float]]:
    """Quantiles of columns with many different values; all of them are searched for in the same passes."""
    searches = []
    for c, shares in asked.items():
        for p in shares:
            place = p * (rows[c] - 1)
            ranks = (math.floor(place), min(math.floor(place) + 1, rows[c] - 1))
            searches.append(_Search(c, place, ranks, rows[c]))
    for turn in count(1):
        active = [s for s in searches if not s.done]
        if not active:
            break
        # A few rows say where to look, others each time; whether the ranks are there is then counted over all rows.
        scope = df.where(reduce(Column.__or__, [s.holds() for s in active])).withColumn("__u", F.rand(turn))
        guides = scope.agg(
            *[
                F.percentile_approx(
                    F.when(s.holds() & (F.col("__u") <= GUIDE_ROWS / s.inside), F.col(f"`{s.column}`")), s.shares(), ACCURACY
                )
                for s in active
            ],
            *[f(F.when(s.holds(), F.col(f"`{s.column}`"))) for s in active for f in (F.min, F.max)],
        ).first()
        edges = guides[len(active) :]
        ends = [s.ends(guides[i], edges[2 * i], edges[2 * i + 1]) for i, s in enumerate(active)]
        counted = []
        for s, (low, high) in zip(active, ends):
            x = F.when(s.holds(), F.col(f"`{s.column}`"))
            bracket = x.between(low, high)
            counted += [F.count_if(x < low), F.count_if(bracket), F.approx_count_distinct(F.when(bracket, x))]
            counted += [F.max(F.when(bracket, x)), F.min(F.when(x > high, x))]
        counts = scope.agg(*counted).first()
        for i, (s, (low, high)) in enumerate(zip(active, ends)):
            s.narrow(low, high, *counts[5 * i : 5 * i + 5])
    _read_off(df, [s for s in searches if not s.found])
    out: dict[str, dict[float, float]] = {c: {} for c in asked}
    for s, p in zip(searches, [p for ps in asked.values() for p in ps]):
        above = s.position - s.ranks[0]
        out[s.column][p] = (1 - above) * s.found[0] + above * s.found[1]
    return out


def _read_off(df: DataFrame, searches: list[_Search]) -> None:
    """Set what is at the ranks, from the few values left in each interval."""
    if not searches:
        return
    cells = [F.when(s.holds(), F.struct(F.lit(i).alias("i"), F.col(f"`{s.column}`").alias("x"))) for i, s in enumerate(searches)]
    counted = df.select(F.inline(F.array_compact(F.array(*cells)))).groupBy("i", "x").agg(F.count("*").alias("n"))
    upto = counted.withColumn("upto", F.sum("n").over(Window.partitionBy("i").orderBy("x")))
    wanted = [
        F.min(F.when((F.col("i") == i) & (F.col("upto") + s.offset > r), F.col("x")))
        for i, s in enumerate(searches)
        for r in s.ranks
    ]
    row = upto.agg(*wanted).first()
    for i, s in enumerate(searches):
        s.found = (row[2 * i], row[2 * i + 1])


def summary(df: DataFrame, column: str) -> dict[str, Column]:
    """Aggregates of one column read as numbers, for use in ``df.agg``."""
    need_column(df, column)
    x = numeric(df, column)
    return {
        "mean": F.avg(x),
        "std": F.stddev_samp(x),
        "min": F.min(x),
        "max": F.max(x),
        "count": F.count(x),
    }


def null_counts(df: DataFrame) -> DataFrame:
    """One row: the number of nulls of each column, NaN among them, and ``total`` over all columns."""
    counts = [F.count_if(present(df, c).isNull()) for c in df.columns]
    total = sum(counts[1:], counts[0]) if counts else F.lit(0)
    return df.agg(*[n.alias(c) for n, c in zip(counts, df.columns)], total.cast("long").alias("total"))


def distinct_counts(df: DataFrame, approx: bool = False) -> DataFrame:
    """Rows (column_name, unique_count): how many different non-null values each column has.

    Each column is read and counted on its own, so no row is multiplied and values keep their type. Settle a
    table first if it is costly to compute. The approximate form reads all columns in one pass.
    """
    if approx:
        row = df.agg(*[F.approx_count_distinct(_known(df, c)).alias(c) for c in df.columns])
        return unpivot(row, "unique_count")
    counts = [
        df.select(_known(df, c).alias("value"))
        .groupBy("value")
        .agg(F.lit(1).alias("one"))
        .agg(F.lit(c).alias("column_name"), F.count("value").alias("unique_count"))
        for c in df.columns
    ]
    return reduce(DataFrame.union, counts)


def _known(df: DataFrame, name: str) -> Column:
    """A column with NaN being no value; maps, which cannot be grouped, as text."""
    value = present(df, name)
    return F.to_json(value) if isinstance(df.schema[name].dataType, T.MapType) else value


def unpivot(df: DataFrame, value: str) -> DataFrame:
    """Rows (column_name, value) for all columns of ``df``, which must share one type."""
    cells = [F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").alias(value)) for c in df.columns]
    return df.select(F.inline(F.array(*cells)))


def duplicate_count(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """One row: ``duplicate_rows``, the rows beyond the first of each group of equal rows, and ``total_rows``.

    Null equals null, and NaN counts as null. Rows are counted by a hash of 16 bytes; what occurs more than once is
    written to the shared folder, and where there is nothing of the kind, that is all. Otherwise the rows are read again:
    those whose hash is not in a packed filter of the repeated ones go no further, and only the others are compared column
    by column. Copies are combined before each shuffle, so a huge group costs no more than a small one.
    """
    cols = list(subset or df.columns)
    need_column(df, *cols)
    table = settled(df.select(*[F.col(f"`{c}`") for c in cols]))
    known = [_known(table, c) for c in cols]
    seen = table.select(*row_hash(known)).groupBy("__h1", "__h2").agg(F.count("*").alias("n"))
    # All hashes that occur once fall together into one row, without hashes, which holds how many they are.
    again = [F.when(F.col("n") > 1, F.col(h)).alias(h) for h in ("__h1", "__h2")]
    told = settle(seen.groupBy(*again).agg(F.sum("n").alias("n")))
    total, repeats = told.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("__h1")).first()
    if not repeats:
        return df.sparkSession.createDataFrame([(0, total)], "duplicate_rows bigint, total_rows bigint")
    hashes = told.where("__h1 IS NOT NULL").select(F.col("__h1").alias("__r1"), F.col("__h2").alias("__r2"))
    rows = table.select(*row_hash(known), *[k.alias(f"c{i}") for i, k in enumerate(known)])
    same = (F.col("__h1") == F.col("__r1")) & (F.col("__h2") == F.col("__r2"))
    if repeats * 2 * 8 <= REPEATS_BYTES:
        hashes = F.broadcast(hashes)
    else:
        filter_ = packed_filter(hashes.select(hash_of([F.col("__r1"), F.col("__r2")]).alias("__h")))
        rows = marked(rows, [F.col("__h1"), F.col("__h2")], filter_, "__maybe").where("__maybe")
    met = rows.join(hashes, same)  # an inner join: the optimizer would put a semi join before the filter
    groups = met.groupBy(*[f"c{i}" for i in range(len(cols))]).agg(F.count("*").alias("n"))
    return groups.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"), F.lit(total).cast("bigint").alias("total_rows"))


def row_hash(cells: Sequence[Column]) -> list[Column]:
    """Two 64-bit hashes of a row, the same for rows that are equal in grouping."""
    return [F.xxhash64(*cells).alias("__h1"), F.xxhash64(F.lit(1), *cells).alias("__h2")]


def fraction(condition: Column, among: Column | None = None, weight: Column | None = None) -> Column:
    """The share of rows for which ``condition`` holds, null counting as no, 0 where there are no rows."""
    weight = F.lit(1) if weight is None else weight
    base = weight if among is None else F.when(among, weight)
    hits = condition if among is None else condition & among
    share = F.sum(F.when(hits, weight)) / F.nullif(F.sum(base), F.lit(0))
    return F.coalesce(share, F.lit(0.0))
