"""Making clean tables dirty in known ways, to test cleaning with.

Which rows are hit depends only on their key and the seed, so any partitioning gives the same table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from burnish.errors import CleaningError, need_choice, need_column
from burnish.functions.draws import draw, pick, whole
from burnish.operators.rows import union_all

SEED = 42

# Country spellings, postal suffixes and date layouts found in dirty contact tables.
COUNTRY_SPELLINGS = ("US", "us", "Us", "USA", "CA", "ca", "Ca", "UK", "uk")
ZIP_SUFFIXES = ("", "", "", "", "-1234", "-5678")
DATE_SPELLINGS = ("yyyy-MM-dd", "MM/dd/yyyy", "dd-MM-yyyy", "MMM dd, yyyy")
# What a digit group of a phone number is wrapped in, per layout.
PHONE_SPELLINGS = ("({0}) {1}-{2}", "{0}-{1}-{2}", "{0}.{1}.{2}", "{0}{1}{2}", "+1 ({0}) {1}-{2}")

FIRST_NAMES = ("Amara", "Bruno", "Chiara", "Dmitri", "Elena", "Farid", "Greta", "Hugo", "Ines", "Jonas", "Kiran", "Leila")
LAST_NAMES = ("Abbott", "Bergman", "Castillo", "Dubois", "Eriksen", "Fischer", "O'Neill", "Haddad", "Ito", "Smith-Jones")
DEPARTMENTS = ("Design", "Logistics", "Legal", "Support", "Research", "Purchasing")
CITIES = ("Lisbon", "Oslo", "Nairobi", "Toronto", "Quito", "Perth")
PRODUCTS = ("Kettle", "Lamp", "Chair", "Blender", "Shelf")
SEGMENTS = ("Retail", "Wholesale", "Online")
ORDER_COUNTRIES = ("PT", "NO", "KE", "PE")


def _hit(df: DataFrame, key: str, share: float, seed: int, purpose: str) -> Column:
    need_column(df, key)
    if not 0 <= share <= 1:
        raise CleaningError(f"share {share} is not between 0 and 1")
    return draw(F.col(f"`{key}`"), seed, purpose) < F.lit(float(share))


def _u(key: str, seed: int, purpose: str) -> Column:
    return draw(F.col(f"`{key}`"), seed, purpose)


def inject_nulls(df: DataFrame, column: str, share: float, key: str, seed: int = SEED) -> DataFrame:
    """Blank a share of a column."""
    need_column(df, column)
    return df.withColumn(column, F.when(~_hit(df, key, share, seed, f"null {column}"), F.col(f"`{column}`")))


def inject_whitespace(df: DataFrame, column: str, share: float, key: str, seed: int = SEED, pad: str = "  ") -> DataFrame:
    """Pad a share of a text column on both sides."""
    need_column(df, column)
    cell = F.col(f"`{column}`")
    padded = F.concat(F.lit(pad), cell, F.lit(pad))
    return df.withColumn(column, F.when(_hit(df, key, share, seed, f"pad {column}"), padded).otherwise(cell))


def inject_case(
    df: DataFrame, column: str, key: str, seed: int = SEED, share: float = 2 / 3, cases: Sequence[str] = ("upper", "lower")
) -> DataFrame:
    """Put a share of a text column into wrong case, evenly over ``cases``."""
    need_column(df, column)
    for case in cases:
        need_choice("case", case, ("upper", "lower"))
    cell = F.col(f"`{column}`")
    which = pick(_u(key, seed, f"which case {column}"), cases)
    wrong = F.when(which == "upper", F.upper(cell)).otherwise(F.lower(cell))
    return df.withColumn(column, F.when(_hit(df, key, share, seed, f"case {column}"), wrong).otherwise(cell))


def inject_spellings(df: DataFrame, column: str, key: str, spellings: Sequence[str], seed: int = SEED) -> DataFrame:
    """Set a column to one of several spellings."""
    return df.withColumn(column, pick(_u(key, seed, f"spelling {column}"), spellings))


def inject_currency(df: DataFrame, column: str, symbol: str = "$") -> DataFrame:
    """Turn a number into text such as ``$45,200.00``."""
    need_column(df, column)
    return df.withColumn(column, F.concat(F.lit(symbol), F.format_number(F.col(f"`{column}`"), 2)))


def inject_int_as_float(df: DataFrame, column: str) -> DataFrame:
    """Store whole numbers as doubles."""
    need_column(df, column)
    return df.withColumn(column, F.col(f"`{column}`").cast("double"))


def inject_duplicates(df: DataFrame, share: float, key: str, seed: int = SEED) -> DataFrame:
    """Append exact copies of a share of the rows."""
    return union_all(df, df.where(_hit(df, key, share, seed, "duplicate")))


def inject_near_duplicates(df: DataFrame, share: float, key: str, offset: int, seed: int = SEED) -> DataFrame:
    """Append copies of a share of the rows under new keys: the old key plus ``offset``."""
    copies = df.where(_hit(df, key, share, seed, "near duplicate"))
    return union_all(df, copies.withColumn(key, F.col(f"`{key}`") + F.lit(offset).cast(df.schema[key].dataType)))


def inject_phone_formats(df: DataFrame, column: str, key: str, seed: int = SEED) -> DataFrame:
    """Write ten-digit numbers in one of five layouts."""
    need_column(df, column)
    digits = F.col(f"`{column}`").cast("string")
    groups = [F.substring(digits, 1, 3), F.substring(digits, 4, 3), F.substring(digits, 7, 4)]
    layout = whole(_u(key, seed, f"layout {column}"), 0, len(PHONE_SPELLINGS) - 1)
    spelled = [F.format_string(s.format("%1$s", "%2$s", "%3$s"), *groups) for s in PHONE_SPELLINGS]
    return df.withColumn(column, F.when(digits.isNotNull(), _choose(layout, spelled)))


def inject_date_formats(df: DataFrame, column: str, key: str, seed: int = SEED) -> DataFrame:
    """Write dates as text in one of four layouts."""
    need_column(df, column)
    layout = whole(_u(key, seed, f"layout {column}"), 0, len(DATE_SPELLINGS) - 1)
    spelled = [F.date_format(F.col(f"`{column}`"), s) for s in DATE_SPELLINGS]
    return df.withColumn(column, _choose(layout, spelled))


def _choose(which: Column, options: Sequence[Column]) -> Column:
    chosen = F.when(which == 0, options[0])
    for i, option in enumerate(options[1:], 1):
        chosen = chosen.when(which == i, option)
    return chosen


def inject_zip_suffix(df: DataFrame, column: str, key: str, seed: int = SEED) -> DataFrame:
    """Append a +4 suffix to a third of the postal codes."""
    need_column(df, column)
    suffix = pick(_u(key, seed, f"suffix {column}"), ZIP_SUFFIXES)
    return df.withColumn(column, F.concat(F.col(f"`{column}`").cast("string"), suffix))


def inject_outliers(
    df: DataFrame, column: str, share: float, low: float, high: float, key: str, seed: int = SEED
) -> DataFrame:
    """Multiply a share of the numbers by a factor between low and high; the type stays as it is."""
    need_column(df, column)
    cell = F.col(f"`{column}`")
    factor = F.lit(float(low)) + _u(key, seed, f"factor {column}") * F.lit(float(high - low))
    blown = (cell * factor).cast(df.schema[column].dataType)
    return df.withColumn(column, F.when(_hit(df, key, share, seed, f"outlier {column}"), blown).otherwise(cell))


def inject_fk_violations(
    df: DataFrame, column: str, share: float, first_absent: int, key: str, seed: int = SEED, spread: int = 49
) -> DataFrame:
    """Point a share of the references at keys from ``first_absent`` on, which no parent has."""
    need_column(df, column)
    absent = whole(_u(key, seed, f"absent {column}"), first_absent, first_absent + spread - 1)
    hit = _hit(df, key, share, seed, f"orphan {column}")
    return df.withColumn(column, F.when(hit, absent.cast(df.schema[column].dataType)).otherwise(F.col(f"`{column}`")))


def shuffle_rows(df: DataFrame, key: str, seed: int = SEED) -> DataFrame:
    """Put all rows into a random order that depends on key and seed only; rows that share a key stay together.

    The last sort keys only matter for such rows: they let a key with very many rows be sorted by several tasks.
    """
    need_column(df, key)
    cells = [F.col(f"`{f.name}`") for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
    return df.orderBy(_u(key, seed, "shuffle"), F.col(f"`{key}`"), F.xxhash64(*cells), F.spark_partition_id())


def gen_people(keys: DataFrame, key: str, seed: int = SEED, dirty: bool = True) -> DataFrame:
    """A table of people, one per key, with gaps, currency text, padding, wrong case and copies."""
    u = lambda purpose: _u(key, seed, purpose)
    first, last = pick(u("first"), FIRST_NAMES), pick(u("last"), LAST_NAMES)
    mailbox = F.lower(F.concat(first, F.lit("."), F.replace(last, F.lit("'")), whole(u("mailbox"), 1, 99).cast("string")))
    df = keys.select(
        F.col(f"`{key}`").cast("bigint").alias("id"),
        F.concat_ws(" ", first, last).alias("name"),
        whole(u("age"), 22, 64).alias("age"),
        pick(u("department"), DEPARTMENTS).alias("department"),
        pick(u("city"), CITIES).alias("city"),
        whole(u("salary"), 35_000, 119_999).alias("salary"),
        F.concat(mailbox, F.lit("@example.com")).alias("email"),
    )
    if not dirty:
        return df
    df = inject_currency(inject_int_as_float(df, "age"), "salary")
    for column, share in (("age", 0.15), ("email", 0.12), ("salary", 0.10)):
        df = inject_nulls(df, column, share, "id", seed)
    df = inject_case(inject_whitespace(df, "department", 0.12, "id", seed), "name", "id", seed)
    return inject_duplicates(df, 0.08, "id", seed)


def gen_contacts(keys: DataFrame, key: str, seed: int = SEED, dirty: bool = True) -> DataFrame:
    """A table of contacts, one per key, with mixed phone, date, postal code, e-mail and country spellings."""
    u = lambda purpose: _u(key, seed, purpose)
    first, last = pick(u("first"), FIRST_NAMES), pick(u("last"), LAST_NAMES)
    digits = [whole(u("area"), 200, 999), whole(u("prefix"), 200, 999), whole(u("line"), 1000, 9999)]
    mailbox = F.lower(F.concat(first, F.lit("."), F.replace(last, F.lit("'")), whole(u("mailbox"), 1, 99).cast("string")))
    born = F.make_date(
        whole(u("year"), 1950, 2003).cast("int"), whole(u("month"), 1, 12).cast("int"), whole(u("day"), 1, 28).cast("int")
    )
    df = keys.select(
        F.col(f"`{key}`").cast("bigint").alias("contact_id"),
        first.alias("first_name"),
        last.alias("last_name"),
        F.concat(*[d.cast("string") for d in digits]).alias("phone"),
        F.concat(mailbox, F.lit("@example.com")).alias("email"),
        born.alias("birth_date"),
        whole(u("zip"), 10_000, 99_999).cast("string").alias("zip_code"),
        pick(u("country"), ("US", "CA", "UK")).alias("country"),
    )
    if not dirty:
        return df
    df = inject_phone_formats(df, "phone", "contact_id", seed)
    df = inject_date_formats(df, "birth_date", "contact_id", seed)
    df = inject_zip_suffix(df, "zip_code", "contact_id", seed)
    df = inject_case(df, "email", "contact_id", seed, share=0.10, cases=("upper",))
    df = inject_whitespace(df, "email", 0.10, "contact_id", seed)
    return inject_spellings(df, "country", "contact_id", COUNTRY_SPELLINGS, seed)


def gen_customers(keys: DataFrame, key: str, seed: int = SEED) -> DataFrame:
    """A clean table of customers, one per key."""
    u = lambda purpose: _u(key, seed, purpose)
    return keys.select(
        F.col(f"`{key}`").cast("bigint").alias("customer_id"),
        F.concat_ws(" ", pick(u("first"), FIRST_NAMES), pick(u("last"), LAST_NAMES)).alias("name"),
        pick(u("segment"), SEGMENTS).alias("segment"),
        pick(u("country"), ORDER_COUNTRIES).alias("country"),
    )


def gen_orders(keys: DataFrame, key: str, customers: int, seed: int = SEED, dirty: bool = True) -> DataFrame:
    """A table of orders, one per key, for customers 1 to ``customers``, with orphans, outliers and near copies."""
    u = lambda purpose: _u(key, seed, purpose)
    df = keys.select(
        F.col(f"`{key}`").cast("bigint").alias("order_id"),
        whole(u("customer"), 1, customers).alias("customer_id"),
        pick(u("product"), PRODUCTS).alias("product"),
        (whole(u("price"), 1_000, 50_000) / F.lit(100.0)).alias("price"),
        whole(u("quantity"), 1, 19).alias("quantity"),
        F.date_format(F.date_add(F.lit("2023-01-01").cast("date"), whole(u("day"), 0, 364).cast("int")), "yyyy-MM-dd").alias(
            "order_date"
        ),
    )
    if not dirty:
        return df
    df = inject_outliers(df, "price", 0.05, 10, 50, "order_id", seed)
    df = df.withColumn("price", F.round("price", 2))
    df = inject_outliers(df, "quantity", 0.05, 20, 50, "order_id", seed)
    df = inject_fk_violations(df, "customer_id", 0.10, customers + 1, "order_id", seed)
    return inject_near_duplicates(df, 0.08, "order_id", 10**12, seed)
