"""Canonical spellings of phone numbers, e-mail addresses, dates and postal codes."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from burnish.errors import CleaningError
from burnish.functions.text import strip

# The layouts in which dates are accepted, tried in this order.
DATE_LAYOUTS = (
    "yyyy-MM-dd",
    "M/d/yyyy",
    "d-M-yyyy",
    "MMM d, yyyy",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss",
)

# Separators under which the order of day and month is voted on, and both orders.
SEPARATORS = ("/", "-")
ORDERS = (("M", "d", "yyyy"), ("d", "M", "yyyy"))

# Strftime directives and the date pattern letters that mean the same.
STRFTIME_LETTERS = {
    "Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "b": "MMM", "B": "MMMM", "a": "EEE", "A": "EEEE",
    "H": "HH", "I": "hh", "p": "a", "M": "mm", "S": "ss", "f": "SSSSSS", "j": "DDD",
}

# The parts of a layout: quoted text, runs of letters, and single other characters.
_PARTS = re.compile(r"'[^']*'|[A-Za-z]+|[^'A-Za-z]")


def phone(text: Column) -> Column:
    """``(XXX) XXX-XXXX`` for ten digits, or eleven that start with 1; other values are left alone."""
    digits = F.regexp_replace(text, r"\P{Nd}+", "")
    local = F.when(F.length(digits) == 10, digits).when(
        (F.length(digits) == 11) & digits.startswith("1"), F.substring(digits, 2, 10)
    )
    spelled = F.concat(
        F.lit("("), F.substring(local, 1, 3), F.lit(") "), F.substring(local, 4, 3), F.lit("-"), F.substring(local, 7, 4)
    )
    return F.coalesce(spelled, text)


def email(text: Column) -> Column:
    """Lower case, without surrounding white space."""
    return strip(F.lower(text))


def zip_code(text: Column) -> Column:
    """The first five digits in a row; null where there are none."""
    return F.nullif(F.regexp_extract(text, r"(\p{Nd}{5})", 1), F.lit(""))


def parse_date(text: Column, layouts: Sequence[str] = DATE_LAYOUTS) -> Column:
    """Read a date or time in the first layout that fits the value; null if none does.

    It is read as if written in UTC and taken as it stands, so gaps of the session's time zone do not shift it.
    """
    instant = F.coalesce(*[_instant(strip(text), layout) for layout in layouts])
    seconds = (F.unix_micros(instant) / F.lit(1_000_000).cast("decimal(18,0)")).cast("decimal(18,6)")
    return F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=seconds)


def _instant(bare: Column, layout: str) -> Column:
    """A time in UTC in one layout. Only text of its shape is tried, as every failure costs Spark an exception."""
    read = F.try_to_timestamp(F.concat(bare, F.lit(" Z")), F.lit(f"{layout} X"))
    shape = _shape(layout)
    return F.when(bare.rlike(shape), read) if shape else read


def _shape(layout: str) -> str | None:
    """A pattern that all text in a layout matches, in linear time; None for layouts with uncommon parts."""
    if any(c in "[]{}#0123456789" for c in layout) or "''" in layout:
        return None
    shape = ""
    for part in _PARTS.findall(layout):
        if part.startswith("'"):
            shape += re.escape(part[1:-1])
        elif not part.isalpha():
            shape += re.escape(part)
        elif set(part) <= set("yMdHhmsS") and "MMM" not in part:
            shape += r"[+-]?[0-9]+" if len(set(part)) == 1 else "[0-9+-]+"
        elif set(part) <= set("MEa"):
            shape += r"\p{L}+\.?"
        else:
            return None
    return f"(?iu)^{shape}$"


def is_date(text: Column, layouts: Sequence[str] = DATE_LAYOUTS) -> Column:
    """Whether ``parse_date`` reads a text."""
    return F.coalesce(*[_instant(strip(text), layout) for layout in layouts]).isNotNull()


def date_votes(text: Column) -> Column:
    """An aggregate: (day, month) votes under each separator, from dates that can be read in one order only.

    ``13/4/2021`` can only have its day first, ``4-13-2021`` only its month; ``3/4/2021`` says nothing.
    """
    votes = []
    for separator in SEPARATORS:
        shape = rf"^([0-9]{{1,2}}){separator}([0-9]{{1,2}}){separator}[0-9]{{4}}$"
        one, two = (F.regexp_extract(strip(text), shape, i).try_cast("int") for i in (1, 2))
        day_first = F.count_if(one.between(13, 31) & two.between(1, 12))
        votes.append(F.struct(day_first.alias("day"), F.count_if(two.between(13, 31) & one.between(1, 12)).alias("month")))
    return F.struct(*[v.alias(f"v{i}") for i, v in enumerate(votes)])


def voted_layouts(votes: Sequence[tuple[int, int]], layouts: Sequence[str] = DATE_LAYOUTS) -> list[str]:
    """The layouts with both orders of day and month under each separator, that of more votes first.

    Without a majority the order stays as ``layouts`` has it, or else ``ORDERS`` has it. The other order follows, for
    the values that only it can read.
    """
    tried = list(layouts)
    for separator, (day, month) in zip(SEPARATORS, votes):
        both = [separator.join(order) for order in ORDERS]
        held = [x for x in tried if x in both]
        ordered = held + [x for x in both if x not in held]
        if day != month:
            ordered = sorted(both, key=lambda x: x.startswith("d") != (day > month))
        place = tried.index(held[0]) if held else len(tried)
        tried[place:] = ordered + [x for x in tried[place:] if x not in both]
    return tried


def date_pattern(strftime: str) -> str:
    """Translate a strftime format to the pattern letters of ``date_format``."""
    out, plain, chars = [], "", iter(strftime)

    def flush() -> None:
        nonlocal plain
        if plain:
            out.append("'" + plain.replace("'", "''") + "'" if any(c.isalpha() or c in "'[]{}#" for c in plain) else plain)
            plain = ""

    for char in chars:
        if char != "%":
            plain += char
            continue
        directive = next(chars, "")
        if directive == "%":
            plain += "%"
        elif directive in STRFTIME_LETTERS:
            flush()
            out.append(STRFTIME_LETTERS[directive])
        else:
            raise CleaningError(f"unsupported date directive %{directive}")
    flush()
    return "".join(out)
