"""Text clean-up. Null text stays null in every function."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from burnish.errors import need_choice

# Every character that counts as white space, as a list and as a pattern. (The blank is all that
# ``trim`` knows; a pattern with all characters spelled out is several times slower than the Unicode class.)
WHITE_SPACE = (
    " \t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
WHITE_SPACE_PATTERN = r"(?U)[\s\x1c-\x1f]+"
# A run of letters that have case, or a run of anything else.
_CASED = r"\p{IsLowercase}\p{IsUppercase}\p{Lt}"
_RUNS = rf"([{_CASED}]+|[^{_CASED}]+)"


def strip(text: Column) -> Column:
    """Remove white space of every kind from both ends."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def title(text: Column) -> Column:
    """Capitalise each run of letters, so ``o'brien mary-jane`` gives ``O'Brien Mary-Jane``.

    ``initcap`` only starts a new word after a blank, which is a different function.
    """
    runs = F.regexp_extract_all(text, F.lit(_RUNS), F.lit(1))
    return F.array_join(
        F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substr(r, F.lit(2))))), ""
    )


def squeeze(text: Column) -> Column:
    """Collapse inner white space to single blanks and strip the ends."""
    return strip(F.regexp_replace(text, WHITE_SPACE_PATTERN, " "))


TEXT_OPERATIONS = {
    "strip": strip,
    "lower": F.lower,
    "upper": F.upper,
    "title": title,
    "remove_extra_spaces": squeeze,
}


def standardize(text: Column, operations: list[str]) -> Column:
    """Apply the named operations from left to right."""
    for name in operations:
        need_choice("text operation", name, TEXT_OPERATIONS)
    return reduce(lambda value, name: TEXT_OPERATIONS[name](value), operations, text)
