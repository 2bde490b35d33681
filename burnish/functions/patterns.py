"""Regular expressions written in Python's dialect, made fit for Spark's."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

from burnish.errors import CleaningError

# Only a line feed ends a line in Python. Classes and flags that mean more than ASCII there need the Unicode switch;
# other patterns match faster without it.
_LINES, _UNICODE = "(?d)", "(?dU)"
_CLASSES = re.compile(r"\\[wWdDsSbB]|\(\?[a-z]*i")


def _group_name(name: str) -> str:
    """Group names may hold an underscore in Python but not in Java."""
    return "g" + "".join(f"{ord(c):x}" if not (c.isascii() and c.isalnum()) else c for c in name)


def pattern(source: str) -> str:
    """A Python pattern as a Java pattern; one that either refuses is refused here, on the driver."""
    try:
        re.compile(source)
    except re.error as bad:
        raise CleaningError(f"invalid pattern {source!r}: {bad}") from bad
    java = (_UNICODE if _CLASSES.search(source) else _LINES) + _translated(source)
    session = SparkSession.getActiveSession()
    if session is not None:
        try:
            session._jvm.java.util.regex.Pattern.compile(java)
        except Exception as bad:  # whichever way the session reports it
            raise CleaningError(f"pattern {source!r} has no equivalent here") from bad
    return java


def _translated(source: str) -> str:
    """The parts that the two dialects write differently, one token after the other."""
    out, at, within = [], 0, False
    while at < len(source):
        rest = source[at:]
        if rest[0] == "\\":
            token = rest[:2]
            new = r"\z" if token == r"\Z" and not within else token
        elif within:
            token = "&&" if rest.startswith("&&") else rest[0]
            new = {"[": r"\[", "&&": r"\&\&"}.get(token, token)
            within = token != "]"
        elif rest[0] == "[":
            # A bracket that comes first in a class is a member of it.
            token = re.match(r"\[\^?\]?", rest)[0]
            new, within = token.replace("]", r"\]"), True
        elif named := re.match(r"\(\?P<(\w+)>", rest):
            token, new = named[0], f"(?<{_group_name(named[1])}>"
        elif named := re.match(r"\(\?P=(\w+)\)", rest):
            token, new = named[0], rf"\k<{_group_name(named[1])}>"
        elif upto := re.match(r"\{,(\d*)\}", rest):
            token, new = upto[0], f"{{0,{upto[1]}}}"
        else:
            token = new = rest[0]
        out.append(new)
        at += len(token)
    return "".join(out)


def replacement(source: str, searched: str | None = None) -> str:
    """A Python replacement template as a Java one: ``\\1`` and ``\\g<n>`` become ``$1``, ``$`` is plain.

    With the pattern ``searched`` its groups are checked to be there.
    """
    if searched is not None:
        try:
            re.compile(searched).sub(source, "")
        except (re.error, IndexError) as bad:
            raise CleaningError(f"invalid replacement {source!r} for {searched!r}: {bad}") from bad

    def translate(m: re.Match[str]) -> str:
        if m["dollar"]:
            return r"\$"
        group = m["number"] or m["name"]
        if group is None:
            return {"n": "\n", "t": "\t", "r": "\r"}.get(m["escaped"], "\\" + m["escaped"])
        if not group.isdigit():
            return "${" + _group_name(group) + "}" + (m["digit"] or "")
        # A digit that follows a numbered group must not be read as part of its number.
        return "$" + group + ("\\" + m["digit"] if m["digit"] else "")

    return re.sub(
        r"(?P<dollar>\$)|\\(?:(?P<number>\d{1,2})|g<(?P<name>\w+)>(?P<digit>\d?)|(?P<escaped>.))", translate, source
    )
