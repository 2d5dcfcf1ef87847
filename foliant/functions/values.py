"""Values of table cells: numbers, dates, names and their display, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPACE = r"[\s　]*"
_CURRENCY = r"(?:NT\$|nt\$|Nt\$|nT\$|\$|＄|￥|¥)"
_DIGITS = r"(?:0|[1-9][0-9]*|[1-9][0-9]{0,2}(?:,[0-9]{3})+)(?:\.[0-9]+)?"
_SIGNED = rf"(?:[+-]?{_SPACE}{_CURRENCY}?{_SPACE}|{_CURRENCY}{_SPACE}[+-]?{_SPACE}){_DIGITS}{_SPACE}%?"
NUMBER = rf"^{_SPACE}(?:{_SIGNED}|\({_SPACE}{_CURRENCY}?{_SPACE}{_DIGITS}{_SPACE}%?{_SPACE}\)){_SPACE}$"
DATE = r"^\s*([0-9]{4})([/-])([0-9]{1,2})\2([0-9]{1,2})(?:[ T]([0-9]{1,2}):([0-9]{2})(?::([0-9]{2})(?:\.[0-9]{1,3})?)?)?\s*$"


def parse_number(c: Column) -> Column:
    """The number of a display text, or null.  ``25.6%`` is 25.6, ``(5)`` is -5; leading zeros,
    exponents, ``.5`` and ``1.`` are text."""
    digits = F.regexp_replace(c, r"[^0-9.]", "")
    sign = F.when(c.rlike(r"[-(]"), F.lit(-1.0)).otherwise(F.lit(1.0))
    return F.when(c.rlike(NUMBER), sign * digits.try_cast("double"))


def parse_date(c: Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss`` of a date text with an optional time, or null."""
    plain = F.translate(F.regexp_replace(F.trim(c), r"\.[0-9]+$", ""), "/T", "- ")
    stamp = F.try_to_timestamp(plain, F.lit("yyyy-M-d[ H:mm[:ss]]"))
    return F.when(c.rlike(DATE), F.date_format(stamp, "yyyy-MM-dd HH:mm:ss"))


def is_number(c: Column) -> Column:
    """Whether :func:`parse_number` gives a number."""
    return c.rlike(NUMBER)


def is_blank(c: Column) -> Column:
    return c.isNull() | c.rlike(r"^[\s　]*$")


def sql_names(headers: list[str]) -> list[str]:
    """Safe, distinct column names: other than letters and digits become ``_``."""
    seen: set[str] = set()
    out = []
    for i, header in enumerate(headers, 1):
        text = (header or "").strip()
        name = "".join(ch if ch.isalnum() or ch == "_" else "_" for ch in text) or f"column_{i}"
        if name[0].isdigit():
            name = f"c_{name}"
        base, n = name, 1
        while name.lower() in seen:
            n += 1
            name = f"{base}_{n}"
        seen.add(name.lower())
        out.append(name)
    return out


def format_double(x: float | None) -> str:
    """Up to 15 significant digits; whole numbers without decimals."""
    if x is None:
        return "NULL"
    if x == int(x) and abs(x) < 1e15:
        return str(int(x))
    text = f"{x:.15g}"
    if "e" in text:
        mantissa, exponent = text.split("e")
        return f"{mantissa}E{exponent[0]}{exponent[1:].lstrip('0').zfill(2)}"
    return text


def format_value(x: object) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(int(x))
    if isinstance(x, float):
        return format_double(x)
    if isinstance(x, (bytes, bytearray)):
        return f"x'{bytes(x).hex().upper()}'"
    return str(x)


def column_name(number: int) -> str:
    """A1 letters of a column, from 1."""
    out = ""
    while number > 0:
        number, r = divmod(number - 1, 26)
        out = chr(65 + r) + out
    return out


def column_number(letters: str) -> int:
    n = 0
    for ch in letters.upper():
        n = n * 26 + ord(ch) - 64
    return n


def parse_range(text: str) -> tuple[int, int, int, int] | None:
    """(top, left, bottom, right) of ``A1`` or ``A1:F9``, or None."""
    m = re.fullmatch(r"\$?([A-Za-z]{1,3})\$?([1-9]\d*)(?::\$?([A-Za-z]{1,3})\$?([1-9]\d*))?", text.strip())
    if not m:
        return None
    top, left = int(m[2]), column_number(m[1])
    bottom, right = (int(m[4]), column_number(m[3])) if m[3] else (top, left)
    return min(top, bottom), min(left, right), max(top, bottom), max(left, right)


def range_text(top: int, left: int, bottom: int, right: int) -> str:
    a, b = f"{column_name(left)}{top}", f"{column_name(right)}{bottom}"
    return a if a == b else f"{a}:{b}"
