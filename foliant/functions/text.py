"""String functions as column expressions, and the query-side text handling."""

from __future__ import annotations

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

_FULL = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
_HALF = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + " "
_FOLD = str.maketrans(_FULL, _HALF)
CJK = "⺀-⿿々-〇぀-ヿ㄀-ㄯㆠ-ㆿ㐀-䶿一-鿿가-힯豈-﫿"
SEGMENT = regex.compile(rf"[{CJK}]+|(?:(?![{CJK}])[\p{{L}}\p{{N}}])+(?:[-_.]+(?:(?![{CJK}])[\p{{L}}\p{{N}}])+)*")


def fold_width(text: str) -> str:
    """Full-width forms to ASCII, then lower case."""
    return text.translate(_FOLD).lower()


def fold_width_column(c: Column) -> Column:
    return F.lower(F.translate(c, _FULL, _HALF))


def segments(query: str) -> list[str]:
    """Runs of CJK or of letters and digits; ``- _ .`` stay between letters and digits."""
    return SEGMENT.findall(fold_width(query))


def grapheme_length(c: Column) -> Column:
    """Length in user-perceived characters, in the JVM."""
    return F.size(F.regexp_extract_all(c, F.lit(r"(\X)"), F.lit(1)))


#: Below U+0300 only CR before LF joins with what follows.
_JOINING = regex.compile(r"[^\x00-\x0C\x0E-\u02FF]")


def simple(text: str) -> bool:
    """Whether each character is a grapheme for certain."""
    return _JOINING.search(text) is None


def graphemes(text: str) -> list[str]:
    return list(text) if simple(text) else regex.findall(r"\X", text)


def collapse_space(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def occurrences(text: Column, term: str) -> Column:
    """Overlapping occurrences of a literal term."""
    if not term:
        return F.lit(0)
    if not _overlaps_itself(term):
        return ((F.length(text) - F.length(F.replace(text, F.lit(term), F.lit("")))) / F.lit(len(term))).cast("int")
    return F.regexp_count(text, F.lit("(?=" + java_quote(term) + ")"))


def _overlaps_itself(term: str) -> bool:
    return any(term.startswith(term[i:]) for i in range(1, len(term)))


def java_quote(term: str) -> str:
    """A literal for Java's regular expressions."""
    return "\\Q" + term.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def csv_safe(c: Column) -> Column:
    """A leading ``= + - @`` would run as a formula in a spreadsheet; an apostrophe stops it."""
    return F.when(c.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), c)).otherwise(c)


# Names of settings that hold secrets.
SECRET_NAMES = ("key", "secret", "token", "password")


def mask_secrets(c: Column) -> Column:
    """``name=value`` and ``name: value`` of secrets become ``name=***``."""
    names = "|".join(SECRET_NAMES)
    return F.regexp_replace(c, rf'(?i)\b([\w-]*(?:{names})[\w-]*)(\s*[=:]\s*)("[^"]*"|[^\s,;"]+)', "$1$2***")


def mask_profiles(c: Column) -> Column:
    """The user's name in home folders."""
    c = F.regexp_replace(c, r"(?i)([a-z]:\\Users\\)[^\\\s]+", "$1***")
    return F.regexp_replace(c, r"(/(?:home|Users)/)[^/\s]+", "$1***")


def mask_folders(c: Column, folders: list[str]) -> Column:
    """Watched folders, the longest first, so that a folder inside another is named as itself."""
    for i, folder in sorted(enumerate(folders), key=lambda x: -len(x[1])):
        c = F.regexp_replace(c, "(?i)" + java_quote(folder.rstrip("/\\")), f"<folder{i + 1}>")
    return c


def middle_ellipsis(c: Column, most: int) -> Column:
    """Both ends of a text that is longer than ``most``."""
    head = (most - 1 + 1) // 2
    tail = most - 1 - head
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.substring(c, 1, head), F.lit("…"), F.expr("''") if tail <= 0 else F.right(c, F.lit(tail))))


def strip_accents(text: str) -> str:
    import unicodedata

    return "".join(x for x in unicodedata.normalize("NFD", text) if unicodedata.category(x) != "Mn")
