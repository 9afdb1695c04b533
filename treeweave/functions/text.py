"""Column functions whose meaning differs from Spark's own: JavaScript white space, ASCII-only case, LIKE without an escape."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What JavaScript's trim and \s take for white space, as the inside of a regex class.
WHITE = r"\t\n\x0B\f\r    -     　﻿"


def trim(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{WHITE}]+|[{WHITE}]+$", "")


def fold_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def like_anywhere(text: Column, wanted: Column) -> Column:
    """``text`` LIKE %wanted%: ``%`` and ``_`` in ``wanted`` are wildcards, case counts but for A-Z, nothing escapes."""
    mark = F.lit("\x01")  # LIKE needs some escape character: one that is doubled wherever it occurs
    pattern = F.concat(F.lit("%"), F.replace(fold_ascii(wanted), mark, F.lit("\x01\x01")), F.lit("%"))
    return F.call_function("like", fold_ascii(text), pattern, mark)


def extension(path: Column) -> Column:
    """The last dot and what follows it in the file's name, '' if there is none or the name only begins with it."""
    name = F.regexp_extract(path, r"([^/]*)/*$", 1)
    return F.regexp_extract(name, r"^.+?(\.[^.]*)$", 1)


def slashes(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def iso_millis(ms: Column) -> Column:
    """Epoch milliseconds as ISO-8601 in UTC; the session's time zone doesn't matter."""
    utc = F.to_utc_timestamp(F.timestamp_millis(ms), F.current_timezone())
    return F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
