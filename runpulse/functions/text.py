"""Text helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters the run-log contract counts as white space, the cap on a
# stored error text and its mark. The set is what JavaScript's \s matches: Unicode white
# space, with the byte order mark and without the next-line control.
WHITESPACE = r"[\s\x{FEFF}&&[^\x{85}]]"
UNICODE = "(?U)"
MAX_ERROR_LENGTH = 300
TRUNCATION_MARK = " …(truncated)"


def trim_text(col: Column) -> Column:
    """Strip white space of every kind from both ends (``F.trim`` strips blanks only)."""
    return F.regexp_replace(col, f"{UNICODE}^{WHITESPACE}+|{WHITESPACE}+$", "")


def squeeze(col: Column) -> Column:
    """One line: each run of white space becomes one blank, none at the ends."""
    return F.trim(F.regexp_replace(col, f"{UNICODE}{WHITESPACE}+", " "))


def summarize_error(col: Column, max_len: int = MAX_ERROR_LENGTH) -> Column:
    """A one-line error text of at most ``max_len`` characters, marked when cut; null stays null."""
    line = squeeze(col)
    cut = F.concat(F.substring(line, 1, max_len), F.lit(TRUNCATION_MARK))
    return F.when(F.length(line) > max_len, cut).otherwise(line)


def blank_to_null(col: Column) -> Column:
    return F.nullif(col, F.lit(""))
