"""Whitespace, case and token rules shared by all name comparisons.

Spark's trim strips only blanks and Java's \\s misses some Unicode blanks, so
the class of white space is spelled out; it means the same to Java and to RE2.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as white space.
WS = r"[\t\n\x0b\x0c\r\x1c-\x1f \x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def words(s: Column) -> Column:
    """The white-space separated parts of s, in order; null stays null."""
    return F.filter(F.split(s, WS), lambda w: w != "")


def normal(s: Column) -> Column:
    """Lower case, outer blanks removed, inner runs of blanks made one."""
    return F.array_join(words(F.lower(s)), " ")


def tokens(s: Column) -> Column:
    """Distinct lower-case words."""
    return F.array_distinct(words(F.lower(s)))


def stripped(s: Column) -> Column:
    return F.regexp_replace(s, f"^{WS}|{WS}$", "")
