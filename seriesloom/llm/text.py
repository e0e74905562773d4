"""Text conventions shared by the operators of this package."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else; null counts as empty.

    lower() is right, and much faster, for a text without other letters.
    """
    whole = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(whole) == F.char_length(whole), F.lower(whole)).otherwise(F.translate(whole, UPPER, UPPER.lower()))


def as_bytes(text: Column) -> Column:
    """UTF-8 bytes, for functions that work on bytes; null counts as empty."""
    return F.coalesce(text, F.lit("")).cast("binary")
