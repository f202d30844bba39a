"""Cleaning of text cells."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

# Fixed value: what counts as a number. Java alone would also take "1d" or hex.
NUMBER = r"^[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:inf(inity)?))$"


# Fixed value: every character that counts as white space.
WHITE_SPACE = (
    "\t\n\v\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip(value: Column) -> Column:
    """Remove white space of any kind from both ends (``trim`` alone knows only blanks)."""
    return F.btrim(value, F.lit(WHITE_SPACE))


def normalize_type(value: Column) -> Column:
    """Event type without surrounding white space, in lower case."""
    return F.lower(strip(value))


def to_price(value: Column, dtype: T.DataType) -> Column:
    """``value`` as a double; null for NaN and for text that is no number."""
    if isinstance(dtype, T.StringType):
        text = strip(value)
        return F.when(text.rlike(NUMBER), text.try_cast("double"))
    number = value.cast("double")
    return F.when(~F.isnan(number), number)
