"""Column expressions over tagged text (XML properties, HTML): the text and the attributes of elements, bit patterns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tag_text(text: Column, tag: str) -> Column:
    """The trimmed text of the first element of a name; null without one."""
    pattern = rf"(?s)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>"
    return F.when(text.rlike(pattern), F.trim(F.regexp_extract(text, pattern, 1)))


def tag_attribute(text: Column, tag: str, attribute: str) -> Column:
    """An attribute in double quotes of the first element of a name that has it; null without one."""
    pattern = rf'<{tag}\s(?:[^>]*\s)?{attribute}="([^"]*)"'
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, 1))


def tag_count(text: Column, tag: str) -> Column:
    """How many elements of a name are opened."""
    return F.regexp_count(text, F.lit(rf"<{tag}[\s/>]"))


def double_of_bits(bits: Column) -> Column:
    """The double whose 64 bits are those of an integer; null for infinities and what is no number.

    A double is (1 + m / 2**52) * 2**(e - 1023), with the sign in front; powers of two are exact.
    """
    fraction = bits.bitwiseAND(F.lit((1 << 52) - 1)) / F.lit(float(1 << 52))
    exponent = F.shiftright(bits, 52).bitwiseAND(F.lit(0x7FF))
    size = F.when(exponent == 0, fraction * F.lit(2.0**-1022)).otherwise((fraction + 1) * F.pow(F.lit(2.0), exponent - 1023))
    return F.when(exponent != 0x7FF, F.when(bits < 0, -size).otherwise(size))
