"""White space at the ends of texts and between their lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as whitespace at the ends of a text.
WHITESPACE = "".join(chr(c) for c in (
    *range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))


def strip(text: Column) -> Column:
    return F.trim(text, F.lit(WHITESPACE))
