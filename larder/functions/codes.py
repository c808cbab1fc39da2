"""Product codes: SKUs, EANs, strict conversions, and codes lifted out of a search text."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The forms of codes.
SKU_PREFIX = re.compile(r"[A-Za-z]{3}-[A-Za-z0-9]*")
SKU_INSIDE = re.compile(r"(?<![A-Za-z])[A-Za-z]{3}-[A-Za-z0-9]+")
EAN_INSIDE = re.compile(r"(?<!\d)\d{13}(?!\d)")


def ean13(number: Column) -> Column:
    """859, nine digits of the number, and the check digit over weights 1 and 3."""
    body = F.concat(F.lit("859"), F.lpad(number.cast("string"), 9, "0"))
    total = F.aggregate(F.sequence(F.lit(1), F.lit(12)), F.lit(0), lambda a, i: a + F.substring(body, i, F.lit(1)).cast("int") * F.when(i % 2 == 1, 1).otherwise(3))
    return F.concat(body, ((10 - total % 10) % 10).cast("string"))


def strict_integer(value: object) -> int:
    if isinstance(value, int) and not isinstance(value, bool):
        return value
    if isinstance(value, str) and re.fullmatch(r"-?\d+", value):
        return int(value)
    raise ValueError(f"{value!r} isn't an integer")


def strict_date(text: str) -> dt.date:
    """YYYY-MM-DD that names a real day and is written in full."""
    if not re.fullmatch(r"\d{4}-\d{2}-\d{2}", text):
        raise ValueError(f"{text!r} isn't a date in the form YYYY-MM-DD")
    return dt.date.fromisoformat(text)


def two_decimals(number: Column) -> Column:
    return F.format_string("%.2f", number)
