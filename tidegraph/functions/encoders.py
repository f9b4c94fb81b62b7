"""Property encoders by name, and a place for more."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

ENCODERS: dict[str, Callable[[Column], Column]] = {
    "time": lambda c: F.try_to_timestamp(c, F.lit("yyyy-MM-dd'T'HH:mm:ss")),
    "int64": lambda c: c.try_cast("long"),
    "double": lambda c: c.try_cast("double"),
    "string": lambda c: c.cast("string"),
    "hex": lambda c: F.conv(F.regexp_replace(c, "^0[xX]", ""), 16, 10).try_cast("long"),
}


def register(name: str, encode: Callable[[Column], Column]) -> None:
    ENCODERS[name] = encode


def encode(name: str, column: Column) -> Column:
    """The typed value, null where the text isn't one."""
    return ENCODERS[name](column)
