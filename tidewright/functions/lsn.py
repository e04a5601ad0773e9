"""Log positions as DECIMAL(20,0) with the text form ``HI/LO`` in hexadecimal."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LSN = "decimal(20,0)"
_TEXT = "^[0-9A-Fa-f]{1,8}/[0-9A-Fa-f]{1,8}$"


def parse(text: Column) -> Column:
    """Position of a text such as ``16/B374D848``; null where it isn't one."""
    part = lambda i: F.conv(F.split(text, "/")[i], 16, 10).cast(LSN)
    return F.when(text.rlike(_TEXT), (part(0) * F.lit(4294967296).cast(LSN) + part(1)).cast(LSN))


def render(lsn: Column) -> Column:
    high = F.floor(lsn.cast(LSN) / F.lit(4294967296)).cast("bigint")
    low = (lsn.cast(LSN) - high.cast(LSN) * F.lit(4294967296)).cast("bigint")
    return F.concat(F.conv(high.cast("string"), 10, 16), F.lit("/"), F.lpad(F.conv(low.cast("string"), 10, 16), 8, "0"))


def lag(received: Column, applied: Column) -> Column:
    """Bytes between two positions, never below 0."""
    return F.greatest(received.cast(LSN) - applied.cast(LSN), F.lit(0).cast(LSN)).cast(LSN)


def checkpoint_outcome(stored: Column, offered: Column) -> Column:
    """What offering a position to a stored checkpoint does."""
    return F.when(stored.isNull(), "inserted").when(offered == stored, "unchanged").when(offered > stored, "advanced").otherwise("regressed")
