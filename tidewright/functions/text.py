"""COPY text codec, identifiers and names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the COPY text format: byte and escape.
ESCAPES = [("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r"), ("\b", "\\b"), ("\f", "\\f"), ("\v", "\\v"), ("\0", "\\000")]
MAX_IDENTIFIER = 63


def copy_encode(value: Column) -> Column:
    """One COPY text field; null becomes ``\\N``."""
    out = reduce(lambda c, e: F.replace(c, F.lit(e[0]), F.lit(e[1])), ESCAPES, value)
    return F.coalesce(out, F.lit("\\N"))


def copy_decode(field: Column) -> Column:
    """The value of one COPY text field: escapes are read left to right, piece by piece."""
    pieces = F.regexp_extract_all(field, F.lit(r"(?s)(\\000|\\.|[^\\]+)"), 1)
    known = {escape: byte for byte, escape in ESCAPES}
    plain = lambda p: F.coalesce(*[F.when(p == F.lit(k), F.lit(v)) for k, v in known.items()], F.when(p.startswith("\\"), F.substring(p, 2, 1)), p)
    return F.when(field == "\\N", F.lit(None).cast("string")).otherwise(F.array_join(F.transform(pieces, plain), ""))


def shorten(name: Column) -> Column:
    """Identifier of at most 63 bytes: longer ones end in ``_`` and 24 digits of their SHA-256 (ASCII names)."""
    cut = F.concat(F.substring(name, 1, MAX_IDENTIFIER - 25), F.lit("_"), F.substring(F.sha2(name.cast("binary"), 256), 1, 24))
    return F.when(F.octet_length(name) <= MAX_IDENTIFIER, name).otherwise(cut)


def target_name(prefix: Column, database: Column, schema: Column) -> Column:
    return shorten(F.concat_ws("__", prefix, database, schema))


def valid_prefix(prefix: Column) -> Column:
    return prefix.rlike("^[a-z][a-z0-9_]{0,23}$")


def valid_identifier(name: Column) -> Column:
    return F.coalesce((F.octet_length(name) > 0) & (F.octet_length(name) <= MAX_IDENTIFIER) & ~F.contains(name, F.lit("\0")), F.lit(False))


def quote(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
