"""Snapshots in the COPY text format: tab-separated fields, one row a line, backslash escapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import copy_decode, copy_encode


def _typed(text: Column, kind: str) -> Column:
    if kind == "binary":
        return F.unhex(F.when(text.startswith("\\x"), F.substring(text, 3, 1 << 30)))
    if kind == "boolean":
        return F.when(text == "t", True).when(text == "f", False)
    return text.try_cast(kind)


def parse_lines(lines: DataFrame, schema: StructType) -> DataFrame:
    """Typed rows of ``lines`` (value); running it raises for a line with another number of fields or a value of another type."""
    # an escaped tab is the letters \t, so every tab parts two fields
    fields = F.split("value", "\t")
    wrong = F.raise_error(F.concat(F.lit("COPY line of "), F.size(fields).cast("string"), F.lit(f" fields, not {len(schema)}"))).cast("boolean")
    own = lines.filter(F.col("value") != "\\.").filter(F.when(F.size(fields) != len(schema), wrong).otherwise(True))
    out = []
    for i, f in enumerate(schema):
        text = copy_decode(F.get(fields, F.lit(i)))
        value = _typed(text, f.dataType.simpleString())
        bad = F.raise_error(F.concat(F.lit(f"{f.name}: no {f.dataType.simpleString()}: "), text)).cast(f.dataType)
        out.append(F.when(text.isNotNull() & value.isNull(), bad).otherwise(value).alias(f.name))
    return own.select(*out)


def read(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Rows of COPY text files; only the asked columns are decoded."""
    return parse_lines(spark.read.option("lineSep", "\n").text(path), schema)


def lines(rows: DataFrame) -> DataFrame:
    """``rows`` as COPY lines (value)."""

    def field(name: str, kind: str) -> Column:
        c = F.col(name)
        if kind == "binary":
            return F.concat(F.lit("\\x"), F.lower(F.hex(c)))
        return F.when(c, "t").otherwise("f") if kind == "boolean" else c.cast("string")

    return rows.select(F.concat_ws("\t", *(copy_encode(F.when(F.col(f.name).isNotNull(), field(f.name, f.dataType.simpleString()))) for f in rows.schema)).alias("value"))
