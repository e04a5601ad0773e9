"""Canonical digests, comparison and row differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _u64(n: Column) -> Column:
    return F.lpad(F.hex(n.cast("bigint")), 16, "0")


def _cell(tag: int, text: Column) -> Column:
    raw = text.cast("binary")
    return F.concat(F.lit(f"{tag:02X}"), _u64(F.octet_length(raw)), F.hex(raw))


def row_hex(keys: list[Column], values: list[Column]) -> Column:
    """Canonical bytes of a row, in hexadecimal: counts, tags, lengths and texts."""
    parts = [_u64(F.lit(len(keys))), *(_cell(1, k) for k in keys), _u64(F.lit(len(values)))]
    return F.concat(*parts, *(F.coalesce(_cell(2, v), F.lit("00")) for v in values))


def chunk_digest(df: DataFrame, chunk: Column, order: Column, keys: list[Column], values: list[Column]) -> DataFrame:
    """(chunk, n_rows, digest): SHA-256 over a chunk's rows in key order; a chunk is bounded by its key range."""
    rows = df.select(chunk.alias("chunk"), order.alias("k"), row_hex(keys, values).alias("bytes"))
    grouped = rows.groupBy("chunk").agg(F.count("*").alias("n_rows"), F.array_sort(F.collect_list(F.struct("k", "bytes"))).alias("r"))
    text = F.array_join(F.transform("r", lambda x: x["bytes"]), "")
    return grouped.select("chunk", "n_rows", F.sha2(F.unhex(text), 256).alias("digest"))


def compare(left: DataFrame, right: DataFrame) -> DataFrame:
    """(chunk, status) over the chunks of both sides."""
    a = left.select("chunk", F.struct("n_rows", "digest").alias("a"))
    b = right.select("chunk", F.struct("n_rows", "digest").alias("b"))
    status = F.when(F.col("a").eqNullSafe(F.col("b")), "match").otherwise("mismatch")
    return a.join(b, "chunk", "full").select("chunk", status.alias("status"))


def row_diff(source: DataFrame, target: DataFrame, keys: list[str], data: list[str]) -> DataFrame:
    """(keys, kind) of rows that are only in one side or differ."""
    s = source.select(*keys, F.struct(*data).alias("s"))
    t = target.select(*keys, F.struct(*data).alias("t"))
    kind = F.when(F.col("t").isNull(), "source_only").when(F.col("s").isNull(), "target_only").when(~F.col("s").eqNullSafe(F.col("t")), "changed")
    return s.join(t, keys, "full").withColumn("kind", kind).filter("kind is not null").select(*keys, "kind")


def repair(source: DataFrame, target: DataFrame, keys: list[str], data: list[str]) -> DataFrame:
    """The target with exactly the differing rows brought to the source's state."""
    diff = row_diff(source, target, keys, data)
    kept = target.join(diff, keys, "left_anti").select(*keys, *data)
    return kept.unionByName(source.join(diff.filter("kind <> 'target_only'"), keys, "left_semi").select(*keys, *data))
