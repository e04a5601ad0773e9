"""Merkle fixity audit of page archives, in DataFrame operations.

Pages become WARC response records.  A record's slot is its page id; ``FANOUT`` neighbouring slots
form a range, ``FANOUT`` ranges the next, up to one root.  A record's leaf is the SHA-256 of its
bytes, and a range's hash covers its children's slots, lengths and hashes in order, so equal roots
mean equal replicas.  An audit compares roots and then, level by level, only the children of ranges
that differ; at the leaves it names each record as changed, missing or extra, with its place in the
primary archive file (``ARCHIVE`` slots each).

Every step is an aggregation of at most ``FANOUT`` children or an equi-join.  Nulls: null url or
html is written as empty; a null page id gets a slot of its content's hash, beyond all others.  Rows
that repeat a page id share a slot as a sorted list; any difference between the lists is ``changed``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import materialize

FANOUT_BITS = 4
ARCHIVE_BITS = 8
NULL_SLOT = 1 << 50


def record(page_id: Column, url: Column, html: Column) -> Column:
    """The bytes of one WARC response record."""
    body = F.coalesce(html, F.lit(""))
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: "), F.coalesce(page_id.cast("string"), F.lit("")),
        F.lit("\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(head, body, F.lit("\r\n\r\n"))


def leaves(pages: DataFrame) -> DataFrame:
    """(slot, length, hash) of every slot that has records."""
    raw = record(F.col("page_id"), F.col("url"), F.col("html"))
    slot = F.coalesce(F.col("page_id").cast("long"), F.lit(NULL_SLOT) + F.pmod(F.xxhash64("url", "html"), F.lit(1 << 40)))
    each = pages.select(slot.alias("slot"), F.octet_length(raw).cast("long").alias("length"), F.sha2(raw.cast("binary"), 256).alias("hash"))
    counted = each.groupBy("slot", "length", "hash").count()
    item = F.concat_ws(":", "length", "hash", "count")
    one = counted.groupBy("slot").agg(F.sum(F.col("length") * F.col("count")).alias("length"), F.min("hash").alias("hash"), F.count("*").alias("kinds"), F.sum("count").alias("copies"), F.sum(F.xxhash64(item).cast("decimal(38,0)")).alias("mark"))
    # one record keeps its own hash; a slot with several is bound by an order-free sum of their hashes
    return one.select("slot", "length", F.when(F.col("copies") == 1, F.col("hash")).otherwise(F.sha2(F.concat_ws(":", "hash", "kinds", "copies", "mark"), 256)).alias("hash"))


def tree(level: DataFrame, height: int) -> list[DataFrame]:
    """Levels from leaves to the root, each (slot, length, hash)."""
    levels = [level]
    for _ in range(height):
        child = F.struct("slot", "length", "hash")
        parent = levels[-1].groupBy(F.shiftright("slot", FANOUT_BITS).alias("up")).agg(F.sum("length").alias("length"), F.array_sort(F.collect_list(child)).alias("children"))
        text = F.array_join(F.transform("children", lambda c: F.concat_ws(":", c["slot"].cast("string"), c["length"].cast("string"), c["hash"])), ";")
        levels.append(parent.select(F.col("up").alias("slot"), "length", F.sha2(text, 256).alias("hash")))
    return levels


def _differing(a: DataFrame, b: DataFrame) -> DataFrame:
    left = a.select("slot", F.col("hash").alias("ha"))
    right = b.select("slot", F.col("hash").alias("hb"))
    return left.join(right, "slot", "full").filter(~F.col("ha").eqNullSafe(F.col("hb")))


def audit(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """(page_id, archive, record_offset, record_length, status) of every record that differs."""
    first = materialize(leaves(primary), "leaves")
    second = materialize(leaves(replica), "leaves")
    top = first.select("slot").union(second.select("slot")).agg(F.max("slot"), F.min("slot")).first()
    span = max(abs(int(x)) for x in top if x is not None) if top[0] is not None else 0
    height = max(1, -(-span.bit_length() // FANOUT_BITS))
    ours, theirs = ([materialize(x, "range") if 0 < k < height else x for k, x in enumerate(tree(t, height))] for t in (first, second))
    bad = _differing(ours[-1], theirs[-1]).select("slot")
    for k in range(height - 1, -1, -1):
        under = F.shiftright("slot", FANOUT_BITS)
        pick = lambda x, b=bad: x.join(b.select(F.col("slot").alias("up")), under == F.col("up"), "left_semi")
        bad = _differing(pick(ours[k]), pick(theirs[k])).select("slot", "ha", "hb")
        if k:
            bad = materialize(bad.select("slot"), "differing")
    archive = F.shiftright("slot", ARCHIVE_BITS)
    touched = bad.select(archive.alias("archive")).distinct()
    # offsets are needed only in archives with a differing record; an archive has at most 256 slots
    place = first.withColumn("archive", archive).join(touched, "archive", "left_semi")
    before = Window.partitionBy("archive").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    place = place.withColumn("record_offset", F.coalesce(F.sum("length").over(before), F.lit(0)))
    status = F.when(F.col("hb").isNull(), "missing").when(F.col("ha").isNull(), "extra").otherwise("changed")
    out = bad.join(place.select("slot", "record_offset", "length"), "slot", "left")
    return out.select(F.when(F.col("slot") < NULL_SLOT, F.col("slot")).alias("page_id"), archive.alias("archive"), "record_offset", F.col("length").alias("record_length"), status.alias("status"))


def damaged(pages: DataFrame) -> DataFrame:
    """A replica with known damage: every 193rd record lost, every 97th with one byte more."""
    kept = pages.filter(F.col("page_id").isNull() | (F.pmod("page_id", F.lit(193)) != 5))
    html = F.when(F.pmod("page_id", F.lit(97)) == 13, F.concat(F.coalesce("html", F.lit("")), F.lit("\u0001"))).otherwise(F.col("html"))
    return kept.withColumn("html", html)


def op7_merkle_audit(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return audit(pages, damaged(pages))


OP7_SQL = """
WITH a AS (
  SELECT page_id, page_id >> 8 AS archive, coalesce(url, '') AS url, coalesce(html, '') AS html,
         'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: ' || page_id || chr(13) || chr(10)
         || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Length: ' || octet_length(encode(coalesce(html, ''))) || chr(13) || chr(10) || chr(13) || chr(10)
         || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS raw
  FROM pages
), b AS (
  SELECT page_id, CASE WHEN page_id % 97 = 13 THEN html || chr(1) ELSE html END AS html FROM a WHERE page_id % 193 <> 5
), p AS (
  SELECT page_id, archive, html, CAST(octet_length(encode(raw)) AS BIGINT) AS record_length,
         CAST(coalesce(sum(octet_length(encode(raw))) OVER (PARTITION BY archive ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS record_offset
  FROM a
)
SELECT p.page_id, p.archive, p.record_offset, p.record_length, CASE WHEN b.page_id IS NULL THEN 'missing' ELSE 'changed' END AS status
FROM p LEFT JOIN b USING (page_id) WHERE b.page_id IS NULL OR sha256(b.html) <> sha256(p.html)
"""
