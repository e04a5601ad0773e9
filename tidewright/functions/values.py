"""Dates, ids, flags and texts for people."""

from __future__ import annotations

import os
import time
import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: microseconds from 1970-01-01 to 2000-01-01, the epoch of log records.
EPOCH_2000 = 946_684_800_000_000


def record_time(micros: Column) -> Column:
    """Timestamp of microseconds since 2000-01-01 UTC."""
    return F.timestamp_micros(micros.cast("long") + F.lit(EPOCH_2000))


def expired(since: Column, seconds: int, now: Column | None = None) -> Column:
    """Whether ``seconds`` have passed since a time."""
    return since <= (F.current_timestamp() if now is None else now) - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(seconds))


def truncate_options(flags: Column) -> Column:
    """Struct (cascade, restart_identity) of a truncate's option bits."""
    return F.struct((flags.bitwiseAND(1) == 1).alias("cascade"), (flags.bitwiseAND(2) == 2).alias("restart_identity"))


def trimmed(text: Column, limit: int = 1024) -> Column:
    """An error text of at most ``limit`` characters."""
    return F.substring(text, 1, limit)


def readable_bytes(size: Column, units: tuple[str, ...] = ("KiB", "MiB", "GiB", "TiB")) -> Column:
    """1.5 KiB, 3.0 MiB ..., rounded down; whole bytes below 1 KiB.  Larger sizes keep the last of ``units``."""
    size = size.cast("long")
    out = F.concat(size.cast("string"), F.lit(" B"))
    for i, unit in enumerate(units, 1):
        whole, tenth = F.shiftright(size, 10 * i), F.shiftright(size.bitwiseAND((1 << 10 * i) - 1) * 10, 10 * i)
        out = F.when(size >= 1 << 10 * i, F.concat(whole.cast("string"), F.lit("."), tenth.cast("string"), F.lit(" " + unit))).otherwise(out)
    return out


def readable_seconds(seconds: Column) -> Column:
    """42s, 3m 5s, 2h 0m, 1d 4h."""
    s = seconds.cast("long")
    part = lambda n, m=None: (F.floor(s / n) if m is None else F.floor(s / n) % m).cast("string")
    two = lambda a, ua, b, ub: F.concat(a, F.lit(ua + " "), b, F.lit(ub))
    return F.when(s >= 86400, two(part(86400), "d", part(3600, 24), "h")).when(s >= 3600, two(part(3600), "h", part(60, 60), "m")).when(s >= 60, two(part(60), "m", part(1, 60), "s")).otherwise(F.concat(s.cast("string"), F.lit("s")))


def label(name: Column) -> Column:
    """catching_up -> Catching Up."""
    return F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))


def middle_cut(text: Column, limit: int) -> Column:
    """A text of at most ``limit`` characters, its middle replaced by an ellipsis."""
    head = (limit - 1 + 1) // 2
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.left(text, F.lit(head)), F.lit("…"), F.right(text, F.lit(limit - 1 - head))))


def percent_encoded(text: Column) -> Column:
    """UTF-8 bytes as %XX, but for ASCII letters, digits and - _ . ! ~ * ' ( )."""
    out = F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))
    for code, ch in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(ch))
    return out


def connection_url(host: Column, port: Column, database: Column, user: Column, password: Column, tls_mode: Column) -> Column:
    """A source's or target's address; an IPv6 host is put in brackets.  It holds the password, so it is never stored."""
    host = F.trim(host)
    shown = F.when(host.contains(":") & ~host.startswith("["), F.concat(F.lit("["), host, F.lit("]"))).otherwise(host)
    parts = [F.lit("postgresql://"), percent_encoded(user), F.lit(":"), percent_encoded(password), F.lit("@"), shown, F.lit(":"), port.cast("string"), F.lit("/"), percent_encoded(database), F.lit("?sslmode="), percent_encoded(tls_mode)]
    return F.concat(*parts)


def uuid7(now_ms: int | None = None) -> str:
    """A UUID that begins with the time in milliseconds."""
    stamp = int(time.time() * 1000) if now_ms is None else now_ms
    raw = bytearray(stamp.to_bytes(6, "big") + os.urandom(10))
    raw[6], raw[8] = raw[6] & 0x0F | 0x70, raw[8] & 0x3F | 0x80
    return str(uuid.UUID(bytes=bytes(raw)))
