"""Quotation linking of conversations, in DataFrame functions only.

Each line's quote level is its number of leading ``>`` marks.  Each run of lines of a level without
blank lines is a passage; its text is normalised (marks and outer space off, A-Z lowered, white space
and line breaks collapsed) and hashed.  A quoted passage is linked to the last earlier message of its
conversation that has it as a passage, a line or its whole text at level 0; where there is none, its
lines are linked likewise, each by itself.  A message replies to the message that most of its linked
level-1 text comes from (of equals the latest); it belongs to the thread of the first message along
these replies.
Messages come back without quoted lines in order of conversation, thread, turn, so that a reply
always follows what it quotes.

The link is a running window over (conversation, hash), not a join, so a line repeated many
times makes no pairs; threads are found by pointer doubling, one join of the replies a round.
Nulls: a null text is empty; rows with null conversation or turn link with nothing.  Repeated rows
of a turn share their reply.  Blank lines are neither sources nor links.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import materialize

_MARKS = r"^(\s*>)+"


def _lines(text: Column) -> Column:
    """Array of (level, plain) for the lines of a text."""
    parts = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n"), "\n")
    marks = lambda s: F.regexp_extract(s, _MARKS, 0)
    return F.transform(parts, lambda s: F.struct(F.length(F.regexp_replace(marks(s), "[^>]", "")).alias("level"), F.regexp_replace(s, _MARKS, "").alias("plain")))


def _normal(plain: Column) -> Column:
    lower = F.translate(plain, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.trim(F.regexp_replace(lower, r"\s+", " "))


def _body(lines: Column) -> Column:
    kept = F.filter(lines, lambda x: x["level"] == 0)
    return F.array_join(F.transform(kept, lambda x: x["plain"]), "\n")


def _passages(lines: Column) -> Column:
    """Array of (level, lines) for the runs of equal level between blank lines; ``lines`` is normalised."""
    blank = lambda i: F.get(lines, i)["plain"] == ""
    level = lambda i: F.get(lines, i)["level"]
    starts = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: ~blank(i) & ((i == 0) | F.coalesce(blank(i - 1) | (level(i - 1) != level(i)), F.lit(True))))
    ends = F.filter(F.sequence(F.lit(1), F.size(lines)), lambda i: ~blank(i - 1) & ((i == F.size(lines)) | F.coalesce(blank(i) | (level(i - 1) != level(i)), F.lit(True))))
    return F.transform(F.arrays_zip(starts.alias("a"), ends.alias("z")), lambda r: F.struct(level(r["a"]).alias("level"), F.transform(F.slice(lines, r["a"] + 1, r["z"] - r["a"]), lambda x: x["plain"]).alias("lines")))


def replies(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, n_linked, parent_turn) of the turns with at least one linked line."""
    keyed = messages.filter("conv_id is not null and turn is not null and text is not null")
    quoting = F.exists("lines", lambda x: x["level"] > 0)
    each = keyed.withColumn("lines", _lines(F.col("text")))
    # only conversations in which something is quoted need their lines spread out
    convs = each.filter(quoting).select("conv_id").distinct()
    own = each.join(convs, "conv_id", "left_semi").withColumn("lines", F.transform("lines", lambda x: F.struct(x["level"].alias("level"), _normal(x["plain"]).alias("plain"))))
    spread = own.select("conv_id", "turn", F.xxhash64("text").alias("message"), F.col("lines"), F.posexplode(_passages(F.col("lines"))).alias("place", "passage"))
    spread = spread.select("conv_id", "turn", "message", "place", "passage.level", "passage.lines", F.array_join("passage.lines", " ").alias("joined"))
    # a passage of one line is that line
    single = F.when(F.size("lines") > 1, F.col("lines")).otherwise(F.array().cast("array<string>"))
    unit = F.explode(F.concat(F.array(F.struct(F.col("joined").alias("text"), F.size("lines").alias("n"), F.lit(True).alias("whole"))), F.transform(single, lambda x: F.struct(x.alias("text"), F.lit(1).alias("n"), F.lit(False).alias("whole")))))
    units = spread.select("conv_id", "turn", "message", "place", "level", unit.alias("unit")).select("conv_id", "turn", "message", "place", "level", "unit.n", "unit.whole", F.length("unit.text").alias("chars"), F.sha2("unit.text", 256).alias("hash"))
    body = F.array_join(F.transform(F.filter("lines", lambda x: (x["level"] == 0) & (x["plain"] != "")), lambda x: x["plain"]), " ")
    sources = units.filter("level = 0").select("conv_id", "turn", "hash").union(own.select("conv_id", "turn", F.sha2(body, 256))).distinct()
    quotes = units.filter("level > 0")
    both = quotes.unionByName(sources.withColumn("level", F.lit(0)), allowMissingColumns=True)
    before = Window.partitionBy("conv_id", "hash").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    source = F.max(F.when(F.col("level") == 0, F.col("turn"))).over(before)
    linked = both.withColumn("source", source).filter("level > 0 and source is not null")
    passage = Window.partitionBy("conv_id", "turn", "message", "place")
    linked = linked.withColumn("found", F.max("whole").over(passage)).filter("whole = found")
    by_source = linked.groupBy("conv_id", "turn", "source").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("level") == 1, F.col("chars"))).alias("chars"))
    direct = F.max(F.when(F.col("chars").isNotNull(), F.struct("chars", "source")))["source"]
    return by_source.groupBy("conv_id", "turn").agg(F.sum("n").alias("n_linked"), direct.alias("parent_turn"))


def threads(links: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(conv_id, turn, thread_turn): the first turn along the replies, by pointer doubling."""
    state = materialize(links.filter("parent_turn is not null").select("conv_id", "turn", F.col("parent_turn").alias("up")), "replies")
    for _ in range(max_rounds):
        above = state.select("conv_id", F.col("turn").alias("up"), F.col("up").alias("next"))
        moved = state.join(above, ["conv_id", "up"], "left").select("conv_id", "turn", F.coalesce("next", "up").alias("up"), F.col("next").isNotNull().alias("moved"))
        moved = materialize(moved, "replies")
        state = moved.select("conv_id", "turn", "up")
        if not moved.filter("moved").limit(1).count():
            break
    return state.select("conv_id", "turn", F.col("up").alias("thread_turn"))


def link_quotes(conversations: DataFrame) -> DataFrame:
    """Messages without quotes, in reply order, with their links."""
    rows = conversations.select(*(F.col(c).cast(t).alias(c) for c, t in (("conv_id", "long"), ("turn", "long"), ("role", "string"), ("text", "string"))))
    links = materialize(replies(rows), "links")
    lines = rows.withColumn("lines", _lines(F.col("text")))
    out = lines.join(links, ["conv_id", "turn"], "left").join(threads(links), ["conv_id", "turn"], "left")
    quoted = F.size(F.filter("lines", lambda x: x["level"] > 0)).cast("long")
    out = out.select("conv_id", "turn", "role", "parent_turn", F.coalesce("thread_turn", "turn").alias("thread_turn"), quoted.alias("n_quoted"), F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), _body(F.col("lines")).alias("body"))
    return out.orderBy("conv_id", "thread_turn", "turn")


def op9_quote_linking(spark, sf_dir: str) -> DataFrame:
    return link_quotes(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


_SPACE = r"[ \t\n\x0B\f\r]"
OP9_SQL = rf"""
WITH RECURSIVE m AS (SELECT row_number() OVER () AS rid, conv_id, turn, role, text FROM conversations),
parts AS (SELECT *, string_split(regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g'), chr(10)) AS p FROM m),
lines AS (SELECT rid, conv_id, turn, text, unnest(range(1, len(p) + 1)) AS i, unnest(p) AS raw FROM parts),
marked AS (SELECT *, regexp_extract(raw, '^({_SPACE}*>)+') AS mark FROM lines),
leveled AS (SELECT rid, conv_id, turn, text, i, len(mark) - len(replace(mark, '>', '')) AS level, substr(raw, len(mark) + 1) AS plain FROM marked),
normal AS (SELECT *, trim(regexp_replace(translate(plain, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_SPACE}+', ' ', 'g'), ' ') AS norm FROM leveled WHERE conv_id IS NOT NULL AND turn IS NOT NULL AND text IS NOT NULL),
before AS (SELECT *, lag(norm) OVER w AS b, lag(level) OVER w AS bl FROM normal WINDOW w AS (PARTITION BY rid ORDER BY i)),
placed AS (SELECT * FROM (SELECT *, sum(CASE WHEN norm <> '' AND (b IS NULL OR b = '' OR bl <> level) THEN 1 ELSE 0 END) OVER (PARTITION BY rid ORDER BY i) AS place FROM before) WHERE norm <> ''),
passages AS (SELECT rid, conv_id, turn, place, level, string_agg(norm, ' ' ORDER BY i) AS h, count(*) AS n FROM placed GROUP BY ALL),
sources AS (
  SELECT conv_id, turn, h FROM passages WHERE level = 0 UNION SELECT conv_id, turn, norm FROM placed WHERE level = 0
  UNION SELECT conv_id, turn, h FROM (SELECT rid, conv_id, turn, string_agg(norm, ' ' ORDER BY i) AS h FROM placed WHERE level = 0 GROUP BY ALL)
),
units AS (
  SELECT rid, conv_id, turn, place, level, h, n, true AS whole FROM passages WHERE level > 0
  UNION ALL SELECT l.rid, l.conv_id, l.turn, l.place, l.level, l.norm, 1, false FROM placed l JOIN passages p USING (rid, place) WHERE l.level > 0 AND p.n > 1
),
found AS (SELECT u.k, u.rid, u.conv_id, u.turn, u.place, u.level, u.h, u.n, u.whole, max(s.turn) AS source FROM (SELECT *, row_number() OVER () AS k FROM units) u JOIN sources s ON s.conv_id = u.conv_id AND s.h = u.h AND s.turn < u.turn GROUP BY ALL),
best AS (SELECT *, bool_or(whole) OVER (PARTITION BY rid, place) AS any_whole FROM found),
by_source AS (SELECT conv_id, turn, source, sum(n) AS n, sum(CASE WHEN level = 1 THEN len(h) END) AS chars FROM best WHERE whole = any_whole GROUP BY ALL),
links AS (SELECT conv_id, turn, CAST(sum(n) AS BIGINT) AS n_linked, arg_max(source, struct_pack(a := chars, b := source)) FILTER (WHERE chars IS NOT NULL) AS parent_turn FROM by_source GROUP BY ALL),
up AS (
  SELECT conv_id, turn, parent_turn AS top FROM links WHERE parent_turn IS NOT NULL
  UNION ALL SELECT up.conv_id, up.turn, l.parent_turn FROM up JOIN links l ON l.conv_id = up.conv_id AND l.turn = up.top WHERE l.parent_turn IS NOT NULL
),
tops AS (SELECT conv_id, turn, min(top) AS top FROM up GROUP BY ALL),
bodies AS (SELECT rid, count(*) FILTER (WHERE level > 0) AS n_quoted, coalesce(string_agg(plain, chr(10) ORDER BY i) FILTER (WHERE level = 0), '') AS body FROM leveled GROUP BY ALL)
SELECT m.conv_id, m.turn, m.role, l.parent_turn, coalesce(t.top, m.turn) AS thread_turn, b.n_quoted, coalesce(l.n_linked, 0) AS n_linked, b.body
FROM m JOIN bodies b USING (rid) LEFT JOIN links l ON l.conv_id = m.conv_id AND l.turn = m.turn LEFT JOIN tops t ON t.conv_id = m.conv_id AND t.turn = m.turn
"""
