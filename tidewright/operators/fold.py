"""Folding a change log to at most one staging row for each key.

Log columns: ``seq``, ``op`` (I, U, D), the key columns, ``old_<key>`` (null unless an update moved
the row), the data columns, and ``p_<column>`` telling whether a data column was sent.  Inserts send
every column.  Staging rows: ``op`` (U upsert, D delete, M move), keys, ``old_<key>``, data, ``p_``.

Keys that no move touches are folded by one aggregation.  As an insert sends all columns, the last
sent value of a column is the last value since the last insert.  Keys linked by moves are folded in
order, one group for each connected set of keys; a batch bounds these.  That fold decides on keys
alone and names for each cell the event it comes from, so values never leave their Arrow columns.

Both ways refuse the same logs: null keys, inserts that lack a column, inserts of a live key, updates
and deletes of a key known to be gone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.storage import materialize
from .components import components
from .names import unused


class AmbiguousSequence(ValueError):
    """A log whose operations can't follow each other."""


def _moved(keys: list[str]) -> Column:
    """Whether an update carries an old key that differs from the new one."""
    has = F.lit(False)
    for k in keys:
        has = has | (F.col(f"old_{k}").isNotNull() & ~F.col(f"old_{k}").eqNullSafe(F.col(k)))
    return (F.col("op") == "U") & has


def _step_fault(before: Column) -> Column:
    """Why an operation can't follow the one before it on the same key, or null."""
    return F.when((F.col("op") == "I") & before.isin("I", "U"), "insert of a live key").when(F.col("op").isin("U", "D") & (before == "D"), "change of a deleted key")


def fold_stable(log: DataFrame, keys: list[str], data: list[str]) -> DataFrame:
    """Staging rows of a log without moves; running it raises for an illegal log."""
    fault, first, final = (unused(n, log.columns) for n in ("_fault", "_first", "_last"))
    null_key = F.lit(False)
    for k in keys:
        null_key = null_key | F.col(k).isNull()
    short = F.lit(False)
    for c in data:
        short = short | ~F.coalesce(F.col(f"p_{c}"), F.lit(False))
    before = F.lag("op").over(Window.partitionBy(*keys).orderBy("seq"))
    why = F.when(null_key, "null key").when(~F.coalesce(F.col("op").isin("I", "U", "D"), F.lit(False)), "unknown operation").when((F.col("op") == "I") & short, "incomplete insert").otherwise(_step_fault(before))
    cells = {c: unused(f"_{c}", log.columns) for c in data}
    last = [F.expr(f"max_by(struct(`{c}`), seq) FILTER (WHERE `p_{c}`)").alias(cells[c]) for c in data]
    sent = [F.bool_or(f"p_{c}").alias(f"p_{c}") for c in data]
    # the window and the aggregation share one shuffle on the key
    rows = log.withColumn(fault, why).groupBy(*keys).agg(F.min_by("op", "seq").alias(first), F.max_by("op", "seq").alias(final), F.min(fault).alias(fault), *last, *sent)
    refused = F.raise_error(F.concat(F.lit("AmbiguousSequence: "), F.col(fault), F.lit(" "), F.to_json(F.struct(*keys)))).cast("boolean")
    rows = rows.filter(F.when(F.col(fault).isNotNull(), refused).otherwise(~((F.col(first) == "I") & (F.col(final) == "D"))))
    gone = F.col(final) == "D"
    return rows.select(
        F.when(gone, "D").otherwise("U").alias("op"),
        *keys,
        *(F.lit(None).cast(log.schema[k].dataType).alias(f"old_{k}") for k in keys),
        *(F.when(~gone, F.col(cells[c])[c]).alias(c) for c in data),
        *(F.when(gone, False).otherwise(F.coalesce(f"p_{c}", F.lit(False))).alias(f"p_{c}") for c in data),
    )


def illegal_steps(log: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose operation can't follow the one before it on the same key."""
    before = F.lag("op").over(Window.partitionBy(*keys).orderBy("seq"))
    return log.withColumn("previous_op", before).withColumn("illegal", _step_fault(before).isNotNull()).filter("illegal").drop("illegal")


def fold_steps(steps: list[tuple], data: list[str]) -> list[tuple]:
    """The fold of ordered events (op, key, old key or None, sent columns), moves included.

    Returns (op, key, old key or None, {column: number of the event that holds its value}).  A lineage is
    the life of one row: the key it had before the batch (none if inserted) and the key it has now (none
    if deleted).
    """
    lives: list[dict] = []
    live: dict[tuple, dict] = {}
    origins: dict[tuple, dict] = {}
    gone: set[tuple] = set()

    def begin(origin, now) -> dict:
        life = {"origin": origin, "now": now, "cells": {}}
        lives.append(life)
        if origin is not None:
            origins[origin] = life
        return life

    for n, (op, key, old, sent) in enumerate(steps):
        if any(v is None for v in key):
            raise AmbiguousSequence("null key")
        if op == "I":
            if key in live:
                raise AmbiguousSequence(f"insert of a live key {key}")
            if len(sent) < len(data):
                raise AmbiguousSequence(f"incomplete insert {key}")
            life = origins.get(key)
            if life is None or life["now"] is not None:
                life = begin(None, None)
            life["now"], life["cells"] = key, dict.fromkeys(sent, n)
            live[key] = life
            gone.discard(key)
            continue
        if op not in ("U", "D"):
            raise AmbiguousSequence(f"unknown operation {op}")
        source = old or key
        if source in gone:
            raise AmbiguousSequence(f"change of a deleted key {source}")
        life = live.pop(source, None) or begin(source, source)
        if op == "D":
            life["now"], life["cells"] = None, {}
            gone.add(source)
            continue
        life["cells"] |= dict.fromkeys(sent, n)
        if key != source:
            if key in live or origins.get(key, life) is not life:
                raise AmbiguousSequence(f"move onto a key that another row has or had: {key}")
            gone.add(source)
            gone.discard(key)
        life["now"] = key
        live[key] = life
    out = []
    for life in lives:
        origin, now, cells = life["origin"], life["now"], life["cells"]
        if now is None and (origin is None or origin in live):
            continue
        op = "D" if now is None else "U" if origin in (None, now) else "M"
        out.append((op, now or origin, origin if op == "M" else None, cells))
    return out


def _comparable(values: list) -> list:
    """NaN keys compare equal, as in SQL."""
    return ["NaN" if v != v else v for v in values]


def _fold_groups(keys: list[str], data: list[str], shape: pa.Schema, group: str):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        number = {g: i for i, g in enumerate(dict.fromkeys(table.column(group).to_pylist()))}
        order = np.lexsort((table.column("seq").to_numpy(), [number[g] for g in table.column(group).to_pylist()]))
        table = table.take(pa.array(order))
        which = table.column(group).to_pylist()
        new = list(zip(*(_comparable(table.column(k).to_pylist()) for k in keys)))
        old = [None if any(v is None for v in o) or o == k else o for o, k in zip(zip(*(_comparable(table.column(f"old_{k}").to_pylist()) for k in keys)), new)]
        sent = {c: table.column(f"p_{c}").to_pylist() for c in data}
        ops = table.column("op").to_pylist()
        # the key's own columns come from the first event that shows it as a new or old key
        shown: dict[tuple, tuple[str, int]] = {}
        rows, lo = [], 0
        for hi in range(1, len(which) + 1):
            if hi < len(which) and which[hi] == which[lo]:
                continue
            for i in range(lo, hi):
                shown.setdefault(new[i], ("", i))
                if old[i]:
                    shown.setdefault(old[i], ("old_", i))
            steps = [(ops[i], new[i], old[i], [c for c in data if sent[c][i]]) for i in range(lo, hi)]
            rows += [(op, key, was, {c: lo + n for c, n in cells.items()}) for op, key, was, cells in fold_steps(steps, data)]
            lo = hi

        def pick(column: str, at: list) -> pa.Array:
            taken = table.column(column).take(pa.array(at, pa.int64()))
            return taken.combine_chunks() if isinstance(taken, pa.ChunkedArray) else taken

        def key_column(k: str, wanted: list) -> pa.Array:
            new_at = [shown[w][1] if w and not shown[w][0] else None for w in wanted]
            old_at = [shown[w][1] if w and shown[w][0] else None for w in wanted]
            return pa.compute.coalesce(pick(k, new_at), pick(f"old_{k}", old_at))

        columns = {"op": pa.array([r[0] for r in rows], pa.string())}
        columns |= {k: key_column(k, [r[1] for r in rows]) for k in keys}
        columns |= {f"old_{k}": key_column(k, [r[2] for r in rows]) for k in keys}
        columns |= {c: pick(c, [r[3].get(c) for r in rows]) for c in data}
        columns |= {f"p_{c}": pa.array([c in r[3] for r in rows], pa.bool_()) for c in data}
        return pa.table([columns[f.name].cast(f.type) for f in shape], schema=shape)

    return run


def key_sets(moves: DataFrame) -> DataFrame:
    """(node, component) of the keys in moves (a, b): a move that shares no key with another is a set of its own."""
    ends = moves.select(F.explode(F.array("a", "b")).alias("node"))
    shared = ends.groupBy("node").count().filter("count > 1").select("node")
    own = lambda m: m.select(F.explode(F.array("a", "b")).alias("node"), F.col("b").alias("component"))
    if shared.isEmpty():
        return own(moves)
    shared = materialize(shared, "shared")
    simple = moves.join(shared, F.col("a") == F.col("node"), "left_anti").join(shared, F.col("b") == F.col("node"), "left_anti")
    return own(simple).union(components(moves.join(simple, ["a", "b"], "left_anti")))


def fold(log: DataFrame, keys: list[str], data: list[str]) -> DataFrame:
    """Staging rows of any log; keys linked by moves go through ``fold_steps``."""
    from pyspark.sql.pandas.types import to_arrow_schema

    new, old = (F.struct(*(F.col(p + k).alias(k) for k in keys)) for p in ("", "old_"))
    moves = materialize(log.filter(_moved(keys)).select(old.alias("a"), new.alias("b")).distinct(), "moved")
    if moves.isEmpty():
        return fold_stable(log, keys, data)
    key, group, task, node = (unused(n, log.columns) for n in ("_key", "_group", "_task", "_node"))
    links = key_sets(moves).select(F.col("node").alias(node), F.col("component").alias(group))
    marked = log.withColumn(key, F.when(F.col("op") == "I", new).otherwise(F.when(_moved(keys), old).otherwise(new)))
    marked = marked.join(links, F.col(key) == F.col(node), "left").drop(key, node)
    stable = fold_stable(marked.filter(F.col(group).isNull()).drop(group), keys, data)
    shape = T.StructType([T.StructField(f.name, f.dataType, True) for f in stable.schema.fields])
    # sets of keys are folded many to a task; a set itself is bounded by its batch
    tasks = int(log.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    linked = marked.filter(F.col(group).isNotNull()).withColumn(group, F.sha2(F.to_json(group), 256)).withColumn(task, F.pmod(F.xxhash64(group), F.lit(tasks)))
    linked = linked.select("seq", "op", *keys, *(f"old_{k}" for k in keys), *data, *(f"p_{c}" for c in data), group, task)
    return stable.unionByName(linked.groupBy(task).applyInArrow(_fold_groups(keys, data, to_arrow_schema(shape), group), shape))
