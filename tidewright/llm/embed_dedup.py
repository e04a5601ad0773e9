"""Embedding near-dedup by sign-key passes.

Equal vectors form one class.  Each pass draws random hyperplanes and deals the classes to buckets
by the signs of a prefix of them; all vectors of a bucket are compared in cosine (double precision),
large buckets by products of blocks, and a spanning forest of the links found is kept.  The depth of
the prefix, the point the planes pass through (the origin or the mean) and the number of passes come
from the vectors themselves (``plan``): a sample gives the share of pairs that meet in a bucket and
each row's chance of meeting a partner at the threshold; passes are added until that chance reaches
``RECALL`` on average and ``LEAST`` for the worst hundredth of the rows, at the least cost.  Depth 0
is one bucket, the exact comparison of all pairs, chosen where keys can't part the vectors for less.
After the union of all passes, the links inside each component are completed exactly, by products
of blocks of its vectors, so groups larger than a bucket report all their links.

Nulls: vectors that are null, zero, or hold null or non-finite components link with nothing; a null
``vec_id`` gets a null component and no links.  Vectors of different lengths don't link.  Repeated
rows count as vectors of their own.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .store import materialize, shuffle_partitions

THRESHOLD, BITS, RECALL, LEAST = 0.95, 62, 0.995, 0.9
BLOCK, LINK_BLOCK, BUCKET_ROWS, SAMPLE = 512, 2048, 4000, 4000
#: Cost of moving a row to a bucket, counted in comparisons.
MOVE = 1000


def _passes(met: np.ndarray, recall: float, least: float) -> float:
    """Passes until rows that meet a partner with chance ``met`` a pass reach ``recall`` and ``least``."""
    reached = lambda p: (x := 1 - (1 - met) ** p).mean() >= recall and np.quantile(x, 0.01) >= least
    hi = 1
    while not reached(hi):
        hi *= 2
        if hi > 1 << 20:
            return math.inf
    lo = hi // 2
    while hi - lo > 1:
        lo, hi = (lo, mid) if reached(mid := (lo + hi) // 2) else (mid, hi)
    return hi


def plan(sample: np.ndarray, n: int, threshold: float, recall: float, seed: int) -> tuple[int, int, np.ndarray]:
    """(passes, depth, centre) of least cost for ``n`` vectors like the unit vectors of ``sample``."""
    best = (float(n), 1, 0, np.zeros(sample.shape[1]))
    apart = 2 * (1 - threshold)
    rng = np.random.default_rng([seed, 1])
    for centre in (np.zeros(sample.shape[1]), sample.mean(axis=0)):
        rest = sample - centre
        # a partner as far from the centre as the row itself, at the threshold's distance
        cosine = np.clip(1 - apart / (2 * np.maximum((rest * rest).sum(axis=1), 1e-12)), -1, 1)
        agree = 1 - np.arccos(cosine) / math.pi
        signs = [rest @ rng.normal(size=(sample.shape[1], BITS)) > 0 for _ in range(4)]
        keys = np.zeros((4, len(sample)), dtype=np.int64)
        for depth in range(1, BITS + 1):
            keys = keys * 2 + np.stack([s[:, depth - 1] for s in signs])
            sizes = [np.unique(k, return_counts=True)[1].astype(float) for k in keys]
            shared = np.mean([(c * (c - 1)).sum() for c in sizes]) / max(1, len(sample) * (len(sample) - 1))
            passes = _passes(agree**depth, recall, LEAST)
            if passes * MOVE > best[0]:
                break  # deeper keys need more passes
            cost = passes * (MOVE + n * shared)
            if cost < best[0]:
                best = (cost, passes, depth, centre)
    return best[1:]


def _matrix(column: pa.Array) -> np.ndarray:
    rows = np.array(column.flatten().to_numpy(), dtype=np.float64).reshape(len(column), -1)
    # scaled first, so that squares of very large or small components don't overflow
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _keys(plans: dict[int, tuple[int, int, np.ndarray]], seed: int):
    """Each vector once a pass, with the sign key of its bucket."""

    def run(batches):
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            dims = np.array(batch.column("dim"))
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                passes, depth, centre = plans[dim]
                if dim not in planes:
                    planes[dim] = np.random.default_rng([seed, dim]).normal(size=(passes, dim, depth))
                v = _matrix(part.column("vector")) - centre
                for p in range(passes):
                    key = (v @ planes[dim][p] > 0) @ (np.int64(1) << np.arange(depth, dtype=np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), p, np.int32)), part.column("dim"), pa.array(key.astype(np.int64)), part.column("rep"), part.column("vector")], ["turn", "dim", "key", "rep", "vector"])

    return run


def _forest(pairs: np.ndarray) -> list[tuple[int, int]]:
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    for a, b in pairs.tolist():
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return [(x, find(x)) for x in parent if find(x) != x]


def _joined(near: np.ndarray) -> np.ndarray:
    """Pairs (row, column) of ``near`` that hold together what all its pairs do, by breadth-first search."""
    if near.sum() <= 4 * sum(near.shape):
        return np.argwhere(near)
    rows, cols, out = near.any(axis=1), np.ones(near.shape[1], dtype=bool), []
    while rows.any():
        edge = np.array([rows.argmax()])
        rows[edge] = False
        while len(edge):
            part = near[edge]
            new = np.flatnonzero(part.any(axis=0) & cols)
            cols[new] = False
            out.append(np.stack([edge[part[:, new].argmax(axis=0)], new], axis=1))
            part = near[:, new]
            edge = np.flatnonzero(part.any(axis=1) & rows)
            rows[edge] = False
            out.append(np.stack([edge, new[part[edge].argmax(axis=1)]] if len(new) else [edge, edge], axis=1))
    return np.concatenate(out)


def _link(threshold: float):
    """A spanning forest of the links of a task's buckets: within a block (p = q) or between two."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        turn, dim, key, rep, mine, p, q = (table.column(c).to_numpy() for c in ("turn", "dim", "key", "rep", "mine", "p", "q"))
        vectors = table.column("vector").combine_chunks()
        vectors = vectors.chunk(0) if isinstance(vectors, pa.ChunkedArray) else vectors
        order = np.lexsort((rep, key, dim, turn))
        cuts = np.flatnonzero((np.diff(turn[order]) != 0) | (np.diff(dim[order]) != 0) | (np.diff(key[order]) != 0)) + 1
        found = []
        for part in np.split(order, cuts) if len(order) else []:
            v = _matrix(vectors.take(pa.array(part)))
            a, b = mine[part] == p[part], mine[part] == q[part]
            pairs = _joined(v[a] @ v[b].T >= threshold)
            found.append(np.stack([rep[part][a][pairs[:, 0]], rep[part][b][pairs[:, 1]]], axis=1))
        edges = np.array(_forest(np.concatenate(found)) if found else [], dtype=np.int64).reshape(-1, 2)
        return pa.table({"a": edges[:, 0], "b": edges[:, 1]})

    return run


def _blocks(rows: DataFrame, of: list[str], block: int, tasks: int) -> DataFrame:
    """``rows`` dealt to tasks: small groups of ``of`` share one, each pair of blocks of a large one has its own."""
    large = rows.groupBy(*of).agg(F.ceil(F.count("*") / block).cast("int").alias("parts")).filter("parts > 1")
    single = F.col("parts") == 1
    dealt = rows.join(F.broadcast(large), of, "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("mine", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return dealt.withColumns({
        "p": F.least("mine", "other"), "q": F.greatest("mine", "other"),
        "task": F.when(single, F.pmod(F.xxhash64(*of), F.lit(tasks))).otherwise(F.xxhash64(*of)),
        "single": single,
    })


def _count(threshold: float):
    """Links of each vector of a task: within its block (p = q) or with the other block."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        comp, rep, weight, mine, p, q = (table.column(c).to_numpy() for c in ("component", "rep", "weight", "mine", "p", "q"))
        vectors = table.column("vector").combine_chunks()
        vectors = vectors.chunk(0) if isinstance(vectors, pa.ChunkedArray) else vectors
        order = np.argsort(comp, kind="stable")
        out_rep, out_n = [], []
        for part in np.split(order, np.flatnonzero(np.diff(comp[order])) + 1) if len(order) else []:
            v = _matrix(vectors.take(pa.array(part)))
            left = part[mine[part] == p[part]]
            a = mine[part] == p[part]
            b = mine[part] == q[part]
            near = v[a] @ v[b].T >= threshold
            same = rep[part][a][:, None] == rep[part][b][None, :]
            near &= ~same
            out_rep.append(rep[left])
            out_n.append(near @ weight[part][b])
            if p[part[0]] != q[part[0]]:
                out_rep.append(rep[part][b])
                out_n.append(near.T @ weight[part][a])
        flat = lambda x: np.concatenate(x).astype(np.int64) if x else np.empty(0, np.int64)
        return pa.table({"rep": flat(out_rep), "n": flat(out_n)})

    return run


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, seed: int = 5) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of ``vectors`` (vec_id, embedding, ...)."""
    spark = vectors.sparkSession
    # single precision stays as it is while vectors move; products are in double precision either way
    kind = "array<float>" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("vector"))
    sound = F.col("vector").isNotNull() & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    usable = rows.filter(sound & F.col("vec_id").isNotNull())
    classes = materialize(usable.groupBy("vector").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight")).withColumn("dim", F.size("vector")), "vectors")
    count = {r["dim"]: r["count"] for r in classes.groupBy("dim").count().collect()}
    n, plans = sum(count.values()), {}
    for dim, own in sorted(count.items()):
        drawn = classes.filter(F.col("dim") == dim).orderBy(F.xxhash64(F.lit(seed), "rep")).limit(SAMPLE).select("vector").toArrow()
        plans[dim] = plan(_matrix(drawn.column("vector").combine_chunks()), own, threshold, recall, seed)
    moved = sum(count[d] * plans[d][0] for d in count)
    keyed = classes.mapInArrow(_keys(plans, seed), f"turn int, dim int, key long, rep long, vector {kind}")
    dealt = _blocks(keyed, ["turn", "dim", "key"], LINK_BLOCK, max(shuffle_partitions(spark), moved // BUCKET_ROWS))
    links = dealt.select("turn", "dim", "key", "rep", "vector", "mine", "p", "q", "task", "single").groupBy("task", "single", "p", "q").applyInArrow(_link(threshold), "a long, b long")
    found = materialize(components(links).select("node", "component"), "components")
    joined = classes.join(found, F.col("rep") == F.col("node"))
    dealt = _blocks(joined, ["component"], BLOCK, max(shuffle_partitions(spark), n // BUCKET_ROWS)).select("component", "rep", "weight", "mine", "vector", "p", "q", "task", "single")
    counts = dealt.groupBy("task", "single", "p", "q").applyInArrow(_count(threshold), "rep long, n long").groupBy("rep").agg(F.sum("n").alias("n"))
    facts = classes.join(found, F.col("rep") == F.col("node"), "left").join(counts, "rep", "left")
    facts = facts.select(F.col("vector").alias("v"), (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    out = rows.join(facts, (rows["vector"] == facts["v"]) & rows["vec_id"].isNotNull(), "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component", "vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))


def op4_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
