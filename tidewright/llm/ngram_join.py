"""N-gram Jaccard self-join: exact classes of documents whose shingle sets overlap by a set share.

1. Each document's set of distinct 5-word shingles is hashed; documents with equal sets form one
   class, stood for by the smallest id.  Each task posts a set once, whatever its copies.
2. A pair that reaches the share must have a common shingle among the first
   ``n - ceil(share * n) + 1`` of each set in any fixed order.  The order is by a fixed-size sketch
   of shingle frequency, rare first, so common lines and passages stay out of these prefixes.
3. Prefix entries are dealt to hash blocks.  A block turns each posting list into segments between
   which sizes differ too much, and names each segment after its smallest document (or that one's own smallest).
4. Each document has a parity bitmap of its set, about one bit a shingle.  Two bitmaps differ in no
   more bits than their sets in shingles, so a document that differs too much from every other one
   of its group leaves it before any text is moved.
5. Each named group is a product of its document-by-shingle incidence matrix with its transpose.
   Groups above ``block_docs`` are dealt out as pairs of document blocks.  Overlaps are accumulated over blocks
   of columns; pairs below the size-derived bound go, and a spanning forest of the rest is returned.
6. Components of the forest edges, by alternating stars.

No pair table exists at any time: each step's rows are linear in documents, but for copies of a
document in a group over ``block_docs``, which go to one task per block of that group.

Nulls: null, empty and word-less texts have an empty set and link with nothing.  A null ``doc_id``
is returned with a null component.  Rows that repeat a ``doc_id`` are one node, each returned.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import components
from .store import materialize, shuffle_partitions
from .tokens import mix, shingles, words

WIDTH, PERCENT = 5, 75
SKETCH_BITS, SLOT_BITS = 22, 18
BLOCK_DOCS = 512
ENTRIES_PER_BLOCK = 1_000_000
GROUP_ROWS = 2_000
MEMBER_BITS = 26
MEMBER_SQL = f"pmod(xxhash64(doc), {1 << MEMBER_BITS}L) + 1"
COLUMNS = 4096
PARITY_BITS = (64, 4096)
SPARSE_COLUMN = 8
SEEN = 200_000
SECOND = np.uint64(0x5851F42D4C957F2D)


def shingle_sets(texts: pa.Array, width: int):
    """(document in the batch, its sorted distinct shingle hashes) for texts with words."""
    for w in words(texts, lower=True):
        runs, bounds = shingles(w.hashes, w.first, width)
        for i in range(w.hi - w.lo):
            if bounds[i + 1] > bounds[i]:
                yield w.lo + i, np.unique(runs[bounds[i] : bounds[i + 1]])


def parity(mixed: np.ndarray) -> bytes:
    """Bit i tells whether an odd number of the hashes fall on i; halves XORed give the bitmap of half the width."""
    bits = min(max(1 << (len(mixed) - 1).bit_length(), PARITY_BITS[0]), PARITY_BITS[1])
    odd = np.bincount((mixed & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def promising(bitmaps: list[bytes], n: np.ndarray, percent: int) -> np.ndarray:
    """Whether each set may reach the share with another one, by sizes and differing bits."""
    width = np.array([len(x) for x in bitmaps])
    found = np.zeros(len(n), dtype=bool)
    for w in np.unique(width):
        wide = np.flatnonzero(width >= w)
        folded = np.stack([np.bitwise_xor.reduce(np.frombuffer(bitmaps[i], np.uint8).reshape(-1, w), axis=0) for i in wide])
        sign = np.unpackbits(folded, axis=1).astype(np.float32) * 2 - 1
        row = np.flatnonzero(width[wide] == w)
        differ = (8 * w - sign[row] @ sign.T) / 2
        a, b = n[wide][row][:, None], n[wide][None, :]
        near = (differ * (100 + percent) <= (100 - percent) * (a + b)) & (100 * np.minimum(a, b) >= percent * np.maximum(a, b))
        near[np.arange(len(row)), row] = False
        found[wide[row]] |= near.any(axis=1)
        found[wide] |= near.any(axis=0)
    return found


def _hopeful(percent: int):
    def run(table: pa.Table) -> pa.Table:
        hub, n, bits = table.column("hub").to_numpy(), table.column("n").to_numpy(), table.column("bits").to_pylist()
        order = np.argsort(hub, kind="stable")
        at = np.flatnonzero(np.diff(hub[order], prepend=hub[order[0]] - 1))
        keep = [part[promising([bits[i] for i in part], n[part], percent)] for part in np.split(order, at[1:])]
        return table.select(["doc", "hub", "task", "p", "q"]).take(pa.array(np.concatenate(keep)))

    return run


def _profile(width: int):
    """Per document size, signature and parity bitmap; per task the frequency sketch, in slots."""

    def run(batches):
        sketch = np.zeros(1 << SKETCH_BITS, dtype=np.int32)
        for batch in batches:
            n, a, b = (np.zeros(batch.num_rows, dtype=np.int64) for _ in range(3))
            bits: list[bytes | None] = [None] * batch.num_rows
            for i, s in shingle_sets(batch.column("text"), width):
                n[i] = len(s)
                a[i] = np.add.reduce(mix(s)).view(np.int64)
                mixed = mix(s ^ SECOND)
                b[i], bits[i] = np.add.reduce(mixed).view(np.int64), parity(mixed)
                np.add.at(sketch, (s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), 1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), pa.array(a), pa.array(b), pa.array(bits, pa.binary()), pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary())], ["doc_id", "n", "s1", "s2", "bits", "slot", "counts"])
        squeeze = zstandard.ZstdCompressor(level=1)
        parts = [(k, p) for k, p in enumerate(sketch.reshape(-1, 1 << SLOT_BITS)) if p.any()]
        m = len(parts)
        yield pa.RecordBatch.from_arrays([pa.nulls(m, pa.int64())] * 4 + [pa.nulls(m, pa.binary())] + [pa.array([k for k, _ in parts], pa.int32()), pa.array([squeeze.compress(p.tobytes()) for _, p in parts], pa.binary())], ["doc_id", "n", "s1", "s2", "bits", "slot", "counts"])

    return run


def _add_slots(table: pa.Table) -> pa.Table:
    total = np.zeros(1 << SLOT_BITS, dtype=np.int64)
    for x in table.column("counts"):
        total += np.frombuffer(zstandard.ZstdDecompressor().decompress(x.as_buffer()), dtype=np.int32)
    total = np.minimum(total, np.iinfo(np.int32).max).astype(np.int32)
    return pa.table({"slot": table.column("slot")[:1], "counts": pa.array([total.tobytes()], pa.binary())})


class Seen:
    """Signatures met lately by a task: of a group of copies only one row in ``SEEN`` different ones goes on."""

    def __init__(self) -> None:
        self.known: set[tuple] = set()

    def add(self, signature: tuple) -> bool:
        """Whether the signature is new."""
        if signature in self.known:
            return False
        if len(self.known) >= SEEN:
            self.known.clear()
        self.known.add(signature)
        return True


def _prefixes(width: int, percent: int, sketch, blocks: int):
    """Prefix entries by hash block: one row of packed arrays for each block and batch."""

    def run(batches):
        seen = Seen()
        weight = np.frombuffer(sketch.value, dtype=np.int32)
        for batch in batches:
            ids = batch.column("doc_id")
            has_id = ids.is_valid().to_numpy(zero_copy_only=False)
            ids = ids.fill_null(0).to_numpy()
            hashes, owners, sizes, marks = [], [], np.zeros(len(ids), np.int64), np.zeros(len(ids), np.uint64)
            for i, s in shingle_sets(batch.column("text"), width):
                if not has_id[i]:
                    continue
                n = len(s)
                sizes[i], marks[i] = n, np.add.reduce(mix(s))
                if not seen.add((n, int(marks[i]), int(np.add.reduce(mix(s ^ SECOND))))):
                    continue
                keep = n - -(-percent * n // 100) + 1
                order = np.lexsort((s, weight[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]))[:keep]
                hashes.append(s[order])
                owners.append(np.full(keep, i, dtype=np.int32))
            if not hashes:
                continue
            h, o = np.concatenate(hashes), np.concatenate(owners)
            block = ((h >> np.uint64(32)) % np.uint64(blocks)).astype(np.int32)
            order = np.argsort(block, kind="stable")
            h, o, block = h[order].astype(np.uint32), o[order], block[order]
            at = np.flatnonzero(np.diff(block, prepend=-1))
            rows = []
            for lo, hi in zip(at, [*at[1:], len(block)]):
                own, count = np.unique(o[lo:hi], return_counts=True)  # entries lie in the order of their owners
                rows.append((int(block[lo]), ids[own].tobytes(), sizes[own].astype(np.int32).tobytes(), marks[own].tobytes(), h[lo:hi].tobytes(), count.astype(np.int32).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [pa.int32()] + [pa.binary()] * 5)], ["block", "ids", "sizes", "marks", "hashes", "lengths"])

    return run


def _groups(percent: int, slices: int):
    """Memberships (hub, document) of one hash block, packed by slices of documents."""

    def run(table: pa.Table) -> pa.Table:
        col = {c: [x.as_buffer() for x in table.column(c)] for c in ("ids", "sizes", "marks", "hashes", "lengths")}
        cat = lambda c, t: np.concatenate([np.frombuffer(x, dtype=t) for x in col[c]])
        ids, sizes, marks, h = cat("ids", np.int64), cat("sizes", np.int32), cat("marks", np.uint64), cat("hashes", np.uint32)
        own = np.repeat(np.arange(len(ids)), cat("lengths", np.int32))
        order = np.argsort(h, kind="stable")
        h, own = h[order], own[order]
        same = h[1:] == h[:-1]
        repeat = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        h, own = h[repeat], own[repeat]
        order = np.lexsort((ids[own], marks[own], h))
        h, own = h[order], own[order]
        fresh = np.ones(len(h), dtype=bool)
        fresh[1:] = (h[1:] != h[:-1]) | (marks[own[1:]] != marks[own[:-1]])
        h, own = h[fresh], own[fresh]
        order = np.lexsort((sizes[own], h))
        h, own = h[order], own[order]
        out = (np.empty(0, np.int64), np.empty(0, np.int64))
        if len(h):
            n = sizes[own].astype(np.int64)
            cut = np.ones(len(h), dtype=bool)
            cut[1:] = (h[1:] != h[:-1]) | (100 * n[:-1] < percent * n[1:])
            at = np.flatnonzero(cut)
            length = np.diff(np.append(at, len(h)))
            hub = np.repeat(np.minimum.reduceat(ids[own], at), length)
            many = np.repeat(length, length) > 1
            pair = np.unique(np.stack([hub[many], ids[own][many]], axis=1), axis=0)
            out = (pair[:, 0], pair[:, 1])
        part = (mix(out[1].view(np.uint64)) % np.uint64(slices)).astype(np.int32)
        order = np.argsort(part, kind="stable")
        at = np.flatnonzero(np.diff(part[order], prepend=-1))
        rows = [(int(part[o[0]]), out[0][o].tobytes(), out[1][o].tobytes()) for o in np.split(order, at[1:])] if len(order) else []
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 3, [pa.int32(), pa.binary(), pa.binary()])], names=["slice", "hubs", "docs"])

    return run


def _memberships(table: pa.Table) -> pa.Table:
    """One row a document with the hubs of all blocks."""
    pair = np.stack([np.concatenate([np.frombuffer(x.as_buffer(), dtype=np.int64) for x in table.column(c)]) for c in ("docs", "hubs")], axis=1)
    pair = np.unique(pair, axis=0)
    at = np.flatnonzero(np.concatenate([[True], pair[1:, 0] != pair[:-1, 0]]))
    hubs = pa.ListArray.from_arrays(pa.array(np.append(at, len(pair)), pa.int32()), pa.array(pair[:, 1]))
    return pa.table({"doc": pair[at, 0], "hubs": hubs})


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Intersection sizes of all sets of a block: incidence times its transpose, by column blocks."""
    m = len(sets)
    rows = np.repeat(np.arange(m), [len(s) for s in sets])
    flat = np.concatenate(sets) if m else np.empty(0, np.uint64)
    order = np.argsort(flat, kind="stable")
    flat, rows = flat[order], rows[order]
    at = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]])) if len(flat) else np.empty(0, np.int64)
    count = np.diff(np.append(at, len(flat)))
    total = np.zeros((m, m), dtype=np.int64)
    for k in range(2, SPARSE_COLUMN + 1):
        first = at[count == k]
        for i in range(k):
            for j in range(i + 1, k):
                total += np.bincount(rows[first + i] * m + rows[first + j], minlength=m * m).reshape(m, m)
    total += total.T
    dense = np.flatnonzero(count > SPARSE_COLUMN)
    for lo in range(0, len(dense), COLUMNS):
        take = dense[lo : lo + COLUMNS]
        part = np.zeros((m, len(take)), dtype=np.float32)
        entry = np.repeat(at[take] - np.concatenate([[0], np.cumsum(count[take])[:-1]]), count[take]) + np.arange(count[take].sum())
        part[rows[entry], np.repeat(np.arange(len(take)), count[take])] = 1
        total += (part @ part.T).astype(np.int64)
    np.fill_diagonal(total, [len(s) for s in sets])
    return total


def forest(linked: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each node to the smallest id of its component, given a symmetric link matrix."""
    order = np.argsort(ids)
    linked, ids = linked[np.ix_(order, order)], ids[order]
    np.fill_diagonal(linked, True)
    label = np.arange(len(ids))
    while True:
        new = np.where(linked, label[None, :], len(ids)).min(axis=1)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(ids))
    return ids[moved], ids[label[moved]]


def _product(width: int, percent: int):
    def one(ids: np.ndarray, blobs: list) -> tuple[np.ndarray, np.ndarray]:
        unpack = zstandard.ZstdDecompressor()
        texts = pa.array([unpack.decompress(x.as_buffer()) for x in blobs], pa.large_binary()).cast(pa.large_string())
        sets: list[np.ndarray] = [np.empty(0, np.uint64)] * len(ids)
        for i, s in shingle_sets(texts, width):
            sets[i] = s
        n = np.array([len(s) for s in sets], dtype=np.int64)
        common = overlaps(sets)
        linked = (100 * common >= percent * (n[:, None] + n[None, :] - common)) & (common > 0)
        return forest(linked, ids)

    def run(table: pa.Table) -> pa.Table:
        hub, ids = table.column("hub").to_numpy(), table.column("doc_id").to_numpy()
        blobs = list(table.column("packed"))
        order = np.argsort(hub, kind="stable")
        at = np.flatnonzero(np.diff(hub[order], prepend=hub[order[0]] - 1))
        found = [one(ids[part], [blobs[i] for i in part]) for part in np.split(order, at[1:])]
        return pa.table({"a": np.concatenate([a for a, _ in found]), "b": np.concatenate([b for _, b in found])})

    return run


def _pack(members):
    """Compressed texts of the rows that the member filter lets through."""

    def run(batches):
        bits, squeeze = members.value, zstandard.ZstdCompressor(level=1)
        for batch in batches:
            place = batch.column("place").to_numpy()
            batch = batch.filter(pa.array((bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1))
            packed = [squeeze.compress(x.as_buffer()) if x.is_valid else b"" for x in batch.column("text").cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(packed, pa.binary())], ["doc_id", "packed"])

    return run


def _place(column: str) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(1 << MEMBER_BITS))


def _member_bits(docs: DataFrame) -> np.ndarray:
    """A bit for each hash of ``doc``: fixed in size, it only saves shuffling; the join decides."""
    rows = docs.groupBy(F.expr(f"bitmap_bucket_number({MEMBER_SQL})").alias("bucket")).agg(F.expr(f"bitmap_construct_agg(bitmap_bit_position({MEMBER_SQL}))").alias("bits"))
    out = np.zeros(1 << MEMBER_BITS - 3, dtype=np.uint8)
    for r in rows.collect():
        at = (r["bucket"] - 1) * 4096
        out[at : at + 4096] = np.frombuffer(r["bits"], dtype=np.uint8)
    return out


def jaccard_components(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of ``docs`` (doc_id, text, ...)."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    seen = materialize(rows.mapInArrow(_profile(width), "doc_id long, n long, s1 long, s2 long, bits binary, slot int, counts binary"), "sets")
    profile = seen.filter("slot is null").select("doc_id", "n", "s1", "s2")
    slots = seen.filter("slot is not null").select("slot", "counts").groupBy("slot").applyInArrow(_add_slots, "slot int, counts binary").collect()
    table = np.zeros((1 << SKETCH_BITS - SLOT_BITS, 1 << SLOT_BITS), dtype=np.int32)
    for r in slots:
        table[r["slot"]] = np.frombuffer(r["counts"], dtype=np.int32)
    sketch = spark.sparkContext.broadcast(table.tobytes())  # 16 MB at any input size
    total = profile.agg(F.sum("n")).first()[0] or 0
    blocks = max(shuffle_partitions(spark), total * (100 - percent) // 100 // ENTRIES_PER_BLOCK)
    entries = rows.mapInArrow(_prefixes(width, percent, sketch, blocks), "block int, ids binary, sizes binary, marks binary, hashes binary, lengths binary")
    packed = entries.groupBy("block").applyInArrow(_groups(percent, blocks), "slice int, hubs binary, docs binary")
    per_doc = materialize(packed.groupBy("slice").applyInArrow(_memberships, "doc long, hubs array<long>"), "hubs")
    # A hub that is itself in an older hub's group hands its whole group over to the oldest of those.
    heir = per_doc.filter(F.array_contains("hubs", F.col("doc"))).select(F.col("doc").alias("old"), F.array_min("hubs").alias("hub"))
    member = per_doc.select("doc", F.explode("hubs").alias("old")).join(heir, "old").select("hub", "doc").distinct()
    known = profile.filter("n > 0 and doc_id is not null")
    classes = known.groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last"))
    # whichever copy a task posted, the class's smallest id stands for it from here on
    posted = member.join(known, F.col("doc") == F.col("doc_id")).select("hub", "n", "s1", "s2")
    member = materialize(posted.join(classes, ["n", "s1", "s2"]).select("hub", F.col("rep").alias("doc")).distinct(), "groups")
    parts = member.groupBy("hub").agg(F.ceil(F.count("*") / block_docs).cast("int").alias("parts"))
    bitmaps = seen.filter("n > 0 and doc_id is not null").select(F.col("doc_id").alias("doc"), "n", "bits")
    mine = member.join(parts, "hub").join(bitmaps, "doc").withColumn("mine", F.pmod(F.xxhash64("doc"), F.col("parts")).cast("int"))
    single, small = F.col("parts") == 1, max(shuffle_partitions(spark), member.count() // GROUP_ROWS)
    tasks = mine.select("doc", "hub", "n", "bits", "mine", "parts", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    tasks = tasks.select(
        "doc", "hub", "n", "bits",
        F.when(single, F.pmod(F.xxhash64("hub"), F.lit(small))).otherwise(F.col("hub")).alias("task"),
        F.when(single, -1).otherwise(F.least("mine", "other")).alias("p"),
        F.when(single, -1).otherwise(F.greatest("mine", "other")).alias("q"),
    )
    tasks = tasks.groupBy("task", "p", "q").applyInArrow(_hopeful(percent), "doc long, hub long, task long, p int, q int").withColumn("t", F.struct("hub", "task", "p", "q"))
    tasks = tasks.groupBy("doc").agg(F.collect_set("t").alias("tasks"))
    tasks = materialize(tasks, "tasks")
    members = spark.sparkContext.broadcast(_member_bits(tasks.select("doc")))  # 8 MB at any input size
    packed = rows.select("doc_id", "text", _place("doc_id").alias("place")).mapInArrow(_pack(members), "doc_id long, packed binary")
    dealt = packed.join(tasks, packed["doc_id"] == tasks["doc"]).select("doc_id", F.explode("tasks").alias("t"), "packed").select("doc_id", "t.hub", "t.task", "t.p", "t.q", "packed")
    edges = dealt.groupBy("task", "p", "q").applyInArrow(_product(width, percent), "a long, b long")
    found = components(edges)
    # a repeated doc_id with several texts joins its classes
    twice = known.groupBy("doc_id").agg(F.min(F.struct("n", "s1", "s2")).alias("x"), F.max(F.struct("n", "s1", "s2")).alias("y")).filter("x <> y").limit(1)
    if twice.count():
        reps = known.join(classes, ["n", "s1", "s2"]).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
        found = components(edges.union(reps))
        by_doc = known.select("doc_id").distinct().join(found, F.col("doc_id") == F.col("node"), "left").select("doc_id", F.coalesce("component", "doc_id").alias("component_id"))
        return profile.join(by_doc, "doc_id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    named = classes.join(found, F.col("rep") == F.col("node"), "left").select("n", "s1", "s2", F.coalesce("component", "rep").alias("component_id"))
    return profile.join(named, ["n", "s1", "s2"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def op2_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
