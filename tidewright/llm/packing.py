"""Packing of token streams into fixed windows by best-fit decreasing.

A document's ids and one separator are cut into full windows and a rest.  Rests are dealt to groups
of bounded size by a hash of their place in the table of pieces; each group is packed longest first, a segment tree over remaining
capacities giving the open window that fits most tightly.  Only ids' checksums travel, not the ids.

Nulls: a null text is empty (one separator); a null ``doc_id`` is carried through.  Rows that repeat
a ``doc_id`` are packed each on its own.  Equal lengths go in order of (doc_id, start).
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .encode import encoder
from .store import materialize

CAPACITY = 4096
SEPARATOR = 2
GROUP_PIECES = 100_000


class CapacityTree:
    """Segment tree over capacities 0 to ``capacity``: how many open windows have that much room."""

    def __init__(self, capacity: int) -> None:
        self.leaves = 1
        while self.leaves <= capacity:
            self.leaves *= 2
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _add(self, room: int, by: int) -> None:
        i = room + self.leaves
        while i:
            self.count[i] += by
            i >>= 1

    def push(self, room: int, window: int) -> None:
        self.open[room].append(window)
        self._add(room, 1)

    def pop_tightest(self, need: int) -> tuple[int, int] | None:
        """Take the window with the least room of at least ``need``: (room, window)."""
        i = need + self.leaves
        while not self.count[i]:
            while i & 1:  # a right child: nothing further right below this parent
                i >>= 1
            if i == 0:
                return None
            i += 1
        while i < self.leaves:
            i = 2 * i if self.count[2 * i] else 2 * i + 1
        room = i - self.leaves
        self._add(room, -1)
        return room, self.open[room].pop()


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Window and offset of every piece, given in descending order of length."""
    tree, windows = CapacityTree(capacity), 0
    window, offset = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64)
    for i, n in enumerate(lengths.tolist()):
        found = tree.pop_tightest(n)
        room, w = found if found else (capacity, windows)
        windows += found is None
        window[i], offset[i] = w, capacity - room
        if room > n:
            tree.push(room - n, w)
    return window, offset


def _cut(path: str, capacity: int, separator: int):
    def run(batches):
        model = encoder(path)
        for batch in batches:
            owner, start, length, crc, total = [], [], [], [], []
            for i, ids in model.documents(batch.column("text")):
                ids = np.append(ids, separator).astype("<u4")
                raw = ids.tobytes()
                for s in range(0, len(ids), capacity):
                    owner.append(i)
                    start.append(s)
                    length.append(min(capacity, len(ids) - s))
                    crc.append(zlib.crc32(raw[4 * s : 4 * (s + capacity)]))
                    total.append(len(ids))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(owner, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return run


def _pack(groups: int, capacity: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending")])
        window, offset = best_fit_decreasing(table.column("length").to_numpy(), capacity)
        group = table.column("part")[0].as_py()
        out = table.drop_columns(["part"])
        return out.append_column("sequence_id", pa.array(window * groups + group)).append_column("offset", pa.array(offset))

    return run


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, separator: int = SEPARATOR, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) for each piece of ``docs``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    shape = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
    pieces = materialize(rows.mapInArrow(_cut(tokenizer, capacity, separator), shape), "pieces")
    groups = max(1, -(-pieces.count() // group_pieces))
    # pieces are fixed in a table, so their places in it deal them evenly, however many rows are equal
    place = F.monotonically_increasing_id() if groups > 1 else F.lit(0)
    dealt = pieces.withColumn("part", F.pmod(F.xxhash64(place), F.lit(groups)))
    return dealt.groupBy("part").applyInArrow(_pack(groups, capacity), f"{shape}, sequence_id long, offset long")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op10_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary())
