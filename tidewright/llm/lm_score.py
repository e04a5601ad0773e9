"""Language-model scoring from a log-frequency Bloom filter of bigram counts.

1. Texts are tokenised once into a table of chunks (distinct word hashes, token codes, counts in
   training documents), written to the shared folder.
2. Word counts: chunks send each hash block their distinct words with counts; the block answers with
   the totals over all training documents.  These are exact.
3. Bigram counts are summed over all training documents by hash block and quantised to levels of
   powers of two.  A bigram of level q is put into its block's segment of the filter q times, once
   for each level, so its level is found by probing for 1, 2, ... until one is missing.
4. A filter of at most ``broadcast_bytes`` is broadcast to the workers, who probe it for the bigrams of
   their texts.  A larger one stays where it was built: each chunk sends its distinct bigrams to the
   segments, by block, which are probed there and answer with the levels.  Either way the texts are
   read once and the chunks a fixed number of times, and the scores are the same.

p(w | v) = (f(v, w) + mu * p1(w)) / (c(v) + mu), with f the lower end of the bigram's level (so that
the counts of one context don't exceed c(v), but for false positives), c(v) exact, and
p1(w) = (c(w) + 0.5) / (N + 0.5 (V + 1)).  A document starts in the context of an end.  As f is at most
the true count, the probabilities of a context sum to at most 1: what quantising takes is not dealt out again.

Nulls: a null text is empty and has one token, its end.  A null ``doc_id`` counts as training, its
checksum being that of an empty string.  Rows that repeat a ``doc_id`` are scored each on its own.
Without training documents all counts are 0.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import materialize, shuffle_partitions
from .tokens import U64, mix, words

MU = 30.0
PROBES, BITS_PER_ENTRY = 5, 10
TEXT_CHUNK = 1 << 20
BLOCK_ENTRIES = 4_000_000
BROADCAST_BYTES = 128 << 20
END = U64(0xE2D0E2D0E2D0E2D1)
_LEFT, _RIGHT = U64(0x9FB21C651E98DF25), U64(0xD6E8FEB86659FD93)


def held_out(doc_id: int | None, fold: int, folds: int) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % folds == fold


def _squeeze(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(a.tobytes())


def _open(blob, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype=kind)


def _chunks(fold: int, folds: int):
    def run(batches):
        number = 0
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for w in words(batch.column("text"), lower=True, limit=TEXT_CHUNK):
                docs = w.hi - w.lo
                first = w.first + np.arange(docs + 1)
                tokens = np.full(first[-1], END, dtype=np.uint64)
                is_word = np.ones(first[-1], dtype=bool)
                is_word[first[1:] - 1] = False
                tokens[is_word] = w.hashes
                distinct, code = np.unique(tokens, return_inverse=True)
                held = [held_out(i, fold, folds) for i in ids[w.lo : w.hi]]
                train = np.repeat(~np.array(held), np.diff(first))
                count = np.bincount(code[train], minlength=len(distinct))
                chunk = (TaskContext.get().partitionId() << 32) + number
                number += 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array([chunk]), pa.array([ids[w.lo : w.hi]], pa.list_(pa.int64())), pa.array([held], pa.list_(pa.bool_())), *(pa.array([_squeeze(x)], pa.binary()) for x in (first, code.astype(np.int32), distinct, count.astype(np.int32)))],
                    ["chunk", "ids", "held", "first", "code", "distinct", "train"],
                )

    return run


def _block_of(hashes: np.ndarray, blocks: int) -> np.ndarray:
    """Blocks are ranges of the hash, so sorted hashes fall into runs."""
    return ((hashes >> U64(32)) * U64(blocks) >> U64(32)).astype(np.int64)


def _slices(sorted_hashes: np.ndarray, blocks: int):
    edges = np.searchsorted(_block_of(sorted_hashes, blocks), np.arange(blocks + 1))
    return [(b, edges[b], edges[b + 1]) for b in range(blocks) if edges[b + 1] > edges[b]]


def _ask(blocks: int):
    def run(batches):
        for batch in batches:
            for chunk, distinct, train in zip(*(batch.column(c) for c in ("chunk", "distinct", "train"))):
                h, n = _open(distinct.as_buffer(), np.uint64), _open(train.as_buffer(), np.int32)
                rows = [(chunk.as_py(), b, h[lo:hi].tobytes(), _squeeze(n[lo:hi])) for b, lo, hi in _slices(h, blocks)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64(), pa.int32(), pa.binary(), pa.binary()])], ["chunk", "block", "hashes", "counts"])

    return run


def _answer(table: pa.Table) -> pa.Table:
    parts = [np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in table.column("hashes")]
    counts = np.concatenate([_open(x.as_buffer(), np.int32) for x in table.column("counts")]).astype(np.int64)
    distinct, code = np.unique(np.concatenate(parts), return_inverse=True)
    total = np.zeros(len(distinct), dtype=np.int64)
    np.add.at(total, code, counts)
    answers, at = [], 0
    for p in parts:
        answers.append(_squeeze(total[code[at : at + len(p)]]))
        at += len(p)
    block = table.column("block")[0].as_py()
    m = len(parts)
    return pa.table(
        {
            "chunk": pa.array([*table.column("chunk").to_pylist(), -1], pa.int64()),
            "block": pa.array([block] * (m + 1), pa.int32()),
            "totals": pa.array([*answers, b""], pa.binary()),
            "tokens": pa.array([0] * m + [int(total.sum())], pa.int64()),
            "types": pa.array([0] * m + [int((total > 0).sum())], pa.int64()),
        }
    )


def bigrams(tokens: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Hash of each token with the one before it; a document's first follows an end."""
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]  # the token before a document's first is the last one's end
    before[:1] = END
    return mix(mix(before * _LEFT) + tokens * _RIGHT)


def _pairs(blocks: int):
    def run(batches):
        for batch in batches:
            for held, first, code, distinct in zip(*(batch.column(c) for c in ("held", "first", "code", "distinct"))):
                first, code, distinct = _open(first.as_buffer(), np.int64), _open(code.as_buffer(), np.int32), _open(distinct.as_buffer(), np.uint64)
                train = np.repeat(~np.array(held.as_py(), dtype=bool), np.diff(first))
                keys, counts = np.unique(bigrams(distinct[code], first)[train], return_counts=True)
                rows = [(b, keys[lo:hi].astype(np.uint32).tobytes(), _squeeze(counts[lo:hi].astype(np.int32))) for b, lo, hi in _slices(keys, blocks)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [pa.int32(), pa.binary(), pa.binary()])], ["block", "keys", "counts"])

    return run


def _position(h: np.ndarray, i: int, bits: int) -> np.ndarray:
    return (((h & U64(0xFFFFFFFF)) + U64(i) * ((h >> U64(32)) | U64(1))) % U64(bits)).astype(np.int64)


def build_segment(keys: np.ndarray, counts: np.ndarray) -> tuple[bytes, int]:
    """Bit array of one block: (bits, number of bits)."""
    level = np.floor(np.log2(counts)).astype(np.int64) + 1
    bits = max(64, -(-int(level.sum()) * BITS_PER_ENTRY // 8) * 8)
    flags = np.zeros(bits, dtype=bool)
    for q in range(1, int(level.max(initial=0)) + 1):
        h = mix(keys[level >= q].astype(np.uint64) + (U64(q) << U64(33)) + U64(0x1B873593))
        for i in range(PROBES):
            flags[_position(h, i, bits)] = True
    return np.packbits(flags, bitorder="little").tobytes(), bits


def probe_levels(segment: np.ndarray, bits: int, keys: np.ndarray) -> np.ndarray:
    """Level of each key: how many of 1, 2, ... are found before the first that is missing."""
    level = np.zeros(len(keys), dtype=np.int64)
    live, q = np.arange(len(keys)), 1
    while len(live):
        h = mix(keys.astype(np.uint64) + (U64(q) << U64(33)) + U64(0x1B873593))
        for i in range(PROBES):
            at = _position(h, i, bits)
            hit = (segment[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
            live, keys, h = live[hit], keys[hit], h[hit]
        level[live] = q
        q += 1
    return level


def _count(table: pa.Table) -> pa.Table:
    keys = np.concatenate([np.frombuffer(x.as_buffer(), dtype=np.uint32) for x in table.column("keys")])
    counts = np.concatenate([_open(x.as_buffer(), np.int32) for x in table.column("counts")])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order].astype(np.int64)
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    segment, bits = build_segment(keys[at], np.add.reduceat(counts, at))
    return pa.table({"block": table.column("block")[:1], "segment": pa.array([segment], pa.binary()), "bits": pa.array([bits], pa.int64())})


def _ask_levels(blocks: int):
    """Distinct bigrams of each chunk, by the block of the filter that knows them."""

    def run(batches):
        for batch in batches:
            for chunk, first, code, distinct in zip(*(batch.column(c) for c in ("chunk", "first", "code", "distinct"))):
                first, code, distinct = _open(first.as_buffer(), np.int64), _open(code.as_buffer(), np.int32), _open(distinct.as_buffer(), np.uint64)
                keys = np.unique(bigrams(distinct[code], first))
                rows = [(chunk.as_py(), b, keys[lo:hi].astype(np.uint32).tobytes()) for b, lo, hi in _slices(keys, blocks)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64(), pa.int32(), pa.binary()])], ["chunk", "block", "keys"])

    return run


def _levels(asked: pa.Table, segments: pa.Table) -> pa.Table:
    """Levels of all bigrams asked of one block; 0 where the block has no training bigram."""
    out = []
    held = (np.frombuffer(segments.column("segment")[0].as_buffer(), dtype=np.uint8), segments.column("bits")[0].as_py()) if segments.num_rows else None
    for x in asked.column("keys"):
        keys = np.frombuffer(x.as_buffer(), dtype=np.uint32)
        out.append(_squeeze((probe_levels(*held, keys) if held else np.zeros(len(keys))).astype(np.int8)))
    return pa.table({"chunk": asked.column("chunk"), "block": asked.column("block"), "levels": pa.array(out, pa.binary())})


def _score(segments, blocks: int, total: int, types: int, mu: float):
    """Scores of chunks, from broadcast segments or, without them, from the levels that came with each chunk."""

    def run(batches):
        held = segments.value if segments else None
        for batch in batches:
            for i in range(batch.num_rows):
                cell = lambda c, i=i, batch=batch: batch.column(c)[i]
                chunk, ids = cell("chunk").as_py(), cell("ids").as_py()
                first, code, distinct = (_open(cell(c).as_buffer(), t) for c, t in (("first", np.int64), ("code", np.int32), ("distinct", np.uint64)))
                count = np.concatenate([_open(t, np.int64) for _, t in sorted((a["block"], a["totals"]) for a in cell("answers").as_py())])
                p1 = (count + 0.5) / (total + 0.5 * (types + 1))
                keys, back = np.unique(bigrams(distinct[code], first), return_inverse=True)
                if held is None:
                    level = np.concatenate([_open(t, np.int8) for _, t in sorted((a["block"], a["levels"]) for a in cell("levels").as_py())]).astype(np.int64)
                else:
                    level = np.zeros(len(keys), dtype=np.int64)
                    for b, lo, hi in _slices(keys, blocks):
                        if b in held:  # others have no training bigram
                            bits, segment = held[b]
                            level[lo:hi] = probe_levels(np.frombuffer(segment, dtype=np.uint8), bits, keys[lo:hi].astype(np.uint32))
                level = level[back]
                seen = np.where(level > 0, np.exp2(level - 1.0), 0.0)
                context = np.empty(len(code), dtype=np.float64)
                context[1:] = count[code[:-1]]
                context[:1] = count[np.searchsorted(distinct, END)]
                log_p = np.log10((seen + mu * p1[code]) / (context + mu))
                known = np.add.reduceat((count[code] > 0).astype(np.int64), first[:-1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), cell("held").values, pa.array(np.diff(first)), pa.array(known), pa.array(np.add.reduceat(np.log10(p1[code]), first[:-1])), pa.array(np.add.reduceat(log_p, first[:-1]))],
                    ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"],
                )

    return run


def score(docs: DataFrame, fold: int = 1, folds: int = 5, mu: float = MU, block_entries: int = BLOCK_ENTRIES, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Scores of all texts of ``docs`` (doc_id, text, ...), learned from all but fold ``fold``."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    chunks = materialize(rows.mapInArrow(_chunks(fold, folds), "chunk long, ids array<long>, held array<boolean>, first binary, code binary, distinct binary, train binary"), "chunks")
    size = chunks.agg(F.sum(F.expr("octet_length(code)"))).first()[0] or 0  # 2 to 3 bytes a token
    blocks = int(max(shuffle_partitions(spark), size // block_entries))
    answers = chunks.select("chunk", "distinct", "train").mapInArrow(_ask(blocks), "chunk long, block int, hashes binary, counts binary")
    answers = materialize(answers.groupBy("block").applyInArrow(_answer, "chunk long, block int, totals binary, tokens long, types long"), "answers")
    total, types = (x or 0 for x in answers.filter("chunk = -1").agg(F.sum("tokens"), F.sum("types")).first())
    pairs = chunks.select("held", "first", "code", "distinct").mapInArrow(_pairs(blocks), "block int, keys binary, counts binary")
    segments = materialize(pairs.groupBy("block").applyInArrow(_count, "block int, segment binary, bits long"), "segments")
    asked = answers.filter("chunk >= 0").groupBy("chunk").agg(F.collect_list(F.struct("block", "totals")).alias("answers"))
    ready, held = chunks.select("chunk", "ids", "held", "first", "code", "distinct").join(asked, "chunk"), None
    if (segments.agg(F.sum("bits")).first()[0] or 0) <= 8 * broadcast_bytes:
        held = spark.sparkContext.broadcast({r["block"]: (r["bits"], bytes(r["segment"])) for r in segments.collect()})  # at most broadcast_bytes
    else:
        wanted = chunks.select("chunk", "first", "code", "distinct").mapInArrow(_ask_levels(blocks), "chunk long, block int, keys binary")
        found = materialize(wanted.groupBy("block").cogroup(segments.groupBy("block")).applyInArrow(_levels, "chunk long, block int, levels binary"), "levels")
        ready = ready.join(found.groupBy("chunk").agg(F.collect_list(F.struct("block", "levels")).alias("levels")), "chunk")
    scored = ready.mapInArrow(_score(held, blocks, total, types, mu), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


def op1_lm_score(spark, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
