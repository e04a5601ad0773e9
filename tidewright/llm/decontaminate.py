"""Benchmark decontamination: CGK embedding, bit-sampling LSH, exact edit verification.

1. Texts and items have A-Z lowered and white space turned to blanks.
2. The CGK random walk turns a string into a longer one whose Hamming distance to another's reflects
   their edit distance: at step j it emits the current byte and moves on by a random bit drawn for
   (j, byte).  A walk starts at every byte of a document and of an item.
3. Bit sampling: each of ``WALKS`` walks keeps a fixed random part of its steps; the first ``samples``
   of them are the key of a place in that walk's table.  A place of a document whose key is that of a
   place of an item votes for an item-sized window: (item, place in the document - place in the item).
4. A window with enough votes from all walks, in a band of neighbouring places, is a candidate.  Key
   length and votes needed come from the recall wanted (``plan``): for each class of item lengths,
   ``TARGET`` of simulated copies with random edits of ``max_percent`` of their bytes, embedded by the
   same walks, reach them.
5. The edit distance of the whole item to its best place in that window (with slack) is computed
   exactly by bit-parallel dynamic programming, and links of at most ``max_percent`` of the item's
   length stay.

Documents are read once for each block of at most ``BLOCK_BYTES`` of item texts.  Nulls: null or empty
texts link with nothing; rows with a null ``doc_id`` or ``item_id`` are left out.  In items of fewer than
``MIN_ITEM`` bytes an edit changes what is asked, so they are matched exactly: as whole words where
their script has spaces.  Repeated ids are told apart by nothing: their links merge.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import U64, words

MIN_ITEM = 24
MAX_PERCENT = 25
WALKS, SAMPLED = 2, 0.8
#: Key lengths to choose from, the votes a key length must leave, and the share of copies at the most edits that reach them.
SAMPLES, VOTES, TARGET, TRIALS = (5, 8, 11, 14, 17), 6, 0.985, 300
SLICE, PLACES = 1 << 20, 1 << 15
BLOCK_BYTES = 2 << 20
LANES, MOST_BLOCKS, HELD_BYTES = 8192, 16, 1 << 24
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[9, 10, 11, 12, 13]] = 32
_MULTIPLY = U64(0x9E3779B97F4A7C15)


def _walks(samples: int) -> list[tuple[np.ndarray, list[bool]]]:
    """For each walk a word for each byte (the byte, and above it a move for each step), and which steps are sampled."""
    out = []
    for w in range(WALKS):
        rng = np.random.default_rng([11, w])
        moves = rng.integers(0, 1 << 56, 256, dtype=np.uint64)
        steps = [True]
        while sum(steps) < samples:
            steps.append(bool(rng.random() < SAMPLED))
        if len(steps) > 56:
            raise ValueError("a walk has at most 56 steps")
        out.append((moves << U64(8) | np.arange(256, dtype=np.uint64), steps))
    return out


def keys(data: np.ndarray, places: int, walk: tuple[np.ndarray, list[bool]], wanted: set[int]):
    """(samples, key of each of the first ``places``) of one walk over ``data``, for each wanted number of samples.

    The end of ``data`` is followed by bytes 0.
    """
    words_of, steps = walk
    word = words_of[np.concatenate([data, np.zeros(max(0, places + len(steps) - len(data)), np.uint8)])]
    at, here, key, byte = np.arange(places), np.empty(places, np.uint64), np.zeros(places, np.uint64), np.empty(places, np.uint64)
    taken = 0
    for j, sampled in enumerate(steps):
        np.take(word, at, out=here, mode="clip")
        if sampled:
            np.bitwise_and(here, U64(255), out=byte)
            key ^= byte
            key *= _MULTIPLY
            taken += 1
            if taken in wanted:
                yield taken, key
        here >>= U64(8 + j)
        here &= U64(1)
        at += here.view(np.int64)


def best_distance(item: bytes, text: bytes) -> tuple[int, int]:
    """Least edit distance of ``item`` to any part of ``text`` and that part's end (Myers)."""
    m = len(item)
    peq: dict[int, int] = {}
    for i, c in enumerate(item):
        peq[c] = peq.get(c, 0) | 1 << i
    full, high = (1 << m) - 1, 1 << m - 1
    pv, mv, score, best, end = full, 0, m, m, 0
    for j, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = ((eq & pv) + pv ^ pv) | eq
        ph, mh = mv | ~(xh | pv) & full, pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph = ph << 1 & full
        mh = mh << 1 & full
        pv, mv = mh | ~(xv | ph) & full, ph & xv
        if score < best:
            best, end = score, j + 1
    return best, end


def _myers(items: list[bytes], which: np.ndarray, texts: list[bytes], blocks: int) -> np.ndarray:
    """``best_distance`` of many pairs at once, a pair a lane; items have ``blocks`` words of 64 rows."""
    own, local = np.unique(which, return_inverse=True)
    peq = np.zeros((blocks, len(own) * 257), dtype=np.uint64)
    for i, o in enumerate(own):
        row = np.arange(len(items[o]))
        np.bitwise_or.at(peq, (row // 64, i * 257 + np.frombuffer(items[o], np.uint8).astype(np.int64)), U64(1) << (row % 64).astype(np.uint64))
    # code 256 stands after a text's end; it matches nothing and so never lowers a distance
    code = np.full((max(map(len, texts)), len(texts)), 256, dtype=np.int64)
    for i, t in enumerate(texts):
        code[: len(t), i] = np.frombuffer(t, np.uint8)
    code += local * 257
    score = np.array([len(items[o]) for o in which])
    best, one = score.copy(), U64(1)
    tops = [U64(63)] * (blocks - 1) + [((score - 1) % 64).astype(np.uint64)]
    pv, mv = np.full((blocks, len(texts)), ~U64(0)), np.zeros((blocks, len(texts)), dtype=np.uint64)
    none = np.zeros(len(texts), dtype=np.uint64)
    for at in code:
        plus = minus = none
        for k, top in enumerate(tops):
            eq, p, m = peq[k][at], pv[k], mv[k]
            xv = eq | m
            eq |= minus
            xh = ((eq & p) + p ^ p) | eq
            ph, mh = m | ~(xh | p), p & xh
            up, down = ph << one | plus, mh << one | minus
            plus, minus = ph >> top & one, mh >> top & one
            pv[k], mv[k] = down | ~(xv | up), up & xv
        score += plus.astype(np.int64) - minus.astype(np.int64)
        np.minimum(best, score, out=best)
    return best


def distances(items: list[bytes], which: np.ndarray, texts: list[bytes]) -> np.ndarray:
    """Least edit distance of ``items[which[i]]`` to any part of ``texts[i]``."""
    out = np.zeros(len(texts), dtype=np.int64)
    blocks = np.array([-(-len(items[i]) // 64) for i in which], dtype=np.int64)
    for b in np.unique(blocks):
        part = np.flatnonzero(blocks == b)
        part = part[np.argsort([len(texts[i]) for i in part], kind="stable")]
        for lanes in np.split(part, range(max(1, LANES // b), len(part), max(1, LANES // b))):
            if b > MOST_BLOCKS:
                out[lanes] = [best_distance(items[which[i]], texts[i])[0] for i in lanes]
            else:
                out[lanes] = _myers(items, which[lanes], [texts[i] for i in lanes], int(b))
    return out


def band(m: int) -> int:
    """Half the width of a band of places."""
    return max(16, m // 16)


def _length_class(m: int) -> int:
    return min(m // 8 * 8 if m < 64 else m // 16 * 16 if m < 128 else m // 32 * 32, 512)


def _ranges(a: np.ndarray, count: np.ndarray) -> np.ndarray:
    return np.arange(count.sum()) + np.repeat(a - (np.cumsum(count) - count), count)


def _slot(key: np.ndarray, coarse: np.ndarray) -> np.ndarray:
    return (key >> U64(65 - len(coarse).bit_length())).astype(np.int64)


class Tables:
    """Hash tables of all places of items, a table for each walk and number of samples."""

    def __init__(self, items: list[bytes], samples: list[int]) -> None:
        self.sizes = np.array([len(t) for t in items], dtype=np.int64)
        self.half = np.array([band(m) for m in self.sizes], dtype=np.int64)
        self.longest = int(self.sizes.max(initial=1))
        self.wanted = set(samples)
        self.walks = _walks(max(self.wanted))
        self.tables: list[dict] = []
        for walk in self.walks:
            own: dict[int, list] = {k: [] for k in self.wanted}
            for i, t in enumerate(items):
                k = samples[i]
                found = next(key for _, key in keys(np.frombuffer(t, np.uint8), len(t), walk, {k}))
                own[k].append((found.copy(), np.full(len(t), i, np.int32), np.arange(len(t), dtype=np.int32)))
            self.tables.append({k: self._table(rows) for k, rows in own.items()})

    @staticmethod
    def _table(rows: list) -> tuple:
        key, owner, offset = (np.concatenate(c) for c in zip(*rows))
        order = np.argsort(key, kind="stable")
        distinct, first, count = np.unique(key[order], return_index=True, return_counts=True)
        coarse = np.zeros(1 << min(24, max(12, len(distinct).bit_length() + 4)), dtype=bool)
        coarse[_slot(distinct, coarse)] = True
        return distinct, first.astype(np.int32), count.astype(np.int32), owner[order], offset[order], coarse

    def hits(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in ``data``, item, place of the item's start) of every equal key."""
        out = [(np.empty(0, np.int64),) * 3]
        for lo in range(0, len(data), PLACES):
            part, n = data[lo : lo + PLACES + 56], min(PLACES, len(data) - lo)
            for walk, tables in zip(self.walks, self.tables):
                for k, key in keys(part, n, walk, self.wanted):
                    distinct, first, count, owner, offset, coarse = tables[k]
                    at = np.flatnonzero(coarse[_slot(key, coarse)])
                    place = np.searchsorted(distinct, key[at]).clip(max=len(distinct) - 1)
                    good = distinct[place] == key[at]
                    at, place = at[good], place[good]
                    entry = _ranges(first[place].astype(np.int64), count[place].astype(np.int64))
                    x = np.repeat(at, count[place]) + lo
                    out.append((x, owner[entry].astype(np.int64), x - offset[entry]))
        return tuple(np.concatenate(c) for c in zip(*out))

    def votes(self, item: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bands, band of each hit, votes of each band with the better of its neighbours)."""
        bins, which, votes = np.unique(item * (1 << 36) + (start + (1 << 34)) // self.half[item], return_inverse=True, return_counts=True)
        return bins, which, _with_neighbours(bins, votes)


def _with_neighbours(bins: np.ndarray, votes: np.ndarray) -> np.ndarray:
    next_to = np.diff(bins) == 1
    both = votes.copy()
    both[:-1] = np.maximum(both[:-1], votes[:-1] + np.where(next_to, votes[1:], 0))
    both[1:] = np.maximum(both[1:], votes[1:] + np.where(next_to, votes[:-1], 0))
    return both


def damaged(rng: np.random.Generator, item: bytes, edits: int) -> bytes:
    """A copy with so many random insertions, deletions and replacements."""
    copy = bytearray(item)
    for kind in rng.integers(0, 3, edits):
        at = int(rng.integers(0, len(copy) + 1))
        copy[at : at + (kind != 1)] = [int(rng.integers(97, 123))] if kind != 2 else []
    return bytes(copy)


def plan(items: list[bytes], percent: int, target: float = TARGET) -> tuple[int, int]:
    """(samples of a key, votes needed) for items of one length class.

    Copies are damaged at ``percent`` and embedded like documents; of the key lengths at which ``target`` of them
    reach ``VOTES`` votes in one band the longest is taken, as it meets least by chance, or else the shortest.
    """
    rng = np.random.default_rng([13, len(items[0])])
    own = [items[i] for i in rng.permutation(len(items))[:TRIALS]]
    reached = {k: [] for k in SAMPLES}
    walks = _walks(max(SAMPLES))
    known = [[dict((k, key.copy()) for k, key in keys(np.frombuffer(t, np.uint8), len(t), walk, set(SAMPLES))) for walk in walks] for t in own]
    for n in range(TRIALS):
        item, half = own[n % len(own)], band(len(own[n % len(own)]))
        copy = np.frombuffer(damaged(rng, item, len(item) * percent // 100), np.uint8)
        shift = int(rng.integers(0, 1 << 20))  # bands lie anywhere in a document
        bands: dict[int, list] = {k: [] for k in SAMPLES}
        for w, walk in enumerate(walks):
            for k, key in keys(copy, len(copy), walk, set(SAMPLES)):
                x, i = np.nonzero(key[:, None] == known[n % len(own)][w][k][None, :])
                bands[k].append((x - i + shift) // half)
        for k, found in bands.items():
            bins, votes = np.unique(np.concatenate(found), return_counts=True)
            reached[k].append(int(_with_neighbours(bins, votes).max(initial=0)))
    votes = {k: int(np.quantile(r, 1 - target, method="lower")) for k, r in reached.items()}
    best = max((k for k in SAMPLES if votes[k] >= VOTES), default=min(SAMPLES))
    return best, max(1, votes[best])


_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u2e80-\ua4cf\uac00-\ud7ff\uf900-\ufaff\U00020000-\U0003ffff]")


def exact_pattern(item: str) -> re.Pattern:
    """Where a short item stands: as whole words, but anywhere in scripts without spaces."""
    edge = lambda c, side: side if re.match(r"\w", c) and not _UNSPACED.match(c) else ""
    return re.compile(edge(item[0], r"(?<!\w)") + re.escape(item) + edge(item[-1], r"(?!\w)"))


class ItemIndex:
    """Items of fewer than ``MIN_ITEM`` bytes as patterns, all others in hash tables with the votes that each needs."""

    def __init__(self, items: list[tuple[int, str]], max_percent: int = MAX_PERCENT) -> None:
        self.items: list[tuple[int, bytes]] = []
        self.exact: list[tuple[int, bytes, re.Pattern]] = []
        for w in words(pa.array([t for _, t in items], pa.string()), lower=True, limit=1 << 40):
            data = _FOLD[w.data]
            for i in range(w.hi - w.lo):
                lo, hi = int(w.first[i]), int(w.first[i + 1])
                if hi > lo:
                    text, name = data[int(w.starts[lo]) : int(w.ends[hi - 1])].tobytes(), items[w.lo + i][0]
                    if len(text) < MIN_ITEM:
                        self.exact.append((name, text, exact_pattern(text.decode())))
                    else:
                        self.items.append((name, text))
        self.tables = None
        if self.items:
            texts = [t for _, t in self.items]
            classes = [_length_class(len(t)) for t in texts]
            plans = {c: plan([t for t, k in zip(texts, classes) if k == c], max_percent) for c in sorted(set(classes))}
            self.tables = Tables(texts, [plans[c][0] for c in classes])
            self.need = np.array([plans[c][1] for c in classes], dtype=np.int64)

    def candidates(self, w):
        """(folded text, (document in ``w``, item, where the item should start) without repeats)."""
        data = _FOLD[w.data]
        full = np.flatnonzero(np.diff(w.first) > 0)
        found = []
        if self.tables and len(full):
            begin = w.starts[w.first[full]]
            for lo in range(0, len(data), SLICE):
                base = max(0, lo - 2 * self.tables.longest)
                x, item, start = self.tables.hits(data[base : lo + SLICE])
                if not len(x):
                    continue
                bins, which, votes = self.tables.votes(item, start)
                enough = np.flatnonzero((votes >= self.need[bins >> 36])[which])
                doc = np.searchsorted(begin, x[enough] + base, side="right") - 1
                order = np.lexsort((which[enough], doc))
                doc, own, start = doc[order], which[enough][order], start[enough][order] + base
                if not len(doc):
                    continue
                first = np.flatnonzero(np.concatenate([[True], (np.diff(doc) != 0) | (np.diff(own) != 0)]))
                middle = np.add.reduceat(start, first) // np.diff(np.append(first, len(start)))
                kept = doc[first] >= 0
                found.append(np.stack([full[doc[first][kept]], bins[own[first][kept]] >> 36, middle[kept]], axis=1))
        return data, np.unique(np.concatenate(found), axis=0) if found else np.empty((0, 3), np.int64)


def _links(index, max_percent: int):
    def run(batches):
        ix, waiting, held = index.value, [], 0
        texts = [t for _, t in ix.items]

        def verify():
            ids, which, parts = zip(*waiting)
            waiting.clear()
            distance = distances(texts, np.array(which), list(parts))
            near = [i for i, d in enumerate(distance.tolist()) if 100 * d <= max_percent * len(texts[which[i]])]
            rows = [(ids[i], ix.items[which[i]][0], int(distance[i]), len(texts[which[i]])) for i in near]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["doc_id", "item_id", "distance", "item_chars"])

        def short(ids, w, data):
            rows = []
            for i in np.flatnonzero(np.diff(w.first) > 0).tolist():
                raw = data[w.starts[w.first[i]] : w.ends[w.first[i + 1] - 1]].tobytes()
                text = raw.decode()
                rows += [(ids[w.lo + i], item, 0, len(t)) for item, t, pattern in ix.exact if t in raw and pattern.search(text)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["doc_id", "item_id", "distance", "item_chars"])

        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for w in words(batch.column("text"), lower=True):
                data, found = ix.candidates(w)
                if ix.exact:
                    yield from short(ids, w, data)
                reach: dict[tuple[int, int], int] = {}
                for doc, item, start in found.tolist():
                    slack, key = len(texts[item]) * max_percent // 100, (doc, item)
                    if start <= reach.get(key, start - 1):
                        continue  # within the slack of a place already tried
                    lo, hi = int(w.starts[w.first[doc]]), int(w.ends[w.first[doc + 1] - 1])
                    a, z = max(lo, start - slack), min(hi, start + len(texts[item]) + 2 * slack)
                    reach[key] = start + slack // 2
                    if ids[w.lo + doc] is not None and a < z:
                        waiting.append((ids[w.lo + doc], item, data[a:z].tobytes()))
                        held += int(z - a)
                    if len(waiting) >= LANES or held >= HELD_BYTES:
                        yield from verify()
                        held = 0
        if waiting:
            yield from verify()

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, max_percent: int = MAX_PERCENT, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, distance, item_chars) for each document that holds an item, once a pair."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null and text is not null")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("item_id is not null and text is not null")
    shape = "doc_id long, item_id long, distance long, item_chars long"
    blocks = max(1, -(-(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block_bytes))
    out = None
    for b in range(blocks):
        own = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).distinct().collect()
        index = ItemIndex(sorted((r["item_id"], r["text"]) for r in own), max_percent)
        if index.items or index.exact:
            part = rows.mapInArrow(_links(spark.sparkContext.broadcast(index), max_percent), shape)
            out = part if out is None else out.union(part)
    if out is None:
        return spark.createDataFrame([], shape)
    return out.groupBy("doc_id", "item_id").agg(F.min("distance").alias("distance"), F.max("item_chars").alias("item_chars"))


def op6_decontaminate(spark, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
