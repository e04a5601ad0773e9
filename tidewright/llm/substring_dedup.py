"""Removal of repeated word spans by matching statistics against suffix automata.

1. Winnowed anchors (25-word hashes, the smallest of every 26 in a row) are kept for each document:
   any 50-word window holds an anchor chosen from its own words alone, so two documents that share
   a window share an anchor.  Documents with equal word sequences form one class, stood for by the
   smallest id; the others of 50 words or more lose everything.
2. Anchors met in several documents name families (the smallest document with the anchor); each
   document sends a family only the words around its anchors.
3. A family's reference automaton is built in ascending document order: each document is first
   streamed through the automaton of the smaller ids (matching statistics; every position that ends
   a match of 50 words or more marks them), then only its unmatched windows are inserted.  Large
   families are cut into shards of bounded words; every pair of shards meets in some task.
4. The maximal spans are joined back and the rest of the words hashed.

The automata go to the tasks whose documents share an anchor with them instead of to every worker,
as their total size grows with the corpus.

Nulls: a null text has no words.  A row with a null ``doc_id`` is neither cut nor a reference.
Rows with equal ``doc_id`` don't count as smaller than each other.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ngram_join import Seen
from .store import materialize, shuffle_partitions
from .tokens import U64, _power_table, mix, words

WINDOW, ANCHOR = 50, 25
SHARD_WORDS = 200_000
BUCKET_WORDS = 1_000_000
ENTRIES_PER_BLOCK = 1_000_000
_STEP = 0xC2B2AE3D27D4EB4F | 1
_BACK = pow(_STEP, -1, 1 << 64)
KEY = ["doc_id", "n", "s1", "s2"]


class SuffixAutomaton:
    """Suffix automaton of a set of sequences of integers, inserted one at a time."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]

    def _clone(self, p: int, c: int, q: int) -> int:
        new = len(self.next)
        self.next.append(self.next[q].copy())
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        self.link[q] = new
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        return new

    def insert(self, sequence) -> None:
        nxt, link, length, last = self.next, self.link, self.length, 0
        for c in sequence:
            q = nxt[last].get(c)
            if q is not None:
                last = q if length[q] == length[last] + 1 else self._clone(last, c, q)
                continue
            new, p = len(nxt), last
            nxt.append({})
            length.append(length[last] + 1)
            link.append(0)
            while p >= 0 and c not in nxt[p]:
                nxt[p][c] = new
                p = link[p]
            if p >= 0:
                q = nxt[p][c]
                link[new] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
            last = new

    def matching_statistics(self, sequence) -> list[int]:
        """For each position, the length of the longest match that ends there."""
        nxt, link, length, state, size, out = self.next, self.link, self.length, 0, 0, []
        for c in sequence:
            to = nxt[state].get(c)
            while to is None and state:
                state = link[state]
                size = length[state]
                to = nxt[state].get(c)
            if to is None:
                size = 0
            else:
                state, size = to, size + 1
            out.append(size)
        return out


def rolling(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` tokens, whatever documents they lie in."""
    n = len(hashes)
    if n < width:
        return np.empty(0, dtype=np.uint64)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(hashes * _power_table(_STEP, n)[:n], out=sums[1:])
    return mix((sums[width:] - sums[:-width]) * _power_table(_BACK, n)[: n - width + 1])


def anchors(hashes: np.ndarray, window: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of one document's winnowed anchors; none for fewer than ``window`` words."""
    if len(hashes) < window:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)
    h = rolling(hashes, width)
    span = window - width + 1
    at = np.unique(np.arange(len(h) - span + 1) + np.lib.stride_tricks.sliding_window_view(h, span).argmin(axis=1))
    return at, h[at]


def _signature(h: np.ndarray) -> tuple[int, int]:
    place = mix(np.arange(1, len(h) + 1, dtype=np.uint64) * U64(_STEP))
    return int(np.add.reduce(mix(h ^ place)).view(np.int64)), int(np.add.reduce(mix(h + place)).view(np.int64))


def _documents(column: pa.Array):
    for w in words(column, lower=False):
        for i in range(w.hi - w.lo):
            yield w.lo + i, w.hashes[w.first[i] : w.first[i + 1]]


def _profile(batches):
    for batch in batches:
        n, a, b = (np.zeros(batch.num_rows, dtype=np.int64) for _ in range(3))
        sha = []
        for (i, h), text in zip(_documents(batch.column("text")), batch.column("text").cast(pa.large_binary())):
            n[i] = len(h)
            a[i], b[i] = _signature(h)
            sha.append(hashlib.sha256(b" ".join(bytes(text.as_buffer()).split()) if text.is_valid else b"").hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), pa.array(a), pa.array(b), pa.array(sha, pa.string())], [*KEY, "sha"])


def _entries(window: int, width: int, blocks: int):
    def run(batches):
        seen = Seen()
        for batch in batches:
            ids, valid = batch.column("doc_id").fill_null(0).to_numpy(), batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
            s1, s2, n = (np.zeros(len(ids), np.int64) for _ in range(3))
            hashes, owners = [], []
            for i, h in _documents(batch.column("text")):
                s1[i], s2[i] = _signature(h)
                n[i] = len(h)
                # each task posts a word sequence once, whatever its copies
                found = np.unique(anchors(h, window, width)[1]) if valid[i] and len(h) >= window and seen.add((len(h), s1[i], s2[i])) else ()
                if len(found):
                    hashes.append(found)
                    owners.append(np.full(len(found), i, dtype=np.int32))
            if not hashes:
                continue
            h, o = np.concatenate(hashes), np.concatenate(owners)
            block = ((h >> U64(32)) % U64(blocks)).astype(np.int32)
            order = np.argsort(block, kind="stable")
            h, o, block = h[order], o[order], block[order]
            at = np.flatnonzero(np.diff(block, prepend=-1))
            rows = []
            for lo, hi in zip(at, [*at[1:], len(block)]):
                own, local = np.unique(o[lo:hi], return_inverse=True)
                head = np.stack([ids[own], n[own], s1[own], s2[own]], axis=1)
                rows.append((int(block[lo]), head.tobytes(), h[lo:hi].tobytes(), local.astype(np.int32).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [pa.int32()] + [pa.binary()] * 3)], ["block", "heads", "hashes", "local"])

    return run


def _families(table: pa.Table) -> pa.Table:
    """Anchors met in several different documents, with the smallest of them as the family's name."""
    heads = [np.frombuffer(x.as_buffer(), dtype=np.int64).reshape(-1, 4) for x in table.column("heads")]
    base = np.concatenate([[0], np.cumsum([len(x) for x in heads])])[:-1]
    head = np.concatenate(heads)
    h = np.concatenate([np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in table.column("hashes")])
    own = np.concatenate([np.frombuffer(x.as_buffer(), dtype=np.int32) + b for x, b in zip(table.column("local"), base)])
    order = np.argsort(h, kind="stable")
    h, own = h[order], own[order]
    same = h[1:] == h[:-1]
    repeat = np.concatenate([same, [False]]) | np.concatenate([[False], same])
    h, own = h[repeat], own[repeat]
    order = np.lexsort((head[own, 0], head[own, 3], head[own, 2], h))
    h, own = h[order], own[order]
    fresh = np.ones(len(h), dtype=bool)
    fresh[1:] = (h[1:] != h[:-1]) | (head[own[1:], 2:] != head[own[:-1], 2:]).any(axis=1)
    h, own = h[fresh], own[fresh]
    cut = np.ones(len(h), dtype=bool)
    cut[1:] = h[1:] != h[:-1]
    at = np.flatnonzero(cut)
    length = np.diff(np.append(at, len(h)))
    hub = np.repeat(np.minimum.reduceat(head[own, 0], at), length) if len(at) else np.empty(0, np.int64)
    many = np.repeat(length, length) > 1
    rows = head[own[many]]
    return pa.table({"doc_id": rows[:, 0], "n": rows[:, 1], "s1": rows[:, 2], "s2": rows[:, 3], "anchor": h[many].view(np.int64), "hub": hub[many]})


def _regions(window: int, width: int):
    """For each document and family, the words around its anchors: starts, lengths and word hashes."""

    def run(batches):
        for batch in batches:
            keys = [batch.column(c).to_numpy() for c in KEY]
            rows = []
            hits = batch.column("hits")
            offsets = hits.offsets.to_numpy()
            hit_anchor, hit_hub = (hits.values.field(c).to_numpy() for c in ("anchor", "hub"))
            for i, h in _documents(batch.column("text")):
                if (len(h), *_signature(h)) != tuple(int(k[i]) for k in keys[1:]):
                    continue  # another row of the same doc_id
                at, hashes = anchors(h, window, width)
                known, hubs = hit_anchor[offsets[i] : offsets[i + 1]], hit_hub[offsets[i] : offsets[i + 1]]
                order = np.argsort(known)
                known, hubs = known[order], hubs[order]
                place = np.searchsorted(known, hashes.view(np.int64)).clip(max=len(known) - 1)
                hit = known[place] == hashes.view(np.int64)
                at, hub = at[hit], hubs[place[hit]]
                for family in np.unique(hub):
                    p = at[hub == family]
                    lo, hi = np.maximum(p - (window - width), 0), np.minimum(p + window, len(h))
                    new = np.ones(len(p), dtype=bool)
                    new[1:] = lo[1:] > hi[:-1]
                    first = np.flatnonzero(new)
                    starts, ends = lo[first], hi[np.append(first[1:], len(p)) - 1]
                    rows.append((int(family), *(int(k[i]) for k in keys), int((ends - starts).sum()), starts.astype(np.int64).tobytes(), ends.astype(np.int64).tobytes(), np.concatenate([h[s:e] for s, e in zip(starts, ends)]).tobytes()))
            kinds = [pa.int64()] * 6 + [pa.binary()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 9, kinds)], ["hub", *KEY, "size", "starts", "ends", "words"])

    return run


def _spans(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _match(window: int):
    def run(table: pa.Table) -> pa.Table:
        col = {c: table.column(c).to_numpy() for c in ("hub", *KEY)}
        blob = {c: table.column(c) for c in ("starts", "ends", "words")}
        order = np.lexsort((col["doc_id"], col["hub"]))
        rows, waiting, state = [], [], (None, None)
        automaton = SuffixAutomaton()
        for i in order:
            now = (col["hub"][i], col["doc_id"][i])
            if now != state:
                if now[0] != state[0]:
                    automaton = SuffixAutomaton()
                else:
                    for w in waiting:
                        automaton.insert(w)
                waiting, state = [], now
            starts, ends, text = (np.frombuffer(blob[c][int(i)].as_buffer(), dtype=np.int64) for c in ("starts", "ends", "words"))
            cut, at = [], 0
            for s, e in zip(starts, ends):
                part = text[at : at + e - s].tolist()
                at += e - s
                if len(part) < window:
                    continue
                long = np.array(automaton.matching_statistics(part)) >= window if len(automaton.next) > 1 else np.zeros(len(part), bool)
                for a, z in zip(*_spans(long)):
                    cut.append((s + a - window + 1, s + z))
                for a, z in zip(*_spans(~long[window - 1 :])):
                    waiting.append(part[a : z + window - 1])
            if cut:
                rows.append((*(int(col[c][i]) for c in KEY), [{"lo": int(a), "hi": int(z)} for a, z in cut]))
        kind = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 5, [pa.int64()] * 4 + [kind])], names=[*KEY, "cut"])

    return run


def _remove(batches):
    for batch in batches:
        removed, sha = [], []
        for text, cuts in zip(batch.column("text").cast(pa.large_binary()), batch.column("cuts")):
            parts = bytes(text.as_buffer()).split() if text.is_valid else []
            keep = np.ones(len(parts), dtype=bool)
            for c in cuts.as_py() or ():
                for x in c:
                    keep[x["lo"] : x["hi"]] = False
            removed.append(int((~keep).sum()))
            sha.append(hashlib.sha256(b" ".join(w for w, k in zip(parts, keep) if k)).hexdigest())
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in KEY), pa.array(removed, pa.int64()), pa.array(sha, pa.string())], [*KEY, "removed", "rest"])


def remove_repeats(docs: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for each row of ``docs`` (doc_id, text, ...)."""
    spark = docs.sparkSession
    width = max(1, window // 2)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    key = "doc_id long, n long, s1 long, s2 long"
    profile = materialize(rows.mapInArrow(_profile, f"{key}, sha string"), "words")
    total = profile.agg(F.sum("n")).first()[0] or 0
    blocks = max(shuffle_partitions(spark), total * 2 // (window - width + 2) // ENTRIES_PER_BLOCK)
    hits = rows.mapInArrow(_entries(window, width, blocks), "block int, heads binary, hashes binary, local binary").groupBy("block").applyInArrow(_families, f"{key}, anchor long, hub long")
    # Whichever copy a task posted, the class's smallest id stands for it; the others are handled below.
    hits = hits.groupBy("n", "s1", "s2").agg(F.collect_set(F.struct("anchor", "hub")).alias("hits"))
    first = profile.filter(f"n >= {window} and doc_id is not null").groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("least"))
    hits = hits.join(first, ["n", "s1", "s2"]).select(F.col("least").alias("id"), F.col("n").alias("hn"), F.col("s1").alias("h1"), F.col("s2").alias("h2"), "hits")
    # Rows are told apart by their words where a doc_id repeats; _regions drops the wrong pairs.
    suspects = rows.join(hits, rows["doc_id"] == hits["id"]).select("doc_id", F.col("hn").alias("n"), F.col("h1").alias("s1"), F.col("h2").alias("s2"), "text", "hits")
    suspects = materialize(suspects, "suspects")
    regions = materialize(suspects.mapInArrow(_regions(window, width), f"hub long, {key}, size long, starts binary, ends binary, words binary"), "regions")
    sizes = regions.groupBy("hub").agg(F.sum("size").alias("all"), F.count("*").alias("docs")).filter("docs > 1")
    buckets = max(shuffle_partitions(spark), total // BUCKET_WORDS)
    sizes = sizes.select("hub", F.greatest(F.lit(1), F.ceil(F.col("all") * 2 / shard_words)).cast("int").alias("parts")).withColumn("parts", F.when(F.col("parts") <= 2, 1).otherwise(F.col("parts")))
    dealt = regions.join(sizes, "hub").withColumn("mine", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    single = F.col("parts") == 1
    dealt = dealt.withColumn("task", F.when(single, F.pmod(F.xxhash64("hub"), F.lit(buckets))).otherwise(F.col("hub")))
    dealt = dealt.withColumn("p", F.when(single, -1).otherwise(F.least("mine", "other"))).withColumn("q", F.when(single, -1).otherwise(F.greatest("mine", "other")))
    cuts = dealt.select("task", "p", "q", "hub", *KEY, "starts", "ends", "words").groupBy("task", "p", "q").applyInArrow(_match(window), f"{key}, cut array<struct<lo:long,hi:long>>")
    cuts = cuts.groupBy(KEY).agg(F.collect_list("cut").alias("cuts"))
    partial = suspects.select(*KEY, "text").dropDuplicates(KEY).join(cuts, KEY).mapInArrow(_remove, f"{key}, removed long, rest string")
    empty = hashlib.sha256(b"").hexdigest()
    copy = F.col("doc_id") > F.col("least")
    out = profile.join(first, ["n", "s1", "s2"], "left").join(partial, KEY, "left")
    return out.select(
        "doc_id",
        F.col("n").alias("n_words"),
        F.when(copy, F.col("n")).otherwise(F.coalesce("removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.lit(empty)).otherwise(F.coalesce("rest", "sha")).alias("kept_sha256"),
    )


def op8_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
