"""Language identification: averaged hashed subword embeddings under a linear softmax.

Features are byte 1-grams and 3-grams of the text with A-Z lowered and other ASCII turned to
spaces, hashed to ``BUCKETS``.  Embeddings and softmax are trained by stochastic gradient descent in
numpy on about ``TRAIN_ROWS`` labelled rows, but about ``LEAST_ROWS`` of each language or all it has
(drawn by a hash of ``doc_id`` from the training folds; whole texts).  As the average is linear, prediction needs only the product of embeddings and
softmax weights: one lookup per feature.  A temperature and a rejection threshold are fitted on a
fifth of the sample that training doesn't see; rejected are texts without a letter and those whose
calibrated probability is below the threshold.

Nulls: null text, or text without a letter, gets ``und`` with score 0.  Rows with null ``lang`` are
predicted but not learned from.  A null ``doc_id`` is held out.  Without labelled rows all get ``und``.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tokens import doc_chunks, text_buffers

BUCKETS, DIM = 1 << 15, 16
TRAIN_ROWS = 4000
#: Rows of a rare language, or all it has.
LEAST_ROWS = 200
EPOCHS, RATE = 8, 1.0
TARGET_ACCEPT = 0.999
REJECT_BELOW = 0.4
_TABLE = np.full(256, 32, dtype=np.uint8)
_TABLE[97:123] = np.arange(97, 123)
_TABLE[65:91] = np.arange(97, 123)
_TABLE[128:] = np.arange(128, 256)
_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = True


def _features(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the 1-gram and the 3-gram that start at each byte (the last two lack 3-grams)."""
    b = _TABLE[data].astype(np.uint32)
    one = (b * np.uint32(0x9E3779B1) >> np.uint32(17)) % np.uint32(BUCKETS)
    three = b[:-2] * np.uint32(0x85EBCA6B) + b[1:-1] * np.uint32(0xC2B2AE35) + b[2:] * np.uint32(0x27D4EB2F) if len(b) > 2 else b[:0]
    return one, (three ^ three >> np.uint32(15)) * np.uint32(0x2C1B3C6D) >> np.uint32(17)


def bags(column: pa.Array):
    """(document, buckets, counts) of every text, for training."""
    data, offsets = text_buffers(column)
    for i in range(len(column)):
        one, three = _features(data[offsets[i] : offsets[i + 1]])
        yield i, *np.unique(np.concatenate([one, three]), return_counts=True)


def has_letter(column: pa.Array) -> np.ndarray:
    data, offsets = text_buffers(column)
    found = np.zeros(len(column), dtype=bool)
    for lo, hi in doc_chunks(offsets):
        total = np.concatenate([[0], np.cumsum(_LETTER[data[offsets[lo] : offsets[hi]]])])
        at = offsets[lo : hi + 1] - offsets[lo]
        found[lo:hi] = total[at[1:]] > total[at[:-1]]
    for i in np.flatnonzero(~found):
        found[i] = any(ch.isalpha() for ch in column[int(i)].as_py() or "")
    return found


def logits(column: pa.Array, weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    data, offsets = text_buffers(column)
    out = np.tile(bias, (len(column), 1)).astype(np.float64)
    for lo, hi in doc_chunks(offsets):
        part = data[offsets[lo] : offsets[hi]]
        edges = offsets[lo : hi + 1] - offsets[lo]
        length = np.diff(edges)
        full = np.flatnonzero(length > 0)
        if not len(full):
            continue
        one, three = _features(part)
        inside = np.ones(len(three), dtype=bool)
        inside[np.concatenate([edges[1:-1] - 1, edges[1:-1] - 2]).clip(0, max(len(three) - 1, 0))] = len(three) == 0
        ends = edges[full]
        for k in range(weights.shape[1]):
            value = weights[:, k]
            per = value[one]
            per[: len(three)] += value[three] * inside
            total = np.add.reduceat(per, ends, dtype=np.float64)
            out[lo + full, k] += total / (length[full] + np.maximum(length[full] - 2, 0))
    return out


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(samples: list[tuple[np.ndarray, np.ndarray, int]], classes: int, seed: int = 7) -> dict:
    """SGD over (buckets, counts, class); returns weights per bucket, bias, temperature, threshold."""
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    soft, bias = rng.normal(0, 0.1, (DIM, classes)).astype(np.float32), np.zeros(classes, dtype=np.float32)
    order = rng.permutation(len(samples))
    fit, check = order[: max(1, len(order) * 4 // 5)], order[max(1, len(order) * 4 // 5) :]
    steps, step = EPOCHS * len(fit), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(fit):
            ids, counts, y = samples[i]
            w = (counts / counts.sum()).astype(np.float32)
            hidden = w @ emb[ids]
            g = _softmax(hidden @ soft + bias)
            g[y] -= 1
            rate = RATE * (1 - step / steps)
            back = soft @ g
            soft -= rate * np.outer(hidden, g)
            bias -= rate * g
            # each feature's step is scaled by its share; the inverse of the mean share keeps the rate
            emb[ids] -= rate * np.outer(w / w.max(), back)
            step += 1
    weights = emb @ soft
    raw = np.array([(counts / counts.sum()) @ weights[ids] + bias for ids, counts, _ in (samples[i] for i in (check if len(check) else fit))])
    gold = np.array([samples[i][2] for i in (check if len(check) else fit)])
    best = min((2.0**k for k in np.arange(-4, 4.1, 0.5)), key=lambda t: -np.log(_softmax(raw / t)[np.arange(len(gold)), gold] + 1e-12).mean())
    top = _softmax(raw / best).max(axis=1)
    right = top[raw.argmax(axis=1) == gold]
    threshold = min(float(np.quantile(right, 1 - TARGET_ACCEPT)), REJECT_BELOW) if len(right) else 0.0
    return {"weights": weights.astype(np.float32), "bias": bias, "temperature": float(best), "threshold": threshold}


def held_out(doc_id: int | None, folds: int = 5) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % folds == 0


def fit(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> dict:
    """A model from labelled rows outside the held-out fold."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    known = rows.filter("lang is not null and text is not null and doc_id is not null").filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    counts = known.groupBy("lang").count().collect()  # a row a language
    total = sum(r["count"] for r in counts)
    names = sorted(r["lang"] for r in counts)
    if not names:
        return {"names": []}
    rows_of = {r["lang"]: max(LEAST_ROWS, train_rows * r["count"] / total) for r in counts}
    share = {r["lang"]: min(1 << 20, math.ceil(rows_of[r["lang"]] * (1 << 20) / r["count"])) for r in counts}

    def extract(batches):
        for batch in batches:
            ids, count = [], []
            for _, a, b in bags(batch.column("text")):
                ids.append(a.astype(np.int32).tobytes())
                count.append(b.astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), pa.array(ids, pa.binary()), pa.array(count, pa.binary())], ["doc_id", "lang", "ids", "counts"])

    shares = F.create_map(*(F.lit(x) for pair in sorted(share.items()) for x in pair))
    drawn = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.element_at(shares, F.col("lang"))).mapInArrow(extract, "doc_id long, lang string, ids binary, counts binary")
    bound = math.ceil(2 * sum(rows_of.values()))
    # the first by a hash of their features, so that repeated ids draw the same rows every time
    got = drawn.withColumn("h", F.xxhash64("doc_id", "ids")).orderBy("h", "doc_id", "ids").limit(bound).collect()
    names = sorted({r["lang"] for r in got if len(r["ids"])})  # a language without samples is not learned
    samples = [(np.frombuffer(r["ids"], np.int32), np.frombuffer(r["counts"], np.int32), names.index(r["lang"])) for r in got if len(r["ids"])]
    if not samples:
        return {"names": []}
    return {"names": names} | train(samples, len(names))


def predict(docs: DataFrame, model: dict, names: tuple[str, str, str] = ("lang_pred", "score", "accepted")) -> DataFrame:
    """``docs`` with the language predicted, its probability and whether it is accepted, in columns ``names`` (any of these names are replaced)."""
    added = list(names)
    docs = docs.drop(*added)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS times languages

    def run(batches):
        m = shared.value
        for batch in batches:
            text = batch.column("text").cast(pa.string())
            found = [None] * len(text)
            score, accepted = np.zeros(len(text)), np.zeros(len(text), dtype=bool)
            letter = has_letter(text)
            if m["names"] and len(text):
                p = _softmax(logits(text, m["weights"], m["bias"]) / m["temperature"])
                best = p.argmax(axis=1)
                score = np.where(letter, p.max(axis=1), 0.0)
                found = [m["names"][k] for k in best]
                accepted = letter & (score >= m["threshold"])
            found = [n if ok and n else "und" for n, ok in zip(found, letter)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string()), pa.array(score), pa.array(accepted)], [*batch.schema.names, *added])

    shape = T.StructType([*docs.schema.fields, *(T.StructField(n, t) for n, t in zip(added, (T.StringType(), T.DoubleType(), T.BooleanType())))])
    return docs.mapInArrow(run, shape)


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0
    return predict(docs.select("doc_id", "text"), fit(docs)).select("doc_id", held.alias("held_out"), "lang_pred", "score", "accepted")
