"""Language identification by nearest centroid over TF-IDF n-gram vectors.

A text is lower-cased, everything but letters becomes one blank, and its n-grams of 1 to 3
characters are counted in ``DIMS`` hash buckets. Weights are term frequency times inverse document
frequency, normalised; document frequencies are counted over all training documents. Each language
gets ``CLUSTERS`` centroids by spherical k-means over a bounded sample of its documents
(``SAMPLE`` a language, the smallest hashes of doc_id). A text takes the language of the centroid
with the largest cosine, which is its score; it is rejected if that cosine is below
``FLOOR * n / (n + 20)`` for n letters: far from every centroid, with allowance for the few n-grams
of a short text.

Texts are read where they are; what is shuffled is one row a bucket and partition, and the sample.
The model (languages times clusters times dims numbers) is collected and its size is checked.

Cases: null texts and texts without a letter are ``und`` with score 0 and rejected; without a
training document everything is ``und``; very long texts count whole; repeated rows are judged one
by one; other columns pass through ``predict``, and columns named as its results are replaced.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from tillroll.llm.tokens import mix, slices

DIMS, ORDERS = 4096, (1, 2, 3)
SAMPLE, CLUSTERS, FLOOR = 300, 4, 0.3
MAX_MODEL_BYTES = 256 << 20
ROWS = 256
CHARS = 100_000


@cache
def _letters() -> np.ndarray:
    """For each code point: itself lower-cased if a letter, else a blank."""
    out = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            out[c] = ord(ch.lower()[0])
    return out


def counts(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Term frequencies, one row a text (all 0: no letter), and the number of its letters. About ``CHARS`` characters are
    worked on at once, since each takes some 150 bytes meanwhile."""
    tf, letters, at = np.zeros((len(texts), DIMS)), np.zeros(len(texts), np.int64), 0
    while at < len(texts):
        to, size = at + 1, len(texts[at] or "")
        while to < len(texts) and size + len(texts[to] or "") <= CHARS:
            size, to = size + len(texts[to] or ""), to + 1
        tf[at:to], letters[at:to] = _counts(texts[at:to])
        at = to
    return tf, letters


def _counts(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    joined = "\0" + "\0".join(t or "" for t in texts) + "\0"
    raw = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    row = np.cumsum(raw == 0) - 1
    if "\0" in "".join(t or "" for t in texts):
        row = np.concatenate([[0], np.repeat(np.arange(len(texts)), [len(t or "") + 1 for t in texts])])
    c = _letters()[raw]
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] != 32) | (c[:-1] != 32) | (row[1:] != row[:-1])
    c, row = c[keep].astype(np.uint64), row[keep]
    letters = np.bincount(row[c != 32], minlength=len(texts))[:len(texts)]
    out = np.zeros(len(texts) * DIMS)
    for n in ORDERS:
        k = len(c) - n + 1
        if k <= 0:
            continue
        h, some, inside = np.full(k, n, np.uint64), np.zeros(k, bool), row[:k] == row[n - 1:]
        for j in range(n):
            h = h * np.uint64(0x100000001B3) + c[j:j + k]
            some |= c[j:j + k] != 32
        ok = some & inside & (row[:k] < len(texts))
        code = row[:k][ok] * DIMS + (mix(h[ok]) >> np.uint64(40)).astype(np.int64) % DIMS
        out += np.bincount(code, minlength=len(out))
    return out.reshape(len(texts), DIMS), letters


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return (x / np.where(norm > 0, norm, 1)).astype(np.float32)


def _chunks(batches, column: int):
    for part in slices(batches, limit=2_000_000):
        for at in range(0, part.num_rows, ROWS):
            piece = part.slice(at, ROWS)
            yield piece, *counts(piece.column(column).to_pylist())


def cluster(x: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means from a farthest-point start."""
    mid = _unit(x.mean(0, keepdims=True))
    near, chosen = x @ mid[0], [int(np.argmax(x @ mid[0]))]
    near = x @ x[chosen[0]]
    while len(chosen) < min(k, len(x)):
        chosen.append(int(np.argmin(near)))
        near = np.maximum(near, x @ x[chosen[-1]])
    mid = x[chosen]
    for _ in range(10):
        label = np.argmax(x @ mid.T, 1)
        mid = _unit(np.stack([x[label == j].sum(0) if (label == j).any() else mid[j] for j in range(len(mid))]))
    return mid


class Model:
    def __init__(self, idf: np.ndarray, langs: list[str], centroids: np.ndarray):
        self.idf, self.langs, self.centroids = idf, langs, centroids


def fit(docs: DataFrame, sample: int = SAMPLE, clusters: int = CLUSTERS) -> Model:
    """Learn from (doc_id, text, lang); rows without lang or without a letter teach nothing."""
    labelled = docs.where("lang is not null and text is not null").select("doc_id", "text", F.col("lang").cast("string").alias("lang"))

    def frequencies(batches):
        df, n = np.zeros(DIMS, np.int64), 0
        for _, tf, _ in _chunks(batches, 1):
            df += (tf > 0).sum(0)
            n += int(tf.any(1).sum())
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, DIMS)), pa.array(np.concatenate([[n], df]))], ["dim", "n"])

    df = {r[0]: r[1] for r in labelled.mapInArrow(frequencies, "dim long, n long").groupBy("dim").agg(F.sum("n")).collect()}
    total = df.get(-1, 0)
    idf = np.log((1 + total) / (1 + np.array([df.get(i, 0) for i in range(DIMS)], float))) + 1

    def learn(batches):
        by: dict[str, list] = {}
        for piece, tf, _ in _chunks(batches, 1):
            for lang, row in zip(piece.column(2).to_pylist(), tf):
                if row.any():
                    by.setdefault(lang, []).append(row.astype(np.float32))
        for lang, rows in sorted(by.items()):
            mid = cluster(_unit(np.stack(rows) * idf), clusters)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(mid)), pa.array([m.tobytes() for m in mid], pa.binary())], ["lang", "centroid"])

    first = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text"))
    chosen = labelled.select("doc_id", "text", "lang").withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= sample)
    per_lang = chosen.repartition("lang").select("doc_id", "text", "lang")
    langs = labelled.agg(F.approx_count_distinct("lang", 0.02)).first()[0]
    if langs * clusters * DIMS * 4 > MAX_MODEL_BYTES:
        raise ValueError(f"about {langs} languages: the model would be too large to broadcast")
    made = sorted(tuple(r) for r in per_lang.mapInArrow(learn, "lang string, centroid binary").collect())
    mid = np.stack([np.frombuffer(m, np.float32) for _, m in made]) if made else np.zeros((0, DIMS), np.float32)
    return Model(idf, [lang for lang, _ in made], mid)


def predict(docs: DataFrame, model: Model, floor: float = FLOOR) -> DataFrame:
    """``docs`` with lang_pred, score (0 to 1) and rejected."""
    added = ["lang_pred", "score", "rejected"]
    docs = docs.drop(*added).withColumn("text", F.col("text").cast("string"))
    sent, place = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")
    schema = StructType([*docs.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("rejected", BooleanType())])

    def run(batches):
        m = sent.value
        for piece, tf, letters in _chunks(batches, place):
            some = tf.any(1)
            if len(m.langs):
                cos = _unit(tf * m.idf) @ m.centroids.T
                best = np.argmax(cos, 1)
                score = np.where(some, np.clip(cos[np.arange(len(best)), best], 0, 1), 0).astype(float)
                lang = [m.langs[b] if s else "und" for b, s in zip(best.tolist(), some.tolist())]
                reject = ~some | (score < floor * letters / (letters + 20))
            else:
                score, lang, reject = np.zeros(len(some)), ["und"] * len(some), np.ones(len(some), bool)
            yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(lang), pa.array(score), pa.array(reject)], [*piece.schema.names, *added])

    return docs.mapInArrow(run, schema)


def held_out(doc_id="doc_id"):
    """Documents that no model here learns from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))
