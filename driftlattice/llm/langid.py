"""Language ID by string kernels.

A text is the set of its byte n-grams of lengths 1 to 3 (the blended spectrum), hashed to `DIMS` places. The kernel of
two texts is the number of common n-grams over the geometric mean of their numbers (a presence kernel). `fit` draws a
bounded sample of labelled rows (at most `per_language` a language, those with the smallest digests of doc_id; of the
texts of one doc_id the smallest), takes
`landmarks` of each language as Nyström landmarks, and solves one-versus-rest kernel ridge regression in the landmarks'
feature space. Prediction is two matrix products for a block of texts: presence times landmarks, kernels times weights.

Defined results: a text that is null or has no letter is `und` with score 0; with nothing to learn from, every text is.
Repeated rows get the same result; texts are read whole, in blocks. Numbers, marks and control characters count as
spaces, A-Z as a-z. Of languages with equal scores the first by name counts; columns besides doc_id and the text (and, in
`fit`, the label) are left out, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftlattice.llm.textbuf import chunks

DIMS = 1 << 15
LETTER = np.zeros(256, bool)
LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
PLAIN = np.full(256, 32, np.uint8)
PLAIN[0x80:] = np.arange(0x80, 0x100)
PLAIN[0x61:0x7B] = np.arange(0x61, 0x7B)
PLAIN[0x41:0x5B] = np.arange(0x61, 0x7B)


def presence(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """A row of 0 and 1 for each text: which places its n-grams hash to."""
    n = len(offs) - 1
    out = np.zeros((n, DIMS), np.float32)
    flat = out.reshape(-1)
    x = PLAIN[data].astype(np.int32)
    row = np.repeat(np.arange(n, dtype=np.int64) * DIMS, np.diff(offs))
    two = (x[:-1] * 256 + x[1:]).astype(np.int64)
    three = two[:-1] * 256 + x[2:]
    inside = np.ones(len(x), bool)
    inside[offs[1:-1][offs[1:-1] < len(x)]] = False  # starts of rows: an n-gram may not run into them
    flat[row + x] = 1
    if len(x) > 1:
        flat[(row[:-1] + 256 + (two * 40503 >> 4) % (DIMS - 256))[inside[1:]]] = 1
    if len(x) > 2:
        flat[(row[:-2] + 256 + (three * 2654435761 >> 11) % (DIMS - 256))[inside[1:-1] & inside[2:]]] = 1
    return out


def has_letter(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    ascii_ = np.diff(np.concatenate([[0], np.cumsum(LETTER[data])])[offs]) > 0
    for i in np.flatnonzero(~ascii_ & (np.diff(offs) > 0)):
        ascii_[i] = any(c.isalpha() for c in data[offs[i] : offs[i + 1]].tobytes().decode("utf-8", "ignore"))
    return ascii_


def blocks(data: np.ndarray, offs: np.ndarray, most: int = 256):
    for i in range(0, len(offs) - 1, most):
        j = min(i + most, len(offs) - 1)
        yield i, j, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]


def fit(df: DataFrame, learn: Column, label: str = "lang", text: str = "text", per_language: int = 128, landmarks: int = 32, ridge: float = 1e-3):
    """The model (languages, landmark presence, weights) or None. learn: which rows may be learned from."""
    rows = df.filter(learn & F.col(label).isNotNull() & F.col(text).isNotNull()).select(F.col("doc_id").cast("long"), F.col(label).alias("lang"), F.col(text).alias("text"))
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    share = F.conv(F.substring(key, 1, 7), 16, 10).cast("double") / float(1 << 28)
    counts = rows.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("__n")).withColumnRenamed("lang", "__lang")
    near = rows.select("doc_id", "lang", key.alias("key"), share.alias("share")).join(F.broadcast(counts), F.col("lang") == F.col("__lang"))
    near = near.filter(F.col("share") * F.col("__n") <= 3 * per_language + 64)  # a few times the sample of each language, however many rows it has
    picked = near.select("doc_id", "lang", "key").distinct().withColumn("rn", F.row_number().over(Window.partitionBy("lang").orderBy("key", "doc_id"))).filter(F.col("rn") <= per_language).select("doc_id", "lang")

    def digest(batches):
        for b in batches:
            for i, j, data, offs in chunks(b.column(1)):
                ok = has_letter(data, offs)
                for p, q, d, o in blocks(data, offs):
                    bits = [np.packbits(x.astype(bool)).tobytes() if fine else None for x, fine in zip(presence(d, o), ok[p:q], strict=True)]
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(i + p, q - p), b.column(2).slice(i + p, q - p), pa.array(bits, pa.binary())], names=["doc_id", "lang", "bits"])

    sample = rows.join(F.broadcast(picked), ["doc_id", "lang"], "left_semi").groupBy("doc_id", "lang").agg(F.min("text").alias("text")).select("doc_id", "text", "lang")
    got = sorted((r for r in sample.mapInArrow(digest, "doc_id long, lang string, bits binary").collect() if r.bits), key=lambda r: (r.doc_id, r.lang, bytes(r.bits)))
    langs = sorted({r.lang for r in got})
    if not langs:
        return None
    x = np.stack([np.unpackbits(np.frombuffer(r.bits, np.uint8)) for r in got]).astype(np.float32)
    y = np.array([langs.index(r.lang) for r in got])
    marks = x[np.concatenate([np.flatnonzero(y == c)[:landmarks] for c in range(len(langs))])]
    scaled = marks / np.sqrt(marks.sum(1, keepdims=True))
    values, vectors = np.linalg.eigh((scaled @ scaled.T).astype(np.float64))
    root = vectors / np.sqrt(np.maximum(values, 1e-6)) @ vectors.T
    z = kernel(x, scaled).astype(np.float64) @ root
    signs = np.where(y[:, None] == np.arange(len(langs)), 1.0, -1.0)
    rare = np.bincount(y, minlength=len(langs))[y]
    w = 1.0 / rare[:, None]  # every language weighs the same
    z1 = np.hstack([z, np.ones((len(z), 1))])
    beta = np.linalg.solve(z1.T @ (w * z1) + ridge * np.eye(z1.shape[1]), z1.T @ (w * signs))
    return langs, scaled.astype(np.float32), (root @ beta[:-1]).astype(np.float32), beta[-1].astype(np.float32)


def kernel(x: np.ndarray, scaled: np.ndarray) -> np.ndarray:
    return x @ scaled.T / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))


def identify(df: DataFrame, model, text: str = "text") -> DataFrame:
    """doc_id, lang_pred and score (half of one more than the margin, between 0 and 1)."""
    bc = df.sparkSession.sparkContext.broadcast(model)  # languages x landmarks x DIMS: a size set by parameters

    def run(batches):
        model = bc.value
        for b in batches:
            for i, j, data, offs in chunks(b.column(1)):
                ok = has_letter(data, offs)
                names, scores = np.full(j - i, "und", object), np.zeros(j - i)
                if model is not None:
                    langs, scaled, weights, bias = model
                    for p, q, d, o in blocks(data, offs):
                        f = kernel(presence(d, o), scaled) @ weights + bias
                        best = f.argmax(1)
                        names[p:q] = np.where(ok[p:q], np.array(langs, object)[best], "und")
                        scores[p:q] = np.where(ok[p:q], np.clip((f[np.arange(q - p), best] + 1) / 2, 0, 1), 0)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return df.select(F.col("doc_id").cast("long"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")
