"""Operator 9: quality scores by nearest-neighbour voting in a latent-semantic space.

A text becomes the logarithmic counts of its byte trigrams (hashed into ``TERMS`` bins) and of a
few terms for its form (how varied its words and lines are, how much of it is capitals, marks or
figures). Terms are weighted by their rarity among the labelled sample, and the sample's
singular vectors span the latent space. Every document's exact cosine with every labelled vector
is computed, a block of documents at a time; the ``NEIGHBOURS`` nearest vote with the cosine as
their weight.

Fitting takes a bounded sample: about ``PER_LABEL`` labelled rows of each label, drawn by a hash,
``4 * PER_LABEL`` at most (``sample``); the labelled vectors, ``4 * PER_LABEL * LATENT`` numbers at
most, are broadcast. Scoring reads every whole text where it lies; only labelled ids are shuffled.

Defined results: a null or empty text is scored like any other, by its form; without labelled rows
of both labels the score is the share of label 1 (0.5 without any); a null id is never learnt
from; repeated labels count once, and rows of one id each as far as the sample's bound goes; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .language import bucket

TERMS, FORMS, LATENT = 4096, 64, 48
PER_LABEL, NEIGHBOURS, SEED = 800, 31, 9
#: Weight of a form's term beside a text's trigrams.
FORM_WEIGHT = 0.35
_HASH = np.uint32(2654435761)
_CLASS = np.zeros(256, np.uint8)  # 1 capital, 2 small letter or beyond ASCII, 3 figure, 4 space, 5 mark
_CLASS[:] = 2
_CLASS[33:127] = 5
_CLASS[:33] = 4
_CLASS[48:58] = 3
_CLASS[65:91] = 1
_CLASS[97:123] = 2


def features(texts: list[str | None]) -> np.ndarray:
    """(texts, TERMS + FORMS) before weighting, from every byte of each whole text."""
    out = np.zeros((len(texts), TERMS + FORMS), np.float32)
    for row, text in zip(out, texts, strict=True):
        data = (text or "").encode()
        raw = np.frombuffer(data, np.uint8)
        if len(raw) >= 3:
            for at in range(0, len(raw) - 2, 1 << 20):  # memory stays bounded for any text
                x = raw[at : at + (1 << 20) + 2].astype(np.uint32)
                grams = ((x[:-2] | x[1:-1] << np.uint32(8) | x[2:] << np.uint32(16)) * _HASH) >> np.uint32(20)
                row[:TERMS] += np.bincount(grams, minlength=TERMS)
            np.log1p(row[:TERMS], out=row[:TERMS])
            row[:TERMS] /= max(np.sqrt(np.dot(row[:TERMS], row[:TERMS])), 1e-9)
        words, lines = data.split(), [x for x in data.split(b"\n") if x.strip()]
        kinds = np.bincount(_CLASS[raw], minlength=6) / max(1, len(raw))
        n = len(words)
        varied = len(set(words)) / max(1, n) * np.log2(n + 2) / 8  # of chance texts, falls slowly with length
        forms = (varied, len(set(lines)) / max(1, len(lines)), 4 * kinds[1], 4 * kinds[3], 4 * kinds[5], len(raw) / max(1, n) / 16, np.log2(n + 1) / 16, np.log2(len(lines) + 1) / 12)
        for k, v in enumerate(forms):  # each value stands between two of eight marks
            v = min(max(float(v), 0.0), 1.0) * 7
            low = min(int(v), 6)
            row[TERMS + 8 * k + low] = FORM_WEIGHT * (1 - (v - low))
            row[TERMS + 8 * k + low + 1] = FORM_WEIGHT * (v - low)
    return out


class Voter:
    """The latent space of a labelled sample, and votes in it."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.y = y.astype(np.float32)
        self.idf = (np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))) + 0.1).astype(np.float32)
        self.idf[TERMS:] = 1
        weighted = x * self.idf
        draw = np.random.default_rng(SEED)
        width = min(LATENT + 16, *weighted.shape)
        basis = np.linalg.qr(weighted @ draw.normal(size=(weighted.shape[1], width)).astype(np.float32))[0]
        for _ in range(3):  # power steps of a randomised singular value decomposition
            basis = np.linalg.qr(weighted @ (weighted.T @ basis))[0]
        terms = np.linalg.svd(basis.T @ weighted, full_matrices=False)[2][:LATENT]
        self.space = np.ascontiguousarray((terms * self.idf).T.astype(np.float32))
        self.known = self.latent(x)

    def latent(self, x: np.ndarray) -> np.ndarray:
        v = x @ self.space
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)

    def score(self, x: np.ndarray) -> np.ndarray:
        sims = self.latent(x) @ self.known.T
        k = min(NEIGHBOURS, sims.shape[1])
        least = np.partition(sims, sims.shape[1] - k, axis=1)[:, -k, None]
        above, tied = sims > least, sims == least
        # ties go to the first labelled vectors, whatever the block
        near = above | (tied & (np.cumsum(tied, axis=1) <= k - above.sum(axis=1, keepdims=True)))
        near = np.nonzero(near)[1].reshape(-1, k)
        weight = np.maximum(np.take_along_axis(sims, near, axis=1), 1e-6).astype(np.float64) ** 4
        return (weight * self.y[near]).sum(axis=1) / weight.sum(axis=1)


def sample(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of about ``per_label`` rows of each label; docs (id, text), labels (id, y).

    Labels are drawn by a hash of the id, equal ones once, ``4 * per_label`` at most, which are
    broadcast; of the documents that have them the ``4 * per_label`` of the least hash of id and text
    reach the driver, however many rows share an id.
    """
    labels = labels.select("id", "y", F.xxhash64("id", F.lit(SEED)).alias("h"))
    counts = {r["y"]: r["n"] for r in labels.groupBy("y").agg(F.approx_count_distinct("h").alias("n")).collect()}
    if not counts:
        return np.zeros((0, TERMS + FORMS), np.float32), np.zeros(0)
    most = F.element_at(F.create_map(*(F.lit(x) for k, n in counts.items() for x in (k, min(1.0, per_label / n)))), F.col("y"))
    h = F.shiftrightunsigned("h", 11) / F.lit(float(1 << 53))
    chosen = labels.where(h <= most).select("id", "y", "h").distinct().orderBy("h", "y").limit(4 * per_label).select("id", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(batch.column(3).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([r.tobytes() for r in x], pa.binary())], names=["id", "y", "h", "x"])

    rows = docs.join(F.broadcast(chosen), "id").select("id", "y", F.xxhash64("id", "text", F.lit(~SEED)).alias("h"), "text")
    got = rows.mapInArrow(run, "id long, y int, h long, x binary").orderBy("h", "y").limit(4 * per_label).collect()
    got.sort(key=lambda r: (r["id"], r["y"], r["x"]))
    return np.frombuffer(b"".join(r["x"] for r in got), np.float32).reshape(-1, TERMS + FORMS), np.array([r["y"] for r in got])


def score_quality(docs: DataFrame, labels: DataFrame, learn: Column, ident: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """(id, score) for each row; ``learn`` over the column ``id`` says which labels may be learnt from."""
    rows = docs.select(F.col(ident).cast("long").alias("id"), F.col(text).alias("text"))
    known = labels.select(F.col(ident).cast("long").alias("id"), F.col(label).cast("int").alias("y")).where(F.coalesce(learn, F.lit(False)) & F.col("y").isin(0, 1))
    x, y = sample(rows, known)
    plain = float(np.mean(y)) if len(y) else 0.5
    sent = docs.sparkSession.sparkContext.broadcast(Voter(x, y) if len(set(y)) == 2 else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = []
            for at in range(0, batch.num_rows, 256):
                texts = batch.column(1).slice(at, 256).to_pylist()
                scores += sent.value.score(features(texts)).tolist() if sent.value else [plain] * len(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["id", "score"])

    return rows.mapInArrow(run, "id long, score double")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: a score for every document; a third, by crc32, is held out of learning."""
    got = score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), bucket(F.col("id"), 3) != 1)
    held = F.coalesce(bucket(F.col("id"), 3) == 1, F.lit(False))
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), "score"))
    return got.select(F.col("id").alias("doc_id"), held.alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))
