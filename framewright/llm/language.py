"""Operator 7: language identification by a bidirectional gated recurrent network over bytes.

The network reads a text's UTF-8 bytes in pieces of ``PIECE`` bytes, forwards and backwards, gives
every position a distribution over the languages, and a document the mean over all its positions.
Gates and states are piecewise linear, so a position costs a few vector operations. It is trained
in numpy by backpropagation through time with Adam, on the driver, from a bounded sample: about
``PER_LANGUAGE`` pieces of each language, drawn by a hash of the row (``sample`` documents the
bounds). Prediction reads every byte of every text where it lies; nothing is shuffled, and the
broadcast network is a few thousand numbers per hundred languages.

Defined results: null and empty texts and texts without a letter are ``und`` with score 0; rows
for which ``learn`` is null (the query's fold of a null id) are not learnt from; without any
labelled row all texts are ``und``; repeated rows stay rows of their own and are learnt once; an
empty table gives no rows; ties go to the first language in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column, table

UNKNOWN = "und"
HIDDEN, PIECE, ROWS = 8, 128, 2048
PER_LANGUAGE, LEARN_BYTES, STEPS, LEARN_ROWS, RATE, SEED = 1500, 64, 160, 384, 0.02, 7
#: Languages that are learnt, those of the most rows.
MOST_LANGUAGES = 256
PAD = 256
LETTER = regex.compile(r"\p{L}")


class Network:
    """Two recurrent networks of ``HIDDEN`` units and an output layer.

    For a byte x and a state h: z, r = clip(E_z[x] + h U_z), clip(E_r[x] + h U_r) in [0, 1],
    m = clip(E_m[x] + r (h U_m)) in [-1, 1], and the next state is m + z (h - m).
    """

    def __init__(self, languages: list[str], seed: int = SEED):
        draw = np.random.default_rng(seed)
        self.languages = languages
        self.p: dict[str, np.ndarray] = {}
        for way in "fb":
            for gate, at in (("z", 0.5), ("r", 0.5), ("m", 0.0)):
                self.p[f"E{gate}{way}"] = (at + draw.normal(0, 0.15, (PAD + 1, HIDDEN))).astype(np.float32)
                self.p[f"U{gate}{way}"] = draw.normal(0, 0.2, (HIDDEN, HIDDEN)).astype(np.float32)
            self.p[f"Ez{way}"][PAD] = 4  # a gate that is shut: what stands behind a text's end leaves no trace
            self.p[f"V{way}"] = draw.normal(0, 0.3, (HIDDEN, len(languages))).astype(np.float32)
        self.p["c"] = np.zeros(len(languages), np.float32)

    def states(self, x: np.ndarray, way: str, keep: list | None = None) -> np.ndarray:
        """(steps, rows, HIDDEN) after each byte; x is (steps, rows). keep gets what the way back needs."""
        p = self.p
        ez, er, em, uz, ur, um = (p[k + way] for k in ("Ez", "Er", "Em", "Uz", "Ur", "Um"))
        steps, rows = x.shape
        out = np.empty((steps, rows, HIDDEN), np.float32)
        h = np.zeros((rows, HIDDEN), np.float32)
        z, r, m, q = (np.empty((rows, HIDDEN), np.float32) for _ in range(4))
        for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
            if keep is not None:
                z, r, m, q = (np.empty((rows, HIDDEN), np.float32) for _ in range(4))
            np.dot(h, uz, out=z)
            z += ez.take(x[t], axis=0)
            np.maximum(z, 0, out=z)
            np.minimum(z, 1, out=z)
            np.dot(h, ur, out=r)
            r += er.take(x[t], axis=0)
            np.maximum(r, 0, out=r)
            np.minimum(r, 1, out=r)
            np.dot(h, um, out=q)
            np.multiply(r, q, out=m)
            m += em.take(x[t], axis=0)
            np.maximum(m, -1, out=m)
            np.minimum(m, 1, out=m)
            if keep is not None:
                keep.append((t, h, z, r, m, q))
            new = out[t]
            np.subtract(h, m, out=new)
            new *= z
            new += m
            h = new
        return out

    def positions(self, x: np.ndarray) -> np.ndarray:
        """Probabilities (languages, steps, rows) at every position."""
        steps, rows = x.shape
        out = self.p["Vf"].T @ self.states(x, "f").reshape(-1, HIDDEN).T
        out += self.p["Vb"].T @ self.states(x, "b").reshape(-1, HIDDEN).T
        out += self.p["c"][:, None]
        out -= out.max(axis=0)
        np.exp(out, out=out)
        out /= out.sum(axis=0)
        return out.reshape(-1, steps, rows)

    def learn(self, x: np.ndarray, y: np.ndarray, steps: int = STEPS, rows: int = LEARN_ROWS, rate: float = RATE, seed: int = SEED) -> None:
        """x: (pieces, LEARN_BYTES) with PAD after an end, y: each piece's language."""
        draw, mean, spread = np.random.default_rng(seed), {}, {}
        for step in range(1, steps + 1):
            pick = draw.integers(0, len(x), min(rows, len(x)))
            grads = self.backward(np.ascontiguousarray(x[pick].T), y[pick])
            for k, g in grads.items():
                mean[k] = 0.9 * mean.get(k, 0) + 0.1 * g
                spread[k] = 0.99 * spread.get(k, 0) + 0.01 * g * g
                fall = rate * (1 - 0.9 * step / steps)
                self.p[k] = (self.p[k] - fall * (mean[k] / (1 - 0.9**step)) / (np.sqrt(spread[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)

    def backward(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the cross-entropy, its mean over pieces of the mean over positions, back through time."""
        steps, rows = x.shape
        keep = {"f": [], "b": []}
        hidden = {way: self.states(x, way, keep[way]) for way in "fb"}
        logits = hidden["f"] @ self.p["Vf"] + hidden["b"] @ self.p["Vb"] + self.p["c"]
        logits -= logits.max(axis=2, keepdims=True)
        d = np.exp(logits)
        d /= d.sum(axis=2, keepdims=True)
        d[:, np.arange(rows), y] -= 1
        there = x != PAD
        d *= (there / (np.maximum(1, there.sum(axis=0)) * np.float32(rows)))[:, :, None].astype(np.float32)
        grads = {"c": d.sum(axis=(0, 1))}
        for way in "fb":
            grads[f"V{way}"] = hidden[way].reshape(-1, HIDDEN).T @ d.reshape(-1, d.shape[2])
            down = d @ self.p[f"V{way}"].T
            uz, ur, um = (self.p[k + way] for k in ("Uz", "Ur", "Um"))
            g = {k: np.zeros_like(self.p[k + way]) for k in ("Ez", "Er", "Em", "Uz", "Ur", "Um")}
            dh = np.zeros((rows, HIDDEN), np.float32)
            for t, h, z, r, m, q in reversed(keep[way]):
                dh = dh + down[t]
                dz = dh * (h - m) * ((z > 0) & (z < 1))
                dm = dh * (1 - z) * ((m > -1) & (m < 1))
                dr = dm * q * ((r > 0) & (r < 1))
                dq = dm * r
                for gate, inner, outer in (("z", dz, dz), ("r", dr, dr), ("m", dm, dq)):
                    np.add.at(g[f"E{gate}"], x[t], inner)
                    g[f"U{gate}"] += h.T @ outer
                dh = dh * z + dz @ uz.T + dr @ ur.T + dq @ um.T
            grads |= {k + way: v for k, v in g.items()}
        return grads


def pool(network: Network, texts: list[str | None]) -> np.ndarray:
    """(texts, languages): mean probabilities over every position of each whole text."""
    data = [(x or "").encode() for x in texts]
    sizes = np.array([len(x) for x in data], np.int64)
    flat = np.frombuffer(b"".join(data), np.uint8)
    ends = np.cumsum(sizes)
    pieces = -(-sizes // PIECE)
    doc = np.repeat(np.arange(len(data)), pieces)
    first = np.cumsum(pieces) - pieces
    start = (ends - sizes)[doc] + (np.arange(len(doc)) - first[doc]) * PIECE
    sums = np.zeros((len(network.languages), len(data)))
    for at in range(0, len(doc), ROWS):
        rows, where = doc[at : at + ROWS], start[at : at + ROWS]
        index = where + np.arange(PIECE)[:, None]
        there = index < ends[rows]
        x = np.where(there, flat[np.minimum(index, len(flat) - 1)].astype(np.int16), np.int16(PAD))  # PAD is no byte
        got = (network.positions(x) * there).sum(axis=1)
        for k in range(len(sums)):
            sums[k] += np.bincount(rows, weights=got[k], minlength=len(data))
    return (sums / np.maximum(sizes, 1)).T


def bucket(ident: Column, of: int) -> Column:
    """crc32 of the id as text, modulo; null for a null id."""
    return F.crc32(ident.cast("string").cast("binary")) % of


def sample(rows: DataFrame, per_language: int = PER_LANGUAGE, languages: int = MOST_LANGUAGES) -> list[tuple[str, str]]:
    """(language, piece of text) of about ``per_language`` different rows of each language, twice that at most.

    Rows whose hash of id and text is under a language's own bound are taken, so no language's rows
    meet in one task; equal rows count once. Of more than ``languages`` languages those of the most
    rows are learnt. The driver gets ``2 * languages * per_language`` pieces at most. rows: (id,
    lang, text), all to learn from.
    """
    # each row's hash spreads evenly, so the least of all rows are a sample of them
    rows = rows.withColumn("row", F.xxhash64("id", "text", F.lit(SEED)))
    count = rows.groupBy("lang").agg(F.approx_count_distinct("row").alias("n")).orderBy(F.desc("n"), "lang").limit(languages)
    counts = {r["lang"]: r["n"] for r in count.collect()}
    if not counts:
        return []
    most = F.element_at(F.create_map(*(F.lit(x) for k, n in counts.items() for x in (k, min(1.0, per_language / n)))), F.col("lang"))
    h = F.shiftrightunsigned("row", 11) / F.lit(float(1 << 53))
    # a place anywhere in the text
    begin = (F.pmod(F.xxhash64("row", F.lit(~SEED)), F.greatest(F.char_length("text") - LEARN_BYTES, F.lit(0)) + 1) + 1).cast("int")
    some = rows.where(h <= most).select("lang", F.col("text").substr(begin, F.lit(LEARN_BYTES)).alias("piece"), (h / most).alias("h")).distinct()
    got = some.orderBy("h", "lang", "piece").limit(2 * per_language * len(counts)).collect()
    by: dict[str, list[str]] = {}
    for r in got:
        by.setdefault(r["lang"], []).append(r["piece"])
    return [(k, piece) for k in sorted(by) for piece in by[k][: 2 * per_language] if piece]


def train(pieces: list[tuple[str, str]]) -> Network | None:
    languages = sorted({x for x, _ in pieces})
    if not languages:
        return None
    network = Network(languages)
    rows = [piece.encode()[:LEARN_BYTES] for _, piece in pieces]
    x = np.full((len(rows), LEARN_BYTES), PAD, np.int64)
    for i, r in enumerate(rows):
        x[i, : len(r)] = np.frombuffer(r, np.uint8)
    # half of the pieces are cut, for texts that are as short
    draw = np.random.default_rng(SEED)
    for i in np.flatnonzero(draw.random(len(x)) < 0.5):
        x[i, draw.integers(6, LEARN_BYTES) :] = PAD
    y = np.array([languages.index(k) for k, _ in pieces])
    # languages count alike however many pieces they have
    order = np.concatenate([np.resize(np.flatnonzero(y == k), max(np.bincount(y))) for k in range(len(languages))])
    network.learn(x[order], y[order])
    return network


def identify(docs: DataFrame, learn: Column, ident: str = "doc_id", text: str = "text", lang: str = "lang", keep: list[str] | None = None) -> DataFrame:
    """The columns in ``keep`` (all) with lang_pred and score; ``learn`` says which rows may be learnt from."""
    rows = docs.where(F.coalesce(learn, F.lit(False)) & column(lang).isNotNull()).select(column(ident).alias("id"), column(lang).alias("lang"), column(text).alias("text"))
    network = train(sample(rows.where(F.col("text").rlike(r"\p{L}"))))
    sent = docs.sparkSession.sparkContext.broadcast(network)
    own = [c for c in (keep if keep is not None else docs.columns) if c not in ("lang_pred", "score")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = sent.value
        for batch in batches:
            names, scores = [], []
            values = batch.column(1)
            at = 0
            while at < len(values):  # about a megabyte at a time
                texts, size = [], 0
                while at < len(values) and (not texts or size < 1 << 20):
                    texts.append(values[at].as_py())
                    size += len(texts[-1] or "")
                    at += 1
                some = [x if network and x and LETTER.search(x) else None for x in texts]
                got = pool(network, some) if network else np.zeros((len(texts), 1))
                best = got.argmax(axis=1)
                names += [network.languages[b] if x else UNKNOWN for x, b in zip(some, best, strict=True)]
                scores += [float(min(1.0, got[i, b])) if some[i] else 0.0 for i, b in enumerate(best)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["own", "lang_pred", "score"])

    both = docs.select(F.struct(*map(column, own)).alias("own"), column(text).alias("text"))
    schema = T.StructType([T.StructField("own", both.schema["own"].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return both.mapInArrow(run, schema).select("own.*", "lang_pred", "score")


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: the language of every document; a quarter, by crc32, is held out of learning."""
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(bucket(F.col("doc_id"), 4) == 2, F.lit(False))
    got = identify(docs, bucket(F.col("doc_id"), 4) != 2, keep=["doc_id"])
    return got.select("doc_id", held.alias("held_out"), "lang_pred", "score")
