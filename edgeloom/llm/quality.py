"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata of the text.

score = sigmoid(w0 + <w, x> + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)): the pairwise interactions cost time
linear in the features.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.llm.bytewords import hash_words
from edgeloom.llm.common import mapped, rows_by_bytes, text_of

HASHED = 1024
STATS = 20
RANK = 8
#: most labelled rows that a model is fitted on
SAMPLE = 12_000
THRESHOLD = 0.3

_CLASS = np.full(256, 5, np.int64)  # others: bytes of letters outside ASCII
for _k, _s in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\x0b\x0c", b"\n")):
    _CLASS[list(_s)] = _k
_CLASS[[c for c in range(128) if _CLASS[c] == 5]] = 6
_CLASS[[ord(c) for c in ".,;:'\"-()?"]] = 7


def features(texts: list[bytes]) -> np.ndarray:
    """A dense float32 row of HASHED + STATS for each text, from its whole bytes; a text without words has zeros."""
    n = len(texts)
    hashes, lengths, bounds, raw = hash_words(texts)
    owner = np.repeat(np.arange(n), np.diff(bounds))
    x = np.zeros((n, HASHED + STATS), np.float32)
    bucket = (hashes >> np.uint64(40)).astype(np.int64) % HASHED
    counts = np.bincount(owner * HASHED + bucket, minlength=n * HASHED).reshape(n, HASHED)
    x[:, :HASHED] = np.log1p(counts)
    x[:, :HASHED] /= np.maximum(np.linalg.norm(x[:, :HASHED], axis=1, keepdims=True), 1e-6)

    sizes = np.fromiter(map(len, texts), np.int64, n)
    of_byte = np.repeat(np.arange(n), sizes + 1)
    classes = np.bincount(of_byte * 8 + _CLASS[raw], minlength=n * 8).reshape(n, 8).astype(np.float64)
    classes[:, 4] -= 1  # the joint
    size, words = np.maximum(sizes, 1), np.maximum(np.diff(bounds), 1)
    order = np.lexsort((hashes, owner))
    h, o = hashes[order], owner[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    distinct = np.bincount(o[fresh], minlength=n)
    top = np.zeros(n)
    if len(h):
        at = np.flatnonzero(fresh)
        np.maximum.at(top, o[at], np.diff(np.append(at, len(h))))
    same = np.zeros(len(h), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    repeats = np.bincount(owner[same], minlength=n)
    sums = np.bincount(owner, lengths, n)
    squares = np.bincount(owner, lengths.astype(np.float64) ** 2, n)
    marked = np.zeros(n)
    kinds = np.zeros(n)
    lines = np.zeros(n)
    for i, t in enumerate(texts):
        own = t.split(b"\n")
        lines[i] = 1 - len(set(own)) / len(own)
        marked[i] = t.count(b"!!") + t.count(b"??") + t.count(b"***") + t.count(b"###") + t.count(b"$$$") + t.count(b"%%%") + t.count(b"&&&")
        kinds[i] = t.count(b" | ")
    share = classes / size[:, None]
    letters = np.maximum(classes[:, 0] + classes[:, 1], 1)
    mean = sums / words
    x[:, HASHED:] = np.stack(
        [
            *share.T[[0, 1, 2, 3, 5, 6, 7]], share[:, 4] * 20, classes[:, 1] / letters, np.log1p(size) / 10, np.log1p(words) / 8, mean / 10,
            np.sqrt(np.maximum(squares / words - mean**2, 0)) / 10, distinct / words, top / words, repeats / words, lines, marked / words, kinds / words, (words < 5) * 1.0,
        ],
        axis=1,
    )
    x[sizes == 0] = 0
    return x


def margin(model: dict, x: np.ndarray) -> np.ndarray:
    z = (x - model["shift"]) * model["scale"]
    p = z @ model["v"]
    return model["w0"] + z @ model["w"] + 0.5 * ((p * p).sum(1) - ((z * z) @ (model["v"] ** 2)).sum(1))


def fit(x: np.ndarray, y: np.ndarray, epochs: int = 30, batch: int = 256, rate: float = 0.01, decay: float = 1e-4, seed: int = 11) -> dict:
    """The machine fitted by Adam on the logistic loss. Without rows, or with one label only, the score is constant."""
    random = np.random.default_rng(seed)
    d = x.shape[1]
    model = {"w0": 0.0, "w": np.zeros(d, np.float32), "v": random.normal(0, 0.01, (d, RANK)).astype(np.float32), "shift": np.zeros(d, np.float32), "scale": np.ones(d, np.float32)}
    if not len(y) or y.min() == y.max():
        model["w0"], model["v"] = (float(np.clip(y.mean(), 0.02, 0.98) if len(y) else 0.5), np.zeros_like(model["v"]))
        model["w0"] = float(np.log(model["w0"] / (1 - model["w0"])))
        return model
    model["shift"][HASHED:] = x[:, HASHED:].mean(0)
    model["scale"][HASHED:] = 1 / np.maximum(x[:, HASHED:].std(0), 1e-3)
    z = np.clip((x - model["shift"]) * model["scale"], -8, 8)
    held = [np.array([np.log(y.mean() / (1 - y.mean()))], np.float32), model["w"], model["v"]]
    first, second, step = [np.zeros_like(a) for a in held], [np.zeros_like(a) for a in held], 0
    for _ in range(epochs):
        order = random.permutation(len(y))
        for at in range(0, len(y), batch):
            rows = order[at : at + batch]
            b = z[rows]
            p = b @ held[2]
            s = held[0][0] + b @ held[1] + 0.5 * ((p * p).sum(1) - ((b * b) @ (held[2] ** 2)).sum(1))
            e = ((1 / (1 + np.exp(-np.clip(s, -30, 30))) - y[rows]) / len(rows)).astype(np.float32)
            gv = b.T @ (e[:, None] * p) - held[2] * ((b * b).T @ e)[:, None]
            step += 1
            for k, g in enumerate((np.array([e.sum()], np.float32), b.T @ e + decay * held[1], gv + decay * held[2])):
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                held[k] -= (rate * first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model | {"w0": float(held[0][0]), "w": held[1], "v": held[2]}


def scores(model: dict, texts: list[bytes]) -> np.ndarray:
    x = features(texts)
    x[:, HASHED:] = np.clip((x[:, HASHED:] - model["shift"][HASHED:]) * model["scale"][HASHED:], -8, 8)
    return 1 / (1 + np.exp(-np.clip(margin(model | {"shift": 0, "scale": 1}, x).astype(np.float64), -30, 30)))


def _raw(part: pa.RecordBatch) -> list[bytes]:
    return [v.as_buffer().to_pybytes() for v in part.column(part.schema.get_field_index("text"))]


def _sample_rows(part: pa.RecordBatch) -> dict:
    x = features(_raw(part)).astype(np.float16)
    return {"y": part.column(part.schema.get_field_index("y")).to_pylist(), "x": [r.tobytes() for r in x]}


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, label: str = "quality") -> dict:
    """A model from at most about `most` labelled rows that are not held out, chosen by a hash of doc_id.

    A doc_id with several labels counts with the smallest; null ids and labels are not used.
    """
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("y").alias("y"))
    n = known.count()
    if n > most:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * most / n))
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text"))
    chosen = texts.join(F.broadcast(known), "doc_id")  # at most about `most` rows of 12 bytes
    rows = mapped(chosen, _sample_rows, "y int, x binary").toArrow()
    x = np.frombuffer(b"".join(v.as_buffer().to_pybytes() for v in rows["x"]), np.float16).reshape(-1, HASHED + STATS).astype(np.float32)
    y = np.array(rows["y"].to_pylist(), np.float32)
    order = np.lexsort((*x.T[HASHED : HASHED + 12], y))  # the rows' order in the shuffle must not matter
    return fit(x[order], y[order])


def _score_rows(part: pa.RecordBatch, model: dict) -> dict:
    s = scores(model, _raw(part)) if part.num_rows else np.zeros(0)
    return {"doc_id": part.column(0).to_pylist(), "held_out": part.column(2).to_pylist(), "score": s.tolist(), "predicted": (s >= THRESHOLD).astype(int).tolist()}


def score_quality(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score and predicted (score >= 0.3) of every whole text.

    Only the text is looked at. Null and empty texts get the score of a text without features; equal texts score
    alike, repeated rows stay; a null doc_id is not held out. Without usable labels the score is 0.5 everywhere.
    The scan is one narrow pass; only the bounded sample of labelled rows reaches the driver.
    """
    model = train(docs, labels, most)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text"), held_out(F.col("doc_id")).alias("held_out"))
    return mapped(texts, partial(_score_rows, model=model), "doc_id bigint, held_out boolean, score double, predicted int")


def score_column(texts: pa.Array, model: dict) -> pa.Array:
    """The scores of texts, by about 1 MB of them, so that memory follows no batch size."""
    parts = rows_by_bytes([pa.RecordBatch.from_arrays([texts], ["text"])])
    return pa.array(np.concatenate([np.zeros(0), *(scores(model, _raw(part)) for part in parts)]))


def keep_good(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """The rows of docs, all columns, whose text is predicted to be good."""
    model = train(docs, labels, most)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return score_column(texts, model)

    return docs.where(score(text_of()) >= THRESHOLD)
