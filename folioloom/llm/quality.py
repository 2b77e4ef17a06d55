"""Quality by nearest-neighbour voting among labelled documents.

Terms are hashed words, hashed trigrams of character classes (runs of letters
count once, so these show form) and the share of repeated four-word runs.
Labelled documents, a bounded sample, give term weights, a truncated singular
value decomposition and the labelled latent vectors, which are broadcast. Every
document's latent vector is compared with all of them, in blocks of exact
cosine products; the nearest vote with their labels, weighted by similarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructType

from folioloom.llm.common import free_name, tidy
from folioloom.llm.shingles import shingle_hashes
from folioloom.llm.wordcache import slices

FORMS, WORDS, SHARES, LATENT = 2039, 2053, 10, 64
TERMS = FORMS + WORDS
#: Trigrams counted at once.
PART = 1_000_000
#: Labelled documents of each label, at most, that the model is fitted on.
SAMPLE = 2048
NEIGHBOURS = 25


def _classes() -> np.ndarray:
    """A class for each byte: letters of either case, digits, blanks, line ends, and each mark alone."""
    out = np.zeros(256, np.uint8)
    marks = 5
    for b in range(128):
        c = chr(b)
        if c.islower():
            out[b] = 0
        elif c.isupper():
            out[b] = 1
        elif c.isdigit():
            out[b] = 2
        elif c in "\n\r\v\f":
            out[b] = 4
        elif c.isspace():
            out[b] = 3
        else:
            out[b] = min(marks, 63)
            marks += 1
    return out


CLASSES = _classes()


def _counted(out: np.ndarray, owner: np.ndarray, term: np.ndarray, first: int, size: int) -> None:
    """Adds the terms of each owner to its columns first to first + size."""
    out[:, first : first + size] += np.bincount(owner * size + term, minlength=len(out) * size).reshape(-1, size)


def features(texts: list[str]) -> np.ndarray:
    """Term frequencies of each text, words and forms apart, damped and scaled to length 1; an empty text has none."""
    out = np.zeros((len(texts), TERMS + SHARES), np.float32)
    for a, b in slices(len(texts), [len(t) for t in texts], PART):
        part = [t.encode("utf-8", "surrogatepass") for t in texts[a:b]]
        data = CLASSES[np.frombuffer(b"".join(part), np.uint8)]
        lengths = [len(p) for p in part]
        starts = np.cumsum([0, *lengths[:-1]])
        keep = np.concatenate(([True], (data[1:] != data[:-1]) | (data[1:] > 2)))[: len(data)]
        keep[starts[starts < len(data)]] = True
        stops = np.cumsum(keep)[np.cumsum(lengths) - 1] if len(data) else np.zeros(b - a, np.int64)
        stops[np.cumsum(lengths) == 0] = 0
        data = data[keep]
        for i in range(0, max(0, len(data) - 2), PART):
            own = data[i : i + PART + 2].astype(np.int64)
            owner = np.searchsorted(stops, np.arange(i, i + len(own)), "right")
            inside = owner[:-2] == owner[2:]
            _counted(out[a:b], owner[:-2][inside], ((own[:-2] * 4099 + own[1:-1] * 67 + own[2:]) % FORMS)[inside], 0, FORMS)
        words = shingle_hashes(texts[a:b], 1)
        sizes = [len(w) for w in words]
        if sum(sizes):
            _counted(out[a:b], np.repeat(np.arange(b - a), sizes), (np.concatenate(words) % np.uint64(WORDS)).astype(np.int64), FORMS, WORDS)
    out = np.log1p(out)
    for part in (out[:, :FORMS], out[:, FORMS:TERMS]):
        norm = np.linalg.norm(part, axis=1, keepdims=True)
        part /= np.where(norm > 0, norm, 1) * 2**0.5
    for a, b in slices(len(texts), [len(t) for t in texts], PART):
        for i, runs in enumerate(shingle_hashes(texts[a:b], 4), a):
            if len(runs) > 9:
                again = 1 - len(np.unique(runs)) / len(runs)
                out[i, TERMS + min(SHARES - 1, int(again * SHARES))] = 1.0 if again > 0.05 else 0.0
    return out


class Model(NamedTuple):
    weights: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray


def latent(x: np.ndarray, weights: np.ndarray, basis: np.ndarray) -> np.ndarray:
    v = (x * weights) @ basis
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    return v / np.where(norm > 0, norm, 1)


def fit(x: np.ndarray, labels: np.ndarray, size: int = LATENT) -> Model:
    """Term weights, latent space and labelled vectors; the decomposition is a randomised one of fixed seed."""
    n = len(x)
    weights = np.log((1 + n) / (1 + (x > 0).sum(0))).astype(np.float32)
    weights[TERMS:] = np.maximum(weights[TERMS:], 2)
    y = x * weights
    size = max(1, min(size, *y.shape))
    q = np.random.default_rng(7).standard_normal((y.shape[1], min(size + 16, y.shape[1]))).astype(np.float32)
    for _ in range(4):
        q, _ = np.linalg.qr(y.T @ (y @ q))
    basis = np.ascontiguousarray((q @ np.linalg.svd(y @ q, full_matrices=False)[2].T)[:, :size], np.float32)
    return Model(weights, basis, latent(x, weights, basis), labels.astype(np.float32))


def vote(model: Model, x: np.ndarray, k: int = NEIGHBOURS) -> np.ndarray:
    """Scores from 0 to 1; a text without terms gets 0, and without labelled documents all get 0.5."""
    if not len(model.labels):
        return np.full(len(x), 0.5)
    k = min(k, len(model.labels))
    v, out = latent(x, model.weights, model.basis), np.zeros(len(x))
    for a in range(0, len(x), 1024):
        cos = v[a : a + 1024] @ model.vectors.T
        near = np.argpartition(-cos, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(cos, near, 1), 0).astype(np.float64) ** 8
        total = weight.sum(1)
        out[a : a + 1024] = np.divide((weight * model.labels[near]).sum(1), total, out=np.zeros(len(total)), where=total > 0)
    return out.clip(0, 1)


def labelled_rows(labels: DataFrame, column: str = "quality") -> DataFrame:
    """Labels that may be learnt from: held_out(doc_id) is false."""
    return labels.where(F.col("doc_id").isNotNull() & F.col(column).isin(0, 1) & ~held_out("doc_id")).select("doc_id", F.col(column).cast("int").alias("label"))


def held_out(column: str):
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """The model of at most ``sample`` documents of each label, chosen by a hash of their ids.

    Of contradictory labels the higher one holds; of rows that repeat a doc_id, one text.
    """
    one = labels.groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = [one.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for k in (0, 1)]
    few = F.broadcast(chosen[0].unionAll(chosen[1]))  # 2 * sample rows at most

    def emit(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            x = features([t or "" for t in batch.column("text").to_pylist()])
            rows = [np.flatnonzero(r) for r in x]
            yield pa.record_batch({
                "doc_id": batch.column("doc_id"), "label": batch.column("label"), "terms": pa.array([r.astype(np.uint16).tobytes() for r in rows], pa.binary()),
                "values": pa.array([v[r].tobytes() for v, r in zip(x, rows)], pa.binary()),
            })

    known = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).join(few, "doc_id")
    known = known.groupBy("doc_id", "label").agg(F.min_by("text", F.struct(F.xxhash64("text"), F.length("text"))).alias("text"))
    found = known.mapInArrow(tidy(emit), "doc_id long, label int, terms binary, values binary")
    got = sorted(found.collect(), key=lambda r: r["doc_id"])  # 2 * sample rows at most
    x = np.zeros((len(got), TERMS + SHARES), np.float32)
    for i, r in enumerate(got):
        x[i, np.frombuffer(r["terms"], np.uint16)] = np.frombuffer(r["values"], np.float32)
    if not got:
        return Model(np.ones(TERMS + SHARES, np.float32), np.zeros((TERMS + SHARES, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0, np.float32))
    return fit(x, np.array([r["label"] for r in got]))


def score(docs: DataFrame, model: Model, threshold: float = 0.3, keep: list[str] | None = None, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """docs, or the columns in keep, with score and predicted, or as named (columns of these names are replaced). Null texts count as empty."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in (docs.columns if keep is None else keep) if c not in names]
    schema = StructType([docs.schema[c] for c in keep]).add(names[0], DoubleType()).add(names[1], IntegerType())

    def emit_scores(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            parts = [vote(held.value, features(texts[a : a + 256])) for a in range(0, len(texts), 256)]
            found = np.concatenate([*parts, np.zeros(0)])
            kept = batch.select(keep).append_column(names[0], pa.array(found, pa.float64()))
            yield kept.append_column(names[1], pa.array((found >= threshold).astype(np.int32)))

    return docs.mapInArrow(tidy(emit_scores), schema)


def scored(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """A row per document: doc_id, held_out, score, predicted.

    Trained on the labelled documents among docs that are not held out. Labels,
    lang, source and doc_id are no inputs of a score. Equal texts, of repeated
    rows too, have equal scores. A text without terms scores 0, and all score 0.5
    without labelled documents. Other columns are ignored; an empty table gives
    no rows. Long texts are counted in parts; a task holds a few bytes for each
    of a text's.
    """
    model = train(docs, labelled_rows(labels))
    rows = score(docs.select(F.col("doc_id").cast("long"), "text"), model, threshold, ["doc_id"])
    return rows.select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """docs without the documents that the classifier rejects. Columns of docs may have any names."""
    names = free_name(docs, "score"), free_name(docs, "predicted")
    found = score(docs, train(docs, labelled_rows(labels)), threshold, names=names)
    return found.where(F.col(names[1]) == 1).select(docs.columns)
