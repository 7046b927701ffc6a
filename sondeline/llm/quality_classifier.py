"""Quality classifier: nearest-neighbour voting on latent-semantic vectors.

A text's terms are its byte bigrams, in TERMS cells, and three terms of repetition (words like the one before, words
and lines that occurred before), which weigh REPETITION times. Counts become log(1 + count) times the inverse
document frequency over all documents, and are projected on the first RANK right singular vectors of the labelled
documents' matrix. The labelled vectors are broadcast - at most SAMPLE of them, chosen by a hash of doc_id, so BROADCAST_BYTES at
most - and exact cosines of every document with all of them are computed in blocks. The NEAREST neighbours vote, and with them
all that are as near as the last of these (within TIE), each weighing its cosine to the power of SHARPNESS.

Defined results: a null text and one of fewer than two bytes scores 0; without a labelled document every score is 0;
of a doc_id labelled both ways the low label counts; null labels and ids are ignored; of repeated labelled ids one text is learned; repeated rows score alike; an
empty table gives no rows; other columns pass, but for those named as an added one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, held_out, small_batches, table, texts_of

TERMS, REPETITION, RANK, SAMPLE = 4096, 3.0, 64, 4096
NEAREST, SHARPNESS, BLOCK, LIMIT, TIE = 31, 32, 256, 0.7, 1e-6
WIDTH = TERMS + 3
BROADCAST_BYTES = 4 * (WIDTH * (RANK + 1) + SAMPLE * (RANK + 1))


@dataclass
class Model:
    weights: np.ndarray  #: of each term
    basis: np.ndarray  #: WIDTH x RANK
    vectors: np.ndarray  #: of the labelled documents, of length 1
    labels: np.ndarray


def counts(text: bytes | None) -> np.ndarray:
    """Term counts of one text."""
    out = np.zeros(WIDTH, np.float32)
    if text and len(text) > 1:
        b = np.frombuffer(text, np.uint8).astype(np.uint32)
        out[:TERMS] = np.bincount((b[:-1] << np.uint32(8) | b[1:]) * np.uint32(2654435761) >> np.uint32(20), minlength=TERMS)
        words, lines = text.split(), text.split(b"\n")
        out[TERMS:] = sum(map(bytes.__eq__, words, words[1:])), len(words) - len(set(words)), len(lines) - len(set(lines))
    return out


def _logs(texts: list[bytes | None]) -> np.ndarray:
    return np.log1p(np.array([counts(t) for t in texts], np.float32).reshape(-1, WIDTH))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _frequencies(batches):
    """(term, docs): documents that have the term; term -1 counts all."""
    docs, total = np.zeros(WIDTH, np.int64), 0
    for batch in batches:
        texts = texts_of(batch.column("text"))
        for t in texts:
            docs += counts(t) > 0
        total += len(texts)
    terms = np.arange(-1, WIDTH, dtype=np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(terms), pa.array(np.r_[total, docs])], names=["term", "docs"])


def _measured(batches):
    for batch in batches:
        texts = texts_of(batch.column("text"))
        for at in range(0, len(texts), BLOCK):
            rows = [x.tobytes() for x in _logs(texts[at : at + BLOCK]).astype(np.float16)]
            yield pa.RecordBatch.from_arrays([batch.column("_y")[at : at + BLOCK], pa.array(rows, pa.binary())], names=["y", "x"])


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality", where: Column | None = None, sample: int = SAMPLE) -> Model | None:
    """Learn from the labelled documents that meet `where` (a condition on labels); None where there are none."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col(doc_id).alias("_doc"), F.col(text).alias("text"))
    summed = texts.select("text").mapInArrow(_frequencies, "term long, docs long").groupBy("term").agg(F.sum("docs").alias("docs")).toArrow()
    found = dict(zip(summed.column("term").to_pylist(), summed.column("docs").to_pylist(), strict=True))  # WIDTH + 1 numbers
    total = found.get(-1, 0)
    weights = np.array([np.log((1 + total) / (1 + found.get(k, 0))) + 1 for k in range(WIDTH)], np.float32)
    weights[TERMS:] *= REPETITION

    rows = labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull())
    rows = rows.where(where) if where is not None else rows
    rows = rows.groupBy(F.col(doc_id).alias("_id")).agg(F.min(label).cast("int").alias("_y")).orderBy(F.xxhash64("_id"), "_id").limit(sample)
    chosen = spark.createDataFrame([(r["_id"], r["_y"]) for r in rows.collect()], f"_id {dict(labels.dtypes)[doc_id]}, _y int")
    # One text an id, so that at most `sample` rows of a few KB come to the driver however often an id is repeated.
    labelled = texts.join(F.broadcast(chosen), F.col("_doc") == F.col("_id")).groupBy("_id").agg(F.min("_y").alias("_y"), F.min_by("text", F.xxhash64("text")).alias("text"))
    got = labelled.select("text", "_y").mapInArrow(_measured, "y int, x binary").toArrow()
    if not got.num_rows:
        return None
    rows = sorted(zip(got.column("x").to_pylist(), got.column("y").to_pylist(), strict=True))
    x = np.array([np.frombuffer(r, np.float16) for r, _ in rows]).astype(np.float32) * weights
    y = np.array([y for _, y in rows], np.float32)
    x = _unit(x)
    basis = np.random.default_rng(1).normal(size=(WIDTH, RANK + 16)).astype(np.float32)
    for _ in range(4):
        basis = np.linalg.qr(x.T @ (x @ basis))[0]
    _, _, right = np.linalg.svd(x @ basis, full_matrices=False)
    basis = np.ascontiguousarray((basis @ right.T)[:, :RANK], np.float32)
    return Model(weights, basis, _unit(x @ basis).astype(np.float32), y)


def vote(model: Model, texts: list[bytes | None]) -> np.ndarray:
    """Scores of a block of texts."""
    x = _logs(texts) * model.weights
    cosines = _unit(x @ model.basis) @ model.vectors.T
    k = min(NEAREST, len(model.labels))
    last = -np.partition(-cosines, k - 1, axis=1)[:, k - 1 : k]
    row, near = np.nonzero((cosines >= last - TIE) & (cosines > 0))
    weight = cosines[row, near].astype(np.float64) ** SHARPNESS
    total = np.bincount(row, weight, len(texts))
    scores = np.bincount(row, weight * model.labels[near], len(texts)) / np.maximum(total, 1e-300)
    return np.where((total > 0) & x.any(1), np.clip(scores, 0, 1), 0.0)


def score(docs: DataFrame, model: Model | None, text: str = "text", keep_text: bool = True) -> DataFrame:
    """Add score (0 to 1, higher: label 1 is likelier) and predicted (0 or 1) to every document."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        found = sent.value

        def work(column: pa.Array) -> list[pa.Array]:
            texts, scores = texts_of(column), np.zeros(len(column))
            for at in range(0, len(texts) if found else 0, BLOCK):
                scores[at : at + BLOCK] = vote(found, texts[at : at + BLOCK])
            return [pa.array(scores), pa.array((scores >= LIMIT).astype(np.int32))]

        return work

    fields = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    return append_columns(docs, text, fields, make, drop=() if keep_text else (text,))


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"), where=~held_out(F.col("doc_id"), 4, 2))
    found = score(docs, model, keep_text=False)
    return found.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score", "predicted")
