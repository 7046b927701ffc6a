"""Toxicity by class-conditional Kneser-Ney models.

One model is made from toxic and one from ordinary documents. A word's probability in a class is its continuation
count there (the number of words it follows) less a discount, and what the discounts free goes to the counts of the
word in the whole corpus, which both classes share: a rare expression has much the same probability in both. A text is
scored by its log-likelihood ratio per word. The median ratio of the text's words is taken off first, for it tells the
language and style rather than the tone, and only what a word has beyond a margin counts; the mean of this, and its sum
over the square root of the length, go through a logistic function. The function and the margin, one of MARGINS, are
those that make the labels of labelled documents kept out of the counts likeliest. (Conditioning each word on the one before as well made held-out results worse.)

Words are told apart by 64-bit hashes, and no two share a count. A table in the shared folder has every word of the corpus with
its count and its continuation counts. A word whose counts in both classes don't exceed the discount has the shared probability
times a class's freed mass, so that its ratio is one constant whatever its count; only the other words make up the model that is
broadcast. Each of these follows more than DISCOUNT different words in the learned documents, so that at 12 bytes a word the model has at
most 4 bytes for each of their words; it doesn't grow with the documents that have no label.
Class counts come from at most SAMPLE labelled rows, chosen by a hash of doc_id; the shared counts come from all documents.

Defined results: a null or empty text, and one without words, scores as one with no toxic word; without labelled
documents of both classes every score is 0; of a doc_id labelled both ways the toxic label counts; null labels and ids
are ignored; repeated rows score alike; an empty table gives no rows; other columns pass, but for those named as an added one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD_BYTES, append_columns, fresh, give_back, held_out, materialize, small_batches, table, texts_of

DISCOUNT, MARGINS, SAMPLE = 2.0, (2.0, 1.5, 1.0), 20_000
LIMIT = 0.5


def _words(text: bytes | None) -> list[bytes]:
    return text.decode("utf-8", "replace").lower().encode().translate(WORD_BYTES).split() if text else []


def word_hash(word: bytes) -> int:
    """64 bits, signed."""
    from xxhash import xxh3_64_intdigest

    return xxh3_64_intdigest(word) - (1 << 63)


class _Known(dict):
    """A number of each word; remembers a bounded number of words."""

    def __init__(self, number, kind):
        self.number, self.kind = number, kind

    def __missing__(self, word: bytes):
        found = self.number(word)
        if len(self) < 150_000:
            self[word] = found
        return found

    def of(self, text: bytes | None) -> np.ndarray:
        words = _words(text)
        return np.fromiter(map(self.__getitem__, words), self.kind, len(words))


@dataclass
class Model:
    words: np.ndarray  #: hashes of the words with a ratio of their own, in order
    ratio: np.ndarray  #: log ratio, toxic over ordinary, of each of them
    other: float  #: and of every other word
    margin: float
    weights: tuple[float, float, float]  #: constant and weights of features()

    def ratios(self) -> _Known:
        def of(word):
            h = word_hash(word)
            k = int(np.searchsorted(self.words, h))
            return float(self.ratio[k]) if k < len(self.words) and self.words[k] == h else self.other

        return _Known(of, np.float32)


def features(ratios: np.ndarray, margins: tuple[float, ...]) -> list[float]:
    """Mean and scaled sum of what the words' ratios have beyond the text's median and each margin."""
    if not len(ratios):
        return [0.0] * (2 * len(margins))
    beyond = ratios - np.median(ratios)
    totals = [float(np.maximum(beyond - m, 0).sum(dtype=np.float64)) for m in margins]
    return [x for t in totals for x in (t / len(beyond), t / (len(beyond) + 20) ** 0.5)]


def _count(batches):
    """(kind, word, before, n): 0, a word and its count; 1 (ordinary) or 2 (toxic), a word after another in documents to learn from, once a flush."""
    known, held, size = _Known(word_hash, np.int64), {0: [], 1: [], 2: []}, 0

    def closed():
        if held[0]:
            words, n = np.unique(np.concatenate(held[0]), return_counts=True)
            yield from _rows(0, words, np.zeros(len(words), np.int64), n)
        for kind in (1, 2):
            if held[kind]:
                w, before = np.concatenate(held[kind], axis=1)
                order = np.lexsort((before, w))
                w, before = w[order], before[order]
                new = np.r_[True, (w[1:] != w[:-1]) | (before[1:] != before[:-1])]
                yield from _rows(kind, w[new], before[new], np.ones(int(new.sum()), np.int64))
        for rows in held.values():
            rows.clear()

    for batch in batches:
        labels = batch.column("_label").to_pylist()
        for text, label in zip(texts_of(batch.column("text")), labels, strict=True):
            w = known.of(text)
            if not len(w):
                continue
            held[0].append(w)
            if label is not None:
                held[1 + label].append(np.stack([w, np.r_[np.int64(0), w[:-1]]]))  # 0: the text's start
            size += len(w)
            if size > 1_000_000:
                yield from closed()
                size = 0
    yield from closed()
    known.clear()
    held = batch = labels = None
    give_back()


def _rows(kind: int, words: np.ndarray, before: np.ndarray, n: np.ndarray):
    for at in range(0, len(words), 100_000):
        w, b, c = (x[at : at + 100_000] for x in (words, before, n))
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(w), kind, np.int32)), pa.array(w), pa.array(b), pa.array(c)], names=["kind", "word", "before", "n"])


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Newton steps with a weak prior on standardised features."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    a = np.c_[np.ones(len(x)), (x - mean) / scale]
    w = np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        prior = np.array([0, 0.01, 0.01])
        w += np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(prior + 1e-6), a.T @ (y - p) - prior * w)
    inner = w[1:] / scale
    return float(w[0] - inner @ mean), float(inner[0]), float(inner[1])


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic", where: Column | None = None, sample: int = SAMPLE) -> Model | None:
    """Learn from the labelled documents that meet `where` (a condition on labels); None without both classes."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull())
    rows = rows.where(where) if where is not None else rows
    rows = rows.groupBy(F.col(doc_id).alias("_id")).agg(F.max(label).cast("int").alias("_y"))
    rows = rows.orderBy(F.xxhash64("_id"), "_id").limit(sample)
    # At most `sample` pairs of numbers come here and go back as a broadcast.
    chosen = spark.createDataFrame([(r["_id"], r["_y"]) for r in rows.collect()], f"_id {dict(labels.dtypes)[doc_id]}, _y int")
    chosen = chosen.withColumn("_check", F.pmod(F.xxhash64("_id", F.lit("check")), F.lit(4)) == 0)
    both = docs.select(F.col(doc_id).alias("_doc"), F.col(text).alias("text")).join(F.broadcast(chosen), F.col("_doc") == F.col("_id"), "left")
    counted = both.select("text", F.when(~F.col("_check"), F.col("_y")).alias("_label")).mapInArrow(_count, "kind int, word long, before long, n long")
    counted = counted.groupBy("kind", "word", "before").agg(F.sum("n").alias("n"))
    times = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("n") if kind == 0 else 1).otherwise(0))
    counted = materialize(counted.groupBy("word").agg(*(times(k).alias(f"n{k}") for k in range(3))), "words")
    n = [float(x or 0) for x in counted.agg(F.sum("n0"), F.sum("n1"), F.sum("n2")).first()]
    if not n[1] or not n[2]:
        return None
    got = counted.where((F.col("n1") > DISCOUNT) | (F.col("n2") > DISCOUNT)).toArrow()  # the words of the model
    words, *counts = (got.column(c).to_numpy() for c in ("word", "n0", "n1", "n2"))
    order = np.argsort(words)
    words, counts = words[order], [c[order].astype(float) for c in counts]
    shared, log, other = counts[0] / n[0], [], []
    for c, total in zip(counts[1:], n[1:], strict=True):
        kept = np.maximum(c - DISCOUNT, 0) / total
        log.append(np.log(kept + (1 - kept.sum()) * shared))
        other.append(np.log(1 - kept.sum()))
    ratio, other = (log[1] - log[0]).astype(np.float32), float(other[1] - other[0])

    sent = spark.sparkContext.broadcast(Model(words, ratio, other, 0.0, (0.0, 0.0, 0.0)))

    names = [f"x{k}" for k in range(2 * len(MARGINS))]

    def measure(batches):
        ratios = sent.value.ratios()
        for batch in batches:
            x = np.array([features(ratios.of(t), MARGINS) for t in texts_of(batch.column("text"))]).reshape(-1, len(names))
            yield pa.RecordBatch.from_arrays([*(pa.array(x[:, k]) for k in range(len(names))), batch.column("_y")], names=[*names, "y"])

    schema = ", ".join(f"{n} double" for n in names) + ", y int"
    # One text an id: part of the sample comes to the driver, however often an id is repeated.
    once = both.where("_check").groupBy("_id").agg(F.min("_y").alias("_y"), F.min_by("text", F.xxhash64("text")).alias("text"))
    checked = once.select("text", "_y").mapInArrow(measure, schema).toArrow()
    rows = np.array(sorted(zip(*(checked.column(c).to_pylist() for c in (*names, "y")), strict=True)), float).reshape(-1, len(names) + 1)
    x, y = rows[:, :-1], rows[:, -1]
    if len(set(y.tolist())) < 2:
        return Model(words, ratio, other, MARGINS[-1], (-4.0, 40.0, 2.0))  # too few documents to fit: a few toxic words in a hundred decide
    tried = []
    for k, margin in enumerate(MARGINS):
        pair = x[:, 2 * k : 2 * k + 2]
        weights = _logistic(pair, y)
        p = np.clip(_chance(weights, pair), 1e-9, 1 - 1e-9)
        tried.append((-float((y * np.log(p) + (1 - y) * np.log(1 - p)).sum()), k, Model(words, ratio, other, margin, weights)))
    return min(tried, key=lambda t: t[:2])[2]


def _chance(weights: tuple[float, float, float], x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(weights[0] + x @ np.array(weights[1:]), -30, 30)))


def score(docs: DataFrame, model: Model | None, text: str = "text", keep_text: bool = True, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """Add score (0 to 1) and predicted (0 or 1) to every document."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        found = sent.value
        ratios = found.ratios() if found else None

        def work(column: pa.Array) -> list[pa.Array]:
            if found is None:
                scores = np.zeros(len(column))
            else:
                x = np.array([features(ratios.of(t), (found.margin,)) for t in texts_of(column)]).reshape(-1, 2)
                scores = _chance(found.weights, x)
            return [pa.array(scores), pa.array((scores >= LIMIT).astype(np.int32))]

        return work

    fields = [T.StructField(names[0], T.DoubleType()), T.StructField(names[1], T.IntegerType())]
    return append_columns(docs, text, fields, make, drop=() if keep_text else (text,))


def learnable(doc_id: str = "doc_id") -> Column:
    """Rows with crc32(doc_id) mod 5 = 0 are held out."""
    return ~held_out(F.col(doc_id), 5, 0)


def remove_toxic(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The documents that aren't predicted toxic, with the columns of docs."""
    model = fit(docs, labels, text, doc_id, where=learnable(doc_id))
    value, toxic = fresh(docs, "_score", "_toxic")
    return score(docs, model, text, names=(value, toxic)).where(F.col(toxic) == 0).select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"), where=learnable())
    found = score(docs, model, keep_text=False)
    return found.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", "predicted")
