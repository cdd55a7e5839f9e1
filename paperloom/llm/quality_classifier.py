"""Operator 9: quality classification with supervised subword embeddings.

A document is the mean of the learned vectors of its words, word pairs and character 3- and 4-grams, each hashed to a row of
one table; a softmax over the mean gives the class. The table and the softmax are trained by stochastic gradient descent
in numpy on a bounded sample of labelled documents (by default at most 2 x 2000, the parameters per_class and max_chars).
Everything else covers all documents: as the model is linear in the mean, the table is folded to one number per row, and
each document is scored in one scan of its whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._spark import beside, bounded_batches, renamed
from ._text import SPACE_WORD, blocks, column_bytes, mix, ranges, word_bounds, word_hashes

_U = np.uint64
#: Neutral features that each document has besides its own, so that a few words decide little.
NEUTRAL = 40
_STEP = np.uint32(0x01000193)


def _characters(d: np.ndarray, o: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of a block's texts, white space being blanks, and their bounds. A text that is not UTF-8 counts by bytes."""
    try:
        code = np.frombuffer(d.tobytes().decode().encode("utf-32-le"), np.uint32).copy()
        o = np.concatenate([[0], np.cumsum((d & 0xC0) != 0x80)])[o]
    except UnicodeDecodeError:
        if len(o) == 2:
            code = d.astype(np.uint32)
        else:
            each = [_characters(d[a:b], np.array([0, b - a]))[0] for a, b in zip(o[:-1].tolist(), o[1:].tolist(), strict=True)]
            code, o = np.concatenate(each), np.concatenate([[0], np.cumsum([len(x) for x in each])])
    code[(code >= 9) & (code <= 13)] = 0x20
    return code, o


def features(d: np.ndarray, o: np.ndarray, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows of the table, bounds of each document) of the words, word pairs, 3-grams and 4-grams of a block."""
    s, e, words = word_bounds(d, o, SPACE_WORD)
    h, down = word_hashes(d, s, e), _U(64 - bits)
    out = [((h >> down).astype(np.int64), words)]
    pair = mix(h[:-1] * _U(3) + h[1:]) >> down
    pair[h[:-1] == h[1:]] = 0  # row 0: a word that repeats the one before it
    inner = np.ones(len(pair), bool)
    inner[words[1:-1][(words[1:-1] > 0) & (words[1:-1] < len(h))] - 1] = False
    out.append((pair[inner].astype(np.int64), np.concatenate([[0], np.cumsum(np.maximum(np.diff(words) - 1, 0))])))
    code, o = _characters(d, o)
    gram = code.copy()
    for n in (2, 3, 4):
        size = max(0, len(code) - n + 1)
        gram = gram[:size] * _STEP ^ code[n - 1 : n - 1 + size]
        if n > 2:
            count = np.maximum(np.diff(o) - n + 1, 0)
            row = (gram * np.uint32(0x9E3779B1) + np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)) >> np.uint32(32 - bits)
            out.append((row[ranges(o[:-1], count)].astype(np.int64), np.concatenate([[0], np.cumsum(count)])))
    return out


class QualityModel:
    """One number per row of the table, and a bias: the log odds of class 1 are the mean of a document's (and NEUTRAL zeros) plus the bias."""

    def __init__(self, weights: np.ndarray, bias: float, bits: int) -> None:
        self.weights, self.bias, self.bits = weights, bias, bits

    def score(self, d: np.ndarray, o: np.ndarray) -> np.ndarray:
        total, count = np.zeros(len(o) - 1), np.zeros(len(o) - 1)
        for rows, bounds in features(d, o, self.bits):
            sums = np.concatenate([[0.0], np.cumsum(self.weights[rows], dtype=np.float64)])
            total += sums[bounds[1:]] - sums[bounds[:-1]]
            count += np.diff(bounds)
        return 1 / (1 + np.exp(-np.clip(total / (count + NEUTRAL) + self.bias, -60, 60)))


def fit(texts: list[str], labels: list[int], bits: int = 17, width: int = 8, epochs: int = 12, rate: float = 2.0, seed: int = 1, prior: float | None = None) -> QualityModel:
    """Embeddings and softmax by gradient descent, one document at a time; the rarer class counts somewhat more.

    prior: the log odds of class 1 where a document says nothing; by default those of the sample.
    """
    random = np.random.default_rng(seed)
    table = ((random.random((1 << bits, width)) - 0.5) / width).astype(np.float32)
    y = np.array(labels, np.int64)
    if prior is None:
        prior = float(np.log((np.count_nonzero(y == 1) + 1) / (np.count_nonzero(y == 0) + 1)))
    out, bias = np.zeros((2, width), np.float32), np.array([0, prior], np.float32)
    share = np.sqrt(len(y) / (2 * np.maximum(np.bincount(y, minlength=2), 1)))
    bags = []
    for text in texts:
        data, offsets = column_bytes(pa.array([text], pa.large_string()))
        rows = np.concatenate([r for r, _ in features(data, offsets, bits)])
        ids, count = np.unique(rows, return_counts=True)
        bags.append((ids.astype(np.int32), (count / (len(rows) + NEUTRAL)).astype(np.float32)))
    steps, step = max(1, epochs * len(bags)), 0
    for _ in range(epochs):
        for k in random.permutation(len(bags)).tolist():
            ids, part = bags[k]
            now = rate * (1 - step / steps)
            step += 1
            mean = part @ table[ids]
            logits = out @ mean + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[y[k]] -= 1
            p *= now * share[y[k]]
            back = p @ out
            out -= np.outer(p, mean)
            # a document's mean moves by sum(part ** 2) of a step; so every row's step is scaled to move it by one
            table[ids] -= np.outer(part / max(float(part @ part), 1e-6), back) * np.float32(0.1)
    return QualityModel((table @ (out[1] - out[0])).astype(np.float32), float(bias[1] - bias[0]), bits)


def train_quality(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_class: int = 2000, max_chars: int = 100_000, **options) -> QualityModel:
    """A model of label 1 against label 0, from a bounded sample of labelled documents.

    The sample has at most per_class ids of each label, those whose hash is least, and of these the documents of at most
    max_chars characters, whole; the prior is that of all labels. Labels that are null or neither 0 nor 1 and null ids count for nothing.
    Without usable labels the model is the prior. One task holds the sample and learns; the driver gets the model only. Ids are whole numbers, or text of such; any other id ends the job with Spark's
    CAST_INVALID_INPUT. The chosen ids are broadcast: 2 x per_class at most.
    """
    bounded_batches(documents.sparkSession)
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).where("id IS NOT NULL")
    order = F.xxhash64("id", F.lit(9))
    chosen = None
    counts = dict(known.where("label IN (0, 1)").groupBy("label").count().collect())
    prior = float(np.log((counts.get(1, 0) + 1) / (counts.get(0, 0) + 1)))
    for label in (0, 1):
        own = known.where(F.col("label") == label).distinct().orderBy(order, "id").limit(per_class)
        chosen = own if chosen is None else chosen.union(own)
    texts = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where(F.length("text") <= max_chars)
    rows = texts.join(F.broadcast(chosen), "id").groupBy("id", "label").agg(F.min("text").alias("text"))  # 2 x per_class rows at most
    found = rows.repartition(1).mapInArrow(_fitted(prior, options), "weights binary, bias double, bits int").collect()
    if not found:
        return fit([], [], prior=prior, **options)
    return QualityModel(np.frombuffer(found[0]["weights"], np.float32), found[0]["bias"], found[0]["bits"])


def _fitted(prior: float, options: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True)), key=lambda r: r[:2])
        model = fit([r[2] for r in rows], [r[1] for r in rows], prior=prior, **options)
        yield pa.RecordBatch.from_arrays([pa.array([model.weights.tobytes()], pa.binary()), pa.array([model.bias]), pa.array([model.bits], pa.int32())], names=["weights", "bias", "bits"])

    return run


def _scorer(model, n_carried: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column_bytes(batch.column(n_carried))
            scores = [model.value.score(d, o) for _, _, d, o in blocks(data, offsets)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n_carried], pa.array(np.concatenate(scores) if scores else np.empty(0))], names=[*batch.schema.names[:n_carried], "__score"])

    return run


def score_quality(documents: DataFrame, model: QualityModel, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """documents' columns (or those in carry) and `__score`: the probability of label 1, from the whole text and nothing else.

    Null and empty texts get the score of the bias; repeated rows are scored alike; other columns are carried along as they
    are, but one named __score gets underscores in front; an empty table gives an empty result. A text is held whole in one task.
    """
    carry = documents.columns if carry is None else carry
    return renamed(_scored(documents, model, text_col, carry), beside(carry, "__score"), "__score")


def _scored(documents: DataFrame, model: QualityModel, text_col: str, carry: list[str]) -> DataFrame:
    """The columns in carry as c0, c1 ..., and __score."""
    bounded_batches(documents.sparkSession)
    names = [f"c{k}" for k in range(len(carry))]
    source = documents.select(*[F.col(f"`{c}`").alias(n) for n, c in zip(names, carry, strict=True)], F.col(f"`{text_col}`").cast("string").alias("__text"))
    schema = T.StructType([*source.schema.fields[:-1], T.StructField("__score", T.DoubleType())])
    return source.mapInArrow(_scorer(documents.sparkSession.sparkContext.broadcast(model), len(carry)), schema)


def keep_good(documents: DataFrame, model: QualityModel, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """documents whose score is `least` or more; all columns stay, whatever their names. See score_quality."""
    return renamed(_scored(documents, model, text_col, documents.columns).where(F.col("__score") >= least), documents.columns)


def is_held_out(id_col: str):
    """Rows that no label is learned from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _model(spark, sf_dir: str, documents: DataFrame) -> QualityModel:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return train_quality(documents, labels.where(~is_held_out("doc_id")))


def op9_quality_classifier(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    done = score_quality(documents, _model(spark, sf_dir, documents), carry=["doc_id"])
    return done.select("doc_id", is_held_out("doc_id").alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= 0.5).cast("int").alias("predicted"))
