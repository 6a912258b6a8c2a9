"""Quality classifier: supervised subword embeddings.

A word's vector is the mean of learned, hashed vectors of the word and of its
character n-grams; a document's vector is the mean over its words, and over one
marker for every three-word window that the text has had before (the only word
n-gram that says anything about texts whose words repeat).  A softmax layer over
the document's vector gives the score.  Vectors and layer are trained together
by stochastic gradient descent in numpy.

Training uses at most ``rows`` labelled documents, half of each label, chosen by
a hash of their ids; scoring reads every whole text.  The layer is linear, so a
scored word needs the layer's value of its vectors only: the model that goes out
is one number per bucket, of fixed size.

Edge cases.  Null and empty texts score by the layer's bias.  Ids labelled twice
count with their lower label; null labels and ids are not learned from.  With
labels of one kind or none, every score is their mean, or 1.  Rows with a null
id are scored and are not held out.  Repeated rows are scored row by row; other
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 17
DIM = 16
GRAMS = (3, 4)
EPOCHS = 6
RATE = 2.0
ROWS = 3000
THRESHOLD = 0.7
FOLDS, HELD_OUT = 4, 2
SEED = 7
_KEEP = 300_000
_AGAIN = b"\0again"


def buckets_of(word: bytes) -> list[int]:
    """Buckets of a word and of its character n-grams, marked at both ends."""
    out = [zlib.crc32(word) % BUCKETS]
    try:
        marked = f"<{word.decode()}>"
    except UnicodeDecodeError:
        return out
    for n in GRAMS:
        out += [zlib.crc32(marked[i : i + n].encode(), n) % BUCKETS for i in range(len(marked) - n + 1)]
    return out


def _bags(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words, each place's word, each document's first place, repeated windows per document."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat = lists.flatten()
    bounds = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    full = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0  # white space at the ends leaves empty strings
    bounds = np.r_[0, np.cumsum(full)][bounds]
    words = flat.filter(pa.array(full)).dictionary_encode()
    codes = words.indices.to_numpy().astype(np.int64)
    again = np.zeros(len(texts), np.int64)
    if len(codes) > 3:
        doc = np.repeat(np.arange(len(texts)), np.diff(bounds))
        with np.errstate(over="ignore"):
            key = doc.astype(np.uint64)
            n = len(codes) - 2
            key = key[:n]
            for k in range(3):
                key = (key ^ codes[k : k + n].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                key ^= key >> np.uint64(31)
        inside = doc[:n] == doc[2:]
        key, doc = key[inside], doc[:n][inside]
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        again = np.bincount(doc[order[1:][same]], minlength=len(texts))
    return words.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist(), codes, bounds, again


def _sparse(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each document as buckets and their weights, which add up to one."""
    words, codes, bounds, again = _bags(texts)
    grams = [np.array(buckets_of(w)) for w in words]
    out = []
    for d in range(len(texts)):
        codes_d, counts = np.unique(codes[bounds[d] : bounds[d + 1]], return_counts=True)
        total = max(1, counts.sum() + again[d])
        index = [grams[c] for c in codes_d] + [np.array([zlib.crc32(_AGAIN) % BUCKETS])]
        weight = [np.full(len(grams[c]), n / len(grams[c]) / total) for c, n in zip(codes_d, counts)] + [np.array([again[d] / total])]
        at, inverse = np.unique(np.concatenate(index), return_inverse=True)
        out.append((at.astype(np.int32), np.bincount(inverse, np.concatenate(weight)).astype(np.float32)))
    return out


def fit(texts: list[str], labels: list[int]) -> tuple[np.ndarray, float]:
    """One number per bucket and the bias: the layer's difference between label 1 and label 0."""
    docs, y = _sparse(pa.array(texts, pa.string())), np.array(labels)
    rng = np.random.default_rng(SEED)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    layer, bias = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
    steps, step = EPOCHS * len(docs), 0
    for _ in range(EPOCHS):
        for d in rng.permutation(len(docs)):
            rate = RATE * (1 - step / steps)
            step += 1
            at, weight = docs[d]
            mean = weight @ vectors[at]
            score = mean @ layer + bias
            p = np.exp(score - score.max())
            p /= p.sum()
            p[y[d]] -= 1
            back = layer @ p
            layer -= rate * np.outer(mean, p)
            bias -= rate * 0.1 * p
            vectors[at] -= (rate * weight)[:, None] * back
    return (vectors @ (layer[:, 1] - layer[:, 0])).astype(np.float32), float(bias[1] - bias[0])


def train(labelled: DataFrame) -> tuple[bytes, float] | float:
    """Fit on ``labelled(text, label)``, which is bounded; a plain mean where one label is missing."""

    def work(batches: Iterable[pd.DataFrame]):
        pdf = pd.concat(list(batches), ignore_index=True) if batches else pd.DataFrame()
        if len(pdf) and pdf["label"].nunique() == 2:
            values, bias = fit(pdf["text"].tolist(), pdf["label"].tolist())
            yield pd.DataFrame([(values.tobytes(), bias)], columns=["values", "bias"])
        else:
            yield pd.DataFrame([(None, float(pdf["label"].mean()) if len(pdf) else 1.0)], columns=["values", "bias"])

    def one(batches):
        pdfs = [b for b in batches if len(b)]
        yield from work(pdfs)

    row = labelled.select("text", "label").coalesce(1).sortWithinPartitions(F.xxhash64("text"), "label").mapInPandas(one, "values binary, bias double").first()
    if row is None:
        return 1.0
    return (bytes(row["values"]), row["bias"]) if row["values"] is not None else row["bias"]


def sample(docs: DataFrame, labels: DataFrame, rows: int = ROWS, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """At most ``rows`` labelled documents outside the held-out fold, half of each label."""
    marks = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    marks = marks.groupBy("doc_id").agg(F.min("label").alias("label")).where(~_held_out(F.col("doc_id")))
    marks = marks.join(docs.select(F.col(doc_id).alias("doc_id")), "doc_id", "left_semi")
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = marks.where("label = 0").orderBy(*order).limit(rows // 2).union(marks.where("label = 1").orderBy(*order).limit(rows - rows // 2))
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    # ``chosen`` has at most ``rows`` rows of two numbers.  Of repeated ids the least text is learned from.
    return texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))


def _held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def _scorer(model: tuple[bytes, float] | float):
    """Function from a string array to scores; it remembers words it has scored."""
    values, bias = (np.frombuffer(model[0], np.float32).tolist(), model[1]) if isinstance(model, tuple) else (None, model)
    memory: dict[bytes, float] = {}

    def value(word: bytes) -> float:
        at = buckets_of(word)
        return sum([values[i] for i in at]) / len(at)

    def scores(texts: pa.Array) -> np.ndarray:
        if values is None:
            return np.full(len(texts), bias)
        out = []
        for at in range(0, len(texts), 2048):
            words, codes, bounds, again = _bags(texts[at : at + 2048])
            if len(memory) > _KEEP:
                memory.clear()
            found = list(map(memory.get, words))
            for i, x in enumerate(found):
                if x is None:
                    found[i] = memory[words[i]] = value(words[i])
            sums = np.r_[0.0, np.cumsum(np.array(found, np.float64)[codes])] if len(codes) else np.zeros(1)
            total = sums[bounds[1:]] - sums[bounds[:-1]] + again * values[zlib.crc32(_AGAIN) % BUCKETS]
            out.append(1 / (1 + np.exp(-(total / np.maximum(1, np.diff(bounds) + again) + bias))))
        return np.concatenate(out) if out else np.zeros(0)

    return scores


def score(docs: DataFrame, model: tuple[bytes, float] | float, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, held_out, score, predicted)``: one row for each input row."""

    def work(batches):
        scores = _scorer(model)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores(batch.column(1)), pa.float64())], ["doc_id", "score"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    scored = rows.mapInArrow(work, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")
    return scored.select("doc_id", _held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep(docs: DataFrame, known: DataFrame, labels: DataFrame, rows: int = ROWS, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """The rows of ``docs``, all columns, that score ``THRESHOLD`` or more.

    The model learns from ``known`` documents: an earlier filter may have taken
    all examples of one label out of ``docs``.
    """
    model = train(sample(known, labels, rows, doc_id, text, label))

    def work(batches):
        scores = _scorer(model)
        for batch in batches:
            yield batch.filter(pa.array(scores(batch.column(batch.schema.get_field_index(text)).cast(pa.string())) >= THRESHOLD))

    return docs.mapInArrow(work, docs.schema)


def classify(docs: DataFrame, labels: DataFrame, rows: int = ROWS, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """Learn from the labelled documents and score all of ``docs``."""
    return score(docs, train(sample(docs, labels, rows, doc_id, text, label)), doc_id, text)
