"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text, each present or not: its words, their stems (the first four
letters, which carry over to endings not yet seen), pairs of neighbouring words
and pairs with one word between, hashed to 2^20 places. FTRL-proximal keeps a sum of
gradients and of their squares for each place: every place has a learning rate of
its own, and the L1 term holds a weight at exactly zero until its evidence exceeds
it. Most of what only a few texts happen to hold gets no weight, so the model is small:
numbers, which are broadcast (never more than 2^20).

Training uses at most ``rows`` labelled rows, those whose ids have the smallest
hashes. Their ids, bounded by that number, pick the texts by a broadcast join;
features are made where the texts are, and one task takes the rows in hash order.
Scoring is one pass over all texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Table, map_arrow

BITS = 20
#: Most labelled rows that a model is trained on.
TRAIN_ROWS = 8000
#: Chosen on rows that aren't held out: trained on those whose remainder is 0, compared on those with 2.
ALPHA, BETA, L1, L2 = 5.0, 1.0, 3.0, 0.0
#: What a toxic row counts, which is the rarer kind.
TOXIC_WEIGHT = 2
EPOCHS = 8
THRESHOLD = 0.7
SEED = 5
_STEM = 4
_KEEP = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
_CACHE = 1 << 19
#: A text is hashed in runs of so many words; runs share the words that pairs need.
_RUN = 1 << 14


class _Hashes(dict):
    """Words to (hash of the word, hash of its stem); forgets all when it has grown too large."""

    def __missing__(self, word: bytes) -> tuple[int, int]:
        if len(self) >= _CACHE:
            self.clear()
        stem = word.decode("utf-8", "replace")[:_STEM].encode()
        pair = self[word] = (xxhash.xxh64_intdigest(word, SEED) >> 1, xxhash.xxh64_intdigest(stem, SEED + 1) >> 1)
        return pair


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return (h >> np.uint64(64 - BITS)).astype(np.int64)


def places(text: str | None, cache: dict) -> Iterator[np.ndarray]:
    """Places of a text's features, repeats included, a run of words at a time. Null and empty texts have none."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_KEEP).split()
    for k in range(0, len(words), _RUN):
        both = np.array([cache[w] for w in words[k : k + _RUN + 2]], np.int64).astype(np.uint64).reshape(-1, 2)
        w, mine = both[:, 0], both[: _RUN]
        five = np.uint64(5)
        pairs = (w[:-1] * five + w[1:] + np.uint64(1))[:_RUN]
        skips = (w[:-2] * five + w[2:] + np.uint64(2))[:_RUN]
        yield _mixed(np.concatenate([mine[:, 0], mine[:, 1], pairs, skips]))


class Ftrl:
    """FTRL-proximal logistic regression over sets of places; place 2^BITS is the intercept, without L1."""

    def __init__(self) -> None:
        n = (1 << BITS) + 1
        self.z, self.n = np.zeros(n), np.zeros(n)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, bias = self.z[at], at == 1 << BITS
        over = np.where(bias, np.abs(z), np.maximum(np.abs(z) - L1, 0))
        return -np.sign(z) * over / ((BETA + np.sqrt(self.n[at])) / ALPHA + np.where(bias, 0, L2))

    def learn(self, at: np.ndarray, value: np.ndarray, label: int) -> None:
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(w @ value, -35, 35)))
        g = (p - label) * value * (TOXIC_WEIGHT if label else 1)
        old = self.n[at]
        self.n[at] = new = old + g * g
        self.z[at] += g - (np.sqrt(new) - np.sqrt(old)) / ALPHA * w


def _featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cache = _Hashes()
    for b in batches:
        found = [np.unique(np.concatenate([np.empty(0, np.int64), *places(t, cache)])).astype(np.int32) for t in b.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.list_(pa.int32()))], names=["turn", "label", "places"])


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(turn, label, places) in order; out (place, weight) of the weights that are not zero, the intercept's place last."""
    labels, sets = [], []
    for b in batches:
        labels += b.column(1).to_pylist()
        for x in b.column(2):
            sets.append(np.asarray(x.values, np.int32))
    seen = np.zeros(1 << BITS, np.int32)
    for s in sets:
        seen[s] += 1
    # a place weighs less the more texts have it
    rare = np.clip(np.log((len(sets) + 1) / np.maximum(seen, 1)) / np.log(max(len(sets), 2) / 2 + 1), 0, 1)
    model, bias = Ftrl(), np.array([1 << BITS])
    for _ in range(EPOCHS):
        for s, label in zip(sets, labels):
            model.learn(np.concatenate([s, bias]), np.append(rare[s], 1.0), label)
    w = model.weights(np.arange((1 << BITS) + 1))
    w[:-1] *= rare
    at = np.flatnonzero(w)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(w[at])], names=["place", "weight"])


def _held_out(id_col: str):
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(3)) == 1


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = TRAIN_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """(places, weights) learned from labelled rows that aren't held out. No usable label: no weights, every score is 0.5."""
    ids = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull() & ~_held_out(id_col)).select(F.col(id_col).alias("id"), (F.col(label) > 0).cast("int").alias("label"), F.xxhash64(F.lit(SEED), F.col(id_col)).alias("turn"))
    ids = Table(ids.orderBy("turn", "id", "label").limit(rows), "labelled").df
    texts = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).join(F.broadcast(ids), "id").select("turn", "label", "text")
    sets = Table(map_arrow(texts, _featurize, "turn long, label int, places array<int>"), "places").df
    # of repeated rows of one id and label one is taken, so that there are no more than the bound
    one = sets.groupBy("turn", "label").agg(F.min(F.struct(F.xxhash64("places").alias("h"), "places")).alias("p")).select("turn", "label", "p.places")
    found = map_arrow(one.repartition(1).sortWithinPartitions("turn", "label"), _train, "place long, weight double").toPandas()
    return found["place"].to_numpy(), found["weight"].to_numpy()


def _scorer(at: np.ndarray, weight: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((1 << BITS) + 1)
        table[at] = weight
        has, bias, cache = table != 0, table[-1], _Hashes()
        for b in batches:
            k = b.schema.get_field_index("__text")
            scores = []
            for t in b.column(k).to_pylist():
                found = [p[has[p]] for p in places(t, cache)]
                x = table[np.unique(np.concatenate(found))].sum() + bias if found else bias
                scores.append(1 / (1 + np.exp(-np.clip(x, -35, 35))))
            rest = [j for j in range(b.num_columns) if j != k]
            yield pa.RecordBatch.from_arrays([*(b.column(j) for j in rest), pa.array(scores, pa.float64())], names=[*(b.schema.names[j] for j in rest), "__score"])

    return run


def _scored(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], text: str) -> DataFrame:
    """Columns c0.. of ``docs`` and ``__score``, the probability of toxicity from its text alone."""
    names = [f"c{k}" for k in range(len(docs.columns))]
    held = docs.toDF(*names).withColumn("__text", F.col(names[docs.columns.index(text)]))
    schema = T.StructType([*held.drop("__text").schema.fields, T.StructField("__score", T.DoubleType())])
    return map_arrow(held, _scorer(*model), schema)


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = TRAIN_ROWS) -> DataFrame:
    """(id, held_out, score, predicted) of every row.

    held_out: crc32 of the id as text leaves 1 modulo 3 (null ids: false; they never train).
    Null and empty texts get the intercept's score. Labels that are null don't count; a
    label over 0 is toxic. Repeated rows get equal scores; an empty table gives no rows; further columns are ignored, whatever their names.
    """
    model = train(docs, labels, id_col, text, label, rows)
    out = _scored(docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")), model, "text")
    return out.select(F.col("c0").alias(id_col), F.coalesce(_held_out("c0"), F.lit(False)).alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = TRAIN_ROWS) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose score is under the threshold."""
    model = train(docs, labels, id_col, text, label, rows)
    return _scored(docs, model, text).where(F.col("__score") < THRESHOLD).drop("__score").toDF(*docs.columns)
