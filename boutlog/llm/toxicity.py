"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A text is the bag of its words and their character 3- to 5-grams (with marks at both ends), lower-cased.
Each is hashed to one of ``buckets`` embeddings; their average goes through a linear softmax of two
classes. Embeddings and softmax are trained together (AdaGrad on the log-loss), so a misspelling never
seen shares the vectors of its n-grams. Because everything after the lookup is linear, scoring needs
one number a bucket: the embedding times the difference of the classes' weights.

Fit on at most ``sample`` labelled rows (half of each class where there are enough), scored on every row
where it is read.

Null and empty texts, and those without a letter or digit, get the score of the bias alone. Without labelled rows
every score is 0.5. An id with two labels counts as toxic. Rows without id are scored, never learnt from, and their held_out is
null. Repeated rows are scored alike; an empty table gives no rows; other columns are not looked at. A very long text is held
whole in the task that reads it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from boutlog.llm.sampling import first_by_hash, remainder, texts_of
from boutlog.llm.textkit import Block, texts

BITS, DIM, GRAMS, SAMPLE = 18, 8, (3, 4, 5), 4000
_GAP = np.ones(256, bool)
_GAP[48:58] = _GAP[97:123] = _GAP[128:] = False
_BLANK = np.where(_GAP, 32, np.arange(256)).astype(np.uint8)


class _Bag(Block):
    """Blocks whose gaps are all bytes but letters and digits, each alike."""

    def __init__(self, held: list[bytes]):
        super().__init__([b" " + x for x in held])
        self.data = _BLANK[self.data]

    def buckets(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(begins in the data, buckets) of the words, then of the n-grams of each length."""
        gap = self.data == 32
        begins = np.flatnonzero(gap[:-1] & ~gap[1:]) + 1
        ends = np.flatnonzero(~gap[:-1] & gap[1:]) + 1
        p, shift = self.prefix(), np.uint64(64 - BITS)
        yield begins, (self._hash(p, begins, ends, 1) >> shift).astype(np.int32)
        gaps = np.concatenate([[0], np.cumsum(gap)])
        for n in GRAMS:
            last = len(self.data) - n + 1
            if last > 0:
                at = np.flatnonzero(gaps[n - 1 : n - 1 + last] == gaps[1 : 1 + last])  # no gap but at the ends
                yield at, (self._hash(p, at, at + n, n) >> shift).astype(np.int32)

    def _hash(self, p: np.ndarray, begins: np.ndarray, ends: np.ndarray, salt: int) -> np.ndarray:
        from boutlog.llm.textkit import _powers, mix

        return mix((p[ends] - p[begins]) * _powers(len(self.data))[1][begins] + np.uint64(salt))


@dataclass
class ToxicityModel:
    weight: np.ndarray  # of each bucket
    bias: float

    def score(self, held: list[bytes]) -> np.ndarray:
        bag = _Bag(held)
        total, count = np.zeros(len(held)), np.zeros(len(held))
        for at, buckets in bag.buckets():
            edges = np.searchsorted(at, bag.begins)
            sums = np.concatenate([[0.0], np.cumsum(self.weight[buckets], dtype=np.float64)])
            total += np.diff(sums[edges])
            count += np.diff(edges)
        return 1 / (1 + np.exp(-np.clip(total / np.maximum(count, 1) + self.bias, -50, 50)))


def bag(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The distinct buckets of a text's words and n-grams, and the share of each."""
    b = np.concatenate([u for _, u in _Bag([text]).buckets()] or [np.zeros(0, np.int32)])
    values, n = np.unique(b, return_counts=True)
    return values, (n / max(1, n.sum())).astype(np.float32)


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 12, rate: float = 0.5, batch: int = 64, seed: int = 1) -> ToxicityModel:
    """The model of bags and their labels."""
    if not len(rows) or labels.min() == labels.max():
        p = 0.5 if not len(rows) else float(np.clip(labels.mean(), 0.01, 0.99))
        return ToxicityModel(np.zeros(1 << BITS, np.float32), float(np.log(p / (1 - p))))
    rng = np.random.default_rng(seed)
    embed = (rng.standard_normal((1 << BITS, DIM)) / DIM).astype(np.float32)
    soft = np.stack([-np.ones(DIM), np.ones(DIM)], 1).astype(np.float32) * 0.5
    bias = np.zeros(2, np.float32)
    seen_e, seen_s, seen_b = np.full(1 << BITS, 1e-8, np.float32), np.full(2, 1e-8, np.float32), np.full(2, 1e-8, np.float32)
    class_weight = np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean())).astype(np.float32)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs) + 0.02
        order = rng.permutation(len(rows))
        for at in range(0, len(order), batch):
            some = [i for i in order[at : at + batch] if len(rows[i][0])]
            if not some:
                continue
            index = np.concatenate([rows[i][0] for i in some])
            share = np.concatenate([rows[i][1] for i in some])
            sizes = np.array([len(rows[i][0]) for i in some])
            starts = np.cumsum(sizes) - sizes
            hidden = np.add.reduceat(embed[index] * share[:, None], starts) * 30  # averages are small: a fixed gain
            logits = hidden @ soft + bias
            logits -= logits.max(1, keepdims=True)
            p = np.exp(logits)
            p /= p.sum(1, keepdims=True)
            error = p
            error[np.arange(len(some)), labels[some]] -= 1
            error *= class_weight[some][:, None] / len(some)
            to_soft, to_bias, to_hidden = hidden.T @ error, error.sum(0), error @ soft.T * 30
            # the same embedding's gradients add up over the batch
            gradient = np.repeat(to_hidden, sizes, axis=0) * share[:, None]
            turn = np.argsort(index, kind="stable")
            ordered = index[turn]
            first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
            unique, summed = ordered[first], np.add.reduceat(gradient[turn], first)
            seen_e[unique] += (summed**2).mean(1)
            embed[unique] -= step * summed / np.sqrt(seen_e[unique])[:, None] * np.minimum(1, np.sqrt(seen_e[unique]) * 1e3)[:, None] * 0.3
            seen_s += (to_soft**2).mean(0)
            soft -= step * 0.1 * to_soft / np.sqrt(seen_s)
            seen_b += to_bias**2
            bias -= step * 0.1 * to_bias / np.sqrt(seen_b)
    difference = soft[:, 1] - soft[:, 0]
    untrained = seen_e < 2e-8
    embed[untrained] = 0
    return ToxicityModel((embed @ difference * 30).astype(np.float32), float(bias[1] - bias[0]))


def fit_labelled(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> ToxicityModel:
    """Fit on at most ``sample`` of the labelled ids: half of each class, or all of one that has fewer.

    One text of each id (the least, if its rows differ) is turned into its bag as it arrives, a partition at a time; what the driver
    keeps is at most ``sample`` bags of distinct buckets, however long a text is or often an id occurs.
    """
    rows = labels.where(F.col(label).isNotNull()).select(key, F.col(label).cast("int").alias("_label")).dropna().groupBy(key).agg(F.max("_label").alias("_label"))
    ids = first_by_hash(rows.where("_label = 1"), key, sample // 2).unionByName(first_by_hash(rows.where("_label = 0"), key, sample // 2))
    one = texts_of(docs, ids, key, text).groupBy(F.col(key).alias("id")).agg(F.min("_text").alias("text"), F.max("_label").alias("label")).orderBy("id")
    bags, known = [], []
    for r in one.toLocalIterator():
        bags.append(bag(r["text"].encode()))
        known.append(r["label"])
    return fit(bags, np.array(known, np.int64))


def score(docs: DataFrame, model: ToxicityModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, held in texts(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(held)), pa.array(shared.value.score(held))], names=[key, "score"])

    source = docs.select(F.col(key), F.col(text).cast("string"))
    return source.mapInArrow(run, f"`{key}` {source.schema[0].dataType.simpleString()}, score double")


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The query: fit on rows whose remainder by 5 is not 0, score all."""
    model = fit_labelled(docs, labels.where(remainder("doc_id", 5) != 0))
    return score(docs, model).select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
