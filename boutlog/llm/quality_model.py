"""Quality classifier by positive-unlabelled learning.

Trusted positives are rows labelled good; everything else about the corpus is learnt from unlabelled text, which is all rows
outside the trusted positives. A small network on measures of a text minimises the non-negative unbiased risk

    prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives)),

where the class prior is estimated first: a logistic model tells positives from unlabelled rows, and the
prior is the least ratio, over its scores, of the unlabelled share above a score to the positives' share
(with confidence bounds). It is estimated twice, each half of both sides told by a model of the other half, and averaged.

Measures are taken once, stored (a few hundred bytes a row) and read for training and scores. Training goes in rounds: each
task improves the network on its own unlabelled rows, a block at a time, beside the positives, and the networks are averaged
by rows. Every unlabelled row takes part in the risk, and in the prior's tail counts. Only positives are sampled: at most ``sample``.

Null and empty texts have measures of zero and are scored like any other; without positives or unlabelled rows all
scores are 0.5. Rows without id are scored, never learnt from, and their held_out is null; of an id with several texts one (the
first by its measures) is a positive. Repeated rows are scored alike; a score equal to the cut counts as good; an empty table
gives no rows; other columns are not looked at. A very long text is held whole in the task that reads it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from boutlog.llm.sampling import first_by_hash, remainder
from boutlog.llm.textkit import Block, texts
from boutlog.session import stored

SAMPLE, HIDDEN, THRESHOLD = 4000, 24, 0.7
ROUNDS, STEPS, BLOCK = 3, 80, 8192  # rounds of the last training; steps on a block of rows in each
#: Bytes that are counted together.
_GROUPS = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r\x0b\x0c", b".", b",", b"!", b"?", b"|", b"%", b"*", b"&", b"$", b"#", b"<>", b"-_", b"'\"", b"()[]{}", b":;", b"/\\=+~^@`"]
_CLASS = np.full(256, len(_GROUPS), np.uint8)
for _i, _g in enumerate(_GROUPS):
    _CLASS[list(_g)] = _i
_CLASS[128:192] = len(_GROUPS) + 1
CLASSES = len(_GROUPS) + 2
FEATURES = CLASSES + 7


def measures(held: list[bytes]) -> np.ndarray:
    """A row of numbers for each text; all but one are shares."""
    block = Block(held, lower=False)
    w, first = block.word_hashes()
    begins, ends, _ = block.words()
    kinds = _CLASS[block.data]
    capital = (block.data[begins] >= 65) & (block.data[begins] <= 90) if len(begins) else np.zeros(0, bool)
    length = np.concatenate([[0], np.cumsum(ends - begins)])
    capitals = np.concatenate([[0], np.cumsum(capital)])
    squares = np.concatenate([[0], np.cumsum((ends - begins) ** 2)])
    pairs = w[:-1] * np.uint64(31) + w[1:] if len(w) > 1 else w[:0]
    out = np.zeros((len(held), FEATURES))
    for i, x in enumerate(held):
        a, n = int(block.begins[i]), len(x)
        if not n:
            continue
        f, e = int(first[i]), int(first[i + 1])
        m = max(1, e - f)
        out[i, :CLASSES] = np.bincount(kinds[a : a + n], minlength=CLASSES) / n
        mean = (length[e] - length[f]) / m
        lines = [y for y in x.split(b"\n") if y.strip()]
        out[i, CLASSES:] = (
            np.log1p(e - f),
            mean,
            np.sqrt(max(0.0, (squares[e] - squares[f]) / m - mean**2)),
            (capitals[e] - capitals[f]) / m,
            len(np.unique(w[f:e])) / m,
            len(np.unique(pairs[f : max(f, e - 1)])) / max(1, m - 1) if e - f > 1 else 1,
            len(set(lines)) / max(1, len(lines)),
        )
    return out


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.layers:
            return np.full(len(x), 0.5)
        return 1 / (1 + np.exp(-np.clip(_forward(self.layers, _shaped(x, self.mean, self.scale))[1], -50, 50)))


def _shaped(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.clip((x - mean) / scale, -6, 6)


def _forward(layers: list[np.ndarray], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    hidden = np.tanh(x @ layers[0] + layers[1])
    return hidden, hidden @ layers[2] + layers[3][0]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def start(features: int, seed: int) -> list[np.ndarray]:
    """A network before training."""
    rng = np.random.default_rng(seed)
    return [rng.standard_normal((features, HIDDEN)) / np.sqrt(features), np.zeros(HIDDEN), rng.standard_normal(HIDDEN) / np.sqrt(HIDDEN), np.zeros(1)]


def risk(layers: list[np.ndarray], p: np.ndarray, u: np.ndarray, prior: float | None, decay: float = 1e-3) -> tuple[float, float, list[np.ndarray]]:
    """The risk, its negatives' part (before the cut at zero), and the gradients that a step follows.

    prior None: plain log-loss of positives against unlabelled rows. Where the negatives' part is below zero, the step turns back
    from it (the gradient of its negative), as the estimate has overfitted.
    """
    n = len(p)
    x = np.concatenate([p, u])
    hidden, z = _forward(layers, x)
    s = _sigmoid(z)
    to_z = np.zeros(len(x))
    as_good, as_bad = np.logaddexp(0, -z), np.logaddexp(0, z)
    if prior is None:
        value, negative = as_good[:n].mean() + as_bad[n:].mean(), 0.0
        to_z[:n], to_z[n:] = (s[:n] - 1) / n, s[n:] / len(u)
    else:
        negative = as_bad[n:].mean() - prior * as_bad[:n].mean()
        value = prior * as_good[:n].mean() + max(0.0, negative)
        if negative >= 0:
            to_z[:n], to_z[n:] = -prior / n, s[n:] / len(u)
        else:
            to_z[:n], to_z[n:] = prior * s[:n] / n, -s[n:] / len(u)
    back = np.outer(to_z, layers[2]) * (1 - hidden**2)
    gradients = [x.T @ back + decay * layers[0], back.sum(0), hidden.T @ to_z + decay * layers[2], np.array([to_z.sum()])]
    return float(value), float(negative), gradients


def improved(layers: list[np.ndarray], p: np.ndarray, u: np.ndarray, prior: float | None, steps: int = STEPS) -> list[np.ndarray]:
    """The network after some steps of Adam."""
    first, second = [np.zeros_like(x) for x in layers], [np.zeros_like(x) for x in layers]
    for t in range(1, steps + 1):
        gradients = risk(layers, p, u, prior)[2]
        out = []
        for i, g in enumerate(gradients):
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.999 * second[i] + 0.001 * g * g
            out.append(layers[i] - 0.02 * (first[i] / (1 - 0.9**t)) / (np.sqrt(second[i] / (1 - 0.999**t)) + 1e-8))
        layers = out
    return layers


def tail_cuts(positives: np.ndarray) -> np.ndarray:
    """The scores at which tails are compared."""
    return np.unique(np.quantile(positives, np.linspace(0.02, 0.98, 97)))


def estimate_prior(positives: np.ndarray, cuts: np.ndarray, above: np.ndarray, n: int) -> float:
    """The least ratio of tail shares over the cuts, each with its confidence bound; ``above`` of n unlabelled rows reach each cut."""
    p, u = np.array([(positives >= c).mean() for c in cuts]), above / n
    slack = np.sqrt(np.log(20) / 2 / len(positives)) + np.sqrt(np.log(20) / 2 / n)
    best = int(np.argmin((u + slack) / p))
    return float(np.clip(u[best] / p[best], 0.02, 0.98))


def measured(docs: DataFrame, key: str, text: str) -> DataFrame:
    """id, m (the measures of the text), half (0 or 1, by the measures) of every row."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, held in texts(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(held)), pa.array(list(measures(held).astype(np.float32)), pa.list_(pa.float32()))], names=["id", "m"])

    made = docs.select(F.col(key).alias("id"), F.col(text).cast("string")).mapInArrow(run, f"id {kind}, m array<float>")
    return made.withColumn("half", F.pmod(F.xxhash64("m"), F.lit(2)))


def _matrix(column: pa.ListArray) -> np.ndarray:
    return np.asarray(column.flatten(), float).reshape(-1, FEATURES)


def _round(rows: DataFrame, layers: list[np.ndarray], p: np.ndarray, prior: float | None, mean: np.ndarray, scale: np.ndarray) -> list[np.ndarray]:
    """The average, by rows, of the networks that the tasks make of this one on their own rows (m)."""
    sizes = [x.size for x in layers]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(sum(sizes)), 0
        for batch in batches:
            x = _shaped(_matrix(batch.column(0)), mean, scale)
            for at in range(0, len(x), BLOCK):
                u = x[at : at + BLOCK]
                total += len(u) * np.concatenate([w.ravel() for w in improved(layers, p, u, prior)])
                n += len(u)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total), pa.array(np.full(len(total), n))], names=["i", "w", "n"])

    sums = rows.select("m").mapInArrow(run, "i long, w double, n long").groupBy("i").agg(F.sum("w").alias("w"), F.sum("n").alias("n")).orderBy("i").collect()
    flat = np.array([r["w"] / r["n"] for r in sums])
    return [x.reshape(w.shape) for x, w in zip(np.split(flat, np.cumsum(sizes)[:-1]), layers)]


def _above(rows: DataFrame, layers: list[np.ndarray], cuts: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, int]:
    """How many rows reach each cut, and how many there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above, n = np.zeros(len(cuts), np.int64), 0
        for batch in batches:
            z = np.sort(_forward(layers, _shaped(_matrix(batch.column(0)), mean, scale))[1])
            above += len(z) - np.searchsorted(z, cuts)
            n += len(z)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cuts) + 1)), pa.array(np.append(above, n))], names=["i", "n"])

    found = {r["i"]: r["n"] for r in rows.select("m").mapInArrow(run, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).collect()}
    return np.array([found[i] for i in range(len(cuts))]), found[len(cuts)]


def fit(p: np.ndarray, web: DataFrame, seed: int = 3) -> QualityModel:
    """The model of positives' measures p and all rows of web (m, half)."""
    count = {r["half"]: r["n"] for r in web.groupBy("half").agg(F.count("*").alias("n")).collect()}
    if not len(p) or not count:
        return QualityModel(np.zeros(FEATURES), np.ones(FEATURES), [], 0.5)
    mean, scale = p.mean(0), p.std(0) + 0.003
    p = _shaped(p, mean, scale)
    # with one positive, or one kind of web rows, there is no other half to tell from
    halves = [(p[h::2], p[1 - h :: 2], web.where(F.col("half") == h), web.where(F.col("half") == 1 - h)) for h in (0, 1)] if len(p) > 1 and len(count) > 1 else [(p, p, web, web)]
    priors = []
    for learnt, other, rows, rest in halves:
        told = _round(rows, start(FEATURES, seed), learnt, None, mean, scale)
        z = _forward(told, other)[1]
        cuts = tail_cuts(z)
        priors.append(estimate_prior(z, cuts, *_above(rest, told, cuts, mean, scale)))
    prior, layers = float(np.mean(priors)), start(FEATURES, seed + 1)
    for _ in range(ROUNDS):
        layers = _round(web, layers, p, prior, mean, scale)
    return QualityModel(mean, scale, layers, prior)


def fit_positives(rows: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", sample: int = SAMPLE) -> QualityModel:
    """The model of measured() rows: positives are at most ``sample`` ids labelled 1; unlabelled are all rows of other ids."""
    chosen = first_by_hash(labels.where(F.col(label) == 1).select(key).dropna().distinct(), key, sample).withColumnRenamed(key, "id")
    got = rows.join(F.broadcast(chosen), "id").groupBy("id").agg(F.min("m").alias("m")).orderBy("id").collect()
    web = rows.where("id IS NOT NULL").join(F.broadcast(chosen), "id", "left_anti")
    return fit(np.array([r["m"] for r in got], float).reshape(-1, FEATURES), web)


def score(rows: DataFrame, model: QualityModel) -> DataFrame:
    """id, score of every row of measured()."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.score(_matrix(batch.column(1))))], names=["id", "score"])

    return rows.select("id", "m").mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, score double")


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The query: fit on rows whose remainder by 4 is not 2, score all."""
    rows = stored(measured(docs, "doc_id", "text"))
    model = fit_positives(rows, labels.where(remainder("doc_id", 4) != 2))
    out = score(rows, model).withColumnRenamed("id", "doc_id")
    return out.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
