"""Language-model scoring: causal self-attention over subword ids, trained in numpy.

A text is its words' subword ids and one end. The model gives each id a probability from the ids before it in its text:

    P(id | ids before) = P(class of id | ids before) * P(id | its class, last id)

The class comes from one layer of causal self-attention over a window of ids with learned biases by distance, a direct
term from the last id, and a softmax over classes of ids: the most frequent ids are classes of their own, the others share
classes by frequency, apart for ids that begin a word. Within a class an id's share of the training rows is tilted by the
product of two learned vectors, the last id's and its own; as only the last id decides, its norms are a table. All ids'
probabilities sum to one at each position. ``score`` is the sum of the log10 probabilities of all ids of the text, the end
included: each id is scored once, by the attention and nothing else. Long texts are scored in overlapping windows: each
query sees at least ``STRIDE`` ids before it, many windows at a time with one mask.

Classes and shares come from counts over all training rows. The parameters are trained by Adam on all
training texts, each once and whole: the texts are dealt to tasks, each starts from the
class pairs of its first texts and goes over all of its texts once, and the parameters are averaged by Spark, in ``ROUNDS``
rounds on different texts.

``known_score`` is the part of ``score`` on words that occur in training rows, and the end; ``flat_score`` the score of the
same ids by their frequency alone. ``base_score`` is another figure: it gives all unseen words one price whatever their letters.

Counts never meet in one place: texts are dealt into blocks of bounded size, each block's distinct words are stored,
joined with the totals, and counts and subword ids come back to the block, which encodes no word again. Words are told
apart by 64-bit hashes.

Null texts are empty: an end alone. An empty table gives no rows; repeated rows are counted and scored as often as
they occur; rows without id are trained on or held out as the condition says (null counts as held out) and scored. Other
columns are not looked at. A block holds whole texts: a very long one makes a larger block.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from boutlog.llm.packing import Encoder, encoder
from boutlog.llm.sampling import remainder
from boutlog.llm.textkit import Block, mix, texts
from boutlog.session import discard, stored

WINDOW, STRIDE, DIM, CLASSES = 32, 16, 16, 64
ROUNDS, BATCH = 2, 64
RATE, IN_CLASS_RATE = 0.03, 0.15
PER_ID = "embed", "before", "after"
TRAINER_BYTES, TRAINERS = 16 << 20, 4096  # text of one task in training, and the most tasks; beyond, each has more text
BLOCK_BYTES, BLOCK_PARTITIONS = 16 << 20, 20_000
SCORES = "score", "known_score", "flat_score"
_END_HASH = int(mix(np.array([0xE0D], np.uint64)).view(np.int64)[0])


@dataclass
class AttentionModel:
    of_class: np.ndarray  # class of each id
    inside: np.ndarray  # log of an id's share of its class
    single: np.ndarray  # log of the share of each id, and the end, of all training rows
    parameters: dict[str, np.ndarray]
    end: int

    def __post_init__(self) -> None:
        p = self.parameters
        e = p["embed"] + p["of_class"][self.of_class]
        scale = np.float32(1 / np.sqrt(DIM))
        self.tables = [np.ascontiguousarray(x, np.float32) for x in (e @ p["q"] * scale, e @ p["k"], e @ p["v"] @ p["o"], e @ p["out"] + p["pair"][self.of_class])]
        self.norms = in_class_norms(p["before"], p["after"], self.inside, self.of_class)

    def log_probabilities(self, targets: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Of texts' ids, each text closed by an end: the log probability of each, given those before it in its text."""
        q, k, v, direct = self.tables
        out, before, after = (self.parameters[n] for n in ("out", "before", "after"))
        starts = np.cumsum(sizes) - sizes
        total = len(targets)
        # inputs: the end before each text, then its ids; WINDOW pads in front for windows that reach out, STRIDE behind
        inputs = np.full(WINDOW + total + STRIDE, self.end, np.int64)
        inputs[WINDOW + 1 : WINDOW + total] = targets[:-1]
        pieces = -(-sizes // STRIDE)
        text = np.repeat(np.arange(len(sizes)), pieces)
        nth = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        first, left = starts[text] + nth * STRIDE, sizes[text] - nth * STRIDE
        kind = self.of_class[targets]
        chosen = np.empty(total, np.float32)
        bias = self.mask()
        ones = np.ones(CLASSES, np.float32)
        offsets = np.arange(WINDOW) + STRIDE  # of the keys, from WINDOW places before the first of them
        early = np.arange(WINDOW) - (WINDOW - STRIDE)
        for a in range(0, len(first), 256):
            at, most = first[a : a + 256], left[a : a + 256]
            key_ids = inputs.take(at[:, None] + offsets)
            ids = np.ascontiguousarray(key_ids[:, WINDOW - STRIDE :])
            weight = np.matmul(q.take(ids, 0), np.ascontiguousarray(k.take(key_ids, 0).transpose(0, 2, 1)))
            weight += bias
            np.exp(weight, out=weight)
            opening = np.flatnonzero(nth[a : a + 256] < WINDOW // STRIDE - 1)  # their first keys lie before the text
            if len(opening):
                weight[opening] *= (nth[a + opening, None] * STRIDE + early >= 0)[:, None, :]
            read = np.matmul(weight, v.take(key_ids, 0)).reshape(-1, DIM)
            read /= (weight.reshape(-1, WINDOW) @ ones[:WINDOW])[:, None]
            logits = read @ out
            logits += direct.take(ids.ravel(), 0)
            np.exp(logits, out=logits)
            real = np.flatnonzero((np.arange(STRIDE) < most[:, None]).ravel())
            spot = (at[:, None] + np.arange(STRIDE)).ravel()[real]
            chosen[spot] = np.log(logits[real, kind[spot]] / (logits @ ones)[real])
        # within its class an id depends on the last id alone, so its norm is a table
        last = inputs[WINDOW : WINDOW + total]
        several = np.flatnonzero(self.inside[targets] < 0)
        for a in range(0, len(several), 1 << 16):
            spot = several[a : a + (1 << 16)]
            x, y = last[spot], targets[spot]
            chosen[spot] += self.inside[y] + np.einsum("ij,ij->i", before.take(x, 0), after.take(y, 0)) - self.norms.ravel().take(x * CLASSES + kind[spot])
        return chosen

    def mask(self) -> np.ndarray:
        """The bias of each query and key of a window by distance; keys after the query are closed."""
        distance = (np.arange(STRIDE)[:, None] + WINDOW - STRIDE) - np.arange(WINDOW)
        return np.where(distance >= 0, self.parameters["distance"][np.clip(distance, 0, WINDOW - 1)], -1e4).astype(np.float32)


def in_class_norms(before: np.ndarray, after: np.ndarray, inside: np.ndarray, of_class: np.ndarray) -> np.ndarray:
    """For each last id and class, the log of the sum over the class's ids of share * exp(before . after); 0 where before is 0."""
    norms = np.zeros((len(before), CLASSES), np.float32)
    order = np.argsort(of_class, kind="stable")
    begin = np.searchsorted(of_class[order], np.arange(CLASSES))
    there = begin < np.append(begin[1:], len(order))
    moved = np.flatnonzero(np.any(before != 0, 1))
    for a in range(0, len(moved), 256):
        rows = moved[a : a + 256]
        norms[np.ix_(rows, there)] = np.log(np.add.reduceat(np.exp(before[rows] @ after[order].T + inside[order]), begin[there], axis=1))
    return norms


def classes(counts: np.ndarray, starts_word: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """of_class and inside from the counts of the ids."""
    of_class = np.full(len(counts), -1, np.int64)
    of_class[end] = 0
    counts = counts.astype(float)
    counts[end] = 0
    shared = 12
    singles = CLASSES - 1 - 2 * shared
    top = np.argsort(-counts, kind="stable")[:singles]
    of_class[top] = 1 + np.arange(singles)
    for side, word in enumerate((True, False)):
        rest = np.flatnonzero((of_class < 0) & (starts_word == word))
        rest = rest[np.argsort(-counts[rest], kind="stable")]
        mass = np.cumsum(counts[rest] + 0.05)
        of_class[rest] = 1 + singles + side * shared + np.minimum(shared - 1, (mass * shared / mass[-1]).astype(int))
    smooth = counts + 0.05
    smooth[end] = 1
    inside = np.log(smooth / np.bincount(of_class, weights=smooth, minlength=CLASSES)[of_class])
    return of_class, inside.astype(np.float32)


def initial(totals: np.ndarray, of_class: np.ndarray, seed: int = 5) -> dict[str, np.ndarray]:
    """Parameters before training: small random ones, and the classes' shares whatever came before."""
    rng = np.random.default_rng(seed)
    small = lambda *shape: (rng.standard_normal(shape) * 0.3 / np.sqrt(shape[0])).astype(np.float32)
    share = np.bincount(of_class, weights=totals, minlength=CLASSES) / max(1, totals.sum())
    zeros = np.zeros((len(totals), DIM), np.float32)
    # ids that no training row holds keep the share of their class, whatever the last id
    after = np.where(totals[:, None] > 0, rng.standard_normal(zeros.shape) * 0.3, 0).astype(np.float32)
    p = {"embed": zeros, "before": zeros, "after": after, "of_class": small(CLASSES, DIM) * 4, "q": small(DIM, DIM), "k": small(DIM, DIM), "v": small(DIM, DIM), "o": small(DIM, DIM), "out": small(DIM, CLASSES)}
    return p | {"pair": np.tile(np.log(share + 1e-4), (CLASSES, 1)).astype(np.float32), "distance": np.zeros(WINDOW, np.float32)}


def _summed(at: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct places, the sum of the values of each, and how many there are."""
    order = np.argsort(at, kind="stable")
    sorted_ = at[order]
    first = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))
    return sorted_[first], np.add.reduceat(values.take(order, 0), first, axis=0), np.diff(np.append(first, len(at)))


class Learner:
    """Parameters and the state of Adam; tables with a row per id move only where an id occurs."""

    def __init__(self, parameters: dict[str, np.ndarray], of_class: np.ndarray, inside: np.ndarray):
        self.p, self.of_class, self.inside, self.t = {n: x.copy() for n, x in parameters.items()}, of_class, inside, 0
        self.dense = [n for n in self.p if n not in PER_ID]
        self.first, self.second = {n: np.zeros_like(self.p[n]) for n in self.dense}, {n: np.zeros_like(x) for n, x in self.p.items()}
        self.used = {n: np.zeros(len(of_class), np.int64) for n in PER_ID}
        self.causal = np.tril(np.ones((WINDOW, WINDOW), bool))
        self.distance = np.clip(np.arange(WINDOW)[:, None] - np.arange(WINDOW), 0, WINDOW - 1)
        live = np.any(self.p["after"] != 0, 1)
        self.members = [np.flatnonzero(live & (of_class == c)) for c in range(CLASSES)]
        self.dead = np.array([np.exp(inside[~live & (of_class == c)]).sum() for c in range(CLASSES)], np.float32)
        self.place = np.zeros(len(of_class), np.int64)
        for m in self.members:
            self.place[m] = np.arange(len(m))

    def pairs(self, stream: np.ndarray) -> None:
        """Start from the pairs of classes in a stream of ids, five rows' worth of weight on what is there."""
        c = self.of_class[stream]
        n = np.bincount(c[:-1] * CLASSES + c[1:], minlength=CLASSES * CLASSES).reshape(CLASSES, CLASSES)
        self.p["pair"] = np.log(n + 5 * np.exp(self.p["pair"])).astype(np.float32)

    def _move_rows(self, name: str, rows: np.ndarray, slope: np.ndarray, times: np.ndarray | int, rate: float) -> None:
        self.used[name][rows] += times
        second = self.second[name].take(rows, 0) + slope**2
        self.second[name][rows] = second
        self.p[name][rows] -= np.float32(rate) * slope / (np.sqrt(second) + np.float32(1e-4))

    def in_class(self, x: np.ndarray, y: np.ndarray, rate: float) -> None:
        """One step of the shares within classes: ids y after last ids x."""
        c = self.of_class[y]
        some = np.flatnonzero(self.inside[y] < 0)
        some = some[np.argsort(c[some], kind="stable")]
        kinds, first = np.unique(c[some], return_index=True)
        slopes = np.empty((len(some), DIM), np.float32)
        moves = []
        for kind, a, z in zip(kinds.tolist(), first.tolist(), [*first[1:].tolist(), len(some)]):
            m, at = self.members[kind], some[a:z]
            before, after = self.p["before"].take(x[at], 0), self.p["after"].take(m, 0)
            share = np.exp(before @ after.T + self.inside[m])
            share /= share.sum(1, keepdims=True) + self.dead[kind]
            share[np.arange(z - a), self.place[y[at]]] -= 1
            share /= np.float32(len(y))
            slopes[a:z] = share @ after
            moves.append((m, share.T @ before, z - a))
        for m, slope, times in moves:
            self._move_rows("after", m, slope, times, rate)
        if len(some):
            rows, slope, times = _summed(x[some], slopes)
            self._move_rows("before", rows, slope, times, rate)

    def step(self, windows: np.ndarray) -> None:
        """One step on windows of WINDOW + 1 ids: each id but the first is predicted from those before it."""
        p, scale = self.p, np.float32(1 / np.sqrt(DIM))
        self.t += 1
        x, y = windows[:, :-1], windows[:, 1:]
        c, aim = self.of_class[x].ravel(), self.of_class[y].ravel()
        three, flat = (lambda m: m.reshape(*x.shape, -1)), (lambda m: m.reshape(x.size, -1))
        e = p["embed"].take(x.ravel(), 0) + p["of_class"].take(c, 0)
        q, k, v = (three(e @ p[n]) for n in "qkv")
        w = (q * scale) @ np.ascontiguousarray(k.transpose(0, 2, 1)) + np.where(self.causal, p["distance"][self.distance], np.float32(-1e9))
        np.exp(w - w.max(2, keepdims=True), out=w)
        w /= w.sum(2, keepdims=True)
        a = flat(w @ v)
        h = e + a @ p["o"]
        z = h @ p["out"] + p["pair"].take(c, 0)
        np.exp(z - z.max(1, keepdims=True), out=z)
        z /= z.sum(1, keepdims=True)
        z[np.arange(len(z)), aim] -= 1
        z /= np.float32(len(z))
        g = {"out": h.T @ z, "pair": np.zeros_like(p["pair"]), "of_class": np.zeros_like(p["of_class"])}
        dh = z @ p["out"].T
        g["o"] = a.T @ dh
        da = three(dh @ p["o"].T)
        dv = flat(w.transpose(0, 2, 1) @ da)
        dw = da @ v.transpose(0, 2, 1)
        dw -= (dw * w).sum(2, keepdims=True)
        dw *= w
        g["distance"] = np.bincount(self.distance[self.causal], weights=dw.sum(0)[self.causal], minlength=WINDOW).astype(np.float32)
        dq, dk = flat(dw @ k) * scale, flat(dw.transpose(0, 2, 1) @ q) * scale
        g["q"], g["k"], g["v"] = e.T @ dq, e.T @ dk, e.T @ dv
        de = dh + dq @ p["q"].T + dk @ p["k"].T + dv @ p["v"].T
        rows, slope, times = _summed(x.ravel(), np.concatenate([de, z], 1))
        kinds, both, _ = _summed(self.of_class[rows], slope)
        g["of_class"][kinds], g["pair"][kinds] = both[:, :DIM], both[:, DIM:]
        rate = RATE / (1 + self.t / 200) + 0.001
        self._move_rows("embed", rows, slope[:, :DIM], times, rate * 2)
        for n in self.dense:
            self.first[n] = 0.9 * self.first[n] + 0.1 * g[n]
            self.second[n] = 0.99 * self.second[n] + 0.01 * g[n] ** 2
            p[n] = (p[n] - rate * (self.first[n] / (1 - 0.9**self.t)) / (np.sqrt(self.second[n] / (1 - 0.99**self.t)) + 1e-8)).astype(np.float32)
        self.in_class(x.ravel(), y.ravel(), IN_CLASS_RATE)


def _one_round(texts_: DataFrame, parameters: dict[str, np.ndarray], of_class: np.ndarray, inside: np.ndarray, tokenizer: str, end: int, begin_pairs: bool) -> dict[str, np.ndarray]:
    """The average of the parameters that tasks reach, each from the same ones over its own texts; _text is the only column."""
    spark = texts_.sparkSession
    shared = spark.sparkContext.broadcast((parameters, of_class, inside))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learner, words, rng = Learner(*shared.value), word_ids(tokenizer), np.random.default_rng(7)
        for batch in batches:
            for _, some in texts(batch.column(0)):
                _, *laid = words.of(Block(some))
                stream = np.concatenate([[end], laid_out(laid[1], laid[0], laid[2], laid[3], end)[0]])
                if begin_pairs and not learner.t:
                    learner.pairs(stream)
                stream = np.concatenate([stream, np.full(-(len(stream) - 1) % WINDOW, end)])  # the last window is filled up with ends
                windows = stream[(np.arange((len(stream) - 1) // WINDOW) * WINDOW)[:, None] + np.arange(WINDOW + 1)]
                windows = windows[rng.permutation(len(windows))]
                for a in range(0, len(windows), BATCH):
                    learner.step(windows[a : a + BATCH])
        if learner.t:
            for number, name in enumerate(sorted(learner.p)):
                values = learner.p[name].reshape(-1, DIM)
                rows = np.flatnonzero(learner.used[name]) if name in PER_ID else np.arange(len(values))
                weight = learner.used[name][rows] if name in PER_ID else np.full(len(rows), learner.t)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), number)), pa.array(rows), pa.array(weight.astype(float)), *[pa.array(values[rows, i].astype(float)) for i in range(DIM)]], names=["part", "at", "weight", *(f"v{i}" for i in range(DIM))])

    reached = texts_.mapInArrow(run, "part long, at long, weight double, " + ", ".join(f"v{i} double" for i in range(DIM)))
    mean = reached.groupBy("part", "at").agg(*[(F.sum(F.col(f"v{i}") * F.col("weight")) / F.sum("weight")).alias(f"v{i}") for i in range(DIM)]).toPandas()
    out = {}
    for number, name in enumerate(sorted(parameters)):  # as many rows as the model has, whatever the corpus
        mine = mean[mean.part == number]
        values = parameters[name].reshape(-1, DIM).copy()
        values[mine["at"].to_numpy(np.int64)] = mine[[f"v{i}" for i in range(DIM)]].to_numpy(np.float32)
        out[name] = values.reshape(parameters[name].shape)
    shared.unpersist()
    return out


class WordIds:
    """Subword ids of words, each encoded after a blank, with a bounded memory of words already encoded."""

    def __init__(self, tokenizer: str, most: int = 700_000):
        self.encode, self.most = Encoder(tokenizer, 0), most
        self.forget()

    def forget(self) -> None:
        self.known: dict[int, int] = {}
        self.flat, self.offsets = np.zeros(0, np.uint16), np.zeros(1, np.int64)

    def ids_of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words with a blank before each, and how many each has. Side by side they are encoded as each alone."""
        if self.encode.odd.search(b"".join(words)):
            each = self.encode.batch(words)
            return np.concatenate(each), np.array([len(x) for x in each])
        ids = self.encode.whole([b"".join(words)])[0]
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        cuts = np.searchsorted(np.cumsum(self.encode.bytes_of[ids]), ends) + 1
        return ids, np.diff(cuts, prepend=0)

    def of(self, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of a block's words: hashes, the number of each text's first word (one more than texts); then of the distinct words number, ids and offsets of ids."""
        begins, ends, first = block.words()
        h = block.spans(begins, ends).view(np.int64)
        distinct, at, number = np.unique(h, return_index=True, return_inverse=True)
        hashes = distinct.tolist()
        spot = np.array([self.known.get(x, -1) for x in hashes], np.int64)
        new = np.flatnonzero(spot < 0)
        if len(new):
            if len(self.known) + len(new) > self.most:
                self.forget()
                new = np.arange(len(distinct))
            data = block.data.tobytes()
            ids, lengths = self.ids_of([b" " + data[b:e] for b, e in zip(begins[at[new]].tolist(), ends[at[new]].tolist())])
            spot[new] = len(self.known) + np.arange(len(new))
            self.known.update(zip((hashes[i] for i in new.tolist()), spot[new].tolist()))
            self.flat = np.concatenate([self.flat, ids.astype(np.uint16)])  # as in the rows of words
            self.offsets = np.concatenate([self.offsets, self.offsets[-1] + np.cumsum(lengths)])
        length = self.offsets[spot + 1] - self.offsets[spot]
        offset = np.concatenate([[0], np.cumsum(length)])
        return h, first, number, self.flat[np.repeat(self.offsets[spot] - offset[:-1], length) + np.arange(offset[-1])].astype(np.int64), offset


def laid_out(number: np.ndarray, first: np.ndarray, ids: np.ndarray, offset: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The ids of texts with an end after each, how many each text has, where each word or end begins, and which are ends."""
    n = np.diff(first)
    spot = first[1:] + np.arange(len(n))  # where each text's end goes among the words
    word = np.insert(number, first[1:], len(offset) - 1)
    length = np.append(np.diff(offset), 1)[word]
    begin = np.cumsum(length) - length
    flat = np.append(ids, end)[np.repeat(offset[word] - begin, length) + np.arange(length.sum())]
    is_end = np.zeros(len(word), bool)
    is_end[spot] = True
    return flat, np.add.reduceat(length, spot - n) if len(n) else np.zeros(0, np.int64), begin, is_end


_words_of: dict[str, WordIds] = {}


def word_ids(tokenizer: str) -> WordIds:
    """This process's WordIds of a tokenizer."""
    if tokenizer not in _words_of:
        _words_of[tokenizer] = WordIds(tokenizer)
    return _words_of[tokenizer]


@dataclass
class Counted:
    """What is gathered from the corpus: the texts dealt into blocks, each block's words with their counts in training rows, totals."""

    dealt: DataFrame
    known: DataFrame
    train_tokens: int
    distinct: int
    totals: np.ndarray


def _block_words(tokenizer: str, end: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """block, train, text in order of blocks -> block, h, n, ids: the distinct words (and the end) of each block, their counts in training rows, their subword ids.

    Block -1 has how often each id occurs in training rows.
    """

    def merged(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
        h, n, ids = (np.concatenate([x[i] for x in parts]) for i in range(3))
        order = np.argsort(h, kind="stable")
        h = h[order]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        return h[first], np.add.reduceat(n[order], first), ids[order[first]]

    def rows(b: int, h: np.ndarray, n: np.ndarray, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(h), 50_000):
            z = slice(a, a + 50_000)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h[z]), b)), pa.array(h[z]), pa.array(n[z]), pa.array(ids[z], pa.binary())], names=["block", "h", "n", "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, held = word_ids(tokenizer), {}
        counts = np.zeros(words.encode.tokenizer.get_vocab_size(), np.int64)
        for batch in batches:
            block, train = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            for at, some in texts(batch.column(2)):
                h, first, number, ids, offset = words.of(Block(some))
                of = np.repeat(np.arange(len(some)), np.diff(first)) + at
                times = np.bincount(number[train[of]], minlength=len(offset) - 1)
                if len(ids):
                    counts += np.bincount(ids, weights=np.repeat(times, np.diff(offset)), minlength=len(counts)).astype(np.int64)
                counts[end] += int(train[at : at + len(some)].sum())
                flat = ids.astype("<u2").tobytes()
                codes = np.empty(len(offset), object)
                codes[:] = [flat[2 * a : 2 * z] for a, z in zip(offset[:-1].tolist(), offset[1:].tolist())] + [np.array([end], "<u2").tobytes()]
                h, number = np.append(h, np.full(len(some), _END_HASH)), np.append(number, np.full(len(some), len(codes) - 1))
                of = np.append(of, np.arange(at, at + len(some)))
                for b in np.unique(block[at : at + len(some)]).tolist():
                    mine = np.flatnonzero(block[of] == b)
                    counted = np.bincount(number[mine], weights=train[of[mine]], minlength=len(codes)).astype(np.int64)
                    there, first_at = np.unique(number[mine], return_index=True)
                    parts = held.setdefault(b, [])
                    parts.append((h[mine[first_at]], counted[there], codes[there]))
                    if len(parts) > 16:
                        held[b] = [merged(parts)]
            for b in [b for b in held if len(block) and b != block[-1]]:
                yield from rows(b, *merged(held.pop(b)))
        for b in list(held):
            yield from rows(b, *merged(held.pop(b)))
        used = np.flatnonzero(counts)
        yield from rows(-1, used, counts[used], np.full(len(used), None, object))

    return run


def gather(docs: DataFrame, training: str, tokenizer: str, key: str = "doc_id", text: str = "text") -> Counted:
    """Counts over the training rows; training: their SQL condition."""
    vocabulary = encoder(tokenizer).tokenizer.get_vocab()
    end = vocabulary["<|endoftext|>"]
    source = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).cast("string").alias("_text"), F.coalesce(F.expr(training), F.lit(False)).alias("_train"))
    size = source.agg(F.sum(F.octet_length("_text") + 64)).first()[0] or 0
    blocks = max(1, -(-int(size) // BLOCK_BYTES))
    dealt = source.withColumn("block", F.pmod(F.xxhash64(key, "_text", F.lit(7)), F.lit(blocks))).repartition(min(blocks, BLOCK_PARTITIONS), "block")
    words = stored(dealt.sortWithinPartitions("block").select("block", "_train", "_text").mapInArrow(_block_words(tokenizer, end), "block long, h long, n long, ids binary"))
    ids = np.zeros(len(vocabulary), np.int64)
    for r in words.where("block < 0").groupBy("h").agg(F.sum("n").alias("n")).collect():  # the vocabulary at most
        ids[r.h] = r.n
    of_words = words.where("block >= 0")
    totals = stored(of_words.groupBy("h").agg(F.sum("n").alias("c")).where("c > 0"))
    tokens, distinct = totals.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    known = stored(of_words.select("block", "h", "ids").join(totals, "h", "left").select("block", "h", "ids", F.coalesce("c", F.lit(0)).alias("c")))
    discard(words, totals)
    return Counted(dealt, known, tokens, distinct, ids)


def fit(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", counted: Counted | None = None) -> AttentionModel:
    """Counted over all rows (if they are not counted yet), trained on all of them."""
    vocabulary = encoder(tokenizer).tokenizer.get_vocab()
    end = vocabulary["<|endoftext|>"]
    starts_word = np.zeros(len(vocabulary), bool)
    starts_word[[i for s, i in vocabulary.items() if s[0] == "Ġ"]] = True
    counted = counted or gather(docs, "true", tokenizer, key, text)
    totals = counted.totals
    of_class, inside = classes(totals, starts_word, end)
    single = np.log((totals + 0.05) / (totals + 0.05).sum())
    parameters = initial(totals, of_class)
    dealt = docs.select(F.coalesce(F.col(text), F.lit("")).cast("string").alias("_text"), F.xxhash64(F.col(key), F.col(text), F.lit(11)).alias("_deal"))
    nth = F.pmod("_deal", F.lit(ROUNDS))
    sizes = dict(dealt.groupBy(nth.alias("r")).agg(F.sum(F.octet_length("_text"))).collect())
    for r in range(ROUNDS):
        if sizes.get(r):
            trainers = min(TRAINERS, -(-sizes[r] // TRAINER_BYTES))
            chosen = dealt.where(nth == r).repartition(trainers, "_deal").sortWithinPartitions("_deal", "_text").select("_text")
            parameters = _one_round(chosen, parameters, of_class, inside, tokenizer, end, r == 0)
    return AttentionModel(of_class, inside, single, parameters, end)


def score(docs: DataFrame, training: str, model: AttentionModel, tokenizer: str, key: str = "doc_id", text: str = "text", counted: Counted | None = None) -> DataFrame:
    """key, n_tokens, n_known, train_tokens, base_score and SCORES of every row; training: SQL condition of the training rows."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    counted = counted or gather(docs, training, tokenizer, key, text)
    dealt, known, train_tokens, distinct = counted.dealt, counted.known, counted.train_tokens, counted.distinct

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        model = shared.value
        h, order = right["h"].to_numpy(), np.argsort(right["h"].to_numpy())
        h, c = h[order], right["c"].to_numpy()[order]
        codes = right["ids"].take(pa.array(order)).combine_chunks() if len(order) else pa.array([], pa.binary())
        ids = np.frombuffer(b"".join(codes.to_pylist()), "<u2").astype(np.int64)
        offset = np.append(0, np.cumsum(pc.binary_length(codes).to_numpy(zero_copy_only=False) // 2)).astype(np.int64)
        columns: list[list] = [[] for _ in range(4 + len(SCORES))]
        for at, some in texts(left["_text"]):
            w, first = Block(some).word_hashes()
            n_words = np.diff(first)
            number = np.searchsorted(h, w.view(np.int64))  # every word of the block is there
            flat, sizes, begin, _ = laid_out(number, first, ids, offset, model.end)
            count = c[np.insert(number, first[1:], np.searchsorted(h, _END_HASH))]
            first = first + np.arange(len(first))  # with the ends
            chosen = np.add.reduceat(model.log_probabilities(flat, sizes), begin, dtype=np.float64) / math.log(10)  # of each word, or end
            single = np.add.reduceat(model.single[flat], begin) / math.log(10)
            for values, out in zip((np.log10(count + 1.0), chosen, np.where(count > 0, chosen, 0.0), single), columns[3:]):
                out.append(np.add.reduceat(values, first[:-1]))
            k = np.concatenate([[0], np.cumsum(count > 0)])
            columns[0].append(left[key].slice(at, len(some)))
            columns[1].append(n_words + 1)
            columns[2].append(k[first[1:]] - k[first[:-1]])
        ids_out = pa.chunked_array([x for part in columns[0] for x in part.chunks], left.schema.field(key).type) if columns[0] else left[key]
        flat = [np.concatenate(x) if x else np.zeros(0) for x in columns[1:]]
        return pa.table({key: ids_out, "n_tokens": flat[0].astype(np.int64), "n_known": flat[1].astype(np.int64), "logs": flat[2].astype(float), **{n: x.astype(float) for n, x in zip(SCORES, flat[3:])}})

    kind = dealt.schema[0].dataType.simpleString()
    scored = dealt.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(run, f"`{key}` {kind}, n_tokens long, n_known long, logs double, " + ", ".join(f"{n} double" for n in SCORES))
    base = F.col("logs") - F.col("n_tokens") * math.log10(train_tokens + distinct + 1)
    return scored.select(key, "n_tokens", "n_known", F.lit(train_tokens).cast("long").alias("train_tokens"), base.alias("base_score"), *SCORES)


def scored(docs: DataFrame, tokenizer: str) -> DataFrame:
    """The query: learnt from rows whose remainder by 7 is not 2, all rows scored."""
    held_out, training = remainder("doc_id", 7) == 2, "pmod(crc32(cast(cast(doc_id as string) as binary)), 7) <> 2"
    counted = gather(docs, training, tokenizer)
    model = fit(docs.where(training), tokenizer, counted=counted)
    out = score(docs, training, model, tokenizer, counted=counted)
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", *SCORES)
