"""Many forests at one time: all fits of a walk-forward, a search or a sweep share their passes over the rows.

Spark ML takes a forest's rows apart once for each fit and goes over them in a dozen jobs. Here the rows are coded once, features as
the places of their values among all fits' thresholds, in blocks; then a level of all trees of all fits is one job: tasks count each
node's rows by bin and label, counts of a tree meet in one group, which picks the splits.

The method is Spark ML's: thresholds are quantiles of a sample of the training rows (at most 32 bins, 10,000 rows or so), a tree's rows
are drawn with replacement by Poisson counts, a node looks at its own draw of features, and p is the mean over trees of the leaf's share.
A fit knows the rows of earlier parts (seasons, folds) alone, its thresholds too. Draws depend on the row's key, the seed and the tree,
and counts are integers, so results don't depend on how rows are dealt.
"""

from __future__ import annotations

import hashlib
import math
import pickle
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import DataFrame, functions as F

from boutlog.session import discard, stored

BINS, SAMPLE, BLOCK = 32, 10_000, 1 << 15
#: Deeper trees have too many nodes for one table of counts; Spark ML takes their nodes in turn.
DEEPEST = 8
_KNOWN = {"featuresCol", "labelCol", "numTrees", "maxDepth", "seed", "minInstancesPerNode", "featureSubsetStrategy", "bootstrap", "subsamplingRate", "impurity"}
_SUBSETS = {"auto", "all", "sqrt", "log2", "onethird"}
_WIDE = 2 * BINS


@dataclass(frozen=True)
class Fit:
    """A forest to be trained on the rows of parts below ``part``; it predicts those of ``part``."""

    name: str
    part: int
    features: Sequence[str]
    classifier: RandomForestClassifier


def takes(classifier: object) -> bool:
    """Whether grown() knows all of the classifier's settings."""
    if not isinstance(classifier, RandomForestClassifier) or not {p.name for p in classifier.params if classifier.isSet(p)} <= _KNOWN:
        return False
    return classifier.getLabelCol() == "y" and classifier.getMaxDepth() <= DEEPEST and classifier.getFeatureSubsetStrategy() in _SUBSETS


@dataclass
class _Tree:
    """Nodes by number, the root first. A leaf leads to itself; ``slot`` is a node's place among those to be split, or -1."""

    key: int
    feature: np.ndarray
    cut: np.ndarray  # rows go right where 2 * bin + label is greater
    left: np.ndarray
    counts: np.ndarray
    slot: np.ndarray
    subset: np.ndarray
    gains: dict = field(default_factory=dict)


@dataclass
class _Forest:
    part: int
    trees: list[_Tree]
    bag: np.ndarray | None  # a row's copies by 16 bits of its draw
    least: int
    entropy: bool


def _number(*of: object) -> int:
    return int.from_bytes(hashlib.blake2b(repr(of).encode(), digest_size=4).digest(), "little")


def _bag(rate: float, replaced: bool) -> np.ndarray | None:
    if not replaced and rate == 1.0:
        return None
    shares = [math.exp(-rate) * rate**k / math.factorial(k) for k in range(40)] if replaced else [1 - rate, rate]
    return np.searchsorted(np.cumsum(shares[:-1]), (np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.uint8)


def _draws(key: np.ndarray, tree: int, bag: np.ndarray) -> np.ndarray:
    x = key ^ np.uint32(tree)
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        x ^= x >> np.uint32(shift)
        x *= np.uint32(factor)
    return bag.take(x >> np.uint32(16), mode="clip")


def _cuts(values: np.ndarray) -> np.ndarray:
    """Thresholds of a feature: halfway between neighbours, all of them, or those nearest to equal shares of the sample."""
    v, n = np.unique(values, return_counts=True)
    middle = v[:-1] + (v[1:] - v[:-1]) / 2
    if len(middle) < BINS:
        return middle
    ends, out = np.cumsum(n), []
    # a cut stands before the first value whose end is farther from the target than the end before it
    between = ends[:-1] + ends[1:]
    for target in np.arange(1, BINS) * len(values) / BINS:
        at = max(int(np.searchsorted(between, 2 * target, "right")), out[-1] + 1 if out else 0)
        if at < len(middle):
            out.append(at)
    return middle[out]


def _thresholds(sample: DataFrame, part: str, names: list[str], parts: list[int]) -> dict[int, list[np.ndarray]]:
    """Of each part to be predicted the thresholds per feature, from a sample of the rows of earlier parts."""
    sizes = {r[0]: r[1] for r in sample.groupBy(part).count().collect() if r[0] is not None}
    known = {s: sum(n for p, n in sizes.items() if p < s) for s in parts}
    share = {s: min(1.0, SAMPLE / n) for s, n in known.items() if n}
    limits = {p: max((share[s] for s in share if s > p), default=0.0) for p in sizes}
    draw = F.pmod(F.xxhash64(F.col("match_num").cast("long"), F.col("y").cast("long"), F.lit("thresholds")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    limit = F.lit(0.0)
    for p, most in limits.items():
        limit = F.when(F.col(part) == p, most).otherwise(limit)
    rows = sample.withColumn("_u", draw).where(F.col("_u") < limit).select(part, "_u", *[F.col(f).cast("double").alias(f"_{i}") for i, f in enumerate(names)]).toArrow()
    at, u = rows.column(0).to_numpy(), rows.column(1).to_numpy()
    out = {}
    for s in share:
        here = (at < s) & (u < share[s])
        out[s] = [_cuts(_plain(rows.column(i + 2), f)[here]) for i, f in enumerate(names)]
    return out


def _plain(column: pa.Array | pa.ChunkedArray, name: str) -> np.ndarray:
    values = column.to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else column.to_numpy()
    if column.null_count or np.isnan(values).any():
        raise ValueError(f"null or NaN in feature {name}")
    return values


_BLOCKS = pa.schema([("part", pa.int64()), ("match_num", pa.binary()), ("y", pa.binary()), ("key", pa.binary()), ("codes", pa.binary())])


def _packed(sample: DataFrame, part: str, names: list[str], edges: list[np.ndarray]) -> DataFrame:
    """Blocks of rows of one part, stored: match_num, y, a key for draws, and each feature's number of edges below its value."""
    kind = np.uint8 if max(map(len, edges)) < 256 else np.uint16

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def block(p: int) -> pa.RecordBatch:
            columns = [np.concatenate(c) for c in zip(*held.pop(p))]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip([p, *[c.tobytes() for c in columns]], _BLOCKS.types)], schema=_BLOCKS)

        for b in batches:
            at, match, y, key = (b.column(i).to_numpy() for i in range(4))
            codes = np.empty((len(at), len(names)), kind)
            for j, f in enumerate(names):
                codes[:, j] = np.searchsorted(edges[j], _plain(b.column(j + 4), f))
            for p in np.unique(at):
                here = at == p
                held.setdefault(int(p), []).append((match[here], y[here].astype(np.uint8), key[here].astype(np.uint32), codes[here]))
                if sum(len(x[0]) for x in held[int(p)]) >= BLOCK:
                    yield block(int(p))
        for p in list(held):
            yield block(p)

    rows = sample.where(F.col(part).isNotNull()).select(F.col(part).cast("long"), F.col("match_num").cast("long"), F.col("y").cast("long"), F.xxhash64(F.col("match_num").cast("long"), F.col("y").cast("long")), *[F.col(f).cast("double").alias(f"_{i}") for i, f in enumerate(names)])
    tasks = max(1, sample.count() * 2 // BLOCK)
    return stored(rows.coalesce(tasks).mapInArrow(pack, "part long, match_num binary, y binary, key binary, codes binary"))


@dataclass
class _Plan:
    """What tasks know: how codes become a part's bins, and the forests so far."""

    codes: type
    tables: dict[int, np.ndarray]  # part -> [feature, code] -> 2 * bin
    forests: list[_Forest]
    level: int

    def block(self, row: dict, part: int) -> tuple[np.ndarray, np.ndarray]:
        """2 * bin + label of every row and feature, flat, and the keys."""
        table = self.tables[part]
        y = np.frombuffer(row["y"], np.uint8)
        codes = np.frombuffer(row["codes"], self.codes).reshape(len(y), -1)
        bins = np.empty(codes.shape, np.uint8)
        for j in range(codes.shape[1]):
            np.take(table[j], codes[:, j], out=bins[:, j], mode="clip")
        bins += y[:, None]
        return bins.ravel(), np.frombuffer(row["key"], np.uint32)


def _walk(tree: _Tree, bins: np.ndarray, base: np.ndarray, steps: int) -> np.ndarray:
    at = np.zeros(len(base), np.intp)
    for _ in range(steps):
        at = tree.left.take(at, mode="clip") + (bins.take(base + tree.feature.take(at, mode="clip"), mode="clip") > tree.cut.take(at, mode="clip"))
    return at


def _shares(tree: _Tree) -> np.ndarray:
    """Each node's share of label 1; a half where no row was drawn."""
    n = tree.counts.sum(1)
    return np.where(n > 0, tree.counts[:, 1] / np.maximum(n, 1), 0.5)


def _counted(tree: _Tree, forest: _Forest, blocks: list, wide: int, level: int) -> np.ndarray:
    """Rows of each node to be split by feature of its draw, bin and label."""
    nodes, k = tree.subset.shape
    total = np.zeros((k, nodes * _WIDE))
    drawn = np.ascontiguousarray(tree.subset.T)
    for bins, key in blocks:
        if forest.bag is None:
            rows, weight = np.arange(len(key)), np.ones(len(key))
        else:
            copies = _draws(key, tree.key, forest.bag)
            rows = np.flatnonzero(copies > 0)
            weight = copies[rows].astype(float)
        base = rows * wide
        slot = tree.slot.take(_walk(tree, bins, base, level), mode="clip")
        if (slot < 0).any():
            there = np.flatnonzero(slot >= 0)
            slot, base, weight = slot[there], base[there], weight[there]
        first = slot * _WIDE
        for j in range(k):
            total[j] += np.bincount(first + bins.take(base + drawn[j].take(slot, mode="clip"), mode="clip"), weight, nodes * _WIDE)
    return total.astype(np.uint16 if total.max() < 1 << 16 else np.int64)


def _counter(plan: _Plan):
    """Tasks' counts: a row per forest and tree. A task holds its blocks, and one tree's counts at a time."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in b.to_pylist()]
        for part in plan.tables:
            blocks = [plan.block(r, part) for r in rows if r["part"] < part]
            wide = len(plan.tables[part])
            for i, forest in enumerate(plan.forests):
                if forest.part != part or not blocks:
                    continue
                for t, tree in enumerate(forest.trees):
                    if len(tree.subset):
                        found = _counted(tree, forest, blocks, wide, plan.level)
                        yield pa.RecordBatch.from_pydict({"forest": pa.array([i], pa.int32()), "tree": pa.array([t], pa.int32()), "short": pa.array([found.dtype == np.uint16]), "counts": pa.array([found.tobytes()], pa.binary())})

    return count


def _impurity(of: np.ndarray, entropy: bool) -> np.ndarray:
    share = of / np.maximum(of.sum(-1, keepdims=True), 1)
    return -(share * np.log2(np.where(share > 0, share, 1))).sum(-1) if entropy else 1 - (share**2).sum(-1)


def _best(counts: np.ndarray, least: int, entropy: bool) -> tuple[np.ndarray, ...]:
    """Of [node, feature, bin, label] each node's rows by label, place of the best feature and bin (-1: no gain), gain, and rows going left."""
    whole = counts[:, 0].sum(1)
    left = np.cumsum(counts, 2)[:, :, :-1]
    right = whole[:, None, None] - left
    a, b = left.sum(-1), right.sum(-1)
    n = np.maximum(whole.sum(-1), 1)[:, None, None]
    gain = _impurity(whole, entropy)[:, None, None] - a / n * _impurity(left, entropy) - b / n * _impurity(right, entropy)
    gain[(a < least) | (b < least)] = -1
    flat = gain.reshape(len(counts), -1)
    best = flat.argmax(1)
    most = flat[np.arange(len(flat)), best]
    place, cut = np.divmod(best, counts.shape[2] - 1)
    return whole, np.where(most > 0, place, -1), cut, most, left[np.arange(len(flat)), place, cut]


def _splitter(plan: _Plan):
    shapes = [[t.subset.shape for t in f.trees] for f in plan.forests]
    kinds = [(f.least, f.entropy) for f in plan.forests]

    def split(table: pa.Table) -> pa.Table:
        i, t = table["forest"][0].as_py(), table["tree"][0].as_py()
        nodes, k = shapes[i][t]
        total = np.zeros((k, nodes, BINS, 2), np.int64)
        for short, counts in zip(table["short"].to_pylist(), table["counts"].to_pylist()):
            total += np.frombuffer(counts, np.uint16 if short else np.int64).reshape(total.shape)
        found = _best(total.transpose(1, 0, 2, 3), *kinds[i])
        return pa.table({"forest": pa.array([i], pa.int32()), "tree": pa.array([t], pa.int32()), "splits": pa.array([pickle.dumps(found)], pa.binary())})

    return split


def _subsets(fit: Fit, tree: int, nodes: Sequence[int], names: dict[str, int]) -> np.ndarray:
    """The features that each node looks at, as places among all."""
    own, n = np.array([names[f] for f in fit.features]), len(fit.features)
    c = fit.classifier
    kind = c.getFeatureSubsetStrategy()
    kind = ("all" if c.getNumTrees() == 1 else "sqrt") if kind == "auto" else kind
    k = {"all": n, "sqrt": math.ceil(math.sqrt(n)), "log2": max(1, math.ceil(math.log2(n))), "onethird": math.ceil(n / 3)}[kind]
    out = [own if k == n else np.sort(own[np.random.default_rng(_number("node", c.getSeed(), tree, x)).permutation(n)[:k]]) for x in nodes]
    return np.array(out, np.intp).reshape(len(out), k)


def _extended(tree: _Tree, found: tuple[np.ndarray, ...], deeper: bool) -> list[int]:
    """Split the nodes as found; the new nodes to be split in turn."""
    whole, place, cut, gain, lefts = found
    active = np.flatnonzero(tree.slot >= 0)[np.argsort(tree.slot[tree.slot >= 0])]
    if len(tree.counts) == 1:
        tree.counts = whole.copy()
    size, new = len(tree.left), []
    for i in np.flatnonzero(place >= 0):
        x = active[i]
        tree.feature[x], tree.cut[x], tree.left[x] = tree.subset[i, place[i]], 2 * cut[i] + 1, size
        tree.gains[int(x)] = float(gain[i])
        new += [lefts[i], whole[i] - lefts[i]]
        size += 2
    n = len(new)
    old = len(tree.left)
    tree.feature = np.concatenate([tree.feature, np.zeros(n, np.intp)])
    tree.cut = np.concatenate([tree.cut, np.full(n, 255, np.uint8)])
    tree.left = np.concatenate([tree.left, np.arange(old, old + n)])
    tree.counts = np.concatenate([tree.counts, np.array(new, np.int64).reshape(n, 2)])
    tree.slot = np.full(old + n, -1, np.intp)
    wanted = [old + j for j in range(n) if deeper and min(new[j]) > 0]
    tree.slot[wanted] = np.arange(len(wanted))
    return wanted


@dataclass
class Grown:
    """Trained forests, with the blocks that they were trained on; close() removes those."""

    fits: list[Fit]
    names: list[str]
    blocks: DataFrame
    plan: _Plan

    def scored(self) -> DataFrame:
        """match_num, y, part, name, p: the rows of each fit's part, for each fit that had rows to learn from."""
        plan, names = self.plan, [f.name for f in self.fits]

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for row in (r for b in batches for r in b.to_pylist()):
                part = row["part"]
                if part not in plan.tables:
                    continue
                bins, key = plan.block(row, part)
                base = np.arange(len(key)) * len(plan.tables[part])
                match, y = np.frombuffer(row["match_num"], np.int64), np.frombuffer(row["y"], np.uint8).astype(np.int32)
                for name, forest in zip(names, plan.forests):
                    if forest.part == part:
                        p = sum(_shares(t)[_walk(t, bins, base, plan.level)] for t in forest.trees) / len(forest.trees)
                        yield pa.RecordBatch.from_arrays([pa.array(match), pa.array(y), pa.repeat(pa.scalar(part, pa.int64()), len(p)), pa.repeat(name, len(p)), pa.array(p)], ["match_num", "y", "part", "name", "p"])

        return self.blocks.mapInArrow(score, "match_num long, y int, part long, name string, p double")

    def importances(self) -> list[list[float]]:
        """Of each fit its features' importances: gains times rows, normed per tree, summed over trees and normed."""
        out = []
        for fit, forest in zip(self.fits, self.plan.forests):
            total = np.zeros(len(self.names))
            for tree in forest.trees:
                one = np.zeros(len(self.names))
                for x, gain in tree.gains.items():
                    one[tree.feature[x]] += gain * tree.counts[x].sum()
                total += one / one.sum() if one.sum() else 0
            own = np.array([total[self.names.index(f)] for f in fit.features])
            out.append((own / own.sum() if own.sum() else own).tolist())
        return out

    def close(self) -> None:
        discard(self.blocks)


def grown(sample: DataFrame, part: str, fits: Sequence[Fit]) -> Grown:
    """The forests of all fits; those without rows in earlier parts are left out."""
    names = list(dict.fromkeys(f for fit in fits for f in fit.features))
    cuts = _thresholds(sample, part, names, sorted({f.part for f in fits}))
    fits = [f for f in fits if f.part in cuts]
    edges = [np.unique(np.concatenate([c[j] for c in cuts.values()])) if cuts else np.array([]) for j in range(len(names))]
    wide = max(map(len, edges)) + 1
    tables = {s: np.array([2 * np.searchsorted(np.searchsorted(edges[j], c[j]), np.arange(wide)) for j in range(len(names))], np.uint8) for s, c in cuts.items()}
    places = {f: j for j, f in enumerate(names)}
    forests = []
    for fit in fits:
        c = fit.classifier
        trees = [_Tree(_number("tree", c.getSeed(), t), np.zeros(1, np.intp), np.full(1, 255, np.uint8), np.zeros(1, np.intp), np.zeros((1, 2), np.int64), np.zeros(1, np.intp), _subsets(fit, t, [0], places)) for t in range(c.getNumTrees())]
        forests.append(_Forest(fit.part, trees, _bag(c.getSubsamplingRate(), c.getBootstrap()), c.getMinInstancesPerNode(), c.getImpurity() == "entropy"))
    blocks = _packed(sample, part, names, edges)
    plan = _Plan(np.uint8 if wide <= 256 else np.uint16, tables, forests, 0)
    while any(len(t.subset) for f in forests for t in f.trees):
        counts = blocks.mapInArrow(_counter(plan), "forest int, tree int, short boolean, counts binary")
        for r in counts.groupBy("forest", "tree").applyInArrow(_splitter(plan), "forest int, tree int, splits binary").collect():
            tree, fit = forests[r.forest].trees[r.tree], fits[r.forest]
            new = _extended(tree, pickle.loads(r.splits), plan.level + 1 < fit.classifier.getMaxDepth())
            tree.subset = _subsets(fit, r.tree, new, places)
        plan.level += 1
    return Grown(list(fits), names, blocks, plan)
