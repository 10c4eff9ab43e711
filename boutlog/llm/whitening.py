"""Whitening of embeddings from an exact scatter matrix: modular products, Chinese remaindering, one double eigendecomposition.

Entries become integers x = floor(scale * c). The fit list is each distinct x vector once. Per partition the vectors, with a
one put after each, are reduced modulo several primes below 2^20, and multiplied with themselves: a block of 8,192 rows stays
below 2^53, so products in doubles are exact. Residues of all partitions are summed by Spark and reconstructed by Chinese
remaindering into the exact count, sums and cross sums (the number of primes follows from the largest entry and the count,
and one prime more must agree). n * sum(x_i x_j) - S_i S_j is the centred scatter times n, exact; its quotient by n^2, rounded
once, goes to the eigendecomposition.

What reaches the driver is bounded by the dimension (its square times the primes), whatever the number of vectors. A vector
repeated by a third of all rows is one row of the fit list, collapsed before the shuffle.

Null vectors and those with null, NaN or infinite entries are dropped; entries beyond a long stop at its ends. Vectors of
different lengths are whitened apart, each length with its own fit list; an empty vector has no component, so no row. A
component whose eigenvalue is zero in doubles (one distinct vector, or fewer than the component's number of independent ones)
has no whitened value (null) and counts in no identity error; the explained share of a zero covariance is null. A deviation
beyond a long is null. Null and repeated ids stay as they are, each row its own; ties of eigenvalues keep the order of the
decomposition. An empty table gives no rows. Other columns are not looked at. A vector is held whole in the task that reads it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from boutlog.session import discard, stored

SCALE, COMPONENTS = 256, 4
BLOCK = 8192  # rows of a modular product: BLOCK * (2^20)^2 = 2^53
_LONG = 1 << 63


def primes(count: int, below: int = 1 << 20) -> list[int]:
    """The ``count`` largest primes under ``below``, falling."""
    out, n = [], below - 1
    while len(out) < count:
        if all(n % k for k in range(2, math.isqrt(n) + 1)):
            out.append(n)
        n -= 1
    return out


def primes_for(bound: int) -> list[int]:
    """As many primes as tell all values of at most ``bound`` in size apart, and one more as a check."""
    k = 1
    while math.prod(primes(k)) <= 2 * bound:
        k += 1
    return primes(k + 1)


def remaindered(residues: dict[int, int]) -> int:
    """The value of least size with these residues (prime -> residue)."""
    value, modulus = 0, 1
    for p, r in residues.items():
        value += modulus * ((r - value) * pow(modulus, -1, p) % p)
        modulus *= p
    return value - modulus if value > modulus // 2 else value


def reconstructed(residues: dict[int, int]) -> int:
    """remaindered() without the last prime, which must agree."""
    *used, spare = residues
    value = remaindered({p: residues[p] for p in used})
    if (value - residues[spare]) % spare:
        raise ArithmeticError(f"residues do not agree modulo {spare}")
    return value


def scaled(embedding: str, scale: int = SCALE) -> Column:
    """The integers of a vector; null where it is null or holds null, NaN or infinite entries."""
    finite = F.forall(embedding, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return F.when(F.coalesce(finite, F.lit(False)), F.transform(embedding, lambda c: F.floor(c.cast("double") * scale)))


def _blocks(lists: pa.ListArray, most: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix) of the vectors, by length, at most ``most`` rows at a time."""
    starts, values = np.asarray(lists.offsets), np.asarray(lists.values)
    sizes = np.diff(starts)
    for d in np.unique(sizes):
        rows = np.flatnonzero(sizes == d)
        for i in range(0, len(rows), most):
            some = rows[i : i + most]
            yield some, values[starts[some][:, None] + np.arange(d)]


def residue_products(fit: DataFrame, moduli: list[int]) -> DataFrame:
    """dim, prime, cell, residue: sums over partitions of the products of (x, 1) with itself modulo each prime, upper triangle by rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for _, x in _blocks(batch.column(0)):
                one = np.concatenate([x, np.ones((len(x), 1), np.int64)], axis=1)
                for p in moduli:
                    r = (one % p).astype(np.float64)
                    product = (r.T @ r).astype(np.int64) % p
                    key = (x.shape[1], p)
                    total[key] = (total[key] + product) % p if key in total else product
        for (d, p), m in total.items():
            cells = m[np.triu_indices(d + 1)]
            for i in range(0, len(cells), 1 << 16):
                part = cells[i : i + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), v, np.int64)) for v in (d, p)] + [pa.array(np.arange(i, i + len(part))), pa.array(part)], names=["dim", "prime", "cell", "residue"])

    made = fit.select("x").mapInArrow(run, "dim long, prime long, cell long, residue long")
    return made.groupBy("dim", "prime", "cell").agg(F.sum("residue").alias("residue"))


@dataclass
class Whitening:
    """The whitening of vectors of one length: exact n and sums, eigenvalues (falling) and unit components (columns)."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def usable(self, k: int) -> bool:
        """Whether component k (0-based) has an eigenvalue above the rounding of the decomposition."""
        return self.values[k] > len(self.values) * np.finfo(float).eps * self.values[0]

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact: longs, or Python integers where those would overflow."""
        most = self.n * int(max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))) + max(map(abs, self.sums), default=0)
        kind = np.int64 if most < _LONG else object
        return x.astype(kind) * self.n - np.array(self.sums, kind)

    def deviations(self, centred: np.ndarray) -> list[int | None]:
        """Per row the sum of squares of n * x - S; None beyond a long."""
        most = max((abs(int(v)) for v in (centred.max(initial=0), centred.min(initial=0))), default=0)
        if most * most * max(1, centred.shape[1]) < _LONG:
            return (centred.astype(np.int64) ** 2).sum(axis=1).tolist()
        exact = (centred.astype(object) ** 2).sum(axis=1).tolist()
        return [v if v < _LONG else None for v in exact]

    def explained(self, k: int) -> list[float | None]:
        """The shares of the first k components in the trace; None where that is zero."""
        return [float(v / self.trace) if self.trace > 0 else None for v in self.values[:k]]

    def whitened(self, centred: np.ndarray, k: int) -> np.ndarray:
        """(x - S / n) projected on the first k components, over the roots of their eigenvalues; NaN where those are not usable."""
        roots = np.array([math.sqrt(self.values[i]) if self.usable(i) else np.nan for i in range(k)])
        return (centred.astype(np.float64) / self.n) @ self.vectors[:, :k] / roots


def _decomposed(d: int, cells: list[int]) -> Whitening:
    """The whitening of exact upper-triangle sums of (x, 1) with itself."""
    full = [[0] * (d + 1) for _ in range(d + 1)]
    for (i, j), v in zip(((i, j) for i in range(d + 1) for j in range(i, d + 1)), cells):
        full[i][j] = full[j][i] = v
    n, sums = full[d][d], full[d][:d]
    v = np.array([[(n * full[i][j] - sums[i] * sums[j]) / (n * n) for j in range(d)] for i in range(d)], float).reshape(d, d)
    values, vectors = np.linalg.eigh(v)
    trace = sum(n * full[i][i] - sums[i] * sums[i] for i in range(d)) / (n * n)
    return Whitening(n, sums, values[::-1], vectors[:, ::-1], trace)


def fit_whitening(fit: DataFrame) -> dict[int, Whitening]:
    """Dimension -> whitening, of a stored frame of distinct integer vectors x."""
    most = fit.agg(F.count("*").alias("n"), F.max(F.array_max("x")).alias("hi"), F.min(F.array_min("x")).alias("lo")).first()
    largest = max(abs(most["hi"] or 0), abs(most["lo"] or 0), 1)
    moduli = primes_for(most["n"] * largest * largest)
    cells: dict[int, dict[int, dict[int, int]]] = {}
    for r in residue_products(fit, moduli).collect():
        cells.setdefault(r["dim"], {}).setdefault(r["cell"], {})[r["prime"]] = r["residue"] % r["prime"]
    return {d: _decomposed(d, [reconstructed({p: by[c][p] for p in moduli}) for c in range(len(by))]) for d, by in cells.items() if d}


def whiten(vectors: DataFrame, models: dict[int, Whitening], components: int = COMPONENTS) -> DataFrame:
    """vectors (with integer vectors x) with dim, n, deviation, and arrays over the first components: explained, and whitened (null where one has none)."""
    keep = [c for c in vectors.columns if c != "x"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("x")
            for rows, x in _blocks(batch.column(at)):
                model = models.get(x.shape[1])
                if model is None:  # empty vectors
                    continue
                centred = model.centred(x)
                k = min(components, x.shape[1])
                w = model.whitened(centred, k)
                flat = pa.array(w.ravel(), mask=np.isnan(w).ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, w.size + 1, k, dtype=np.int32)), flat)
                own = [batch.column(batch.schema.get_field_index(c)).take(pa.array(rows)) for c in keep]
                more = [pa.array(np.full(len(rows), v, np.int64)) for v in (x.shape[1], model.n)] + [pa.array(model.deviations(centred), pa.int64()), lists]
                more.append(pa.array([model.explained(k)] * len(rows), pa.list_(pa.float64())))
                yield pa.RecordBatch.from_arrays([*own, *more], names=[*keep, "dim", "n", "deviation", "whitened", "explained"])

    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema.fields}
    own = "".join(f"`{c}` {kinds[c]}, " for c in keep)
    return vectors.select(*keep, "x").mapInArrow(run, f"{own}dim long, n long, deviation long, whitened array<double>, explained array<double>")


def identity_error(fit: DataFrame, models: dict[int, Whitening], components: int = COMPONENTS) -> float | None:
    """The largest absolute entry of the fit list's whitened covariance minus the identity; null without a usable component."""
    w = whiten(fit, models, components)
    at = [F.get("whitened", F.lit(i)) for i in range(components)]
    pairs = [(i, j) for i in range(components) for j in range(i, components)]
    found = w.groupBy("dim").agg(*[F.covar_pop(at[i], at[j]).alias(f"c{i}_{j}") for i, j in pairs]).collect()
    errors = [abs(r[f"c{i}_{j}"] - (i == j)) for r in found for i, j in pairs if r[f"c{i}_{j}"] is not None]
    return max(errors, default=None)


def whitened_rows(embeddings: DataFrame, key: str = "vec_id", embedding: str = "embedding", scale: int = SCALE, components: int = COMPONENTS) -> DataFrame:
    """key, component, n, deviation, whitened, explained, identity_error: a row per vector and component."""
    whole = embeddings.select(F.col(key).alias("id"), scaled(embedding, scale).alias("x")).where("x IS NOT NULL")
    fit = stored(whole.select("x").distinct())
    models = fit_whitening(fit)
    error = identity_error(fit, models, components)
    discard(fit)
    rows = whiten(whole, models, components).select("id", "n", "deviation", "explained", F.posexplode("whitened").alias("at", "whitened"))
    return rows.select(F.col("id").alias(key), (F.col("at") + 1).cast("int").alias("component"), "n", "deviation", "whitened", F.get("explained", F.col("at")).alias("explained"), F.lit(error).cast("double").alias("identity_error"))
