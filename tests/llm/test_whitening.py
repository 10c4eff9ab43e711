import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from boutlog.llm import whitening

RND = random.Random(5)


def brute(rows):
    """id -> (n, deviation), and the exact covariance of the distinct integer vectors."""
    whole = [(i, tuple(math.floor(256 * c) for c in v)) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({x for _, x in whole})
    n, d = len(fit), len(fit[0])
    s = [sum(x[j] for x in fit) for j in range(d)]
    cov = [[Fraction(sum((n * x[i] - s[i]) * (n * x[j] - s[j]) for x in fit), n**3) for j in range(d)] for i in range(d)]
    return whole, fit, n, s, cov


def test_primes_and_remainders():
    moduli = whitening.primes_for(10**30)
    assert len(set(moduli)) == len(moduli) and max(moduli) < 1 << 20
    for v in (0, 1, -1, 10**30, -(10**30), 123456789012345678901234567890):
        assert whitening.reconstructed({p: v % p for p in moduli}) == v
    with pytest.raises(ArithmeticError):
        whitening.reconstructed({p: (7 if p == moduli[0] else 8) for p in moduli})


@pytest.mark.parametrize("size", [1.0, 1e9])
def test_equals_exact_arithmetic(spark, size):
    rows = [(i, [float(np.float32(RND.gauss(0, 1) * size * (j + 1))) for j in range(6)]) for i in range(300)]
    rows += [(1000 + i, rows[0][1]) for i in range(400)] + [(None, rows[1][1]), (None, rows[1][1])]  # one vector of half the rows
    rows += [(2000, None), (2001, [None] * 6), (2002, [float("nan")] * 6), (2003, [1.0, float("inf"), 0.0, 0.0, 0.0, 0.0]), (2004, [-0.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"x": F.lit(1), "n": F.lit("own"), "dim": F.lit(0)}).repartition(5)
    got = whitening.whitened_rows(df).toPandas()
    whole, fit, n, s, cov = brute(rows)
    values, vectors = np.linalg.eigh(np.array(cov, float))
    trace = float(sum(cov[i][i] for i in range(6)))
    assert len(got) == 4 * len(whole) and set(got.n) == {n} and got.identity_error.max() < 1e-9
    signs = {}
    for i, x in whole:
        mine = got[got.vec_id == i] if i is not None else got[got.vec_id.isna()][:4]
        c = [n * a - b for a, b in zip(x, s)]
        exact = sum(v * v for v in c)
        for r in mine.itertuples():
            k = 6 - r.component
            want = float(sum(Fraction(v, n) * Fraction(float(u)) for v, u in zip(c, vectors[:, k]))) / math.sqrt(values[k])
            if abs(want) > 1e-6:
                signs.setdefault(r.component, np.sign(want * r.whitened))
            assert abs(signs.get(r.component, 1) * r.whitened - want) < 1e-9 * max(1, abs(want))
            assert abs(r.explained - values[k] / trace) < 1e-12
            assert (r.deviation == exact) if exact < 1 << 63 else np.isnan(r.deviation)


def test_no_or_few_vectors(spark):
    schema = "vec_id long, embedding array<double>"
    assert whitening.whitened_rows(spark.createDataFrame([], schema)).count() == 0
    one = whitening.whitened_rows(spark.createDataFrame([(1, [0.5, 0.25]), (2, [0.5, 0.25]), (3, [])], schema)).collect()
    assert {(r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one} == {(i, k, 1, 0, None, None, None) for i in (1, 2) for k in (1, 2)}
    # points on a line have one component; vectors of another length are apart
    some = [(i, [float(i), 2.0 * i, -1.0 * i]) for i in range(5)] + [(10 + i, [float(i % 2), float(i // 2)]) for i in range(4)]
    got = whitening.whitened_rows(spark.createDataFrame(some, schema)).collect()
    assert all((r.whitened is None) == (r.component > 1) and r.n == 5 for r in got if r.vec_id < 10)
    assert all(abs(abs(r.whitened) - 1) < 1e-12 and r.n == 4 and r.component <= 2 for r in got if r.vec_id >= 10)
    assert max(r.identity_error for r in got) < 1e-12


def test_long_vectors(spark):
    rows = [(i, [RND.random() for _ in range(300)]) for i in range(40)]
    got = whitening.whitened_rows(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert len(got) == 160 and all(abs(r.whitened) < 10 and r.identity_error < 1e-9 for r in got)
