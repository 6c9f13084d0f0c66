"""Embedding whitening by the exact characteristic polynomial of the integer scatter.

Each entry becomes an integer, each distinct integer vector x counts once, and with n of them, sums
S and m = floor(S / n) the scatter

    M = n * sum (x - m)(x - m)^T - D D^T,   D = S - n m,   covariance V = M / n^2

is an exact integer matrix: tasks add their part of it, one row per entry.  Then

1. det(t I - M) modulo many 31-bit primes, a task each: Hessenberg reduction and its recurrence; the
   integer coefficients follow by Chinese remaindering, and one spare prime checks them;
2. all roots are real, so the sign changes of the coefficients of p(t + a) count the roots beyond a
   exactly (with multiplicity); bisection isolates the largest roots and the sign of p narrows each
   to ``EXTRA`` bits behind the point;
3. inverse iteration with an LU of M - t I in long decimals gives the null space of each root, one
   task per distinct root; equal roots give an orthonormal basis.

Only quantities of the size of M, whose size follows the dimension alone, reach the driver.
"""

from __future__ import annotations

import decimal
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratafin.llm.common import map_batches
from stratafin.session import stage

SCALE = 256.0
COMPONENTS = 4
#: Bits of a root behind the binary point, and of the digits in which tasks hand over their sums.
EXTRA, LIMB, LIMBS = 192, 32, 5
#: Integers below this are exact as doubles.
EXACT = 1 << 53


def usable(vector: Column) -> Column:
    """Whether a vector is there and holds finite numbers only."""
    return F.coalesce(F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(math.inf))), F.lit(False))


def integers(vector: Column, scale: float = SCALE) -> Column:
    """floor(scale * c) of each entry; what 64 bits can't hold becomes the nearest they can."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * scale))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column of equal lengths."""
    return column.flatten().to_numpy().reshape(len(column), -1)


def products(z: np.ndarray, bound: int) -> np.ndarray:
    """z^T z exactly, for entries of at most ``bound``: doubles while they hold every sum."""
    total = np.zeros((z.shape[1], z.shape[1]), object)
    if bound * bound >= EXACT:
        wide = z.astype(object)
        return total + wide.T @ wide
    step = max(1, EXACT // max(bound * bound, 1))
    for at in range(0, len(z), step):
        part = z[at : at + step].astype(np.float64)
        total += (part.T @ part).astype(np.int64)
    return total


def limbs(value: int) -> list[int]:
    """Digits to the base 2^32, lowest first; the last one carries the sign."""
    return [(value >> (LIMB * i)) & ((1 << LIMB) - 1) for i in range(LIMBS - 1)] + [value >> (LIMB * (LIMBS - 1))]


def summed(fit: DataFrame, part) -> dict[int, int]:
    """Exact sums over all rows of what ``part`` gives for a matrix of rows: a vector of integers.

    A task adds up its rows; a row per entry leaves it, as digits that 64-bit sums hold.
    """

    def run(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                own = part(matrix(batch.column(0)))
                total = own if total is None else total + own
        if total is not None:
            digits = np.array([limbs(int(v)) for v in total], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int64()), *[pa.array(digits[:, i]) for i in range(LIMBS)]], ["k", *[f"l{i}" for i in range(LIMBS)]])

    rows = map_batches(fit.select("x"), run, "k long, " + ", ".join(f"l{i} long" for i in range(LIMBS)))
    found = rows.groupBy("k").agg(*[F.sum(f"l{i}").alias(f"l{i}") for i in range(LIMBS)]).collect()  # a row per entry of the scatter
    return {r["k"]: sum(r[f"l{i}"] << (LIMB * i) for i in range(LIMBS)) for r in found}


def _counts(x: np.ndarray) -> np.ndarray:
    largest = max(abs(int(x.min())), abs(int(x.max()))) if x.size else 0
    sums = x.sum(axis=0) if largest * len(x) < 1 << 62 else x.astype(object).sum(axis=0)
    return np.array([len(x), *[int(s) for s in sums]], object)


def scatter(fit: DataFrame, dimension: int) -> tuple[int, list[int], list[list[int]]]:
    """(n, S, M) of the distinct vectors (x)."""
    sums = summed(fit, _counts)
    n, s = sums[0], [sums[1 + j] for j in range(dimension)]
    centre = [v // n for v in s]

    def centred(x: np.ndarray) -> np.ndarray:
        bound = max(max(abs(int(x.min())), abs(int(x.max()))) + max(map(abs, centre)), 1)
        z = x - np.array(centre, np.int64) if bound < 1 << 62 else x.astype(object) - np.array(centre, object)
        return products(z, bound)[np.triu_indices(dimension)]

    around = summed(fit, centred)
    rest = [v - n * c for v, c in zip(s, centre, strict=True)]
    m = [[0] * dimension for _ in range(dimension)]
    for k, (i, j) in enumerate(zip(*np.triu_indices(dimension), strict=True)):
        m[i][j] = m[j][i] = n * around[k] - rest[i] * rest[j]
    return n, s, m


def is_prime(n: int) -> bool:
    """Miller-Rabin with the bases that settle every number below 2^32."""
    if n < 2 or any(n % p == 0 for p in (2, 7, 61)):
        return n in (2, 7, 61)
    d, r = n - 1, 0
    while d % 2 == 0:
        d, r = d // 2, r + 1
    for a in (2, 7, 61):
        x = pow(a, d, n)
        if x in (1, n - 1):
            continue
        for _ in range(r - 1):
            x = x * x % n
            if x == n - 1:
                break
        else:
            return False
    return True


def primes(bound: int) -> list[int]:
    """31-bit primes whose product exceeds ``bound``, and a spare one."""
    found, product, p = [], 1, (1 << 31) - 1
    while product <= bound:
        if is_prime(p):
            found.append(p)
            product *= p
        p -= 2
    while not is_prime(p):
        p -= 2
    return [*found, p]


def hessenberg(a: np.ndarray, p: int) -> np.ndarray:
    """A matrix similar to ``a`` modulo p with zeros below its first subdiagonal."""
    h, n = a.copy(), len(a)
    for k in range(n - 2):
        below = np.flatnonzero(h[k + 1 :, k])
        if not len(below):
            continue
        row = k + 1 + int(below[0])
        if row != k + 1:
            h[[k + 1, row]] = h[[row, k + 1]]
            h[:, [k + 1, row]] = h[:, [row, k + 1]]
        factor = h[k + 2 :, k] * pow(int(h[k + 1, k]), -1, p) % p
        h[k + 2 :] = (h[k + 2 :] - factor[:, None] * h[k + 1] % p) % p
        h[:, k + 1] = (h[:, k + 1] + (h[:, k + 2 :] * factor % p).sum(axis=1)) % p
    return h


def polynomial(a: np.ndarray, p: int) -> np.ndarray:
    """Coefficients of det(t I - a) modulo p, constant first."""
    h, n = hessenberg(a, p), len(a)
    polys = np.zeros((n + 1, n + 1), np.int64)
    polys[0, 0] = 1
    for k in range(n):
        polys[k + 1, 1:] = polys[k, :-1]
        chain, weights = 1, np.zeros(k + 1, np.int64)
        weights[k] = h[k, k]
        for i in range(k - 1, -1, -1):
            chain = chain * int(h[i + 1, i]) % p
            weights[i] = int(h[i, k]) * chain % p
        polys[k + 1] = (polys[k + 1] - (polys[: k + 1] * weights[:, None] % p).sum(axis=0)) % p
    return polys[n]


def remaindered(residues: list[list[int]], moduli: list[int]) -> list[int]:
    """The integers, nearest zero, with these residues: one list of residues per modulus."""
    product = math.prod(moduli)
    units = [product // p * pow(product // p, -1, p) for p in moduli]
    found = [sum(r * u for r, u in zip(column, units, strict=True)) % product for column in zip(*residues, strict=True)]
    return [v - product if 2 * v > product else v for v in found]


def characteristic(spark, m: list[list[int]]) -> list[int]:
    """Integer coefficients of det(t I - m), constant first, for a matrix without negative roots:
    the k-th elementary sum of its roots is at most C(d, k) (trace / d)^k."""
    d, trace = len(m), sum(m[i][i] for i in range(len(m)))
    mean = -(-trace // d)
    bound = 2 * max(math.comb(d, k) * mean**k for k in range(d + 1))
    moduli = primes(bound)
    shared = spark.sparkContext.broadcast(np.array(m, object))

    def run(batches):
        for batch in batches:
            at = batch.column(0).to_pylist()
            rows = [polynomial((shared.value % moduli[i]).astype(np.int64), moduli[i]).tolist() for i in at]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.int64()))], ["id", "c"])

    rows = map_batches(spark.range(0, len(moduli), 1, min(len(moduli), 64)), run, "id long, c array<bigint>").collect()  # follows the dimension
    found = {r["id"]: list(r["c"]) for r in rows}
    known = [found[i] for i in range(len(moduli) - 1)]
    whole = remaindered(known, moduli[:-1])
    if [v % moduli[-1] for v in whole] != found[len(moduli) - 1]:
        raise ArithmeticError("the remainders don't fit one polynomial")
    return whole


def beyond(poly: list[int], a: int) -> int:
    """How many roots of a polynomial with real roots only exceed a, with multiplicity."""
    c = list(poly)
    if a:
        for i in range(len(c) - 1):
            for j in range(len(c) - 2, i - 1, -1):
                c[j] += a * c[j + 1]
    signs = [v > 0 for v in c if v]
    return sum(x != y for x, y in zip(signs, signs[1:], strict=False))


def scaled(poly: list[int], bits: int) -> list[int]:
    """The polynomial whose roots are 2^bits times those of ``poly``."""
    return [c << (bits * (len(poly) - 1 - i)) for i, c in enumerate(poly)]


def value_sign(poly: list[int], t: int) -> int:
    total = 0
    for c in reversed(poly):
        total = total * t + c
    return (total > 0) - (total < 0)


def _least(low: int, high: int, reached) -> int:
    """The smallest integer in (low, high] that ``reached`` accepts; it accepts high."""
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (low, mid) if reached(mid) else (mid, high)
    return high


def largest_roots(poly: list[int], count: int, top: int, bits: int = EXTRA) -> list[int]:
    """The ``count`` largest roots, none negative and none beyond ``top``, falling, each as the
    integer that bounds 2^bits times the root from above; equal roots repeat."""
    found, fine = [], scaled(poly, bits)
    for j in range(1, count + 1):
        whole = _least(-1, top, lambda t: beyond(poly, t) < j)  # noqa: B023
        low, high = max((whole - 1) << bits, -1), whole << bits
        if whole and beyond(poly, whole - 1) - beyond(poly, whole) == 1:
            above = 1 if j % 2 else -1
            found.append(_least(low, high, lambda t: value_sign(fine, t) in (0, above)))  # noqa: B023
        else:
            found.append(_least(low, high, lambda t: beyond(fine, t) < j))  # noqa: B023
    return found


def null_space(m: list[list[int]], root: int, bits: int, count: int) -> list[list[float]]:
    """``count`` orthonormal vectors of the null space of m - root / 2^bits, by inverse iteration."""
    d = len(m)
    digits = len(str(max(max(map(abs, row)) for row in m))) + int(bits * 0.31) + 40
    with decimal.localcontext() as context:
        context.prec, context.Emin, context.Emax = digits, decimal.MIN_EMIN, decimal.MAX_EMAX
        shift = decimal.Decimal(root) / decimal.Decimal(1 << bits)
        a = [[decimal.Decimal(v) for v in row] for row in m]
        for i in range(d):
            a[i][i] -= shift
        tiny = decimal.Decimal(max(1, max(max(map(abs, row)) for row in m))).scaleb(10 - digits)
        order = list(range(d))
        for k in range(d):
            best = max(range(k, d), key=lambda i: abs(a[i][k]))  # noqa: B023
            a[k], a[best], order[k], order[best] = a[best], a[k], order[best], order[k]
            if abs(a[k][k]) < tiny:
                a[k][k] = tiny
            head, pivot = a[k], a[k][k]
            for i in range(k + 1, d):
                row = a[i]
                if row[k]:
                    f = row[k] / pivot
                    row[k] = f
                    for j in range(k + 1, d):
                        row[j] -= f * head[j]

        def solve(b: list) -> list:
            y = [b[i] for i in order]
            for i in range(d):
                y[i] -= sum((a[i][j] * y[j] for j in range(i)), decimal.Decimal(0))
            for i in range(d - 1, -1, -1):
                y[i] = (y[i] - sum((a[i][j] * y[j] for j in range(i + 1, d)), decimal.Decimal(0))) / a[i][i]
            return y

        def unit(v: list, others: list[list]) -> list:
            for _ in range(2):
                for o in others:
                    along = sum((x * y for x, y in zip(v, o, strict=True)), decimal.Decimal(0))
                    v = [x - along * y for x, y in zip(v, o, strict=True)]
                length = sum((x * x for x in v), decimal.Decimal(0)).sqrt()
                v = [x / length for x in v]
            return v

        rng, found = np.random.default_rng(d), []
        for _ in range(count):
            v = [decimal.Decimal(int(x)) for x in rng.integers(1, 1 << 30, d)]
            for _ in range(3):
                v = unit(solve(v), found)
            found.append(v)
        out = []
        for v in found:
            sign = 1 if max(v, key=abs) > 0 else -1
            out.append([float(sign * x) for x in v])
        return out


def eigenvectors(spark, m: list[list[int]], roots: list[int]) -> np.ndarray:
    """A unit vector per root, in their order; runs of equal roots share a task."""
    runs: list[tuple[int, int]] = []
    for i, r in enumerate(roots):
        if not i or r != roots[i - 1]:
            runs.append((i, sum(x == r for x in roots)))
    shared = spark.sparkContext.broadcast(m)

    def run(batches):
        for batch in batches:
            at, rows = [], []
            for i in batch.column(0).to_pylist():
                first, count = runs[i]
                at += range(first, first + count)
                rows += null_space(shared.value, roots[first], EXTRA, count)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(rows, pa.list_(pa.float64()))], ["id", "v"])

    found = map_batches(spark.range(0, len(runs), 1, len(runs)), run, "id long, v array<double>").collect()  # a row per component
    return np.array([r["v"] for r in sorted(found, key=lambda r: r["id"])])


class Whitening:
    """What is learnt from the distinct vectors: n, S, components (rows), their eigenvalues and
    shares of the trace, and the largest error of the whitened covariance."""

    def __init__(self, fit: DataFrame, dimension: int, components: int):
        spark = fit.sparkSession
        self.n, self.sums, m = scatter(fit, dimension)
        trace = sum(m[i][i] for i in range(dimension))
        roots = largest_roots(characteristic(spark, m), min(components, dimension), trace)
        self.vectors = eigenvectors(spark, m, roots)
        one = 1 << EXTRA
        self.explained = [r / (trace * one) if trace else None for r in roots]
        with decimal.localcontext() as context:
            context.prec = 60
            self.deviations = [float((decimal.Decimal(r) / one).sqrt() / self.n) for r in roots]  # square roots of eigenvalues
        self.mean = np.array([float(decimal.Decimal(s) / self.n) for s in self.sums])
        self.error = self._identity_error(fit)

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened values, a column per component; NaN along a component without variance."""
        along = (x.astype(np.float64) - self.mean) @ self.vectors.T
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(np.array(self.deviations) > 0, along / np.array(self.deviations), np.nan)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """sum (n x - S)^2 of each row, exact; None where 64 bits don't hold it."""
        largest = self.n * max(abs(int(x.min())), abs(int(x.max()))) + max(map(abs, self.sums))
        if largest * largest * x.shape[1] < 1 << 63:
            y = self.n * x - np.array(self.sums, np.int64)
            return (y * y).sum(axis=1).tolist()
        y = self.n * x.astype(object) - np.array(self.sums, object)
        return [int(v) if v < 1 << 63 else None for v in (y * y).sum(axis=1)]

    def _identity_error(self, fit: DataFrame) -> float | None:
        use = [i for i, d in enumerate(self.deviations) if d > 0]
        if not use:
            return None
        project = self.project

        def run(batches):
            for batch in batches:
                w = project(matrix(batch.column(0)))
                yield pa.RecordBatch.from_arrays([pa.array(w[:, i]) for i in use], [f"w{i}" for i in use])

        w = map_batches(fit.select("x"), run, ", ".join(f"w{i} double" for i in use))
        pairs = [(i, j) for i in use for j in use if i <= j]
        found = w.agg(*[F.covar_pop(f"w{i}", f"w{j}").alias(f"c{i}_{j}") for i, j in pairs]).first()
        return max(abs(found[f"c{i}_{j}"] - (i == j)) for i, j in pairs)


RESULT = [
    ("component", T.IntegerType()),
    ("n", T.LongType()),
    ("deviation", T.LongType()),
    ("whitened", T.DoubleType()),
    ("explained", T.DoubleType()),
    ("identity_error", T.DoubleType()),
]


def whiten(vectors: DataFrame, components: int = COMPONENTS, keep: tuple[str, ...] = ("vec_id",), vector_col: str = "embedding", scale: float = SCALE) -> DataFrame:
    """Rows of ``keep`` and, for each component, what ``RESULT`` lists.

    Rows whose vector is null or holds null or non-finite entries are dropped, and so are rows whose
    vector is not as long as most are (of equally many, the shorter).  Repeated rows and ids stay as
    rows but a vector counts once.  An empty table, or vectors without entries, give no rows.  Along
    a component without variance ``whitened`` is null and ``identity_error`` leaves it out; without
    any variance ``explained`` and ``identity_error`` are null too.
    """
    spark = vectors.sparkSession
    schema = T.StructType([T.StructField(c, vectors.schema[c].dataType) for c in keep] + [T.StructField(c, t) for c, t in RESULT])
    rows = vectors.where(usable(F.col(vector_col))).select(*keep, integers(F.col(vector_col), scale).alias("__x"))
    size = rows.groupBy(F.size("__x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if size is None or not size["d"]:
        return spark.createDataFrame([], schema)
    rows = rows.where(F.size("__x") == size["d"])
    fit = stage(rows.select(F.col("__x").alias("x")).distinct())
    found = Whitening(fit, size["d"], components)
    count = len(found.vectors)

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column(len(keep)))
            each = pa.array(np.repeat(np.arange(batch.num_rows), count))
            white = found.project(x).ravel()
            own = [batch.column(i).take(each) for i in range(len(keep))]
            size = batch.num_rows * count
            values = [
                pa.array(np.tile(np.arange(1, count + 1), batch.num_rows), pa.int32()),
                pa.array(np.full(size, found.n), pa.int64()),
                pa.array(found.deviation(x), pa.int64()).take(each),
                pa.array(white, pa.float64(), mask=np.isnan(white)),
                pa.array(found.explained * batch.num_rows, pa.float64()),
                pa.array([found.error] * size, pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays([*own, *values], schema.names)

    return map_batches(rows, run, schema)
