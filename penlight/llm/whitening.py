"""Operator 12: whitening of embeddings by QDWH spectral divide-and-conquer.

Components of vectors become integers x = floor(64 * c) + 1000000. Sums and products are
taken in integers, so that they are exact in any order: x is centred at the whole number
nearest to its mean, tasks add up the products, and the rest of the mean is taken off as a
fraction before anything is rounded. One square matrix, bounded by the width of a vector,
reaches the driver.

Its components come from spectral divide-and-conquer: the polar factor of the covariance,
shifted into the middle of its diagonal, has eigenvalue 1 on one invariant subspace and -1
on the other; (factor + 1) / 2 projects on the first. Bases of both split the matrix into
two smaller ones, down to two by two. The factor comes from the dynamically weighted Halley
iteration (QDWH), by QR while the matrix is ill-conditioned and by Cholesky after that. A
shift that hits an eigenvalue shows in the factor's square and is moved.

The whitening matrix (width times `COMPONENTS`) goes to the tasks; whitened vectors are
written, and their covariance is measured on what was written.

Nulls and edges: vectors that are null, empty or hold a null or non-finite entry are
dropped, and so are vectors of another width than most have (the smaller width of equally
frequent ones); a null id is an id; repeated rows count as often as they stand; a component
without variance (up to rounding) has null `whitened`; a deviation beyond 64 bits is null;
entries of 2**43 and more raise an error; an empty table gives an empty result; input
columns that bear the name of an output column are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from penlight.llm._shared import written
from penlight.llm._vector_shards import usable

COMPONENTS, SCALE, SHIFT = 32, 64, 1_000_000
#: Entries below this keep the sums of a batch within 64 bits.
LARGEST = 2.0**43
EPS = float(np.finfo(float).eps)


def polar_factor(a: np.ndarray) -> np.ndarray:
    """The orthogonal factor of a symmetric matrix, by QDWH; of a singular one, what the iteration comes to."""
    n = len(a)
    x = a / np.sqrt(np.abs(a).sum(axis=0).max() * np.abs(a).sum(axis=1).max())
    try:
        low = max(min(1 / np.linalg.norm(np.linalg.inv(x)), 1.0), EPS)
    except np.linalg.LinAlgError:
        low = EPS
    eye = np.eye(n)
    for _ in range(40):
        square = low * low
        d = np.cbrt(4 * (1 - square) / square**2)
        root = np.sqrt(1 + d)
        p = root + 0.5 * np.sqrt(max(8 - 4 * d + 8 * (2 - square) / (square * root), 0.0))
        q = (p - 1) ** 2 / 4
        c = p + q - 1
        if c > 100:
            both, _ = np.linalg.qr(np.vstack([np.sqrt(c) * x, eye]))
            step = (p - q / c) / np.sqrt(c) * (both[:n] @ both[n:].T)
        else:
            lower = np.linalg.cholesky(eye + c * (x.T @ x))
            step = (p - q / c) * np.linalg.solve(lower.T, np.linalg.solve(lower, x.T)).T
        new = q / c * x + step
        new = (new + new.T) / 2
        moved = np.linalg.norm(new - x)
        x, low = new, min(low * (p + q * square) / (1 + c * square), 1.0)
        if moved <= np.cbrt(5 * EPS) and abs(1 - low) <= 10 * EPS:
            break
    return x


def rotated(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and vectors of a matrix of at most two rows."""
    if len(a) == 1:
        return a[0], np.eye(1)
    angle = 0.5 * np.arctan2(2 * a[0, 1], a[0, 0] - a[1, 1])
    v = np.array([[np.cos(angle), -np.sin(angle)], [np.sin(angle), np.cos(angle)]])
    return np.diag(v.T @ a @ v), v


def split(a: np.ndarray, size: float) -> tuple[np.ndarray, int] | None:
    """An orthogonal matrix whose first k columns span one invariant subspace and the others the rest; None if no shift tells eigenvalues apart."""
    n = len(a)
    diagonal = np.sort(np.diag(a))
    middle, width = float(np.median(diagonal)), float(np.linalg.norm(a - np.eye(n) * np.trace(a) / n)) / np.sqrt(n)
    random = np.random.default_rng(n)
    for shift in [middle, float(diagonal.mean()), *(middle + width * t for t in (0.03, -0.03, 0.1, -0.1, 0.3, -0.3))]:
        u = polar_factor(a - shift * np.eye(n))
        k = round(float(np.trace(u) + n) / 2)
        if not 0 < k < n or np.abs(u @ u - np.eye(n)).max() > 1e-9:
            continue
        onto = (u + np.eye(n)) / 2
        first, _ = np.linalg.qr(onto @ random.normal(size=(n, k)))
        second, _ = np.linalg.qr((np.eye(n) - onto) @ random.normal(size=(n, n - k)))
        # Once more on its own image: the random start then leaves no error of its own.
        basis, _ = np.linalg.qr(np.hstack([onto @ first, second - onto @ second]))
        if np.abs(basis[:, :k].T @ a @ basis[:, k:]).max() <= 1e-12 * size:
            return basis, k
    return None


def components(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors in columns; the largest entry of each is positive."""
    size = float(np.abs(a).max(initial=0.0))

    def solve(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(m) <= 2:
            return rotated(m)
        off = m - np.diag(np.diag(m))
        if np.abs(off).max() <= EPS * size:
            return np.diag(m), np.eye(len(m))
        found = split(m, size)
        if found is None:
            # Eigenvalues as close as rounding lets them be: rotations of pairs end what is left.
            return swept(m)
        basis, k = found
        parts = [solve((p + p.T) / 2) for p in (basis[:, :k].T @ m @ basis[:, :k], basis[:, k:].T @ m @ basis[:, k:])]
        return np.concatenate([p[0] for p in parts]), np.hstack([basis[:, :k] @ parts[0][1], basis[:, k:] @ parts[1][1]])

    _, vectors = solve(a)
    # The product of many bases is orthogonal up to some roundings; one Newton step and the values anew.
    vectors = vectors @ (1.5 * np.eye(len(a)) - 0.5 * vectors.T @ vectors)
    values = np.einsum("ij,ij->j", vectors, a @ vectors)
    order = np.argsort(-values, kind="stable")
    values, vectors = values[order], vectors[:, order]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(a))])
    return values, vectors * np.where(signs == 0, 1, signs)


def swept(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cyclic rotations of pairs until nothing is left beside the diagonal."""
    m, n = m.copy(), len(m)
    vectors = np.eye(n)
    for _ in range(60):
        if np.abs(m - np.diag(np.diag(m))).max() <= EPS * np.abs(m).max():
            break
        for i in range(n - 1):
            for j in range(i + 1, n):
                _, r = rotated(m[np.ix_([i, j], [i, j])])
                m[:, [i, j]] = m[:, [i, j]] @ r
                m[[i, j]] = r.T @ m[[i, j]]
                vectors[:, [i, j]] = vectors[:, [i, j]] @ r
    return np.diag(m), vectors


def whole_numbers(vectors: pa.Array) -> np.ndarray:
    """x of every row; all rows have the same width."""
    c = np.asarray(vectors.flatten().to_numpy(zero_copy_only=False), dtype=float).reshape(len(vectors), -1)
    if np.abs(c).max(initial=0) >= LARGEST:
        raise ValueError("an entry of a vector is 2**43 or more")
    return np.floor(SCALE * c).astype(np.int64) + SHIFT


def exact_products(a: np.ndarray) -> np.ndarray:
    """Sums of products of columns: in doubles while these are whole numbers below 2**53, else in Python's integers."""
    largest = int(np.abs(a).max(initial=0))
    rows = 2**53 // (largest * largest) if largest else len(a)
    if rows < 1:
        wide = a.astype(object)
        return wide.T @ wide
    f = a.astype(float)
    total = np.zeros((a.shape[1],) * 2, dtype=object if len(a) > rows * 500 else np.int64)
    for at in range(0, len(a), max(rows, 1)):
        part = f[at : at + rows]
        total += (part.T @ part).astype(np.int64)
    return total


class Fit:
    """What the covariance gives: number of rows, sums, whole centre, and the components."""

    def __init__(self, n: int, sums: list[int], centre: list[int], covariance: np.ndarray):
        self.n, self.centre = n, np.array(centre, dtype=np.int64)
        #: n * x - sums is n * (x - centre) - rest.
        self.rest = [s - n * c for s, c in zip(sums, centre)]
        values, vectors = components(covariance)
        self.values, self.vectors = values[:COMPONENTS], vectors[:, :COMPONENTS]
        trace = float(np.trace(covariance))
        self.explained = [float(v / trace) if trace > 0 else None for v in self.values]
        self.kept = self.values > len(sums) * EPS * max(float(values.max(initial=0.0)), 0.0)
        self.matrix = self.vectors[:, self.kept] / np.sqrt(self.values[self.kept])

    def whiten(self, x: np.ndarray) -> np.ndarray:
        """Of every row the components that have variance."""
        return (x - self.centre - np.array([float(Fraction(r, self.n)) for r in self.rest])) @ self.matrix

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """The exact sum of (n * x - sums) ** 2 of every row, None beyond 64 bits."""
        a = x - self.centre
        largest = self.n * int(np.abs(a).max(initial=0)) + max(map(abs, self.rest), default=0)
        if largest * largest * max(a.shape[1], 1) < 2**63:
            t = self.n * a - np.array(self.rest, dtype=np.int64)
            return (t * t).sum(axis=1).tolist()
        rows = ((self.n * a.astype(object) - np.array(self.rest, dtype=object)) ** 2).sum(axis=1)
        return [v if v < 2**63 else None for v in rows]


def totals(vectors: DataFrame, centre: np.ndarray | None) -> dict[int, int]:
    """By place: sums of x, or with a centre the sums of products of x - centre. Tasks add up their own rows first."""
    width = None if centre is None else len(centre)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = whole_numbers(batch.column(0))
            part = (x.sum(axis=0) if width is None else exact_products(x - centre)).astype(object)
            total = part if total is None else total + part
        if total is not None:
            # Decimals reach Spark as text: a task's sum may have more than 64 bits.
            yield pa.RecordBatch.from_pydict({"place": pa.array(range(total.size), pa.int32()), "total": pa.array([str(t) for t in total.ravel()])})

    parts = vectors.mapInArrow(added, "place int, total string")
    return {r["place"]: int(r["total"]) for r in parts.groupBy("place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()}


def kept_vectors(df: DataFrame, vector_col: str) -> tuple[DataFrame, int]:
    """The rows that take part, and their width (0 for none)."""
    good = df.where(usable(F.col(vector_col)))
    widths = good.groupBy(F.size(vector_col).alias("width")).count().orderBy(F.desc("count"), "width").head(1)
    width = widths[0]["width"] if widths else 0
    return good.where(F.size(vector_col) == width), width


def learn(df: DataFrame, vector_col: str = "embedding") -> Fit | None:
    """The fit over all vectors that take part; None if there are none."""
    rows, width = kept_vectors(df, vector_col)
    if not width:
        return None
    vectors = rows.select(F.col(vector_col).cast("array<double>").alias("v"))
    n = vectors.count()
    found = totals(vectors, None)
    sums = [found[i] for i in range(width)]
    centre = [round(Fraction(s, n)) for s in sums]
    products = totals(vectors, np.array(centre, dtype=np.int64))
    rest = [s - n * c for s, c in zip(sums, centre)]
    # Exact integers over n * n, rounded once.
    covariance = np.array([[(n * products[i * width + j] - rest[i] * rest[j]) / (n * n) for j in range(width)] for i in range(width)])
    return Fit(n, sums, centre, covariance)


def whitened(df: DataFrame, fit: Fit | None, vector_col: str = "embedding") -> DataFrame:
    """The rows that take part with `deviation` and `whitened`, an array with a place for each component (null without variance)."""
    rows, _ = kept_vectors(df, vector_col)
    others = [c for c in df.columns if c not in ("deviation", "whitened")]
    kept = rows.select(*others, F.col(vector_col).cast("array<double>").alias("_v"))
    schema = T.StructType([*kept.drop("_v").schema.fields, T.StructField("deviation", T.LongType()), T.StructField("whitened", T.ArrayType(T.DoubleType()))])
    if fit is None:
        return df.sparkSession.createDataFrame([], schema)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = whole_numbers(batch.column(batch.num_columns - 1))
            made = np.full((len(x), len(fit.kept)), np.nan)
            made[:, fit.kept] = fit.whiten(x)
            flat = pa.array(made.ravel(), mask=np.tile(~fit.kept, len(x)))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(fit.kept)), flat)
            columns = [*batch.columns[:-1], pa.array(fit.deviations(x), pa.int64()), lists]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return kept.mapInArrow(project, schema)


def identity_error(rows: DataFrame, fit: Fit) -> float | None:
    """The largest entry of the covariance of `whitened` less the identity, over the components that have variance."""
    k = int(fit.kept.sum())
    kept = fit.kept

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, sums, n = np.zeros((k, k)), np.zeros(k), 0
        for batch in batches:
            flat = batch.column(0).flatten().to_numpy(zero_copy_only=False)
            w = np.asarray(flat, dtype=float).reshape(batch.num_rows, -1)[:, kept]
            total, sums, n = total + w.T @ w, sums + w.sum(axis=0), n + len(w)
        if n:
            values = np.concatenate([total.ravel(), sums])
            yield pa.RecordBatch.from_pydict({"place": pa.array(range(len(values)), pa.int32()), "total": pa.array(values)})

    if not k:
        return None
    found = {r["place"]: r["total"] for r in rows.select("whitened").mapInArrow(added, "place int, total double").groupBy("place").agg(F.sum("total").alias("total")).collect()}
    values = np.array([found[i] for i in range(k * k + k)])
    # Whitened values are centred already; what rounding leaves of their mean comes off too.
    mean = values[k * k :] / fit.n
    return float(np.abs(values[: k * k].reshape(k, k) / fit.n - np.outer(mean, mean) - np.eye(k)).max())


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    fit = learn(vectors)
    if fit is None:
        return spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    rows = written(whitened(vectors, fit).drop("embedding"), "whitened")
    error = identity_error(rows, fit)
    shares = F.array(*[F.lit(e).cast("double") for e in fit.explained])
    each = rows.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return each.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(fit.n).cast("long").alias("n"), "deviation", "whitened", shares[F.col("at")].alias("explained"), F.lit(error).cast("double").alias("identity_error"))
