"""Whitening of embeddings by an incremental eigendecomposition.

Entries become whole numbers, so that counts and sums are exact. Then, in three steps:

1. Every task keeps the spectrum of the vectors it has read: count, mean, eigenvalues and eigenvectors of
   their scatter. One more vector is a rank-one update of the centred scatter. Its eigenvalues are the
   roots of the secular equation, found for all intervals between the old ones at once; entries that
   are not moved (no component along them, or equal eigenvalues) are deflated first. Repeats of
   a vector in a block are one update with their number as weight.
2. Spectra are combined in a tree, ``FAN`` at a time in one task: each eigenpair of one is a rank-one
   update of the other, and the distance of the means is one more.
3. The eigenvectors are a basis in which the covariance is almost diagonal. A distributed Rayleigh-Ritz
   pass projects all centred vectors on it and sums their products; the small matrix's eigenvectors turn
   the basis. The centred entries are (n * x - S) / n with an exact numerator. A second pass removes what
   rounding left of the first.

What a task or the driver holds follows from the dimension (a square matrix), never from the rows.

Defined results: null vectors, empty ones and those with null, NaN or infinite entries are dropped, as are
those whose length is not the most frequent one (of equally frequent ones the longest): they have no
value in some dimension. So are vectors with an entry of 2 ** 56 or more in size, whose
whole number is no long. Null and repeated identifiers are rows like others. Components of no variance keep
their rows, with ``whitened`` null and ``explained`` 0, and take no part in the identity error. ``deviation``
is null beyond 64 bits; ``deviation_exact`` has it as text. An empty table gives no rows.
"""

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.llm.storage import stored
from wakeline.llm.words import in_batches

EPS = float(np.finfo(np.float64).eps)
SCALE = 64
FAN = 16
#: Entries whose 64-fold is no long.
LIMIT = float(1 << 56)
#: Eigenvalues below this share of the largest are rounding, not variance.
RANK = 1e-12
SPECTRUM = "node long, n long, mean array<double>, values array<double>, basis array<double>"


def secular_roots(poles: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of diag(poles) + w w' for ascending distinct poles and w * w = weights > 0.

    Returns each root's distance from the pole next to it and that pole's number: the root lies
    in (pole i, pole i + 1), the last one above the last pole by at most the sum of the weights. The
    iteration fits one rational function to the poles below a root and one to those above; a step that
    leaves the bracket is replaced by a bisection.
    """
    k, total = len(poles), float(weights.sum())
    gaps = np.append(np.diff(poles), total)
    right = np.append(poles[1:], poles[-1] + 2 * total)
    lower = np.arange(k)[:, None] <= np.arange(k)[None, :]
    middle = 0.5 * gaps
    value = 1 + (weights[:, None] / (poles[:, None] - poles[None, :] - middle[None, :])).sum(0)
    nearest = np.where((value < 0) & (np.arange(k) < k - 1), np.arange(k) + 1, np.arange(k))
    origin = poles[nearest]
    shifted = poles[:, None] - origin[None, :]
    after = np.append(shifted[np.arange(1, k), np.arange(k - 1)], right[-1] - origin[-1])
    before = np.diagonal(shifted).copy()
    low = np.where(nearest == np.arange(k), 0.0, -middle)
    high = np.where(nearest == np.arange(k), np.where(np.arange(k) < k - 1, middle, gaps), 0.0)
    high[-1] = total * (1 + 4 * EPS)
    root = 0.5 * (low + high)
    for _ in range(80):
        away = shifted - root
        parts = weights[:, None] / away
        slopes = parts / away
        below, slope_below = np.where(lower, parts, 0).sum(0), np.where(lower, slopes, 0).sum(0)
        every, slope = parts.sum(0), slopes.sum(0)
        value = 1 + every
        size = 1 + np.abs(below) + np.abs(every - below)
        high, low = np.where(value > 0, root, high), np.where(value > 0, low, root)
        done = (np.abs(value) <= 4 * EPS * size) | (high - low <= 2 * EPS * np.maximum(np.abs(high), np.abs(low)))
        if done.all():
            break
        left, beyond = before - root, after - root
        a = (left + beyond) * value - left * beyond * slope
        b = left * beyond * value
        c = value - left * slope_below - beyond * (slope - slope_below)
        under = np.sqrt(np.abs(a * a - 4 * b * c))
        with np.errstate(all="ignore"):
            move = np.where(a <= 0, (a - under) / (2 * c), 2 * b / (a + under))
            new = root + move
        good = (new > low) & (new < high)
        root = np.where(done, root, np.where(good, new, 0.5 * (low + high)))
    return root, nearest


def update(values: np.ndarray, basis: np.ndarray, vector: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, ascending, and eigenvectors of basis * diag(values) * basis' + vector * vector'."""
    z = basis.T @ vector
    norm = float(np.sqrt(z @ z))
    if norm == 0:
        return values, basis
    tolerance = 8 * EPS * max(float(np.abs(values).max()), norm * norm)
    moved = np.abs(z) * norm > tolerance
    at = np.flatnonzero(moved)
    gap, left, right = np.diff(values[at]), z[at[:-1]], z[at[1:]]
    if (np.abs(gap * left * right) <= tolerance * (left * left + right * right)).any():
        # Equal eigenvalues: turn two of their vectors so that one of them no longer moves.
        basis, values, last = basis.copy(), values.copy(), -1
        for i in at:
            if last >= 0:
                length = float(np.hypot(z[last], z[i]))
                c, s = z[i] / length, z[last] / length
                if abs((values[i] - values[last]) * c * s) <= tolerance:
                    z[i], z[last] = length, 0.0
                    moved[last] = False
                    one, two = basis[:, last].copy(), basis[:, i].copy()
                    basis[:, last], basis[:, i] = c * one - s * two, s * one + c * two
                    d = values[last] * c * c + values[i] * s * s
                    values[i], values[last] = values[last] * s * s + values[i] * c * c, d
            last = i
        at = np.flatnonzero(moved)
    poles = values[at]
    root, nearest = secular_roots(poles, z[at] ** 2)
    k = len(at)
    distance = poles[nearest][None, :] - poles[:, None] + root[None, :]  # new value j from pole i
    spread = poles[None, :] - poles[:, None]
    np.fill_diagonal(spread, 1.0)
    # The vector whose exact eigenvalues the roots are; with it the eigenvectors are orthogonal.
    ratio = distance / spread
    fitted = np.sqrt(np.abs(np.prod(ratio, axis=1)))
    turn = np.copysign(fitted, z[at])[:, None] / -distance
    turn /= np.sqrt((turn * turn).sum(0))
    new_values = values.copy()
    new_values[at] = poles[nearest] + root
    new_basis = basis.copy()
    new_basis[:, at] = basis[:, at] @ turn
    order = np.argsort(new_values, kind="stable")
    return (new_values, new_basis) if (np.diff(order) > 0).all() or k == 0 else (new_values[order], new_basis[:, order])


@dataclass
class Spectrum:
    """Count, mean and eigendecomposition of the scatter (centred sum of products) of some vectors."""

    n: int
    mean: np.ndarray
    values: np.ndarray
    basis: np.ndarray

    @classmethod
    def empty(cls, size: int) -> "Spectrum":
        return cls(0, np.zeros(size), np.zeros(size), np.eye(size))

    def add(self, vector: np.ndarray, times: int = 1) -> None:
        away = vector - self.mean
        if self.n:
            self.values, self.basis = update(self.values, self.basis, away * np.sqrt(self.n * times / (self.n + times)))
        self.n += times
        self.mean = self.mean + away * (times / self.n)

    def combine(self, other: "Spectrum") -> None:
        if not self.n:
            self.n, self.mean, self.values, self.basis = other.n, other.mean, other.values, other.basis
            return
        away = other.mean - self.mean
        floor = EPS * max(float(other.values[-1]), 0.0)
        for value, vector in zip(other.values, other.basis.T):
            if value > floor:
                self.values, self.basis = update(self.values, self.basis, vector * np.sqrt(value))
        self.values, self.basis = update(self.values, self.basis, away * np.sqrt(self.n * other.n / (self.n + other.n)))
        self.n += other.n
        self.mean = self.mean + away * (other.n / self.n)

    def row(self, node: int) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), *[pa.list_(pa.float64())] * 3]
        values = [node, self.n, self.mean, self.values, self.basis.ravel()]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], ["node", "n", "mean", "values", "basis"])

    @classmethod
    def of(cls, n, mean, values, basis) -> "Spectrum":
        size = len(mean)
        return cls(n, np.array(mean), np.array(values), np.array(basis).reshape(size, size))


def matrix(column: pa.Array) -> np.ndarray:
    """Equally long lists without nulls as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def whole_vectors(rows: DataFrame, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, x): the vectors without nulls and of the most frequent length, entries as floor(64 * c)."""
    e = F.transform(F.col(vector), lambda c: c.cast("double"))
    sound = F.forall(e, lambda c: F.coalesce(F.abs(c) < LIMIT, F.lit(False)) & ~F.isnan(c))
    fit = rows.select(F.col(id_column).alias("id"), e.alias("e")).where((F.size("e") > 0) & sound)
    lengths = fit.groupBy(F.size("e").alias("length")).count().orderBy(F.desc("count"), F.desc("length")).first()
    size = lengths["length"] if lengths else 0
    return fit.where(F.size("e") == size).select("id", F.transform("e", lambda c: F.floor(c * SCALE).cast("long")).alias("x"))


def spectra(vectors: DataFrame, size: int) -> DataFrame:
    """One spectrum for each partition of the vectors, stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Spectrum.empty(size)
        for batch in batches:
            if batch.num_rows:
                distinct, times = np.unique(matrix(batch.column(0)), axis=0, return_counts=True)
                for x, n in zip(distinct.astype(np.float64), times.tolist()):
                    own.add(x, n)
        if own.n:
            yield own.row(TaskContext.get().partitionId())

    return stored(in_batches(vectors.select("x"), run, SPECTRUM), "spectra")


def combined(parts: DataFrame) -> Spectrum | None:
    """All spectra in one, through a tree whose groups have ``FAN`` members at most."""

    def merge(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for batch in batches:
            for row in batch.to_pylist():
                other = Spectrum.of(row["n"], row["mean"], row["values"], row["basis"])
                if own is None:
                    own = Spectrum.empty(len(other.mean))
                own.combine(other)
        yield own.row(key[0].as_py())

    last = parts.agg(F.max("node")).first()[0]
    if last is None:
        return None
    while last > 0:
        groups = parts.withColumn("node", F.floor(F.col("node") / FAN).cast("long")).groupBy("node")
        parts, last = stored(groups.applyInArrow(merge, SPECTRUM), "spectra"), last // FAN
    row = parts.first()
    return Spectrum.of(row.n, row["mean"], row["values"], row.basis)


@dataclass
class Whitening:
    """A fitted transform; ``axes`` has a column per component, by falling variance."""

    n: int
    sums: list[int]
    axes: np.ndarray
    variances: np.ndarray
    total: float

    @property
    def explained(self) -> np.ndarray:
        return self.variances / self.total if self.total > 0 else np.zeros(len(self.variances))

    @property
    def live(self) -> np.ndarray:
        return self.variances > RANK * max(self.total, 0.0)


def numerators(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S as whole numbers, in 64 bits where they fit and as Python's otherwise."""
    largest = max(int(np.abs(x).max(initial=0)), 1)
    if largest * n < 1 << 61 and max(map(abs, sums), default=0) < 1 << 61:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    return (numerators(x, n, sums) / n).astype(np.float64)


def exact_sums(vectors: DataFrame, size: int) -> tuple[int, list[int]]:
    """Count and exact sum of every dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, [0] * size
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(0))
                if int(np.abs(x).max()) * len(x) >= 1 << 63:
                    x = x.astype(object)
                n, sums = n + len(x), [a + int(b) for a, b in zip(sums, x.sum(0))]
        values = pa.array([Decimal(v) for v in [*sums, n]], pa.decimal128(38, 0))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size + 1)), values], ["place", "value"])

    parts = in_batches(vectors.select("x"), run, "place long, value decimal(38,0)")
    found = {row.place: int(row.value) for row in parts.groupBy("place").agg(F.sum("value").alias("value")).collect()}  # one row a dimension
    return found[size], [found[i] for i in range(size)]


def products(vectors: DataFrame, n: int, sums: list[int], axes: np.ndarray) -> np.ndarray:
    """Sum of p p' over all vectors, p the centred vector's coordinates along the axes.

    A task returns one matrix; they are added position by position, so that the shuffle brings a few
    numbers a position together.
    """
    k = axes.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for batch in batches:
            if batch.num_rows:
                p = centred(matrix(batch.column(0)), n, sums) @ axes
                total += p.T @ p
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * k)), pa.array(total.ravel())], ["place", "value"])

    parts = in_batches(vectors.select("x"), run, "place long, value double")
    added = parts.groupBy("place").agg(F.sum("value").alias("value")).collect()  # dimension squared
    out = np.zeros(k * k)
    for row in added:
        out[row.place] = row.value
    out = out.reshape(k, k)
    return (out + out.T) / 2


def fit(vectors: DataFrame, components: int = 32) -> Whitening | None:
    """The transform learnt from all vectors; None without any."""
    first = vectors.select(F.size("x").alias("size")).first()
    if first is None:
        return None
    size = first["size"]
    n, sums = exact_sums(vectors, size)
    spectrum = combined(spectra(vectors, size))
    axes = spectrum.basis[:, ::-1]
    for _ in range(2):
        # Orthogonal to the last bit before each pass; the passes then turn it by small angles.
        axes, r = np.linalg.qr(axes)
        axes = axes * np.sign(np.where(np.diagonal(r) == 0, 1, np.diagonal(r)))
        variances, turn = np.linalg.eigh(products(vectors, n, sums, axes) / n)
        axes, variances = (axes @ turn)[:, ::-1], variances[::-1]
    total = float(variances.clip(min=0).sum())
    return Whitening(n, sums, np.ascontiguousarray(axes[:, :components]), variances[:components].clip(min=0), total)


def identity_error(vectors: DataFrame, model: Whitening) -> float | None:
    """Largest entry of the whitened vectors' covariance minus the identity, over components with variance."""
    live = model.live
    if not live.any():
        return None
    scaled = model.axes[:, live] / np.sqrt(model.variances[live])
    return float(np.abs(products(vectors, model.n, model.sums, scaled) / model.n - np.eye(int(live.sum()))).max())


def transform(vectors: DataFrame, model: Whitening) -> DataFrame:
    """(id, deviation, deviation_exact, whitened): one row per vector, null entries for components of no variance."""
    live = model.live
    scaled = model.axes / np.sqrt(np.where(live, model.variances, 1.0))
    dead = np.flatnonzero(~live)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            away = numerators(matrix(batch.column(1)), model.n, model.sums)
            white = (away / model.n).astype(np.float64) @ scaled
            white[:, dead] = np.nan
            largest = int(np.abs(away).max())
            wide = away if largest * largest * away.shape[1] < 1 << 63 else away.astype(object)
            exact = [int(d) for d in (wide * wide).sum(1)]
            flat = pa.array(white.ravel(), from_pandas=True)  # NaN marks what has no value
            offsets = pa.array(np.arange(0, white.size + 1, white.shape[1], dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([d if d < 1 << 63 else None for d in exact], pa.int64()), pa.array(map(str, exact), pa.string()),
                 pa.ListArray.from_arrays(offsets, flat)],
                ["id", "deviation", "deviation_exact", "whitened"])

    kind = vectors.schema["id"].dataType.simpleString()
    return in_batches(vectors.select("id", "x"), run, f"id {kind}, deviation long, deviation_exact string, whitened array<double>")


def whiten(rows: DataFrame, id_column: str = "vec_id", vector: str = "embedding", components: int = 32) -> DataFrame:
    """One row per vector and component, numbered from 1.

    Columns: the identifier, component, n, deviation, whitened, explained, identity_error, deviation_exact.
    """
    vectors = stored(whole_vectors(rows, id_column, vector), "vectors")
    model = fit(vectors, components)
    if model is None:
        return vectors.where("false").select(F.col("id").alias(id_column), *(F.lit(None).cast(t).alias(c) for c, t in (
            ("component", "int"), ("n", "long"), ("deviation", "long"), ("whitened", "double"), ("explained", "double"),
            ("identity_error", "double"), ("deviation_exact", "string"))))
    error = identity_error(vectors, model)
    found = transform(vectors, model).select("id", "deviation", "deviation_exact", F.posexplode("whitened").alias("at", "whitened"))
    explained = F.array(*(F.lit(float(v)) for v in model.explained))
    return found.select(
        F.col("id").alias(id_column), (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(explained, F.col("at")).alias("explained"), F.lit(error).cast("double").alias("identity_error"), "deviation_exact",
    )
