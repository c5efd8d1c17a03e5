"""Embedding whitening: float32 eigenvectors of the distributed covariance, refined in higher precision."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoalkit.llm.common import dropped, stored

COMPONENTS = 16
SCALE, SHIFT = 64, 1_000_000
# Rows of centred vectors multiplied at once.
BLOCK_ROWS = 4096
# An eigenvalue below this share of the largest counts as zero.
LEAST_SHARE = 1e-13
# Eigenvalues closer than this share of the norm are solved together.
CLOSE = 1e-9
WIDE = np.longdouble


def integer_vectors(embeddings: DataFrame, column="embedding") -> DataFrame:
    """All columns and ``x``, the entries as ``floor(64 * entry) + 1000000``; unusable rows are left out.

    Left out are null vectors and those with null or non-finite entries, or with an entry
    of 2 ** 46 or more, whose integer is no longer exact.
    """
    entry = lambda c: c.cast("double")
    usable = F.col(column).isNotNull() & F.forall(
        column, lambda c: F.coalesce(~F.isnan(c) & (F.abs(entry(c)) < 2.0 ** 46), F.lit(False)))
    return embeddings.filter(usable).withColumn(
        "x", F.transform(column, lambda c: F.floor(F.lit(float(SCALE)) * entry(c)).cast("long") + SHIFT))


def _matrix(batch, name):
    """The lists of a batch, which have one length, as rows of a matrix."""
    column = batch.column(name)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _few(df: DataFrame) -> DataFrame:
    """``df`` in at most as many tasks as run at once, so that there are few partial sums."""
    return df.coalesce(max(1, df.sparkSession.sparkContext.defaultParallelism))


def _totals(fit: DataFrame):
    """Number of vectors and the exact sum of each dimension."""

    def add(batches):
        n, total = 0, None
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch, 0)
                n += len(x)
                # Python's integers do not overflow.
                here = [int(v) for v in (x >> 32).sum(axis=0)], [int(v) for v in (x & 0xFFFFFFFF).sum(axis=0)]
                here = [(high << 32) + low for high, low in zip(*here)]
                total = here if total is None else [a + b for a, b in zip(total, here)]
        if total is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(-1, len(total)), pa.int32()), pa.array([str(v) for v in [n, *total]])], names=["at", "total"])

    sums = _few(fit).mapInArrow(add, "at int, total string").groupBy("at").agg(
        F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).orderBy("at").collect()
    return (int(sums[0].total), [int(r.total) for r in sums[1:]]) if sums else (0, [])


class Centre:
    """Centred vectors: ``n * x - sum`` exactly, and divided by ``n``."""

    def __init__(self, n, sums):
        self.n, self.sums = n, sums
        # The whole part of the mean is taken off first, so the products stay small.
        self.whole = np.array([s // n for s in sums], np.int64)
        self.rest = np.array([s % n for s in sums], np.int64)

    def fits(self, x):
        """Whether ``n * x - sum`` and the sum of its squares fit 64 bits."""
        largest = int(np.abs(x - self.whole).max(initial=0)) * self.n + self.n
        return largest * largest * max(x.shape[1], 1) < 1 << 63

    def exact(self, x):
        return (x - self.whole) * self.n - self.rest

    def __call__(self, x):
        """``x - sum / n`` in double precision, rounded once."""
        if self.fits(x):
            return self.exact(x) / self.n
        return ((x - self.whole).astype(WIDE) - self.rest.astype(WIDE) / self.n).astype(float)

    def deviation(self, x):
        """Sum of the squares of ``n * x - sum``, exact; None where it exceeds 64 bits."""
        if self.fits(x):
            return np.square(self.exact(x)).sum(axis=1).tolist()
        rows = (sum((int(v) * self.n - s) ** 2 for v, s in zip(row, self.sums)) for row in x)
        return [v if v < 1 << 63 else None for v in rows]


def _second_moments(fit: DataFrame, vectors, size):
    """Sums of products of the entries of ``vectors(x)`` over all rows, as a symmetric matrix, and sums of the entries.

    Each task adds up blocks of rows with a compensation for rounding; the partial sums
    of a cell are added by Spark, and only the finished matrix comes to the driver.
    """
    low, high = np.triu_indices(size)

    def add(batches):
        total, lost = np.zeros((size + 1, size)), np.zeros((size + 1, size))
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK_ROWS):
                c = vectors(_matrix(batch.slice(start, BLOCK_ROWS), 0))
                term = np.vstack([c.T @ c, c.sum(axis=0)]) - lost
                new = total + term
                lost, total = (new - total) - term, new
        cells = np.r_[total[:size][low, high], total[size]]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(cells), dtype=np.int32)), pa.array(cells)], names=["cell", "total"])

    found = _few(fit).mapInArrow(add, "cell int, total double").groupBy("cell").agg(
        F.sum("total").alias("total")).orderBy("cell").toArrow()["total"].to_numpy()
    matrix = np.zeros((size, size))
    matrix[low, high] = found[:len(low)]
    matrix[high, low] = found[:len(low)]
    return matrix, found[len(low):]


def _clusters(values, gap):
    """Index ranges of eigenvalues (falling) whose neighbours are closer than ``gap``; single ones are left out."""
    cut = np.flatnonzero(np.r_[True, values[:-1] - values[1:] > gap, True])
    return [(a, b) for a, b in zip(cut[:-1], cut[1:]) if b - a > 1]


def refine(matrix, vectors, rounds=8):
    """Eigenvalues (falling) and eigenvectors of a symmetric ``matrix``, from approximate ``vectors``.

    Every round corrects the vectors by two products: ``R = I - X'X`` for their lengths
    and angles, ``S = X'AX`` for their directions. The correction of a pair is
    ``(s + l r) / (l' - l)``; of a pair whose eigenvalues are too close to tell apart by
    the residuals only the orthogonality is corrected, ``r / 2``. Such a cluster is then
    solved by itself: its own block of ``X'AX``, less its mean eigenvalue, is small, so an
    ordinary solver separates what the whole matrix hides. The error is squared each
    round; all products are made in extended precision.
    """
    a, x = matrix.astype(WIDE), vectors.astype(WIDE)
    n, one = len(a), np.eye(len(a), dtype=WIDE)
    norm = float(np.abs(a).sum(axis=1).max(initial=0.0))
    if norm == 0.0:
        return np.zeros(n), np.eye(n)
    for _ in range(rounds):
        r = one - x.T @ x
        s = x.T @ (a @ x)
        # Both are symmetric but for rounding, which a small distance would magnify.
        r, s = (r + r.T) / 2, (s + s.T) / 2
        values = np.diag(s) / (1 - np.diag(r))
        off = s - np.diag(values)
        gap = max(2 * float(np.sqrt((off * off).sum()) + norm * np.sqrt((r * r).sum())), CLOSE * norm)
        distance = values[None, :] - values[:, None]
        apart = np.abs(distance) > gap
        e = np.where(apart, (s + values[None, :] * r) / np.where(apart, distance, 1), r / 2)
        x = x + x @ e
        order = np.argsort(-values, kind="stable")
        x, values = x[:, order], values[order]
        for low, high in _clusters(values, gap):
            part = x[:, low:high]
            block = part.T @ (a @ part) - values[low:high].mean() * (part.T @ part)
            scale = np.abs(block).max()
            if scale > 0:
                _, turn = np.linalg.eigh(((block + block.T) / (2 * scale)).astype(float))
                x[:, low:high] = part @ turn[:, ::-1].astype(WIDE)
        # The next correction would be its square.
        if float(np.abs(e).max()) < 1e-10:
            break
    x = x + x @ (one - x.T @ x) / 2
    x = x / np.sqrt((x * x).sum(axis=0))
    values = (x * (a @ x)).sum(axis=0)
    order = np.argsort(-values, kind="stable")
    x, values = x[:, order], values[order]
    # The entry of largest size is positive, so that the sign does not depend on the run.
    sign = np.sign(x[np.abs(x).argmax(axis=0), np.arange(n)])
    return values.astype(float), (x * np.where(sign == 0, 1, sign)).astype(float)


def principal_axes(covariance):
    """All eigenvalues, falling, and unit eigenvectors of ``covariance`` to double precision."""
    if not len(covariance):
        return np.zeros(0), np.zeros((0, 0))
    scale = np.abs(covariance).max() or 1.0
    _, start = np.linalg.eigh((covariance / scale).astype(np.float32))
    return refine(covariance, start[:, ::-1])


def whiten(embeddings: DataFrame, components=COMPONENTS, column="embedding") -> DataFrame:
    """``vec_id, n, deviation, whitened, explained, identity_error`` of every usable row.

    ``whitened`` lists the centred vector's coordinates on the first ``components``
    eigenvectors of the covariance, each over the root of its eigenvalue; ``explained``
    their shares of all variance. The covariance is that of the distinct integer vectors
    (``integer_vectors``), so copies, a hot vector included, count once: they meet in a
    map-side aggregation. ``deviation`` is ``sum((n * x - sum) ** 2)``, null where it
    exceeds 64 bits. ``identity_error`` is the largest entry by which the covariance of the
    whitened distinct vectors differs from the identity, measured on the data.

    What comes to the driver is one number for each pair of dimensions, whatever the
    number of rows.

    Vectors of another length than the commonest (of equally common lengths the longest)
    are left out, as are those that ``integer_vectors`` leaves out. Components without
    variance have no whitened value and are left out; without any, ``whitened`` is
    empty. Null ids and repeated rows are returned each. An empty table gives no rows.
    Extra columns are not read.
    """
    rows = integer_vectors(embeddings.select("vec_id", F.col(f"`{column}`").alias("embedding"))).select("vec_id", "x")
    sizes = rows.groupBy(F.size("x").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("size")).first()
    size = sizes["size"] if sizes else 0
    kept = rows.filter(F.size("x") == size)
    fit = stored(kept.select("x").distinct(), "vectors")
    n, sums = _totals(fit)
    out = "vec_id long, n long, deviation long, whitened array<double>, explained array<double>, identity_error double"
    if not n or not size:
        dropped(fit)
        return kept.select(
            F.col("vec_id").cast("long"), F.lit(n).cast("long").alias("n"), F.lit(0).cast("long").alias("deviation"),
            F.array().cast("array<double>").alias("whitened"), F.array().cast("array<double>").alias("explained"),
            F.lit(0.0).alias("identity_error"))
    centre = Centre(n, sums)
    covariance = _second_moments(fit, centre, size)[0] / n
    values, vectors = principal_axes(covariance)
    used = min(components, int((values > LEAST_SHARE * max(values[0], 0.0)).sum()))
    explained = (values[:used] / np.trace(covariance)).tolist() if used else []
    turn = vectors[:, :used] / np.sqrt(values[:used])
    error = 0.0
    if used:
        moments, totals = _second_moments(fit, lambda x: centre(x) @ turn, used)
        mean = totals / n
        error = float(np.abs(moments / n - np.outer(mean, mean) - np.eye(used)).max())
    dropped(fit)

    def project(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch, 1)
            m = len(x)
            flat = (centre(x) @ turn).ravel()
            ends = pa.array(np.arange(0, (m + 1) * used, used, dtype=np.int32) if used else np.zeros(m + 1, np.int32))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(np.full(m, n)), pa.array(centre.deviation(x), pa.int64()),
                pa.ListArray.from_arrays(ends, pa.array(flat)), pa.ListArray.from_arrays(ends, pa.array(np.tile(explained, m))),
                pa.array(np.full(m, error))], names=["vec_id", "n", "deviation", "whitened", "explained", "identity_error"])

    return kept.select(F.col("vec_id").cast("long"), "x").mapInArrow(project, out)


def by_component(found: DataFrame) -> DataFrame:
    """One row for each vector and component, components numbered from 1."""
    pair = F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "pair")
    return found.select("vec_id", "n", "deviation", "identity_error", pair).select(
        "vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", "pair.whitened", "pair.explained", "identity_error")
