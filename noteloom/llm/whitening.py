"""Whitened profiles of pieces: principal components by Golub-Kahan-Lanczos bidiagonalisation."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from noteloom.llm.columns import forget, plain, stored
from noteloom.llm.shipping import map_arrow

SCALE, SHIFT = 64, 1_000_000
#: Rows that a task multiplies at once.
BLOCK = 1 << 12


def levels(profile: str = "profile") -> Column:
    """Whole-number entries of a profile: ``floor(64 * entry) + 1000000``."""
    return F.transform(profile, lambda entry: F.floor(entry.cast("double") * SCALE).cast("long") + F.lit(SHIFT))


def _usable(profile: str) -> Column:
    """Profiles of at least one entry, all of them finite and below 2^40 in size."""
    large = F.lit(float(1 << 40))
    bad = F.exists(profile, lambda entry: entry.isNull() | F.isnan(entry.cast("double")) | (F.abs(entry.cast("double")) >= large))
    return F.col(profile).isNotNull() & (F.size(profile) > 0) & ~bad


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


@dataclass(frozen=True)
class Centre:
    """Number of the different profiles and the sum of each of their entries."""

    n: int
    sums: tuple[int, ...]

    def offsets(self, levels: np.ndarray) -> np.ndarray:
        """``n * level - sum`` of each entry, exactly: 64-bit numbers, or any numbers where these do not reach."""
        largest = max(int(np.abs(levels).max(initial=0)) * self.n, max(map(abs, self.sums)))
        if largest < 1 << 62:
            return levels * self.n - np.array(self.sums, np.int64)
        return levels.astype(object) * self.n - np.array(self.sums, object)

    def centred(self, levels: np.ndarray) -> np.ndarray:
        return self.offsets(levels).astype(np.float64) / self.n

    def deviations(self, levels: np.ndarray) -> list[int | None]:
        """Sum of the squared offsets of each row, exactly; null where it is no 64-bit number."""
        offsets = self.offsets(levels)
        if offsets.dtype == object or float(np.abs(offsets).max(initial=0)) ** 2 * levels.shape[1] >= 2.0**62:
            sums = (offsets.astype(object) ** 2).sum(axis=1)
            return [value if value < 1 << 63 else None for value in sums]
        return (offsets**2).sum(axis=1).tolist()


def _summed(rows: DataFrame, width: int, size: int, of: Callable[[np.ndarray], np.ndarray], kind: str) -> np.ndarray:
    """Sums over all rows of the ``size`` numbers that ``of`` gives for a block of levels; a task sends its own sums once."""
    arrow = pa.int64() if kind == "long" else pa.float64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, arrow.to_pandas_dtype())
        for batch in batches:
            levels = _matrix(batch.column(0), width)
            for start in range(0, len(levels), BLOCK):
                total += of(levels[start : start + BLOCK]).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total, arrow)], ["place", "value"])

    wide = F.col("value").cast("decimal(38,0)") if kind == "long" else F.col("value")
    parts = map_arrow(rows.select("levels"), run, f"place int, value {kind}")
    found = parts.groupBy("place").agg(F.sum(wide).alias("value")).toArrow()
    total = np.zeros(size, object if kind == "long" else np.float64)
    total[found["place"].to_numpy()] = [int(v) if kind == "long" else v for v in found["value"].to_pylist()]
    return total


def bidiagonal(product: Callable[[np.ndarray], np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Singular values and right singular vectors (columns) of a matrix X, by Golub-Kahan-Lanczos steps.

    ``product`` gives ``X.T @ (X @ z)``, the only thing that reads X. A step extends orthonormal right vectors v and left
    vectors u by ``X v = beta u_before + alpha u`` and ``X.T u = alpha v + beta v_next``. A left vector is as long as X,
    so it is held as the w with ``u = X w``, along with ``X.T u``: its products with other left vectors are
    then products of short vectors. Both families are orthogonalised twice against all before. A step that ends in an invariant
    space goes on from a new direction, so repeated values are all found.
    """
    random = np.random.default_rng(20)
    rights, lefts, images = (np.zeros((width, width)) for _ in range(3))
    alphas, betas = np.zeros(width), np.zeros(width)
    scale = 0.0
    for step in range(width):
        if step and betas[step - 1]:
            right = following
        else:
            right = random.standard_normal(width)
            for _ in range(3):
                right -= rights[:, :step] @ (rights[:, :step].T @ right)
                right /= np.linalg.norm(right)
        rights[:, step] = right
        left = right - (betas[step - 1] * lefts[:, step - 1] if step else 0.0)
        image = product(left)
        for _ in range(2):
            along = lefts[:, :step].T @ image
            left, image = left - lefts[:, :step] @ along, image - images[:, :step] @ along
        alpha = math.sqrt(max(float(left @ image), 0.0))
        scale = max(scale, alpha)
        if alpha <= scale * width * 1e-14:
            continue
        alphas[step], lefts[:, step], images[:, step] = alpha, left / alpha, image / alpha
        following = images[:, step] - alpha * right
        for _ in range(2):
            following -= rights[:, : step + 1] @ (rights[:, : step + 1].T @ following)
        beta = float(np.linalg.norm(following))
        if beta > scale * width * 1e-14 and step + 1 < width:
            betas[step], following = beta, following / beta
    small = np.diag(alphas) + np.diag(betas[:-1], 1)
    _, values, turned = np.linalg.svd(small)
    return values, rights @ turned.T


@dataclass(frozen=True)
class Whitening:
    """Principal axes (columns) of different profiles by falling variance, and how well they whiten them."""

    centre: Centre
    variances: np.ndarray
    axes: np.ndarray
    explained: np.ndarray
    identity_error: float


def fit(rows: DataFrame, width: int, components: int) -> Whitening | None:
    """Axes of the different ``levels`` (arrays of ``width`` whole numbers) of ``rows``; None without rows.

    The different rows are stored once, and every product reads them once: a task multiplies its blocks of rows by the vector
    and back, and sends ``width`` sums. Only such sums and vectors of ``width`` numbers reach the driver.
    """
    different = stored(rows.select("levels").distinct(), "levels")
    n = different.count()
    if not n:
        return None
    centre = Centre(n, tuple(_summed(different, width, width, lambda x: x.sum(axis=0), "long").tolist()))

    def product(z: np.ndarray) -> np.ndarray:
        def of(levels: np.ndarray) -> np.ndarray:
            block = centre.centred(levels)
            return block.T @ (block @ z)

        return _summed(different, width, width, of, "double")

    total = _summed(different, width, 1, lambda x: (centre.centred(x) ** 2).sum(keepdims=True), "double")[0] / n
    values, axes = bidiagonal(product, width)
    variances = values**2 / n
    kept = min(components, int((variances > variances[0] * 1e-12).sum()))
    variances, axes = variances[:kept], axes[:, :kept]
    scaled = axes / np.sqrt(variances)

    def covariance(levels: np.ndarray) -> np.ndarray:
        block = centre.centred(levels) @ scaled
        return block.T @ block

    found = _summed(different, width, kept * kept, covariance, "double").reshape(kept, kept) / n if kept else np.zeros((0, 0))
    error = float(np.abs(found - np.eye(kept)).max(initial=0.0))
    forget(different)
    return Whitening(centre, variances, axes, variances / total if total else variances, error)


def whiten(profiles: DataFrame, components: int = 16) -> DataFrame:
    """Profiles on the principal axes of all different profiles, each axis with variance one.

    ``profiles`` has ``piece_id`` and ``profile``, an array of numbers such as pitch-class weights. An entry c counts as
    the whole number ``floor(64 * c) + 1000000``. Means and variances are those of the different profiles of such
    numbers, so copies weigh once. Returns for each row and each of the first ``components`` axes, by falling variance,
    ``piece_id``, ``component`` (from 1), ``n`` (different profiles), ``deviation`` (sum of the squared ``n * number - sum`` over the
    entries, null beyond 64 bits), ``whitened``, ``explained`` (share of the whole variance) and ``identity_error`` (largest entry
    by which the covariance of the whitened profiles differs from the identity).

    Profiles that are null, empty, of another length than most (ties: than the shortest) or hold null or non-finite entries, or such
    of 2^40 and more, take no part; rows that repeat and rows without an id stay. Axes without variance are left out, so an
    empty table and one of a single different profile give no rows. An axis may point either way, the same for all rows.
    """
    if components < 1:
        raise ValueError(f"components must be positive, not {components}")
    spark = profiles.sparkSession
    rows = plain(profiles, "piece_id", "profile").filter(_usable("profile")).select("piece_id", levels().alias("levels"))
    rows = stored(rows, "profile-levels")
    schema = StructType([rows.schema["piece_id"]]).add("component", "integer").add("n", "long").add("deviation", "long")
    schema = schema.add("whitened", "double").add("explained", "double").add("identity_error", "double")
    usual = rows.groupBy(F.size("levels").alias("width")).count().orderBy(F.desc("count"), "width").head()
    if usual is None:
        return spark.createDataFrame([], schema)
    width = usual["width"]
    rows = rows.filter(F.size("levels") == width)
    model = fit(rows, width, components)
    count = len(model.variances)
    scaled = model.axes / np.sqrt(model.variances)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows if count else 0, BLOCK):
                part = batch.slice(start, BLOCK)
                x = _matrix(part.column(1), width)
                again = pa.array(np.repeat(np.arange(len(x)), count))
                columns = [
                    part.column(0).take(again),
                    pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(len(again), model.centre.n)),
                    pa.array(model.centre.deviations(x), pa.int64()).take(again),
                    pa.array((model.centre.centred(x) @ scaled).ravel()),
                    pa.array(np.tile(model.explained, len(x))),
                    pa.array(np.full(len(again), model.identity_error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    return map_arrow(rows, run, schema)
