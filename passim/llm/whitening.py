"""Embedding whitening from an exact, bit-sliced scatter matrix.

A component ``c`` becomes the whole number ``floor(scale * c) + shift``. Less the
least value of its dimension, it has few bits. Each bit plane of a dimension is
packed across rows into words of 64; the population count of two planes' AND is
the number of rows with both bits, so counts weighted by powers of two add up to
exact cross-products. They are centred as whole numbers, and only then rounded.
"""

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE = 64
SHIFT = 1_000_000
COMPONENTS = 32
# Rows whose planes a task packs at once, and rows that it whitens at once.
SLICE_ROWS = 8192
OUT_ROWS = 2048
# A whole number is kept within so many, far beyond any float's use here.
LARGEST = 2.0**61
EXACT = "decimal(38,0)"


@dataclass
class Whitening:
    """What ``fit`` found: plain numbers, a few for each pair of dimensions."""

    n: int
    least: list[int]
    sums: list[int]
    eigenvalues: np.ndarray
    explained: np.ndarray
    projection: np.ndarray
    identity_error: float | None = None

    @property
    def width(self) -> int:
        return len(self.least)


def _numbers(batch: pa.RecordBatch, scale: int, width: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and whole numbers of the rows that take part, by width of their vectors."""
    lists = batch.column("embedding")
    present = np.asarray(lists.is_valid())
    offsets = np.asarray(lists.offsets)
    flat = np.asarray(lists.values.cast(pa.float64()).fill_null(float("nan")))
    sizes = np.where(present, np.diff(offsets), 0)
    for size in np.unique(sizes[sizes > 0]) if width is None else [width]:
        rows = np.flatnonzero(sizes == size)
        values = flat[offsets[rows][:, None] + np.arange(size)]
        good = np.isfinite(values).all(axis=1)
        with np.errstate(over="ignore"):
            x = np.clip(np.floor(scale * values[good]), -LARGEST, LARGEST).astype(np.int64)
        yield rows[good], x


def _decimals(values: list[int]) -> pa.Array:
    return pa.array([Decimal(v) for v in values], pa.decimal128(38, 0))


def _measured(vectors: DataFrame, scale: int, shift: int) -> tuple[int, list[int], list[int], list[int]]:
    """Rows, and least, greatest and sum of each dimension, of the commonest width."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for rows, x in _numbers(batch, scale):
                if not len(rows):
                    continue
                # High and low halves, as a sum of 64-bit numbers need not fit in 64 bits.
                sums = [(int(h) << 32) + int(low) for h, low in zip((x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0), strict=True)]
                own = [len(rows), x.min(axis=0), x.max(axis=0), sums]
                old = held.get(x.shape[1])
                if old:
                    own = [old[0] + own[0], np.minimum(old[1], own[1]), np.maximum(old[2], own[2]), [a + b for a, b in zip(old[3], sums, strict=True)]]
                held[x.shape[1]] = own
        for width, (n, least, most, sums) in held.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([width] * width), pa.array(range(width)), pa.array([n] * width), pa.array(least + shift), pa.array(most + shift), _decimals([s + n * shift for s in sums])],
                names=["width", "d", "n", "least", "most", "total"],
            )

    found = vectors.mapInArrow(run, f"width long, d long, n long, least long, most long, total {EXACT}")
    found = found.groupBy("width", "d").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"), F.sum("total").alias("total"))
    first = found.where("d = 0").orderBy(F.desc("n"), "width").first()
    if first is None:
        return 0, [], [], []
    rows = found.where(F.col("width") == first["width"]).orderBy("d").collect()
    return first["n"], [r["least"] for r in rows], [r["most"] for r in rows], [int(r["total"]) for r in rows]


def bit_planes(y: np.ndarray, bits: list[int]) -> np.ndarray:
    """One row of 64-bit words for each bit of each column, lowest bit first."""
    n = len(y)
    padded = np.zeros((sum(bits), -(-n // 64) * 64), dtype=np.uint8)
    at = 0
    for d, count in enumerate(bits):
        padded[at : at + count, :n] = (y[:, d][None, :] >> np.arange(count)[:, None]) & 1
        at += count
    return np.packbits(padded, axis=1).view(np.uint64)


def plane_counts(planes: np.ndarray) -> np.ndarray:
    """For each two planes (upper triangle) the rows that have both bits."""
    out = np.zeros((len(planes), len(planes)), dtype=np.int64)
    for p in range(len(planes)):
        out[p, p:] = np.bitwise_count(planes[p:] & planes[p]).sum(axis=1, dtype=np.int64)
    return out


def weighted(counts: np.ndarray, bits: list[int]) -> Iterator[tuple[int, int, int]]:
    """Column, column and cross-product for each two columns, from the counts of their planes."""
    ends = np.concatenate([[0], np.cumsum(bits)])
    full = counts + np.triu(counts, 1).T
    for i, a in enumerate(bits):
        for j in range(i, len(bits)):
            block, total = full[ends[i] : ends[i + 1], ends[j] : ends[j + 1]], 0
            for s in range(a + bits[j] - 1):
                # Counts whose bits have one weight together.
                total += int(np.fliplr(block).trace(bits[j] - 1 - s)) << s
            yield i, j, total


def _scatter(vectors: DataFrame, scale: int, shift: int, least: list[int], bits: list[int]) -> dict[tuple[int, int], int]:
    """Exact sums of products of the numbers less their least, for each two dimensions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((sum(bits), sum(bits)), dtype=np.int64)
        low = np.array(least, dtype=np.int64) - shift
        for batch in batches:
            for _, x in _numbers(batch, scale, len(least)):
                for s in range(0, len(x), SLICE_ROWS):
                    counts += plane_counts(bit_planes(x[s : s + SLICE_ROWS] - low, bits))
        i, j, products = zip(*weighted(counts, bits), strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), _decimals(list(products))], names=["i", "j", "total"])

    found = vectors.mapInArrow(run, f"i int, j int, total {EXACT}").groupBy("i", "j").agg(F.sum("total").alias("total"))
    return {(r["i"], r["j"]): int(r["total"]) for r in found.collect()}


def fit_whitening(
    vectors: DataFrame, embedding: str = "embedding", components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT
) -> Whitening:
    """The whitening of all rows that take part.

    Rows whose vector is null or empty, or holds a null, NaN or infinity, take
    no part, nor do vectors of another width than the commonest (of equally
    common ones, the smallest). Repeated rows count each. Without any row the
    result has width 0. The driver receives one number for each two dimensions,
    however many rows there are; sums beyond 38 digits fail.

    A direction without variance (below rounding) has projection 0 and explains 0.
    ``identity_error`` is measured on the whitened rows, by one more pass, over
    the directions that have variance.
    """
    vectors = vectors.select(F.col(f"`{embedding}`").cast("array<double>").alias("embedding"))
    n, least, most, sums = _measured(vectors, scale, shift)
    if not n:
        return Whitening(0, [], [], np.zeros(0), np.zeros(0), np.zeros((0, 0)))
    bits = [max(1, (m - low).bit_length()) for low, m in zip(least, most, strict=True)]
    products = _scatter(vectors, scale, shift, least, bits)
    width, rest = len(least), [s - n * low for s, low in zip(sums, least, strict=True)]
    covariance = np.zeros((width, width))
    for (i, j), total in products.items():
        # Whole numbers until the one division, which rounds correctly.
        covariance[i, j] = covariance[j, i] = (n * total - rest[i] * rest[j]) / (n * n)
    values, columns = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")[: min(components, width)]
    values, columns = np.maximum(values[order], 0.0), columns[:, order]
    trace = float(np.trace(covariance))
    real = values > trace * width * np.finfo(float).eps
    divisor = np.sqrt(np.where(real, values, 1.0))
    model = Whitening(n, least, sums, values, np.where(real, values / (trace or 1.0), 0.0), np.where(real, columns / divisor, 0.0))
    model.identity_error = _identity_error(vectors, model, scale, shift)
    return model


def _whitened(x: np.ndarray, model: Whitening, shift: int) -> np.ndarray:
    """Rows (still without the shift) less the mean, projected."""
    low = np.array(model.least, dtype=np.int64)
    mean = np.array([(s - model.n * b) / model.n for s, b in zip(model.sums, model.least, strict=True)])
    return ((x - (low - shift)).astype(np.float64) - mean) @ model.projection


def _identity_error(vectors: DataFrame, model: Whitening, scale: int, shift: int) -> float:
    """The largest absolute entry of the whitened rows' covariance minus the identity."""
    count = model.projection.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, products = np.zeros(count), np.zeros((count, count))
        for batch in batches:
            for _, x in _numbers(batch, scale, model.width):
                z = _whitened(x, model, shift)
                total += z.sum(axis=0)
                products += z.T @ z
        i, j = np.divmod(np.arange(count * count), count)
        values = np.concatenate([total, products.ravel()])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([np.full(count, -1), i])), pa.array(np.concatenate([np.arange(count), j])), pa.array(values)], names=["i", "j", "total"]
        )

    rows = vectors.mapInArrow(run, "i long, j long, total double").groupBy("i", "j").agg(F.sum("total").alias("total")).collect()
    mean, products = np.zeros(count), np.zeros((count, count))
    for r in rows:
        if r["i"] < 0:
            mean[r["j"]] = r["total"] / model.n
        else:
            products[r["i"], r["j"]] = r["total"] / model.n
    # The rows are centred before they are multiplied; what rounding left of the mean is taken off here.
    wanted = np.diag((model.explained > 0).astype(float))
    return float(np.abs(products - np.outer(mean, mean) - wanted).max())


def _deviations(x: np.ndarray, model: Whitening, shift: int) -> list[int]:
    """Of each row the sum over dimensions of ``(n * number - sum)`` squared, exactly."""
    low = np.array(model.least, dtype=np.int64)
    rest = [s - model.n * b for s, b in zip(model.sums, model.least, strict=True)]
    y = x - (low - shift)
    most = max([model.n * int(y.max(initial=0)), *rest])
    if most * most * max(1, len(rest)) < 1 << 62:
        apart = y * model.n - np.array(rest, dtype=np.int64)
        return (apart * apart).sum(axis=1).tolist()
    apart = y.astype(object) * model.n - np.array(rest, dtype=object)
    return (apart * apart).sum(axis=1).tolist()


def whiten(
    vectors: DataFrame, model: Whitening, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = SCALE, shift: int = SHIFT
) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error``.

    One row for each row that takes part (as in ``fit_whitening``) and
    component, numbered from 1 by falling eigenvalue. ``deviation`` is the exact
    squared distance from the mean, times ``n`` squared, as decimal. Null and
    repeated ids stay; other columns go. Nothing is shuffled.
    """
    rows = vectors.select(F.col(f"`{vec_id}`").alias("vec_id"), F.col(f"`{embedding}`").cast("array<double>").alias("embedding"))
    count = model.projection.shape[1] if model.n else 0
    kind = rows.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches if count else ():
            for s in range(0, batch.num_rows, OUT_ROWS):
                part = batch.slice(s, OUT_ROWS)
                for places, x in _numbers(part, scale, model.width):
                    each = np.repeat(np.arange(len(places)), count)
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column("vec_id").take(pa.array(places[each])),
                            pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(places))),
                            pa.array(np.full(len(each), model.n)),
                            _decimals(_deviations(x, model, shift)).take(pa.array(each)),
                            pa.array(_whitened(x, model, shift).ravel()),
                            pa.array(np.tile(model.explained, len(places))),
                            pa.array(np.full(len(each), model.identity_error)),
                        ],
                        names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                    )

    return rows.mapInArrow(run, f"vec_id {kind}, component int, n long, deviation {EXACT}, whitened double, explained double, identity_error double")
