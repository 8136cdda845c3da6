"""Embedding whitening by spectral divide and conquer.

Tasks add up sums, then products of centred vectors; one matrix of the vectors' length reaches the driver. There its
spectrum is split by the polar factor of the shifted covariance (dynamically weighted Halley steps by QR): half of one plus the factor projects on
the eigenvalues above the shift. Bases of both sides give two smaller problems, until components stand alone. The components are few
numbers and go to the tasks that project every vector on them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from invoiceloom.llm.rows import column

COMPONENTS = 32
SCALE = 64
SHIFT = 1_000_000
ROWS_AT_ONCE = 4096

#: Entries beyond this have no exact whole number; vectors that hold one are left out like those with an infinite entry.
LARGEST = float(2**45)
EPS = np.finfo(float).eps


# Spectrum ---------------------------------------------------------------------------------------------------------


def polar_factor(a: np.ndarray) -> np.ndarray:
    """The orthogonal factor of a symmetric matrix: QR-based dynamically weighted Halley steps.

    The step's weights follow a lower bound of the singular values, so six or seven steps do for any matrix that isn't singular to
    working precision.
    """
    n = len(a)
    x = a / max(np.linalg.norm(a), np.finfo(float).tiny)
    try:
        low = max(1 / np.linalg.norm(np.linalg.inv(x)), EPS)
    except np.linalg.LinAlgError:
        low = EPS
    for _ in range(30):
        square = min(low * low, 1.0)
        d = np.cbrt(4 * (1 - square) / (square * square))
        root = np.sqrt(1 + d)
        wa = root + 0.5 * np.sqrt(max(8 - 4 * d + 8 * (2 - square) / (square * root), 0.0))
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        q, _ = np.linalg.qr(np.vstack((np.sqrt(wc) * x, np.eye(n))))
        after = (wb / wc) * x + (wa - wb / wc) / np.sqrt(wc) * (q[:n] @ q[n:].T)
        after = (after + after.T) / 2
        moved, x = np.linalg.norm(after - x), after
        low = min(low * (wa + wb * square) / (1 + wc * square), 1.0)
        if moved <= (4 * EPS) ** (1 / 3) * 0.1 and abs(1 - low) < 10 * EPS:
            break
    return x


def split_at(a: np.ndarray, shift: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of the invariant subspaces above and below ``shift``; none where an eigenvalue is too near to it."""
    n = len(a)
    projector = (polar_factor(a - shift * np.eye(n)) + np.eye(n)) / 2
    rank = round(float(np.trace(projector)))
    if not 0 < rank < n or np.linalg.norm(projector @ projector - projector) > 1e-8 * n:
        return None
    # columns of the projector of the largest norms, then one more product, span its range
    start = projector[:, np.argsort(-np.diag(projector), kind="stable")]
    q, r = np.linalg.qr(start)
    if np.abs(np.diag(r))[:rank].min() < 1e-3:  # those columns depend on each other: mix them all
        q, _ = np.linalg.qr(projector @ np.random.default_rng(n).standard_normal((n, n)))
    q, _ = np.linalg.qr(np.hstack((projector @ q[:, :rank], q[:, rank:])))
    above, below = q[:, :rank], q[:, rank:]
    below = below - above @ (above.T @ below)
    below, _ = np.linalg.qr(below)
    if np.linalg.norm(above.T @ a @ below) > 1e-9 * max(np.linalg.norm(a), np.finfo(float).tiny):
        return None
    return above, below


def components(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, columns of unit eigenvectors) of a symmetric matrix, by falling eigenvalue."""
    a = (a + a.T) / 2
    whole = np.linalg.norm(a)
    vectors = np.eye(len(a))
    ready: list[tuple[float, np.ndarray]] = []
    stack = [(a, vectors)] if len(a) else []
    while stack:
        block, basis = stack.pop()
        n = len(block)
        mean = np.trace(block) / n
        spread = np.linalg.norm(block - mean * np.eye(n))
        if n == 1 or spread <= 4 * EPS * whole:
            ready.extend((float(block[i, i]), basis[:, i]) for i in range(n))
            continue
        # the mean of the eigenvalues always lies between them; beside it where one is too near
        found = None
        for part in (0.0, 0.05, -0.05, 0.11, -0.11, 0.23, -0.23, 0.4, -0.4, 0.7, -0.7):
            found = split_at(block, mean + part * spread / np.sqrt(n))
            if found is not None:
                break
        if found is None:
            rotation = jacobi(block)
            ready.extend((float(v), basis @ rotation[:, i]) for i, v in enumerate(np.diag(rotation.T @ block @ rotation)))
            continue
        for side in found:
            inner = side.T @ block @ side
            stack.append(((inner + inner.T) / 2, basis @ side))
    ready.sort(key=lambda x: -x[0])
    values = np.array([v for v, _ in ready])
    vectors = np.array([v for _, v in ready]).T if ready else np.zeros((0, 0))
    return polished(a, values, vectors) if len(values) else (values, vectors)


def jacobi(a: np.ndarray) -> np.ndarray:
    """Eigenvectors by plane rotations, for a cluster of eigenvalues that no shift splits."""
    a, v, n = a.copy(), np.eye(len(a)), len(a)
    for _ in range(60):
        if np.linalg.norm(a - np.diag(np.diag(a))) <= EPS * np.linalg.norm(a):
            break
        for p in range(n - 1):
            for q in range(p + 1, n):
                if a[p, q] != 0:
                    theta = 0.5 * np.arctan2(2 * a[p, q], a[q, q] - a[p, p])
                    c, s = np.cos(theta), np.sin(theta)
                    turn = np.array([[c, s], [-s, c]])
                    a[:, [p, q]] = a[:, [p, q]] @ turn
                    a[[p, q], :] = turn.T @ a[[p, q], :]
                    v[:, [p, q]] = v[:, [p, q]] @ turn
    return v


def polished(a: np.ndarray, values: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvectors corrected to working precision by two first-order steps; columns with equal eigenvalues are left as they are."""
    for _ in range(2):
        rotated = vectors.T @ a @ vectors
        values = np.diag(rotated).copy()
        gap = values[None, :] - values[:, None]
        near = np.abs(gap) <= 1e-6 * max(np.abs(values).max(), np.finfo(float).tiny)
        turn = np.where(near, 0.0, rotated / np.where(near, 1.0, gap))
        np.fill_diagonal(turn, 0.0)
        q, r = np.linalg.qr(vectors @ (np.eye(len(values)) + turn))
        vectors = q * np.where(np.diag(r) < 0, -1.0, 1.0)
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:, order]


# Corpus -----------------------------------------------------------------------------------------------------------


def whole_numbers(cells: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places of the rows, rows x dimensions of long) for each length of vectors in a batch, some rows at a time."""
    ends = np.asarray(cells.offsets).astype(np.int64)
    sizes = np.diff(ends)
    flat = np.asarray(cells.values).astype(np.float64)
    for dim in np.unique(sizes[sizes > 0]):
        rows = np.flatnonzero(sizes == dim)
        for at in range(0, len(rows), ROWS_AT_ONCE):
            part = rows[at : at + ROWS_AT_ONCE]
            entries = flat[ends[part][:, None] + np.arange(dim)]
            yield part, np.floor(SCALE * entries).astype(np.int64) + SHIFT


def sound_vectors(df: DataFrame, vector_column: str) -> Column:
    """Whether a vector is there and every entry of it is finite, and of a size that a whole number states."""
    sound = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= LARGEST)
    return F.coalesce(F.forall(column(vector_column), lambda x: F.coalesce(sound(x.cast("double")), F.lit(False))), F.lit(False))


def vector_sums(vectors: DataFrame) -> dict[int, tuple[int, list[int], list[int], list[int]]]:
    """By length of vectors: how many, and sums, least and greatest of each dimension."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for _, x in whole_numbers(batch.column(0)):
                n, s, low, high = held.get(x.shape[1], (0, 0, x[0], x[0]))
                held[x.shape[1]] = (n + len(x), s + x.sum(axis=0), np.minimum(low, x.min(axis=0)), np.maximum(high, x.max(axis=0)))
        for dim, (n, s, low, high) in held.items():
            yield pa.RecordBatch.from_pydict(
                {"dim": [dim] * dim, "at": list(range(dim)), "n": [n] * dim, "total": s.tolist(), "low": low.tolist(), "high": high.tolist()},
                pa.schema([("dim", pa.int32()), ("at", pa.int32()), ("n", pa.int64()), ("total", pa.int64()), ("low", pa.int64()), ("high", pa.int64())]),
            )

    told = vectors.select("vector").mapInArrow(add, "dim int, at int, n long, total long, low long, high long")
    total = F.sum(F.col("total").cast("decimal(38,0)"))
    summed = told.groupBy("dim", "at").agg(F.sum("n").alias("n"), total.alias("total"), F.min("low").alias("low"), F.max("high").alias("high"))
    out: dict[int, tuple[int, list[int], list[int], list[int]]] = {}
    for r in summed.orderBy("dim", "at").collect():  # a row per dimension
        n, s, low, high = out.setdefault(r["dim"], (r["n"], [], [], []))
        s.append(int(r["total"]))
        low.append(r["low"])
        high.append(r["high"])
    return out


def centred_products(vectors: DataFrame, centres: dict[int, np.ndarray], onto: dict[int, np.ndarray] | None = None) -> dict[int, np.ndarray]:
    """By length of vectors: sums over all vectors of the products of their centred entries, projected with ``onto`` first if given."""

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, x in whole_numbers(batch.column(0)):
                dim = x.shape[1]
                y = x - centres[dim]
                y = y if onto is None else y @ onto[dim]
                held[dim] = held.get(dim, 0) + y.T @ y
        for dim, m in held.items():
            i, j = np.triu_indices(len(m))
            for at in range(0, len(i), 100_000):
                part = slice(at, at + 100_000)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(i[part]), dim), pa.int32()), pa.array(i[part], pa.int32()), pa.array(j[part], pa.int32()), pa.array(m[i[part], j[part]])],
                    ["dim", "i", "j", "value"],
                )

    told = vectors.select("vector").mapInArrow(multiply, "dim int, i int, j int, value double")
    summed = told.groupBy("dim", "i", "j").agg(F.sum("value").alias("value")).toArrow()  # half a matrix
    dims, i, j, value = (np.asarray(summed.column(c).combine_chunks()) for c in ("dim", "i", "j", "value"))
    out = {}
    for dim, centre in centres.items():
        size = len(centre) if onto is None else onto[dim].shape[1]
        m, mine = np.zeros((size, size)), dims == dim
        m[i[mine], j[mine]] = value[mine]
        m[j[mine], i[mine]] = value[mine]
        out[dim] = m
    return out


def whitened(df: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error): a row for each sound vector and component up to ``most``.

    Entries count as whole numbers ``floor(64 c) + 1000000``. Vectors that are null or hold a null, infinite or undefined entry, or one beyond
    ``LARGEST``, are left out. Vectors of each length are whitened among themselves; one without entries has no component. Where the
    vectors don't vary in a component (one vector, equal ones, fewer vectors than dimensions), ``whitened`` is null and
    ``identity_error`` looks at the others (null if there is none). ``deviation`` is null where it exceeds a long. Repeated rows count each,
    null ids stay. An empty table gives an empty one. Other columns are not looked at.
    """
    vectors = df.where(sound_vectors(df, vector_column)).select(column(id_column).alias("id"), column(vector_column).alias("vector"))
    sums = vector_sums(vectors)
    centres = {dim: np.array([s / n for s in total]) for dim, (n, total, _, _) in sums.items()}
    spectrum, onto, explained = {}, {}, {}
    for dim, m in centred_products(vectors, centres).items():
        v = m / sums[dim][0]
        e, u = components(v)
        e, u = e[:most], u[:, :most]
        flat = e <= dim * EPS * max(e[0], 1.0)  # rounding leaves such eigenvalues of a component without variance
        trace = np.trace(v)
        spectrum[dim] = np.where(flat, 0.0, e)
        explained[dim] = np.where(flat, 0.0, e / trace) if trace > 0 else np.zeros(len(e))
        onto[dim] = np.where(flat, 0.0, u / np.sqrt(np.where(flat, 1.0, e)))
    errors = {}
    for dim, m in centred_products(vectors, centres, onto).items() if onto else ():
        there = spectrum[dim] > 0
        errors[dim] = float(np.abs(m / sums[dim][0] - np.eye(len(m)))[np.ix_(there, there)].max()) if there.any() else None

    exact = {}
    for dim, (n, total, low, high) in sums.items():
        far = sum(max(abs(n * lo - s), abs(n * hi - s)) ** 2 for s, lo, hi in zip(total, low, high, strict=True))
        exact[dim] = far < 2**63 and max(max(abs(lo), abs(hi)) for lo, hi in zip(low, high, strict=True)) * n < 2**62

    def deviations(x: np.ndarray) -> pa.Array:
        n, total, _, _ = sums[x.shape[1]]
        if exact[x.shape[1]]:
            off = n * x - np.array(total, np.int64)
            return pa.array((off * off).sum(axis=1))
        wide = [sum((n * v - s) ** 2 for v, s in zip(r, total, strict=True)) for r in x.tolist()]
        return pa.array([v if v < 2**63 else None for v in wide], pa.int64())

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in whole_numbers(batch.column(1)):
                dim = x.shape[1]
                out = (x - centres[dim]) @ onto[dim]
                k = out.shape[1]
                each = pa.array(np.repeat(np.arange(len(x)), k))
                tiled = lambda a: pa.array(np.tile(a, len(x)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows)).take(each), tiled(np.arange(1, k + 1, dtype=np.int32)),
                     pa.array(np.full(k * len(x), sums[dim][0])), deviations(x).take(each),
                     pa.array(out.ravel(), mask=np.tile(spectrum[dim] == 0, len(x))), tiled(explained[dim]),
                     pa.array([errors[dim]] * (k * len(x)), pa.float64())],
                    ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    kind = vectors.schema["id"].dataType.simpleString()
    rows = vectors.mapInArrow(project, f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    return rows.withColumnRenamed("id", id_column)
