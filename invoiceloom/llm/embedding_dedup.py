"""Near-duplicate vectors by sorted projection passes.

In each pass the vectors, less the mean direction of the corpus, are put in the lexicographic order of many concatenated one-bit random
hashes, and each is compared with a window of neighbours, block by block. Vectors that are close agree in long prefixes in some pass. Rounds of
passes with new hashes follow until one joins no two components, so crowded directions get as many passes as they yield links, at any size.
Links inside the components found this way are then counted in full: a component that lies within half the
angle of its centre is linked throughout, and only vectors outside that are compared, block by block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from invoiceloom.llm.components import components
from invoiceloom.llm.rows import column, written

THRESHOLD = 0.95
PASSES = 16
BITS = 62
WINDOW = 256
BLOCK = 512


def planes(dim: int, passes: int, turn: int = 0) -> np.ndarray:
    """Normals of the random hyperplanes of all passes of a round; the same for every task and run."""
    return np.random.default_rng([20240611, dim, turn]).standard_normal((dim, passes * BITS))


def order_keys(vectors: np.ndarray, passes: int, turn: int = 0) -> np.ndarray:
    """A whole number per vector and pass whose order is the lexicographic order of its hashes."""
    bits = (vectors @ planes(vectors.shape[1], passes, turn) > 0).reshape(len(vectors), passes, BITS)
    return bits.astype(np.int64) @ (np.int64(1) << np.arange(BITS - 1, -1, -1, dtype=np.int64))


def unit(vectors: np.ndarray) -> np.ndarray:
    v = vectors.astype(np.float64)
    v /= np.abs(v).max(axis=1, keepdims=True)  # so that squares stay in range
    return v / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]


def close_pairs(ids: np.ndarray, vectors: np.ndarray, window: int, threshold: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that connect all rows which pairs of cosine ``threshold`` at most ``window`` apart connect; one for each row and block at most."""
    u, found = unit(vectors), []
    for at in range(0, max(len(ids) - window, 1), window):
        block = u[at : at + 2 * window]
        near = block @ block.T >= threshold
        np.fill_diagonal(near, False)
        rows = np.flatnonzero(near.any(axis=1))
        if not len(rows):
            continue
        near = near[np.ix_(rows, rows)] | np.eye(len(rows), dtype=bool)
        least = np.arange(len(rows))
        while True:
            now = np.where(near, least, len(rows)).min(axis=1)
            now = now[now]
            if (now == least).all():
                break
            least = now
        moved = np.flatnonzero(least != np.arange(len(rows)))
        found.append((ids[at + rows[moved]], ids[at + rows[least[moved]]]))
    return found


def mean_directions(kinds: DataFrame, dtype: str) -> dict[int, np.ndarray]:
    """The mean of the unit vectors of each length; a task sends one sum per length."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            dims, cells = np.asarray(batch.column(0)), batch.column(1).to_pylist()
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                total = unit(np.frombuffer(b"".join(cells[i] for i in at), dtype).reshape(len(at), dim)).sum(axis=0)
                known = sums.setdefault(dim, [0, np.zeros(dim)])
                known[0] += len(at)
                known[1] += total
        columns = [list(sums), [n for n, _ in sums.values()], [x.tobytes() for _, x in sums.values()]]
        types = (pa.int32(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["dim", "n", "total"])

    count, total = {}, {}
    for r in sorted(kinds.select("dim", "vec").mapInArrow(add, "dim int, n long, total binary").collect()):
        count[r.dim] = count.get(r.dim, 0) + r.n
        total[r.dim] = total.get(r.dim, 0) + np.frombuffer(r.total)
    return {dim: np.round(x / count[dim], 9) for dim, x in total.items()}


FOUND = pa.schema(
    [("u", pa.int64()), ("v", pa.int64()), ("border", pa.int64()), ("place", pa.int32()), ("dim", pa.int32()), ("pass", pa.int32()), ("id", pa.int64()), ("vec", pa.binary())]
)
FOUND_DDL = "u long, v long, border long, place int, dim int, pass int, id long, vec binary"


def link_batch(pairs: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    u = np.concatenate([np.minimum(a, b) for a, b in pairs]) if pairs else np.zeros(0, np.int64)
    v = np.concatenate([np.maximum(a, b) for a, b in pairs]) if pairs else np.zeros(0, np.int64)
    empty = [pa.nulls(len(u), FOUND.field(i).type) for i in range(2, len(FOUND))]
    return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), *empty], schema=FOUND)


def window_links(ordered: DataFrame, dtype: str, window: int, threshold: float) -> DataFrame:
    """Links between neighbours inside the partitions of sorted rows, and the rows at their borders."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        begun, tail, tail_key = 0, [], None

        def border(number: int, place: int, rows: list[tuple]) -> pa.RecordBatch:
            columns = [[number] * len(rows), [place + i for i in range(len(rows))], *(list(x) for x in zip(*rows, strict=True))]
            none = [pa.nulls(len(rows), pa.int64())] * 2
            return pa.RecordBatch.from_arrays([*none, *(pa.array(c, FOUND.field(i + 2).type) for i, c in enumerate(columns))], schema=FOUND)

        for batch in batches:
            dims, passes, ids = (np.asarray(batch.column(i)) for i in (0, 1, 2))
            cells = batch.column(3).to_pylist()
            rows = list(zip(dims.tolist(), passes.tolist(), ids.tolist(), cells, strict=True))
            if begun < window:
                yield border(part - 1, window, rows[: window - begun])
                begun += len(rows[: window - begun])
            change = np.flatnonzero((np.diff(dims) != 0) | (np.diff(passes) != 0)) + 1
            pairs = []
            for a, b in zip([0, *change], [*change, len(ids)], strict=True):
                key = (dims[a], passes[a])
                before = tail if key == tail_key else []
                own = np.concatenate([np.array([r[2] for r in before], np.int64), ids[a:b]])
                matrix = np.frombuffer(b"".join([*(r[3] for r in before), *cells[a:b]]), dtype).reshape(len(own), int(dims[a]))
                pairs += close_pairs(own, matrix, window, threshold)
                tail, tail_key = (before + rows[a:b])[-window:], key
            if pairs:
                yield link_batch(pairs)
        if tail:
            yield border(part, 0, tail)

    return ordered.mapInArrow(scan, FOUND_DDL)


def border_links(borders: DataFrame, dtype: str, window: int, threshold: float) -> DataFrame:
    """Links across the border of two partitions: at most ``window`` rows of each side meet."""

    def meet(group: pa.Table) -> pa.Table:
        group = group.sort_by("place")
        place, dims, passes, ids = (np.asarray(group.column(c).combine_chunks()) for c in ("place", "dim", "pass", "id"))
        cells = group.column("vec").to_pylist()
        left = np.flatnonzero(place < window)
        pairs = []
        if len(left) and len(left) < len(ids):
            same = np.flatnonzero((dims == dims[left[-1]]) & (passes == passes[left[-1]]))
            matrix = np.frombuffer(b"".join(cells[i] for i in same), dtype).reshape(len(same), int(dims[left[-1]]))
            pairs = close_pairs(ids[same], matrix, window, threshold)
        return pa.Table.from_batches([link_batch(pairs)]).select(["u", "v"])

    return borders.groupBy("border").applyInArrow(meet, "u long, v long")


def round_links(kinds: DataFrame, means: dict[int, np.ndarray], dtype: str, passes: int, window: int, threshold: float, turn: int) -> DataFrame:
    """Links found by one round of sorted passes; each round has hashes of its own."""

    @F.arrow_udf("array<long>")
    def keys(vec: pa.Array) -> pa.Array:
        out: list = [None] * len(vec)
        cells = vec.to_pylist()
        sizes = np.array([len(c) for c in cells])
        for size in np.unique(sizes):
            at = np.flatnonzero(sizes == size)
            matrix = unit(np.frombuffer(b"".join(cells[i] for i in at), dtype).reshape(len(at), -1))
            for i, k in zip(at, order_keys(matrix - means[matrix.shape[1]], passes, turn), strict=True):
                out[i] = k
        return pa.array(out, pa.list_(pa.int64()))

    spread = kinds.select("dim", "id", "vec", F.posexplode(keys("vec")).alias("pass", "key"))
    spread = spread.withColumn("tie", F.xxhash64("id", "pass", F.lit(turn)))
    order = ("dim", "pass", "key", "tie", "id")
    ordered = spread.repartitionByRange(*order).sortWithinPartitions(*order)
    found = written(window_links(ordered.select("dim", "pass", "id", "vec"), dtype, window, threshold), "windows")
    borders = found.where("border is not null").select("border", "place", "dim", "pass", "id", "vec")
    return found.where("u is not null").select("u", "v").union(border_links(borders, dtype, window, threshold)).distinct()


def joining(links: DataFrame, labels: DataFrame) -> DataFrame:
    """Links between components, as pairs of these."""
    for end in ("u", "v"):
        known = labels.select(F.col("id").alias(end), F.col("component").alias(f"{end}_component"))
        links = links.join(known, end, "left").withColumn(end, F.coalesce(f"{end}_component", end)).drop(f"{end}_component")
    return links.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def joined_labels(labels: DataFrame, merged: DataFrame) -> DataFrame:
    """``labels`` where components became part of others; ids that had none come in with theirs."""
    merged = written(merged, "labels")
    to = merged.select(F.col("id").alias("component"), F.col("component").alias("whole"))
    moved = labels.join(to, "component", "left").select("id", F.coalesce("whole", "component").alias("component"))
    return moved.union(merged.join(labels, "id", "left_anti").select("id", "component"))


def near_duplicates(
    df: DataFrame,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    threshold: float = THRESHOLD,
    passes: int = PASSES,
    window: int = WINDOW,
) -> DataFrame:
    """(id, n_links, component_id, kept) of every row: other vectors linked directly, smallest id reachable, whether that is its own.

    Only vectors of equal length are compared, by cosine in double precision; equal vectors count as one while searching, so their number
    doesn't matter. Vectors that are null, empty, zero, or hold null or non-finite components link with nothing. Rows that repeat an id are separate
    vectors of one id. Rows with a null id have no links, a null component, and are kept. An empty table gives an empty one.
    """
    element = df.select(column(vector_column).alias("x")).schema["x"].dataType.elementType.simpleString()
    dtype = "<f4" if element == "float" else "<f8"
    rows = df.select(column(id_column).cast("long").alias("id"), column(vector_column).alias("x"))
    number = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    sound = F.col("id").isNotNull() & (F.size("x") > 0) & F.forall("x", number) & F.exists("x", lambda c: c != 0)

    @F.arrow_udf("binary")
    def as_bytes(lists: pa.Array) -> pa.Array:
        return pa.array([np.asarray(x.values, dtype).tobytes() for x in lists], pa.binary())

    valid = rows.where(F.coalesce(sound, F.lit(False))).select("id", F.size("x").alias("dim"), as_bytes("x").alias("vec"))
    marked = written(valid.withColumn("digest", F.sha2(F.concat("vec", F.lit(b"|")), 256)), "vectors")
    equal = written(marked.groupBy("digest").agg(F.min("id").alias("first_id"), F.count("*").alias("copies")), "copies")
    kinds = marked.join(equal, "digest").where("id = first_id").dropDuplicates(["digest"]).select("digest", "id", "dim", "vec", "copies")
    kinds = written(kinds, "vectors")

    means = mean_directions(kinds, dtype)
    labels, turn = None, 0
    while True:
        links = round_links(kinds, means, dtype, passes, window, threshold, turn)
        if labels is None:
            labels = written(components(links), "labels")
        else:
            joins = written(joining(links, labels), "links")
            if joins.isEmpty():
                break
            labels = written(joined_labels(labels, components(joins)), "labels")
        turn += 1

    # every link inside a component
    joined = written(kinds.join(labels, "id").select("id", "component", "dim", "vec", "copies"), "members")

    @F.arrow_udf("array<double>")
    def directions(vec: pa.Array) -> pa.Array:
        return pa.array([unit(np.frombuffer(c.as_buffer(), dtype)[None, :])[0] for c in vec], pa.list_(pa.float64()))

    sums = joined.select("component", F.posexplode(directions("vec")).alias("at", "x")).groupBy("component", "at").agg(F.sum("x").alias("x"))
    centres = sums.groupBy("component").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda s: s["x"]).alias("centre"))

    @F.arrow_udf("double")
    def angle(vec: pa.Array, centre: pa.Array) -> pa.Array:
        out = []
        for a, b in zip(vec, centre, strict=True):
            c = np.asarray(b.values)
            size = float(np.sqrt(np.dot(c, c)))
            cosine = float(np.dot(unit(np.frombuffer(a.as_buffer(), dtype)[None, :])[0], c)) / size if size > 0 else -1.0
            out.append(float(np.arccos(min(max(cosine, -1.0), 1.0))))
        return pa.array(out)

    placed = written(joined.join(centres, "component").withColumn("angle", angle("vec", "centre")).drop("centre"), "members")
    widest = placed.groupBy("component").agg(F.max("angle").alias("widest"), F.sum("copies").alias("total"), F.count("*").alias("size"))
    sure = float(np.arccos(threshold)) - 1e-7
    told = placed.join(widest, "component")
    tight = told.where(F.col("angle") + F.col("widest") <= sure).select("id", F.col("total").alias("near"))
    loose = told.where(F.col("angle") + F.col("widest") > sure).select("component", "id", "size", "vec", "copies")
    open_components = loose.select("component").distinct()

    def blocks(members: DataFrame, side: str) -> DataFrame:
        number = F.pmod(F.xxhash64("id"), F.ceil(F.col("size") / BLOCK))
        packed = members.groupBy("component", number.alias("block")).agg(F.collect_list(F.struct("id", "vec", "copies")).alias(side))
        return packed.withColumnRenamed("block", f"{side}_block")

    @F.arrow_udf("array<struct<id: long, near: long>>")
    def counted(left: pa.Array, right: pa.Array) -> pa.Array:
        out = []
        for a, b in zip(left, right, strict=True):
            x, y = (unit(np.stack([np.frombuffer(r["vec"], dtype) for r in side.as_py()])) for side in (a, b))
            copies = np.array([r["copies"] for r in b.as_py()])
            out.append([{"id": r["id"], "near": int(n)} for r, n in zip(a.as_py(), ((x @ y.T) >= threshold) @ copies, strict=True)])
        return pa.array(out, pa.list_(pa.struct([("id", pa.int64()), ("near", pa.int64())])))

    members = told.join(open_components, "component", "left_semi").select("component", "id", "size", "vec", "copies")
    met = blocks(loose, "left").join(blocks(members, "right"), "component")
    compared = met.select(F.explode(counted("left", "right")).alias("r")).groupBy("r.id").agg(F.sum("r.near").alias("near"))
    near = tight.union(compared)

    per_kind = (
        equal.join(labels, F.col("first_id") == labels["id"], "left").drop("id")
        .join(near.withColumnRenamed("id", "near_id"), F.col("first_id") == F.col("near_id"), "left")
        .select("digest", F.coalesce("component", "first_id").alias("component"), (F.coalesce("near", "copies") - 1).alias("n_links"))
    )
    known = marked.join(per_kind, "digest").groupBy("id").agg(F.min("component").alias("component"), F.max("n_links").alias("n_links"))
    out = rows.select("id").join(known, "id", "left")
    component = F.coalesce("component", "id")
    return out.select(
        F.col("id").alias(id_column), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )
