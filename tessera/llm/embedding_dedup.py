"""Operator 10: exact near-duplicate links of embeddings by cosine, comparing tiles in PCA order.

Vectors are scaled to unit length in double precision and rotated to the principal axes of all of them, so that the
leading coordinates hold most of every dot product. Tiles of at most ``TILE`` vectors or ``TILE_BYTES`` are compared in
steps of ``STEP`` coordinates: after each step the missing part of a product is at most the product of the two suffix
norms, and pairs whose sum of both stays under the threshold are dropped. Survivors are decided by the full cosine of
the vectors as they came, in double precision.

Equal vectors are one vertex with a multiplicity, so copies aren't compared with each other. A tile task returns, for
each vector, its number of links and one spanning link, never pairs. Tiles are cut by a hash of the vector, and where
there are many also in bands (at most ``BANDS``) of the first coordinate: bands too far apart never meet. A vector is
sent once for each tile that its own tile meets, so large tiles keep the copies few.
The work grows with the square of the number of distinct vectors, in tasks of fixed size; nothing is dropped.

Defined cases: a vector that is null, empty, zero or holds a null or non-finite component links with nothing; vectors
of different lengths never link; a null id links with nothing and has a null component (kept); rows that share an id
are counted apart and are one component; labels aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.components import connected_components
from tessera.llm.storage import batches_of, materialize

TILE, TILE_BYTES, BANDS, STEP, ROWS = 8192, 16 << 20, 64, 16, 256
SLACK = 1e-4  # of single-precision partial sums against the threshold


def _unit(flat: np.ndarray, dim: int) -> np.ndarray:
    x = flat.reshape(-1, dim).astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _moments(dim: int):
    """Sums of products of unit vectors, a row for each cell of the upper triangle and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for batch in batches:
            if batch.num_rows:
                x = _unit(batch.column(0).flatten().to_numpy(zero_copy_only=False), dim)
                total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim * dim)), pa.array(total.ravel())], names=["cell", "total"])

    return run


def principal_axes(vectors: DataFrame, dim: int) -> np.ndarray:
    """Axes (columns) by falling share of the unit vectors' products; dim * dim numbers reach the driver."""
    cells = vectors.select("vector").mapInArrow(_moments(dim), "cell long, total double").groupBy("cell").agg(F.sum("total").alias("total")).collect()
    moments = np.zeros(dim * dim)
    for r in cells:
        moments[r.cell] = r.total
    _, axes = np.linalg.eigh(moments.reshape(dim, dim))
    return np.ascontiguousarray(axes[:, ::-1])


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least position connected to each of n positions by the links a-b, by hooking and pointer jumping."""
    root = np.arange(n)
    while len(a):
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        np.minimum.at(root, high, low)
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
        open_ = root[a] != root[b]
        a, b = a[open_], b[open_]
    return root


def close_pairs(x: np.ndarray, y: np.ndarray, threshold: float, triangle: bool, plain: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Positions (in x, in y) with dot product >= threshold of unit rows in PCA order; ``triangle``: x is y, pairs once.

    ``plain`` are the same rows before the rotation, which decide.
    """
    plain = plain or (x, y)
    dim = x.shape[1]
    narrow_x, narrow_y = x.astype(np.float32), y.astype(np.float32)
    squares_x, squares_y = np.cumsum((narrow_x**2)[:, ::-1], 1)[:, ::-1], np.cumsum((narrow_y**2)[:, ::-1], 1)[:, ::-1]
    out_a, out_b = [], []
    for at in range(0, len(x), ROWS):
        part = narrow_x[at : at + ROWS]
        first = at if triangle else 0
        done = min(STEP, dim)
        sums = part[:, :done] @ narrow_y[first:, :done].T
        while True:
            if done < dim:
                rest = np.sqrt(np.maximum(squares_x[at : at + ROWS, done], 0))[:, None] * np.sqrt(np.maximum(squares_y[first:, done], 0))[None, :]
                alive = sums + rest >= threshold - SLACK
            else:
                alive = sums >= threshold - SLACK
            n_alive = int(np.count_nonzero(alive))
            if done >= dim or n_alive * 8 < alive.size:
                break
            to = min(dim, done + STEP)
            sums += part[:, done:to] @ narrow_y[first:, done:to].T
            done = to
        i, j = np.nonzero(alive)
        partial, i, j = sums[alive], i + at, j + first
        if triangle:
            keep = i < j
            partial, i, j = partial[keep], i[keep], j[keep]
        while done < dim and len(i):  # few are left: go on with those alone
            to = min(dim, done + STEP)
            partial = partial + np.einsum("nd,nd->n", narrow_x[i, done:to], narrow_y[j, done:to])
            done = to
            rest = np.sqrt(np.maximum(squares_x[i, done], 0) * np.maximum(squares_y[j, done], 0)) if done < dim else 0
            keep = partial + rest >= threshold - SLACK
            partial, i, j = partial[keep], i[keep], j[keep]
        for a in range(0, len(i), 1 << 18):
            p, q = i[a : a + (1 << 18)], j[a : a + (1 << 18)]
            exact = np.einsum("nd,nd->n", plain[0][p], plain[1][q]) >= threshold
            out_a.append(p[exact])
            out_b.append(q[exact])
    none = np.zeros(0, np.int64)
    return (np.concatenate(out_a), np.concatenate(out_b)) if out_a else (none, none)


def _compare(dim: int, axes: np.ndarray, threshold: float):
    schema = pa.schema([("id", pa.int64()), ("key", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right, members = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)
            ends = np.cumsum(members.value_lengths().to_numpy(zero_copy_only=False))
            flat = members.flatten()
            tile, ids, keys, copies = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("tile", "id", "h1", "copies"))
            raw = flat.field("vector").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            for k, e in enumerate(ends.tolist()):
                s = int(ends[k - 1]) if k else 0
                mine = [np.flatnonzero(tile[s:e] == t) + s for t in ((left[k],) if left[k] == right[k] else (left[k], right[k]))]
                units = [_unit(raw[m].ravel(), dim) for m in mine]
                turned = [u @ axes for u in units]
                a, b = close_pairs(turned[0], turned[-1], threshold, len(mine) == 1, (units[0], units[-1]))
                if not len(a):
                    continue
                a, b = mine[0][a], mine[-1][b]
                here, n = np.concatenate([a, b]), e - s
                links = np.bincount(here - s, np.concatenate([copies[b], copies[a]]), n).astype(np.int64)
                order = np.argsort(ids[s:e], kind="stable")
                rank = np.empty(n, np.int64)
                rank[order] = np.arange(n)
                root = order[_roots(n, rank[a - s], rank[b - s])[rank]]
                hit = np.flatnonzero(links)
                yield pa.RecordBatch.from_arrays([pa.array(ids[s:e][hit]), pa.array(keys[s:e][hit]), pa.array(links[hit]), pa.array(ids[s:e][root[hit]])], schema=schema)

    return run


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding", tile: int = TILE) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row."""
    v = F.col("vector")
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    usable = F.coalesce(F.col("vec_id").isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda c: c != 0), F.lit(False))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector"))
    rows = rows.select("vec_id", "vector", usable.alias("usable"), F.size(v).alias("dim"), F.xxhash64("vector").alias("h1"), F.xxhash64(F.lit(1), "vector").alias("h2"))
    distinct = materialize(rows.where("usable").groupBy("dim", "h1", "h2").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"), F.min_by("vector", "vec_id").alias("vector")), "vectors")
    found = None
    for dim, n in distinct.groupBy("dim").count().collect():  # one row for each length that occurs
        same = distinct.where(F.col("dim") == dim)
        axes = principal_axes(same, dim)
        lead = F.aggregate(F.zip_with("vector", F.array(*(F.lit(float(c)) for c in axes[:, 0])), lambda x, y: x.cast("double") * y), F.lit(0.0), lambda a, x: a + x)
        length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
        placed = same.select("id", "h1", "copies", "vector", (lead / length).alias("lead"))
        tiles = max(1, -(-n // max(64, min(tile, TILE_BYTES // (8 * dim)))))
        bands = int(min(BANDS, max(1, tiles // 4)))
        cuts = sorted(set(placed.approxQuantile("lead", [k / bands for k in range(1, bands)], 0.25 / bands))) if bands > 1 else []
        band = sum(((F.col("lead") >= c).cast("int") for c in cuts), F.lit(0))
        per_band = -(-tiles // (len(cuts) + 1))
        placed = placed.withColumn("band", band).withColumn("tile", F.col("band") * per_band + F.pmod(F.xxhash64("id"), F.lit(per_band)))
        placed = materialize(placed.withColumn("tile", F.col("tile").cast("long")), "tiles")
        boxes = placed.groupBy("band").agg(F.min("lead").alias("low"), F.max("lead").alias("high")).collect()  # at most BANDS rows
        far = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + 1e-6  # unit vectors with this cosine are no farther apart
        near = [(x.band, y.band) for x in boxes for y in boxes if y.low - x.high <= far and x.low - y.high <= far]
        numbered = placed.select("band", "tile").distinct()
        meeting = numbered.select(F.col("band").alias("x"), F.col("tile").alias("a")).join(placed.sparkSession.createDataFrame(near, "x int, y int"), "x").join(numbered.select(F.col("band").alias("y"), F.col("tile").alias("b")), "y")
        sides = materialize(meeting.where("a <= b").select("a", "b"), "tile-pairs")
        sides = sides.withColumn("tile", F.explode(F.array_distinct(F.array("a", "b"))))
        dealt = placed.join(sides, "tile").select("a", "b", F.struct("tile", "id", "h1", "copies", "vector").alias("member"))
        links = dealt.groupBy("a", "b").agg(F.collect_list("member").alias("members")).mapInArrow(_compare(dim, axes, threshold), "id long, key long, links long, root long")
        found = links if found is None else found.unionByName(links)
    if found is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    with batches_of(vectors.sparkSession, 1):  # a row holds two tiles
        found = materialize(found, "links")
    per_vector = found.groupBy("id", F.col("key").alias("h1")).agg(F.sum("links").alias("links"))
    named = connected_components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    known = distinct.select("dim", "h1", "h2", "id", "copies").join(per_vector, ["id", "h1"], "left").join(named.withColumnRenamed("node", "id"), "id", "left")
    known = known.select("dim", "h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component", "id").alias("component"))
    joined = rows.drop("vector").join(known, ["dim", "h1", "h2"], "left")
    links, component = F.when(F.col("usable"), F.col("links")).otherwise(0).cast("long"), F.when(F.col("usable"), F.col("component")).otherwise(F.col("vec_id"))
    return joined.select("vec_id", links.alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
