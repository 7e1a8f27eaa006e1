"""Similarity clusters within scenes, the best and the alternative of each, a selection floor, labels and groups."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera import config
from tessera.functions import scalar
from tessera.functions.session import cut


def pair_distances(vectors: DataFrame, key: str, scene: str, vector: str) -> DataFrame:
    """Cosine distance of every pair a < b of a scene."""
    unit = vectors.select(scene, F.col(key).alias("a"), scalar.l2_normalize(F.col(vector)).alias("_u"))
    other = unit.select(scene, F.col("a").alias("b"), F.col("_u").alias("_v"))
    return unit.join(other, scene).where("a < b").select(scene, "a", "b", scalar.cosine_distance(F.col("_u"), F.col("_v")).alias("distance"))


def average_linkage(x: np.ndarray, cut: float) -> np.ndarray:
    """Labels of average-linkage clusters of unit rows cut at cosine distance ``cut``, numbered by first member.

    Nearest-neighbour chain: average linkage is reducible, so merges found along a chain are those of the full order.
    """
    n = len(x)
    d = 1 - x @ x.T
    np.fill_diagonal(d, np.inf)
    if n <= 1 or d[np.triu_indices(n, 1)].max() < 1e-8:
        return np.zeros(n, np.int64)
    size, alive, root = np.ones(n), np.ones(n, bool), np.arange(n)
    chain: list[int] = []
    for _ in range(n - 1):
        if not chain:
            chain.append(int(np.flatnonzero(alive)[0]))
        while True:
            a = chain[-1]
            b = int(np.argmin(d[a]))
            if len(chain) > 1 and d[a, chain[-2]] <= d[a, b]:
                b = chain[-2]
                break
            chain.append(b)
        chain = chain[:-2]
        height = d[a, b]
        if a > b:
            a, b = b, a
        if height <= cut:
            root[root == b] = a
        merged = (size[a] * d[a] + size[b] * d[b]) / (size[a] + size[b])
        d[a], d[:, a] = merged, merged
        d[a, a] = np.inf
        d[b], d[:, b] = np.inf, np.inf
        size[a] += size[b]
        alive[b] = False
    _, first = np.unique(root, return_index=True)
    order = root[np.sort(first)]
    return np.array([int(np.flatnonzero(order == r)[0]) for r in root])


def cluster_scenes(vectors: DataFrame, key: str, scene: str | list[str], vector: str, cut: float = config.CLUSTER_DISTANCE) -> DataFrame:
    """(scene, key, local_label) by average linkage in each scene (named by one or more columns).

    Memory grows with the square of a scene's rows.
    """
    kinds = dict(vectors.dtypes)
    scenes = [scene] if isinstance(scene, str) else list(scene)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(key)
        x = np.stack([np.asarray(v, np.float64) for v in part[vector]])
        x = x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-8)
        return part[[*scenes, key]].assign(local_label=average_linkage(x, cut))

    ddl = ", ".join(f"{c} {kinds[c]}" for c in (*scenes, key))
    return vectors.select(*scenes, key, vector).groupBy(*scenes).applyInPandas(run, f"{ddl}, local_label long")


def global_cluster_ids(clusters: DataFrame, scene: str, label: str = "local_label", shoot: str = "shoot_id") -> DataFrame:
    """cluster_id over all scenes of a shoot, ascending by scene and label; numbered on one row for each cluster."""
    names = clusters.select(shoot, scene, label).distinct()
    return clusters.join(names.withColumn("cluster_id", F.row_number().over(Window.partitionBy(shoot).orderBy(scene, label)).cast("long") - 1), [shoot, scene, label])


def pick(frames: DataFrame, cluster: str = "cluster_id", primary: str = "composite_relevance", other: str = "qualiclip_score", key: str = "global_index", shoot: str = "shoot_id") -> DataFrame:
    """selected, aesthetic_disagreement and cluster_agreement, for each cluster of a shoot.

    The primary pick is the best gate-passing row (the best of all where none passes); the best gate-passing row by the
    other scorer is a second pick if the cluster has two passing rows and it differs.
    """
    gate = F.col("technical_gate_pass")
    w = Window.partitionBy(shoot, cluster)
    ranked = frames.withColumns(
        {
            "_first": F.row_number().over(w.orderBy(gate.desc(), F.col(primary).desc(), key)),
            "_second": F.row_number().over(w.orderBy(gate.desc(), F.col(other).desc(), key)),
            "_passing": F.sum(gate.cast("int")).over(w),
        }
    )
    alternative = (F.col("_second") == 1) & (F.col("_passing") >= 2) & (F.col("_first") != 1)
    marked = ranked.withColumn("_alt", alternative).withColumn("_has_alt", F.max(F.col("_alt").cast("int")).over(w) == 1)
    return marked.withColumns({"selected": (F.col("_first") == 1) | F.col("_alt"), "aesthetic_disagreement": F.col("_alt"), "cluster_agreement": (F.col("_first") == 1) & ~F.col("_has_alt")}).drop("_first", "_second", "_passing", "_alt", "_has_alt")


def selection_floor(frames: DataFrame, shoot: str = "shoot_id", score: str = "composite_relevance", key: str = "global_index") -> DataFrame:
    """Fill the selection up to max(3, 2 % of the rows) with the best unselected gate-passing rows."""
    counts = frames.groupBy(shoot).agg(F.greatest(F.lit(config.SELECT_LEAST), F.ceil(config.SELECT_SHARE * F.count("*"))).alias("_floor"), F.sum(F.col("selected").cast("int")).alias("_have"))
    need = counts.select(shoot, (F.col("_floor") - F.col("_have")).alias("_need"))
    # Only shoots that lack rows are ranked.
    spare = frames.where(~F.col("selected") & F.col("technical_gate_pass")).join(need.where("_need > 0"), shoot)
    added = spare.withColumn("_r", F.row_number().over(Window.partitionBy(shoot).orderBy(F.col(score).desc(), key))).where("_r <= _need").select(shoot, key, F.lit(True).alias("_add"))
    return frames.join(added, [shoot, key], "left").withColumn("selected", F.col("selected") | F.coalesce("_add", F.lit(False))).drop("_add")


def with_label(frames: DataFrame) -> DataFrame:
    return frames.withColumn("label", scalar.label(F.col("selected"), F.col("aesthetic_disagreement"), F.col("technical_gate_pass")))


def match_features(items: DataFrame, features: DataFrame, on: str = "filename", order: str | None = None) -> DataFrame:
    """Items with their features and ``matched``; of features with one name the last by ``order`` counts."""
    if order is not None:
        others = [c for c in features.columns if c != on]
        features = features.groupBy(on).agg(F.max_by(F.struct(*others), order).alias("_f")).select(on, "_f.*")
    return items.join(features.withColumn("matched", F.lit(True)), on, "left").withColumn("matched", F.coalesce("matched", F.lit(False)))


def group_leaders(frames: DataFrame, cluster: str = "cluster_id", key: str = "global_index", stars: str = "star_rating") -> DataFrame:
    """Leader of each cluster of two or more rows: best-star Red, else best-star selected, else best-star."""
    tier = F.when(F.col("label") == "Red", 0).when(F.col("selected"), 1).otherwise(2)
    w = Window.partitionBy(cluster)
    ranked = frames.where(F.col(cluster) >= 0).withColumns({"_n": F.count("*").over(w), "_r": F.row_number().over(w.orderBy(tier, F.col(stars).desc(), key))})
    return ranked.where("_n >= 2 AND _r = 1").select(cluster, F.col(key).alias("leader"), F.col("_n").alias("n_rows"))


def reduce_bursts(frames: DataFrame, burst: str, score: str, keep: float = 0.1, key: str = "global_index") -> DataFrame:
    """The best share of each burst, one row at least."""
    w = Window.partitionBy(burst)
    return frames.withColumns({"_r": F.row_number().over(w.orderBy(F.col(score).desc(), key)), "_n": F.count("*").over(w)}).where(F.col("_r") <= F.greatest(F.lit(1), F.floor(F.col("_n") * keep))).drop("_r", "_n")


def greedy_dpp(kernel: np.ndarray, k: int) -> tuple[list[int], list[float]]:
    """Greedy maximum a posteriori selection of a determinantal point process, by incremental Cholesky factors."""
    n = len(kernel)
    gains, factors, picked, out = kernel.diagonal().astype(float).copy(), np.zeros((k, n)), [], []
    for t in range(min(k, n)):
        j = int(np.argmax(gains))
        if gains[j] <= 1e-10:
            break
        out.append(float(gains[j]))
        e = (kernel[j] - factors[:t].T @ factors[:t, j]) / np.sqrt(gains[j])
        factors[t] = e
        gains = gains - e * e
        gains[[*picked, j]] = -np.inf
        picked.append(j)
    return picked, out


def diverse_top_k(vectors: DataFrame, key: str, group: str, vector: str, quality: str, k: int) -> DataFrame:
    """(group, key, rank): k diverse rows of each group by quality-weighted similarity."""
    kinds = dict(vectors.dtypes)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(key)
        x = np.stack([np.asarray(v, np.float64) for v in part[vector]])
        x /= np.linalg.norm(x, axis=1, keepdims=True) + 1e-8
        q = part[quality].to_numpy(np.float64)
        picked, _ = greedy_dpp(q[:, None] * (x @ x.T) * q[None, :], k)
        return pd.DataFrame({group: part[group].iloc[picked], key: part[key].iloc[picked], "rank": np.arange(1, len(picked) + 1)})

    return vectors.select(group, key, vector, quality).groupBy(group).applyInPandas(run, f"{group} {kinds[group]}, {key} {kinds[key]}, rank long")


def with_position(frames: DataFrame, name: str, *order: Column) -> DataFrame:
    """``name``: 0-based place of each row among all rows, which ``order`` must tell apart.

    Ranges of the order are sorted side by side; each range's first place comes from the counts of those before it.
    """
    n = int(frames.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(frames.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    bases = ranged.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    placed = ranged.join(F.broadcast(bases), "_range").withColumn(name, F.col("_base") + F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1)
    return placed.drop("_range", "_base")


def ordinal_rank(score: Column, key: str, *partition: str) -> Column:
    """0-based rank by falling score, ties by key."""
    return F.row_number().over(Window.partitionBy(*partition).orderBy(score.desc(), key)).cast("long") - 1
