"""Technical gate, consensus and disagreement of scorers, principal components, ratings and categories."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera import config
from tessera.functions.session import cut

LOW = float("-inf")


def technical_gate() -> Column:
    """A blink fails; else two failing checks (one, where fewer than two are available) fail. 0 means not measured."""
    checks = [(F.col("topiq_score"), config.GATE_TOPIQ), (F.col("musiq_score"), config.GATE_MUSIQ), (F.when(F.col("has_face"), F.col("sharp_near_eye")).otherwise(F.col("sharpness_subject")), config.GATE_SHARP)]
    available = sum(((v > 0).cast("int") for v, _ in checks), F.lit(0))
    failures = sum((((v > 0) & (v < t)).cast("int") for v, t in checks), F.lit(0))
    return ~F.col("blink_detected") & (failures < F.when(available >= 2, 2).otherwise(1))


def active_columns(frames: DataFrame, columns: list[str]) -> list[str]:
    """The columns with any value other than 0, in order, by one aggregate."""
    if not columns:
        return []
    row = frames.agg(*(F.coalesce(F.bool_or(F.coalesce(F.col(c), F.lit(0)) != 0), F.lit(False)).alias(c) for c in columns)).first()
    return [c for c in columns if row[c]]


def z_columns(frames: DataFrame, columns: list[str], shoot: str = "shoot_id") -> DataFrame:
    """z_<column> over all rows of a shoot: population deviation, under 1e-8 counts as 1. Means are joined, not windowed."""
    stats = frames.groupBy(shoot).agg(*(F.avg(c).alias(f"_m_{c}") for c in columns), *(F.stddev_pop(c).alias(f"_s_{c}") for c in columns))
    z = {f"z_{c}": (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") < 1e-8, 1.0).otherwise(F.col(f"_s_{c}")) for c in columns}
    return frames.join(stats, shoot).withColumns(z).drop(*stats.columns[1:])


def consensus(frames: DataFrame, weights: dict[str, float], shoot: str = "shoot_id") -> DataFrame:
    """z_consensus (weighted mean of z) and z_disagreement (population deviation across z, unweighted)."""
    total = sum(weights.values())
    if total == 0:
        raise ValueError("the consensus weights sum to zero")
    z = z_columns(frames, list(weights), shoot)
    cols = [F.col(f"z_{c}") for c in weights]
    mean = reduce(lambda a, b: a + b, cols) / len(cols)
    spread = F.sqrt(reduce(lambda a, b: a + b, [(c - mean) * (c - mean) for c in cols]) / len(cols))
    return z.withColumns({"z_consensus": reduce(lambda a, b: a + b, [c * (w / total) for c, w in zip(cols, weights.values(), strict=True)]), "z_disagreement": spread})


def pca(frames: DataFrame, columns: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(explained shares, loadings as columns) of the z columns' covariance; the largest loading of each is positive.

    Only the k * k covariances reach the driver. Fewer than three columns give zeros.
    """
    k = len(columns)
    if k < 3:
        return np.zeros(k), np.zeros((k, k))
    row = frames.agg(*(F.covar_samp(a, b).alias(f"{i}_{j}") for i, a in enumerate(columns) for j, b in enumerate(columns) if i <= j)).first()
    m = np.array([[row[f"{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)], float)
    return components(m)


def components(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Explained shares and loadings of a covariance matrix, by falling share."""
    k = len(m)
    values, vectors = np.linalg.eigh(m)
    values, vectors = values[::-1], vectors[:, ::-1]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(0), np.arange(k)])
    return values / values.sum(), vectors


def project(frames: DataFrame, columns: list[str], loadings: np.ndarray, **names: int) -> DataFrame:
    """Projections on the components given by name=number (from 0)."""
    return frames.withColumns({n: reduce(lambda a, b: a + b, [F.col(c) * float(loadings[i, k]) for i, c in enumerate(columns)]) for n, k in names.items()})


def override_degraded(frames: DataFrame, degraded: str = "degraded") -> DataFrame:
    """Degraded rows can't be ranked: consensus and composite are -inf, disagreement 0, the gate fails."""
    bad = F.col(degraded)
    return frames.withColumns({"composite_relevance": F.when(bad, LOW).otherwise(F.col("z_consensus")), "z_consensus": F.when(bad, LOW).otherwise(F.col("z_consensus")), "z_disagreement": F.when(bad, 0.0).otherwise(F.col("z_disagreement")), "technical_gate_pass": ~bad & F.col("technical_gate_pass")})


def bootstrap_thresholds(frames: DataFrame, score: str, shoot: str = "shoot_id", order: str = "global_index", mode: str = "seeded", n: int = 1000, seed: int = 42) -> DataFrame:
    """q1..q4 of each shoot's finite scores at config.QUANTILES: "seeded" resamples, "empirical" interpolates.

    A seeded shoot is resampled in one task, as its generator runs through its rows in order; "empirical" scales with rows.
    """
    finite = frames.where(F.col(score).isNotNull() & (F.abs(score) != float("inf")) & ~F.isnan(score))
    if mode == "empirical":
        return finite.groupBy(shoot).agg(F.percentile(score, list(config.QUANTILES)).alias("q")).select(shoot, *(F.col("q")[i].alias(f"q{i + 1}") for i in range(4)))

    def resample(part: pd.DataFrame) -> pd.DataFrame:
        x = part.sort_values(order)[score].to_numpy()
        rng = np.random.default_rng(seed)
        q = np.mean([np.quantile(rng.choice(x, len(x), replace=True), config.QUANTILES) for _ in range(n)], axis=0)
        return pd.DataFrame({shoot: [part[shoot].iloc[0]], **{f"q{i + 1}": [q[i]] for i in range(4)}})

    kind = dict(frames.dtypes)[shoot]
    return finite.select(shoot, order, score).groupBy(shoot).applyInPandas(resample, f"{shoot} {kind}, q1 double, q2 double, q3 double, q4 double")


def rate(frames: DataFrame, score: str, thresholds: DataFrame, shoot: str = "shoot_id") -> DataFrame:
    """star_rating 1..5; scores that aren't finite get 1; a shoot of equal scores gets 3."""
    finite = F.col(score).isNotNull() & (F.abs(score) != float("inf")) & ~F.isnan(score)
    span = frames.groupBy(shoot).agg((F.max(F.when(finite, F.col(score))) - F.min(F.when(finite, F.col(score)))).alias("_span"))
    s = F.col(score)
    stars = F.when(F.col("_span") < 1e-8, 3).when(~finite, 1).when(s >= F.col("q4"), 5).when(s >= F.col("q3"), 4).when(s >= F.col("q2"), 3).when(s >= F.col("q1"), 2).otherwise(1)
    return frames.join(thresholds, shoot, "left").join(span, shoot, "left").withColumn("star_rating", stars.cast("int")).drop("_span", "q1", "q2", "q3", "q4")


def z_by_camera(frames: DataFrame, column: str, degraded: str | None = None, camera: str = "camera_body") -> DataFrame:
    """z of a column within each camera, degraded rows left out of the statistics."""
    value = F.col(column) if degraded is None else F.when(~F.col(degraded), F.col(column))
    stats = frames.groupBy(F.col(camera).alias("_camera")).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    return frames.join(stats, F.col(camera).eqNullSafe(F.col("_camera"))).drop("_camera").withColumn(f"z_{column}", (F.col(column) - F.col("_m")) / F.when(F.col("_s") < 1e-8, 1.0).otherwise(F.col("_s"))).drop("_m", "_s")


def detect_categories(frames: DataFrame, vector: str = "embedding", key: str = "global_index", most: int = 5, threshold: float = 0.25, seed: int = 42, sample: int = 1000) -> DataFrame:
    """visual_category by k-means for the k of largest mean silhouette, -1 where it is under the threshold or rows are few."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    n = frames.count()
    if n < 10:
        return frames.withColumn("visual_category", F.lit(-1))
    data = cut(frames.withColumn("_features", array_to_vector(F.col(vector).cast("array<double>"))))
    best, chosen = -1.0, None
    for k in range(2, min(most, n - 1) + 1):
        labelled = KMeans(k=k, seed=seed, featuresCol="_features", predictionCol="visual_category").fit(data).transform(data)
        s = silhouette(labelled.orderBy(F.xxhash64(key), key).limit(sample), vector, "visual_category", key)
        if s > best:
            best, chosen = s, labelled
    if chosen is None or best < threshold:
        return frames.withColumn("visual_category", F.lit(-1))
    return chosen.drop("_features")


def silhouette(frames: DataFrame, vector: str, labels: str, key: str) -> float:
    """Mean Euclidean silhouette of a bounded sample (the caller's limit) with unique keys, by a self join."""
    rows = frames.select(F.col(key).alias("i"), F.col(vector).alias("v"), F.col(labels).alias("c"))
    other = rows.select(F.col("i").alias("j"), F.col("v").alias("w"), F.col("c").alias("d"))
    gap = F.sqrt(F.aggregate(F.zip_with("v", "w", lambda x, y: (x - y).cast("double") * (x - y)), F.lit(0.0), lambda a, x: a + x))
    means = rows.join(other, F.col("i") != F.col("j")).groupBy("i", "c", "d").agg(F.avg(gap).alias("m"))
    per = means.groupBy("i").agg(F.max(F.when(F.col("c") == F.col("d"), F.col("m"))).alias("a"), F.min(F.when(F.col("c") != F.col("d"), F.col("m"))).alias("b"))
    out = per.agg(F.avg(F.coalesce((F.col("b") - F.col("a")) / F.greatest("a", "b"), F.lit(0.0)))).first()[0]
    return float(out) if out is not None else -1.0


class PositiveUnlabeled:
    """Logistic regression on positives against the rest; the probability divided by the labelled share c, within 0..1.

    ``update`` adds rows to those seen so far and fits on all of them.
    """

    def __init__(self, features: list[str], label: str, c: float = 0.5, least: int = 50):
        self.features, self.label, self.c, self.least, self.model, self.n, self.seen = features, label, c, least, None, 0, None

    def update(self, rows: DataFrame) -> PositiveUnlabeled:
        from pyspark.ml.classification import LogisticRegression
        from pyspark.ml.feature import VectorAssembler

        new = rows.select(*self.features, F.col(self.label).cast("double").alias(self.label))
        self.seen = cut(new if self.seen is None else self.seen.unionByName(new))
        weighted = VectorAssembler(inputCols=self.features, outputCol="_x").transform(self.seen).withColumn("_w", F.when(F.col(self.label) == 1, 1 / self.c).otherwise(1.0))
        self.n = self.seen.where(F.col(self.label) == 1).count()
        self.model = LogisticRegression(featuresCol="_x", labelCol=self.label, weightCol="_w", maxIter=50).fit(weighted)
        return self

    def score(self, rows: DataFrame) -> DataFrame:
        from pyspark.ml.feature import VectorAssembler
        from pyspark.ml.functions import vector_to_array

        if self.model is None or self.n < self.least:
            return rows.withColumn("pu_score", F.lit(0.5))
        out = self.model.transform(VectorAssembler(inputCols=self.features, outputCol="_x").transform(rows))
        p = vector_to_array("probability")[1]
        return out.withColumn("pu_score", F.least(F.greatest(p / self.c, F.lit(0.0)), F.lit(1.0))).drop("_x", "rawPrediction", "probability", "prediction")

