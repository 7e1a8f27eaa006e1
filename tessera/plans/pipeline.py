"""The whole selection pipeline as one plan: order, sessions, calibration, gate, consensus, clusters, picks and stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.session import cut
from tessera.operators import scoring, selection, sequence


def select_frames(frames: DataFrame, weights: dict[str, float], vectors: DataFrame | None = None, cluster: str | None = None, rating: str = "empirical", distance: float | None = None) -> DataFrame:
    """Frames with consensus, components, flags, label and stars; everything has the shoot as a key.

    ``frames`` has shoot_id, global_index, scene_id, the scorers of ``weights``, gate columns and ``degraded``. Clusters
    are the column ``cluster``, or average-linkage clusters of ``vectors`` (shoot_id, scene_id, global_index, embedding).
    The frames and their consensus are each computed once; all statistics read what was written.
    """
    scored = scoring.consensus(cut(frames), weights)
    if "technical_gate_pass" not in scored.columns:
        scored = scored.withColumn("technical_gate_pass", scoring.technical_gate())
    scored = cut(with_components(cut(scored), list(weights)))
    scored = scoring.override_degraded(scored)
    if vectors is not None:
        limit = {} if distance is None else {"cut": distance}
        found = selection.cluster_scenes(vectors, "global_index", ["shoot_id", "scene_id"], "embedding", **limit)
        ids = selection.global_cluster_ids(found, "scene_id").select("shoot_id", "global_index", "cluster_id")
        scored, cluster = cut(scored.join(ids, ["shoot_id", "global_index"])), "cluster_id"
    picked = selection.selection_floor(selection.pick(scored, cluster or "cluster_id"))
    labelled = cut(selection.with_label(picked))
    return scoring.rate(labelled, "composite_relevance", scoring.bootstrap_thresholds(labelled, "composite_relevance", mode=rating))


def with_components(frames: DataFrame, columns: list[str], shoot: str = "shoot_id") -> DataFrame:
    """pc2_aesthetic_vs_technical and pc3_structural of each shoot's z columns; one row of loadings a shoot is joined.

    The covariances of a shoot are one aggregate row; the driver doesn't see them.
    """
    k = len(columns)
    if k < 3:
        return frames.withColumns({"pc2_aesthetic_vs_technical": F.lit(0.0), "pc3_structural": F.lit(0.0)})
    z = [f"z_{c}" for c in columns]
    cells = F.array(*(F.covar_samp(z[min(i, j)], z[max(i, j)]) for i in range(k) for j in range(k)))

    @F.pandas_udf("array<array<double>>")
    def loadings(values):
        import numpy as np
        import pandas as pd

        out = []
        for v in values:
            m = np.array(v, float).reshape(k, k)
            out.append(scoring.components(m)[1].T[1:3].tolist() if np.isfinite(m).all() else [[0.0] * k] * 2)
        return pd.Series(out)

    axes = frames.groupBy(shoot).agg(cells.alias("_m")).select(shoot, loadings("_m").alias("_axes"))
    along = lambda n: sum((F.col(c) * F.col("_axes")[n][i] for i, c in enumerate(z)), F.lit(0.0))
    return frames.join(axes, shoot).withColumns({"pc2_aesthetic_vs_technical": along(0), "pc3_structural": along(1)}).drop("_axes")


def calibrated(frames: DataFrame, **limits: float) -> DataFrame:
    """Order, sessions, then mixed bursts, then blinks: the order matters. The gate follows from what they leave."""
    return sequence.calibrate_blinks(sequence.harmonize(sequence.sessionize(sequence.order_frames(frames), **limits)), "shoot_id", "burst_id")


def run_selection(frames: DataFrame, weights: dict[str, float], vectors: DataFrame | None = None, cluster: str | None = None, rating: str = "empirical", distance: float | None = None, **limits: float) -> DataFrame:
    """From listed frames with their features to stars. ``vectors`` has shoot_id, path and embedding."""
    ready = cut(calibrated(frames, **limits))
    if vectors is not None:
        vectors = ready.select("shoot_id", "path", "scene_id", "global_index").join(vectors, ["shoot_id", "path"]).drop("path")
    return select_frames(ready, weights, vectors, cluster, rating, distance)
