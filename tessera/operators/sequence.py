"""Chronological order, gap and attribute sessionization, and calibration within bursts. One window for each shoot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera import config
from tessera.functions import scalar


def order_frames(frames: DataFrame, shoot: str = "shoot_id", time: str = "timestamp", tie: str = "path") -> DataFrame:
    """global_index from 0 by time, ties by path."""
    return frames.withColumn("global_index", F.row_number().over(Window.partitionBy(shoot).orderBy(time, tie)).cast("long") - 1)


def boundary_features(frames: DataFrame, shoot: str = "shoot_id") -> DataFrame:
    """dt, d_focal, orient_change, d_exposure and body_change against the previous frame (null for the first).

    Columns: global_index, timestamp, focal, orientation, ev and camera_body.
    """
    w = Window.partitionBy(shoot).orderBy("global_index")
    prev = lambda c: F.lag(c).over(w)
    first = prev("global_index").isNull()
    kept = lambda c: F.when(~first, c)
    text = lambda c: F.coalesce(c, F.lit(""))
    return frames.withColumns(
        {
            "dt": kept(F.abs(F.col("timestamp") - prev("timestamp"))),
            "d_focal": kept(scalar.relative_change(F.col("focal"), prev("focal"))),
            "orient_change": kept(text(F.col("orientation")) != text(prev("orientation"))),
            "d_exposure": kept(F.coalesce(F.abs(F.col("ev") - prev("ev")), F.lit(0.0))),
            "body_change": kept(text(F.col("camera_body")) != text(prev("camera_body"))),
        }
    )


def boundaries(burst_gap: float = config.BURST_GAP_S, scene_gap: float = config.SCENE_GAP_S, focal: float = config.FOCAL_CHANGE, exposure: float = config.EXPOSURE_CHANGE) -> tuple[Column, Column]:
    """(burst break, scene break); all comparisons strict, a scene breaks on time alone."""
    burst = (F.col("dt") > burst_gap) | (F.col("d_focal") > focal) | F.col("orient_change") | (F.col("d_exposure") > exposure) | F.col("body_change")
    return F.coalesce(burst, F.lit(False)), F.coalesce(F.col("dt") > scene_gap, F.lit(False))


def sessionize(frames: DataFrame, shoot: str = "shoot_id", **limits: float) -> DataFrame:
    """scene_id, burst_id (running from 0), frame_index and burst_length; a scene break also breaks the burst."""
    burst, scene = boundaries(**limits)
    flagged = boundary_features(frames, shoot).withColumns({"_b": (burst | scene).cast("long"), "_s": scene.cast("long")})
    running = Window.partitionBy(shoot).orderBy("global_index").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    named = flagged.withColumns({"scene_id": F.sum("_s").over(running), "burst_id": F.sum("_b").over(running)}).drop("_b", "_s")
    group = Window.partitionBy(shoot, "burst_id")
    return named.withColumns({"frame_index": F.row_number().over(group.orderBy("global_index")).cast("long") - 1, "burst_length": F.count("*").over(group)})


def calibrate_blinks(frames: DataFrame, *keys: str) -> DataFrame:
    """blink_detected of face rows from the burst's eye aspect ratios; other rows keep theirs."""
    w = Window.partitionBy(*(keys or ("shoot_id", "burst_id")))
    ear = F.when(F.col("has_face"), F.col("raw_min_ear"))
    n, top, own = F.count(ear).over(w), F.max(ear).over(w), F.col("raw_min_ear")
    absolute = (n == 1) | ((top < config.EAR_ALL_CLOSED_MAX) & (n <= config.EAR_SMALL_BURST))
    rule = F.when(absolute, own < config.EAR_ABSOLUTE).otherwise(own < config.EAR_RELATIVE * top)
    return frames.withColumn("blink_detected", F.when(F.col("has_face"), rule).otherwise(F.col("blink_detected")))


def harmonize(frames: DataFrame, *keys: str) -> DataFrame:
    """In bursts that mix face and other rows, face rows take the subject's sharpness; the originals stay in pre_*."""
    w = Window.partitionBy(*(keys or ("shoot_id", "burst_id")))
    valid = F.col("subject_det_method") != "error"
    n = F.sum(valid.cast("int")).over(w)
    share = F.avg(F.when(valid, (~F.col("has_face")).cast("double"))).over(w)
    hit = (n >= 2) & (share > config.MIXED_LOW) & (share < config.MIXED_HIGH) & F.col("has_face") & valid
    new = {"sharp_near_eye": F.col("sharpness_subject"), "sharp_far_eye": F.col("sharpness_subject"), "eye_ratio_raw": F.lit(0.0)}
    marked = frames.withColumn("_hit", F.coalesce(hit, F.lit(False)))
    return marked.withColumns({f"pre_{c}": F.when(F.col("_hit"), F.col(c)) for c in new}).withColumns({c: F.when(F.col("_hit"), v).otherwise(F.col(c)) for c, v in new.items()}).drop("_hit")


def aggregate_faces(faces: Column) -> Column:
    """near, far, min_ear, n_faces and largest of an array of (near, far, area, min_ear); the first largest face wins.

    Means are weighted by area; near leans by 0.4 to the least of the faces over a tenth of the largest area.
    """
    total = F.aggregate(faces, F.lit(0.0), lambda a, x: a + x.area)
    mean = lambda f: F.aggregate(faces, F.lit(0.0), lambda a, x: a + x[f] * x.area) / total
    top = F.array_max(F.transform(faces, lambda x: x.area))
    major = F.array_min(F.transform(F.filter(faces, lambda x: x.area > 0.10 * top), lambda x: x.near))
    return F.struct((0.6 * mean("near") + 0.4 * major).alias("near"), mean("far").alias("far"), F.array_min(F.transform(faces, lambda x: x.min_ear)).alias("min_ear"), F.size(faces).alias("n_faces"), F.get(F.filter(faces, lambda x: x.area == top), F.lit(0)).alias("largest"))


def content_profile(frames: DataFrame, *keys: str) -> DataFrame:
    """face_rate and profile of each scene."""
    out = frames.groupBy(*(keys or ("shoot_id", "scene_id"))).agg(F.avg(F.col("has_face").cast("int")).alias("face_rate"), F.count("*").alias("n"))
    return out.withColumn("profile", F.when(F.col("face_rate") > 0.5, "portrait").when(F.col("face_rate") > 0.2, "general").otherwise("landscape"))
