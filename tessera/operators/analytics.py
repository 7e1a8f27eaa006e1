"""Reports on scorers: distributions, correlations, overlaps, ranks, flips and labels."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.session import cut
from tessera.operators.selection import with_position


def distributions(frames: DataFrame, columns: list[str]) -> DataFrame:
    """mean, std (population), min and max of each column."""
    long = frames.unpivot([], columns, "scorer", "value")
    return long.groupBy("scorer").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))


def _pairs(frames: DataFrame, columns: list[str], of) -> DataFrame:
    """One row for each pair of columns from one aggregate over all of them."""
    pairs = list(combinations(columns, 2))
    wide = frames.agg(*(F.struct(*of(F.col(a), F.col(b))).alias(f"p{i}") for i, (a, b) in enumerate(pairs)))
    return wide.select(F.inline(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"p{i}").alias("v")) for i, (a, b) in enumerate(pairs))))).select("a", "b", "v.*")


def pearson(frames: DataFrame, columns: list[str], redundant: float = 0.90) -> DataFrame:
    out = _pairs(frames, columns, lambda x, y: [F.corr(x, y).alias("r")])
    return out.withColumns({"redundant": F.abs("r") > redundant, "verdict": F.when(F.abs("r") < 0.5, "orthogonal").otherwise("correlated")})


def rows_below(frames: DataFrame, column: str) -> DataFrame:
    """(value, n, below): rows of each distinct value of a column and rows under it; a null value has no place.

    Ranges of values are summed side by side; each range starts from the totals of those before it.
    """
    n = int(frames.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    values = frames.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    ranged = cut(values.repartitionByRange(n, "value").withColumn("part", F.spark_partition_id()))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    bases = ranged.groupBy("part").agg(F.sum("n").alias("t")).select("part", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    return ranged.join(F.broadcast(bases), "part").select("value", "n", (F.col("base") + F.coalesce(F.sum("n").over(inside), F.lit(0))).alias("below"))


def average_ranks(frames: DataFrame, columns: list[str]) -> DataFrame:
    """r_<column>: average rank of ties, ascending from 1 (null for null). Ranks come from counts by distinct value."""
    out = frames
    for c in columns:
        ranks = rows_below(frames, c).select(F.col("value").alias("_v"), (F.col("below") + (F.col("n") + 1) / 2).alias(f"r_{c}"))
        out = out.join(ranks, F.col(c) == F.col("_v"), "left").drop("_v")
    return out


def spearman(frames: DataFrame, columns: list[str]) -> DataFrame:
    return _pairs(average_ranks(frames, columns), [f"r_{c}" for c in columns], lambda x, y: [F.corr(x, y).alias("rho")]).withColumns({"a": F.substring("a", 3, 100), "b": F.substring("b", 3, 100)})


def differences(frames: DataFrame, columns: list[str]) -> DataFrame:
    """mean and std of each pair's difference, its largest size and how often it exceeds 0.3, 0.5 and 1."""

    def of(x, y):
        d = x - y
        return [F.avg(d).alias("mean"), F.stddev_pop(d).alias("std"), F.max(F.abs(d)).alias("largest"), *(F.count_if(F.abs(d) > t).alias(f"over_{str(t).replace('.', '')}") for t in (0.3, 0.5, 1.0))]

    return _pairs(frames, columns, of)


def gate_overlap(frames: DataFrame, a: str, low_a: float, b: str, low_b: float) -> DataFrame:
    x, y = F.col(a) < low_a, F.col(b) < low_b
    return frames.agg(F.count_if(x & y).alias("n_both"), F.count_if(x & ~y).alias("n_only_a"), F.count_if(~x & y).alias("n_only_b"))


def gate_redundancy(frames: DataFrame, gate: str, low: float, score: str, share: float = 0.1) -> DataFrame:
    """Gated rows and those of them within the lowest share by the other score."""
    cut = frames.agg(F.percentile(score, share).alias("_cut"))
    return frames.crossJoin(F.broadcast(cut)).agg(F.count_if(F.col(gate) < low).alias("gated"), F.count_if((F.col(gate) < low) & (F.col(score) <= F.col("_cut"))).alias("in_lowest"))


def by_star(frames: DataFrame, score: str = "z_consensus", stars: str = "star_rating") -> DataFrame:
    return frames.groupBy(stars).agg(F.count("*").alias("n"), F.avg(score).alias("mean"), F.stddev_pop(score).alias("std"), F.min(score).alias("min"), F.max(score).alias("max"))


def percentile_bins(frames: DataFrame, score: str, cuts: tuple[float, ...] = (0.05, 0.20, 0.50, 0.80)) -> DataFrame:
    """Rows by recommended star: how many of the percentile cuts a score reaches, from 1. The cuts are one row."""
    q = frames.agg(F.percentile(score, list(cuts)).alias("_q"))
    star = reduce(lambda a, b: a + b, ((F.col(score) >= F.col("_q")[i]).cast("int") for i in range(len(cuts))), F.lit(1))
    return frames.crossJoin(F.broadcast(q)).groupBy(star.alias("star")).agg(F.count("*").alias("n"))


def compare_stars(frames: DataFrame, score: str, stars: str = "star_rating") -> DataFrame:
    now = frames.groupBy(F.col(stars).cast("int").alias("star")).agg(F.count("*").alias("n_now"))
    new = percentile_bins(frames, score).withColumnRenamed("n", "n_recommended")
    return now.join(new, "star", "full").select("star", F.coalesce("n_now", F.lit(0)).alias("n_now"), F.coalesce("n_recommended", F.lit(0)).alias("n_recommended"))


def agreement(frames: DataFrame) -> DataFrame:
    return frames.agg(F.count_if(F.col("z_disagreement") < 0.3).alias("n_high"), F.count_if(F.col("z_disagreement") > 1.0).alias("n_controversial"), F.count("*").alias("n"))


def residuals(frames: DataFrame, a: str, b: str) -> DataFrame:
    d = F.col(a) - F.col(b)
    return frames.agg(F.avg(d).alias("mean"), F.stddev_pop(d).alias("std"), F.count_if(d > 0.5).alias("n_above"), F.count_if(d < -0.5).alias("n_below"))


def residual_extremes(frames: DataFrame, a: str, b: str, k: int = 5, key: str = "global_index") -> DataFrame:
    """The k rows of largest and of smallest difference: side (above, below), key, both values and the residual."""
    rows = frames.select(key, a, b, (F.col(a) - F.col(b)).alias("residual"))
    above, below = top_k(rows, "residual", k, key), top_k(rows, "residual", k, key, largest=False)
    return above.withColumn("side", F.lit("above")).unionByName(below.withColumn("side", F.lit("below")))


def category_counts(frames: DataFrame, shoot: str = "shoot_id") -> DataFrame:
    """Rows of each visual category of a shoot, and how many of them are degraded or failed the gate."""
    return frames.groupBy(shoot, "visual_category").agg(F.count("*").alias("n"), F.count_if("degraded").alias("n_degraded"), F.count_if(~F.col("technical_gate_pass")).alias("n_failed"))


def enriched(frames: DataFrame, columns: list[str], loadings, key: str = "global_index") -> DataFrame:
    """key, star_rating, places by the first column and by consensus and their shift, z values and up to three components."""
    from tessera.operators.scoring import project

    names = {f"PC{i + 1}": i for i in range(min(len(columns), 3))}
    rows = project(frames, [f"z_{c}" for c in columns], loadings, **names)
    rows = with_position(rows, f"{columns[0]}_rank", F.col(columns[0]).desc(), F.col(key))
    rows = with_position(rows, "consensus_rank", F.col("z_consensus").desc(), F.col(key))
    shift = (F.col("consensus_rank") - F.col(f"{columns[0]}_rank")).alias("rank_shift")
    return rows.select(key, "star_rating", f"{columns[0]}_rank", "consensus_rank", shift, "z_consensus", "z_disagreement", *names, *(f"z_{c}" for c in columns))


def label_counts(frames: DataFrame) -> DataFrame:
    return frames.agg(*(F.count_if(F.col("label") == c).alias(f"n_{c.lower()}") for c in ("Red", "Purple", "Green")), F.count_if(F.col("label") == "").alias("n_none"))


def strict_percentile(frames: DataFrame, score: str) -> DataFrame:
    """percentile: share of all rows strictly below, times 100 (null for null); counted on distinct values."""
    total = frames.agg(F.count("*").alias("_total"))
    ranked = rows_below(frames, score).crossJoin(F.broadcast(total)).select(F.col("value").alias("_v"), (F.col("below") / F.col("_total") * 100).alias("percentile"))
    return frames.join(ranked, F.col(score) == F.col("_v"), "left").drop("_v")


def rank_flips(frames: DataFrame, a: str, b: str, scene: str = "scene_id", key: str = "global_index") -> DataFrame:
    """Pairs of a scene and how many of them the two scores order differently."""
    left = frames.select(scene, F.col(key).alias("_i"), F.col(a).alias("_a1"), F.col(b).alias("_b1"))
    right = frames.select(scene, F.col(key).alias("_j"), F.col(a).alias("_a2"), F.col(b).alias("_b2"))
    pairs = left.join(right, scene).where("_i < _j")
    flip = (F.col("_a1") - F.col("_a2")) * (F.col("_b1") - F.col("_b2")) < 0
    return pairs.agg(F.count("*").alias("n_pairs"), F.count_if(flip).alias("n_flips"))


def rank_shift(frames: DataFrame, a: str, b: str, key: str = "global_index", share: float = 0.10, top: int = 10) -> DataFrame:
    """The rows whose ranks by two scores differ most, over a share of all rows."""
    by_a = with_position(frames.select(key, a, b), "rank_a", F.col(a).desc(), F.col(key))
    ranked = with_position(by_a, "rank_b", F.col(b).desc(), F.col(key)).crossJoin(F.broadcast(frames.agg(F.count("*").alias("_n"))))
    moved = ranked.withColumn("shift", F.abs(F.col("rank_a") - F.col("rank_b"))).where(F.col("shift") > share * F.col("_n"))
    return moved.select(key, "rank_a", "rank_b", "shift").orderBy(F.col("shift").desc(), key).limit(top)


def top_k(frames: DataFrame, score: str, k: int, key: str = "global_index", largest: bool = True) -> DataFrame:
    order = F.col(score).desc() if largest else F.col(score).asc()
    return frames.orderBy(order, key).limit(k)


def batch_verdict(frames: DataFrame, a: str, b: str) -> DataFrame:
    """Spearman's rho of two runs and what it says: adopt over 0.98, borderline over 0.95, else keep."""
    rho = spearman(frames, [a, b])
    return rho.select("rho", F.when(F.col("rho") > 0.98, "adopt").when(F.col("rho") > 0.95, "borderline").otherwise("keep").alias("verdict"))
