"""Queries over the star-schema tables: each applies an operator to an adapter view; most have an oracle in SQL.

Adapter views are SQL text that both engines run. Doubles are compared after ``r6``, a rounding that both define alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import scalar
from tessera.functions.session import cut, reachable
from tessera.operators import analytics, scoring, selection, sequence
from tessera.plans.pipeline import run_selection, select_frames
from tessera.sources import readers, sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def r6(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.floor(c * 1e6 + 0.5) / 1e6


def s6(x: str, name: str | None = None) -> str:
    return f"floor(({x}) * 1e6 + 0.5) / 1e6 AS {name or x}"


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return reachable(spark).read.parquet(f"{sf}/{name}.parquet")


#: One row for each part: four averages as scorers, from integer sums so that both engines divide the same numbers.
_MEAN = "CAST(sum(CAST(round({c} * 100) AS BIGINT)) AS DOUBLE) / CAST(100 * count(*) AS DOUBLE)"
SCORES_SQL = f"""
SELECT p_partkey AS global_index, p_brand AS scene_id, concat(p_brand, '/', p_type) AS cluster_id, p_type AS camera_body,
       p_name AS filename, p_size % 3 > 0 AS has_face, p_size = 7 AS blink_detected, p_size = 9 AS degraded,
       {_MEAN.format(c="l_quantity")} AS deqa_score, {_MEAN.format(c="l_extendedprice")} AS qalign_score,
       {_MEAN.format(c="l_discount")} AS qualiclip_score, {_MEAN.format(c="l_tax")} AS musiq_score
FROM {{lineitem}} JOIN {{part}} ON l_partkey = p_partkey GROUP BY p_partkey, p_brand, p_type, p_name, p_size"""
WEIGHTS = {"deqa_score": 4.0, "qalign_score": 4.0, "qualiclip_score": 1.0, "musiq_score": 2.0}
COLS = list(WEIGHTS)


def scores(spark: SparkSession, sf: str) -> DataFrame:
    return cut(spark.sql(SCORES_SQL, lineitem=_table(spark, sf, "lineitem"), part=_table(spark, sf, "part")).withColumn("shoot_id", F.lit(1)))


def gated(spark: SparkSession, sf: str) -> DataFrame:
    return scores(spark, sf).withColumn("technical_gate_pass", F.col("musiq_score") >= 0.035)


A = "WITH a AS (" + SCORES_SQL.format(lineitem="lineitem", part="part") + ")"
_STD = "CASE WHEN stddev_pop({c}) OVER () < 1e-8 THEN 1.0 ELSE stddev_pop({c}) OVER () END"
_TAX_GATE = "musiq_score >= 0.035"
Z = A + ", z AS (SELECT *, " + ", ".join(f"({c} - avg({c}) OVER ()) / ({_STD.format(c=c)}) AS z_{c}" for c in COLS) + f", {_TAX_GATE} AS gate FROM a), c AS (SELECT *, (4*z_deqa_score + 4*z_qalign_score + z_qualiclip_score + 2*z_musiq_score)/11 AS z_consensus, (z_deqa_score+z_qalign_score+z_qualiclip_score+z_musiq_score)/4 AS m FROM z), k AS (SELECT *, sqrt((" + " + ".join(f"(z_{c}-m)*(z_{c}-m)" for c in COLS) + ")/4) AS z_disagreement FROM c)"
#: Composite for ranking, rounded so that both engines break ties alike.
PICKS = Z + """, q AS (SELECT global_index, scene_id, cluster_id, filename, qualiclip_score, z_consensus, floor(z_consensus*1e6+0.5)/1e6 AS comp, gate FROM k),
r AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY gate DESC, comp DESC, global_index) AS f,
  row_number() OVER (PARTITION BY cluster_id ORDER BY gate DESC, qualiclip_score DESC, global_index) AS s,
  sum(gate::INT) OVER (PARTITION BY cluster_id) AS passing FROM q),
t AS (SELECT *, s = 1 AND passing >= 2 AND f <> 1 AS alt FROM r),
u AS (SELECT *, f = 1 OR alt AS selected0, f = 1 AND NOT bool_or(alt) OVER (PARTITION BY cluster_id) AS agree FROM t),
v AS (SELECT *, greatest(3, ceil(0.02 * count(*) OVER ())) - sum(selected0::INT) OVER () AS need,
  row_number() OVER (PARTITION BY NOT selected0 AND gate ORDER BY comp DESC, global_index) AS rk FROM u),
w AS (SELECT *, selected0 OR (gate AND rk <= need) AS selected FROM v),
l AS (SELECT *, CASE WHEN selected AND alt THEN 'Purple' WHEN selected THEN 'Red' WHEN NOT gate THEN 'Green' ELSE '' END AS label FROM w)"""
STARS = PICKS + """, th AS (SELECT quantile_cont(comp, [0.0228, 0.1587, 0.5, 0.8413]) AS q FROM l),
x AS (SELECT l.*, CASE WHEN comp >= q[4] THEN 5 WHEN comp >= q[3] THEN 4 WHEN comp >= q[2] THEN 3 WHEN comp >= q[1] THEN 2 ELSE 1 END AS star_rating FROM l, th)"""


def consensus_frames(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.consensus(gated(spark, sf), WEIGHTS)


def picked_frames(spark: SparkSession, sf: str) -> DataFrame:
    frames = cut(consensus_frames(spark, sf).withColumn("composite_relevance", r6("z_consensus")))
    return cut(selection.with_label(selection.selection_floor(cut(selection.pick(frames)))))


def starred_frames(spark: SparkSession, sf: str) -> DataFrame:
    frames = picked_frames(spark, sf)
    return scoring.rate(frames, "composite_relevance", scoring.bootstrap_thresholds(frames, "composite_relevance", mode="empirical"))


@query(STARS + " SELECT global_index, cluster_id, selected, label, star_rating FROM x")
def selection_pipeline(spark, sf):
    """REL-2 to REL-8, STAT-2 to STAT-4: consensus, picks, floor, labels and stars."""
    return starred_frames(spark, sf).select("global_index", "cluster_id", "selected", "label", "star_rating")


@query()
def selection_pipeline_seeded(spark, sf):
    """EXE-9 with seeded bootstrap ratings and the degraded override."""
    return select_frames(gated(spark, sf), WEIGHTS, cluster="cluster_id", rating="seeded").select("global_index", "selected", "label", "star_rating", "composite_relevance")


@query(Z + f" SELECT global_index, {', '.join(s6('z_' + c) for c in COLS)}, {s6('z_consensus')}, {s6('z_disagreement')} FROM k")
def consensus(spark, sf):
    return consensus_frames(spark, sf).select("global_index", *(r6(f"z_{c}").alias(f"z_{c}") for c in COLS), r6("z_consensus").alias("z_consensus"), r6("z_disagreement").alias("z_disagreement"))


@query(Z + " SELECT global_index, NOT degraded AND gate AS technical_gate_pass, CASE WHEN degraded THEN -1e9 ELSE floor(z_consensus*1e6+0.5)/1e6 END AS composite, CASE WHEN degraded THEN 0 ELSE floor(z_disagreement*1e6+0.5)/1e6 END AS z_disagreement FROM k")
def degraded_override(spark, sf):
    f = scoring.override_degraded(consensus_frames(spark, sf))
    return f.select("global_index", "technical_gate_pass", F.when(F.col("composite_relevance") == float("-inf"), -1e9).otherwise(r6("composite_relevance")).alias("composite"), r6("z_disagreement").alias("z_disagreement"))


@query(A + ", g AS (SELECT *, qualiclip_score * 10 AS topiq, musiq_score * 1000 AS musiq, CASE WHEN has_face THEN deqa_score * 2 ELSE deqa_score END AS sharp FROM a) SELECT global_index, NOT blink_detected AND ((topiq > 0 AND topiq < 0.35)::INT + (musiq > 0 AND musiq < 30)::INT + (sharp > 0 AND sharp < 50)::INT) < CASE WHEN (topiq > 0)::INT + (musiq > 0)::INT + (sharp > 0)::INT >= 2 THEN 2 ELSE 1 END AS technical_gate_pass FROM g")
def technical_gate(spark, sf):
    f = scores(spark, sf).withColumns({"topiq_score": F.col("qualiclip_score") * 10, "musiq_score": F.col("musiq_score") * 1000, "sharp_near_eye": F.col("deqa_score") * 2, "sharpness_subject": F.col("deqa_score")})
    return f.select("global_index", scoring.technical_gate().alias("technical_gate_pass"))


@query(A + " SELECT name FROM (SELECT unnest(['deqa_score','qalign_score','qualiclip_score','musiq_score']) AS name)")
def active_scorers(spark, sf):
    """REL-10, STAT-1, SRC-6: scorers with any value; a column of zeros is left out."""
    names = scoring.active_columns(scores(spark, sf).withColumn("zero_score", F.lit(0.0)), [*COLS, "zero_score"])
    return spark.createDataFrame([(n,) for n in names], "name string")


@query(A + ", " + ", ".join(f"d{i} AS (SELECT '{c}' AS scorer, {s6(f'avg({c})', 'mean')}, {s6(f'stddev_pop({c})', 'std')}, {s6(f'min({c})', 'min')}, {s6(f'max({c})', 'max')} FROM a)" for i, c in enumerate(COLS)) + " SELECT * FROM d0 UNION ALL SELECT * FROM d1 UNION ALL SELECT * FROM d2 UNION ALL SELECT * FROM d3")
def scorer_distributions(spark, sf):
    return analytics.distributions(scores(spark, sf), COLS).select("scorer", *(r6(c).alias(c) for c in ("mean", "std", "min", "max")))


def _pair_sql(body: str) -> str:
    return " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {body.format(x=a, y=b)}" for i, a in enumerate(COLS) for b in COLS[i + 1 :])


@query(A + " SELECT a, b, floor(r*1e6+0.5)/1e6 AS r, abs(r) > 0.9 AS redundant, CASE WHEN abs(r) < 0.5 THEN 'orthogonal' ELSE 'correlated' END AS verdict FROM (" + _pair_sql("corr({x}, {y}) AS r FROM a") + ")")
def scorer_pearson(spark, sf):
    return analytics.pearson(scores(spark, sf), COLS).withColumn("r", r6("r"))


@query(A + ", ar AS (SELECT " + ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}" for c in COLS) + " FROM a) SELECT a, b, floor(r*1e6+0.5)/1e6 AS rho FROM (" + _pair_sql("corr({x}, {y}) AS r FROM ar") + ")")
def scorer_spearman(spark, sf):
    return analytics.spearman(scores(spark, sf), COLS).withColumn("rho", r6("rho"))


@query(Z + " SELECT a, b, floor(mean*1e6+0.5)/1e6 AS mean, floor(std*1e6+0.5)/1e6 AS std, floor(largest*1e6+0.5)/1e6 AS largest, over_03, over_05, over_10 FROM (" + " UNION ALL ".join(f"SELECT 'z_{a}' AS a, 'z_{b}' AS b, avg(z_{a} - z_{b}) AS mean, stddev_pop(z_{a} - z_{b}) AS std, max(abs(z_{a} - z_{b})) AS largest, count(*) FILTER (abs(z_{a} - z_{b}) > 0.3) AS over_03, count(*) FILTER (abs(z_{a} - z_{b}) > 0.5) AS over_05, count(*) FILTER (abs(z_{a} - z_{b}) > 1.0) AS over_10 FROM z" for i, a in enumerate(COLS) for b in COLS[i + 1 :]) + ")")
def scorer_differences(spark, sf):
    return analytics.differences(scoring.z_columns(scores(spark, sf), COLS), [f"z_{c}" for c in COLS]).withColumns({c: r6(c) for c in ("mean", "std", "largest")})


@query(A + " SELECT count(*) FILTER (qualiclip_score < 0.045 AND musiq_score < 0.035) AS n_both, count(*) FILTER (qualiclip_score < 0.045 AND NOT musiq_score < 0.035) AS n_only_a, count(*) FILTER (NOT qualiclip_score < 0.045 AND musiq_score < 0.035) AS n_only_b FROM a")
def gate_overlap(spark, sf):
    return analytics.gate_overlap(scores(spark, sf), "qualiclip_score", 0.045, "musiq_score", 0.035)


@query(A + " SELECT count(*) FILTER (musiq_score < 0.03) AS gated, count(*) FILTER (musiq_score < 0.03 AND deqa_score <= (SELECT quantile_cont(deqa_score, 0.1) FROM a)) AS in_lowest FROM a")
def gate_redundancy(spark, sf):
    return analytics.gate_redundancy(scores(spark, sf), "musiq_score", 0.03, "deqa_score")


@query(STARS + f" SELECT star_rating, count(*) AS n, {s6('avg(comp)', 'mean')}, {s6('stddev_pop(comp)', 'std')}, {s6('min(comp)', 'min')}, {s6('max(comp)', 'max')} FROM x GROUP BY star_rating")
def consensus_by_star(spark, sf):
    return analytics.by_star(starred_frames(spark, sf), "composite_relevance").withColumns({c: r6(c) for c in ("mean", "std", "min", "max")})


@query(STARS + ", y AS (SELECT 1 + (comp >= q[1])::INT + (comp >= q[2])::INT + (comp >= q[3])::INT + (comp >= q[4])::INT AS star FROM l, (SELECT quantile_cont(comp, [0.05, 0.2, 0.5, 0.8]) AS q FROM l)), n AS (SELECT star, count(*) AS n_recommended FROM y GROUP BY 1), o AS (SELECT star_rating AS star, count(*) AS n_now FROM x GROUP BY 1) SELECT star, coalesce(n_now, 0) AS n_now, coalesce(n_recommended, 0) AS n_recommended FROM o FULL JOIN n USING (star)")
def recommended_stars(spark, sf):
    return analytics.compare_stars(starred_frames(spark, sf), "composite_relevance")


@query(Z + " SELECT count(*) FILTER (z_disagreement < 0.3) AS n_high, count(*) FILTER (z_disagreement > 1.0) AS n_controversial, count(*) AS n FROM k")
def agreement_counts(spark, sf):
    return analytics.agreement(consensus_frames(spark, sf))


@query(Z + f" SELECT {s6('avg(z_qalign_score - z_deqa_score)', 'mean')}, {s6('stddev_pop(z_qalign_score - z_deqa_score)', 'std')}, count(*) FILTER (z_qalign_score - z_deqa_score > 0.5) AS n_above, count(*) FILTER (z_qalign_score - z_deqa_score < -0.5) AS n_below FROM z")
def residuals(spark, sf):
    return analytics.residuals(scoring.z_columns(scores(spark, sf), COLS), "z_qalign_score", "z_deqa_score").withColumns({"mean": r6("mean"), "std": r6("std")})


@query(PICKS + " SELECT count(*) FILTER (label = 'Red') AS n_red, count(*) FILTER (label = 'Purple') AS n_purple, count(*) FILTER (label = 'Green') AS n_green, count(*) FILTER (label = '') AS n_none FROM l")
def label_counts(spark, sf):
    return analytics.label_counts(picked_frames(spark, sf))


@query(A + f" SELECT global_index, {s6('(rank() OVER (ORDER BY deqa_score) - 1) * 100.0 / count(*) OVER ()', 'percentile')} FROM a")
def strict_percentile(spark, sf):
    return analytics.strict_percentile(scores(spark, sf), "deqa_score").select("global_index", r6("percentile").alias("percentile"))


@query(A + " SELECT global_index, row_number() OVER (ORDER BY deqa_score DESC, global_index) - 1 AS position FROM a")
def ordinal_rank(spark, sf):
    return selection.with_position(scores(spark, sf).select("global_index", "deqa_score"), "position", F.col("deqa_score").desc(), F.col("global_index")).select("global_index", "position")


@query(A + " SELECT count(*) AS n_pairs, count(*) FILTER ((x.deqa_score - y.deqa_score) * (x.qalign_score - y.qalign_score) < 0) AS n_flips FROM a x JOIN a y USING (scene_id) WHERE x.global_index < y.global_index")
def rank_flips(spark, sf):
    return analytics.rank_flips(scores(spark, sf), "deqa_score", "qalign_score")


@query(A + ", rk AS (SELECT global_index, row_number() OVER (ORDER BY deqa_score DESC, global_index) - 1 AS rank_a, row_number() OVER (ORDER BY musiq_score DESC, global_index) - 1 AS rank_b, count(*) OVER () AS n FROM a) SELECT global_index, rank_a, rank_b, abs(rank_a - rank_b) AS shift FROM rk WHERE abs(rank_a - rank_b) > 0.1 * n ORDER BY shift DESC, global_index LIMIT 10")
def rank_shift(spark, sf):
    return analytics.rank_shift(scores(spark, sf), "deqa_score", "musiq_score")


@query(Z + f" SELECT global_index, {s6('z_disagreement')} FROM k ORDER BY floor(k.z_disagreement*1e6+0.5) DESC, global_index LIMIT 10")
def most_controversial(spark, sf):
    return analytics.top_k(consensus_frames(spark, sf).select("global_index", r6("z_disagreement").alias("z_disagreement")), "z_disagreement", 10)


@query(A + ", ar AS (SELECT rank() OVER (ORDER BY deqa_score) + (count(*) OVER (PARTITION BY deqa_score) - 1) / 2.0 AS x, rank() OVER (ORDER BY qalign_score) + (count(*) OVER (PARTITION BY qalign_score) - 1) / 2.0 AS y FROM a), c AS (SELECT corr(x, y) AS r FROM ar) SELECT floor(r*1e6+0.5)/1e6 AS rho, CASE WHEN r > 0.98 THEN 'adopt' WHEN r > 0.95 THEN 'borderline' ELSE 'keep' END AS verdict FROM c")
def batch_verdict(spark, sf):
    return analytics.batch_verdict(scores(spark, sf), "deqa_score", "qalign_score").withColumn("rho", r6("rho"))


_CELLS = " UNION ALL ".join(f"SELECT {i} AS i, {j} AS j, covar_samp(z_{a}, z_{b}) AS c FROM z" for i, a in enumerate(COLS) for j, b in enumerate(COLS))


@query(Z + f", m AS ({_CELLS}), m2 AS (SELECT x.i, y.j, sum(x.c * y.c) AS c FROM m x JOIN m y ON x.j = y.i GROUP BY x.i, y.j) SELECT round((SELECT sum(c) FROM m WHERE i = j), 4) AS sum_1, round((SELECT sum(c) FROM m2 WHERE i = j), 4) AS sum_2, round((SELECT sum(x.c * y.c) FROM m2 x JOIN m y ON x.i = y.j AND x.j = y.i), 4) AS sum_3, round((SELECT sum(c * c) FROM m2), 4) AS sum_4, 0.0::DOUBLE AS largest_covariance, true AS falling")
def principal_components(spark, sf):
    """STAT-5: the components' variances have the power sums of the covariance's eigenvalues, and don't covary."""
    z = cut(scoring.z_columns(scores(spark, sf), COLS))
    names = [f"z_{c}" for c in COLS]
    shares, loadings = scoring.pca(z, names)
    pcs = [f"pc{i}" for i in range(len(COLS))]
    p = scoring.project(z, names, loadings, **{c: i for i, c in enumerate(pcs)})
    powers = [F.round(sum((F.pow(F.var_samp(c), F.lit(float(k))) for c in pcs), F.lit(0.0)), 4).alias(f"sum_{k}") for k in range(1, 5)]
    off = [F.abs(F.covar_samp(a, b)) for i, a in enumerate(pcs) for b in pcs[i + 1 :]]
    falling = F.lit(bool(all(shares[:-1] >= shares[1:]))) & (F.var_samp(pcs[0]) >= F.var_samp(pcs[-1]))
    return p.agg(*powers, F.round(F.greatest(*off), 6).alias("largest_covariance"), falling.alias("falling"))


@query(Z + PICKS[len(Z) :].replace("cluster_id", "camera_body") + " SELECT global_index, selected, label, selected AND NOT selected0 AS padded FROM l")
def padded_selection(spark, sf):
    """REL-6 where a few large clusters leave the selection under its floor."""
    frames = cut(consensus_frames(spark, sf).withColumn("composite_relevance", r6("z_consensus")))
    picked = cut(selection.pick(frames, "camera_body").withColumn("selected0", F.col("selected")))
    return selection.with_label(selection.selection_floor(picked)).select("global_index", "selected", "label", (F.col("selected") & ~F.col("selected0")).alias("padded"))


@query(A + f", s AS (SELECT camera_body, avg(deqa_score) FILTER (NOT degraded) AS m, stddev_pop(deqa_score) FILTER (NOT degraded) AS sd FROM a GROUP BY 1) SELECT global_index, {s6('(deqa_score - m) / CASE WHEN sd < 1e-8 THEN 1 ELSE sd END', 'z')} FROM a JOIN s USING (camera_body)")
def z_by_camera(spark, sf):
    return scoring.z_by_camera(scores(spark, sf), "deqa_score", "degraded").select("global_index", r6("z_deqa_score").alias("z"))


@query(A + ", r AS (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY deqa_score DESC, global_index) AS k, count(*) OVER (PARTITION BY scene_id) AS n FROM a) SELECT global_index FROM r WHERE k <= greatest(1, floor(n * 0.1))")
def reduce_bursts(spark, sf):
    return selection.reduce_bursts(scores(spark, sf), "scene_id", "deqa_score").select("global_index")


@query(STARS + ", g AS (SELECT *, count(*) OVER (PARTITION BY cluster_id) AS n_rows, row_number() OVER (PARTITION BY cluster_id ORDER BY CASE WHEN label = 'Red' THEN 0 WHEN selected THEN 1 ELSE 2 END, star_rating DESC, global_index) AS k FROM x) SELECT cluster_id, global_index AS leader, n_rows FROM g WHERE n_rows >= 2 AND k = 1")
def group_leaders(spark, sf):
    f = starred_frames(spark, sf)
    names = f.select("cluster_id").distinct().withColumn("_k", F.xxhash64("cluster_id").bitwiseAND(F.lit(2**62 - 1)))
    return selection.group_leaders(f.join(names, "cluster_id"), "_k").join(names, "_k").select("cluster_id", "leader", "n_rows")


@query(STARS + " SELECT star_rating, count(*) AS n FROM x GROUP BY 1")
def star_counts(spark, sf):
    return sinks.star_counts(starred_frames(spark, sf))


@query(STARS + ", u2 AS (SELECT global_index, filename, star_rating, label, 'comp' AS scorer, comp AS value FROM x UNION ALL SELECT global_index, filename, star_rating, label, 'qualiclip_score', qualiclip_score FROM x), rr AS (SELECT *, row_number() OVER (PARTITION BY scorer ORDER BY value DESC, global_index) AS rank FROM u2) SELECT scorer, global_index, rank, printf('%03d', rank) || '_' || repeat('★', star_rating) || repeat('☆', 5 - star_rating) || CASE label WHEN 'Red' THEN '_R' WHEN 'Purple' THEN '_P' WHEN 'Green' THEN '_G' ELSE '' END || '_' || filename AS link FROM rr")
def ranked_listing(spark, sf):
    return sinks.ranked_listing(starred_frames(spark, sf).withColumn("comp", F.col("composite_relevance")), ["comp", "qualiclip_score"])


@query()
def feature_table(spark, sf):
    return sinks.feature_rows(starred_frames(spark, sf).drop("scene_id", "cluster_id").withColumn("dpp_selected", F.col("selected")))


@query()
def sidecar_tags(spark, sf):
    t = sinks.sidecar_tags(starred_frames(spark, sf).withColumn("path", F.concat(F.lit("/x/"), "filename", F.lit(".cr3"))))
    return t.select("path", "sidecar", F.array_join(F.transform(F.array_sort(F.map_entries("tags")), lambda e: F.concat(e.key, F.lit("="), e.value)), ";").alias("tags"))


# Sessions and calibration on the event stream --------------------------------------------------------------------

EVENTS_SQL = "SELECT user_id AS shoot_id, event_id, CAST(event_id AS {text}) AS path, {epoch} AS timestamp, value AS focal, event_type AS orientation, {ev} AS ev, 'b' AS camera_body FROM {events}"
E_DUCK = "WITH e AS (SELECT user_id AS shoot_id, event_id, epoch_us(ts) / 1e6 AS timestamp, value AS focal, event_type AS orientation, ln(value + 1) / ln(2) AS ev FROM events), o AS (SELECT *, row_number() OVER (PARTITION BY shoot_id ORDER BY timestamp, event_id::VARCHAR) - 1 AS global_index FROM e), l AS (SELECT *, timestamp - lag(timestamp) OVER w AS dt, CASE WHEN lag(focal) OVER w IS NULL THEN NULL WHEN lag(focal) OVER w > 0 THEN abs(focal - lag(focal) OVER w) / (lag(focal) OVER w + 1e-8) ELSE 0 END AS df, orientation <> lag(orientation) OVER w AS oc, abs(ev - lag(ev) OVER w) AS de FROM o WINDOW w AS (PARTITION BY shoot_id ORDER BY global_index))"
S_DUCK = E_DUCK + ", b AS (SELECT *, coalesce(dt > 86400, false) AS s, coalesce(dt > 21600 OR df > 3 OR de > 1.5, false) AS bb FROM l), i AS (SELECT *, sum(s::INT) OVER w AS scene_id, sum((s OR bb)::INT) OVER w AS burst_id FROM b WINDOW w AS (PARTITION BY shoot_id ORDER BY global_index ROWS UNBOUNDED PRECEDING))"


def event_frames(spark: SparkSession, sf: str) -> DataFrame:
    e = _table(spark, sf, "events")
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return sequence.order_frames(e.select(F.col("user_id").alias("shoot_id"), "event_id", F.col("event_id").cast("string").alias("path"), seconds.alias("timestamp"), F.col("value").alias("focal"), F.col("event_type").alias("orientation"), (F.ln(F.col("value") + 1) / F.ln(F.lit(2.0))).alias("ev"), F.lit("b").alias("camera_body")))


@query(S_DUCK + " SELECT event_id, global_index, scene_id::BIGINT AS scene_id, burst_id::BIGINT AS burst_id, row_number() OVER (PARTITION BY shoot_id, burst_id ORDER BY global_index) - 1 AS frame_index, count(*) OVER (PARTITION BY shoot_id, burst_id) AS burst_length FROM i")
def sessionize(spark, sf):
    """WIN-1 to WIN-4 with time, relative and exposure conditions."""
    f = event_frames(spark, sf).withColumn("orientation", F.lit(""))
    return sequence.sessionize(f, burst_gap=21600, scene_gap=86400, focal=3, exposure=1.5).select("event_id", "global_index", "scene_id", "burst_id", "frame_index", "burst_length")


@query(E_DUCK + f" SELECT event_id, {s6('dt')}, {s6('df', 'd_focal')}, oc AS orient_change, {s6('de', 'd_exposure')} FROM l")
def boundary_features(spark, sf):
    return sequence.boundary_features(event_frames(spark, sf)).select("event_id", r6("dt").alias("dt"), r6("d_focal").alias("d_focal"), "orient_change", r6("d_exposure").alias("d_exposure"))


@query(S_DUCK + " SELECT count(DISTINCT (shoot_id, scene_id)) AS n_scenes, count(DISTINCT (shoot_id, burst_id)) AS n_bursts FROM i")
def session_counts(spark, sf):
    f = sequence.sessionize(event_frames(spark, sf).withColumn("orientation", F.lit("")), burst_gap=21600, scene_gap=86400, focal=3, exposure=1.5)
    return f.agg(F.count_distinct("shoot_id", "scene_id").alias("n_scenes"), F.count_distinct("shoot_id", "burst_id").alias("n_bursts"))


def burst_frames(spark: SparkSession, sf: str) -> DataFrame:
    e = _table(spark, sf, "events")
    return e.select("event_id", F.col("user_id").alias("burst_id"), (F.col("event_type") != "error").alias("has_face"), (F.col("value") / 300).alias("raw_min_ear"), F.lit(False).alias("blink_detected"), F.col("value").alias("sharp_near_eye"), (F.col("value") * 2).alias("sharp_far_eye"), (F.col("value") * 3).alias("sharpness_subject"), F.lit(1.0).alias("eye_ratio_raw"), F.when(F.col("event_type") == "view", "error").otherwise("face_mesh").alias("subject_det_method"), F.to_date("ts").alias("scene_id"))


@query("WITH b AS (SELECT event_id, user_id, event_type <> 'error' AS f, value / 300 AS ear FROM events), c AS (SELECT *, count(*) FILTER (f) OVER w AS n, max(ear) FILTER (f) OVER w AS m FROM b WINDOW w AS (PARTITION BY user_id)) SELECT event_id, CASE WHEN NOT f THEN false WHEN n = 1 OR (m < 0.2 AND n <= 3) THEN ear < 0.12 ELSE ear < 0.5 * m END AS blink_detected FROM c")
def blink_calibration(spark, sf):
    return sequence.calibrate_blinks(burst_frames(spark, sf), "burst_id").select("event_id", "blink_detected")


@query("WITH b AS (SELECT event_id, user_id, value, event_type <> 'error' AS f, event_type <> 'view' AS ok FROM events), c AS (SELECT *, sum(ok::INT) OVER w AS n, avg(CASE WHEN ok THEN (NOT f)::INT END) OVER w AS share FROM b WINDOW w AS (PARTITION BY user_id)) SELECT event_id, CASE WHEN n >= 2 AND share > 0.2 AND share < 0.8 AND f AND ok THEN value * 3 ELSE value END AS sharp_near_eye, CASE WHEN n >= 2 AND share > 0.2 AND share < 0.8 AND f AND ok THEN 0 ELSE 1 END::DOUBLE AS eye_ratio_raw FROM c")
def harmonize(spark, sf):
    return sequence.harmonize(burst_frames(spark, sf), "burst_id").select("event_id", "sharp_near_eye", "eye_ratio_raw")


@query("WITH p AS (SELECT ts::DATE AS scene_id, avg((event_type <> 'error')::INT) AS r, count(*) AS n FROM events GROUP BY 1) SELECT scene_id::VARCHAR AS scene_id, floor(r*1e6+0.5)/1e6 AS face_rate, n, CASE WHEN r > 0.5 THEN 'portrait' WHEN r > 0.2 THEN 'general' ELSE 'landscape' END AS profile FROM p")
def content_profile(spark, sf):
    return sequence.content_profile(burst_frames(spark, sf), "scene_id").withColumns({"face_rate": r6("face_rate"), "scene_id": F.col("scene_id").cast("string")})


@query("WITH l AS (SELECT l_orderkey AS k, l_quantity AS near, l_tax AS far, l_extendedprice AS area, l_discount AS ear FROM lineitem), t AS (SELECT *, max(area) OVER (PARTITION BY k) AS top FROM l) SELECT k, floor((0.6 * sum(near*area)/sum(area) + 0.4 * min(near) FILTER (area > 0.1 * top))*1e4+0.5)/1e4 AS near, floor(sum(far*area)/sum(area)*1e6+0.5)/1e6 AS far, min(ear) AS min_ear, count(*)::INT AS n_faces, max(area) AS largest FROM t GROUP BY k")
def aggregate_faces(spark, sf):
    face = F.struct(F.col("l_quantity").alias("near"), F.col("l_tax").alias("far"), F.col("l_extendedprice").alias("area"), F.col("l_discount").alias("min_ear"))
    g = _table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(sequence.aggregate_faces(F.array_sort(F.collect_list(face))).alias("f"))
    return g.select("k", (F.floor(F.col("f.near") * 1e4 + 0.5) / 1e4).alias("near"), r6("f.far").alias("far"), "f.min_ear", "f.n_faces", F.col("f.largest.area").alias("largest"))


#: Frames of four shoots with the features that every stage needs, in SQL text that both engines run.
SHOOT_SQL = """
SELECT user_id % 4 AS shoot_id, event_id, {path} AS path, {epoch} AS timestamp, event_type <> 'error' AS has_face,
       CASE WHEN event_type = 'view' THEN 'error' ELSE 'face_mesh' END AS subject_det_method, value / 300 AS raw_min_ear,
       value AS sharp_near_eye, value * 2 AS sharp_far_eye, value * 3 AS sharpness_subject, event_id % 97 = 5 AS degraded,
       CAST(event_id * 7919 % 1009 AS DOUBLE) / 1009 AS topiq_score, CAST(event_id * 104729 % 997 AS DOUBLE) / 10 AS musiq_score,
       1 + CAST(event_id * 1299709 % 811 AS DOUBLE) / 200 AS qalign_score, CAST(event_id * 15485863 % 613 AS DOUBLE) / 613 AS qualiclip_score
FROM {events}"""
SHOOT_WEIGHTS = {"musiq_score": 2.0, "qalign_score": 4.0, "qualiclip_score": 1.0}
_Z = ", ".join(f"({c} - avg({c}) OVER s) / (CASE WHEN stddev_pop({c}) OVER s < 1e-8 THEN 1.0 ELSE stddev_pop({c}) OVER s END) AS z_{c}" for c in SHOOT_WEIGHTS)
RUN_DUCK = "WITH e AS (" + SHOOT_SQL.format(path="lpad(event_id::VARCHAR, 12, '0')", epoch="epoch_us(ts) / 1e6", events="events") + f"""),
o AS (SELECT *, row_number() OVER (PARTITION BY shoot_id ORDER BY timestamp, path) - 1 AS global_index FROM e),
g AS (SELECT *, coalesce(timestamp - lag(timestamp) OVER w > 21600, false) AS sb, coalesce(timestamp - lag(timestamp) OVER w > 3600, false) AS bb FROM o WINDOW w AS (PARTITION BY shoot_id ORDER BY global_index)),
i AS (SELECT *, sum(sb::INT) OVER w AS scene_id, sum((sb OR bb)::INT) OVER w AS burst_id FROM g WINDOW w AS (PARTITION BY shoot_id ORDER BY global_index ROWS UNBOUNDED PRECEDING)),
h AS (SELECT *, sum((subject_det_method <> 'error')::INT) OVER w AS n_valid, avg(CASE WHEN subject_det_method <> 'error' THEN (NOT has_face)::INT END) OVER w AS share, count(*) FILTER (has_face) OVER w AS n_face, max(raw_min_ear) FILTER (has_face) OVER w AS top FROM i WINDOW w AS (PARTITION BY shoot_id, burst_id)),
c AS (SELECT *, CASE WHEN n_valid >= 2 AND share > 0.2 AND share < 0.8 AND has_face AND subject_det_method <> 'error' THEN sharpness_subject ELSE sharp_near_eye END AS near,
  has_face AND CASE WHEN n_face = 1 OR (top < 0.2 AND n_face <= 3) THEN raw_min_ear < 0.12 ELSE raw_min_ear < 0.5 * top END AS blink FROM h),
f AS (SELECT *, CASE WHEN has_face THEN near ELSE sharpness_subject END AS sharp FROM c),
t AS (SELECT *, NOT blink AND ((topiq_score > 0 AND topiq_score < 0.35)::INT + (musiq_score > 0 AND musiq_score < 30)::INT + (sharp > 0 AND sharp < 50)::INT) < CASE WHEN (topiq_score > 0)::INT + (musiq_score > 0)::INT + (sharp > 0)::INT >= 2 THEN 2 ELSE 1 END AS passes FROM f),
z AS (SELECT *, {_Z} FROM t WINDOW s AS (PARTITION BY shoot_id)),
k AS (SELECT *, (2 * z_musiq_score + 4 * z_qalign_score + z_qualiclip_score) / 7 AS z_consensus, passes AND NOT degraded AS gate FROM z),
q AS (SELECT *, CASE WHEN degraded THEN '-infinity'::DOUBLE ELSE z_consensus END AS comp FROM k),
r AS (SELECT *, row_number() OVER (PARTITION BY shoot_id, burst_id ORDER BY gate DESC, comp DESC, global_index) AS p1, row_number() OVER (PARTITION BY shoot_id, burst_id ORDER BY gate DESC, qualiclip_score DESC, global_index) AS p2, sum(gate::INT) OVER (PARTITION BY shoot_id, burst_id) AS passing FROM q),
a AS (SELECT *, p2 = 1 AND passing >= 2 AND p1 <> 1 AS alt FROM r),
u AS (SELECT *, p1 = 1 OR alt AS selected0, p1 = 1 AND NOT bool_or(alt) OVER (PARTITION BY shoot_id, burst_id) AS agree FROM a),
v AS (SELECT *, greatest(3, ceil(0.02 * count(*) OVER (PARTITION BY shoot_id))) - sum(selected0::INT) OVER (PARTITION BY shoot_id) AS need, row_number() OVER (PARTITION BY shoot_id, NOT selected0 AND gate ORDER BY comp DESC, global_index) AS rk FROM u),
l AS (SELECT *, selected0 OR (gate AND rk <= need) AS selected FROM v),
th AS (SELECT shoot_id, quantile_cont(comp, [0.0228, 0.1587, 0.5, 0.8413]) AS qs FROM l WHERE NOT degraded GROUP BY shoot_id)
SELECT l.shoot_id, event_id, global_index, scene_id::BIGINT AS scene_id, burst_id::BIGINT AS burst_id, blink AS blink_detected, gate AS technical_gate_pass, selected, alt AS aesthetic_disagreement, agree AS cluster_agreement,
  CASE WHEN selected AND alt THEN 'Purple' WHEN selected THEN 'Red' WHEN NOT gate THEN 'Green' ELSE '' END AS label,
  CASE WHEN degraded THEN 1 WHEN comp >= qs[4] THEN 5 WHEN comp >= qs[3] THEN 4 WHEN comp >= qs[2] THEN 3 WHEN comp >= qs[1] THEN 2 ELSE 1 END AS star_rating,
  CASE WHEN degraded THEN -1e9 ELSE floor(z_consensus * 1e6 + 0.5) / 1e6 END AS consensus
FROM l JOIN th USING (shoot_id)"""


def shoot_frames(spark: SparkSession, sf: str) -> DataFrame:
    sql = SHOOT_SQL.replace("{path}", "lpad(CAST(event_id AS STRING), 12, '0')").replace("{epoch}", "unix_micros(CAST(ts AS TIMESTAMP)) / 1e6D")
    f = spark.sql(sql, events=_table(spark, sf, "events"))
    return f.withColumns({"focal": F.lit(50.0), "orientation": F.lit(""), "ev": F.lit(None).cast("double"), "camera_body": F.lit("b"), "blink_detected": F.lit(False), "eye_ratio_raw": F.lit(1.0)})


@query(RUN_DUCK)
def shoots_end_to_end(spark, sf):
    """EXE-9: order, sessions, calibration, gate, consensus, components, picks, floor, labels and stars of four shoots."""
    f = run_selection(shoot_frames(spark, sf), SHOOT_WEIGHTS, cluster="burst_id", burst_gap=3600, scene_gap=21600)
    consensus = F.when(F.col("degraded"), -1e9).otherwise(r6("z_consensus")).alias("consensus")
    return f.select("shoot_id", "event_id", "global_index", "scene_id", "burst_id", "blink_detected", "technical_gate_pass", "selected", "aesthetic_disagreement", "cluster_agreement", "label", "star_rating", consensus)


# Vectors ---------------------------------------------------------------------------------------------------------


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "embeddings").select(F.lit(1).alias("shoot_id"), F.col("vec_id").alias("global_index"), F.col("label").alias("scene_id"), "embedding")


@query("WITH u AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), n AS (SELECT vec_id, label, list_transform(e, lambda x: x / (sqrt(list_sum(list_transform(e, lambda y: y*y))) + 1e-8)) AS v FROM u) SELECT x.label AS scene_id, x.vec_id AS a, y.vec_id AS b, floor((1 - list_inner_product(x.v, y.v))*1e5+0.5)/1e5 AS distance FROM n x JOIN n y USING (label) WHERE x.vec_id < y.vec_id")
def pair_distances(spark, sf):
    return selection.pair_distances(vectors(spark, sf), "global_index", "scene_id", "embedding").withColumn("distance", F.floor(F.col("distance") * 1e5 + 0.5) / 1e5)


@query()
def cluster_scenes(spark, sf):
    return selection.global_cluster_ids(selection.cluster_scenes(vectors(spark, sf), "global_index", ["shoot_id", "scene_id"], "embedding", 0.9), "scene_id").select("global_index", "cluster_id")


@query()
def visual_categories(spark, sf):
    return scoring.detect_categories(vectors(spark, sf), threshold=0.0).select("global_index", "visual_category")


@query()
def diverse_top_k(spark, sf):
    return selection.diverse_top_k(vectors(spark, sf).withColumn("q", F.lit(1.0)), "global_index", "scene_id", "embedding", "q", 10)


@query("WITH p AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x*x) AS e FROM embeddings), s AS (SELECT vec_id, list_transform(e, lambda x: x / (list_sum(e) + 1e-10)) AS q FROM p) SELECT vec_id AS global_index, floor(least(greatest(1 + list_sum(list_transform(q, lambda x: x * ln(x + 1e-10))) / ln(64), 0), 1)*1e5+0.5)/1e5 AS confidence FROM s")
def saliency_confidence(spark, sf):
    squares = F.transform("embedding", lambda x: x.cast("double") * x.cast("double"))
    return vectors(spark, sf).withColumn("s", squares).select("global_index", (F.floor(scalar.saliency_confidence(F.col("s"), 64) * 1e5 + 0.5) / 1e5).alias("confidence"))


@query("WITH e AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: exp(x)) AS w FROM embeddings) SELECT vec_id AS global_index, floor(list_sum(list_transform(w, lambda x, i: x * (i - 1))) / list_sum(w)*1e5+0.5)/1e5 AS score FROM e")
def expected_score(spark, sf):
    return vectors(spark, sf).select("global_index", (F.floor(scalar.expected_score(F.transform("embedding", lambda x: x.cast("double"))) * 1e5 + 0.5) / 1e5).alias("score"))


# Texts, paths and joins ------------------------------------------------------------------------------------------


@query("SELECT p_partkey, p_size::DOUBLE AS plain, CASE WHEN p_size > 10 THEN p_size / 10.0 ELSE p_size END::DOUBLE AS named, CASE WHEN p_size <= 5 THEN p_size ELSE 3 END::DOUBLE AS rating FROM part")
def parsed_scores(spark, sf):
    """FN-1, FN-10, FN-11 on generated texts."""
    size = F.col("p_size").cast("string")
    return _table(spark, sf, "part").select("p_partkey", scalar.parse_number(F.concat(size, F.lit(" mm"))).alias("plain"), scalar.score_from_text(F.concat(F.lit("Score: "), size)).alias("named"), scalar.rating_from_text(F.concat(F.lit("<answer> about "), size, F.lit(" </answer>"))).alias("rating"))


@query("SELECT p_partkey, floor((ln(p_size * p_size / (1.0 / p_size)) / ln(2) + ln(100.0 / (p_size + 99)) / ln(2))*1e6+0.5)/1e6 AS ev, floor(least(greatest(p_size / (p_retailprice / 100 + 1e-6) - 1, 0), 3) * 0.1 * 1e6+0.5)/1e6 AS eye, floor(p_size / (p_retailprice + 1e-6)*1e6+0.5)/1e6 AS isolation FROM part")
def ratios(spark, sf):
    size = F.col("p_size").cast("double")
    return _table(spark, sf, "part").select("p_partkey", r6(scalar.exposure_value(size, 1 / size, size + 99)).alias("ev"), r6(scalar.eye_ratio(size, F.col("p_retailprice") / 100)).alias("eye"), r6(scalar.isolation_ratio(size, F.col("p_retailprice"))).alias("isolation"))


@query("SELECT substr(md5(string_agg(url, chr(10) ORDER BY url)), 1, 8) AS data_hash FROM pages")
def path_hash(spark, sf):
    return readers.path_hash(_table(spark, sf, "pages"), "url")


IMAGE_PATHS = "concat('/home/.u/in/', CASE WHEN page_id % 7 = 0 THEN '.trash/' WHEN page_id % 11 = 0 THEN 'x_ranked_topiq/' WHEN page_id % 13 = 0 THEN 'x_category_1/' ELSE 'day/' END, page_id, CASE WHEN page_id % 5 = 0 THEN '.JPG' WHEN page_id % 5 = 1 THEN '_embedded.jpg' WHEN page_id % 5 = 2 THEN '.txt' ELSE '.cr3' END)"


@query(f"SELECT path FROM (SELECT page_id, {IMAGE_PATHS} AS path FROM pages) WHERE page_id % 7 <> 0 AND page_id % 11 <> 0 AND page_id % 5 NOT IN (1, 2)")
def image_listing(spark, sf):
    return readers.select_images(_table(spark, sf, "pages").select(F.expr(IMAGE_PATHS).alias("path")), root="/home/.u/in/")


@query(f"SELECT upper(regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1)) AS extension, count(*) AS n FROM (SELECT {IMAGE_PATHS} AS path FROM pages) GROUP BY 1")
def extension_counts(spark, sf):
    return readers.extension_counts(_table(spark, sf, "pages").select(F.expr(IMAGE_PATHS).alias("path")))


@query("SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'native_jpeg' WHEN length(html) > 10000 OR page_id % 2 = 0 THEN 'embedded_jpeg' ELSE 'rawpy' END AS rendering_path FROM pages")
def image_routes(spark, sf):
    p = _table(spark, sf, "pages")
    return p.select("page_id", scalar.rendering_path(F.when(F.col("page_id") % 5 == 0, "jpg").otherwise("cr3"), F.length("html"), F.col("page_id") % 2 == 0).alias("rendering_path"))


@query("SELECT p_partkey, (CASE WHEN 4000 + p_size > 2500 THEN trunc((4000 + p_size) * (2500.0 / (4000 + p_size))::DOUBLE) END)::INT AS w, trunc((1000 + p_size) * (2500::DOUBLE / (4000 + p_size)))::INT AS h FROM part")
def scaled_sizes(spark, sf):
    w, h = scalar.scaled_size(F.col("p_size") + 4000, F.col("p_size") + 1000)
    return _table(spark, sf, "part").select("p_partkey", w.alias("w"), h.alias("h"))


@query("SELECT count(*) FILTER (o_orderkey IS NOT NULL) AS n_matched, count(*) FILTER (o_orderkey IS NULL) AS n_unmatched FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def feature_match(spark, sf):
    items = _table(spark, sf, "customer").select(F.col("c_custkey").alias("filename"))
    features = _table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("filename")).agg(F.max("o_orderkey").alias("last"))
    return selection.match_features(items, features).agg(F.count_if("matched").alias("n_matched"), F.count_if(~F.col("matched")).alias("n_unmatched"))


@query(
    "WITH g AS (SELECT i, j, row_number() OVER (ORDER BY i * j, i, j) AS k FROM range(1, 7) a(i), range(1, 7) b(j) WHERE i * j <= 6), "
    "d AS (SELECT p_partkey, i, j, k, abs((p_size * 40 + 200)::DOUBLE / 1000 - i::DOUBLE / j) AS d, (p_size * 40 + 200) * 1000.0 > 0.5 * 448 * 448 * i * j AS big FROM part, g), "
    "t AS (SELECT *, min(d) OVER (PARTITION BY p_partkey) AS m FROM d), f AS (SELECT *, min(k) OVER (PARTITION BY p_partkey) AS first FROM t WHERE d = m), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY CASE WHEN k = first THEN 0 WHEN big THEN k ELSE -1 END DESC) AS n FROM f) SELECT p_partkey, i::INT AS i, j::INT AS j FROM r WHERE n = 1"
)
def closest_grid(spark, sf):
    return _table(spark, sf, "part").select("p_partkey", scalar.closest_grid(F.col("p_size") * 40 + 200, F.lit(1000)).alias("g")).select("p_partkey", F.col("g.i").alias("i"), F.col("g.j").alias("j"))


@query()
def pu_scores(spark, sf):
    rows = _table(spark, sf, "labels").join(_table(spark, sf, "documents"), "doc_id").select("doc_id", F.col("quality").cast("double").alias("quality"), F.col("n_chars").cast("double").alias("n_chars"))
    return scoring.PositiveUnlabeled(["n_chars"], "quality").update(rows).score(rows).select("doc_id", "pu_score")
