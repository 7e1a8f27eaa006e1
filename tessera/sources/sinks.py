"""Sinks: feature tables, sidecar tags, ranked and category listings, and stage tables by shoot, stage and hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.sources.readers import FEATURES, SCORES, SHARP

#: Sidecar tag names.
TAGS = {"qalign_score": "QAlignScore", "qualiclip_score": "QualiCLIPScore", "topiq_score": "TOPIQScore", "musiq_score": "MUSIQScore", "deqa_score": "DeQAScore", "q_scorer_score": "QScorerScore", "q_insight_score": "QInsightScore", "nima_score": "NIMAScore", "artimuse_score": "ArtiMuseScore", "unipercept_score": "UniPerceptScore", "z_consensus": "ZConsensus", "z_disagreement": "ZDisagreement", "pc2_aesthetic_vs_technical": "PC2AestheticVsTechnical", "pc3_structural": "PC3Structural"}


def decimals(value: Column, n: int) -> Column:
    return F.when(value == float("-inf"), "-inf").otherwise(F.format_string(f"%.{n}f", value))


def feature_rows(frames: DataFrame) -> DataFrame:
    """The feature table as text; columns that don't exist are 0."""
    have = set(frames.columns)

    def text(name: str, kind: str) -> Column:
        if kind == "boolean":
            return F.when(F.col(name) if name in have else F.lit(False), "True").otherwise("False")
        if kind == "double":
            return decimals(F.col(name).cast("double") if name in have else F.lit(0.0), 4 if name in SHARP else 6)
        return F.col(name).cast("string") if name in have else F.lit("" if kind == "string" else "0")

    return frames.select(*(text(c, k).alias(c) for c, k in FEATURES))


def write_features(frames: DataFrame, path: str) -> None:
    feature_rows(frames).write.mode("overwrite").option("header", True).csv(path)


def sidecar_tags(frames: DataFrame) -> DataFrame:
    """path, sidecar and tags: rating, gate, label (empty to clear it) and every value that isn't 0."""
    values = [c for c in (*SCORES, "z_consensus", "z_disagreement", "pc2_aesthetic_vs_technical", "pc3_structural") if c in frames.columns]
    pairs = [F.struct(F.lit(TAGS[c]).alias("key"), F.when(F.col(c) != 0, decimals(F.col(c).cast("double"), 6)).alias("value")) for c in values]
    fixed = [("Rating", F.col("star_rating").cast("string")), ("TechGatePass", F.when(F.col("technical_gate_pass"), "True").otherwise("False")), ("Label", F.col("label"))]
    entries = F.array(*(F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in fixed), *pairs)
    tags = F.map_from_entries(F.filter(entries, lambda e: e.value.isNotNull()))
    return frames.select("path", F.regexp_replace("path", r"\.[^./]+$", ".xmp").alias("sidecar"), tags.alias("tags"))


#: The namespaces of a sidecar.
_SIDECAR = '<?xpacket begin="\ufeff" id="W5M0MpCehiHzreSzNTczkc9d"?>\n<x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#"><rdf:Description rdf:about="" xmlns:xmp="http://ns.adobe.com/xap/1.0/" xmlns:xmpMM="http://ns.adobe.com/xap/1.0/mm/" xmpMM:OriginalDocumentID="'


def sidecar_documents(frames: DataFrame) -> DataFrame:
    """(sidecar, xml): a whole sidecar for each image, with its tags in the xmp namespace; an empty label is left out."""
    quoted = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    entries = F.array_sort(F.filter(F.map_entries("tags"), lambda e: e.value != ""))
    written = F.array_join(F.transform(entries, lambda e: F.concat(F.lit(" xmp:"), e.key, F.lit('="'), quoted(e.value), F.lit('"'))), "")
    name = quoted(F.element_at(F.split("path", "/"), -1))
    return sidecar_tags(frames).select("sidecar", F.concat(F.lit(_SIDECAR), name, F.lit('"'), written, F.lit('/></rdf:RDF></x:xmpmeta>\n<?xpacket end="w"?>')).alias("xml"))


def write_sidecars(frames: DataFrame) -> int:
    """Write each image's sidecar beside it, whole or not at all, from the executors; returns how many."""

    def run(batches):
        import pyarrow as pa
        from pyarrow import fs

        for batch in batches:
            for path, xml in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                files, place = fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)
                with files.open_output_stream(place) as out:
                    out.write(xml.encode())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    return sidecar_documents(frames).mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def ranked_listing(frames: DataFrame, columns: list[str], key: str = "global_index") -> DataFrame:
    """scorer, rank and link name for each column: best first, ties by key."""
    long = frames.unpivot([key, "filename", "star_rating", "label"], columns, "scorer", "value")
    rank = F.row_number().over(Window.partitionBy("scorer").orderBy(F.col("value").desc(), key))
    return _links(long.withColumn("rank", rank), key, "scorer")


def category_listing(frames: DataFrame, key: str = "global_index") -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("visual_category").orderBy(F.col("z_consensus").desc(), key))
    return _links(frames.where("visual_category >= 0").withColumn("rank", rank), key, "visual_category")


def red_picks(frames: DataFrame, shoot: str = "shoot_id", key: str = "global_index") -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(shoot).orderBy(F.col("z_consensus").desc(), key))
    return _links(frames.where("selected AND NOT aesthetic_disagreement").withColumn("rank", rank), key, shoot)


def _links(ranked: DataFrame, key: str, by: str) -> DataFrame:
    stars = F.concat(F.expr("repeat('★', star_rating)"), F.expr("repeat('☆', 5 - star_rating)"))
    mark = F.when(F.col("label") == "Red", "_R").when(F.col("label") == "Purple", "_P").when(F.col("label") == "Green", "_G").otherwise("")
    return ranked.select(by, key, "rank", F.concat(F.format_string("%03d", F.col("rank")), F.lit("_"), stars, mark, F.lit("_"), F.col("filename")).alias("link"))


def star_counts(frames: DataFrame) -> DataFrame:
    return frames.groupBy("star_rating").agg(F.count("*").alias("n"))


def stage_path(root: str, shoot: str, stage: str, version: str, data_hash: str) -> str:
    return f"{root}/shoot={shoot}/stage={stage}/version={version}/data={data_hash or '-'}"


def _folder(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def save_stage(frames: DataFrame, root: str, shoot: str, stage: str, version: str, data_hash: str = "") -> None:
    frames.write.mode("overwrite").parquet(stage_path(root, shoot, stage, version, data_hash))


def load_stage(spark: SparkSession, root: str, shoot: str, stage: str, version: str, data_hash: str = "") -> DataFrame | None:
    files, place = _folder(spark, f"{stage_path(root, shoot, stage, version, data_hash)}/_SUCCESS")
    return spark.read.parquet(stage_path(root, shoot, stage, version, data_hash)) if files.exists(place) else None


def clear_stages(spark: SparkSession, root: str, shoot: str | None = None) -> bool:
    """Delete one shoot's tables, by its exact name, or all."""
    files, place = _folder(spark, root if shoot is None else f"{root}/shoot={shoot}")
    return bool(files.delete(place, True)) if files.exists(place) else False
