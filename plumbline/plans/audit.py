"""The audit: annotation files to tables.  One job graph over arrays by record; no loop over files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import geometry as G
from plumbline.operators import dedup, roles
from plumbline.sources import files


def _keyed(points: DataFrame) -> DataFrame:
    """Pixels by record; of a repeated id the last one counts, by ``place`` if there is one, else the one of greatest (x, y)."""
    at = F.struct("x", "y")
    last = F.max_by(at, F.struct("place", at)) if "place" in points.columns else F.max(at)
    p = points.groupBy("record", "point_id").agg(last.alias("p")).select("record", "point_id", "p.*")
    return p.groupBy("record").agg(F.sort_array(F.collect_list(F.struct("point_id", "x", "y"))).alias("pixels"))


def audit(points: DataFrame, poses: DataFrame, images: DataFrame, spark: SparkSession) -> dict[str, DataFrame]:
    """Tables of the audit.

    ``points``: record, point_id, x, y and perhaps place, their order; ``poses``: record, line_no, bbox_w, bbox_h, keypoints,
    n_points; ``images``: record, source_group, taxon, origin, width, height, file_bytes,
    content_id, image_error (decoded elsewhere: a missing or broken image is a row with an error).
    """
    chosen = roles.pick_rows(poses.withColumnRenamed("record", "record_id")).withColumnRenamed("record_id", "record")
    pose = chosen.groupBy("record").agg(
        F.first(F.when(F.col("row_kind") == "fish", F.col("keypoints")), ignorenulls=True).alias("fish_pose"),
        F.first(F.when(F.col("row_kind") == "scale", F.col("keypoints")), ignorenulls=True).alias("scale_pose"),
    )
    lines = poses.groupBy("record").agg(F.count("*").alias("pose_rows"))
    base = images.join(_keyed(points), "record", "left").join(pose, "record", "left").join(lines, "record", "left")
    empty = "array<struct<role_id: int, source_id: bigint, x: double, y: double, error_px: double>>"
    none = F.array().cast(empty)
    pixels = F.coalesce("pixels", F.array().cast("array<struct<point_id: int, x: double, y: double>>"))
    match = lambda c: F.coalesce(F.when(F.col(c).isNotNull() & F.col("width").isNotNull(), roles.greedy_match(F.col(c), F.col("pixels"), F.col("width"), F.col("height"))), none)
    m = base.withColumn("pixels", pixels).withColumns({"fish": match("fish_pose"), "scale": match("scale_pose")})
    by_role = F.transform(F.sequence(F.lit(1), F.lit(11)), lambda k: F.get(F.filter("fish", lambda p: p["role_id"] == k), F.lit(0)))
    m = m.withColumn("r", F.transform(by_role, lambda p, i: F.when(p.isNotNull(), F.struct((i + 1).alias("canonical_id"), p["x"].alias("x"), p["y"].alias("y")))))
    ends = F.when(F.size("scale") == 2, F.transform("scale", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))))
    m = m.withColumn("o", roles.orientation(F.col("r"), ends)).withColumn("area", G.signed_area(F.col("r")))
    unmatched = lambda c: F.exists(c, lambda p: p["source_id"].isNull())
    n = {k: F.size(k) for k in ("pixels", "fish", "scale")}
    tail_ids = F.transform("scale", lambda p: p["source_id"])
    rules = [
        (n["pixels"] != 13, F.concat(F.lit("csv_point_count_"), n["pixels"].cast("string"))),
        (n["fish"] != 11, F.concat(F.lit("fish_landmark_count_"), n["fish"].cast("string"))),
        (n["scale"] != 2, F.concat(F.lit("scale_endpoint_count_"), n["scale"].cast("string"))),
        (unmatched("fish") | unmatched("scale"), "yolo_csv_role_match_incomplete"),
        ((n["fish"] == 10) & (tail_ids == F.array(F.lit(11).cast("long"), F.lit(12).cast("long"))), "source_variant_10_fish_plus_raw_11_12_scale"),
        (F.coalesce("pose_rows", F.lit(0)) != 2, F.concat(F.lit("yolo_row_count_"), F.coalesce("pose_rows", F.lit(0)).cast("string"))),
        (F.col("fish_pose").isNull(), "missing_fish_pose_row"),
        (F.col("scale_pose").isNull(), "missing_scale_row"),
        (F.col("image_error").isNotNull(), "image_decode_error"),
        (F.col("o.mode") == "ambiguous", "canonical_mapping_ambiguous"),
        (F.col("area") <= 0, "nonpositive_raw_contour_orientation"),
    ]
    m = m.withColumn("codes", roles.anomaly_codes(rules))
    meta = m.select(
        "record", "source_group", "taxon", "origin", "width", "height", "file_bytes", "content_id", "image_error",
        n["pixels"].alias("raw_point_count"), (n["fish"] == 11).alias("fish_complete"), (n["scale"] == 2).alias("scale_complete"),
        F.col("area").alias("raw_polygon_signed_area"), F.col("o.mode").alias("mapping_mode"), F.col("o.reason").alias("mapping_reason"), F.col("o.angle").alias("body_axis_angle_deg"),
        F.size("codes").alias("anomaly_count"), F.array_join("codes", ";").alias("anomaly_codes"),
    )
    fish, scale = m.select("record", F.inline("fish")), m.select("record", F.inline("scale"))
    raw = points.select("record", F.col("point_id").cast("long").alias("point_id"), "x", "y")
    named = m.select("record", F.col("o.mode").alias("mode"), F.inline(F.filter("r", lambda p: p.isNotNull()))).withColumnRenamed("canonical_id", "raw_id")
    return {
        "metadata": dedup.membership(meta, "content_id"),
        "keypoints_raw_long": roles.tag_raw_points(raw, fish, scale, "record"),
        "keypoints_canonical_long": roles.canonicalise(named, spark).select("record", "canonical_id", "canonical_name", "x", "y", "raw_id"),
        "scale_endpoints_long": scale.withColumns({"scale_length_value": F.lit(None).cast("double"), "scale_unit": F.lit(None).cast("string")}),
        "anomalies": m.select("record", "source_group", F.explode("codes").alias("anomaly_code")),
        "exact_duplicates": dedup.exact_groups(meta, "content_id"),
    }


def run_audit(spark: SparkSession, csv_root: str, pose_root: str, images: DataFrame) -> dict[str, DataFrame]:
    """:func:`audit` of the files below two folders."""
    return audit(files.keypoint_csv(spark, csv_root), files.pose_text(spark, pose_root), images, spark)


def summary(tables: dict[str, DataFrame]) -> DataFrame:
    """The audit as one row."""
    m = tables["metadata"]
    has = lambda s: F.count(F.when(F.col("anomaly_codes").contains(s), 1))
    return m.agg(
        F.count("*").alias("records"), F.countDistinct("content_id").alias("distinct_contents"), F.count(F.when(F.col("fish_complete"), 1)).alias("fish_complete"),
        F.count(F.when(F.col("is_exact_duplicate_member"), 1)).alias("duplicate_members"), has("role_match_incomplete").alias("match_incomplete"),
        F.sum("anomaly_count").alias("anomalies"), F.countDistinct("taxon").alias("taxa"),
    )
