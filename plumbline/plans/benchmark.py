"""The curated benchmark: audit tables to entities, consensus, splits, and an export in axial crops."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import geometry as G
from plumbline.operators import dedup, splits

THRESHOLD = 0.02


def build_benchmark(
    metadata: DataFrame, keypoints: DataFrame, seed: int = splits.SEED, validation: float = 0.15, test: float = 0.15, threshold: float = THRESHOLD
) -> dict[str, DataFrame]:
    """Samples, consensus keypoints, agreement of repeats and exclusions.

    ``metadata`` and ``keypoints`` are the audit's tables.  A record is eligible with a
    decodable image, all fish points and a resolved orientation.  Records of one content are
    one entity; contents with conflicting taxa are excluded as a whole.
    """
    if not 0 < validation + test < 1:
        raise ValueError("the shares of validation and test must leave some for training")
    ok = F.col("image_error").isNull() & F.col("fish_complete") & F.col("mapping_mode").isin("direct", "reverse") & F.col("content_id").isNotNull()
    eligible = metadata.filter(ok)
    out = dedup.conflicting_labels(eligible, "content_id", "taxon", "conflicting_taxon_for_identical_content")
    good = eligible.join(out.select("content_id").distinct(), "content_id", "left_anti")
    first = F.min(F.struct("anomaly_count", "record", "width", "height", "file_bytes")).alias("f")
    samples = good.groupBy("content_id").agg(
        first, F.count("*").alias("source_record_count"), dedup.piped("record").alias("source_records"), dedup.piped("source_group").alias("source_groups"),
        F.min("taxon").alias("taxon"), dedup.consolidated("origin").alias("origin"), F.bool_and("scale_complete").alias("scale_complete"),
    )
    samples = samples.select(F.concat(F.lit("flm_"), "content_id").alias("benchmark_id"), "*", "f.record", "f.width", "f.height", "f.file_bytes").drop("f")
    points = keypoints.join(good.select("record", "content_id", "width", "height"), "record").withColumn("benchmark_id", F.concat(F.lit("flm_"), "content_id"))
    med = points.groupBy("benchmark_id", "canonical_id").agg(F.percentile("x", F.lit(0.5)).alias("mx"), F.percentile("y", F.lit(0.5)).alias("my"))
    spread = points.join(med, ["benchmark_id", "canonical_id"]).groupBy("benchmark_id", "canonical_id").agg(
        F.min("mx").alias("x"), F.min("my").alias("y"), F.count("*").alias("consensus_record_count"),
        F.percentile(F.abs(F.col("x") - F.col("mx")), F.lit(0.5)).alias("x_mad_px"), F.percentile(F.abs(F.col("y") - F.col("my")), F.lit(0.5)).alias("y_mad_px"),
    )
    agreement = dedup.repeat_disagreement(points, "benchmark_id", "record", "canonical_id", F.hypot(F.col("width"), F.col("height")))
    both = samples.filter("origin <> 'conflicted'").groupBy("taxon").agg(F.collect_set("origin").alias("o"))
    both = both.select(F.col("taxon").alias("_taxon"), (F.array_contains("o", "farmed") & F.array_contains("o", "wild")).alias("_both"))
    samples = samples.join(both, F.col("taxon") == F.col("_taxon"), "left").join(agreement.select("benchmark_id", "pairwise_mean_error_diagonal"), "benchmark_id", "left")
    high = F.coalesce("pairwise_mean_error_diagonal", F.lit(0.0)) > threshold
    samples = samples.withColumns({
        "cross_origin_eligible": F.coalesce("_both", F.lit(False)) & (F.col("origin") != "conflicted"),
        "technical_validation_eligible": ~high,
        "split_stratum": F.concat("taxon", F.lit("|"), "origin"),
    }).drop("_taxon", "_both")
    members = splits.split_members(samples.filter("technical_validation_eligible"), "split_stratum", "benchmark_id", seed, validation, test)
    samples = samples.join(members.select("benchmark_id", "split"), "benchmark_id", "left").withColumn("split", F.coalesce("split", F.lit("review_holdout")))
    return {"benchmark_samples": samples, "benchmark_keypoints": spread, "duplicate_annotation_agreement": agreement, "benchmark_exclusions": out}


def export_crops(keypoints: DataFrame, size: int = 448) -> dict[str, DataFrame]:
    """Axial crops of ``benchmark_id, canonical_id, x, y``: transforms and transformed points.

    An entity must have 11 points; any other number is an error.
    """
    packed = keypoints.groupBy("benchmark_id").agg(F.sort_array(F.collect_list(F.struct("canonical_id", "x", "y"))).alias("points"))
    wrong = F.raise_error(F.concat(F.lit("not 11 points: "), F.col("benchmark_id"))).cast("array<struct<canonical_id: int, x: double, y: double>>")
    packed = packed.withColumn("points", F.when(F.size("points") == 11, F.col("points")).otherwise(wrong))
    df = packed.withColumn("f", G.axial_frame(F.col("points")))
    df = df.withColumn("e", G.axial_extent(F.col("points"), F.col("f"))).withColumn("s", G.axial_scale(F.col("e"), size))
    df = df.withColumn("m", G.axial_matrix(F.col("f"), F.col("e"), F.col("s"), size))
    at = df.select("benchmark_id", "m", F.inline("points"))
    x, y = (G.clip(v, 0.0, size - 1e-6) for v in G.apply_affine(F.col("m"), F.col("x"), F.col("y")))
    crops = at.select("benchmark_id", "canonical_id", x.alias("x_crop_px"), y.alias("y_crop_px"), (x / size).alias("x_crop_normalized"), (y / size).alias("y_crop_normalized"), F.lit(2).alias("visibility"))
    names = {"length": "body_axis_length_px", "ux": "axis_unit_x", "uy": "axis_unit_y", "vx": "down_unit_x", "vy": "down_unit_y"}
    transforms = df.select("benchmark_id", *[F.col(f"f.{k}").alias(v) for k, v in names.items()], "e.*", "m.*")
    return {"crop_transforms": transforms, "keypoints_crops_448": crops}
