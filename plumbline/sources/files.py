"""Readers of annotation files.  Every one is a Spark scan: files are listed and read by executors."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import text as X

#: Schema of nested annotation documents: images with boxes and points that have attributes.
_ATTRIBUTE = "attribute: array<struct<_name: string, _VALUE: string>>"
ANNOTATION_SCHEMA = (
    f"_id string, _name string, _width string, _height string, box array<struct<_label: string, {_ATTRIBUTE}>>, "
    f"points array<struct<_label: string, _points: string, {_ATTRIBUTE}>>"
)


def record_name(path: Column, suffix: str) -> Column:
    """A file's name without folders and suffix."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.when(name.endswith(suffix), F.substring(name, F.lit(1), F.char_length(name) - len(suffix))).otherwise(name)


def keypoint_csv(spark: SparkSession, path: str, suffix: str = "_result.csv") -> DataFrame:
    """``record, point_id, x, y, place`` of all keypoint files below a folder.

    A byte-order mark, blanks and trailing commas don't matter; rows that don't parse and
    points at the origin are left out.  ``place`` grows down a file.
    """
    rows = (
        spark.read.option("header", True).option("enforceSchema", True).option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}")
        .schema("ID string, X string, Y string").csv(path).select("*", F.col("_metadata.file_path").alias("_path"), F.monotonically_increasing_id().alias("_id"), F.col("_metadata.file_block_start").alias("_start"))
    )
    p = X.keypoint_row(F.col("ID"), F.col("X"), F.col("Y"))
    return rows.select(record_name(F.col("_path"), suffix).alias("record"), p.alias("p"), F.struct("_start", "_id").alias("place")).filter("p is not null").select("record", "p.*", "place")


def pose_text(spark: SparkSession, path: str, suffix: str = ".txt") -> DataFrame:
    """``record, line_no, class_id, bbox_*, keypoints, n_points`` of all pose files; short lines are left out."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").text(path, wholetext=True)
    lines = files.select(record_name(F.col("_metadata.file_path"), suffix).alias("record"), F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "line"))
    p = lines.select("record", "line_no", X.pose_line(F.col("line")).alias("p")).filter("p is not null")
    bad = F.col("p.bbox_cx").isNull() | F.col("p.bbox_cy").isNull() | F.col("p.bbox_w").isNull() | F.col("p.bbox_h").isNull()
    checked = F.when(bad, F.raise_error(F.concat(F.lit("bad box in "), F.col("record")))).otherwise(F.lit(0))
    p = p.withColumn("_ok", checked.cast("int")).filter("_ok = 0")
    return p.select("record", "line_no", "p.*", X.nonzero_points(F.col("p.keypoints")).alias("n_points"))


def annotation_xml(spark: SparkSession, path: str) -> DataFrame:
    """One row for each annotated image, with an explicit schema, so that types never depend on the data."""
    return spark.read.format("xml").option("rowTag", "image").schema(ANNOTATION_SCHEMA).load(path)


def annotation_points(images: DataFrame) -> DataFrame:
    """``image_id, image_name, label, x, y, n_vertices, identical, good`` of :func:`annotation_xml`."""
    p = images.select(F.col("_id").alias("image_id"), F.col("_name").alias("image_name"), F.explode("points").alias("p"))
    v = X.vertices(F.col("p._points"))
    good = F.get(F.filter("p.attribute", lambda a: a["_name"] == "good_landmark"), F.lit(0))["_VALUE"]
    return p.select("image_id", "image_name", F.col("p._label").alias("label"), v.alias("v"), good.alias("good")).select("image_id", "image_name", "label", "v.*", "good")


def delimited(spark: SparkSession, path: str, schema: str, sep: str | None = None) -> DataFrame:
    """Delimited text with a header.  Without ``sep`` the delimiter is the likeliest of the first line."""
    if sep is None:
        first = spark.read.text(path).first()
        line = first["value"] if first else ""
        sep = max((",", "\t", ";", "|"), key=line.count)
    return spark.read.option("header", True).option("sep", sep).schema(schema).csv(path)


def file_manifest(spark: SparkSession, path: str) -> DataFrame:
    """``path, bytes, modified`` of all files below a folder; contents aren't read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return f.select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))


def config(spark: SparkSession, path: str) -> dict:
    """A YAML or JSON document, read by Spark, so that any store will do."""
    text = spark.read.text(path, wholetext=True).first()["value"]
    if path.endswith(".json"):
        return json.loads(text)
    import yaml

    return yaml.safe_load(text)
