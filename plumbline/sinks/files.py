"""Writers of tables, documents, labels and lists.  Spark writes all of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import text as X


def write_both(df: DataFrame, path: str) -> None:
    """Parquet, and CSV made from the Parquet files, so that the plan runs once.  Arrays become text with pipes in the CSV."""
    df.write.mode("overwrite").parquet(f"{path}.parquet")
    again = df.sparkSession.read.schema(df.schema).parquet(f"{path}.parquet")
    flat = [F.array_join(F.col(c).cast("array<string>"), "|").alias(c) if t.startswith("array") else F.to_json(c).alias(c) if t.startswith(("struct", "map")) else F.col(c) for c, t in df.dtypes]
    again.select(*flat).write.mode("overwrite").option("header", True).csv(f"{path}.csv")


def write_document(row: DataFrame, path: str) -> None:
    """A one-row frame as one JSON document."""
    row.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def split_document(members: DataFrame, split: str = "split", key: str = "benchmark_id") -> DataFrame:
    """``{split: [ids]}`` as one row; a list of ids is the document itself, so it is bounded by what a document may hold."""
    lists = members.groupBy(split).agg(F.array_sort(F.collect_list(key)).alias("ids"))
    return lists.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(split, "ids")))).alias("splits"))


def write_labels(entities: DataFrame, path: str, key: str = "benchmark_id", split: str = "split") -> None:
    """Pose label lines in a folder for each split, with the key beside each line.

    ``entities``: key, split, box (array of 4) and points (array of structs x, y from 0 to 1).
    """
    line = X.label_line(0, [F.get("box", F.lit(i)) for i in range(4)], F.col("points"))
    entities.select(split, F.concat(F.col(key), F.lit("\t"), line).alias("value")).write.mode("overwrite").partitionBy(split).text(path)


def coco_document(entities: DataFrame, names: list[str]) -> DataFrame:
    """Images, annotations and the category as one row.

    ``entities``: benchmark_id, width, height, box (x, y, w, h) and points; ids run in the
    order of benchmark_id, and the order is made inside the document's arrays.
    """
    flat = F.flatten(F.transform("points", lambda p: F.array(p["x"], p["y"], F.lit(2.0))))
    row = F.struct(
        "benchmark_id", "width", "height", F.col("box").alias("bbox"), (F.get("box", F.lit(2)) * F.get("box", F.lit(3))).alias("area"),
        flat.alias("keypoints"), F.size("points").alias("num_keypoints"),
    )
    one = entities.agg(F.array_sort(F.collect_list(row)).alias("rows"))
    images = F.transform("rows", lambda r, i: F.struct((i + 1).alias("id"), F.concat(r["benchmark_id"], F.lit(".jpg")).alias("file_name"), r["width"].alias("width"), r["height"].alias("height")))
    notes = F.transform("rows", lambda r, i: F.struct((i + 1).alias("id"), (i + 1).alias("image_id"), F.lit(1).alias("category_id"), r["bbox"].alias("bbox"), r["area"].alias("area"), r["keypoints"].alias("keypoints"), r["num_keypoints"].alias("num_keypoints"), F.lit(0).alias("iscrowd")))
    category = F.struct(F.lit(1).alias("id"), F.lit("specimen").alias("name"), F.array(*map(F.lit, names)).alias("keypoints"))
    return one.select(images.alias("images"), notes.alias("annotations"), F.array(category).alias("categories"))


def write_path_list(paths: DataFrame, existing: DataFrame, path: str) -> None:
    """Sorted paths as text; raises if one is missing from ``existing`` (both have a column ``path``)."""
    missing = paths.join(existing, "path", "left_anti").limit(1).collect()
    if missing:
        raise FileNotFoundError(missing[0]["path"])
    paths.select("path").orderBy("path").write.mode("overwrite").text(path)
