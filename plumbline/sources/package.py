"""Reading a published package: its layout, its tables, single samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables of a package by their place (fixed values).
TABLES = {
    "benchmark_samples": "tables/benchmark_samples.parquet",
    "benchmark_keypoints": "tables/benchmark_keypoints.parquet",
    "keypoints_crops_448": "annotations/keypoints_crops_448.parquet",
    "crop_transforms": "annotations/crop_transforms.parquet",
}


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def dataset_root(spark: SparkSession, package: str) -> str:
    """The folder of the tables in either of the two layouts."""
    for inner in ("benchmark_v1", "DATA_REPOSITORY_UPLOAD/benchmark_v1"):
        if exists(spark, f"{package}/{inner}"):
            return f"{package}/{inner}"
    raise FileNotFoundError(f"no dataset below {package}")


def attach(spark: SparkSession, package: str, replace: bool = False) -> list[str]:
    """Registers the package's tables as views; a view of the same name is kept unless ``replace``."""
    root, names = dataset_root(spark, package), []
    for name, at in TABLES.items():
        if exists(spark, f"{root}/{at}"):
            if spark.catalog.tableExists(name) and not replace:
                raise ValueError(f"existing view kept: {name}")
            spark.read.parquet(f"{root}/{at}").createOrReplaceTempView(name)
            names.append(name)
    return names


def read_sample(samples: DataFrame, keypoints: DataFrame, benchmark_id: str | None = None) -> DataFrame:
    """One sample with its points in order: the one asked for, else the first by id."""
    if benchmark_id is None:
        one = samples.select("benchmark_id").orderBy("benchmark_id").limit(1)
    else:
        one = samples.select("benchmark_id").filter(F.col("benchmark_id") == benchmark_id).limit(1)
        if one.isEmpty():
            raise KeyError(benchmark_id)
    return keypoints.join(F.broadcast(one), "benchmark_id", "left_semi").orderBy("canonical_id")  # one row is broadcast
