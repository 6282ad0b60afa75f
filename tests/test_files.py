"""Readers, writers and the two end-to-end plans on files written here."""

import json
import random

import pytest
from pyspark.sql import functions as F

from plumbline.plans import audit as A
from plumbline.plans import benchmark as B
from plumbline.sinks import files as S
from plumbline.sources import files, package

#: A body with the head on the left and point 2 above the axis; 13 pixels with the scale's ends.
BODY = {1: (10, 50), 2: (20, 42), 3: (40, 38), 4: (60, 40), 5: (88, 46), 6: (92, 50), 7: (88, 54), 8: (70, 58), 9: (50, 62), 10: (22, 58), 11: (26, 50)}
SCALE = {12: (30, 5), 13: (60, 5)}
WIDTH, HEIGHT = 128, 64


@pytest.fixture(scope="module")
def raw(spark, tmp_path_factory):
    """Four records: two of one content, one without its scale, one broken."""
    root = tmp_path_factory.mktemp("raw")
    (root / "csv").mkdir()
    (root / "pose").mkdir()
    images = []
    for name, shift, scale, content, error in (("a", 0, True, "c1", None), ("b", 1, True, "c1", None), ("c", 2, False, "c2", None), ("d", 3, True, "c3", "broken")):
        px = {k: (x + shift / 4, y) for k, (x, y) in BODY.items()} | (SCALE if scale else {})
        text = "ID,X,Y\n" + "".join(f'"{k},",{x},{y}\n' for k, (x, y) in px.items()) + "bad,1,2\n5,0,0\n"
        (root / "csv" / f"{name}_result.csv").write_text("﻿" + text, encoding="utf-8")
        line = lambda ks, px=px: "0 0.5 0.5 0.9 0.9 " + " ".join(f"{px[k][0] / WIDTH} {px[k][1] / HEIGHT} 2" for k in ks)
        (root / "pose" / f"{name}.txt").write_text("\n".join([line(range(1, 12)), *([line((12, 13))] if scale else []), "short"]) + "\n")
        images.append((name, "g", "t", "farmed", WIDTH, HEIGHT, 1000, content, error))
    schema = "record string, source_group string, taxon string, origin string, width int, height int, file_bytes bigint, content_id string, image_error string"
    return root, spark.createDataFrame(images, schema)


@pytest.fixture(scope="module")
def tables(spark, raw):
    root, images = raw
    return {k: v.cache() for k, v in A.run_audit(spark, f"{root}/csv", f"{root}/pose", images).items()}


def test_readers(spark, raw):
    root, _ = raw
    p = files.keypoint_csv(spark, f"{root}/csv")
    assert {r["record"]: r["count"] for r in p.groupBy("record").count().collect()} == {"a": 13, "b": 13, "c": 11, "d": 13}
    poses = files.pose_text(spark, f"{root}/pose")
    assert sorted((r["record"], r["line_no"], r["n_points"]) for r in poses.collect())[:3] == [("a", 0, 11), ("a", 1, 2), ("b", 0, 11)]
    assert files.file_manifest(spark, str(root)).count() == 8


def test_audit(tables):
    meta = {r["record"]: r for r in tables["metadata"].collect()}
    assert meta["a"]["anomaly_codes"] == "" and meta["a"]["mapping_mode"] == "direct"
    assert meta["c"]["anomaly_codes"] == "csv_point_count_11;scale_endpoint_count_0;yolo_row_count_1;missing_scale_row"
    assert meta["d"]["anomaly_codes"] == "image_decode_error"
    assert [meta[k]["is_exact_duplicate_member"] for k in "abcd"] == [True, True, False, False]
    tagged = tables["keypoints_raw_long"].filter("record = 'a'").groupBy("point_role").count()
    assert {r["point_role"]: r["count"] for r in tagged.collect()} == {"fish_landmark": 11, "scale_endpoint": 2}
    assert A.summary(tables).first()["anomalies"] == 5


def test_benchmark_and_export(tables):
    out = B.build_benchmark(tables["metadata"], tables["keypoints_canonical_long"])
    samples = {r["benchmark_id"]: r for r in out["benchmark_samples"].collect()}
    assert set(samples) == {"flm_c1", "flm_c2"} and samples["flm_c1"]["source_records"] == "a|b"
    k = {(r["benchmark_id"], r["canonical_id"]): r for r in out["benchmark_keypoints"].collect()}
    assert k["flm_c1", 1]["x"] == pytest.approx(10.125) and k["flm_c1", 1]["x_mad_px"] == pytest.approx(0.125)
    assert out["duplicate_annotation_agreement"].first()["pairwise_mean_error"] == pytest.approx(0.25)
    crops = B.export_crops(out["benchmark_keypoints"])
    assert crops["crop_transforms"].count() == 2
    box = crops["keypoints_crops_448"].agg(F.min("x_crop_px"), F.max("x_crop_px"), F.count("*")).first()
    assert box[0] >= 0 and box[1] < 448 and box[2] == 22
    with pytest.raises(ValueError, match="shares"):
        B.build_benchmark(tables["metadata"], tables["keypoints_canonical_long"], validation=0.6, test=0.5)


def test_nested_annotations(spark, tmp_path):
    (tmp_path / "a.xml").write_text(
        '<annotations><image id="0" name="x.jpg" width="10" height="5"><points label="snout" points="1,2;1,2"><attribute name="good_landmark">true</attribute></points>'
        '<box label="body"><attribute name="species">s</attribute></box></image><image id="1" name="y.jpg" width="1" height="1"/></annotations>'
    )
    images = files.annotation_xml(spark, str(tmp_path / "a.xml"))
    assert images.count() == 2
    p = files.annotation_points(images).collect()
    assert [(r["image_name"], r["label"], r["x"], r["n_vertices"], r["identical"], r["good"]) for r in p] == [("x.jpg", "snout", 1.0, 2, True, "true")]


def test_sniffed_delimiter_and_config(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("a\tb\n1\tx,y\n")
    assert files.delimited(spark, str(tmp_path / "t.tsv"), "a int, b string").first()["b"] == "x,y"
    (tmp_path / "c.json").write_text('{"k": 1}')
    (tmp_path / "c.yaml").write_text("k: 1\n")
    assert files.config(spark, str(tmp_path / "c.json")) == files.config(spark, str(tmp_path / "c.yaml")) == {"k": 1}


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("b", "test", [1, 2]), ("a", "train", [])], "benchmark_id string, split string, v array<int>")
    S.write_both(df, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t.parquet")).count() == spark.read.option("header", True).csv(str(tmp_path / "t.csv")).count() == 2
    S.write_document(S.split_document(df), str(tmp_path / "doc"))
    assert json.loads(spark.read.text(str(tmp_path / "doc")).first()[0]) == {"splits": {"test": ["b"], "train": ["a"]}}
    ent = spark.createDataFrame([("b", "test", 4, 4, [0.5, 0.5, 1.0, 1.0], [(0.25, 0.75)])], "benchmark_id string, split string, width int, height int, box array<double>, points array<struct<x: double, y: double>>")
    S.write_labels(ent, str(tmp_path / "labels"))
    fields = spark.read.text(str(tmp_path / "labels")).filter("split = 'test'").first()["value"].split("\t")[1].split(" ")
    assert len(fields) == 8 and fields[5] == "0.25000000"
    coco = S.coco_document(ent, ["p"]).first()
    assert coco["images"][0]["id"] == 1 and coco["annotations"][0]["keypoints"] == [0.25, 0.75, 2.0]
    paths = spark.createDataFrame([("x",), ("y",)], "path string")
    S.write_path_list(paths, paths, str(tmp_path / "list"))
    with pytest.raises(FileNotFoundError):
        S.write_path_list(paths, paths.filter("path = 'x'"), str(tmp_path / "list2"))


def test_package(spark, tmp_path):
    root = tmp_path / "p" / "benchmark_v1"
    spark.createDataFrame([("a",), ("b",)], "benchmark_id string").write.parquet(str(root / "tables/benchmark_samples.parquet"))
    k = [(i, c, 1.0, 2.0) for i in "ab" for c in random.Random(0).sample(range(1, 12), 11)]
    spark.createDataFrame(k, "benchmark_id string, canonical_id int, x double, y double").write.parquet(str(root / "tables/benchmark_keypoints.parquet"))
    assert package.attach(spark, str(tmp_path / "p")) == ["benchmark_samples", "benchmark_keypoints"]
    with pytest.raises(ValueError, match="kept"):
        package.attach(spark, str(tmp_path / "p"))
    got = package.read_sample(spark.table("benchmark_samples"), spark.table("benchmark_keypoints")).collect()
    assert [r["canonical_id"] for r in got] == list(range(1, 12)) and got[0]["benchmark_id"] == "a"
    with pytest.raises(KeyError):
        package.read_sample(spark.table("benchmark_samples"), spark.table("benchmark_keypoints"), "z")
