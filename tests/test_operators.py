"""Operators against brute force on small literal inputs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import geometry as G
from plumbline.functions import stats
from plumbline.functions import text as X
from plumbline.operators import dedup, relational, roles, splits
from plumbline.plans import audit

POINTS = "id int, points array<struct<canonical_id: int, x: double, y: double>>"


def _points(xy):
    return [(k, float(x), float(y)) for k, (x, y) in enumerate(xy, 1)]


def test_procrustes_ignores_rotation_scale_and_shift(spark):
    square = [(0, 0), (1, 0), (1, 1), (0, 1)]
    moved = [(-3 * y + 10, 3 * x - 7) for x, y in square]
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(11, 2)), rng.normal(size=(11, 2))
    df = spark.createDataFrame([(1, _points(square), _points(moved)), (2, _points(a), _points(b)), (3, _points([(1, 1)] * 4), _points(square))], POINTS + ", other array<struct<canonical_id: int, x: double, y: double>>")
    df = df.select("id", "points", G.centred(F.col("points")).alias("p"), G.centred(F.col("other")).alias("t"))
    got = {r["id"]: r["d"] for r in df.select("id", G.procrustes_rmse(G.procrustes_terms(F.col("p"), F.col("t")), F.size("points")).alias("d")).collect()}

    p, t = ((v - v.mean(axis=0)) / np.linalg.norm(v - v.mean(axis=0)) for v in (a, b))
    u, _, vt = np.linalg.svd(p.T @ t)
    u[:, -1] *= np.sign(np.linalg.det(u @ vt))
    assert got[1] < 1e-7
    assert got[2] == pytest.approx(math.sqrt((((p @ u @ vt) - t) ** 2).sum() / 11), abs=1e-12)
    assert got[3] is None


def test_affine_and_its_inverse_undo_each_other(spark):
    rng = np.random.default_rng(2)
    pts = _points(rng.normal(size=(11, 2)) * 100)
    df = spark.createDataFrame([(1, pts)], POINTS).withColumn("f", G.axial_frame(F.col("points"))).withColumn("e", G.axial_extent(F.col("points"), F.col("f")))
    df = df.withColumn("m", G.axial_matrix(F.col("f"), F.col("e"), G.axial_scale(F.col("e"), 448), 448)).select("m", F.inline("points"))
    x, y = G.apply_affine(F.col("m"), F.col("x"), F.col("y"))
    inv = G.invert_affine(F.col("m"))
    back = df.select("x", "y", x.alias("u"), y.alias("v"), *[c.alias(k) for k, c in inv.items()]).collect()
    for r in back:
        assert r["inverse_00"] * r["u"] + r["inverse_01"] * r["v"] + r["inverse_02"] == pytest.approx(r["x"], abs=1e-8)
        assert 7.9 < r["u"] < 440.1 and 7.9 < r["v"] < 440.1


def test_greedy_match_equals_a_loop(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for i in range(60):
        pixels = [(k, float(rng.randint(0, 6)), float(rng.randint(0, 6))) for k in rng.sample(range(1, 30), rng.randint(0, 9))]
        pose = [(rng.randint(0, 6) / 8, rng.randint(0, 6) / 8, 2) for _ in range(rng.randint(0, 8))]
        rows.append((i, pose, pixels))
        free, out = dict((k, (x, y)) for k, x, y in pixels), []
        for role, (u, v, _) in enumerate(pose, 1):
            if u == 0 and v == 0:
                continue
            best = None
            for k, (x, y) in free.items():
                d = math.hypot(x - u * 8, y - v * 8)
                if best is None or d < best[0]:
                    best = (d, k)
            if best and best[0] <= 1.5:
                out.append((role, best[1], *free.pop(best[1])))
            else:
                out.append((role, None, u * 8, v * 8))
        want[i] = out
    df = spark.createDataFrame(rows, "id int, pose array<struct<x: double, y: double, v: int>>, pixels array<struct<point_id: int, x: double, y: double>>")
    got = df.select("id", roles.greedy_match(F.col("pose"), F.col("pixels"), F.lit(8.0), F.lit(8.0)).alias("m")).collect()
    assert {r["id"]: [(m["role_id"], m["source_id"], m["x"], m["y"]) for m in r["m"]] for r in got} == want


@pytest.mark.parametrize(
    ("xy", "ends", "mode"),
    [
        ({1: (0, 0), 2: (1, 1), 6: (1, 10), 10: (-1, 1)}, None, "ambiguous"),
        ({1: (0, 0), 2: (1, -1), 6: (10, 0), 10: (1, 1)}, None, "direct"),
        ({1: (0, 0), 2: (1, 1), 6: (10, 0), 10: (1, -1)}, None, "reverse"),
        ({1: (0, 0), 2: (1, 1), 6: (1, 10), 10: (-1, 1)}, [(5, 3), (5, 5)], "direct"),
        ({1: (0, 0), 2: (1, 1), 10: (-1, 1)}, None, "unresolved"),
    ],
)
def test_orientation(spark, xy, ends, mode):
    pts = [(k, float(xy[k][0]), float(xy[k][1])) if k in xy else None for k in range(1, 12)]
    df = spark.createDataFrame([(1, pts, ends and [(float(a), float(b)) for a, b in ends])], POINTS + ", ends array<struct<x: double, y: double>>")
    assert df.select(roles.orientation(F.col("points"), F.col("ends")).alias("o")).first()["o"]["mode"] == mode


def test_split_counts_equal_the_shuffled_split(spark):
    rows = [(f"s{n}", i) for n in (*range(1, 24), 57, 200) for i in range(n)]
    df = spark.createDataFrame(rows, "stratum string, id int")
    members = splits.split_members(df, "stratum", "id").groupBy("stratum").pivot("split", ["test", "validation", "train"]).count().na.fill(0)
    counts = df.groupBy("stratum").agg(F.count("*").alias("n")).select("stratum", *[c.cast("long").alias(k) for k, c in splits.split_counts(F.col("n")).items()])
    as_rows = lambda d: sorted((r["stratum"], r["test"], r["validation"], r["train"]) for r in d.collect())
    assert as_rows(members) == as_rows(counts)


def test_quarantine_takes_only_the_test_member(spark):
    pairs = spark.createDataFrame([("a", "b", 1), ("c", "d", 2), ("x", "a", 1)], "left_id string, right_id string, hamming_distance int")
    held = spark.createDataFrame([("a", "train"), ("b", "test"), ("c", "test"), ("d", "test")], "id string, role string")
    got = {(r["left_id"], r["right_id"]): r["quarantine_id"] for r in dedup.quarantine(pairs, held).collect()}
    assert got == {("a", "b"): "b", ("c", "d"): None, ("x", "a"): None}


def test_banded_near_pairs_equal_brute_force(spark):
    rng = random.Random(4)
    base = [rng.getrandbits(63) for _ in range(30)]
    bits = base + [b ^ (1 << rng.randrange(63)) ^ (1 << rng.randrange(63)) for b in base]
    rows = [(i, i % 2, b) for i, b in enumerate(bits)]
    df = spark.createDataFrame(rows, "id int, block int, bits bigint")
    got = {(r["left_id"], r["right_id"]) for r in dedup.near_pairs(df, ["block"], "id", "bits", 2).collect()}
    assert got == {(i, j) for i, a, x in rows for j, b, y in rows if i < j and a == b and (x ^ y).bit_count() <= 2}


def test_near_pairs_by_size_and_content(spark):
    rows = [(1, 0, 5, 1000, "a"), (2, 0, 5, 1000, "a"), (3, 0, 5, 1010, "b"), (4, 0, 7, 1011, "c"), (5, 0, 5, None, "d"), (6, 0, 5, 990, None)]
    df = spark.createDataFrame(rows, "id int, block int, bits bigint, bytes bigint, content string")
    got = {(r["left_id"], r["right_id"]): r["relative_file_size_difference"] for r in dedup.near_pairs(df, ["block"], "id", "bits", 2, size="bytes", content="content").collect()}
    assert got == {(1, 3): pytest.approx(10 / 1010), (2, 3): pytest.approx(10 / 1010), (3, 4): pytest.approx(1 / 1011)}


def test_split_order_is_the_generators(spark):
    df = spark.createDataFrame([("abc", i) for i in range(20)], "stratum string, id int")
    got = {r["id"]: r["split"] for r in splits.split_members(df, "stratum", "id").collect()}
    ids = list(range(20))
    random.Random(splits.SEED + ord("a") + 2 * ord("b") + 3 * ord("c")).shuffle(ids)
    assert got == {i: "test" if k < 3 else "validation" if k < 6 else "train" for k, i in enumerate(ids)}


def test_repeated_points_stay_whole(spark):
    rows = [("r", 1, 1.0, 9.0, 0), ("r", 1, 5.0, 2.0, 1), ("r", 2, 7.0, 7.0, 2), ("s", 1, 5.0, 2.0, 3), ("s", 1, 1.0, 9.0, 4)]
    df = spark.createDataFrame(rows, "record string, point_id int, x double, y double, place int")
    got = {r["record"]: [tuple(p) for p in r["pixels"]] for r in audit._keyed(df).collect()}
    assert got == {"r": [(1, 5.0, 2.0), (2, 7.0, 7.0)], "s": [(1, 1.0, 9.0)]}
    assert [tuple(p) for r in audit._keyed(df.drop("place").filter("record = 's'")).collect() for p in r["pixels"]] == [(1, 5.0, 2.0)]


def test_icc(spark):
    df = spark.createDataFrame([(1, 1.0, 1.0), (1, 2.0, 2.0), (1, 4.0, 4.0), (1, 8.0, 8.0), (2, 1.0, 5.0)], "g int, a double, b double")
    got = {r["g"]: r["icc"] for r in stats.icc_a1("a", "b", "g")(df).collect()}
    assert got == {1: pytest.approx(1.0), 2: None}


def test_bootstraps(spark):
    got = stats.cluster_mean_ci([1.0, 1.0], [2, 2])
    assert (got["n"], got["clusters"], got["mean"]) == (4, 2, 0.5)
    v = np.random.default_rng(0).normal(size=50)
    assert stats.mean_ci([*v, float("nan")]) == stats.mean_ci(v)
    assert stats.mean_ci([])["n"] == 0
    draws = np.random.default_rng(stats.SEED).integers(0, 50, size=(2000, 50))
    assert stats.mean_ci(v)["ci95_low"] == pytest.approx(np.quantile(v[draws].mean(axis=1), 0.025))


def test_text_parsers(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("c")).first()["c"]
    answer = lambda s: get(X.point_answer(F.lit(s), F.lit(800), F.lit(600)))
    assert tuple(answer("answer <box><250><750></box>")) == (200.0, 450.0)
    assert answer("none") is None and answer("<box><1001><1></box>") is None
    assert tuple(get(X.vertices(F.lit("12.5,7.25;12.5,7.25")))) == (12.5, 7.25, 2, True)
    assert tuple(get(X.keypoint_row(F.lit(" 1,"), F.lit("12.5"), F.lit("7.25")))) == (1, 12.5, 7.25)
    assert get(X.keypoint_row(F.lit("1.0"), F.lit("1"), F.lit("1"))) is None
    assert get(X.keypoint_row(F.lit("1"), F.lit("0"), F.lit("0.0"))) is None
    assert get(X.pose_line(F.lit("0 1 2 3"))) is None
    assert len(get(X.pose_line(F.lit("0 .5 .5 1 1 .1 .2 2 .3 bad 2 .4 .5 2")))["keypoints"]) == 1


def test_contracts(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    right = spark.createDataFrame([(1, "x"), (1, "y")], "k int, w string")
    with pytest.raises(Exception, match="duplicate keys"):
        relational.join_unique(left, right, "k").collect()
    with pytest.raises(Exception, match="unknown id"):
        relational.ordered_lookup(left, "k", [2, 9]).collect()
    assert [r["v"] for r in relational.ordered_lookup(left, "k", [2, 1]).collect()] == ["b", "a"]
    over = relational.last_match({"train": F.lit(True), "test": F.col("k") == 2}, "excluded")
    assert [r["r"] for r in left.select(over.alias("r")).collect()] == ["train", "test"]
