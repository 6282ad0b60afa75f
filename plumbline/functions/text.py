"""Parsing of annotation texts as column expressions.  Bad input gives null, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The box that a model answers with: per mille of width and height (fixed value).
BOX = r"<box><(\d+)><(\d+)></box>"


def point_answer(text: Column, width: Column, height: Column) -> Column:
    """Struct x, y in pixels of the first box; null without one or beyond 1000."""
    part = lambda k: F.nullif(F.regexp_extract(text, BOX, k), F.lit("")).try_cast("bigint")
    u, v = part(1), part(2)
    ok = u.between(0, 1000) & v.between(0, 1000)
    return F.when(ok, F.struct((u / 1000 * width).alias("x"), (v / 1000 * height).alias("y")))


def vertices(text: Column) -> Column:
    """Struct x, y, n_vertices, identical of ``x,y;x,y`` text; malformed vertices are left out."""

    def vertex(s: Column) -> Column:
        xy = F.split(s, ",")
        x, y = F.trim(F.get(xy, F.lit(0))).try_cast("double"), F.trim(F.get(xy, F.lit(1))).try_cast("double")
        return F.when((F.size(xy) == 2) & x.isNotNull() & y.isNotNull(), F.struct(x.alias("x"), y.alias("y")))

    vs = F.filter(F.transform(F.split(text, ";"), vertex), lambda v: v.isNotNull())
    first = F.get(vs, F.lit(0))
    return F.struct(first["x"].alias("x"), first["y"].alias("y"), F.size(vs).alias("n_vertices"), (F.size(F.array_distinct(vs)) == 1).alias("identical"))


def pose_line(line: Column) -> Column:
    """Struct class_id, bbox, keypoints of a pose line; null under five fields.

    Triples are read until the first that doesn't parse; an incomplete last one is ignored.
    """
    f = F.split(F.trim(line), r"\s+")
    number = lambda i: F.get(f, i).try_cast("double")
    n = F.floor((F.size(f) - 5) / 3).cast("int")
    starts = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda k: k * 3 + 5)).otherwise(F.array().cast("array<int>"))
    triples = F.transform(
        starts, lambda i: F.struct(number(i).alias("x"), number(i + 1).alias("y"), F.get(f, i + 2).try_cast("double").cast("int").alias("v"))
    )
    bad = lambda t: t["x"].isNull() | t["y"].isNull() | t["v"].isNull()
    first_bad = F.array_min(F.filter(F.transform(triples, lambda t, i: F.when(bad(t), i)), lambda i: i.isNotNull()))
    good = F.slice(triples, F.lit(1), F.coalesce(first_bad, F.size(triples)))
    named = {"class_id": F.get(f, F.lit(0)).try_cast("double").cast("int")}
    named |= {k: number(F.lit(i)) for i, k in enumerate(("bbox_cx", "bbox_cy", "bbox_w", "bbox_h"), 1)}
    return F.when(F.size(f) >= 5, F.struct(*[c.alias(k) for k, c in named.items()], good.alias("keypoints")))


def nonzero_points(keypoints: Column) -> Column:
    return F.size(F.filter(keypoints, lambda k: (k["x"] != 0) | (k["y"] != 0)))


def cell(c: Column) -> Column:
    """A CSV cell without blanks around and commas after."""
    return F.rtrim(F.trim(c), F.lit(","))


def keypoint_row(i: Column, x: Column, y: Column) -> Column:
    """Struct point_id, x, y of three CSV cells; null where one doesn't parse or the point is at the origin."""
    k, u, v = cell(i).try_cast("int"), cell(x).try_cast("double"), cell(y).try_cast("double")
    ok = k.isNotNull() & u.isNotNull() & v.isNotNull() & ~((u == 0) & (v == 0))
    return F.when(ok, F.struct(k.alias("point_id"), u.alias("x"), v.alias("y")))


def tolerant_bool(c: Column) -> Column:
    """Whether a text says true; null stays null."""
    return F.lower(F.trim(c.cast("string"))).isin("true", "1", "yes")


def slug(c: Column) -> Column:
    return F.replace(F.replace(F.lower(c), F.lit(" "), F.lit("_")), F.lit("."), F.lit(""))


def label_line(class_id: int, box: list[Column], keypoints: Column) -> Column:
    """A pose line with eight decimals."""
    points = F.transform(keypoints, lambda p: F.format_string("%.8f %.8f 2", p["x"], p["y"]))
    return F.concat_ws(" ", F.lit(str(class_id)), F.format_string(" ".join(["%.8f"] * len(box)), *box), F.array_join(points, " "))
