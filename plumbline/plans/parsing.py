"""Parsers, exports and tensor kernels, on texts built from the carrier's points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import geometry as G
from plumbline.functions import tensors
from plumbline.functions import text as X
from plumbline.operators import roles
from plumbline.plans.base import LM, long_points, packed, query, r6, s6, table

_ANSWER = "CASE WHEN id % 7 = 0 THEN 'none' WHEN id % 7 = 1 THEN 'box <box><1001><5></box>' ELSE 'answer <box><' || ((id * 37 + canonical_id) % 1001) || '><' || ((id * 11 + canonical_id) % 1001) || '></box>' END"


def _n(expr: str) -> Column:
    return F.expr(expr)


@query(
    f"WITH {LM}, a AS (SELECT id, canonical_id, {_ANSWER} AS t FROM lm), m AS (SELECT *, TRY_CAST(nullif(regexp_extract(t, '<box><(\\d+)><(\\d+)></box>', 1), '') AS BIGINT) AS u, TRY_CAST(nullif(regexp_extract(t, '<box><(\\d+)><(\\d+)></box>', 2), '') AS BIGINT) AS v FROM a) "
    f"SELECT id, canonical_id, CASE WHEN u <= 1000 AND v <= 1000 THEN {s6('u / 1000 * 800')} END AS x, CASE WHEN u <= 1000 AND v <= 1000 THEN {s6('v / 1000 * 600')} END AS y FROM m"
)
def parse_point_answer(spark: SparkSession, sf: str) -> DataFrame:
    a = long_points(spark, sf).select("id", "canonical_id", _n(_ANSWER).alias("t"))
    p = a.select("id", "canonical_id", X.point_answer(F.col("t"), F.lit(800), F.lit(600)).alias("p"))
    return p.select("id", "canonical_id", r6(F.col("p.x")).alias("x"), r6(F.col("p.y")).alias("y"))


_VERTS = "CASE WHEN id % 5 = 0 THEN id || '.5,7.25;' || id || '.5,7.25' WHEN id % 5 = 1 THEN 'bad;' || id || ',2' WHEN id % 5 = 2 THEN id || ',1,3' ELSE id || ',1;2,' || id END"
_VEXP = """SELECT vec_id AS id, CASE vec_id % 5 WHEN 0 THEN vec_id + 0.5 WHEN 2 THEN NULL ELSE vec_id END::DOUBLE AS x, CASE vec_id % 5 WHEN 0 THEN 7.25 WHEN 1 THEN 2 WHEN 2 THEN NULL ELSE 1 END::DOUBLE AS y,
  CASE vec_id % 5 WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 0 ELSE 2 END::INT AS n_vertices, vec_id % 5 IN (0, 1) AS identical FROM embeddings"""


@query(_VEXP)
def parse_vertices(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"))
    return e.select("id", X.vertices(_n(_VERTS)).alias("v")).select("id", "v.x", "v.y", "v.n_vertices", "v.identical")


@query(
    "SELECT id % 3 AS kind, count(*)::BIGINT AS records, sum(n)::BIGINT AS vertices, count(*) FILTER (n = 0)::BIGINT AS unparsed FROM (SELECT vec_id AS id, CASE vec_id % 5 WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 0 ELSE 2 END AS n FROM embeddings) GROUP BY 1"
)
def vertex_inventory(spark: SparkSession, sf: str) -> DataFrame:
    v = parse_vertices(spark, sf)
    return v.groupBy((F.col("id") % 3).alias("kind")).agg(
        F.count("*").alias("records"), F.sum("n_vertices").alias("vertices"), F.count(F.when(F.col("n_vertices") == 0, 1)).alias("unparsed")
    )


_POSE = "concat_ws(' ', id % 3, '0.5 0.5', format_string('%.6f', id / 100000D), '0.25', CASE WHEN id % 4 = 0 THEN '0.1 0.2 2 0.3 x 2 0.5 0.6 2' WHEN id % 4 = 1 THEN '0.1 0.2 2.0 0 0 0 0.7' WHEN id % 4 = 2 THEN '0 0 0' ELSE '0.9 0.8 1 0.7 0.6 1' END)"


@query(
    f"SELECT vec_id AS id, (vec_id % 3)::INT AS class_id, {s6('vec_id / 100000')} AS bbox_w, CASE vec_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 2 END::INT AS n_points, CASE vec_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 0 ELSE 2 END::INT AS n_nonzero FROM embeddings"
)
def parse_pose_line(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id")).select("id", _n(_POSE).alias("line"))
    p = lines.select("id", X.pose_line(F.col("line")).alias("p"))
    return p.select("id", "p.class_id", r6(F.col("p.bbox_w")).alias("bbox_w"), F.size("p.keypoints").alias("n_points"), X.nonzero_points(F.col("p.keypoints")).alias("n_nonzero"))


@query(
    f"WITH {LM} SELECT id, canonical_id AS point_id, {s6('round(x, 6)')} AS x, {s6('round(y, 6)')} AS y FROM lm WHERE (id + canonical_id) % 6 NOT IN (0, 1)"
)
def parse_keypoint_csv(spark: SparkSession, sf: str) -> DataFrame:
    """Cells with blanks and commas around parse; a bad number or a point at the origin is skipped."""
    k = F.col("id") + F.col("canonical_id")
    rows = long_points(spark, sf).select(
        "id",
        F.concat(F.lit(" "), F.col("canonical_id").cast("string"), F.lit(",")).alias("i"),
        F.when(k % 6 == 0, "x").when(k % 6 == 1, "0").otherwise(F.round("x", 6).cast("string")).alias("x"),
        F.when(k % 6 == 1, "0.0").otherwise(F.concat(F.round("y", 6).cast("string"), F.lit(", "))).alias("y"),
    )
    rows = rows.select("id", X.keypoint_row(F.col("i"), F.col("x"), F.rtrim("y")).alias("p")).filter("p is not null")
    return rows.select("id", "p.point_id", r6(F.col("p.x")).alias("x"), r6(F.col("p.y")).alias("y"))


@query()
def greedy_role_match(spark: SparkSession, sf: str) -> DataFrame:
    """Poses that are the points moved a little, against the points as pixels."""
    pose = F.transform("points", lambda p: F.struct(((p["x"] + 0.001) / 8).alias("x"), ((p["y"] - 0.002) / 8).alias("y"), F.lit(2).alias("v")))
    pixels = F.transform("points", lambda p: F.struct(p["canonical_id"].alias("point_id"), p["x"].alias("x"), p["y"].alias("y")))
    df = packed(spark, sf).select("id", F.inline(roles.greedy_match(pose, pixels, F.lit(8.0), F.lit(8.0), 0.05)))
    return df.select("id", "role_id", "source_id", r6(F.col("x")).alias("x"), r6(F.col("y")).alias("y"), r6(F.col("error_px")).alias("error_px"))


@query(
    f"WITH {LM} SELECT id, canonical_id::BIGINT AS point_id, CASE WHEN canonical_id >= 10 THEN 'scale_endpoint' WHEN canonical_id <= 8 AND (id + canonical_id) % 9 <> 0 THEN 'fish_landmark' ELSE 'unassigned_raw_point' END AS point_role, "
    "CASE WHEN canonical_id >= 10 THEN canonical_id - 9 WHEN canonical_id <= 8 AND (id + canonical_id) % 9 <> 0 THEN canonical_id END::INT AS role_point_id FROM lm"
)
def raw_role_tagging(spark: SparkSession, sf: str) -> DataFrame:
    p = long_points(spark, sf).select("id", F.col("canonical_id").cast("long").alias("point_id"))
    fish = p.filter("point_id <= 8 and (id + point_id) % 9 <> 0").select("id", F.col("point_id").alias("source_id"), F.col("point_id").cast("int").alias("role_id"))
    scale = p.filter("point_id >= 10").select("id", F.col("point_id").alias("source_id"), (F.col("point_id") - 9).cast("int").alias("role_id"))
    return roles.tag_raw_points(p, fish, scale).select("id", "point_id", "point_role", "role_point_id")


_BOXES = "bxs AS (SELECT id, id // 8 AS page, id % 2 AS block, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM lm GROUP BY id)"


@query(
    f"WITH {LM}, {_BOXES} SELECT a.page, a.id AS left_id, b.id AS right_id, {s6('least(a.x1, b.x1) - greatest(a.x0, b.x0)')} AS overlap_w, {s6('least(a.y1, b.y1) - greatest(a.y0, b.y0)')} AS overlap_h FROM bxs a JOIN bxs b ON a.page = b.page AND a.id < b.id AND a.block <> b.block "
    "WHERE least(a.x1, b.x1) - greatest(a.x0, b.x0) > 0.3 AND least(a.y1, b.y1) - greatest(a.y0, b.y0) > 0.3"
)
def box_overlap_pairs(spark: SparkSession, sf: str) -> DataFrame:
    p, x, y = F.col("points"), (lambda q: q["x"]), (lambda q: q["y"])
    b = packed(spark, sf).select(
        F.floor(F.col("id") / 8).alias("page"), "id", (F.col("id") % 2).alias("block"),
        G.least(p, x).alias("x0"), G.most(p, x).alias("x1"), G.least(p, y).alias("y0"), G.most(p, y).alias("y1"),
    )
    side = lambda s: b.select("page", *[F.col(c).alias(f"{s}_{c}") for c in b.columns if c != "page"])
    w = F.least("left_x1", "right_x1") - F.greatest("left_x0", "right_x0")
    h = F.least("left_y1", "right_y1") - F.greatest("left_y0", "right_y0")
    j = side("left").join(side("right"), "page").filter("left_id < right_id and left_block <> right_block").filter((w > 0.3) & (h > 0.3))
    return j.select("page", "left_id", "right_id", r6(w).alias("overlap_w"), r6(h).alias("overlap_h"))


def _unit(c: str) -> Column:
    """A coordinate of the carrier as a multiple of 1/256 from 0 to 1, which eight decimals hold exactly."""
    return F.round(F.least(F.greatest((F.col(c) if isinstance(c, str) else c) / 8 + 0.5, F.lit(0.0)), F.lit(1.0)) * 256, 0) / 256


_U = lambda c: f"round(least(greatest({c} / 8 + 0.5, 0), 1) * 256, 0) / 256"


@query(
    f"WITH {LM} SELECT id, '0 0.50000000 0.50000000 1.00000000 1.00000000 ' || string_agg(printf('%.8f %.8f 2', {_U('x')}, {_U('y')}), ' ' ORDER BY canonical_id) AS line FROM lm GROUP BY id"
)
def yolo_label_lines(spark: SparkSession, sf: str) -> DataFrame:
    unit = lambda c: F.round(F.least(F.greatest(c / 8 + 0.5, F.lit(0.0)), F.lit(1.0)) * 256, 0) / 256
    points = F.transform("points", lambda p: F.struct(unit(p["x"]).alias("x"), unit(p["y"]).alias("y")))
    box = [F.lit(v) for v in (0.5, 0.5, 1.0, 1.0)]
    return packed(spark, sf).select("id", X.label_line(0, box, points).alias("line"))


@query(
    f"WITH {LM}, n AS (SELECT label, id, row_number() OVER (PARTITION BY label ORDER BY id) AS annotation_id, count(*) AS num_keypoints, string_agg(CAST(CAST(round(x * 1000) AS BIGINT) AS VARCHAR) || ',' || CAST(CAST(round(y * 1000) AS BIGINT) AS VARCHAR) || ',2', ',' ORDER BY canonical_id) AS keypoints FROM lm GROUP BY label, id) "
    "SELECT label, id AS image_id, annotation_id::INT AS annotation_id, num_keypoints::INT AS num_keypoints, keypoints FROM n"
)
def coco_annotations(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    flat = F.array_join(F.transform("points", lambda p: F.concat_ws(",", F.round(p["x"] * 1000).cast("long"), F.round(p["y"] * 1000).cast("long"), F.lit(2))), ",")
    n = F.row_number().over(Window.partitionBy("label").orderBy("id"))
    return packed(spark, sf).select("label", F.col("id").alias("image_id"), n.alias("annotation_id"), F.size("points").alias("num_keypoints"), flat.alias("keypoints"))


@query("SELECT lang || CASE WHEN doc_id % 5 = 0 THEN '|test' ELSE '|train' END AS split, count(*)::BIGINT AS n, md5(string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id)) AS ids_md5 FROM documents GROUP BY 1")
def split_id_lists(spark: SparkSession, sf: str) -> DataFrame:
    """Sorted id lists by split, as a digest of the list that the sink writes."""
    split = F.concat("lang", F.when(F.col("doc_id") % 5 == 0, "|test").otherwise("|train"))
    d = table(spark, sf, "documents").select(split.alias("split"), "doc_id")
    ids = F.array_sort(F.collect_list("doc_id"))
    return d.groupBy("split").agg(F.count("*").alias("n"), F.md5(F.array_join(F.transform(ids, lambda i: i.cast("string")), ",")).alias("ids_md5"))


@query(
    f"WITH l AS (SELECT vec_id AS id, k - 1 AS i, exp(embedding[k]::DOUBLE) AS e FROM embeddings, range(1, 65) t(k)) SELECT id, {s6('sum(e * (i % 8)) / sum(e) / 7')} AS x, {s6('sum(e * (i // 8)) / sum(e) / 7')} AS y FROM l GROUP BY id"
)
def softmax_coordinates(spark: SparkSession, sf: str) -> DataFrame:
    """The vectors as 8 x 8 heat maps."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    p = e.select("id", tensors.softmax(F.col("embedding")).alias("p")).select("id", tensors.expected_coordinates(F.col("p"), 8).alias("c"))
    return p.select("id", r6(F.col("c.x")).alias("x"), r6(F.col("c.y")).alias("y"))


_GAUSS = f"gp AS (SELECT vec_id AS id, {_U('embedding[1]::DOUBLE')} AS x, {_U('embedding[2]::DOUBLE')} AS y FROM embeddings), gm AS (SELECT id, i, exp(-((i % 8 - x * 7) ** 2 + (i // 8 - y * 7) ** 2) / 8) AS e FROM gp, range(64) t(i))"


@query(f"WITH {_GAUSS} SELECT id, {s6('max(e) / sum(e)')} AS peak, {s6('sum(e * (i % 8)) / sum(e)')} AS mean_x, {s6('1.0')} AS total FROM gm GROUP BY id")
def gaussian_targets(spark: SparkSession, sf: str) -> DataFrame:
    unit = lambda k: _unit(F.get("embedding", F.lit(k)).cast("double"))
    g = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), tensors.gaussian_map(unit(0), unit(1), 8, 2.0).alias("g"))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    return g.select("id", r6(F.array_max("g")).alias("peak"), r6(total(F.transform("g", lambda v, i: v * (i % 8)))).alias("mean_x"), r6(total(F.col("g"))).alias("total"))


@query(
    f"WITH {LM}, sc AS (SELECT a.id, greatest(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), 1e-4) AS s FROM lm a JOIN lm b USING (id) WHERE a.canonical_id = 1 AND b.canonical_id = 6) SELECT a.id, a.canonical_id AS a, b.canonical_id AS b, {s6('sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) / s')} AS distance FROM lm a JOIN lm b ON a.id = b.id AND a.canonical_id < b.canonical_id JOIN sc ON sc.id = a.id"
)
def pairwise_distances(spark: SparkSession, sf: str) -> DataFrame:
    """All 55 distances of an entity over its axis length, without a join."""
    scale = F.greatest(G.chord(F.col("points"), 1, 6), F.lit(1e-4))
    first = packed(spark, sf).select("id", "points", scale.alias("s"), F.explode("points").alias("p"))
    both = first.select("id", "p", "s", F.explode("points").alias("q")).filter("p.canonical_id < q.canonical_id")
    return both.select("id", F.col("p.canonical_id").alias("a"), F.col("q.canonical_id").alias("b"), r6(G.distance(F.col("p"), F.col("q")) / F.col("s")).alias("distance"))


@query(
    f"WITH {LM}, d AS (SELECT lm.id, unnest([abs(lm.x - s.x), abs(lm.y - s.y)]) AS d FROM lm JOIN second s USING (id, canonical_id)) SELECT id, {s6('avg(CASE WHEN d < 0.02 THEN 0.5 * d * d / 0.02 ELSE d - 0.01 END)')} AS loss FROM d GROUP BY id"
)
def smooth_l1_loss(spark: SparkSession, sf: str) -> DataFrame:
    terms = F.zip_with("points", "second", lambda a, b: tensors.smooth_l1(a["x"], b["x"]) + tensors.smooth_l1(a["y"], b["y"]))
    return packed(spark, sf).select("id", r6(F.aggregate(terms, F.lit(0.0), lambda s, v: s + v) / 22).alias("loss"))


@query(
    f"WITH {_GAUSS}, lg AS (SELECT vec_id AS id, k - 1 AS i, embedding[k]::DOUBLE AS v FROM embeddings, range(1, 65) t(k)), nz AS (SELECT id, ln(sum(exp(v))) AS z FROM lg GROUP BY id), gs AS (SELECT id, sum(e) AS t FROM gm GROUP BY id) "
    f"SELECT gm.id, {s6('-sum(e / t * (v - z))')} AS loss FROM gm JOIN lg USING (id, i) JOIN nz USING (id) JOIN gs USING (id) GROUP BY gm.id"
)
def heatmap_cross_entropy(spark: SparkSession, sf: str) -> DataFrame:
    unit = lambda k: _unit(F.get("embedding", F.lit(k)).cast("double"))
    g = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding", tensors.gaussian_map(unit(0), unit(1), 8, 2.0).alias("g"))
    return g.select("id", r6(tensors.cross_entropy(F.col("g"), F.col("embedding"))).alias("loss"))




@query("SELECT (vec_id % 250)::BIGINT AS record_id, vec_id AS line_no, CASE WHEN rk = 1 THEN 'fish' ELSE 'scale' END AS row_kind FROM (SELECT *, row_number() OVER (PARTITION BY vec_id % 250 ORDER BY n DESC, area DESC, vec_id) AS rk FROM (SELECT vec_id, CASE vec_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE vec_id % 3 + 9 END AS n, (vec_id % 10)::DOUBLE AS area FROM embeddings)) q WHERE (rk = 1 AND n >= 10) OR (rk > 1 AND n BETWEEN 1 AND 2 AND rk = (SELECT min(rk) FROM (SELECT vec_id, row_number() OVER (PARTITION BY vec_id % 250 ORDER BY CASE vec_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE vec_id % 3 + 9 END DESC, (vec_id % 10)::DOUBLE DESC, vec_id) AS rk, CASE vec_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE vec_id % 3 + 9 END AS n FROM embeddings) z WHERE z.vec_id % 250 = q.vec_id % 250 AND z.rk > 1 AND z.n BETWEEN 1 AND 2))")
def pose_row_selection(spark: SparkSession, sf: str) -> DataFrame:
    """The fish row and the scale row of each record among its pose lines."""
    v = F.col("vec_id")
    n = F.when(v % 4 == 0, 1).when(v % 4 == 1, 2).otherwise(v % 3 + 9)
    rows = table(spark, sf, "embeddings").select((v % 250).alias("record_id"), v.alias("line_no"), n.alias("n_points"), (v % 10).cast("double").alias("bbox_w"), F.lit(1.0).alias("bbox_h"))
    return roles.pick_rows(rows).select("record_id", "line_no", "row_kind")


@query("WITH p AS (SELECT doc_id, md5(text) AS content_id FROM documents WHERE doc_id % 3 <> 0) SELECT d.doc_id, coalesce(p.content_id, md5(d.text)) AS content_id, p.doc_id IS NOT NULL AS reused FROM documents d LEFT JOIN p ON p.doc_id = d.doc_id")
def incremental_cache_join(spark: SparkSession, sf: str) -> DataFrame:
    """Digests known from a prior snapshot are reused; only rows without one are digested."""
    d = table(spark, sf, "documents").select("doc_id", "text")
    prior = d.filter("doc_id % 3 <> 0").select("doc_id", F.md5("text").alias("content_id"))
    known = d.select("doc_id").join(prior, "doc_id").withColumn("reused", F.lit(True))
    new = d.join(prior.select("doc_id"), "doc_id", "left_anti").select("doc_id", F.md5("text").alias("content_id"), F.lit(False).alias("reused"))
    return known.unionByName(new)


@query("SELECT url, regexp_replace(regexp_extract(url, '[^/]*$'), '\\.[^.]*$', '') AS stem, regexp_replace(url, '^[a-z]+://[^/]*/', '') AS relative, starts_with(url, 'https://') AS secure FROM pages")
def suffix_and_stem(spark: SparkSession, sf: str) -> DataFrame:
    stem = F.regexp_replace(F.regexp_extract("url", "[^/]*$", 0), r"\.[^.]*$", "")
    return table(spark, sf, "pages").select("url", stem.alias("stem"), F.regexp_replace("url", "^[a-z]+://[^/]*/", "").alias("relative"), F.startswith("url", F.lit("https://")).alias("secure"))


@query(f"WITH {LM} SELECT id, canonical_id, 'Locate the ' || CASE canonical_id " + " ".join(f"WHEN {k} THEN '{n.replace('_', ' ')}'" for k, n in enumerate(roles.LANDMARKS, 1)) + " END || ' in image ' || id || '.' AS prompt FROM lm")
def prompt_expansion(spark: SparkSession, sf: str) -> DataFrame:
    """A template filled for every image and role; roles come from an array, so there is no join."""
    names = F.array(*[F.lit(n.replace("_", " ")) for n in roles.LANDMARKS])
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.posexplode(names).alias("k", "name"))
    filled = F.replace(F.replace(F.lit("Locate the {role} in image {id}."), F.lit("{role}"), F.col("name")), F.lit("{id}"), F.col("id").cast("string"))
    return e.select("id", (F.col("k") + 1).alias("canonical_id"), filled.alias("prompt"))


@query("SELECT doc_id, length(text)::BIGINT AS chars, octet_length(encode(text))::BIGINT AS bytes FROM documents")
def bytes_decode(spark: SparkSession, sf: str) -> DataFrame:
    """Bytes that may end in NULs, decoded."""
    raw = F.concat(F.encode("text", "UTF-8"), F.unhex(F.lit("0000")))
    clean = F.rtrim(F.decode(raw, "UTF-8"), F.lit("\x00"))
    d = table(spark, sf, "documents").select("doc_id", clean.alias("t"))
    return d.select("doc_id", F.char_length("t").cast("long").alias("chars"), F.octet_length("t").cast("long").alias("bytes"))


@query("SELECT p_partkey, p_name FROM part WHERE starts_with(p_name, 'part 1') OR starts_with(p_name, 'Part#1') OR starts_with(p_name, 's')")
def prefix_filter(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("p_name")
    return table(spark, sf, "part").filter(n.startswith("part 1") | n.startswith("Part#1") | n.startswith("s")).select("p_partkey", "p_name")


@query("SELECT dedup_key, count(*)::BIGINT AS n FROM (SELECT substr(md5(text), 1, 2) AS dedup_key FROM documents) GROUP BY 1")
def keyed_streaming_count(spark: SparkSession, sf: str) -> DataFrame:
    """One pass over records, counted by key."""
    return table(spark, sf, "documents").groupBy(F.substring(F.md5("text"), 1, 2).alias("dedup_key")).agg(F.count("*").alias("n"))


