"""Relational primitives: filters, joins, aggregates, windows, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions import geometry as G
from plumbline.functions import stats
from plumbline.functions import text as X
from plumbline.operators import dedup, relational
from plumbline.plans.base import LM, long_points, packed, query, r6, s6, table


@query(f"SELECT event_type, count(*)::BIGINT AS n, {s6('min(value)')} AS minimum, {s6('quantile_cont(value, 0.25)')} AS q1, {s6('quantile_cont(value, 0.5)')} AS median, {s6('quantile_cont(value, 0.75)')} AS q3, {s6('max(value)')} AS maximum FROM events GROUP BY event_type")
def five_number_summary(spark: SparkSession, sf: str) -> DataFrame:
    return relational.five_numbers(table(spark, sf, "events"), ["event_type"], "value")


@query("SELECT quality, count(*)::BIGINT AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY quality")
def value_counts_nulls(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    return d.groupBy("quality").agg(F.count("*").alias("n"))


@query(f"SELECT event_type, {s6('quantile_cont(m, 0.5)')} AS median_of_means, count(*)::BIGINT AS users FROM (SELECT event_type, user_id, avg(value) AS m FROM events GROUP BY ALL) GROUP BY event_type")
def two_level_median(spark: SparkSession, sf: str) -> DataFrame:
    m = table(spark, sf, "events").groupBy("event_type", "user_id").agg(F.avg("value").alias("m"))
    return m.groupBy("event_type").agg(r6(F.percentile("m", F.lit(0.5))).alias("median_of_means"), F.count("*").alias("users"))


_STAGES = {"1_source": "TRUE", "2_with_label": "quality IS NOT NULL", "3_good": "quality = 1", "4_clean": "quality = 1 AND toxic = 0", "5_long": "quality = 1 AND toxic = 0 AND n_chars >= 1000"}


@query(
    "WITH j AS (SELECT d.*, quality, toxic FROM documents d LEFT JOIN labels USING (doc_id)), c AS ("
    + " UNION ALL ".join(f"SELECT '{k}' AS stage, count(*) FILTER ({v})::BIGINT AS n FROM j" for k, v in _STAGES.items())
    + ") SELECT stage, n, coalesce(lag(n) OVER (ORDER BY stage) - n, 0)::BIGINT AS excluded_from_previous FROM c"
)
def curation_funnel(spark: SparkSession, sf: str) -> DataFrame:
    """All stages in one conditional aggregate; the deltas come from one row."""
    j = table(spark, sf, "documents").select("doc_id", "n_chars").join(table(spark, sf, "labels"), "doc_id", "left")
    return relational.funnel(j, {k: F.expr(v) for k, v in _STAGES.items()})


_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*)::BIGINT AS n FROM {t}" for t in _TABLES))
def table_catalogue(spark: SparkSession, sf: str) -> DataFrame:
    counts = [table(spark, sf, t).agg(F.lit(t).alias("table_name"), F.count("*").alias("n")) for t in _TABLES]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


_FLAGS = "f AS (SELECT coalesce(quality = 0, FALSE) AS low, coalesce(toxic = 1, FALSE) AS toxic, n_chars > 5000 AS long FROM documents LEFT JOIN labels USING (doc_id))"


@query(f"WITH {_FLAGS} SELECT low, toxic, long, count(*)::BIGINT AS n FROM f GROUP BY ALL")
def flag_intersections(spark: SparkSession, sf: str) -> DataFrame:
    j = table(spark, sf, "documents").select("doc_id", "n_chars").join(table(spark, sf, "labels"), "doc_id", "left")
    no = F.lit(False)
    f = j.select(F.coalesce(F.col("quality") == 0, no).alias("low"), F.coalesce(F.col("toxic") == 1, no).alias("toxic"), (F.col("n_chars") > 5000).alias("long"))
    return f.groupBy("low", "toxic", "long").agg(F.count("*").alias("n"))


@query("SELECT lang, count(*) FILTER (quality = 0)::BIGINT AS low, count(*) FILTER (quality = 1)::BIGINT AS good, count(*) FILTER (quality IS NULL)::BIGINT AS unlabelled, count(*)::BIGINT AS total FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang")
def outcome_crosstab(spark: SparkSession, sf: str) -> DataFrame:
    j = table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    outcome = F.when(F.col("quality") == 0, "low").when(F.col("quality") == 1, "good").otherwise("unlabelled")
    p = j.withColumn("o", outcome).groupBy("lang").pivot("o", ["low", "good", "unlabelled"])
    out = p.count().na.fill(0, ["low", "good", "unlabelled"])
    return out.withColumn("total", F.col("low") + F.col("good") + F.col("unlabelled"))


@query("SELECT roles, count(*)::BIGINT AS n FROM (SELECT conv_id, string_agg(DISTINCT role, '|' ORDER BY role) AS roles FROM conversations GROUP BY conv_id) GROUP BY roles")
def label_set_frequency(spark: SparkSession, sf: str) -> DataFrame:
    sets = table(spark, sf, "conversations").groupBy("conv_id").agg(dedup.piped("role").alias("roles"))
    return sets.groupBy("roles").agg(F.count("*").alias("n"))


@query("SELECT source AS value, 'good_only' AS side FROM (SELECT source FROM documents JOIN labels USING (doc_id) WHERE quality = 1 EXCEPT SELECT source FROM documents JOIN labels USING (doc_id) WHERE toxic = 1) UNION ALL SELECT source, 'both' FROM (SELECT source FROM documents JOIN labels USING (doc_id) WHERE quality = 1 INTERSECT SELECT source FROM documents JOIN labels USING (doc_id) WHERE toxic = 1)")
def vocabulary_diff(spark: SparkSession, sf: str) -> DataFrame:
    j = table(spark, sf, "documents").select("doc_id", "source").join(table(spark, sf, "labels"), "doc_id")
    good, toxic = j.filter("quality = 1").select("source"), j.filter("toxic = 1").select("source")
    side = lambda df, s: df.select(F.col("source").alias("value"), F.lit(s).alias("side"))
    return side(good.subtract(toxic), "good_only").unionByName(side(good.intersect(toxic), "both"))


@query("SELECT conv_id, " + ", ".join(f"max((turn = {k})::INT)::INT AS turn_{k}" for k in range(6)) + " FROM conversations GROUP BY conv_id")
def completeness_matrix(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "conversations").groupBy("conv_id").pivot("turn", list(range(6))).agg(F.lit(1))
    return p.select("conv_id", *[F.coalesce(F.col(str(k)), F.lit(0)).alias(f"turn_{k}") for k in range(6)])


@query("SELECT conv_id, bool_and(length(text) > 50) AS all_long, bool_or(role = 'system') AS has_system, count(*)::BIGINT AS n FROM conversations GROUP BY conv_id")
def all_roles_complete(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").groupBy("conv_id").agg(
        F.bool_and(F.char_length("text") > 50).alias("all_long"), F.bool_or(F.col("role") == "system").alias("has_system"), F.count("*").alias("n")
    )


@query("SELECT n_nationkey, n_name, r_name FROM nation LEFT JOIN region ON n_regionkey = r_regionkey")
def one_to_one_left_join(spark: SparkSession, sf: str) -> DataFrame:
    """A left join that fails if the right keys aren't unique."""
    n = table(spark, sf, "nation").select("n_nationkey", "n_name", F.col("n_regionkey").alias("r_regionkey"))
    r = table(spark, sf, "region").select("r_regionkey", "r_name")
    return relational.join_unique(n, r, "r_regionkey").select("n_nationkey", "n_name", "r_name")


@query("SELECT n_name, coalesce(CASE WHEN r_regionkey <> 2 THEN r_name END, 'unmapped') AS region_name FROM nation LEFT JOIN region ON n_regionkey = r_regionkey")
def lookup_default(spark: SparkSession, sf: str) -> DataFrame:
    r = table(spark, sf, "region").filter("r_regionkey <> 2").select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("region_name"))
    j = table(spark, sf, "nation").select("n_name", "n_regionkey").join(r, "n_regionkey", "left")
    return j.select("n_name", F.coalesce("region_name", F.lit("unmapped")).alias("region_name"))


@query("SELECT n_nationkey, n_name, 'kept' AS origin FROM nation WHERE n_regionkey <> 1 UNION ALL SELECT n_nationkey + 100, upper(n_name), 'replaced' FROM nation WHERE n_regionkey = 1")
def replace_partition_union(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey")
    new = n.filter("n_regionkey = 1").select((F.col("n_nationkey") + 100).alias("n_nationkey"), F.upper("n_name").alias("n_name"), "n_regionkey")
    out = relational.replace_partition(n.withColumn("origin", F.lit("kept")), new.withColumn("origin", F.lit("replaced")), F.col("n_regionkey") == 1)
    return out.select("n_nationkey", "n_name", "origin")


@query("SELECT CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderpriority END AS priority, count(*)::BIGINT AS n FROM orders GROUP BY 1")
def group_count_null_key(spark: SparkSession, sf: str) -> DataFrame:
    p = F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderpriority"))
    return table(spark, sf, "orders").groupBy(p.alias("priority")).agg(F.count("*").alias("n"))


@query("SELECT count(DISTINCT quality)::BIGINT AS qualities, count(DISTINCT lang)::BIGINT AS langs, count(DISTINCT source)::BIGINT AS sources, count(*)::BIGINT AS n FROM documents LEFT JOIN labels USING (doc_id)")
def distinct_counts(spark: SparkSession, sf: str) -> DataFrame:
    j = table(spark, sf, "documents").select("doc_id", "lang", "source").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    return j.agg(F.countDistinct("quality").alias("qualities"), F.countDistinct("lang").alias("langs"), F.countDistinct("source").alias("sources"), F.count("*").alias("n"))


@query("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def distinct_sorted_list(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderstatus", "o_orderpriority").distinct().orderBy("o_orderstatus", "o_orderpriority")


@query("SELECT event_type, " + ", ".join(f"{s6(f'quantile_cont(value, {q})')} AS q{round(q * 1000):03d}" for q in (0.025, 0.1, 0.5, 0.9, 0.975)) + " FROM events GROUP BY event_type")
def exact_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    qs = (0.025, 0.1, 0.5, 0.9, 0.975)
    g = table(spark, sf, "events").groupBy("event_type").agg(F.percentile("value", F.array(*map(F.lit, qs))).alias("p"))
    return g.select("event_type", *[r6(F.get("p", F.lit(i))).alias(f"q{round(q * 1000):03d}") for i, q in enumerate(qs)])


@query(f"WITH {LM} SELECT id, " + ", ".join(f"{s6(f'max(x) FILTER (canonical_id = {k})')} AS x_{k}" for k in range(1, 12)) + " FROM lm GROUP BY id")
def pivot_points(spark: SparkSession, sf: str) -> DataFrame:
    p = long_points(spark, sf).groupBy("id").pivot("canonical_id", list(range(1, 12))).agg(F.first("x"))
    return p.select("id", *[r6(F.col(str(k))).alias(f"x_{k}") for k in range(1, 12)])


@query("SELECT count(*)::BIGINT AS records, count(DISTINCT md5(text))::BIGINT AS distinct_contents, count(*) FILTER (length(text) = 0)::BIGINT AS empty, min(n_chars) AS shortest, max(n_chars) AS longest, count(DISTINCT source)::BIGINT AS sources FROM documents")
def audit_summary_row(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select(F.md5("text").alias("m"), F.char_length("text").alias("n"), "n_chars", "source")
    return d.agg(
        F.count("*").alias("records"), F.countDistinct("m").alias("distinct_contents"), F.count(F.when(F.col("n") == 0, 1)).alias("empty"),
        F.min("n_chars").alias("shortest"), F.max("n_chars").alias("longest"), F.countDistinct("source").alias("sources"),
    )


@query("WITH b AS (SELECT source FROM documents JOIN labels USING (doc_id) GROUP BY source HAVING bool_or(quality = 0) AND bool_or(quality = 1)) SELECT doc_id, source FROM documents WHERE source IN (SELECT source FROM b)")
def both_classes_semi_join(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "source")
    g = d.join(table(spark, sf, "labels"), "doc_id").groupBy("source").agg(F.bool_or(F.col("quality") == 0).alias("bad"), F.bool_or(F.col("quality") == 1).alias("good"))
    return d.join(g.filter("bad and good"), "source", "left_semi").select("doc_id", "source")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_acctbal > 0 AND c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey NOT IN (3, 4, 5) AND c_name IS NOT NULL")
def eligibility_filter(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    ok = (c("c_acctbal") > 0) & c("c_mktsegment").isin("BUILDING", "MACHINERY") & ~c("c_nationkey").isin(3, 4, 5) & c("c_name").isNotNull()
    return table(spark, sf, "customer").filter(ok).select("c_custkey", "c_mktsegment")


@query(f"WITH {LM}, ok AS (SELECT id, list(canonical_id) FILTER (x > -0.2) AS ks FROM lm GROUP BY id) SELECT id, len(coalesce(ks, []))::INT AS n, len(list_filter(coalesce(ks, []), lambda k: k <= 10)) = 10 AS complete_1_to_10, len(coalesce(ks, [])) = 11 AS complete_1_to_11, list_contains(coalesce(ks, []), 1) AND list_contains(coalesce(ks, []), 6) AS has_axis FROM ok")
def completeness_flags(spark: SparkSession, sf: str) -> DataFrame:
    ks = F.transform(F.filter("points", lambda p: p["x"] > -0.2), lambda p: p["canonical_id"])
    d = packed(spark, sf).select("id", ks.alias("ks"))
    missing = lambda n: F.size(F.array_except(F.sequence(F.lit(1), F.lit(n)), F.col("ks"))) == 0
    axis = F.array_contains("ks", 1) & F.array_contains("ks", 6)
    return d.select("id", F.size("ks").alias("n"), missing(10).alias("complete_1_to_10"), missing(11).alias("complete_1_to_11"), axis.alias("has_axis"))


@query("SELECT doc_id, lower(trim(CASE doc_id % 5 WHEN 0 THEN 'True' WHEN 1 THEN ' yes ' WHEN 2 THEN '0' WHEN 3 THEN 'False' END)) IN ('true', '1', 'yes') AS flag FROM documents")
def tolerant_bool(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("doc_id") % 5
    said = F.when(k == 0, "True").when(k == 1, " yes ").when(k == 2, "0").when(k == 3, "False")
    return table(spark, sf, "documents").select("doc_id", X.tolerant_bool(said).alias("flag"))


@query("SELECT event_id FROM (SELECT event_id, CASE event_id % 10 WHEN 0 THEN 'nan'::DOUBLE WHEN 1 THEN 'inf'::DOUBLE WHEN 2 THEN NULL ELSE value END AS v FROM events) WHERE v IS NOT NULL AND isfinite(v)")
def finite_filter(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("event_id") % 10
    v = F.when(k == 0, F.lit(float("nan"))).when(k == 1, F.lit(float("inf"))).when(k == 2, F.lit(None)).otherwise(F.col("value"))
    return table(spark, sf, "events").select("event_id", v.cast("double").alias("v")).filter(stats.finite(F.col("v"))).select("event_id")


@query("SELECT page_id, contains(html, '<table') AS has_table, contains(html, '<script') AS has_script, contains(html, 'a_b%c') AS has_literal FROM pages")
def substring_flag(spark: SparkSession, sf: str) -> DataFrame:
    has = lambda s: F.col("html").contains(s)
    return table(spark, sf, "pages").select("page_id", has("<table").alias("has_table"), has("<script").alias("has_script"), has("a_b%c").alias("has_literal"))


@query("SELECT 'documents_unique' AS invariant, 0::BIGINT AS violations UNION ALL SELECT 'eleven_points', 0 UNION ALL SELECT 'labels_known', (SELECT count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents))::BIGINT UNION ALL SELECT 'split_shares_sum_to_one', 0")
def invariant_violations(spark: SparkSession, sf: str) -> DataFrame:
    """Violations of contracts, counted; all are 0 in a sound table."""
    d = table(spark, sf, "documents").select("doc_id")
    twice = d.groupBy("doc_id").count().filter("count > 1")
    points = long_points(spark, sf).groupBy("id").count().filter("count <> 11")
    stray = table(spark, sf, "labels").join(d, "doc_id", "left_anti")
    checks = {"documents_unique": twice, "eleven_points": points, "labels_known": stray}
    rows = [df.agg(F.lit(n).alias("invariant"), F.count("*").alias("violations")) for n, df in checks.items()]
    shares = (F.abs(F.lit(0.7) + F.lit(0.15) + F.lit(0.15) - 1) > 1e-9).cast("long")
    rows.append(spark.range(1).select(F.lit("split_shares_sum_to_one").alias("invariant"), shares.alias("violations")))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


@query(f"WITH {LM} SELECT lm.id, canonical_id, label, {s6('x - m')} AS x_from_mean FROM lm LEFT JOIN (SELECT id, avg(x) AS m FROM lm GROUP BY id) USING (id)")
def left_join_axis(spark: SparkSession, sf: str) -> DataFrame:
    means = packed(spark, sf).select("id", (G.total(F.col("points"), lambda p: p["x"]) / 11).alias("m"))
    j = long_points(spark, sf).join(means, "id", "left")
    return j.select("id", "canonical_id", "label", r6(F.col("x") - F.col("m")).alias("x_from_mean"))


@query(f"WITH {LM} SELECT lm.id, canonical_id, {s6('lm.x')} AS x, {s6('s.x')} AS x_second FROM lm LEFT JOIN second s USING (id, canonical_id)")
def two_key_join(spark: SparkSession, sf: str) -> DataFrame:
    a = long_points(spark, sf).select("id", "canonical_id", "x")
    b = long_points(spark, sf, "second").select("id", "canonical_id", F.col("x").alias("x_second"))
    return a.join(b, ["id", "canonical_id"], "left").select("id", "canonical_id", r6(F.col("x")).alias("x"), r6(F.col("x_second")).alias("x_second"))


_SQL = "SELECT c.c_mktsegment, o.o_orderpriority, count(*) AS n FROM {c} c JOIN {o} o ON c.c_custkey = o.o_custkey WHERE o.o_orderstatus = {s} GROUP BY c.c_mktsegment, o.o_orderpriority"


@query(_SQL.format(c="customer", o="orders", s="'F'").replace("count(*)", "count(*)::BIGINT"))
def inner_join_sql(spark: SparkSession, sf: str) -> DataFrame:
    """SQL text with named parameters over frames."""
    return spark.sql(_SQL.format(c="{c}", o="{o}", s=":status"), args={"status": "F"}, c=table(spark, sf, "customer"), o=table(spark, sf, "orders"))


@query("SELECT pos::INT AS pos, c_custkey, c_name FROM (VALUES (0, 9), (1, 3), (2, 77), (3, 5)) v(pos, k) JOIN customer ON c_custkey = k")
def ordered_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Rows for a list of ids in the list's order; an unknown id is an error."""
    return relational.ordered_lookup(table(spark, sf, "customer").select("c_custkey", "c_name"), "c_custkey", [9, 3, 77, 5])


@query("SELECT r_regionkey, r_name, 'provisional' AS status, length(r_name)::INT AS name_length, NULL::DOUBLE AS scale_length FROM region")
def computed_and_status_columns(spark: SparkSession, sf: str) -> DataFrame:
    r = table(spark, sf, "region").select("r_regionkey", "r_name")
    return r.withColumns({"status": F.lit("provisional"), "name_length": F.char_length("r_name"), "scale_length": F.lit(None).cast("double")})


@query("SELECT n_name, coalesce(CASE n_regionkey WHEN 0 THEN 'south' WHEN 1 THEN 'west' END, 'elsewhere') AS side FROM nation")
def recode_default(spark: SparkSession, sf: str) -> DataFrame:
    codes = F.create_map(F.lit(0), F.lit("south"), F.lit(1), F.lit("west"))
    return table(spark, sf, "nation").select("n_name", F.coalesce(F.try_element_at(codes, F.col("n_regionkey").cast("int")), F.lit("elsewhere")).alias("side"))


@query("SELECT c_custkey, c_mktsegment || '|' || CASE WHEN c_nationkey > 10 THEN NULL ELSE c_nationkey::VARCHAR END AS stratum FROM customer")
def composite_key(spark: SparkSession, sf: str) -> DataFrame:
    part = F.when(F.col("c_nationkey") <= 10, F.col("c_nationkey").cast("string"))
    return table(spark, sf, "customer").select("c_custkey", F.concat("c_mktsegment", F.lit("|"), part).alias("stratum"))


@query("SELECT n_nationkey, CASE n_regionkey WHEN 0 THEN 'F ' WHEN 1 THEN 'W ' WHEN 2 THEN 'C ' ELSE '? ' END || upper(substr(n_name, 1, 3)) AS display FROM nation")
def display_label(spark: SparkSession, sf: str) -> DataFrame:
    mark = F.when(F.col("n_regionkey") == 0, "F ").when(F.col("n_regionkey") == 1, "W ").when(F.col("n_regionkey") == 2, "C ").otherwise("? ")
    return table(spark, sf, "nation").select("n_nationkey", F.concat(mark, F.upper(F.substring("n_name", 1, 3))).alias("display"))


@query("SELECT n_nationkey, replace(replace(lower(n_name || ' Sp. A'), ' ', '_'), '.', '') AS slug FROM nation")
def slug(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "nation").select("n_nationkey", X.slug(F.concat("n_name", F.lit(" Sp. A"))).alias("slug"))


@query("SELECT CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'low' ELSE 'high' END AS bracket, count(*)::BIGINT AS n FROM customer GROUP BY 1")
def case_group(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql("SELECT CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'low' ELSE 'high' END AS bracket, count(*) AS n FROM {c} GROUP BY bracket", c=table(spark, sf, "customer"))


@query("SELECT n_name AS name, n_regionkey::BIGINT AS parent, NULL::VARCHAR AS comment FROM nation UNION ALL SELECT r_name, NULL, 'region' FROM region")
def union_by_name(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").cast("long").alias("parent"))
    return n.unionByName(table(spark, sf, "region").select(F.col("r_name").alias("name"), F.lit("region").alias("comment")), allowMissingColumns=True)


@query("WITH a AS (SELECT n_nationkey, 'first' AS panel FROM nation WHERE n_regionkey IN (0, 1)), b AS (SELECT n_nationkey, 'second' AS panel FROM nation WHERE n_regionkey IN (1, 2) AND n_nationkey NOT IN (SELECT n_nationkey FROM a)), c AS (SELECT n_nationkey, 'third' AS panel FROM nation WHERE n_nationkey NOT IN (SELECT n_nationkey FROM a) AND n_nationkey NOT IN (SELECT n_nationkey FROM b)) SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c")
def exclusive_reservation(spark: SparkSession, sf: str) -> DataFrame:
    """Each panel takes what no panel before it has taken: the first that matches."""
    n, key = table(spark, sf, "nation").select("n_nationkey", "n_regionkey"), F.col("n_regionkey")
    panels = {"first": key.isin(0, 1), "second": key.isin(1, 2), "third": F.lit(True)}
    return n.select("n_nationkey", relational.first_match(panels).alias("panel")).filter("panel is not null")


@query("SELECT stage, (sum(n) OVER (ORDER BY stage) - n)::BIGINT AS lower_end, (sum(n) OVER (ORDER BY stage))::BIGINT AS upper_end FROM (SELECT o_orderpriority AS stage, count(*) AS n FROM orders GROUP BY 1)")
def cumulative_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """The window runs over one row for each group."""
    g = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("stage")).agg(F.count("*").alias("n"))
    upper = F.sum("n").over(Window.orderBy("stage"))
    return g.select("stage", (upper - F.col("n")).alias("lower_end"), upper.alias("upper_end"))


@query(f"SELECT o_orderkey, o_orderpriority, {s6('o_totalprice')} AS o_totalprice FROM orders ORDER BY o_orderpriority, round(o_totalprice, 6) DESC, o_orderkey LIMIT 25")
def multi_key_sort_topk(spark: SparkSession, sf: str) -> DataFrame:
    """A top-k report: mixed directions with a unique tie-break."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", r6(F.col("o_totalprice")).alias("o_totalprice"))
    return o.orderBy("o_orderpriority", F.desc("o_totalprice"), "o_orderkey").limit(25)


@query(f"SELECT l_orderkey, l_linenumber, {s6('l_extendedprice')} AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS k FROM lineitem) WHERE k = 1")
def best_instance(spark: SparkSession, sf: str) -> DataFrame:
    """The instance of highest confidence, the first of equals: one aggregate with map-side combine."""
    best = F.max_by(F.struct("l_linenumber", "l_extendedprice"), F.struct("l_extendedprice", -F.col("l_linenumber")))
    g = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(best.alias("b"))
    return g.select("l_orderkey", "b.l_linenumber", r6(F.col("b.l_extendedprice")).alias("confidence"))


@query("SELECT c_mktsegment, k::INT AS place, c_custkey FROM (SELECT c_mktsegment, c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) - 1 AS k FROM customer) WHERE k IN (0, 42, 84)")
def fixed_index_sample(spark: SparkSession, sf: str) -> DataFrame:
    """Rows at fixed places of each group."""
    place = F.row_number().over(Window.partitionBy("c_mktsegment").orderBy("c_custkey")) - 1
    return table(spark, sf, "customer").select("c_mktsegment", place.alias("place"), "c_custkey").filter(F.col("place").isin(0, 42, 84))


@query("SELECT role, count(*)::BIGINT AS n, count(DISTINCT conv_id)::BIGINT AS conversations, count(*) FILTER (text IS NULL)::BIGINT AS missing, min(length(text))::BIGINT AS shortest, max(length(text))::BIGINT AS longest FROM conversations GROUP BY role")
def external_audit_counts(spark: SparkSession, sf: str) -> DataFrame:
    n = F.char_length("text").cast("long")
    return table(spark, sf, "conversations").groupBy("role").agg(
        F.count("*").alias("n"), F.countDistinct("conv_id").alias("conversations"), F.count(F.when(F.col("text").isNull(), 1)).alias("missing"), F.min(n).alias("shortest"), F.max(n).alias("longest")
    )


@query("SELECT n, count(*)::BIGINT AS conversations FROM (SELECT count(*)::BIGINT AS n FROM conversations GROUP BY conv_id) GROUP BY n")
def rows_per_record_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").groupBy("conv_id").agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("conversations"))
