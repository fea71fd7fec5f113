"""Per-position vector functions."""

from pyspark.sql import functions as F

from sitewise.catalog.registry import query
from sitewise.catalog.standins import VECTORS_SQL, r6, vectors
from sitewise.functions import vectors as V
from sitewise.operators.aggregates import vector_profile
from sitewise.operators.matching import eligible_positions, match_greedy, match_nearest, pair_differences
from sitewise.sources.readers import select_vectors, with_array_column

_PIVOT = """
s AS (SELECT vec_id, any_value(label) AS label, any_value(c) AS c, 64 AS n,
  count(v) FILTER (p BETWEEN c - 10 AND c - 1) AS lc, count(v) FILTER (p BETWEEN c + 1 AND c + 10) AS rc,
  avg(v) FILTER (p BETWEEN c - 10 AND c - 1) AS lm, avg(v) FILTER (p BETWEEN c + 1 AND c + 10) AS rm,
  avg(v) FILTER (p BETWEEN c - 10 AND c + 10 AND p <> c) AS fm
  FROM vl GROUP BY vec_id)"""


@query("flank_coverage", f"""
WITH {VECTORS_SQL}, {_PIVOT}
SELECT CAST(vec_id AS BIGINT) AS vec_id, round(CASE WHEN c > 10 THEN lc / 10 END, 6) AS cov_left,
  round(CASE WHEN c + 10 <= n THEN rc / 10 END, 6) AS cov_right,
  round(CASE WHEN c > 10 AND c + 10 <= n THEN (lc + rc) / 20 END, 6) AS cov_both,
  c > 10 AND c + 10 <= n AND lc >= 7 AND rc >= 7 AS main_window_valid FROM s""")
def _(t):
    v, c = F.col("values"), F.col("c").cast("int")
    left, right, both = V.flank_coverage(v, c, 10)
    return vectors(t).select("vec_id", r6(left).alias("cov_left"), r6(right).alias("cov_right"), r6(both).alias("cov_both"),
                             V.main_window_valid(v, c, 10, 0.7).alias("main_window_valid"))


@query("flank_coverage_zero_filled", f"""
WITH {VECTORS_SQL}, {_PIVOT}
SELECT CAST(vec_id AS BIGINT) AS vec_id, round(CASE WHEN c > 10 THEN lc / 10 ELSE 0 END, 6) AS cov_left,
  round(CASE WHEN c + 10 <= n THEN rc / 10 ELSE 0 END, 6) AS cov_right,
  round((CASE WHEN c > 10 THEN lc ELSE 0 END + rc) / 20, 6) AS cov_both FROM s""")
def _(t):
    left, right, both = V.flank_coverage_zero(F.col("values"), F.col("c").cast("int"), 10)
    return vectors(t).select("vec_id", r6(left).alias("cov_left"), r6(right).alias("cov_right"), r6(both).alias("cov_both"))


@query("flank_means", f"""
WITH {VECTORS_SQL}, {_PIVOT}
SELECT CAST(vec_id AS BIGINT) AS vec_id, round(lm, 7) AS mean_up, round(rm, 7) AS mean_down, round(fm, 7) AS mean_flank FROM s""")
def _(t):
    v, c = F.col("values"), F.col("c").cast("int")
    return vectors(t).select(
        "vec_id", r6(V.valid_mean(V.left_flank(v, c, 10), None), 7).alias("mean_up"),
        r6(V.valid_mean(V.right_flank(v, c, 10), None), 7).alias("mean_down"), r6(V.flank_mean(v, c, 10, None), 7).alias("mean_flank"))


@query("window_vectors", f"""
WITH {VECTORS_SQL}
SELECT CAST(e.vec_id AS BIGINT) AS vec_id, CAST(o.rel AS BIGINT) AS rel, round(v, 6) AS value, CAST(CASE WHEN v IS NULL THEN 0 ELSE 1 END AS BIGINT) AS mask
FROM (SELECT DISTINCT vec_id, c FROM vl) e CROSS JOIN range(-20, 21) o(rel) LEFT JOIN vl ON vl.vec_id = e.vec_id AND vl.p = e.c + o.rel""")
def _(t):
    w = vectors(t).withColumn("w", V.window_vector(F.col("values"), F.col("c"), 20))
    long = w.select("vec_id", F.posexplode(F.arrays_zip("w", V.mask_of(F.col("w")).alias("m"))).alias("i", "z"))
    return long.select("vec_id", (F.col("i") - 20).cast("long").alias("rel"), (F.col("z.w") + 0.0).alias("value"),
                       F.col("z.m").cast("long").alias("mask"))


@query("centre_excluded_means", f"""
WITH {VECTORS_SQL}, x AS (SELECT vec_id, count(v) FILTER (p BETWEEN c - 10 AND c - 3) AS lc, count(v) FILTER (p BETWEEN c + 3 AND c + 10) AS rc,
  avg(round(v, 6)) FILTER (p BETWEEN c - 10 AND c - 3 OR p BETWEEN c + 3 AND c + 10) AS m FROM vl GROUP BY vec_id)
SELECT CAST(vec_id AS BIGINT) AS vec_id, lc / 8 >= 0.7 AND rc / 8 >= 0.7 AS ok, round(CASE WHEN lc / 8 >= 0.7 AND rc / 8 >= 0.7 THEN m END, 10) AS mean FROM x""")
def _(t):
    ok, mean = V.window_exclude_centre(V.window_vector(F.col("values"), F.col("c"), 20), 20, 3, 10, 0.7)
    return vectors(t).select("vec_id", ok.alias("ok"), r6(mean, 10).alias("mean"))


@query("probability_features", """
WITH pl AS (SELECT vec_id, unnest(range(1, len(embedding) + 1)) AS p, least(0.99::DOUBLE, greatest(0.0::DOUBLE, abs(unnest(embedding)::DOUBLE) * 3)) AS q FROM embeddings),
f AS (SELECT vec_id, p, q, 1 - q AS u, least(1 - 2.220446049250313e-16::DOUBLE, greatest(2.220446049250313e-16::DOUBLE, q)) AS c FROM pl WHERE p <= 63)
SELECT CAST(vec_id AS BIGINT) AS vec_id, round(avg(-(c * ln(c) + (1 - c) * ln(1 - c))), 6) AS entropy,
  round(avg(u) FILTER (p BETWEEN 22 AND 31), 6) AS up, round(avg(u) FILTER (p BETWEEN 33 AND 42), 6) AS down,
  round(avg(u) FILTER (p BETWEEN 22 AND 42 AND p <> 32), 6) AS flank,
  round(avg(u) FILTER (p BETWEEN 7 AND 21 OR p BETWEEN 43 AND 57), 6) AS far
FROM f GROUP BY vec_id""")
def _(t):
    paired = F.transform(F.slice("embedding", 1, 63), lambda x: F.least(F.lit(0.99), F.greatest(F.lit(0.0), F.abs(x.cast("double")) * 3)))
    f = V.probability_features(paired, 31, 10, 25)
    names = ["entropy", "up", "down", "flank", "far"]
    return t("embeddings").select("vec_id", *[r6(c).alias(n) for n, c in zip(names, f.values())])


@query("exploded_measured_positions", f"""
WITH {VECTORS_SQL}
SELECT CAST(vec_id AS BIGINT) AS vec_id, CAST(p AS BIGINT) AS pos, round(v, 6) AS value FROM vl
WHERE v IS NOT NULL AND substring('ACGTACGGTA', CAST((vec_id + p) % 10 + 1 AS INTEGER), 1) = 'A'""")
def _(t):
    letters = F.transform(F.sequence(F.lit(1), F.size("values")),
                          lambda p: F.substring(F.lit("ACGTACGGTA"), ((F.col("vec_id") + p) % 10 + 1).cast("int"), F.lit(1)))
    z = vectors(t).select("vec_id", F.posexplode(F.arrays_zip("values", letters.alias("letter"))).alias("i", "z"))
    return z.where("z.letter = 'A' and z.values is not null").select(
        "vec_id", (F.col("i") + 1).cast("long").alias("pos"), r6(F.col("z.values")).alias("value"))


@query("selected_vectors", """
SELECT CAST(vec_id AS BIGINT) AS vec_id, CAST(len(embedding) AS BIGINT) AS length, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 6) AS total
FROM embeddings WHERE vec_id IN (SELECT DISTINCT l_suppkey FROM lineitem WHERE l_quantity > 45)""")
def _(t):
    ids = t("lineitem").where("l_quantity > 45").select(F.col("l_suppkey").alias("vec_id"))
    v = t("embeddings").select("vec_id", F.lit(64).alias("length"), F.transform("embedding", lambda x: x.cast("double")).alias("values"))
    return select_vectors(v, ids, "vec_id").select(
        "vec_id", F.col("length").cast("long").alias("length"), r6(F.aggregate("values", F.lit(0.0), lambda a, x: a + x)).alias("total"))


@query("json_arrays", """
SELECT CAST(vec_id AS BIGINT) AS vec_id, CAST(len(a) AS BIGINT) AS n, round(list_sum(a), 6) AS total FROM (
  SELECT vec_id, list_transform(embedding, lambda x: round(x::DOUBLE, 6)) AS a FROM embeddings)""")
def _(t):
    text = F.to_json(F.transform("embedding", lambda x: F.round(x.cast("double"), 6)))
    parsed = with_array_column(t("embeddings").select("vec_id", text.alias("a")), "a", 64)
    return parsed.select("vec_id", F.size("a").cast("long").alias("n"), r6(F.aggregate("a", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@query("vector_table_profile", f"""
WITH {VECTORS_SQL}, r AS (SELECT vec_id, count(*) AS n, count(v) AS ok FROM vl GROUP BY vec_id)
SELECT CAST(count(*) AS BIGINT) AS rows, CAST(sum(CASE WHEN n <> 64 - CASE WHEN vec_id % 9 = 0 THEN 1 ELSE 0 END THEN 1 ELSE 0 END) AS BIGINT) AS length_mismatch_rows,
  CAST(sum(n) AS BIGINT) AS elements, CAST(sum(ok) AS BIGINT) AS valid_elements, round(sum(ok) / sum(n), 8) AS valid_fraction,
  CAST(sum(CASE WHEN vec_id % 3 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS versioned_ids, CAST(sum(CASE WHEN vec_id % 3 <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS unversioned_ids FROM r""")
def _(t):
    k = F.col("vec_id")
    v = vectors(t).withColumns({
        "tid": F.concat(F.lit("T"), k.cast("string"), F.when(k % 3 == 0, ".1").otherwise("")),
        "length": F.when(k % 9 == 0, 63).otherwise(64)})
    return vector_profile(v)


def _matched(t):
    """Vectors with letters by value rank and sites at high values."""
    letters = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(64)),
                                       lambda p: F.substring(F.lit("ACGTACGGTA"), ((F.col("vec_id") + p) % 10 + 1).cast("int"), F.lit(1))), "")
    sites = F.filter(F.sequence(F.lit(6), F.lit(59)), lambda p: F.get("values", p - 1) > 0.2)
    return vectors(t).select("vec_id", "values", letters.alias("letters"), sites.alias("sites")).where(F.size("sites") > 0)


_ELIGIBLE = """
let AS (SELECT vec_id, p, v, substring('ACGTACGGTA', CAST((vec_id + p) % 10 + 1 AS INTEGER), 1) AS b, v > 0.2 AND p BETWEEN 6 AND 59 AS site FROM vl),
cnt AS (SELECT vec_id, p, v, b, coalesce(site, false) AS site, count(v) OVER (PARTITION BY vec_id ORDER BY p ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS lc,
  count(v) OVER (PARTITION BY vec_id ORDER BY p ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS rc FROM let),
el AS (SELECT vec_id, p, b FROM cnt WHERE NOT site AND p > 5 AND p <= 59 AND lc >= 4 AND rc >= 4)"""


@query("eligible_control_positions", f"""
WITH {VECTORS_SQL}, {_ELIGIBLE}
SELECT CAST(vec_id AS BIGINT) AS vec_id, CAST(p AS BIGINT) AS pos, b AS letter FROM el WHERE vec_id IN (SELECT vec_id FROM cnt WHERE site)""")
def _(t):
    e = eligible_positions(F.col("values"), F.col("letters"), F.col("sites"), 5, 0.7)
    return _matched(t).select("vec_id", F.explode(e).alias("e")).select("vec_id", F.col("e.pos").cast("long").alias("pos"), "e.letter")


@query("nearest_matched_controls", f"""
WITH {VECTORS_SQL}, {_ELIGIBLE}, c AS (SELECT s.vec_id, s.p AS site_pos, e.p AS control_pos, s.b AS letter, abs(s.p - e.p) AS distance,
  row_number() OVER (PARTITION BY s.vec_id, s.p ORDER BY abs(s.p - e.p), e.p) AS rn
  FROM (SELECT * FROM cnt WHERE site) s JOIN el e ON e.vec_id = s.vec_id AND e.b = s.b AND abs(s.p - e.p) >= 8)
SELECT CAST(vec_id AS BIGINT) AS vec_id, CAST(site_pos AS BIGINT) AS site_pos, CAST(control_pos AS BIGINT) AS control_pos, letter, CAST(distance AS BIGINT) AS distance FROM c WHERE rn = 1""")
def _(t):
    m = match_nearest(_matched(t), "vec_id", "values", "letters", "sites", 5, 0.7, 8)
    return m.select("vec_id", *[F.col(c).cast("long").alias(c) for c in ("site_pos", "control_pos")], "letter", F.col("distance").cast("long").alias("distance"))


@query("greedy_matched_controls", f"""
WITH RECURSIVE {VECTORS_SQL}, {_ELIGIBLE},
sites AS (SELECT vec_id, p, b, row_number() OVER (PARTITION BY vec_id ORDER BY p) AS i FROM cnt WHERE site),
ranked AS (SELECT s.vec_id, s.i, s.p, e.p AS q, row_number() OVER (PARTITION BY s.vec_id, s.i, e.p < s.p ORDER BY abs(e.p - s.p)) AS step
  FROM sites s JOIN el e ON e.vec_id = s.vec_id AND e.b = s.b),
options AS (SELECT s.vec_id, s.i, list(q ORDER BY step, abs(q - s.p), q) FILTER (abs(q - s.p) >= 8) AS qs
  FROM sites s LEFT JOIN ranked r ON r.vec_id = s.vec_id AND r.i = s.i GROUP BY 1, 2),
walk AS (
  SELECT DISTINCT vec_id, 0::BIGINT AS i, []::BIGINT[] AS used, NULL::BIGINT AS q FROM sites
  UNION ALL
  SELECT vec_id, i, CASE WHEN q IS NULL THEN used ELSE list_append(used, q) END, q
  FROM (SELECT o.vec_id, o.i, w.used, list_filter(coalesce(o.qs, []), lambda x: NOT list_contains(w.used, x))[1] AS q
        FROM walk w JOIN options o ON o.vec_id = w.vec_id AND o.i = w.i + 1)),
flanks AS (SELECT vec_id, p, avg(v) OVER (PARTITION BY vec_id ORDER BY p ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING EXCLUDE CURRENT ROW) AS m FROM cnt)
SELECT CAST(w.vec_id AS BIGINT) AS vec_id, CAST(s.p AS BIGINT) AS site_pos, CAST(w.q AS BIGINT) AS control_pos, s.b AS letter, CAST(abs(s.p - w.q) AS BIGINT) AS distance,
  round(x.m, 6) AS site_mean, round(y.m, 6) AS control_mean
FROM walk w JOIN sites s ON s.vec_id = w.vec_id AND s.i = w.i JOIN flanks x ON x.vec_id = w.vec_id AND x.p = s.p
  JOIN flanks y ON y.vec_id = w.vec_id AND y.p = w.q""")
def _(t):
    x = _matched(t)
    pairs = match_greedy(x, "vec_id", "values", "letters", "sites", 5, 0.7, 8)
    return pair_differences(pairs, x, "vec_id", "values", 5).select(
        "vec_id", *[F.col(c).cast("long").alias(c) for c in ("site_pos", "control_pos")], "letter", F.col("distance").cast("long").alias("distance"),
        *[r6(F.col(c)).alias(c) for c in ("site_mean", "control_mean")])
