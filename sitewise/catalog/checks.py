"""Gates, constraints, audits and keyed enrichment."""

from decimal import Decimal

from pyspark.sql import functions as F

from sitewise.catalog.registry import query
from sitewise.catalog.standins import r6
from sitewise.operators import quality as K


@query("gate_evaluation", """
WITH d AS (SELECT DISTINCT 'g' || (l_suppkey) AS gate FROM lineitem WHERE l_suppkey % 7 <> 3),
o AS (SELECT 'g' || (l_suppkey) AS gate, sum(CAST(l_discount AS DECIMAL(18, 6))) < 0.051 * count(l_discount) AS passed FROM lineitem WHERE l_suppkey % 9 <> 4 GROUP BY l_suppkey)
SELECT coalesce(d.gate, o.gate) AS gate, CASE WHEN o.gate IS NULL THEN 'not_observed' WHEN d.gate IS NULL THEN 'not_declared' WHEN passed THEN 'PASS' ELSE 'FAIL' END AS status FROM d FULL OUTER JOIN o ON d.gate = o.gate""")
def _(t):
    return K.evaluate_gates(*_gates(t))


def _gates(t):
    li = t("lineitem").withColumn("gate", F.concat(F.lit("g"), F.col("l_suppkey").cast("string")))
    declared = li.where("l_suppkey % 7 <> 3").select("gate").distinct()
    # In decimals: a mean of exactly 0.051 would pass or fail by the order in which doubles are added.
    total = F.sum(F.col("l_discount").cast("decimal(18,6)"))
    observed = li.where("l_suppkey % 9 <> 4").groupBy("gate").agg((total < F.lit(Decimal("0.051")) * F.count("l_discount")).alias("passed"))
    return declared, observed


@query("overall_gate_status", """
WITH d AS (SELECT DISTINCT 'g' || (l_suppkey) AS gate FROM lineitem WHERE l_suppkey % 7 <> 3),
o AS (SELECT 'g' || (l_suppkey) AS gate, sum(CAST(l_discount AS DECIMAL(18, 6))) < 0.051 * count(l_discount) AS passed FROM lineitem WHERE l_suppkey % 9 <> 4 GROUP BY l_suppkey),
s AS (SELECT coalesce(d.gate IS NOT NULL AND o.gate IS NOT NULL AND passed, false) AS ok FROM d FULL OUTER JOIN o ON d.gate = o.gate)
SELECT CAST(count(*) AS BIGINT) AS gates, CAST(count(*) FILTER (NOT ok) AS BIGINT) AS not_passed, CASE WHEN bool_and(ok) THEN 'PASS' ELSE 'FAIL' END AS status FROM s""")
def _(t):
    return K.overall_status(K.evaluate_gates(*_gates(t)))


@query("threshold_gates", """
WITH o AS (SELECT o_orderpriority AS metric, CAST(count(*) AS DOUBLE) AS observed FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), r AS (SELECT o_orderpriority AS metric, count(*) / 3.0 AS required FROM orders GROUP BY 1)
SELECT r.metric, round(required, 4) AS required, observed, coalesce(observed >= required, false) AS passed FROM r LEFT JOIN o ON r.metric = o.metric""")
def _(t):
    g = F.col("o_orderpriority").alias("metric")
    o = t("orders").where("o_orderstatus = 'F'").groupBy(g).agg(F.count(F.lit(1)).cast("double").alias("observed"))
    r = t("orders").groupBy(g).agg((F.count(F.lit(1)) / 3.0).alias("required"))
    return K.threshold_gates(o, r).withColumn("required", r6(F.col("required"), 4)).select("metric", "required", "observed", "passed")


_TRACKS = "WITH s AS (SELECT p_brand AS track, p_type AS kind, count(*) AS n, avg(p_size) AS m FROM part GROUP BY 1, 2)"
_ADMIT = "CASE WHEN n >= (SELECT avg(n) * 1.2 FROM s) AND m > 24 THEN 'ADMIT_QUANTITATIVE' WHEN n >= (SELECT avg(n) FROM s) THEN 'ADMIT_BINARY' ELSE 'HOLD' END"


def _admitted(t):
    s = t("part").groupBy(F.col("p_brand").alias("track"), F.col("p_type").alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.avg("p_size").alias("m"))
    mean = s.agg(F.avg("n").alias("x")).scalar()
    return K.admission_rules(s, [("ADMIT_QUANTITATIVE", (F.col("n") >= mean * 1.2) & (F.col("m") > 24)), ("ADMIT_BINARY", F.col("n") >= mean)], "kind")


@query("admission_rules", f"{_TRACKS} SELECT track, kind, CAST(n AS BIGINT) AS n, {_ADMIT} AS admission FROM s")
def _(t):
    return _admitted(t).select("track", "kind", "n", "admission")


@query("go_no_go", f"""{_TRACKS}, a AS (SELECT kind, {_ADMIT} AS d FROM s)
SELECT CAST(count(DISTINCT kind) AS BIGINT) AS admitted_kinds, CASE WHEN count(DISTINCT kind) >= 3 THEN 'GO' ELSE 'NO_GO' END AS gate FROM a WHERE d <> 'HOLD'""")
def _(t):
    return K.go_no_go(_admitted(t), 3)


@query("multi_criterion_admission", """
SELECT CAST(c_custkey AS BIGINT) AS c_custkey, array_to_string(list_filter([CASE WHEN NOT c_acctbal > 0 THEN 'positive_balance' END, CASE WHEN NOT c_nationkey < 20 THEN 'known_nation' END,
  CASE WHEN NOT c_mktsegment <> 'HOUSEHOLD' THEN 'business' END], lambda x: x IS NOT NULL), ';') AS failed_criteria,
  CASE WHEN c_acctbal > 0 AND c_nationkey < 20 AND c_mktsegment <> 'HOUSEHOLD' THEN 'ADMIT_FOR_ASSOCIATION' ELSE 'HOLD_NOT_ADMITTED' END AS decision FROM customer""")
def _(t):
    a = K.admission_with_failures(t("customer"), {
        "positive_balance": F.col("c_acctbal") > 0, "known_nation": F.col("c_nationkey") < 20, "business": F.col("c_mktsegment") != "HOUSEHOLD"})
    return a.select("c_custkey", "failed_criteria", "decision")


@query("row_constraints", """
SELECT 'status' AS "constraint", CAST(count(*) FILTER (o_orderstatus NOT IN ('F', 'O')) AS BIGINT) AS violations FROM orders
UNION ALL SELECT 'price_range', CAST(count(*) FILTER (NOT o_totalprice BETWEEN 1000 AND 400000) AS BIGINT) FROM orders
UNION ALL SELECT 'priority_digit', CAST(count(*) FILTER (NOT regexp_matches(o_orderpriority, '^[1-4]-')) AS BIGINT) FROM orders""")
def _(t):
    return K.constraint_violations(t("orders"), {
        "status": F.col("o_orderstatus").isin("F", "O"), "price_range": F.col("o_totalprice").between(1000, 400000),
        "priority_digit": F.col("o_orderpriority").rlike("^[1-4]-")})


@query("referential_checks", """
WITH p AS (SELECT c_custkey AS k FROM customer WHERE c_acctbal > 0), c AS (SELECT o_custkey AS k FROM orders)
SELECT CAST(0 AS BIGINT) AS duplicate_parent_keys, CAST((SELECT count(*) FROM c WHERE k NOT IN (SELECT k FROM p)) AS BIGINT) AS orphan_rows, CAST((SELECT count(*) FROM p WHERE k NOT IN (SELECT k FROM c)) AS BIGINT) AS uncovered_parents""")
def _(t):
    return K.referential_checks(t("orders"), "o_custkey", t("customer").where("c_acctbal > 0"), "c_custkey")


@query("population_invariants", """
SELECT 'duplicate_ids' AS invariant, CAST(count(l_orderkey) - count(DISTINCT l_orderkey) AS BIGINT) AS violations FROM lineitem
UNION ALL SELECT 'deep_implies_taxed', CAST(count(*) FILTER (l_quantity > 40 AND NOT l_tax > 0.01) AS BIGINT) FROM lineitem
UNION ALL SELECT 'row_count_difference', CAST(abs(count(*) - 60000) AS BIGINT) FROM lineitem""")
def _(t):
    return K.population_invariants(t("lineitem"), "l_orderkey", {"deep_implies_taxed": (F.col("l_quantity") > 40, F.col("l_tax") > 0.01)}, 60000)


@query("leakage_audit", """
SELECT 'l_suppkey' AS variable, CAST(count(*) AS BIGINT) AS overlap FROM (SELECT l_suppkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) > 1)
UNION ALL SELECT 'l_orderkey', CAST(count(*) AS BIGINT) FROM (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) > 1)""")
def _(t):
    return K.leakage_audit(t("lineitem"), "l_returnflag", ["l_suppkey", "l_orderkey"])


@query("status_preconditions", """
SELECT source AS stage, CAST(count(*) AS BIGINT) AS rows, count(*) = 1 AND bool_and(lang = 'en') AS ready FROM documents GROUP BY source""")
def _(t):
    d = t("documents").select(F.col("source").alias("stage"), F.when(F.col("lang") == "en", "PASS").otherwise("FAIL").alias("status"))
    return K.status_precondition(d, ["stage"])


@query("metric_reproduction", """
WITH a AS (SELECT l_suppkey AS k, round(avg(l_tax), 9) AS v FROM lineitem GROUP BY 1)
SELECT CAST(k AS BIGINT) AS k, k % 8 <> 0 AS match FROM a""")
def _(t):
    a = t("lineitem").groupBy(F.col("l_suppkey").alias("k")).agg(F.round(F.avg("l_tax"), 9).alias("value"))
    b = a.withColumn("value", F.col("value") + F.when(F.col("k") % 8 == 0, 1e-6).otherwise(0.0))
    return K.reproduction_check(a, b, ["k"]).select("k", "match")


@query("formula_consistency", """
WITH s AS (SELECT l_suppkey AS k, stddev_samp(l_quantity) AS sd, avg(l_quantity) AS m FROM lineitem GROUP BY 1)
SELECT 'scaled_slope' AS formula, CAST(count(*) FILTER (k % 9 = 4) AS BIGINT) AS violations FROM s UNION ALL SELECT 'delta', CAST(count(*) FILTER (k % 12 = 5) AS BIGINT) FROM s""")
def _(t):
    s = t("lineitem").groupBy(F.col("l_suppkey").alias("k")).agg(F.stddev_samp("l_quantity").alias("sd"), F.avg("l_quantity").alias("m"))
    s = s.withColumns({"per_sd": F.col("m") * F.col("sd") + F.when(F.col("k") % 9 == 4, 1e-3).otherwise(0.0), "delta": F.col("m") - F.col("sd") + F.when(F.col("k") % 12 == 5, 1e-3).otherwise(0.0)})
    f = K.formula_consistency(s, {"scaled_slope": (F.col("per_sd"), F.col("m") * F.col("sd")), "delta": (F.col("delta"), F.col("m") - F.col("sd"))})
    return f.select("formula", "violations")


@query("keyed_enrichment", """
SELECT CAST(doc_id AS BIGINT) AS doc_id, sha256(text) AS content_sha256, CAST(length(text) AS BIGINT) AS n_letters, CAST(length(regexp_replace(text, '[^aeiou]', '', 'g')) AS BIGINT) AS vowels FROM documents""")
def _(t):
    from sitewise.operators.enrich import KEY, enrich_distinct
    from sitewise.session import ensure_checkpoint_dir

    def compute(keys):
        def run(batches):
            for pdf in batches:
                yield pdf.assign(n_letters=pdf["content"].str.len(), vowels=pdf["content"].str.count("[aeiou]"))[[KEY, "n_letters", "vowels"]]

        return keys.mapInPandas(run, f"{KEY} string, n_letters long, vowels long")

    # A fresh store in the shared folder; a caller would keep its own between runs.
    import uuid

    store = f"{ensure_checkpoint_dir(t.spark)}/enrich-{uuid.uuid4().hex}"
    return enrich_distinct(t("documents"), F.col("text"), compute, store).select("doc_id", KEY, "n_letters", "vowels")


@query("file_inventory")
def _(t):
    files = K.file_inventory(t.spark, t.folder, "*.parquet")
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "bytes", "sha256", "readable", "rows", "columns")
