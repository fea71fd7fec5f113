"""Ranks, running totals, splits, components and set comparisons."""

from pyspark.sql import functions as F

from sitewise.catalog.registry import query
from sitewise.catalog.standins import r6
from sitewise.operators import groups as G
from sitewise.operators import windows as W
from sitewise.operators.aggregates import group_size
from sitewise.operators.inference import bh_adjust
from sitewise.operators.intervals import with_tx_offsets
from sitewise.operators.matching import eligibility
from sitewise.operators.ordering import positions, running
from sitewise.operators.quality import fingerprint_match, table_equivalence, table_fingerprint
from sitewise.sources.writers import concat_rows

_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


@query("representative_ranking", """
SELECT CAST(l_orderkey AS BIGINT) AS l_orderkey, CAST(l_partkey AS BIGINT) AS l_partkey, CAST(l_suppkey AS BIGINT) AS l_suppkey, l_extendedprice,
  CAST(row_number() OVER w AS BIGINT) AS rank, row_number() OVER w = 1 AS representative, CAST(count(*) OVER (PARTITION BY l_orderkey) AS BIGINT) AS group_size FROM lineitem
WINDOW w AS (PARTITION BY l_orderkey ORDER BY CASE WHEN l_tax > 0.04 THEN 0 ELSE 1 END, l_quantity DESC, l_linenumber, l_partkey, l_suppkey, l_extendedprice)""")
def _(t):
    order = [F.when(F.col("l_tax") > 0.04, 0).otherwise(1), F.col("l_quantity").desc(), *[F.col(c) for c in _ORDER]]
    return W.rank_candidates(t("lineitem"), ["l_orderkey"], order) \
        .select("l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice", "rank", "representative", "group_size")


@query("representative_rows", """
SELECT CAST(l_orderkey AS BIGINT) AS l_orderkey, CAST(l_partkey AS BIGINT) AS l_partkey, l_extendedprice, CAST(n AS BIGINT) AS group_size FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey) AS n,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY -l_quantity, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rn FROM lineitem) WHERE rn = 1""")
def _(t):
    r = W.representative(t("lineitem"), ["l_orderkey"], [-F.col("l_quantity"), *[F.col(c) for c in _ORDER]])
    return r.select("l_orderkey", "l_partkey", "l_extendedprice", "group_size")


@query("keep_first_per_key", """
SELECT CAST(o_custkey AS BIGINT) AS o_custkey, CAST(arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS BIGINT) AS o_orderkey FROM orders GROUP BY o_custkey""")
def _(t):
    return W.keep_first(t("orders").select("o_custkey", "o_orderdate", "o_orderkey"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey")


@query("equal_group_weights", """
SELECT source, CAST(n AS BIGINT) AS group_size, CAST(count(*) AS BIGINT) AS rows, round(sum(1 / n), 6) AS weight FROM (SELECT source, count(*) OVER (PARTITION BY source) AS n FROM documents) GROUP BY source, n""")
def _(t):
    return group_size(t("documents").select("source"), ["source"]).groupBy("source", "group_size").agg(
        F.count(F.lit(1)).alias("rows"), r6(F.sum(1 / F.col("group_size"))).alias("weight"))


@query("cumulative_offsets", """
WITH x AS (SELECT DISTINCT l_partkey AS tid, CAST(round(l_extendedprice * 100) AS BIGINT) AS s, CAST(round(l_extendedprice * 100) AS BIGINT) + CAST(l_quantity AS BIGINT) AS e FROM lineitem)
SELECT CAST(tid AS BIGINT) AS tid, s AS start, CAST(sum(e - s + 1) OVER w - (e - s) AS BIGINT) AS tx_start, CAST(sum(e - s + 1) OVER w AS BIGINT) AS tx_end FROM x
WINDOW w AS (PARTITION BY tid ORDER BY CASE WHEN tid % 2 = 0 THEN s ELSE -s END, CASE WHEN tid % 2 = 0 THEN e ELSE -e END ROWS UNBOUNDED PRECEDING)""")
def _(t):
    s = F.round(F.col("l_extendedprice") * 100).cast("long")
    x = t("lineitem").select(F.col("l_partkey").alias("tid"), s.alias("start"), (s + F.col("l_quantity").cast("long")).alias("end")).distinct()
    x = x.withColumn("strand", F.when(F.col("tid") % 2 == 0, "+").otherwise("-"))
    return with_tx_offsets(x).select("tid", "start", "tx_start", "tx_end")


@query("running_totals_skewed_key", """
SELECT event_type, CAST(event_id AS BIGINT) AS event_id, round(sum(value) OVER w, 2) AS total, CAST(row_number() OVER w AS BIGINT) AS n, min(value) OVER w AS lowest FROM events
WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def _(t):
    r = running(t("events"), ["event_type"], ["ts", "event_id"],
                {"total": ("sum", F.col("value")), "n": ("sum", F.lit(1).cast("long")), "lowest": ("min", F.col("value"))})
    return r.select("event_type", "event_id", r6(F.col("total"), 2).alias("total"), "n", "lowest")


@query("flank_eligibility_rows", """
WITH p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos, value > 20 AS ok FROM events),
c AS (SELECT *, count(*) FILTER (ok) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS l, count(*) FILTER (ok) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS r,
  count(*) OVER (PARTITION BY user_id) AS n FROM p)
SELECT CAST(event_id AS BIGINT) AS event_id, CAST(l AS BIGINT) AS valid_left, CAST(r AS BIGINT) AS valid_right, pos > 5 AND pos + 5 <= n AND l >= 4 AND r >= 4 AND event_type <> 'error' AS eligible FROM c""")
def _(t):
    p = positions(t("events"), ["user_id"], ["ts", "event_id"], "pos")
    e = eligibility(p, ["user_id"], "pos", F.col("value") > 20, 5, 0.7, F.col("event_type") == "error")
    return e.select("event_id", "valid_left", "valid_right", "eligible")


@query("stratified_first_rows", """
SELECT CAST(event_id AS BIGINT) AS event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY event_type, value > 50 ORDER BY event_id) AS rn FROM events) WHERE rn <= 3""")
def _(t):
    x = t("events").withColumn("big", F.col("value") > 50)
    return W.stratified_sample(x, ["event_type", "big"], ["event_id"], 3).select("event_id", "event_type")


@query("stratified_sample_with_fill", """
WITH g AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS rn FROM events WHERE event_type <> 'error'),
b AS (SELECT event_id, 1 AS fill FROM g WHERE rn <= 3), x AS (SELECT event_id, 2 AS fill FROM g WHERE rn > 3 ORDER BY event_id LIMIT 15),
f AS (SELECT event_id, 3 AS fill FROM events WHERE event_type = 'error' ORDER BY event_id LIMIT 6),
a AS (SELECT *, row_number() OVER (ORDER BY fill, event_id) AS n FROM (SELECT * FROM b UNION ALL SELECT * FROM x UNION ALL SELECT * FROM f))
SELECT CAST(event_id AS BIGINT) AS event_id, CAST(fill AS BIGINT) AS fill FROM a WHERE fill = 1 OR n <= 15""")
def _(t):
    s = W.sample_with_fill(t("events"), ["event_type"], ["event_id"], 3, 15, F.col("event_type") == "error")
    return s.select("event_id", F.col("fill").cast("long").alias("fill"))


@query("group_split", """
WITH s AS (SELECT l_suppkey, count(*) AS n, ('0x' || substr(md5('42|' || l_suppkey), 1, 8))::BIGINT AS h FROM lineitem GROUP BY l_suppkey),
c AS (SELECT *, sum(n) OVER (ORDER BY h, l_suppkey ROWS UNBOUNDED PRECEDING) AS cum, sum(n) OVER () AS tot FROM s), k AS (SELECT arg_min(cum, (abs(cum - tot * 0.2), cum)) AS cut FROM c)
SELECT CAST(l_suppkey AS BIGINT) AS l_suppkey, CAST(n AS BIGINT) AS size, CAST(cum AS BIGINT) AS cumulative, CASE WHEN cum <= cut THEN 'test' ELSE 'development' END AS split FROM c, k""")
def _(t):
    return G.group_split(t("lineitem"), "l_suppkey", 0.2, 42)


@query("fdr_adjustment", """
WITH p AS (SELECT l_suppkey % 5 AS family, l_suppkey AS id, least(1.0, abs(avg(l_discount) - 0.05) * 150 + (l_suppkey % 3) * 0.1) AS p FROM lineitem GROUP BY l_suppkey),
r AS (SELECT *, p * count(*) OVER (PARTITION BY family) / row_number() OVER (PARTITION BY family ORDER BY p, id) AS raw, row_number() OVER (PARTITION BY family ORDER BY p, id) AS rk FROM p)
SELECT CAST(family AS BIGINT) AS family, CAST(id AS BIGINT) AS id, round(p, 7) AS p, round(least(1.0, min(raw) OVER (PARTITION BY family ORDER BY rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 7) AS q_value FROM r""")
def _(t):
    k = F.col("l_suppkey")
    p = t("lineitem").groupBy("l_suppkey").agg(F.avg("l_discount").alias("m")).select(
        (k % 5).alias("family"), k.alias("id"), F.least(F.lit(1.0), F.abs(F.col("m") - 0.05) * 150 + (k % 3) * 0.1).alias("p"))
    q = bh_adjust(p, ["family"], "p", ["id"])
    return q.select("family", "id", r6(F.col("p"), 7).alias("p"), r6(F.col("q_value"), 7).alias("q_value"))


_COMPONENTS = """
WITH RECURSIVE d AS (SELECT DISTINCT 'n' || (doc_id // 4) AS node, sha256(text) AS v FROM documents), c AS (SELECT v, min(node) AS m FROM d GROUP BY v),
e AS (SELECT DISTINCT node AS a, m AS b FROM d JOIN c USING (v) WHERE node <> m), s AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(n, m) AS (SELECT node, node FROM d UNION SELECT s.b, r.m FROM r JOIN s ON s.a = r.n), comp AS (SELECT n AS node, min(m) AS component FROM r GROUP BY n)"""


@query("joint_groups", _COMPONENTS + """
SELECT node, component, 'G' || CASE WHEN i < 100000 THEN lpad(CAST(i AS VARCHAR), 5, '0') ELSE CAST(i AS VARCHAR) END AS label FROM (SELECT *, dense_rank() OVER (ORDER BY component) AS i FROM comp)""")
def _(t):
    d = t("documents").select(F.concat(F.lit("n"), F.floor(F.col("doc_id") / 4).cast("string")).alias("node"), F.sha2("text", 256).alias("v"))
    return G.component_labels(G.connected_components(d, G.shared_value_edges(d, "node", "v")))


@query("joint_group_split", _COMPONENTS + """,
l AS (SELECT node, 'G' || CASE WHEN i < 100000 THEN lpad(CAST(i AS VARCHAR), 5, '0') ELSE CAST(i AS VARCHAR) END AS g FROM (SELECT *, dense_rank() OVER (ORDER BY component) AS i FROM comp)),
gs AS (SELECT g, count(*) AS n FROM documents JOIN l ON node = 'n' || (doc_id // 4) GROUP BY g), h AS (SELECT *, ('0x' || substr(md5('7|' || g), 1, 8))::BIGINT AS h FROM gs),
cm AS (SELECT *, sum(n) OVER (ORDER BY h, g ROWS UNBOUNDED PRECEDING) AS cum, sum(n) OVER () AS tot FROM h), k AS (SELECT arg_min(cum, (abs(cum - tot * 0.2), cum)) AS cut FROM cm)
SELECT g AS joint_group, CAST(n AS BIGINT) AS size, CASE WHEN cum <= cut THEN 'test' ELSE 'development' END AS split FROM cm, k""")
def _(t):
    d = t("documents").select("doc_id", F.concat(F.lit("n"), F.floor(F.col("doc_id") / 4).cast("string")).alias("n"), F.sha2("text", 256).alias("text_key"))
    return G.group_split(G.joint_groups(d, "n", "text_key"), "joint_group", 0.2, 7).select("joint_group", "size", "split")


@query("snake_folds", """
WITH s AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, user_id) - 1 AS i FROM s)
SELECT CAST(user_id AS BIGINT) AS user_id, CAST(n AS BIGINT) AS size, CAST(CASE WHEN (i // 5) % 2 = 0 THEN i % 5 ELSE 4 - i % 5 END + 1 AS BIGINT) AS fold FROM r""")
def _(t):
    return G.snake_folds(t("events"), "user_id", 5).select("user_id", "size", F.col("fold").cast("long").alias("fold"))


@query("lightest_group_folds", """
WITH RECURSIVE s AS (SELECT user_id % 997 AS g, count(*) AS size FROM events GROUP BY 1), o AS (SELECT *, row_number() OVER (ORDER BY size DESC, g) AS i FROM s),
r(i, g, size, fold, load) AS (
  SELECT 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, [0, 0, 0, 0, 0]::BIGINT[]
  UNION ALL SELECT o.i, o.g, o.size, list_position(load, list_min(load))::BIGINT,
    list_transform(range(1, 6), lambda k: load[k] + CASE WHEN k = list_position(load, list_min(load)) THEN o.size ELSE 0 END) FROM r JOIN o ON o.i = r.i + 1)
SELECT g, size, fold FROM r WHERE i > 0""")
def _(t):
    f = G.lightest_folds(t("events").select((F.col("user_id") % 997).alias("g")), "g", 5)
    return f.select("g", "size", F.col("fold").cast("long").alias("fold"))


@query("balanced_group_folds", """
WITH g AS (SELECT CASE WHEN l_suppkey % 13 <> 0 THEN l_suppkey END AS k, count(*) AS n FROM lineitem GROUP BY 1),
r AS (SELECT n, row_number() OVER (ORDER BY n DESC, k NULLS FIRST) - 1 AS i FROM g)
SELECT CAST(CASE WHEN (i // 5) % 2 = 0 THEN i % 5 ELSE 4 - i % 5 END + 1 AS BIGINT) AS fold, CAST(sum(n) AS BIGINT) AS rows, CAST(count(*) AS BIGINT) AS groups
FROM r GROUP BY 1""")
def _(t):
    grouped = t("lineitem").withColumn("k", F.when(F.col("l_suppkey") % 13 != 0, F.col("l_suppkey")))
    f = G.group_folds(grouped, "k", 5, "snake")
    return f.groupBy(F.col("fold").cast("long").alias("fold")).agg(F.sum("size").alias("rows"), F.count(F.lit(1)).alias("groups"))


@query("counts_in_order", """
SELECT p_brand, CAST(count(*) AS BIGINT) AS count FROM part GROUP BY p_brand ORDER BY count DESC, p_brand""")
def _(t):
    return W.count_order(t("part"), "p_brand")


@query("best_candidate_selection", """
WITH m AS (SELECT o_orderpriority AS model, o_custkey % 9 AS alpha, avg(o_totalprice) AS mae FROM orders GROUP BY 1, 2),
b AS (SELECT model, arg_min(alpha, (round(mae, 4), alpha)) AS alpha, min(round(mae, 4)) AS mae, min(alpha) AS lo, max(alpha) AS hi FROM m GROUP BY model)
SELECT model, CAST(alpha AS BIGINT) AS alpha, mae, alpha IN (lo, hi) AS on_edge FROM b""")
def _(t):
    m = t("orders").groupBy(F.col("o_orderpriority").alias("model"), (F.col("o_custkey") % 9).alias("alpha")).agg(r6(F.avg("o_totalprice"), 4).alias("mae"))
    return W.best_of(m, ["model"], "mae", "alpha")


@query("table_fingerprint", """
SELECT CAST(count(*) AS BIGINT) AS rows, CAST(sum(('0x' || substr(md5('v' || o_orderkey || chr(31) || CASE WHEN o_orderkey % 7 = 0 THEN 'n' ELSE 'v' || o_orderpriority END), 1, 12))::BIGINT) AS VARCHAR) AS fingerprint FROM orders""")
def _(t):
    o = t("orders").select("o_orderkey", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderpriority")).alias("p"))
    return table_fingerprint(o, ["o_orderkey", "p"])


@query("snapshot_match", """
SELECT CAST(count(*) AS BIGINT) AS rows_before, CAST(count(*) AS BIGINT) AS rows_after, 'MATCH' AS result FROM lineitem""")
def _(t):
    cols = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    li = t("lineitem").select(*cols)
    return fingerprint_match(li, li.repartition(13, "l_partkey"), cols)


@query("labelled_row_concat", """
SELECT track, CAST(count(*) AS BIGINT) AS n, CAST(count(o_totalprice) AS BIGINT) AS prices, CAST(count(c_acctbal) AS BIGINT) AS balances FROM (
  SELECT 'orders' AS track, o_totalprice, NULL AS c_acctbal FROM orders UNION ALL SELECT 'customer', NULL, c_acctbal FROM customer) GROUP BY track""")
def _(t):
    x = concat_rows([t("orders").select("o_totalprice"), t("customer").select("c_acctbal")], "track", ["orders", "customer"])
    return x.groupBy("track").agg(F.count(F.lit(1)).alias("n"), F.count("o_totalprice").alias("prices"), F.count("c_acctbal").alias("balances"))


@query("table_equivalence", """
WITH a AS (SELECT o_orderkey AS k, o_totalprice AS v, o_orderstatus AS s FROM orders), b AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE o_totalprice + CASE WHEN o_orderkey % 31 = 0 THEN 0.5 ELSE 0 END END AS v,
  CASE WHEN o_orderkey % 43 = 0 THEN 'Z' ELSE o_orderstatus END AS s FROM orders WHERE o_orderkey % 17 <> 0), j AS (SELECT a.k IS NOT NULL AND b.k IS NOT NULL AS paired, a.v AS av, b.v AS bv, a.s AS sa, b.s AS sb FROM a FULL OUTER JOIN b ON a.k = b.k)
SELECT CAST(count(*) FILTER (paired) AS BIGINT) AS common_rows, CAST(count(*) FILTER (NOT paired) AS BIGINT) AS unmatched_rows, CAST(count(*) FILTER (paired AND (av IS NULL) <> (bv IS NULL)) AS BIGINT) AS null_pattern_differences,
  CAST(count(*) FILTER (paired AND sa IS DISTINCT FROM sb) AS BIGINT) AS text_differences, round(max(abs(av - bv)), 6) AS max_abs_difference, false AS equivalent FROM j""")
def _(t):
    a = t("orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"), F.col("o_orderstatus").alias("s"))
    k = F.col("k")
    b = a.where("k % 17 <> 0").withColumns({
        "v": F.when(k % 50 != 0, F.col("v") + F.when(k % 31 == 0, 0.5).otherwise(0.0)), "s": F.when(k % 43 == 0, "Z").otherwise(F.col("s"))})
    e = table_equivalence(a, b, ["k"], ["v"], ["s"])
    return e.select("common_rows", "unmatched_rows", *[F.col(c).cast("long").alias(c) for c in ("null_pattern_differences", "text_differences")],
                    r6(F.col("max_abs_difference")).alias("max_abs_difference"), "equivalent")


@query("wide_to_long_and_back", """
SELECT CAST(l_suppkey AS BIGINT) AS l_suppkey, round(max(l_quantity), 4) AS q, round(max(l_discount), 4) AS d, round(max(l_tax), 4) AS x FROM lineitem GROUP BY l_suppkey""")
def _(t):
    wide = t("lineitem").groupBy("l_suppkey").agg(F.max("l_quantity").alias("q"), F.max("l_discount").alias("d"), F.max("l_tax").alias("x"))
    back = W.to_wide(W.to_long(wide, ["l_suppkey"], ["q", "d", "x"]), ["l_suppkey"], "model", "prediction", ["q", "d", "x"])
    return back.select("l_suppkey", *[r6(F.col(c), 4).alias(c) for c in ("q", "d", "x")])
