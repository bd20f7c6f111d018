"""Relational, authorization and analytic queries over the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from harrier.functions import text as X
from harrier.operators import access, hierarchy
from harrier.plans.registry import Registry
from harrier.sources.tables import table

Q = Registry()

Q.both("pricing_summary", """
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus""")
Q.both("revenue_by_nation", """
SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
GROUP BY n_name""")
Q.both("filtered_revenue", "SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue, count(*) AS n FROM lineitem WHERE l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24")
Q.both("inner_join", "SELECT o_orderpriority, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey AND c_acctbal > o_totalprice / 100 GROUP BY o_orderpriority")
Q.both("semi", "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
Q.both("anti", "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
Q.both("full_outer", "SELECT coalesce(a.k, b.k) AS k, a.n AS suppliers, b.n AS rich_customers FROM (SELECT s_nationkey AS k, count(*) AS n FROM supplier WHERE s_acctbal > 3000 GROUP BY s_nationkey) a FULL OUTER JOIN (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_acctbal > 9900 GROUP BY c_nationkey) b ON a.k = b.k")
Q.both("cross_grid", "SELECT r_name, n_name, r_regionkey = n_regionkey AS home FROM region CROSS JOIN nation")
Q.both("theta", "SELECT a.s_suppkey AS low, b.s_suppkey AS high FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_acctbal < b.s_acctbal")
Q.both("grouping_sets", "SELECT l_returnflag, l_linestatus, grouping(l_returnflag) AS g, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())", "SELECT l_returnflag, l_linestatus, grouping(l_returnflag)::TINYINT AS g, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())")
Q.both("cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
Q.both("rollup", "SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY ROLLUP (c_mktsegment, c_nationkey)")
Q.both("top_k_per_group", "SELECT l_suppkey, l_orderkey, l_extendedprice, n FROM (SELECT l_suppkey, l_orderkey, l_extendedprice, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS INT) AS n FROM lineitem) t WHERE n <= 3")
Q.both("running_total", "SELECT o_custkey, o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS running FROM orders")
Q.both("conversation_text", "SELECT conv_id, md5(array_join(transform(array_sort(collect_list(struct(turn, role, text))), x -> concat(x.role, ': ', x.text)), '\\n')) AS h FROM conversations GROUP BY conv_id", "SELECT conv_id, md5(string_agg(role || ': ' || text, chr(10) ORDER BY turn)) AS h FROM conversations GROUP BY conv_id")


@Q("SELECT event_id, p AS action, list_aggregate(CASE p WHEN 'view' THEN ['view', 'comment', 'edit', 'manage'] WHEN 'comment' THEN ['comment', 'edit', 'manage'] WHEN 'edit' THEN ['edit', 'manage'] WHEN 'manage' THEN ['manage'] WHEN 'delete' THEN ['delete', 'manage'] ELSE ['view'] END, 'string_agg', ',') AS allowed_by FROM (SELECT event_id, ['view', 'comment', 'edit', 'manage', 'delete', 'other'][event_id % 6 + 1] AS p FROM events)")
def permission_closure(spark, sf_dir):
    asked = F.element_at(F.array(*[F.lit(a) for a in (*access.ORDER, "delete", "other")]), (F.col("event_id") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", asked.alias("action")).withColumn("allowed_by", F.array_join(access.allowed_by(F.col("action")), ","))


#: A principal of nation 3 who is customer 7; grants come from line items, suppliers and nations.
VISIBLE = """
SELECT o_orderkey FROM orders o JOIN customer c ON c_custkey = o_custkey
WHERE o_orderstatus <> 'P' AND (
  (o_orderstatus = 'O' AND c_nationkey = 3) OR o_custkey = 7
  OR EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_suppkey = 5)
  OR EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = o_orderkey % 100 AND s_nationkey = 4)
  OR EXISTS (SELECT 1 FROM nation WHERE n_nationkey = c_nationkey AND n_name LIKE '%A' AND n_regionkey = 1))"""


def _visible(spark, sf_dir, paths=None):
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey")).withColumn("folder", F.col("o_orderkey") % 100)
    grants = [
        (table(spark, sf_dir, "lineitem").filter("l_suppkey = 5"), "o_orderkey", "l_orderkey"),
        (table(spark, sf_dir, "supplier").filter("s_nationkey = 4"), "folder", "s_suppkey"),
        (table(spark, sf_dir, "nation").filter("n_name LIKE '%A' AND n_regionkey = 1"), "c_nationkey", "n_nationkey"),
    ]
    scopes = [(F.col("o_orderstatus") == "O") & (F.col("c_nationkey") == 3), F.col("o_custkey") == 7]
    return access.visible(rows, "o_orderkey", F.col("o_orderstatus") != "P", scopes, access.granted(rows, grants, "o_orderkey"), paths, "o_orderpriority")


@Q(VISIBLE)
def acl_visible(spark, sf_dir):
    return _visible(spark, sf_dir).select("o_orderkey")


@Q(VISIBLE.replace("WHERE o_orderstatus", "WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus", 1))
def acl_paths(spark, sf_dir):
    paths = spark.createDataFrame([("1-URGENT",), ("2-HIGH",)], "o_orderpriority string")
    return _visible(spark, sf_dir, paths).select("o_orderkey")


@Q("SELECT l_partkey AS k FROM lineitem WHERE l_suppkey = 5 INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT p_partkey FROM part WHERE p_size < 30")
def scope_intersection(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem")
    mine = items.filter("l_suppkey = 5").select(F.col("l_partkey").alias("k")).distinct()
    picked = items.filter("l_returnflag = 'R'").select(F.col("l_partkey").alias("k"))
    asked = table(spark, sf_dir, "part").filter("p_size < 30").select(F.col("p_partkey").alias("k"))
    return mine.join(picked, "k", "left_semi").join(asked, "k", "left_semi")


TREE = "e AS (SELECT 'n' || n_nationkey AS id, 'r' || n_regionkey AS parent FROM nation UNION ALL SELECT 'r' || r_regionkey, 'root' FROM region UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer)"


def _tree(spark, sf_dir):
    nation, region, customer = (table(spark, sf_dir, t) for t in ("nation", "region", "customer"))
    node = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    return nation.select(node("n", "n_nationkey").alias("id"), node("r", "n_regionkey").alias("parent")).union(region.select(node("r", "r_regionkey"), F.lit("root"))).union(customer.select(node("c", "c_custkey"), node("n", "c_nationkey")))


@Q(f"WITH RECURSIVE {TREE}, down AS (SELECT 'r1' AS id UNION SELECT e.id FROM e JOIN down ON e.parent = down.id) SELECT id FROM down")
def folder_closure(spark, sf_dir):
    return hierarchy.closure(spark.createDataFrame([("r1",)], "id string"), _tree(spark, sf_dir))


@Q(f"WITH RECURSIVE {TREE}, up AS (SELECT 'c' || c_custkey AS id FROM customer WHERE c_acctbal > 9950 UNION SELECT e.parent FROM e JOIN up ON e.id = up.id) SELECT id FROM up")
def visible_ancestors(spark, sf_dir):
    seeds = table(spark, sf_dir, "customer").filter("c_acctbal > 9950").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"))
    return hierarchy.closure(seeds, _tree(spark, sf_dir), down=False)


WORDS = r"regexp_extract_all(lower(text), '[a-z0-9]+')"


@Q(rf"WITH w AS (SELECT conv_id, turn, list_distinct({WORDS}) AS s FROM conversations) SELECT a.conv_id, a.turn AS l, b.turn AS r, round(CASE WHEN len(list_distinct(a.s || b.s)) = 0 THEN 1.0 ELSE len(list_intersect(a.s, b.s)) / len(list_distinct(a.s || b.s)) END, 4) AS jaccard FROM w a JOIN w b ON a.conv_id = b.conv_id AND a.turn < b.turn")
def jaccard_pairs(spark, sf_dir):
    """All pairs of answers within their group."""
    w = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))).alias("s"))
    a, b = w.select("conv_id", F.col("turn").alias("l"), F.col("s").alias("x")), w.select("conv_id", F.col("turn").alias("r"), F.col("s").alias("y"))
    return a.join(b, "conv_id").filter("l < r").select("conv_id", "l", "r", F.round(X.jaccard(F.col("x"), F.col("y")), 4).alias("jaccard"))


@Q(rf"WITH c AS (SELECT conv_id, turn, w, count(*) AS n FROM (SELECT conv_id, turn, unnest({WORDS}) AS w FROM conversations) GROUP BY ALL), m AS (SELECT conv_id, turn, sqrt(sum(n * n)) AS m FROM c GROUP BY ALL) SELECT a.conv_id, a.turn AS l, b.turn AS r, round(sum(a.n * b.n) / (any_value(ma.m) * any_value(mb.m)), 4) AS cosine FROM c a JOIN c b ON a.conv_id = b.conv_id AND a.w = b.w AND a.turn < b.turn JOIN m ma ON ma.conv_id = a.conv_id AND ma.turn = a.turn JOIN m mb ON mb.conv_id = b.conv_id AND mb.turn = b.turn GROUP BY a.conv_id, a.turn, b.turn")
def tf_cosine(spark, sf_dir):
    from harrier.operators.evaluation import tf_cosine

    words = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0)).alias("words"))
    return tf_cosine(words, "turn", ["conv_id"])


@Q(rf"WITH w AS (SELECT doc_id, {WORDS} AS w FROM documents) SELECT doc_id, CASE WHEN len(w) < 4 THEN 0.0::DOUBLE ELSE round(1 - len(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) / (len(w) - 2), 4) END AS redundancy FROM w")
def trigram_redundancy(spark, sf_dir):
    w = table(spark, sf_dir, "documents").select("doc_id", F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0)).alias("w"))
    return w.select("doc_id", X.trigram_redundancy(F.col("w")).alias("redundancy"))
