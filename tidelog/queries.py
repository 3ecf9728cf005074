"""Named queries over the supplied tables, each with the DuckDB SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import QueryError
from .functions.predicates import register_predicate
from .operators import joins, pull, utility
from .operators.hypergraph import Hypergraph
from .operators.zframe import W, ZFrame
from .plans.compiler import estimated_bytes, run_query
from .sources import datoms as D
from .sources import readers
from .sources.catalog import ID_SPACE, AttributeCatalog, idents, supplied_catalog
from .storage import delete_at_exit, shared_dir
from .streaming import stream as S
from .streaming.view import View

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _datalog(name: str, query: str, sql: str, extended: bool = False, after: Callable[[DataFrame], DataFrame] = lambda d: d) -> None:
    QUERIES[name] = lambda spark, sf_dir: after(run_query(query, supplied_catalog(spark, sf_dir), extended))
    ORACLES[name] = sql


def _query(name: str, sql: str | None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Selection, joins, predicates

_datalog("join_ref_chain", "[:find ?c ?n ?r :where [?x :customer/name ?c] [?x :customer/nation ?y] [?y :nation/name ?n] [?y :nation/region ?z] [?z :region/name ?r]]",
         "SELECT DISTINCT c_name AS c, n_name AS n, r_name AS r FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
_datalog("single_attr", "[:find ?v :where [_ :nation/name ?v]]", "SELECT DISTINCT n_name AS v FROM nation")
_datalog("entity_literal", f"[:find ?v :where [{2 * ID_SPACE + 7} :nation/name ?v]]", "SELECT n_name AS v FROM nation WHERE n_nationkey = 7")
_datalog("const_value", '[:find ?k ?b :where [?c :customer/mktsegment "BUILDING"] [?c :customer/key ?k] [?c :customer/acctbal ?b]]',
         "SELECT c_custkey AS k, c_acctbal AS b FROM customer WHERE c_mktsegment = 'BUILDING'")
_datalog("join_eid_eid", "[:find ?s ?p :where [?o :orders/orderstatus ?s] [?o :orders/orderpriority ?p]]", "SELECT DISTINCT o_orderstatus AS s, o_orderpriority AS p FROM orders")
_datalog("join_shared_value", "[:find ?n (count ?c) :where [?c :customer/nation ?x] [?s :supplier/nation ?x] [?x :nation/name ?n]]",
         "SELECT n_name AS n, count(*)::BIGINT AS count_c FROM customer JOIN supplier ON c_nationkey = s_nationkey JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name")
_datalog("join_multi_var", '[:find ?p ?s :where [?a :lineitem/part ?x] [?a :lineitem/supplier ?y] [?a :lineitem/returnflag "A"] [?b :lineitem/part ?x] [?b :lineitem/supplier ?y] [?b :lineitem/returnflag "R"] [?x :part/key ?p] [?y :supplier/key ?s]]',
         "SELECT DISTINCT a.l_partkey AS p, a.l_suppkey AS s FROM lineitem a JOIN lineitem b ON a.l_partkey = b.l_partkey AND a.l_suppkey = b.l_suppkey WHERE a.l_returnflag = 'A' AND b.l_returnflag = 'R'")
_datalog("self_join", "[:find ?a ?b :where [?x :supplier/nation ?n] [?y :supplier/nation ?n] [?x :supplier/name ?a] [?y :supplier/name ?b] [(distinct? ?a ?b)]]",
         "SELECT DISTINCT a.s_name AS a, b.s_name AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey WHERE a.s_name <> b.s_name")
_datalog("cartesian_two", "[:find ?r ?s :where [_ :region/name ?r] [_ :nation/name ?s]]", "SELECT DISTINCT r_name AS r, n_name AS s FROM region, nation")
_datalog("cartesian_three", "[:find ?a ?b (count ?n) :where [_ :region/name ?a] [_ :region/name ?b] [?n :nation/name ?x]]",
         "SELECT a.r_name AS a, b.r_name AS b, count(*)::BIGINT AS count_n FROM region a, region b, nation GROUP BY a.r_name, b.r_name")
_datalog("pred_lt", "[:find ?k :where [?o :orders/totalprice ?t] [?o :orders/key ?k] [(< ?t 2000)]]", "SELECT o_orderkey AS k FROM orders WHERE o_totalprice < 2000")
_datalog("pred_chain", "[:find ?k :where [?o :orders/totalprice ?t] [?o :orders/key ?k] [(<= 1000 ?t 3000.5 400000)]]", "SELECT o_orderkey AS k FROM orders WHERE 1000 <= o_totalprice AND o_totalprice <= 3000.5")
_datalog("pred_not_eq", '[:find ?s (count ?o) :where [?o :orders/orderstatus ?s] [(not= ?s "F")]]', "SELECT o_orderstatus AS s, count(*)::BIGINT AS count_o FROM orders WHERE o_orderstatus <> 'F' GROUP BY o_orderstatus")
_datalog("pred_aliases", '[:find ?s ?p :where [?o :orders/orderstatus ?s] [?o :orders/orderpriority ?p] [(!= ?s "F")] [(== ?p "1-URGENT")]]',
         "SELECT DISTINCT o_orderstatus AS s, o_orderpriority AS p FROM orders WHERE o_orderstatus <> 'F' AND o_orderpriority = '1-URGENT'")
_datalog("pred_distinct", "[:find ?a ?b ?c :where [_ :region/name ?a] [_ :region/name ?b] [_ :region/name ?c] [(clojure.core/distinct? ?a ?b ?c)]]",
         "SELECT a.r_name AS a, b.r_name AS b, c.r_name AS c FROM region a, region b, region c WHERE a.r_name <> b.r_name AND a.r_name <> c.r_name AND b.r_name <> c.r_name")
_datalog("pred_includes", '[:find ?n :where [_ :part/name ?n] [(clojure.string/includes? ?n "widget")]]', "SELECT DISTINCT p_name AS n FROM part WHERE contains(p_name, 'widget')")
_datalog("pred_time", "[:find ?s (count ?o) :where [?o :orders/orderdate ?d] [?o :orders/orderstatus ?s] [(>= ?d #inst \"1995-06-01\")] [(< ?d #inst \"1996-01-01T00:00:00\")]]",
         "SELECT o_orderstatus AS s, count(*)::BIGINT AS count_o FROM orders WHERE o_orderdate >= TIMESTAMP '1995-06-01' AND o_orderdate < TIMESTAMP '1996-01-01' GROUP BY o_orderstatus")
_datalog("theta_cartesian", "[:find ?a ?b :where [?x :nation/key ?i] [?y :region/key ?j] [?x :nation/name ?a] [?y :region/name ?b] [(< ?i ?j)]]",
         "SELECT DISTINCT n_name AS a, r_name AS b FROM nation, region WHERE n_nationkey < r_regionkey")
_datalog("repeated_variable", "[:find ?k :where [?l :lineitem/linenumber ?k] [?l :lineitem/quantity ?k]]", "SELECT DISTINCT l_linenumber AS k FROM lineitem WHERE l_linenumber = l_quantity")
_datalog("existence", '[:find ?n :where [_ :nation/name ?n] [_ :orders/orderstatus "F"]]', "SELECT DISTINCT n_name AS n FROM nation WHERE EXISTS (SELECT 1 FROM orders WHERE o_orderstatus = 'F')")
_datalog("wildcard_values", f"[:find ?v :where [{2 * ID_SPACE + 7} _ ?v]]",
         f"SELECT '7' AS v UNION SELECT n_name FROM nation WHERE n_nationkey = 7 UNION SELECT CAST({ID_SPACE} + n_regionkey AS VARCHAR) FROM nation WHERE n_nationkey = 7")
_datalog("attribute_variable", f'[:find ?a (count ?e) :where [?e ?a "NATION_7"]]', "SELECT 'nation/name' AS a, count(*)::BIGINT AS count_e FROM nation WHERE n_name = 'NATION_7' HAVING count(*) > 0")

# Aggregates

_datalog("count_by", "[:find ?m (count ?c) :where [?c :customer/mktsegment ?m]]", "SELECT c_mktsegment AS m, count(*)::BIGINT AS count_c FROM customer GROUP BY c_mktsegment")
_datalog("sum_by", "[:find ?f ?s (sum ?q) :where [?l :lineitem/returnflag ?f] [?l :lineitem/linestatus ?s] [?l :lineitem/quantity ?q]]",
         "SELECT l_returnflag AS f, l_linestatus AS s, sum(l_quantity) AS sum_q FROM lineitem GROUP BY ALL")
_datalog("multi_agg", "[:find ?n (count ?l) (sum ?q) (sum ?i) :where [?l :lineitem/supplier ?s] [?l :lineitem/quantity ?q] [?l :lineitem/linenumber ?i] [?s :supplier/nation ?x] [?x :nation/name ?n]]",
         "SELECT n_name AS n, count(*)::BIGINT AS count_l, sum(l_quantity) AS sum_q, sum(l_linenumber)::BIGINT AS sum_i FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name")
_datalog("global_agg", "[:find (sum ?q) (count ?q) :where [?l :lineitem/quantity ?q]]", "SELECT sum(l_quantity) AS sum_q, count(*)::BIGINT AS count_q FROM lineitem")
_datalog("bag_agg_through_join", "[:find ?r (count ?o) :where [?o :orders/customer ?c] [?c :customer/nation ?n] [?n :nation/region ?x] [?x :region/name ?r]]",
         "SELECT r_name AS r, count(*)::BIGINT AS count_o FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
_datalog("shipping_priority", '[:find ?k (count ?l) (sum ?q) :where [?c :customer/mktsegment "BUILDING"] [?o :orders/customer ?c] [?o :orders/key ?k] [?o :orders/orderdate ?d] [?l :lineitem/order ?o] [?l :lineitem/shipdate ?h] [?l :lineitem/quantity ?q] [(< ?d #inst "1995-03-15")] [(> ?h #inst "1995-03-15")]]',
         "SELECT o_orderkey AS k, count(*)::BIGINT AS count_l, sum(l_quantity) AS sum_q FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1995-03-15' AND l_shipdate > TIMESTAMP '1995-03-15' GROUP BY o_orderkey")

_SIGN = "CASE WHEN event_type = 'error' THEN -1 ELSE 1 END"


def _signed_events(spark: SparkSession, sf_dir: str) -> ZFrame:
    """Events as changes: errors are retractions."""
    events = _table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", "ts")
    return ZFrame(events.withColumn(W, F.when(F.col("event_type") == "error", -1).otherwise(1).cast("long")))


@_query("agg_zero_sum", "SELECT n_name AS n, 0::BIGINT AS total, count(*)::BIGINT AS cnt FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def agg_zero_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A group whose sum is zero is there while it has rows."""
    z = ZFrame(_table(spark, sf_dir, "customer").selectExpr("c_nationkey as k")).join(ZFrame(_table(spark, sf_dir, "nation").selectExpr("n_nationkey as k", "n_name as n")), ["k"])
    return z.group(["n"], {"total": F.lit(0).cast("long")}, ["cnt"])


@_query("agg_retraction", f"SELECT user_id, CAST(sum({_SIGN} * (event_id % 10)) AS BIGINT) AS total, CAST(sum({_SIGN}) AS BIGINT) AS cnt FROM events GROUP BY user_id HAVING sum({_SIGN}) <> 0")
def agg_retraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _signed_events(spark, sf_dir).group(["user_id"], {"total": F.col("event_id") % 10}, ["cnt"])


# Z-set algebra


def _users(spark: SparkSession, sf_dir: str) -> ZFrame:
    return _signed_events(spark, sf_dir).select("user_id")


@_query("zset_consolidate", f"SELECT user_id, CAST(sum({_SIGN}) AS BIGINT) AS w FROM events GROUP BY user_id HAVING sum({_SIGN}) <> 0")
def zset_consolidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _users(spark, sf_dir).consolidate().df


@_query("zset_plus", f"SELECT k, CAST(sum(w) AS BIGINT) AS w FROM (SELECT user_id AS k, {_SIGN} AS w FROM events UNION ALL SELECT c_custkey, 1 FROM customer) GROUP BY k HAVING sum(w) <> 0")
def zset_plus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _users(spark, sf_dir).select(F.col("user_id").alias("k")).plus(ZFrame(_table(spark, sf_dir, "customer").selectExpr("c_custkey as k"))).df


@_query("zset_pos_plus", f"SELECT k, CAST(sum(w) AS BIGINT) AS w FROM (SELECT user_id AS k, {_SIGN} AS w FROM events UNION ALL SELECT c_custkey, -3 FROM customer) GROUP BY k HAVING sum(w) > 0")
def zset_pos_plus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _users(spark, sf_dir).select(F.col("user_id").alias("k")).pos_plus(ZFrame(_table(spark, sf_dir, "customer").selectExpr("c_custkey as k", "-3L as w"))).df


@_query("zset_negate", f"SELECT user_id, CAST(-sum({_SIGN}) AS BIGINT) AS w FROM events GROUP BY user_id HAVING sum({_SIGN}) <> 0")
def zset_negate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _users(spark, sf_dir).negate().consolidate().df


@_query("zset_inverse", "SELECT c_custkey AS user_id, 1::BIGINT AS w FROM customer")
def zset_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """z + (-z) is empty: what is added to it stays alone."""
    z = _users(spark, sf_dir)
    return z.plus(z.negate(), ZFrame(_table(spark, sf_dir, "customer").selectExpr("c_custkey as user_id"))).df


_LAWS = f"(SELECT user_id AS k, {_SIGN} AS w FROM events)"


@_query("zset_laws", f"SELECT law, CASE law WHEN 'commutes' THEN (SELECT count(*) FROM (SELECT k FROM (SELECT * FROM {_LAWS} UNION ALL SELECT c_custkey, 1 FROM customer) GROUP BY k HAVING sum(w) <> 0)) WHEN 'associates' THEN (SELECT count(*) FROM (SELECT k FROM (SELECT * FROM {_LAWS} UNION ALL SELECT c_custkey, 1 FROM customer UNION ALL SELECT s_suppkey, 1 FROM supplier) GROUP BY k HAVING sum(w) <> 0)) ELSE (SELECT count(*) FROM (SELECT a.k FROM (SELECT * FROM {_LAWS} UNION ALL SELECT c_custkey, 1 FROM customer) a JOIN supplier ON k = s_suppkey GROUP BY a.k HAVING sum(w) <> 0)) END::BIGINT AS n, 0::BIGINT AS differ FROM (SELECT unnest(['commutes', 'associates', 'distributes']) AS law)")
def zset_laws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Laws over the tables: rows of one side, and rows in which the sides differ."""
    a = _users(spark, sf_dir).select(F.col("user_id").alias("k"))
    b, c = ZFrame(_table(spark, sf_dir, "customer").selectExpr("c_custkey as k")), ZFrame(_table(spark, sf_dir, "supplier").selectExpr("s_suppkey as k"))
    sides = {
        "commutes": (a.plus(b), b.plus(a)),
        "associates": (a.plus(b).plus(c), a.plus(b.plus(c))),
        "distributes": (a.plus(b).indexed_times(c, ["k"]).consolidate(), a.indexed_times(c, ["k"]).plus(b.indexed_times(c, ["k"]))),
    }
    rows = [x.df.agg(F.count("*").alias("n")).crossJoin(x.minus(y).df.agg(F.count("*").alias("differ"))).select(F.lit(law).alias("law"), "n", "differ") for law, (x, y) in sides.items()]
    return rows[0].union(rows[1]).union(rows[2])


@_query("zset_indexed_pos_plus", f"SELECT user_id, event_type, CAST(sum(w) AS BIGINT) AS w FROM (SELECT user_id, event_type, {_SIGN} AS w FROM events UNION ALL SELECT c_custkey, 'error', 2 FROM customer) GROUP BY ALL HAVING sum(w) > 0")
def zset_indexed_pos_plus(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = _signed_events(spark, sf_dir).select("user_id", "event_type").index("user_id")
    return z.indexed_pos_plus(ZFrame(_table(spark, sf_dir, "customer").selectExpr("c_custkey as user_id", "'error' as event_type", "2L as w"))).df


@_query("zset_times", f"SELECT event_type, r_name, CAST(sum({_SIGN}) AS BIGINT) AS w FROM events, region GROUP BY ALL HAVING sum({_SIGN}) <> 0")
def zset_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _signed_events(spark, sf_dir).select("event_type").consolidate().times(ZFrame(_table(spark, sf_dir, "region").select("r_name"))).consolidate().df


@_query("zset_indexed_times", f"SELECT user_id, c_mktsegment, CAST(sum({_SIGN}) AS BIGINT) AS w FROM events JOIN customer ON user_id = c_custkey GROUP BY ALL HAVING sum({_SIGN}) <> 0")
def zset_indexed_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _users(spark, sf_dir).indexed_times(ZFrame(_table(spark, sf_dir, "customer").selectExpr("c_custkey as user_id", "c_mktsegment")), ["user_id"]).consolidate().df


@_query("zset_indexed_plus", f"SELECT user_id, event_type, CAST(sum(2 * ({_SIGN})) AS BIGINT) AS w FROM events GROUP BY ALL HAVING sum({_SIGN}) <> 0")
def zset_indexed_plus(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = _signed_events(spark, sf_dir).select("user_id", "event_type")
    return z.index("user_id").indexed_plus(z).df


@_query("zset_total_weight", f"SELECT CAST(sum({_SIGN}) AS BIGINT) AS total FROM events")
def zset_total_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _users(spark, sf_dir).total_weight()


@_query("zset_plus_mapped", "SELECT k, CAST(sum(w) AS BIGINT) AS w FROM (SELECT n_nationkey AS k, 1 AS w FROM nation UNION ALL SELECT r_regionkey + 1, 1 FROM region) GROUP BY k")
def zset_plus_mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = ZFrame(_table(spark, sf_dir, "nation").selectExpr("n_nationkey as k"))
    return nations.plus_mapped(ZFrame(_table(spark, sf_dir, "region").selectExpr("r_regionkey as k")), lambda z: z.select((F.col("k") + 1).alias("k"))).df


@_query("conditional_routing", "SELECT CASE WHEN n_nationkey < 5 THEN 'low' WHEN n_nationkey < 15 THEN 'middle' ELSE 'high' END AS band, n_name, 1::BIGINT AS w FROM nation")
def conditional_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    def band(x: str):
        return lambda z: z.select(F.lit(x).alias("band"), "n_name")

    return ZFrame(_table(spark, sf_dir, "nation")).route((F.col("n_nationkey") < 5, band("low")), (F.col("n_nationkey") < 15, band("middle")), (None, band("high"))).df


# Set operations and joins beyond the grammar


def _keys(spark: SparkSession, sf_dir: str) -> tuple[ZFrame, ZFrame]:
    return ZFrame(_table(spark, sf_dir, "customer").selectExpr("c_nationkey as k")), ZFrame(_table(spark, sf_dir, "supplier").selectExpr("s_nationkey as k"))


_BOTH = "(SELECT c_nationkey AS k, 1 AS w FROM customer UNION ALL SELECT s_nationkey, {} FROM supplier)"


@_query("bag_union", f"SELECT k, CAST(sum(w) AS BIGINT) AS w FROM {_BOTH.format(1)} GROUP BY k")
def bag_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.union(*_keys(spark, sf_dir)).df


@_query("bag_difference", f"SELECT k, CAST(sum(w) AS BIGINT) AS w FROM {_BOTH.format(-1)} GROUP BY k HAVING sum(w) <> 0")
def bag_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.difference(*_keys(spark, sf_dir)).df


@_query("set_union", "SELECT c_custkey % 90 AS k FROM customer UNION SELECT s_suppkey + 50 FROM supplier")
def set_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.set_union(*_odd_keys(spark, sf_dir)).df.drop(W)


def _odd_keys(spark: SparkSession, sf_dir: str) -> tuple[ZFrame, ZFrame]:
    return ZFrame(_table(spark, sf_dir, "customer").selectExpr("c_custkey % 90 as k")), ZFrame(_table(spark, sf_dir, "supplier").selectExpr("s_suppkey + 50 as k"))


@_query("set_difference", "SELECT c_custkey % 90 AS k FROM customer EXCEPT SELECT s_suppkey + 50 FROM supplier")
def set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.set_difference(*_odd_keys(spark, sf_dir)).df.drop(W)


@_query("set_intersection", "SELECT c_custkey % 90 AS k FROM customer INTERSECT SELECT s_suppkey + 50 FROM supplier")
def set_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.intersection(*_odd_keys(spark, sf_dir)).df.drop(W)


@_query("ext_left_join", "SELECT c_custkey, o_orderkey, 1::BIGINT AS w FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'P'")
def ext_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").selectExpr("o_custkey as c_custkey", "o_orderkey")
    return joins.left_outer(ZFrame(_table(spark, sf_dir, "customer").select("c_custkey")), ZFrame(orders), ["c_custkey"]).df


@_query("ext_semi_join", "SELECT c_custkey, 1::BIGINT AS w FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def ext_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").selectExpr("o_custkey as c_custkey")
    return joins.semi(ZFrame(_table(spark, sf_dir, "customer").select("c_custkey")), ZFrame(orders), ["c_custkey"]).df


_datalog("ext_not", '[:find ?n :where [?c :customer/name ?n] (not [?o :orders/customer ?c] [?o :orders/orderstatus "P"])]',
         "SELECT DISTINCT c_name AS n FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')", True)
_datalog("ext_or", '[:find ?k :where [?c :customer/key ?k] (or [?c :customer/mktsegment "BUILDING"] (and [?c :customer/nation ?n] [?n :nation/name "NATION_3"]))]',
         "SELECT DISTINCT c_custkey AS k FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment = 'BUILDING' OR n_name = 'NATION_3'", True)
_datalog("ext_get_else", '[:find ?k ?v :where [?c :customer/key ?k] [(get-else $ ?c :customer/mktsegment "none") ?v]]', "SELECT c_custkey AS k, coalesce(c_mktsegment, 'none') AS v FROM customer", True)
_datalog("ext_avg_min_max", "[:find ?m (min ?k) (max ?k) (avg ?k) (count-distinct ?n) :where [?c :customer/mktsegment ?m] [?c :customer/key ?k] [?c :customer/nation ?n]]",
         "SELECT c_mktsegment AS m, min(c_custkey) AS min_k, max(c_custkey) AS max_k, sum(c_custkey)::DOUBLE / count(*) AS avg_k, count(DISTINCT c_nationkey)::BIGINT AS count_distinct_n FROM customer GROUP BY c_mktsegment", True)
_datalog("ext_with", "[:find (sum ?s) :with ?p :where [?l :lineitem/part ?x] [?x :part/size ?s] [?x :part/key ?p]]",
         "SELECT CAST(sum(p_size) AS BIGINT) AS sum_s FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem)", True)


@_query("param_query", "SELECT n_name AS n, count(*)::BIGINT AS count_c FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name IN ('NATION_1', 'NATION_5') GROUP BY n_name")
def param_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = spark.createDataFrame([("NATION_1",), ("NATION_5",), ("nowhere",)], "n string")
    return run_query("[:find ?n (count ?c) :in $ ?n :where [?c :customer/nation ?x] [?x :nation/name ?n]]", supplied_catalog(spark, sf_dir), True, given)


# Changes, views, streams


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' nations and balances class as a datom log of three transactions, and retractions of every seventh customer in a fourth."""
    customer = _table(spark, sf_dir, "customer").selectExpr("*", "c_custkey % 3 + 1 as tx")
    asserted = D.unpivot(customer, "c_custkey", {"c_nationkey": "customer/nation", "c_mktsegment": "customer/segment"}, "tx")
    gone = D.unpivot(customer.where("c_custkey % 7 = 0"), "c_custkey", {"c_nationkey": "customer/nation", "c_mktsegment": "customer/segment"}).withColumn("w", F.lit(-1).cast("long")).withColumn("tx", F.lit(4).cast("long"))
    nations = D.unpivot(_table(spark, sf_dir, "nation"), "n_nationkey", {"n_name": "nation/name"})
    return asserted.unionByName(gone).unionByName(nations.withColumn("tx", F.lit(2).cast("long")))


_TYPES = {"customer/nation": "long", "customer/segment": "string", "nation/name": "string"}


def _view(spark: SparkSession, query: str) -> View:
    view = View(spark, query, _TYPES)
    delete_at_exit(spark, view.path)
    return view


@_query("incremental_join", "SELECT DISTINCT c_custkey AS c, n_name AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 7 <> 0")
def incremental_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = _view(spark, "[:find ?c ?n :where [?c :customer/nation ?x] [?x :nation/name ?n]]")
    view.replay(_changes(spark, sf_dir))
    return view.result()


@_query("incremental_agg", "SELECT n_name AS n, count(*)::BIGINT AS count_c, CAST(sum(c_custkey) AS BIGINT) AS sum_c FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 7 <> 0 GROUP BY n_name")
def incremental_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = _view(spark, "[:find ?n (count ?c) (sum ?c) :where [?c :customer/nation ?x] [?x :nation/name ?n]]")
    view.replay(_changes(spark, sf_dir))
    return view.result()


@_query("as_of", "SELECT n_name AS n, count(*)::BIGINT AS count_c FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 3 + 1 <= 2 GROUP BY n_name")
def as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = _view(spark, "[:find ?n (count ?c) :where [?c :customer/nation ?x] [?x :nation/name ?n]]")
    view.replay(_changes(spark, sf_dir))
    return view.as_of(2)


@_query("history_index", "SELECT DISTINCT (c_custkey % 3 + 1)::BIGINT AS tx FROM customer UNION SELECT 2 FROM nation UNION SELECT 4 FROM customer WHERE c_custkey % 7 = 0")
def history_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = _view(spark, "[:find ?s (count ?c) :where [?c :customer/segment ?s]]")
    view.replay(_changes(spark, sf_dir))
    return spark.createDataFrame([(t,) for t in view.history_index()], "tx long")


@_query("update_overwrite", "SELECT user_id, arg_max(event_type, event_id) AS v FROM events GROUP BY user_id")
def update_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event replaces its user's type: -old, +new in two steps, then the sum of weights."""
    events = _table(spark, sf_dir, "events")
    last = lambda df: df.groupBy(F.col("user_id").alias("e")).agg(F.max_by("event_type", "event_id").alias("v"))
    half = last(events.where("event_id % 2 = 0"))
    now = last(events)
    z = ZFrame(half).union(ZFrame(D.overwrite(half, now))).plus(ZFrame(now.join(half, "e", "left_anti")).select("e", "v"))
    # New users come with the second step's assertions; what both branches assert counts once.
    return z.positive().df.drop(W).distinct().withColumnRenamed("e", "user_id")


@_query("cdc_log_range", "SELECT c_custkey % 3 + 1 AS tx, (2 * count(*) + CASE WHEN c_custkey % 3 + 1 = 2 THEN (SELECT count(*) FROM nation) ELSE 0 END)::BIGINT AS n FROM customer GROUP BY c_custkey % 3 + 1 HAVING c_custkey % 3 + 1 IN (1, 2)")
def cdc_log_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.log_range(_changes(spark, sf_dir), 1, 3).groupBy("tx").agg(F.count("*").alias("n"))


@_query("all_transactions", "SELECT DISTINCT (c_custkey % 3 + 1)::BIGINT AS tx FROM customer UNION SELECT 2 FROM nation UNION SELECT 4 FROM customer WHERE c_custkey % 7 = 0")
def all_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.all_transactions(_changes(spark, sf_dir))


@_query("datom_wide_to_long", "SELECT 'n_name' AS a, n_nationkey::BIGINT AS e, n_name AS v FROM nation UNION ALL SELECT 'n_regionkey', n_nationkey, n_regionkey::VARCHAR FROM nation")
def datom_wide_to_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.unpivot(_table(spark, sf_dir, "nation"), "n_nationkey", {"n_name": "n_name", "n_regionkey": "n_regionkey"}).select("a", "e", "v")


@_query("idents_resolved", "SELECT n_nationkey::BIGINT AS e, n_name AS v, 'nation/name' AS a FROM nation")
def idents_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbered = _table(spark, sf_dir, "nation").selectExpr("cast(n_nationkey as bigint) as e", "n_name as v", "72L as attr_id")
    return idents(numbered, spark.createDataFrame([(72, "nation/name"), (73, "nation/region")], "attr_id long, attr string")).select("e", "v", "a")


@_query("last_datoms", "SELECT n_nationkey::BIGINT AS e, n_name AS v FROM nation ORDER BY n_nationkey DESC LIMIT 5")
def last_datoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.last_datoms(D.unpivot(_table(spark, sf_dir, "nation"), "n_nationkey", {"n_name": "nation/name"}), 5).select("e", "v")


@_query("changes_to_weights", f"SELECT user_id, CAST(sum({_SIGN}) AS BIGINT) AS w FROM events GROUP BY user_id HAVING sum({_SIGN}) <> 0")
def changes_to_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ZFrame.from_changes(_table(spark, sf_dir, "events").selectExpr("user_id", "event_type <> 'error' as added")).consolidate().df


@_query("intake_per_second", "SELECT date_trunc('second', ts) AS start, count(*)::BIGINT AS n FROM events GROUP BY 1")
def intake_per_second(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.intake(_table(spark, sf_dir, "events"))


@_query("intake_sliding", "SELECT event_id, count(*) OVER (ORDER BY epoch_us(ts) RANGE BETWEEN 599999999 PRECEDING AND CURRENT ROW)::BIGINT AS n FROM events")
def intake_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.sliding_intake(_table(spark, sf_dir, "events"), 600).select("event_id", "n")


@_query("stream_maintained_agg", "SELECT event_type AS t, count(*)::BIGINT AS count_e FROM events GROUP BY event_type")
def stream_maintained_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a datom stream, folded into a view batch by batch."""
    path = shared_dir(spark, "stream")
    delete_at_exit(spark, path)
    D.unpivot(_table(spark, sf_dir, "events"), "event_id", {"event_type": "event/type"}).write.parquet(f"{path}/in")
    view = View(spark, "[:find ?t (count ?e) :where [?e :event/type ?t]]", {"event/type": "string"}, f"{path}/view")
    S.maintain(view, S.read_datoms(spark, f"{path}/in"), f"{path}/checkpoint").awaitTermination()
    return view.result()


@_query("stream_delta_join", f"SELECT c_mktsegment, CAST(sum({_SIGN}) AS BIGINT) AS w FROM events JOIN customer ON user_id = c_custkey GROUP BY ALL")
def stream_delta_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two change streams joined by Spark's stateful join; the pairs land in a table and are added up."""
    path = shared_dir(spark, "join")
    delete_at_exit(spark, path)
    left = _users(spark, sf_dir).df
    right = ZFrame(_table(spark, sf_dir, "customer").selectExpr("c_custkey as user_id", "c_mktsegment")).df
    left.write.parquet(f"{path}/left")
    right.write.parquet(f"{path}/right")
    streams = [spark.readStream.schema(df.schema).parquet(f"{path}/{side}") for df, side in ((left, "left"), (right, "right"))]
    S.delta_join(*streams, ["user_id"]).writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/out").groupBy("c_mktsegment").agg(F.sum(W).alias(W))


# Nested results, hypergraphs, helpers


@_query("pull_nested", "SELECT r_name, count(*)::BIGINT AS n, string_agg(n_name, ',' ORDER BY n_name) AS names FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY r_name")
def pull_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = _table(spark, sf_dir, "nation").join(_table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    nested = pull.pull(flat, ["r_name", {"nations": ["n_name", "n_nationkey"]}])
    return nested.select("r_name", F.size("nations").cast("long").alias("n"), F.array_join(F.transform("nations", lambda x: x.n_name), ",").alias("names"))


@_query("pull_entities", "SELECT c_custkey AS k, c_mktsegment AS segment, n_name AS nation, r_name AS region FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def pull_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = supplied_catalog(spark, sf_dir)
    customers = catalog.star(["customer/key"]).df.select("e", F.col("v0").alias("k"))
    pulled = pull.pull_entities(catalog, customers, ["customer/mktsegment", {"customer/nation": ["nation/name", {"nation/region": ["region/name"]}]}])
    return pulled.select("k", F.col("pulled.mktsegment").alias("segment"), F.col("pulled.nation.name").alias("nation"), F.col("pulled.nation.region.name").alias("region"))


@_query("datom_log_files", "SELECT c_custkey % 3 + 1 AS tx, count(*)::BIGINT AS n FROM customer WHERE c_custkey % 3 + 1 < 3 GROUP BY 1")
def datom_log_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A datom log written by attribute and transaction; the read skips the folders it does not need."""
    path = shared_dir(spark, "log")
    delete_at_exit(spark, path)
    readers.write_datoms(_changes(spark, sf_dir), path)
    return readers.read_datoms(spark, path, ["customer/segment"], 1, 3).groupBy("tx").agg(F.count("*").alias("n"))


def _baskets(spark: SparkSession, sf_dir: str) -> Hypergraph:
    """Orders as edges over suppliers."""
    return Hypergraph(_table(spark, sf_dir, "lineitem").selectExpr("l_orderkey as edge_id", "l_suppkey as vertex"))


@_query("hypergraph_neighbors", "SELECT DISTINCT b.l_suppkey AS vertex FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey WHERE a.l_suppkey = 3 AND b.l_suppkey <> 3")
def hypergraph_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _baskets(spark, sf_dir).neighbors(3)


@_query("hypergraph_remove_vertex", "SELECT l_orderkey AS edge_id, count(DISTINCT l_suppkey)::BIGINT AS n FROM lineitem WHERE l_suppkey <> 3 GROUP BY l_orderkey")
def hypergraph_remove_vertex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _baskets(spark, sf_dir).remove_vertex(3).hyperedges().select("edge_id", F.size("vertices").cast("long").alias("n"))


@_query("hypergraph_sets", "SELECT count(DISTINCT s)::BIGINT AS edges FROM (SELECT list_sort(list(DISTINCT l_suppkey)) AS s FROM lineitem GROUP BY l_orderkey)")
def hypergraph_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal vertex sets are one edge."""
    sets = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("s"))
    return Hypergraph.from_sets(sets, "l_orderkey", "s").incidence.agg(F.countDistinct("edge_id").alias("edges"))


@_query("keep_every_nth", "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders) WHERE i % 7 = 0")
def keep_every_nth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return utility.keep_every_nth(_table(spark, sf_dir, "orders").select("o_orderkey"), 7, "o_orderkey")


@_query("group_and_map", "SELECT n_regionkey, string_agg(lower(n_name), ',' ORDER BY lower(n_name)) AS names FROM nation GROUP BY n_regionkey")
def group_and_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return utility.group_and_map(_table(spark, sf_dir, "nation"), ["n_regionkey"], F.lower("n_name"), "x").select("n_regionkey", F.array_join("x", ",").alias("names"))


@_query("map_and_filter", "SELECT n_nationkey * 2 AS n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN upper(n_name) ELSE lower(n_name) END AS n_name FROM nation WHERE n_nationkey * 2 > 20")
def map_and_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _table(spark, sf_dir, "nation").select("n_nationkey", F.lower("n_name").alias("n_name"))
    df = utility.map_when(df, F.col("n_nationkey") % 2 == 0, "n_name", F.upper)
    return utility.map_filter_values(df, "n_nationkey", lambda c: c * 2, lambda c: c > 20)


@_query("cat_when", "SELECT n_nationkey, unnest(CASE WHEN n_nationkey < 3 THEN [n_name, 'x'] ELSE [n_name] END) AS n_name FROM nation")
def cat_when(spark: SparkSession, sf_dir: str) -> DataFrame:
    return utility.cat_when(_table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), F.col("n_nationkey") < 3, "n_name", F.array("n_name", F.lit("x")))


@_query("key_intersection", "SELECT DISTINCT c_nationkey AS k FROM customer WHERE c_nationkey IN (SELECT s_nationkey FROM supplier)")
def key_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return utility.key_intersection(*(z.df for z in _keys(spark, sf_dir)), "k")


# Streams, registry, imports and errors


#: Bytes of events, by the estimate of their scan, in a file of their stream.
STREAM_FILE_BYTES = 2**22


def _event_stream(spark: SparkSession, sf_dir: str, batches: int) -> tuple[str, DataFrame, View]:
    """Events as a folder of datom files, event e in transaction e % 4 + 1, the stream that reads it in ``batches``, and a view of their types."""
    path = shared_dir(spark, "stream")
    delete_at_exit(spark, path)
    events = _table(spark, sf_dir, "events").selectExpr("*", "event_id % 4 + 1 as tx")
    rows = D.unpivot(events, "event_id", {"event_type": "event/type"}, "tx")
    files = estimated_bytes(events.select("event_id", "event_type")) // STREAM_FILE_BYTES + 1
    rows.repartition(batches * files, "e").write.parquet(f"{path}/in")
    stream = S.read_datoms(spark, f"{path}/in", files_per_batch=files if batches > 1 else None)
    return path, stream, View(spark, "[:find ?t (count ?e) :where [?e :event/type ?t]]", {"event/type": "string"}, f"{path}/view")


@_query("stream_as_of", "SELECT event_type AS t, count(*)::BIGINT AS count_e FROM events WHERE event_id % 4 + 1 <= 2 GROUP BY event_type")
def stream_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions that are spread over micro-batches, read as of the second one."""
    path, stream, view = _event_stream(spark, sf_dir, 2)
    S.maintain(view, stream, f"{path}/checkpoint").awaitTermination()
    return view.as_of(2)


@_query("registry_served", "SELECT event_type AS t, count(*)::BIGINT AS count_e FROM events GROUP BY event_type")
def registry_served(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A named view that a stream keeps up to date, read by SQL after the stream was stopped."""
    path, stream, view = _event_stream(spark, sf_dir, 1)
    registry, name = S.Registry(spark), "served_" + path.rsplit("-", 1)[-1]
    registry.sync(name, view, stream, f"{path}/checkpoint")
    registry.running[name].awaitTermination()
    registry.stop(name)
    registry.serve(name)
    return spark.sql(f"SELECT t, count_e FROM {name}")


@_query("registry_status", "SELECT 'types' AS name, count(DISTINCT event_id % 4)::BIGINT AS transactions, count(*)::BIGINT AS input_rows, false AS active FROM events")
def registry_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the registry says of a stream that has ended."""
    path, stream, view = _event_stream(spark, sf_dir, 1)
    registry = S.Registry(spark)
    registry.sync("types", view, stream, f"{path}/checkpoint")
    registry.running["types"].awaitTermination()
    status = registry.status()["types"]
    return spark.createDataFrame([("types", int(status["transactions"]), int(status["progress"]["numInputRows"]), status["active"])], "name string, transactions long, input_rows long, active boolean")


@_query("stream_progress", "SELECT count(*)::BIGINT AS n FROM events")
def stream_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that progress reports count, batch by batch."""
    path, stream, view = _event_stream(spark, sf_dir, 2)
    seen: dict[int, int] = {}
    running = S.maintain(view, stream, f"{path}/checkpoint")
    running.awaitTermination()
    for report in running.recentProgress:
        seen[report["batchId"]] = report["numInputRows"]
    return spark.createDataFrame([(sum(seen.values()),)], "n long")


@_query("stream_intake_late", "SELECT date_trunc('hour', ts) AS start, count(*)::BIGINT AS n FROM events GROUP BY 1")
def stream_intake_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly windows of a stream whose watermark lets all rows in, as the last batch left them."""
    path = shared_dir(spark, "intake")
    delete_at_exit(spark, path)
    name = "intake_" + path.rsplit("-", 1)[-1]
    events = _table(spark, sf_dir, "events")
    events.repartition(2).write.parquet(f"{path}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    hours = S.intake(stream.withColumn("ts", F.col("ts").cast("timestamp")), length="1 hour", late="4000 days")
    hours.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    return spark.table(name).select(F.col("start").cast("timestamp_ntz").alias("start"), "n")


@_query("edn_import", "SELECT 5::BIGINT AS tx, n_nationkey::BIGINT AS e, 'nation/name' AS a, n_name AS v, 1::BIGINT AS w FROM nation UNION ALL SELECT 1, r_regionkey, 'region/name', r_name, 1 FROM region")
def edn_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as datom vectors and regions as entity maps, through EDN files."""
    path = shared_dir(spark, "edn")
    delete_at_exit(spark, path)
    _table(spark, sf_dir, "nation").selectExpr("concat('[', n_nationkey, ' :nation/name \"', n_name, '\" 5 true]') as value").write.text(f"{path}/lines")
    _table(spark, sf_dir, "region").selectExpr("concat('{:db/id ', r_regionkey, '\\n :region/name \"', r_name, '\"}') as value").coalesce(1).write.text(f"{path}/whole")
    return D.read_edn(spark, f"{path}/lines", lines=True).union(D.read_edn(spark, f"{path}/whole"))


_REJECTED = {
    "no pattern": "[:find ?x :where [(< 1 2)]]",
    "unbound in find": "[:find ?y :where [?x :nation/name ?n]]",
    "unbound in predicate": "[:find ?x :where [?x :nation/name ?n] [(< ?z 2)]]",
    "unknown attribute": "[:find ?x :where [?x :nation/color ?n]]",
    "unknown operator": "[:find ?x :where [?x :nation/name ?n] [(near ?n 2)]]",
    "four places": "[:find ?x :where [?x :nation/name ?n 1]]",
    "collection": "[:find ?x :where [?x :nation/name #{1}]]",
    "number and text": '[:find ?x :where [?x :nation/key ?n] [(< ?n "b")]]',
}


@_query("rejected_queries", "SELECT * FROM (VALUES ('no pattern', 'UnsupportedQueryError'), ('unbound in find', 'UnboundVariableError'), ('unbound in predicate', 'UnboundVariableError'), ('unknown attribute', 'UnknownAttributeError'), ('unknown operator', 'UnsupportedQueryError'), ('four places', 'UnsupportedQueryError'), ('collection', 'UnsupportedQueryError'), ('number and text', 'TypeMismatchError')) t(query, error)")
def rejected_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors that wrong queries are refused with, before anything runs."""
    out = []
    for name, query in _REJECTED.items():
        try:
            run_query(query, supplied_catalog(spark, sf_dir))
            out.append((name, "none"))
        except (QueryError, TypeError, LookupError, ValueError) as e:
            out.append((name, type(e).__name__))
    return spark.createDataFrame(out, "query string, error string")


@_query("custom_predicate", "SELECT DISTINCT c_custkey AS k FROM customer WHERE c_acctbal BETWEEN 100 AND 900 AND starts_with(c_mktsegment, 'B')")
def custom_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    register_predicate("between?", lambda args: args[0].between(args[1], args[2]))
    register_predicate("starts?", lambda args: args[0].startswith(args[1]))
    return run_query('[:find ?k :where [?c :customer/key ?k] [?c :customer/acctbal ?b] [?c :customer/mktsegment ?m] [(between? ?b 100 900)] [(starts? ?m "B")]]', supplied_catalog(spark, sf_dir))


_JOINS = {
    "entity and entity": "[:find (count ?a) :where [?x :customer/key ?a] [?x :customer/nation ?b]]",
    "value and entity": "[:find (count ?x) :where [?x :customer/nation ?n] [?n :nation/name ?b]]",
    "value and value": "[:find (count ?x) :where [?x :customer/nation ?n] [?y :supplier/nation ?n]]",
    "nothing shared": "[:find (count ?x) :where [?x :region/name ?n] [?y :nation/name ?m]]",
}


@_query("join_kinds", "SELECT 'entity and entity' AS kind, count(*)::BIGINT AS n FROM customer UNION ALL SELECT 'value and entity', count(*) FROM customer UNION ALL SELECT 'value and value', count(*) FROM customer JOIN supplier ON c_nationkey = s_nationkey UNION ALL SELECT 'nothing shared', count(*) FROM region, nation")
def join_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How patterns join, by the places of the variable that they share."""
    parts = [run_query(q, supplied_catalog(spark, sf_dir)).toDF("n").select(F.lit(k).alias("kind"), "n") for k, q in _JOINS.items()]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


_datalog("join_empty_side", '[:find ?r (count ?c) :where [?c :customer/nation ?n] [?n :nation/region ?x] [?x :region/name ?r] [?s :supplier/nation ?n] [?s :supplier/name "Nobody"]]',
         "SELECT r_name AS r, count(*)::BIGINT AS count_c FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey WHERE s_name = 'Nobody' GROUP BY r_name")
_datalog("path_by_name", "[:find ?r ?n ?k :where [?c :customer/key ?k] [?c :customer/nation ?x] [?x :nation/region ?y] [?y :region/name ?r] [?x :nation/name ?n] [(< ?k 50)]]",
         "SELECT r_name AS r, n_name AS n, c_custkey AS k FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_custkey < 50")
_datalog("variable_named_w", "[:find ?w (count ?t) :where [?t :customer/mktsegment ?w]]", "SELECT c_mktsegment AS w, count(*)::BIGINT AS count_t FROM customer GROUP BY c_mktsegment")


@_query("pull_wildcard", "SELECT r_name, r_regionkey, string_agg(n_nationkey || ':' || n_name, ',' ORDER BY n_nationkey) AS nations FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY ALL")
def pull_wildcard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``r_*`` and ``n_*`` expand against the columns."""
    flat = _table(spark, sf_dir, "nation").join(_table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    nested = pull.pull(flat, ["r_*", {"nations": ["n_*"]}])
    return nested.select("r_name", "r_regionkey", F.array_join(F.transform("nations", lambda x: F.concat_ws(":", x.n_nationkey, x.n_name)), ",").alias("nations"))


@_query("pull_transforms", "SELECT upper(r_name) AS r_name, string_agg(n_name, ',' ORDER BY n_name) AS names FROM region JOIN nation ON r_regionkey = n_regionkey AND n_nationkey % 2 = 0 WHERE r_regionkey < 3 GROUP BY ALL")
def pull_transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows are changed and dropped before each level nests."""
    flat = _table(spark, sf_dir, "nation").join(_table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    changes = {"": lambda d: d.where("r_regionkey < 3").withColumn("r_name", F.upper("r_name")), "nations": lambda d: d.where("n_nationkey % 2 = 0")}
    return pull.pull(flat, ["r_name", {"nations": ["n_name"]}], changes).select("r_name", F.array_join(F.transform("nations", lambda x: x.n_name), ",").alias("names"))


@_query("hypergraph_remove_edge", "SELECT s_suppkey AS vertex FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_orderkey <> 7)")
def hypergraph_remove_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without order 7, and without suppliers that only it had."""
    return _baskets(spark, sf_dir).remove_hyperedge(7).vertices


@_query("hypergraph_add", "SELECT l_suppkey AS vertex, count(DISTINCT l_orderkey)::BIGINT + CASE WHEN l_suppkey IN (1, 2) THEN 1 ELSE 0 END AS edges FROM lineitem GROUP BY l_suppkey UNION ALL SELECT -5, 1 UNION ALL SELECT -6, 0")
def hypergraph_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One more edge over two suppliers and a new vertex, and a vertex without an edge."""
    graph = _baskets(spark, sf_dir).add_hyperedge(1, 2, -5).add_vertex(-6)
    return graph.vertices.join(graph.incidence, "vertex", "left").groupBy("vertex").agg(F.count("edge_id").alias("edges"))


@_query("take_last", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey DESC LIMIT 25")
def take_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return utility.take_last(_table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), 25, "o_orderkey")


#: What bench.py times.
HEADLINE = ["join_ref_chain", "const_value", "join_shared_value", "join_multi_var", "sum_by", "multi_agg", "bag_agg_through_join", "shipping_priority", "agg_retraction", "zset_indexed_times", "ext_not", "intake_per_second", "incremental_join", "incremental_agg", "as_of", "hypergraph_neighbors"]
__all__ = ["HEADLINE", "ORACLES", "QUERIES", "AttributeCatalog"]
