"""Filters, joins, aggregates, windows and sorts over the benchmark tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstead.functions.scalars import equals_ignoring_case, is_given
from loomstead.operators import relational as ops
from loomstead.plans.base import Registry, Tables
from loomstead.sources.tables import query as bound

query = Registry()
SECRET = r'(?i)token\s*=\s*"[0-9a-f]{40}"'


@query("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey = 42")
def filter_point_lookup(t: Tables) -> DataFrame:
    return t.customer.where(F.col("c_custkey") == 42).select("c_custkey", "c_name", "c_acctbal")


@query("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey = 42")
def filter_bound_parameters(t: Tables) -> DataFrame:
    t.customer.createOrReplaceTempView("bound_customer")
    return bound(t.spark, "SELECT c_custkey, c_name, c_acctbal FROM bound_customer WHERE c_custkey = :key", key=42)


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_custkey = 7 AND o_orderstatus = 'F'")
def filter_conjunction(t: Tables) -> DataFrame:
    return t.orders.where((F.col("o_custkey") == 7) & (F.col("o_orderstatus") == "F")).select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE lower(c_mktsegment) = lower('bUiLdInG')")
def filter_ci_equality(t: Tables) -> DataFrame:
    return t.customer.where(equals_ignoring_case(F.col("c_mktsegment"), F.lit("bUiLdInG"))).select("c_custkey", "c_mktsegment")


@query("SELECT p_partkey, p_name, p_brand, p_type FROM part WHERE contains(lower(p_name), 'steel') OR contains(lower(p_brand), 'steel') OR contains(lower(p_type), 'steel')")
def search_substring_multi(t: Tables) -> DataFrame:
    return ops.search(t.part.select("p_partkey", "p_name", "p_brand", "p_type"), "STEEL", "p_name", "p_brand", "p_type")


@query("SELECT CASE o_orderstatus WHEN 'O' THEN 'idle' WHEN 'P' THEN 'analyzing' WHEN 'F' THEN 'complete' ELSE 'failed' END AS status, count(*) AS n FROM orders WHERE o_orderstatus IN ('O', 'P') GROUP BY 1")
def filter_status_bucket(t: Tables) -> DataFrame:
    o = F.col("o_orderstatus")
    named = t.orders.select(F.when(o == "O", "idle").when(o == "P", "analyzing").when(o == "F", "complete").otherwise("failed").alias("status"))
    return ops.by_named_status(named, "active").groupBy("status").agg(F.count("*").alias("n"))


@query("SELECT o_orderstatus, count(*) AS n, count(*) FILTER (WHERE o_orderstatus IN ('F', 'P')) AS n_listed FROM orders GROUP BY 1")
def filter_allowed_set(t: Tables) -> DataFrame:
    status = F.col("o_orderstatus")
    anyone, listed = ops.in_allowed(status, []), ops.in_allowed(status, ["F", "P"])
    return t.orders.where(anyone).groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.count(F.when(listed, 1)).alias("n_listed"))


@query("SELECT count(*) FILTER (WHERE quality IS NULL) AS missing, count(quality) AS there FROM documents LEFT JOIN labels USING (doc_id)")
def filter_null_test(t: Tables) -> DataFrame:
    joined = t.documents.select("doc_id").join(t.labels, "doc_id", "left")
    return joined.agg(F.count(F.when(F.col("quality").isNull(), 1)).alias("missing"), F.count("quality").alias("there"))


@query("SELECT doc_id, coalesce(lang, '') <> '' AND coalesce(quality, 0) <> 0 AS given FROM documents LEFT JOIN labels USING (doc_id)")
def validate_required(t: Tables) -> DataFrame:
    joined = t.documents.select("doc_id", "lang").join(t.labels, "doc_id", "left")
    return joined.select("doc_id", (is_given(F.col("lang")) & is_given(F.col("quality"), "int")).alias("given"))


@query("SELECT min(o_orderkey) AS o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT'")
def first_match(t: Tables) -> DataFrame:
    return t.orders.where(F.col("o_orderpriority") == "1-URGENT").orderBy("o_orderkey").limit(1).select("o_orderkey")


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey <> 3 AND n_name <> ''")
def remove_matching(t: Tables) -> DataFrame:
    return t.nation.where((F.col("n_nationkey") != 3) & (F.col("n_name") != "")).select("n_nationkey", "n_name")


@query("SELECT page_id, url FROM pages WHERE NOT (starts_with(url, 'http://') OR starts_with(url, 'https://m.'))")
def privacy_ignored_paths(t: Tables) -> DataFrame:
    return ops.without_ignored(t.pages.select("page_id", "url"), "url", ["http://", "https://m."])


@query(f"SELECT doc_id FROM documents WHERE NOT coalesce(regexp_matches(text, '{SECRET}'), false)")
def privacy_secret_filter(t: Tables) -> DataFrame:
    return ops.without_secrets(t.documents.select("doc_id", "text"), "text", SECRET).select("doc_id")


@query("SELECT * FROM (SELECT source, doc_id, CAST(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM documents) WHERE running <= 50000")
def limit_cumulative_budget(t: Tables) -> DataFrame:
    return ops.within_budget(t.documents.select("source", "doc_id", "n_chars"), "source", "n_chars", 50_000, F.col("doc_id")).drop("n_chars")


@query("SELECT c_custkey, c_name, o_orderkey FROM customer JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P'")
def join_inner_membership(t: Tables) -> DataFrame:
    joined = ops.visible_to(t.customer, t.orders.select("o_custkey", "o_orderkey", "o_orderstatus"), "P", "c_custkey", "o_custkey", "o_orderstatus")
    return joined.select("c_custkey", "c_name", "o_orderkey")


@query("SELECT d.doc_id, d.lang, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def join_left_optional(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", "lang").join(t.labels, "doc_id", "left")


@query("SELECT d.doc_id, l.doc_id IS NOT NULL AS has_settings, CASE WHEN l.doc_id IS NOT NULL THEN '{\"doc_id\":' || l.doc_id || ',\"quality\":' || coalesce(CAST(l.quality AS VARCHAR), 'null') || ',\"toxic\":' || coalesce(CAST(l.toxic AS VARCHAR), 'null') || '}' END AS settings FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def join_left_nested_settings(t: Tables) -> DataFrame:
    nested = ops.nest(t.labels, "doc_id", "settings")
    joined = t.documents.select("doc_id").join(nested, "doc_id", "left")
    return joined.select("doc_id", F.col("settings").isNotNull().alias("has_settings"), F.to_json("settings", {"ignoreNullFields": "false"}).alias("settings"))


@query("SELECT user_id, event_type, min(event_id) AS event_id FROM events WHERE user_id IN (SELECT user_id FROM events WHERE event_type = 'error') GROUP BY ALL")
def exists_semi_join(t: Tables) -> DataFrame:
    failed = t.events.where(F.col("event_type") == "error").select("user_id")
    return t.events.join(failed, "user_id", "left_semi").groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"))


@query("""
SELECT c.c_custkey, s.n AS stale_count
FROM customer c LEFT JOIN LATERAL (
  SELECT CAST(count(*) AS INTEGER) AS n FROM lineitem l
  WHERE l.l_orderkey = (SELECT o.o_orderkey FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F' AND o.o_orderpriority = '1-URGENT'
                        ORDER BY o.o_orderdate DESC, o.o_orderkey DESC LIMIT 1)
) s ON true
""")
def lateral_latest_stale_count(t: Tables) -> DataFrame:
    snapshots = t.orders.where((F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") == "1-URGENT"))
    found = ops.latest_with_count(t.customer.select("c_custkey"), "c_custkey", snapshots, "o_custkey", "o_orderdate", "o_orderkey", t.lineitem.select("l_orderkey"), "l_orderkey")
    return found.select("c_custkey", "stale_count")


@query("SELECT l_orderkey, CAST(count(*) AS INTEGER) AS n FROM lineitem GROUP BY 1")
def agg_count_per_key(t: Tables) -> DataFrame:
    return ops.count_per_key(t.lineitem, "l_orderkey")


@query("SELECT CAST(count(*) AS INTEGER) AS n FROM orders WHERE o_orderstatus = 'none such'")
def agg_global_count(t: Tables) -> DataFrame:
    return t.orders.where(F.col("o_orderstatus") == "none such").agg(F.count("*").cast("int").alias("n"))


@query("SELECT p_brand, count(*) AS parts, CAST(sum(p_size) AS BIGINT) AS total_size, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS types FROM part GROUP BY 1")
def module_clusters(t: Tables) -> DataFrame:
    return t.part.groupBy("p_brand").agg(F.count("*").alias("parts"), F.sum("p_size").alias("total_size"), F.array_join(F.array_sort(F.collect_set("p_type")), ",").alias("types"))


@query("SELECT l_suppkey, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) AS position, s_name FROM lineitem JOIN supplier ON s_suppkey = l_suppkey")
def sort_members_by_joined(t: Tables) -> DataFrame:
    order = [F.col(c) for c in ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")]
    joined = t.lineitem.join(t.supplier.select("s_suppkey", "s_name"), F.col("l_suppkey") == F.col("s_suppkey"))
    return ops.numbered_by_range(joined, ["l_suppkey"], *order).select("l_suppkey", "l_orderkey", "l_linenumber", "position", "s_name")


@query("SELECT o_custkey, o_orderkey AS latest FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1")
def latest_per_group(t: Tables) -> DataFrame:
    return ops.latest(t.orders, "o_custkey", "o_orderdate", "o_orderkey")


@query("SELECT c_custkey, c_name FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 1")
def first_as_default(t: Tables) -> DataFrame:
    return t.customer.orderBy(F.desc("c_acctbal"), "c_custkey").limit(1).select("c_custkey", "c_name")


@query("SELECT conv_id, turn, row_number() OVER w AS step, lag(role) OVER w AS previous, lead(role) OVER w AS following FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def workflow_step_sequence(t: Tables) -> DataFrame:
    return ops.steps(t.conversations.select("conv_id", "turn", "role"), "conv_id", "turn", "role").drop("role")


@query("SELECT p_brand, p_partkey, rank FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rank, count(*) OVER (PARTITION BY p_brand) AS n FROM part) WHERE rank <= ceil(n * 0.25)")
def critical_quartile(t: Tables) -> DataFrame:
    return ops.top_share(t.part.select("p_brand", "p_partkey", "p_retailprice"), "p_brand", 0.25, F.desc("p_retailprice"), F.asc("p_partkey")).select("p_brand", "p_partkey", "rank")


@query("SELECT c_custkey, CAST(c_nationkey AS BIGINT) AS nation, 'merged' AS status FROM customer")
def overlay_columns(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", "c_nationkey").withColumns({"nation": F.col("c_nationkey").cast("long"), "status": F.lit("merged")}).drop("c_nationkey")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_extract(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.try_variant_get(F.parse_json("props"), "$.k", "long").alias("k"))


@query("SELECT event_id, '{\"event_id\":' || event_id || ',\"event_type\":\"' || event_type || '\"}' AS json FROM events")
def json_rows(t: Tables) -> DataFrame:
    from loomstead.sources.tables import as_json

    rows = t.events.select("event_id", "event_type")
    return as_json(rows).select(F.get_json_object("json", "$.event_id").cast("long").alias("event_id"), "json")
