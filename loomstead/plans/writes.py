"""Writes, constraints and decisions over the benchmark tables; the change batch is every tenth customer, altered."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstead.operators import decisions, mutations
from loomstead.plans.base import Registry, Tables

query = Registry()
_CUSTOMER = "c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment"


def _changes(t: Tables) -> DataFrame:
    """Every tenth customer with another balance and no segment, and as many new ones."""
    tenth = t.customer.where(F.col("c_custkey") % 10 == 0)
    altered = tenth.withColumns({"c_acctbal": F.col("c_acctbal") + 1, "c_mktsegment": F.lit(None).cast("string"), "c_name": F.lit("changed")})
    return altered.unionByName(altered.withColumn("c_custkey", F.col("c_custkey") + 10_000_000))


@query(f"SELECT {_CUSTOMER} FROM customer UNION ALL SELECT c_custkey + 10000000, c_name, c_nationkey, 0.0, 'idle' FROM customer WHERE c_custkey % 10 = 0")
def insert_with_defaults(t: Tables) -> DataFrame:
    rows = t.customer.where(F.col("c_custkey") % 10 == 0).select((F.col("c_custkey") + 10_000_000).alias("c_custkey"), "c_name", "c_nationkey")
    return mutations.insert(t.customer, rows, {"c_acctbal": F.lit(0.0), "c_mktsegment": F.lit("idle")})


@query(f"""
SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_custkey % 10 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal, CASE WHEN c_custkey % 10 <> 0 THEN c_mktsegment END AS c_mktsegment FROM customer
UNION ALL SELECT c_custkey + 10000000, 'changed', c_nationkey, c_acctbal + 1, NULL FROM customer WHERE c_custkey % 10 = 0""")
def upsert_last_wins(t: Tables) -> DataFrame:
    # the batch holds an older change of each key too
    both = _changes(t).withColumn("seq", F.lit(2)).unionByName(_changes(t).withColumns({"c_acctbal": F.lit(-1.0), "seq": F.lit(1)}))
    return mutations.upsert(t.customer, both, ["c_custkey"], ["c_acctbal", "c_mktsegment"], order="seq")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 AND o_orderstatus = 'O' THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_orderkey % 10 = 0 AND o_orderstatus = 'O' AS changed FROM orders")
def update_guarded_status(t: Tables) -> DataFrame:
    ids = t.orders.where(F.col("o_orderkey") % 10 == 0)
    return mutations.update_guarded(t.orders.select("o_orderkey", "o_orderstatus"), ids, "o_orderkey", F.col("o_orderstatus") == "O", {"o_orderstatus": F.lit("X")})


@query("SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'changed' ELSE c_name END AS c_name, CASE WHEN c_custkey % 20 = 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment FROM customer")
def update_partial_fields(t: Tables) -> DataFrame:
    known = t.customer.where(F.col("c_custkey") % 10 == 0)
    changes = known.select("c_custkey", F.lit("changed").alias("c_name"), F.lit(True).alias("has_c_name"), F.lit(None).cast("string").alias("c_mktsegment"), (F.col("c_custkey") % 20 == 0).alias("has_c_mktsegment"))
    return mutations.update_partial(t.customer.select("c_custkey", "c_name", "c_mktsegment"), changes, ["c_custkey"], ["c_name", "c_mktsegment"])


@query(f"SELECT {_CUSTOMER} FROM customer WHERE c_custkey % 10 <> 0")
def delete_anti(t: Tables) -> DataFrame:
    return mutations.delete(t.customer, _changes(t).select("c_custkey"), ["c_custkey"])


@query(f"SELECT {_CUSTOMER} FROM customer UNION ALL SELECT c_custkey + 10000000, 'changed', c_nationkey, c_acctbal + 1, NULL FROM customer WHERE c_custkey % 10 = 0")
def insert_ignore_existing(t: Tables) -> DataFrame:
    return mutations.insert_ignore(t.customer, _changes(t), ["c_custkey"])


@query("""SELECT l_orderkey, l_linenumber, rule FROM (
  SELECT l_orderkey, l_linenumber, 'quantity' AS rule FROM lineitem WHERE NOT (l_quantity BETWEEN 1 AND 45)
  UNION ALL SELECT l_orderkey, l_linenumber, 'discount' FROM lineitem WHERE NOT (l_discount < 0.09)
  UNION ALL SELECT l_orderkey, l_linenumber, 'flag' FROM lineitem WHERE NOT (l_returnflag IN ('A', 'N')))""")
def dq_check_violations(t: Tables) -> DataFrame:
    rules = {"quantity": F.col("l_quantity").between(1, 45), "discount": F.col("l_discount") < 0.09, "flag": F.col("l_returnflag").isin("A", "N")}
    return mutations.violations(t.lineitem, rules).select("l_orderkey", "l_linenumber", "rule")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def dq_unique_violations(t: Tables) -> DataFrame:
    return mutations.duplicates(t.lineitem, ["l_orderkey", "l_linenumber"])


@query("SELECT o_custkey, lower(o_orderpriority) AS priority, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY 1, 2 HAVING count(*) > 1")
def dq_partial_unique(t: Tables) -> DataFrame:
    pending = t.orders.where(F.col("o_orderstatus") == "P").withColumn("priority", F.lower("o_orderpriority"))
    return mutations.duplicates(pending, ["o_custkey", "priority"])


@query("SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NULL OR lang IS NULL")
def dq_not_null(t: Tables) -> DataFrame:
    joined = t.documents.select("doc_id", "lang").join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    return mutations.nulls(joined, ["quality", "lang"]).select("doc_id")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 0)")
def dq_orphans(t: Tables) -> DataFrame:
    return mutations.orphans(t.orders.select("o_orderkey", "o_custkey"), "o_custkey", t.customer.where(F.col("c_custkey") % 10 != 0), "c_custkey").select("o_orderkey", "o_custkey")


@query("""
WITH n AS (SELECT n_nationkey FROM nation WHERE n_regionkey = 1), c AS (SELECT c_custkey FROM customer WHERE c_nationkey IN (FROM n)),
o AS (SELECT o_orderkey FROM orders WHERE o_custkey IN (FROM c)), l AS (SELECT l_orderkey FROM lineitem WHERE l_orderkey IN (FROM o))
SELECT 'nation' AS gone, count(*) AS n FROM n UNION ALL SELECT 'customer', count(*) FROM c UNION ALL SELECT 'orders', count(*) FROM o UNION ALL SELECT 'lineitem', count(*) FROM l""")
def cascade_delete_closure(t: Tables) -> DataFrame:
    # nations stand in for users, customers for projects, orders for snapshots and lines for workflows
    stands_for = {"users": "nation", "projects": "customer", "analysis_snapshots": "orders", "workflows": "lineitem"}
    before = {
        "users": t.nation.select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("region")),
        "projects": t.customer.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("user_id")),
        "analysis_snapshots": t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("project_id")),
        "workflows": t.lineitem.select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), F.col("l_orderkey").alias("snapshot_id")),
    }
    after, _ = mutations.cascade(before, "users", before["users"].where("region = 1"))
    fewer = lambda name: before[name].select(F.lit(1).alias("n")).unionAll(after[name].select(F.lit(-1).alias("n")))
    counted = [fewer(k).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select(F.lit(v).alias("gone"), "n") for k, v in stands_for.items()]
    return reduce(DataFrame.unionByName, counted)


@query("SELECT o_orderkey, CASE WHEN o_custkey % 10 <> 0 THEN o_custkey END AS o_custkey FROM orders")
def fk_set_null(t: Tables) -> DataFrame:
    gone = t.customer.where(F.col("c_custkey") % 10 == 0)
    return mutations.set_null(t.orders.select("o_orderkey", "o_custkey"), "o_custkey", gone, "c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)")
def fk_restrict_violations(t: Tables) -> DataFrame:
    gone = t.nation.where(F.col("n_regionkey") == 2)
    return mutations.restricted(t.customer, "c_nationkey", gone, "n_nationkey").select("c_custkey")


@query("""SELECT o_orderkey, CASE WHEN o_custkey % 7 = 0 THEN '401' WHEN o_custkey % 5 = 0 THEN '403 not a member'
  WHEN o_orderstatus NOT IN ('O', 'F') THEN '403 tier' ELSE 'allow' END AS decision FROM orders""")
def decide_access(t: Tables) -> DataFrame:
    user = F.when(F.col("o_custkey") % 7 != 0, F.col("o_custkey"))
    tier = F.when(F.col("o_custkey") % 5 != 0, F.col("o_orderstatus"))
    return t.orders.select("o_orderkey", decisions.access(user, tier, ["O", "F"]).alias("decision"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN '404' WHEN lower(c_name) <> lower(CASE WHEN c_custkey % 3 = 0 THEN upper(c_name) WHEN c_custkey % 7 = 0 THEN 'other' ELSE c_name END) THEN '403'
  WHEN CASE WHEN c_acctbal > 5000 THEN 'accepted' ELSE 'pending' END <> 'pending' THEN '409 not pending' WHEN c_mktsegment = 'BUILDING' THEN '400 no role'
  WHEN c_nationkey = 3 THEN '409 member' ELSE 'accept' END AS decision FROM customer""")
def decide_accept_invitation(t: Tables) -> DataFrame:
    key, name = F.col("c_custkey"), F.col("c_name")
    asked = F.when(key % 3 == 0, F.upper(name)).when(key % 7 == 0, "other").otherwise(name)
    status = F.when(F.col("c_acctbal") > 5000, "accepted").otherwise("pending")
    role = F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment"))
    return t.customer.select("c_custkey", decisions.accept_invitation(key % 11 != 0, name, asked, status, role, F.col("c_nationkey") == 3).alias("decision"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 OR c_mktsegment IS NULL THEN '400' WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') THEN '409' ELSE '201' END AS decision FROM customer")
def decide_invite(t: Tables) -> DataFrame:
    pending = t.orders.where(F.col("o_orderstatus") == "P").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("_p", F.lit(True))
    email = F.when(F.col("c_custkey") % 4 == 0, "").otherwise(F.col("c_name"))
    joined = t.customer.join(pending, "c_custkey", "left")
    return joined.select("c_custkey", decisions.create_invitation(email, F.col("c_mktsegment"), F.col("_p").isNotNull()).alias("decision"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN '404' WHEN o_custkey % 2 = 0 AND o_orderstatus <> 'O' THEN '403' WHEN o_orderkey % 5 = 0 THEN '400' ELSE 'ok' END AS decision FROM orders""")
def decide_member_update(t: Tables) -> DataFrame:
    actor = F.when(F.col("o_custkey") % 2 == 0, "admin").otherwise("owner")
    target = F.when(F.col("o_orderkey") % 9 != 0, F.when(F.col("o_orderstatus") == "O", "developer").otherwise("admin"))
    return t.orders.select("o_orderkey", decisions.update_member(actor, target, F.col("o_orderkey") % 5).alias("decision"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN '404' WHEN o_orderstatus = 'P' THEN '403' ELSE 'ok' END AS decision FROM orders")
def decide_member_remove(t: Tables) -> DataFrame:
    target = F.when(F.col("o_orderkey") % 9 != 0, F.when(F.col("o_orderstatus") == "P", "owner").otherwise("admin"))
    return t.orders.select("o_orderkey", decisions.remove_member(target).alias("decision"))
