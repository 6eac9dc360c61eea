"""Kept tables and links to symbols over the benchmark tables: parts stand in for nodes, shipments for steps, orders for workflows, customers for sections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstead.operators import kept, links
from loomstead.plans.base import Registry, Tables
from loomstead.sources.shared import fresh_folder

query = Registry()
#: What the first snapshot lacks, what the second does, and which nodes change between them.
LATER, GONE, CHANGED = "l_shipdate >= TIMESTAMP '1998-01-01'", "l_returnflag = 'R' AND l_quantity > 45", "p_size % 10 = 7"

_STEPS = "SELECT l_orderkey AS w, l_linenumber AS o, p_partkey AS k, {0} AS h, p_size AS s FROM lineitem JOIN part ON p_partkey = l_partkey WHERE {1}"
_VALUES = "SELECT w, 1000 * sum(s) // count(*) AS v FROM {0} GROUP BY 1"


@query(f"""WITH a AS ({_STEPS.format("p_brand", f"NOT ({LATER})")}), b AS ({_STEPS.format(f"CASE WHEN {CHANGED} THEN p_type ELSE p_brand END", f"NOT ({GONE})")}),
t AS (SELECT DISTINCT w FROM ((FROM a EXCEPT ALL FROM b) UNION ALL (FROM b EXCEPT ALL FROM a))), va AS ({_VALUES.format("a")}), vb AS ({_VALUES.format("b")}),
flags AS (SELECT o_custkey FROM orders JOIN t ON w = o_orderkey WHERE o_orderstatus <> 'P' UNION
 SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' AND o_custkey IN (SELECT o_custkey FROM orders JOIN va ON w = o_orderkey WHERE o_orderstatus <> 'P')),
s AS (SELECT o_custkey AS section_id, CAST(sum(v) AS BIGINT) AS score FROM orders JOIN vb ON w = o_orderkey GROUP BY 1)
SELECT section_id, score, row_number() OVER (ORDER BY score DESC, section_id) AS rank, section_id IN (SELECT o_custkey FROM flags) AS stale FROM s""")
def kept_sections(t: Tables) -> DataFrame:
    """The second snapshot's ranked sections, after the first and the changes between them were carried through."""
    none = lambda df: df.limit(0)
    nodes = lambda h: t.part.select(F.col("p_partkey").alias("stable_key"), F.expr(h).alias("hash"), F.col("p_size").cast("long").alias("score"))
    steps = lambda rule: t.lineitem.where(F.expr(rule.replace("TIMESTAMP ", "TIMESTAMP_NTZ "))).select(F.col("l_orderkey").alias("workflow_id"), F.col("l_linenumber").cast("long").alias("step_order"), F.col("l_partkey").alias("stable_key"))
    sections = lambda rule: t.orders.where(rule).select(F.col("o_custkey").alias("section_id"), F.col("o_orderkey").alias("workflow_id"))
    first = [nodes("p_brand"), steps(f"NOT ({LATER})"), sections("o_orderstatus <> 'P'")]
    second = [nodes(f"CASE WHEN {CHANGED} THEN p_type ELSE p_brand END"), steps(f"NOT ({GONE})"), sections("true")]
    analysis = kept.Analysis(t.spark, fresh_folder(t.spark), "long", kept.parts_for(t.lineitem.count()))
    analysis.advance(0, *[kept.changes(none(df), df) for df in first])
    analysis.advance(1, *[kept.changes(a, b) for a, b in zip(first, second)])
    return analysis.ranking(1).join(analysis.flagged(1).withColumn("_f", F.lit(True)), "section_id", "left").select("section_id", "score", "rank", F.col("_f").isNotNull().alias("stale"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@query(f"""WITH i AS (SELECT item_id, {_WORDS} AS ws FROM benchmark), names AS (SELECT item_id * 2 AS symbol, array_to_string(ws[1:2], ' ') AS name, 2 AS n FROM i WHERE len(ws) >= 2
 UNION ALL SELECT item_id * 2 + 1, array_to_string(ws[1:4], ' '), 4 FROM i WHERE len(ws) >= 4),
w AS (SELECT doc_id, {_WORDS} AS ws FROM documents), p AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS start FROM w),
l AS (SELECT doc_id, start, word || ' ' || lead(word) OVER d AS two, lead(word, 2) OVER d || ' ' || lead(word, 3) OVER d AS more FROM p WINDOW d AS (PARTITION BY doc_id ORDER BY start)),
m AS (SELECT doc_id, start, name, n FROM l JOIN (SELECT DISTINCT name, n FROM names) ON name = CASE n WHEN 2 THEN two ELSE two || ' ' || more END),
r AS (SELECT *, max(start + n) OVER (PARTITION BY doc_id ORDER BY start, n DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM m)
SELECT doc_id, symbol, count(*) AS places, min(start) AS first_place FROM r JOIN names USING (name) WHERE reach IS NULL OR reach < start + r.n GROUP BY 1, 2""")
def doc_symbol_links(t: Tables) -> DataFrame:
    """The first two and the first four words of each benchmark item stand in for names of symbols."""
    split = t.benchmark.select("item_id", links.words("text").alias("_w"))
    name = lambda n: split.where(F.size("_w") >= n).select((F.col("item_id") * 2 + int(n == 4)).alias("symbol"), F.array_join(F.slice("_w", 1, n), " ").alias("name"))
    found = links.symbol_links(t.documents, "doc_id", "text", name(2).unionByName(name(4)), "symbol", "name")
    return found.withColumnRenamed("doc", "doc_id")
