"""Mixing sources to target weights by entropy balancing.

1. Sources, in code-point order, null last, weigh as `weights` says, repeating. They share all words by weight; a target
   stops at `most` times what its source holds, and what is above is shared anew. So each target is the smaller of that
   cap and weight * level, and the level follows from sums over the sources in the order of cap / weight.
2. Of all rates r of documents that give each source its target, sum(r * size) = target, those nearest to 1 by relative
   entropy are exp(tilt * size), with one tilt a source, and `most` where that is more. The tilt is the root of the
   derivative of a convex dual, found by Newton's method; where a step leaves the bracket known so far, the bracket is
   halved. All sources go together, one aggregate a step, over a table of sizes (not of documents), in whole numbers.
3. Rates become copies in the order of (source, size, hash): a document gets as many copies as the running sum of rates
   passes halves, so the copies of neighbours make up for one another. What is then still missing from a target, or is
   too much, is at most about one document: it is added as a part of a further copy, or cut off, from the longest on.

Words are runs of anything but ASCII white space. Null and empty texts have no words: they are taken as often as their
rate of 1 says, which is no word. Rows without doc_id count like others, so do repeated rows (ties in the order: equal
rows may change places). A null source is a source of its own, an empty one too. A very long document is one row of the
table of sizes. Other columns of docs, whatever their names, are not read. An empty table gives no rows.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstead.llm.common import materialize, skew_safe_left_join
from loomstead.operators.relational import numbered_by_range

WEIGHTS, MOST = (1, 2, 3), 3
#: Rates are counted in parts of one, so sums of them are exact and reruns agree.
UNIT = 1 << 24
#: The solver stops within this part of the target (or one word); what is left is made up for at the end.
TOLERANCE = 1e-6
_WORD = r"[^\x20\x09-\x0D]+"


def sized(docs: DataFrame) -> DataFrame:
    """_k (the source, never null), source, doc_id, size of docs (doc_id, text, source)."""
    key = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n"))
    return docs.select(key.alias("_k"), "source", "doc_id", F.coalesce(F.regexp_count("text", F.lit(_WORD)), F.lit(0)).cast("long").alias("size"))


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """sources (_k, source, source_size, ...) with weight and target."""
    ordered = numbered_by_range(sources, [], F.asc_nulls_last("source"), name="_rank")
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("_rank") - 1) % len(weights) + 1).cast("int")).cast("long")
    capped = ordered.withColumn("weight", weight).withColumn("_cap", F.col("source_size") * most)
    total = capped.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    if not total["weight"]:
        return capped.select(*sources.columns, "weight", F.lit(0.0).alias("target"))
    ratio = F.col("_cap") / F.col("weight")
    walked = materialize(numbered_by_range(capped, [], ratio.asc(), F.asc("_rank"), name="_i", running={"_caps": "_cap", "_weights": "weight"}))
    # the level if all before this source are capped and it isn't
    level = (F.lit(total["size"]) - F.col("_caps") + F.col("_cap")) / (F.lit(total["weight"]) - F.col("_weights") + F.col("weight"))
    found = walked.where(ratio >= level).agg(F.min_by(level, "_i")).first()[0] or 0.0
    return walked.select(*sources.columns, "weight", F.least(F.col("_cap").cast("double"), F.col("weight") * F.lit(found)).alias("target"))


def rate(tilt: Column, size: Column, scale: Column, most: int = MOST) -> Column:
    """The rate of a document in parts of UNIT."""
    return F.when(size == 0, F.lit(UNIT)).otherwise(F.round(F.least(F.lit(float(most)), F.exp(tilt * size / scale)) * UNIT)).cast("long")


def solve(sizes: DataFrame, sources: DataFrame, most: int = MOST) -> DataFrame:
    """_k, tilt, scale: Newton iterations for all sources at once.

    sizes: _k, size (> 0), m (documents); sources: _k, target, source_size, smallest, scale (mean) of those with words.
    """
    # at these ends of the bracket the source takes no more than its target, and no less
    low = F.when(F.col("target") < F.col("source_size"), F.log(F.col("target") / F.col("source_size")) * F.col("scale") / F.col("smallest")).otherwise(0.0)
    high = F.when(F.col("target") > F.col("source_size"), F.lit(log(most)) * F.col("scale") / F.col("smallest")).otherwise(0.0)
    full = F.col("target") >= F.col("source_size") * F.lit(most * (1 - 1e-12))
    state = sources.select("_k", "target", "scale", low.alias("low"), high.alias("high"), F.lit(None).cast("double").alias("taken"), F.when(full, high).otherwise(0.0).alias("tilt"))
    state = materialize(state)
    enough = F.greatest(F.lit(1.0), F.col("target") * TOLERANCE)
    done = (F.abs(F.col("taken") - F.col("target")) <= enough) | (F.col("high") - F.col("low") <= F.lit(1e-12) * F.greatest(F.abs("low"), F.abs("high")))
    while True:
        r = rate(F.col("tilt"), F.col("size"), F.col("scale"), most)
        words = (F.col("m") * F.col("size")).cast("decimal(38,0)") * r
        slope = F.when(r < most * UNIT, words * F.col("size"))
        summed = sizes.join(state.drop("taken"), "_k").groupBy("_k", "target", "scale", "low", "high", "tilt").agg((F.sum(words).cast("double") / UNIT).alias("taken"), (F.coalesce(F.sum(slope), F.lit(0)).cast("double") / UNIT / F.col("scale")).alias("_slope"))
        below = F.col("taken") < F.col("target")
        narrowed = summed.withColumns({"low": F.when(below, F.col("tilt")).otherwise(F.col("low")), "high": F.when(below, F.col("high")).otherwise(F.col("tilt"))})
        newton = F.col("tilt") + (F.col("target") - F.col("taken")) / F.col("_slope")
        inside = (F.col("_slope") > 0) & (newton > F.col("low")) & (newton < F.col("high"))
        following = F.when(done, F.col("tilt")).when(inside, newton).otherwise((F.col("low") + F.col("high")) / 2)
        state = materialize(narrowed.select("_k", "target", "scale", "low", "high", "taken", following.alias("tilt"), done.alias("_done")))
        if state.where(~F.col("_done")).isEmpty():
            return state.select("_k", "tilt", "scale")
        state = state.drop("_done")


def rated(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """_k, source, doc_id, size, source_size, target, rate (in parts of UNIT) of each row of docs."""
    rows = materialize(sized(docs))
    sizes = materialize(rows.groupBy("_k", "source", "size").agg(F.count("*").alias("m")))
    inked = F.when(F.col("size") > 0, F.col("size"))
    sources = sizes.groupBy("_k", "source").agg(
        F.sum(F.col("size") * F.col("m")).alias("source_size"), F.sum("m").alias("rows"), F.min(inked).alias("smallest"),
        (F.sum(F.col("size") * F.col("m")) / F.sum(F.when(F.col("size") > 0, F.col("m")))).alias("scale"),
    )
    aimed = materialize(targets(sources, weights, most))
    solved = solve(sizes.where("size > 0").drop("source"), aimed.where("source_size > 0"), most)
    known = aimed.select("_k", "rows", "source_size", "target").join(solved, "_k", "left")
    total = aimed.agg(F.sum("rows")).first()[0] or 0
    joined = skew_safe_left_join(rows, materialize(known), ["_k"], "rows", total)
    return joined.select("_k", "source", "doc_id", "size", "source_size", "target", rate(F.col("tilt"), F.col("size"), F.col("scale"), most).alias("rate"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """doc_id, source, size, source_size, target, rate, copies, part, taken of each row of docs (doc_id, text, source).

    The mix holds `copies` whole copies of the document and the first `part` words of one more: `taken` words.
    """
    order = [F.asc("size"), F.asc(F.xxhash64("doc_id")), F.asc("doc_id")]
    walked = numbered_by_range(rated(docs, weights, most), ["_k"], *order, running={"_sum": "rate"})
    passed = lambda c: F.shiftright(c + UNIT // 2, UNIT.bit_length() - 1)
    copied = materialize(walked.drop("position").withColumn("_copies", passed(F.col("_sum")) - passed(F.col("_sum") - F.col("rate"))).drop("_sum"))
    missing = copied.groupBy("_k", "target").agg(F.sum(F.col("_copies") * F.col("size")).alias("_taken"), F.count("*").alias("rows"))
    missing = materialize(missing.select("_k", "rows", (F.round("target").cast("long") - F.col("_taken")).alias("_missing")))
    total = missing.agg(F.sum("rows")).first()[0] or 0
    held = F.col("_copies") * F.col("size")
    room = F.when(F.col("_missing") > 0, F.col("size") * most - held).otherwise(held)
    roomy = skew_safe_left_join(copied, missing, ["_k"], "rows", total).withColumn("_room", room)
    ordered = numbered_by_range(roomy, ["_k"], F.desc("size"), *order[1:], running={"_rooms": "_room"})
    change = F.greatest(F.lit(0), F.least(F.col("_room"), F.abs("_missing") - F.col("_rooms") + F.col("_room"))) * F.signum("_missing").cast("long")
    taken = (held + change).alias("taken")
    whole = F.when(F.col("size") > 0, F.floor((held + change) / F.col("size"))).otherwise(F.col("_copies")).cast("long")
    part = F.when(F.col("size") > 0, (held + change) % F.col("size")).otherwise(F.lit(0)).cast("long")
    return ordered.select("doc_id", "source", "size", "source_size", "target", (F.col("rate") / UNIT).alias("rate"), whole.alias("copies"), part.alias("part"), taken)
