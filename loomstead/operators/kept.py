"""An analysis kept in tables: a snapshot's changes are carried to steps, workflows, sections, ranks and flags.

Changes are signed rows: `weight` says how many of a row come (above 0) or go (below 0). A kept table is the sum of what
its batches brought. Joins of a batch meet only what its changes touch, sums are added to, and what isn't a sum (a
mean, a rank) is taken back and given anew for touched keys alone. Tables lie in parts by the key that they are looked
up by, so a batch reads the parts of its keys and writes its changes.

- A batch writes its own folder of each table. One that was cut short is run again and replaces what it wrote; states
  up to an earlier batch don't see it. Batches are numbered from 0 and follow one another.
- Repeated rows count as often as they occur, as in a join of whole tables. A null key meets nothing; a workflow
  without a known step has no value, a section without such a workflow no score. Scores are whole numbers; a workflow's
  value is a thousand times its steps' mean, rounded down, a section's score the sum over its workflows (measures are ours).
- A section is flagged if it was there before and one of its workflows' steps is new, gone or on a changed node, or if
  it gains or loses a workflow. Others aren't.
- The driver gets the numbers of touched parts, never keys. Ranks are kept as places in bands of scores and the bands'
  sizes, so a section that moves shifts no other row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomstead.operators.relational import numbered_by_range
from loomstead.sources.shared import materialize, scratch

#: Columns of each kept table (id: the ids' type), those that are summed, and the key that it is looked up by.
TABLES = {
    "nodes": ("stable_key id, hash string, score long", (), "stable_key"),
    "steps": ("workflow_id id, step_order long, stable_key id", (), "stable_key"),
    "sections": ("section_id id, workflow_id id", (), "workflow_id"),
    "totals": ("workflow_id id, score long", ("score",), "workflow_id"),
    "scores": ("section_id id, score long", ("score",), "section_id"),
    "ranks": ("section_id id, score long, band int", (), "band"),
    "bands": ("band int", (), "band"),
    "flags": ("section_id id", (), "section_id"),
}


def net(*signed: DataFrame) -> DataFrame:
    """The sum of signed rows: equal rows as one, without those that cancel out."""
    rows = reduce(DataFrame.unionByName, signed)
    return rows.groupBy(*[c for c in rows.columns if c != "weight"]).agg(F.sum("weight").alias("weight")).where("weight <> 0")


def signed(rows: DataFrame, weight: int = 1) -> DataFrame:
    return rows.withColumn("weight", F.lit(weight).cast("long"))


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Signed rows that lead from one snapshot to another."""
    return net(signed(old, -1), signed(new))


def times(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join of signed rows: weights multiply."""
    met = left.withColumnRenamed("weight", "_l").join(right.withColumnRenamed("weight", "_r"), key)
    return met.withColumn("weight", F.col("_l") * F.col("_r")).drop("_l", "_r")


def parts_for(rows: int) -> int:
    """Parts for a table of that many rows: some 2^20 rows in each, but 8 to 4096 parts, as each is a folder a batch."""
    return max(8, min(4096, rows >> 20))


class Analysis:
    """The kept tables in a folder that driver and executors share.

    ident is the type of all ids, parts the number of parts of a table, width the scores that a band of ranks spans;
    scores beyond the last band lie in it.
    """

    def __init__(self, spark: SparkSession, folder: str, ident: str = "string", parts: int = 256, width: int = 10_000):
        self.spark, self.folder, self.ident, self.parts, self.width = spark, folder.rstrip("/"), ident, parts, width
        #: While a batch is carried through: the parts that keys of its tables lie in, with those tables.
        self._touched: list[tuple[DataFrame, str, list[int]]] | None = None

    def advance(self, batch: int, nodes: DataFrame, steps: DataFrame, sections: DataFrame) -> None:
        """Carry a batch of changes (columns of TABLES and weight; see `changes`) through all tables."""
        self._touched = []
        try:
            with scratch(self.spark):
                self._advance(batch, *[self._keep(n, batch, net(self._plain(n, d))) for n, d in (("nodes", nodes), ("steps", steps), ("sections", sections))])
        finally:
            self._touched = None

    def _advance(self, batch: int, nodes: DataFrame, steps: DataFrame, sections: DataFrame) -> None:
        before = batch - 1
        # steps that come, go or lie on a changed node, in whole
        known, used = self.state("nodes", before, steps), self.state("steps", batch, nodes)
        moved = materialize(net(times(steps, known, "stable_key"), times(used, nodes, "stable_key").select("stable_key", "workflow_id", "step_order", "weight", "hash", "score")))
        totals = self._keep("totals", batch, _summed(moved, "workflow_id", "score"))

        # values of touched workflows are taken back and given anew
        shifted = materialize(net(signed(self._values(before, totals), -1), signed(self._values(batch, totals))))
        linked = self.state("sections", batch, shifted)
        scored = net(times(sections, signed(self._values(before, sections)), "workflow_id"), times(linked, shifted, "workflow_id").select("workflow_id", "section_id", "value", "weight"))
        scores = self._keep("scores", batch, _summed(scored, "section_id", "value"))

        places = lambda until: signed(self.state("scores", until, scores).select("section_id", "score", self._band().alias("band")))
        ranks = self._keep("ranks", batch, net(places(before).withColumn("weight", F.lit(-1).cast("long")), places(batch)))
        self._keep("bands", batch, net(ranks.select("band", "weight")))

        by_step = self.state("sections", before, totals).select("section_id")
        by_link = self.state("scores", before, sections).select("section_id")
        self._keep("flags", batch, signed(by_step.unionByName(by_link).distinct()))

    def state(self, name: str, until: int, near: DataFrame | None = None) -> DataFrame:
        """A table's rows after batch `until`, with weight; given `near`, those whose key it has, from the parts of those keys."""
        sums, key = TABLES[name][1:]
        if until < 0:
            return self._nothing(name)
        rows = self._rows(name).where(F.col("batch") <= until)
        if near is not None:
            rows = rows.where(F.col("part").isin(self._parts_of(near, key))).join(near.select(key).distinct(), key, "left_semi")
        plain = [c for c in rows.columns if c not in ("weight", "batch", "part", *sums)]
        return rows.groupBy(*plain).agg(*[F.sum(c).alias(c) for c in (*sums, "weight")]).where("weight <> 0")

    def flagged(self, batch: int) -> DataFrame:
        """section_id of what the batch has made stale."""
        return self._rows("flags").where(F.col("batch") == batch).select("section_id")

    def ranking(self, until: int, near: DataFrame | None = None) -> DataFrame:
        """section_id, score, rank (by falling score, then id); given `near` (band), of the sections in those bands alone."""
        sizes = self.state("bands", until)
        above = Window.orderBy(F.desc("band")).rowsBetween(Window.unboundedPreceding, -1)  # a row for each band, at most `parts`
        bases = sizes.select("band", F.coalesce(F.sum("weight").over(above), F.lit(0)).alias("_above"))
        placed = numbered_by_range(self.state("ranks", until, near).drop("weight"), ["band"], F.desc("score"), F.asc("section_id"), name="_place")
        return placed.join(F.broadcast(bases), "band").select("section_id", "score", (F.col("_place") + F.col("_above")).alias("rank"))

    def compacted(self, until: int, folder: str) -> Analysis:
        """The same states in another folder, as one batch `until`; later batches follow there, flags of earlier ones stay behind."""
        other = Analysis(self.spark, folder, self.ident, self.parts, self.width)
        for name in TABLES:
            other._keep(name, until, self.state(name, until) if name != "flags" else signed(self.flagged(until)))
        return other

    def _values(self, until: int, near: DataFrame) -> DataFrame:
        return self.state("totals", until, near).select("workflow_id", F.expr("1000 * score div weight").alias("value"))

    def _band(self) -> Column:
        return F.greatest(F.lit(0), F.least(F.lit(self.parts - 1), F.floor(F.col("score") / self.width))).cast("int")

    def _part(self, key: str) -> Column:
        return (F.col(key) if key == "band" else F.pmod(F.xxhash64(key), F.lit(self.parts))).cast("int").alias("part")

    def _schema(self, name: str) -> str:
        return TABLES[name][0].replace(" id", f" {self.ident}") + ", weight long"

    def _nothing(self, name: str) -> DataFrame:
        """No rows, known to the optimizer, which drops joins and unions with them."""
        fields = [f.rsplit(" ", 1) for f in self._schema(name).split(", ")]
        return self.spark.range(0).select(*[F.lit(None).cast(kind).alias(c) for c, kind in fields]).where(F.lit(False))

    def _parts_of(self, near: DataFrame, key: str) -> list[int]:
        """The parts that near's keys lie in; in a batch they are asked once for each of its tables, which don't change."""
        for table, by, parts in self._touched or []:
            if table is near and by == key:
                return parts
        parts = [r[0] for r in near.select(self._part(key)).distinct().collect()]
        if self._touched is not None:
            self._touched.append((near, key, parts))
        return parts

    def _plain(self, name: str, rows: DataFrame) -> DataFrame:
        return rows.to(self._nothing(name).schema)

    def _rows(self, name: str) -> DataFrame:
        return self.spark.read.schema(f"{self._schema(name)}, batch long, part int").parquet(f"{self.folder}/{name}")

    def _keep(self, name: str, batch: int, rows: DataFrame) -> DataFrame:
        """Write a batch's changes of a table; parts with many rows go to several files."""
        rows = self._plain(name, rows)
        rows.withColumn("part", self._part(TABLES[name][2])).hint("rebalance", "part").write.mode("overwrite").partitionBy("part").parquet(f"{self.folder}/{name}/batch={batch}")
        return self._rows(name).where(F.col("batch") == batch).select(*rows.columns)


def _summed(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Changes of a sum and of the number of its rows; a key stays although both are 0, as it was touched."""
    return rows.groupBy(key).agg(F.sum(F.col("weight") * F.col(value)).alias("score"), F.sum("weight").alias("weight"))
