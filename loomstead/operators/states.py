"""States of packages from a log of asked changes, folded by composing what runs of changes do to every state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstead.operators.relational import numbered_by_range
from loomstead.sources.shared import materialize

#: Changes of a run, which one row holds.
RUN = 512


def replayed(log: DataFrame, key: str, order: str, asked: str, states: list[str], rules: dict[tuple[str, str], str], initial: str, run: int = RUN) -> DataFrame:
    """log with position (from 1), was, state and allowed of each asked change of its package (key), in order.

    rules has the state that follows for (state, asked); any other change is refused and leaves the state. What a run of
    changes does is a function of the few states, so runs are folded side by side, their functions are composed in front
    of each run (by runs of runs, where a package has many), and each run is then replayed from its own first state. A
    package with all changes is dealt over as many tasks as it has runs. Ties of order are any; null keys are one package,
    null or unknown changes are refused. An empty log gives no rows.
    """
    at = {s: i for i, s in enumerate(states)}
    effects = {a: [at[rules.get((s, a), s)] for s in states] for a in sorted({a for _, a in rules})}
    identity = F.array(*map(F.lit, range(len(states))))
    effect = F.coalesce(F.element_at(F.create_map(*[x for a, f in effects.items() for x in (F.lit(a), F.array(*map(F.lit, f)))]), F.col(asked)), identity)
    columns = [c for c in log.columns if c != key]
    numbered = numbered_by_range(log, [key], F.asc(order)).withColumn("_run", F.floor((F.col("position") - 1) / run))
    change = F.struct("position", effect.alias("f"), F.struct(*columns).alias("row"), F.col(asked).alias("asked"))
    runs = materialize(numbered.groupBy(key, "_run").agg(F.array_sort(F.collect_list(F.struct("position", change.alias("c")))).alias("_changes")))
    composed = runs.select(key, "_run", _composed(F.transform("_changes", lambda x: x["c"]["f"]), identity).alias("_f"))
    first = _before(composed, key, identity, run).select(F.col(key).alias("_k"), F.col("_run").alias("_r"), F.get("_f", F.lit(at[initial])).alias("_first"))
    begun = runs.join(first, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_run") == F.col("_r")))
    start = F.struct(F.col("_first").alias("s"), F.array().cast("array<int>").alias("out"))
    step = lambda acc, x: F.struct(F.get(x["c"]["f"], acc["s"]).alias("s"), F.array_append(acc["out"], F.get(x["c"]["f"], acc["s"])).alias("out"))
    walked = begun.select(key, "_first", "_changes", F.aggregate("_changes", start, step)["out"].alias("_out"))
    rows = walked.select(key, F.posexplode("_changes").alias("_i", "_x"), "_first", "_out")
    name = lambda c: F.get(F.array(*map(F.lit, states)), c)
    was = name(F.when(F.col("_i") == 0, F.col("_first")).otherwise(F.get("_out", F.col("_i") - 1)))
    allowed = F.array_contains(F.array(*[F.lit(f"{s}\n{a}") for s, a in rules]), F.concat(was, F.lit("\n"), F.col("_x.c.asked")))
    return rows.select(key, *[F.col("_x.c.row")[c].alias(c) for c in columns], F.col("_x.position").alias("position"), was.alias("was"), name(F.get("_out", F.col("_i"))).alias("state"), F.coalesce(allowed, F.lit(False)).alias("allowed"))


def _composed(functions: Column, identity: Column) -> Column:
    """What functions (arrays: the next state of each) do one after another."""
    return F.aggregate(functions, identity, lambda acc, f: F.transform(acc, lambda s: F.get(f, s)))


def _before(runs: DataFrame, key: str, identity: Column, run: int) -> DataFrame:
    """key, _run, _f: what all runs of the key before this one do; runs has what each does."""
    runs = materialize(runs)
    group = F.floor(F.col("_run") / run)
    listed = runs.groupBy(key, group.alias("_group")).agg(F.array_sort(F.collect_list(F.struct("_run", "_f"))).alias("_l"))
    if (runs.agg(F.max("_run")).first()[0] or 0) < run:
        entered = listed.withColumn("_entry", identity)
    else:
        whole = listed.select(key, F.col("_group").alias("_run"), _composed(F.transform("_l", lambda x: x["_f"]), identity).alias("_f"))
        above = _before(whole, key, identity, run).select(F.col(key).alias("_k"), F.col("_run").alias("_g"), F.col("_f").alias("_entry"))
        entered = listed.join(above, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_group") == F.col("_g")))
    start = F.struct(F.col("_entry").alias("f"), F.array().cast("array<array<int>>").alias("out"))
    step = lambda acc, x: F.struct(F.transform(acc["f"], lambda s: F.get(x["_f"], s)).alias("f"), F.array_append(acc["out"], acc["f"]).alias("out"))
    walked = entered.select(key, "_l", F.aggregate("_l", start, step)["out"].alias("_out"))
    return walked.select(key, F.posexplode("_l").alias("_i", "_x"), "_out").select(key, F.col("_x._run").alias("_run"), F.get("_out", F.col("_i")).alias("_f"))
