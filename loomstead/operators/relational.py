"""Filters, joins, aggregates and sorts of the project-evidence domain as pure DataFrame transformations."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstead.sources.shared import materialize

#: Which statuses each named filter shows; "stale" counts flags instead.
STATUS_FILTERS = {"active": ("analyzing", "idle"), "completed": ("complete",)}
#: Rows of a run, a power of two.
RUN = 1 << 12


def search(df: DataFrame, text: str, *columns: str) -> DataFrame:
    """Rows with text as a literal part of any column, ignoring case; an empty text filters nothing."""
    if not text:
        return df
    return df.where(reduce(or_, [F.contains(F.lower(c), F.lower(F.lit(text))) for c in columns]))


def by_named_status(df: DataFrame, name: str, status: str = "status", stale: str = "stale_count") -> DataFrame:
    """all, active, stale or completed; failed rows show under all alone."""
    if name == "all":
        return df
    return df.where(F.col(stale) > 0) if name == "stale" else df.where(F.col(status).isin(*STATUS_FILTERS[name]))


def in_allowed(column: Column, allowed: list[str]) -> Column:
    """Membership in a list; an empty list allows any."""
    return column.isin(*allowed) if allowed else F.lit(True)


def visible_to(rows: DataFrame, members: DataFrame, user, key: str, member_key: str, member_user: str) -> DataFrame:
    """rows joined with the user's memberships: the user is part of the join's condition, so it is pushed to the scan."""
    mine = members.where(F.col(member_user) == F.lit(user))
    return rows.join(mine, rows[key] == mine[member_key], "inner")


def nest(right: DataFrame, key: str, name: str) -> DataFrame:
    """right as (key, name), where name is its row; a left join then gives a null, not a struct of nulls, on a miss."""
    return right.select(F.col(key), F.struct("*").alias(name))


def latest(df: DataFrame, key: str, at: str, ident: str) -> DataFrame:
    """key and latest: the ident with the largest at (ties: the largest ident) of each key, by partial aggregation."""
    return df.groupBy(key).agg(F.max(F.struct(at, ident))[ident].alias("latest"))


def count_per_key(df: DataFrame, key: str, name: str = "n") -> DataFrame:
    return df.groupBy(key).agg(F.count("*").cast("int").alias(name))


def latest_with_count(parents: DataFrame, parent: str, children: DataFrame, child_parent: str, at: str, child: str, flags: DataFrame, flag_child: str) -> DataFrame:
    """Each parent, its latest child and the number of that child's flags, 0 for none.

    The latest child is found before flags are counted, so flags of older children are dropped by the join.
    """
    newest = latest(children, child_parent, at, child)
    counts = flags.join(newest.select(F.col("latest").alias(flag_child)), flag_child, "left_semi").groupBy(flag_child).agg(F.count("*").alias("n"))
    joined = parents.join(newest, parents[parent] == newest[child_parent], "left").join(counts, F.col("latest") == counts[flag_child], "left")
    return joined.select(parents[parent], "latest", F.coalesce("n", F.lit(0)).cast("int").alias("stale_count"))


def steps(df: DataFrame, parent: str, order: str, label: str) -> DataFrame:
    """Ordered steps with the labels before and after each.

    A parent may have any number of steps: they are cut into runs of RUN, each of which also gets the step before it
    and the one after.
    """
    run, at = F.floor(F.col("step") / RUN), F.col("step") % RUN
    runs = F.array_compact(F.array(run, F.when(at == 0, run - 1), F.when(at == RUN - 1, run + 1)))
    w = Window.partitionBy(parent, "_run").orderBy("step")
    dealt = numbered_by_range(df, [parent], F.col(order), name="step").withColumn("_run", F.explode(runs))
    return dealt.withColumns({"previous": F.lag(label).over(w), "following": F.lead(label).over(w)}).where(F.col("_run") == run).drop("_run")


def numbered_by_range(df: DataFrame, partition: list[str], *order: Column, name: str = "position", total: str | None = None, running: dict[str, str] | None = None) -> DataFrame:
    """Rows numbered from 1 in each partition, with the partition's rows as `total` and running sums {name: column}.

    Rows are dealt by ranges of (partition, order) and written once, so a partition with a third of all rows lies in
    as many tasks as its size needs. A row's number is its place in its range plus the rows of the ranges before.
    """
    keys = [*map(F.col, partition), *order]
    dealt = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    dealt = materialize(dealt).withColumn("_p", F.shiftright("_at", 33))
    sums = {**(running or {})}
    ranges = dealt.groupBy(*partition, "_p").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"), *[F.sum(c).alias(f"_s_{n}") for n, c in sums.items()])
    every = Window.partitionBy(*partition)
    before = every.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    base = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    bases = ranges.select(*[F.col(k).alias(f"_k_{k}") for k in [*partition, "_p"]], "_first", base("_n").alias("_base"), F.sum("_n").over(every).alias("_total"), *[base(f"_s_{n}").alias(f"_b_{n}") for n in sums])
    joined = dealt.join(bases, reduce(and_, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in [*partition, "_p"]]))
    inside = Window.partitionBy(*partition, "_p").orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = joined.withColumns({name: F.col("_at") - F.col("_first") + F.col("_base") + 1, **({total: F.col("_total")} if total else {}), **{n: F.sum(c).over(inside) + F.col(f"_b_{n}") for n, c in sums.items()}})
    return out.select(*df.columns, name, *([total] if total else []), *sums)


def top_share(df: DataFrame, partition: str, share: float, *order: Column) -> DataFrame:
    """The first ceil(share * rows) rows of each partition, with rank. Rounding and ties (by `order`) are ours."""
    ranked = numbered_by_range(df, [partition], *order, name="rank", total="_n")
    return ranked.where(F.col("rank") <= F.ceil(F.col("_n") * share)).drop("_n")


def within_budget(df: DataFrame, partition: str, size: str, limit: float, *order: Column) -> DataFrame:
    """Rows, in order, while the running sum of size stays within limit. The cut-off is ours."""
    return numbered_by_range(df, [partition], *order, name="_i", running={"running": size}).drop("_i").where(F.col("running") <= limit)


def without_ignored(df: DataFrame, path: str, ignored: list[str]) -> DataFrame:
    """Rows whose path begins with none of the ignored ones; a null path begins with none. Matching by prefix is ours."""
    return df.where(~F.coalesce(F.exists(F.array(*map(F.lit, ignored)), lambda p: F.startswith(F.col(path), p)), F.lit(False))) if ignored else df


def without_secrets(df: DataFrame, text: str, pattern: str) -> DataFrame:
    """Rows whose text doesn't match; a null text doesn't. The pattern is ours."""
    return df.where(~F.coalesce(F.rlike(F.col(text), F.lit(pattern)), F.lit(False)))
