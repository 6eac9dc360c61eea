"""Writes as transformations: the table now and a batch of changes give the table next; constraints are queries.

Parquet tables know no UPDATE, DELETE, MERGE or constraints. A batch is computed and checked as a whole and then
written, which stands in for a transaction. What must be one change for each key is reduced to the last by `last_of`.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstead.schemas import DOMAIN_TABLES, FOREIGN, UNIQUE
from loomstead.sources.shared import materialize


def last_of(changes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The change with the largest order for each key."""
    rest = [c for c in changes.columns if c not in keys]
    return changes.groupBy(*keys).agg(F.max(F.struct(order, *[c for c in rest if c != order])).alias("_c")).select(*keys, *[F.col(f"_c.{c}").alias(c) for c in rest])


def single(changes: DataFrame, keys: list[str], order: str | None) -> DataFrame:
    """One change for each key: the last by `order`; without an order several changes of a key are refused."""
    if order:
        return last_of(changes, keys, order)
    rest = [c for c in changes.columns if c not in keys]
    counted = changes.groupBy(*keys).agg(F.count("*").alias("_n"), F.first(F.struct(*rest)).alias("_c"))
    checked = F.when(F.col("_n") > 1, F.raise_error(F.lit("several changes of one key, and no order"))).otherwise(F.col("_c"))
    return counted.withColumn("_c", checked).select(*keys, *[F.col("_c")[c].alias(c) for c in rest])


def merged(changes: DataFrame, keys: list[str], columns: list[str], order: str) -> DataFrame:
    """One change for each key that does what all do one after another: of each column the last that is supplied."""
    last = [F.max(F.when(F.col(f"has_{c}"), F.struct(order, F.struct(F.col(c).alias("v")).alias("s")))).alias(f"_{c}") for c in columns]
    return changes.groupBy(*keys).agg(*last).select(*keys, *[x for c in columns for x in (F.col(f"_{c}.s.v").alias(c), F.col(f"_{c}").isNotNull().alias(f"has_{c}"))])


def insert(table: DataFrame, rows: DataFrame, defaults: dict[str, Column] | None = None) -> DataFrame:
    """rows appended; columns that they lack get a default, else null."""
    given = {c: (defaults or {}).get(c, F.lit(None)).cast(t) for c, t in table.dtypes if c not in rows.columns}
    return table.unionByName(rows.withColumns(given) if given else rows)


def insert_ignore(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows whose keys are new appended."""
    return table.unionByName(rows.dropDuplicates(keys).join(table.select(*keys), keys, "left_anti").select(*table.columns))


def upsert(table: DataFrame, changes: DataFrame, keys: list[str], updated: list[str], order: str | None = None) -> DataFrame:
    """New keys are inserted; of known keys the updated columns change, to null too, and others stay. See `single`."""
    new = single(changes, keys, order).select(*keys, *[F.col(c).alias(f"_{c}") for c in table.columns if c not in keys], F.lit(True).alias("_new"))
    joined = table.withColumn("_old", F.lit(True)).join(new, keys, "full")
    pick = lambda c: F.when(F.col("_new").isNotNull() & (F.col("_old").isNull() | F.lit(c in updated)), F.col(f"_{c}")).otherwise(F.col(c)).alias(c)
    return joined.select(*[F.col(c) if c in keys else pick(c) for c in table.columns])


def update_guarded(table: DataFrame, ids: DataFrame, key: str, guard: Column, new: dict[str, Column]) -> DataFrame:
    """Rows named in ids for which guard holds get new values; `changed` tells which."""
    named = table.join(ids.select(key).distinct().withColumn("_named", F.lit(True)), key, "left")
    hit = F.col("_named").isNotNull() & F.coalesce(guard, F.lit(False))
    marked = named.withColumn("changed", hit)
    return marked.select(*[F.when(F.col("changed"), new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in table.columns], "changed")


def update_partial(table: DataFrame, changes: DataFrame, keys: list[str], columns: list[str], order: str | None = None) -> DataFrame:
    """Per column, changes with has_<column> set it, to null too; others leave it. See `single`."""
    new = single(changes, keys, order).select(*keys, *[F.col(c).alias(f"_{c}") for c in columns], *[f"has_{c}" for c in columns])
    joined = table.join(new, keys, "left")
    return joined.select(*[F.when(F.col(f"has_{c}"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in table.columns])


def delete(table: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows without those keys; keys that aren't there do no harm."""
    return table.join(keys, on, "left_anti")


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """A row for each row and rule (column `rule`) that is false; null passes, as in a CHECK. One pass over df."""
    broken = F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(True)), F.lit(name)) for name, ok in rules.items()]), lambda r: r.isNotNull())
    return df.withColumn("rule", F.explode(broken))


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys, all of them there, that more than one row has, with n."""
    there = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    return df.where(there).groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def orphans(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Rows of child that name a parent which isn't there."""
    return child.where(F.col(column).isNotNull()).join(parent.select(F.col(key).alias(column)), column, "left_anti")


def nulls(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.where(reduce(or_, [F.col(c).isNull() for c in columns]))


def set_null(child: DataFrame, column: str, deleted: DataFrame, key: str) -> DataFrame:
    """child with column null where it names a deleted parent."""
    gone = deleted.select(F.col(key).alias(column)).distinct().withColumn("_gone", F.lit(True))
    return child.join(gone, column, "left").withColumn(column, F.when(F.col("_gone").isNull(), F.col(column))).select(*child.columns)


def restricted(child: DataFrame, column: str, deleted: DataFrame, key: str) -> DataFrame:
    """Rows of child that forbid the delete."""
    return child.join(deleted.select(F.col(key).alias(column)), column, "left_semi")


def primary_key(table: str) -> list[str]:
    return UNIQUE.get(table, [["id"]])[0]


def cascade(tables: dict[str, DataFrame], root: str, deleted: DataFrame) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """All tables after a delete of rows (id) of root, and by table the rows that forbid it.

    Tables are listed parents first, so one walk finds what goes; other keys then are set to null or forbid. The keys
    that go from a table are written, or each level would compute all above it again.
    """
    gone = {root: materialize(tables[root].join(deleted.select("id"), "id", "left_semi").select("id"))}
    names = [t for t in DOMAIN_TABLES if t in tables]
    keys = lambda child, action: [(c, p) for t, c, p, a in FOREIGN if t == child and a == action and p in gone]
    for child in names:
        hit = [tables[child].join(gone[p].select(F.col("id").alias(c)), c, "left_semi").select(*primary_key(child), *[x for x in ["id"] if x not in primary_key(child) and x in tables[child].columns]) for c, p in keys(child, "cascade")]
        if hit and child != root:
            gone[child] = materialize(hit[0] if len(hit) == 1 else reduce(DataFrame.unionByName, hit).distinct())
    after, forbid = {}, {}
    for name in names:
        rest = delete(tables[name], gone[name], primary_key(name)) if name in gone else tables[name]
        for column, parent in keys(name, "set null"):
            rest = set_null(rest, column, gone[parent], "id")
        for column, parent in keys(name, "restrict"):
            forbid[name] = restricted(rest, column, gone[parent], "id")
        after[name] = rest.select(*tables[name].columns)
    return after, forbid
