"""Table operators: merge trees, changes of rows, versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def replacing(rows: DataFrame, key: list[str], version: str) -> DataFrame:
    """Per key the row of greatest version, ties to the greatest row. Combines before the shuffle."""
    rest = [c for c in rows.columns if c not in key]
    best = F.max_by(F.struct(*rest), F.struct(version, *rest)).alias("row")
    return rows.groupBy(*key).agg(best).select(*key, "row.*").select(*rows.columns)


def aggregating(rows: DataFrame, key: list[str], sums: list[str], order: str) -> DataFrame:
    """Per key the sums of `sums` and of other columns the value of the row last in `order`."""
    rest = [c for c in rows.columns if c not in key and c not in sums]
    last = F.max_by(F.struct(*rest), F.struct(order, *rest)).alias("row")
    out = rows.groupBy(*key).agg(*[F.sum(s).alias(s) for s in sums], last)
    return out.select(*key, *sums, "row.*").select(*rows.columns)


def merge_sorted(rows: DataFrame, key: list[str], parts: int) -> DataFrame:
    """All rows, in `parts` ranges of the key, each sorted, as a compaction leaves them."""
    return rows.repartitionByRange(parts, *key).sortWithinPartitions(*key)


def upsert(old: DataFrame, new: DataFrame, key: list[str], update: bool = True) -> DataFrame:
    """Insert with ON CONFLICT DO UPDATE, or DO NOTHING if not `update`. New rows of one key: the greatest."""
    one = replacing(new, key, [c for c in new.columns if c not in key][0]) if len(new.columns) > len(key) else new.distinct()
    same = [old[k].eqNullSafe(one[k]) for k in key]
    if update:
        return old.join(one, same, "left_anti").unionByName(one)
    return old.unionByName(one.join(old, same, "left_anti"))


def update(rows: DataFrame, where: Column, **values: Column) -> DataFrame:
    """UPDATE … SET … WHERE: only where the condition is true."""
    hit = F.coalesce(where, F.lit(False))
    return rows.select(*[F.when(hit, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in rows.columns])


def delete(rows: DataFrame, where: Column) -> DataFrame:
    """DELETE … WHERE: rows for which the condition is null stay."""
    return rows.filter(~F.coalesce(where, F.lit(False)))


def update_returning(rows: DataFrame, where: Column, **values: Column) -> DataFrame:
    """What UPDATE … RETURNING * returns: the changed rows as they are afterwards."""
    return update(rows.filter(F.coalesce(where, F.lit(False))), F.lit(True), **values)


def delete_returning(rows: DataFrame, where: Column) -> DataFrame:
    """What DELETE … RETURNING * returns: the rows that go."""
    return rows.filter(F.coalesce(where, F.lit(False)))


def upsert_returning(old: DataFrame, new: DataFrame, key: list[str], update: bool = True) -> DataFrame:
    """What INSERT … ON CONFLICT … RETURNING * returns: rows inserted or changed; with DO NOTHING those inserted only."""
    one = replacing(new, key, [c for c in new.columns if c not in key][0]) if len(new.columns) > len(key) else new.distinct()
    return one if update else one.join(old, [old[k].eqNullSafe(one[k]) for k in key], "left_anti")


def truncate(rows: DataFrame) -> DataFrame:
    """TRUNCATE: the columns without rows; the scan is pruned."""
    return rows.filter(F.lit(False))


def diff(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """(key, change, before, after) for rows added, modified or deleted between two states."""
    rest = [c for c in old.columns if c not in key]
    a = old.select(*key, F.struct(*rest).alias("before"))
    b = new.select(*[F.col(k).alias(f"__{k}") for k in key], F.struct(*rest).alias("after"))
    both = a.join(b, [a[k].eqNullSafe(b[f"__{k}"]) for k in key], "full")
    change = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "deleted").when(~F.col("before").eqNullSafe(F.col("after")), "modified")
    keys = [F.coalesce(F.col(k), F.col(f"__{k}")).alias(k) for k in key]
    return both.select(*keys, change.alias("change"), "before", "after").filter(F.col("change").isNotNull())


def merge(target: DataFrame, source: DataFrame, key: list[str]) -> DataFrame:
    """All rows of both, the source's where both have the key."""
    keys = source.select(*[F.col(k).alias(f"__{k}") for k in key])
    same = [target[k].eqNullSafe(keys[f"__{k}"]) for k in key]
    return target.join(keys, same, "left_anti").unionByName(source)


def history(changes: DataFrame, key: list[str], ts: str) -> DataFrame:
    """Changes as versions: valid_from, and valid_to where the next change of the key closes it."""
    w = Window.partitionBy(*key).orderBy(ts)
    return changes.withColumn("valid_to", F.lead(ts).over(w)).withColumnRenamed(ts, "valid_from")


def as_of(versions: DataFrame, at: Column) -> DataFrame:
    """Versions with valid_from <= at < valid_to, an open end counting as never."""
    return versions.filter((F.col("valid_from") <= at) & (F.col("valid_to").isNull() | (F.col("valid_to") > at)))


def violations(rows: DataFrame, not_null: list[str] = (), unique: list[list[str]] = (), checks: dict[str, Column] | None = None, references: dict[str, tuple[DataFrame, str]] | None = None) -> DataFrame:
    """(rule, rows): how many rows break each constraint that is broken."""
    out = [rows.filter(F.col(c).isNull()).select(F.lit(f"not null {c}").alias("rule")) for c in not_null]
    for u in unique:
        full = rows.dropna(subset=u)
        many = full.groupBy(*u).count().filter("count > 1")
        out.append(many.select(F.lit(f"unique {', '.join(u)}").alias("rule"), F.explode(F.sequence(F.lit(2), F.col("count"))).alias("n")).select("rule"))
    for name, check in (checks or {}).items():
        out.append(rows.filter(~check).select(F.lit(f"check {name}").alias("rule")))
    for column, (parent, parent_key) in (references or {}).items():
        lost = rows.filter(F.col(column).isNotNull()).join(parent.select(F.col(parent_key).alias("__k")), F.col(column) == F.col("__k"), "left_anti")
        out.append(lost.select(F.lit(f"foreign key {column}").alias("rule")))
    every = out[0]
    for o in out[1:]:
        every = every.union(o)
    return every.groupBy("rule").agg(F.count("*").alias("rows"))
