"""State changes as pure transforms: (state, commands) to new state, and to a log where one is kept.

Tables are folders of Parquet files without row-level updates, so every change is a join of the state with its
commands.  `as_of` stands for the time of the change (K18).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def insert(state: DataFrame, rows: DataFrame) -> DataFrame:
    """Append; columns that the rows lack are null."""
    return state.unionByName(rows, allowMissingColumns=True)


def first_of(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key: a fold that starts where the rows are, so a key of many rows is no task of its own."""
    first = F.min_by(F.struct(*rows.columns), F.struct(*order)).alias("_first")
    return rows.groupBy(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)]).agg(first).select("_first.*")


def insert_ignore(state: DataFrame, rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Append the first row of each key that the state does not hold."""
    first = first_of(rows, keys, [order])
    return state.unionByName(first.join(state.select(*keys).distinct(), keys, "left_anti"), allowMissingColumns=True)


def replace(state: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows take the place of all state rows with their keys."""
    return state.join(rows.select(*keys).distinct(), keys, "left_anti").unionByName(rows, allowMissingColumns=True)


def first_command(commands: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first command of each key wins."""
    return first_of(commands, [key], order)


def guarded(state: DataFrame, commands: DataFrame, key: str, order: list[str], guard: Column, changes: dict[str, Column], as_of: Column | None = None) -> DataFrame:
    """Apply the first command of each key to the rows whose guard holds; adds `applied`."""
    won = first_command(commands, key, order).withColumn("_cmd", F.lit(True))
    j = state.join(won, key, "left").withColumn("applied", F.coalesce(F.col("_cmd") & guard, F.lit(False)))
    if as_of is not None:
        changes = {**changes, "updated_at": as_of}
    new = {c: F.when(F.col("applied"), v).otherwise(F.col(c) if c in state.columns else F.lit(None)) for c, v in changes.items()}
    return j.withColumns(new).select(*dict.fromkeys([*state.columns, *new]), "applied")


def audit_diff(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """A row per changed field: key, field, old_value, new_value; null counts as empty.  One join on the key; only changed fields become rows."""
    side = lambda df, name: df.select(key, F.struct(*[F.col(f).cast("string").alias(f) for f in fields]).alias(name))
    both = side(old, "_old").join(side(new, "_new"), key)
    pairs = [F.struct(F.lit(f).alias("field"), F.col("_old")[f].alias("old_value"), F.col("_new")[f].alias("new_value")) for f in fields]
    changed = F.filter(F.array(*pairs), lambda p: F.coalesce(p["old_value"], F.lit("")) != F.coalesce(p["new_value"], F.lit("")))
    return both.select(key, F.explode(changed).alias("c")).select(key, "c.*")


def delete(state: DataFrame, ids: DataFrame, key: str, children: dict[str, tuple[DataFrame, str]], pointer: str | None = None) -> dict[str, DataFrame]:
    """Rows, their children and pointers to them."""
    left = state.join(ids, key, "left_anti")
    if pointer:
        gone = ids.select(F.col(key).alias(pointer), F.lit(True).alias("_gone"))
        left = left.join(gone, pointer, "left").withColumn(pointer, F.when(F.col("_gone").isNull(), F.col(pointer))).select(*state.columns)
    out = {"state": left}
    for name, (df, ref) in children.items():
        out[name] = df.join(ids.select(F.col(key).alias(ref)), ref, "left_anti")
    return out


def upsert_settings(state: DataFrame, commands: DataFrame, order: str) -> DataFrame:
    """Last command of a key wins; a blank value deletes the key."""
    last = commands.groupBy("key").agg(F.max_by("value", order).alias("new_value"))
    j = state.join(last.withColumn("_c", F.lit(True)), "key", "full")
    value = F.when(F.col("_c"), F.nullif(F.btrim("new_value"), F.lit(""))).otherwise(F.col("value"))
    return j.select("key", value.alias("value")).filter("value IS NOT NULL")


def deactivate(state: DataFrame, people: DataFrame, key: str, active: str) -> DataFrame:
    """Soft deletion."""
    gone = people.select(key, F.lit(True).alias("_gone")).distinct()
    return state.join(gone, key, "left").withColumn(active, F.col(active) & F.col("_gone").isNull()).drop("_gone")


def send_back(reasons: Column, reason: str) -> Column:
    """Sorted distinct reasons with one more."""
    return F.array_sort(F.array_distinct(F.array_append(F.coalesce(reasons, F.array().cast("array<string>")), F.lit(reason))))


def merge_json(a: Column, b: Column) -> Column:
    """Shallow merge of two maps; the right one wins."""
    return F.map_concat(F.map_filter(a, lambda k, _: ~F.array_contains(F.map_keys(b), k)), b)
