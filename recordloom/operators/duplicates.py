"""Duplicate records: by content hash, by composite key, transitively."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.operators.graph import connected_components


def first_wins(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """Position of each row among those of its key; 1 is kept."""
    return df.withColumn("pos", F.row_number().over(Window.partitionBy(key).orderBy(*order)))


def hash_gate(incoming: DataFrame, known: DataFrame, key: str, order: str, record: str) -> DataFrame:
    """Incoming rows with the oldest known holder of the same hash (null: process it)."""
    oldest = known.groupBy(key).agg(F.min_by(record, F.struct(order, record)).alias("holder"))
    return incoming.join(oldest, key, "left")


def key_edges(df: DataFrame, record: str, keys: dict[str, Column]) -> DataFrame:
    """(id, family, key) of every family whose key is not null: the record-key graph of G01."""
    parts = F.array(*[F.struct(F.lit(k).alias("family"), c.cast("string").alias("key")) for k, c in keys.items()])
    return df.select(F.col(record).alias("id"), F.explode(parts).alias("e")).select("id", "e.family", "e.key").filter("key IS NOT NULL")


def shared_keys(edges: DataFrame) -> DataFrame:
    """Edges of keys that more than one record has."""
    held = edges.groupBy("family", "key").agg(F.countDistinct("id").alias("n"), F.min("id").alias("first")).filter("n > 1")
    return edges.join(held, ["family", "key"])


def candidates(edges: DataFrame) -> DataFrame:
    """Ids that share any key."""
    return shared_keys(edges).select("id").distinct()


def groups(edges: DataFrame) -> DataFrame:
    """Id and component of records that are linked by shared keys.

    Every record is joined to the first record of its key, so a key of n records gives n links.
    """
    star = shared_keys(edges).filter("id <> first").select(F.col("id").alias("src"), F.col("first").alias("dst"))
    return connected_components(star)


def report(members: DataFrame, approved: Column, created: str) -> DataFrame:
    """Per component its size, surplus, number of approved, keeper and pile."""
    g = members.groupBy("component").agg(
        F.count(F.lit(1)).alias("size"),
        F.count_if(approved).alias("approved"),
        F.min_by(F.when(approved, F.col("id")), F.when(approved, F.struct(created, "id"))).alias("keeper"),
    )
    return g.withColumns(
        {
            "surplus": F.col("size") - 1,
            "pile": F.when(F.col("approved") >= 2, "approved_dups").when((F.col("approved") == 1) & (F.col("size") > 1), "clearable").otherwise("untouched"),
        }
    )


def clashes(members: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """Per component the sorted fields with more than one value, and whether it is identical."""
    g = members.groupBy("component").agg(*[F.countDistinct(F.coalesce(c.cast("string"), F.lit(""))).alias(f"_{k}") for k, c in fields.items()])
    names = F.array_sort(F.array_compact(F.array(*[F.when(F.col(f"_{k}") > 1, F.lit(k)) for k in fields])))
    return g.select("component", names.alias("clash_fields"), (F.size(names) == 0).alias("identical"))


def resolve(df: DataFrame, members: DataFrame, record: str, created: str, fields: dict[str, Column]) -> DataFrame:
    """Df without the members of identical groups but the oldest of each."""
    good = clashes(members, fields).filter("identical").select("component")
    oldest = members.groupBy("component").agg(F.min_by("id", F.struct(created, "id")).alias("keep"))
    gone = members.join(good, "component").join(oldest, "component").filter("id <> keep").select(F.col("id").alias(record))
    return df.join(gone, record, "left_anti")


def superseded_by(edges: DataFrame, keepers: DataFrame, open_records: DataFrame) -> DataFrame:
    """Open records that share a key with approved ones, and the oldest of these.  keepers: id, created; open_records: id."""
    k = edges.join(keepers, "id").groupBy("family", "key").agg(F.min(F.struct("created", "id")).alias("k"))
    e = edges.join(open_records, "id").join(k, ["family", "key"])
    return e.groupBy("id").agg(F.min("k").alias("k")).select("id", F.col("k")["id"].alias("superseded_by")).filter("id <> superseded_by")
