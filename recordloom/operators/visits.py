"""Numbering of an entity's visits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def visit_key(day: Column, record_id: Column) -> Column:
    """The day, or for undated records a key of their own that sorts behind all days."""
    return F.coalesce(F.date_format(day, "yyyy-MM-dd"), F.concat(F.lit("id:"), record_id.cast("string")))


def numbered(df: DataFrame, entity: str, key: Column) -> DataFrame:
    """Round, dup (records of the round) and total (rounds) - three windows over one exchange.

    Rounds are numbered on the distinct (entity, visit) pairs, so the window sees one row a visit and not one a record.
    """
    keyed = df.withColumn("gkey", key)
    visits = keyed.groupBy(entity, "gkey").agg(F.count(F.lit(1)).alias("dup"))
    by = Window.partitionBy(entity)
    rounds = visits.withColumn("round", F.row_number().over(by.orderBy("gkey"))).withColumn("total", F.max("round").over(by.orderBy("gkey").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return keyed.join(rounds, [entity, "gkey"])


def repeated(df: DataFrame) -> DataFrame:
    """Records of entities with several rounds, or several records in a round."""
    return df.filter((F.col("total") > 1) | (F.col("dup") > 1))
