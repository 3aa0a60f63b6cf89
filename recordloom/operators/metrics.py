"""Counters, breakdowns and daily series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN = "— ไม่ระบุ —"


def kpi(df: DataFrame, counts: dict[str, Column], sums: dict[str, Column], positive_means: dict[str, Column]) -> DataFrame:
    """Total, conditional counts, sums and means of positive values, in one row."""
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(c).alias(k) for k, c in counts.items()],
        *[F.round(F.coalesce(F.sum(c), F.lit(0.0)), 2).alias(k) for k, c in sums.items()],
        *[F.round(F.coalesce(F.avg(F.when(c > 0, c)), F.lit(0.0)), 4).alias(k) for k, c in positive_means.items()],
    )


def top_labels(df: DataFrame, label: Column, n: int = 8, unknown: str = UNKNOWN) -> DataFrame:
    """Most frequent labels, blank ones as unknown; ties by label."""
    known = F.coalesce(F.nullif(label, F.lit("")), F.lit(unknown))
    return df.groupBy(known.alias("label")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "label").limit(n)


def days(spark, last: str, n: int) -> DataFrame:
    """The n days that end at `last`."""
    return spark.range(1).select(F.explode(F.sequence(F.date_sub(F.lit(last).cast("date"), n - 1), F.lit(last).cast("date"))).alias("day"))


def daily(df: DataFrame, day: Column, last: str, n: int, marked: Column) -> DataFrame:
    """Count and conditional count of each of n days, zeros included.  Filter df before."""
    counts = df.groupBy(day.cast("date").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.count_if(marked).alias("marked"))
    full = days(df.sparkSession, last, n).join(counts, "day", "left")
    return full.select("day", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("marked", F.lit(0)).alias("marked"))


def date_health(df: DataFrame, day: Column, as_of: str) -> DataFrame:
    """Rows by age of the date: none, out of range, older than the chart, in the chart."""
    at = F.lit(as_of).cast("date")
    d = day.cast("date")
    far = (d < F.date_sub(at, 365)) | (d > F.date_add(at, 1))
    old = d.between(F.date_sub(at, 365), F.date_sub(at, 30))
    return df.agg(
        F.count_if(d.isNull()).alias("no_date"),
        F.count_if(far).alias("odd"),
        F.count_if(old & ~far).alias("older"),
        F.count_if(d.between(F.date_sub(at, 29), F.date_add(at, 1))).alias("in_window"),
    )


def coverage(health: DataFrame) -> DataFrame:
    """Rows outside of the chart and the share inside, in percent."""
    outside = F.col("no_date") + F.col("odd") + F.col("older")
    total = F.nullif(outside + F.col("in_window"), F.lit(0))
    return health.select("*", outside.alias("outside"), F.round(100.0 * F.col("in_window") / total, 2).alias("coverage_pct"))


def by_person(df: DataFrame, person: Column, counts: dict[str, Column], limit: int) -> DataFrame:
    """Groups of one name in any case and padding, under its most frequent spelling (the least of ties)."""
    trimmed = F.btrim(person)
    g = df.groupBy(F.lower(trimmed).alias("_key")).agg(F.mode(trimmed, True).alias("label"), F.count(F.lit(1)).alias("n"), *[F.count_if(c).alias(k) for k, c in counts.items()])
    return g.drop("_key").orderBy(F.desc("n"), "label").limit(limit)


def unnested(df: DataFrame, values: Column) -> DataFrame:
    """A10: how often each value of an array occurs."""
    return df.select(F.explode(values).alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def two_sided(dim: DataFrame, key: Column, sides: dict[str, tuple[DataFrame, Column]]) -> DataFrame:
    """A dimension with the counts of several facts, each aggregated before its join."""
    out = dim.withColumn("_k", key)
    for name, (fact, fact_key) in sides.items():
        out = out.join(fact.groupBy(fact_key.alias("_k")).agg(F.count(F.lit(1)).alias(name)), "_k", "left")
    return out.withColumns({n: F.coalesce(n, F.lit(0)) for n in sides}).drop("_k")


def shares(df: DataFrame, n: str) -> DataFrame:
    """Percent of the total and width against the largest, of a small grouped result."""
    t = df.agg(F.sum(n).alias("_t"), F.max(n).alias("_m"))
    return (
        df.join(F.broadcast(t))
        .select(*df.columns, F.round(100.0 * F.col(n) / F.nullif("_t", F.lit(0)), 2).alias("pct"), F.round(100.0 * F.col(n) / F.nullif("_m", F.lit(0)), 2).alias("width"))
    )
