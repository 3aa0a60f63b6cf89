"""Scoreboards of extraction runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.functions import rules


def field_scores(reads: DataFrame, truth: DataFrame, key: list[str], field: str = "field") -> DataFrame:
    """Exact, near and error rate of each read of a field with a truth."""
    j = reads.join(truth, [*key, field])
    t, g = F.coalesce("truth", F.lit("")), F.coalesce("got", F.lit(""))
    return j.withColumns({"exact": (t == g).cast("int"), "near": rules.near(t, g).cast("int"), "cer": rules.cer(t, g)})


def scoreboard(scores: DataFrame, by: list[str], item: str, costs: DataFrame | None = None) -> DataFrame:
    """Two levels - items, then runs: accuracy, near accuracy, error rate and share of items that are right as a whole."""
    items = scores.groupBy(*by, item).agg(F.avg("exact").alias("acc"), F.avg("near").alias("near"), F.avg("cer").alias("cer"), F.min("exact").alias("whole"))
    out = items.groupBy(*by).agg(
        F.count(F.lit(1)).alias("items"),
        F.round(F.avg("acc"), 6).alias("acc"),
        F.round(F.avg("near"), 6).alias("near_acc"),
        F.round(F.avg("cer"), 6).alias("cer"),
        F.round(F.avg("whole"), 6).alias("whole_rate"),
    )
    if costs is not None:
        out = out.join(costs.groupBy(*by).agg(F.round(1000 * F.avg("cost"), 6).alias("cost_1000"), F.round(F.median("latency"), 6).alias("p50"), F.max("latency").alias("p95")), by)
    return out


def best(board: DataFrame, key: str, acc: str = "acc", cost: str = "cost_1000") -> DataFrame:
    """Most accurate run, and the best value by cost per accuracy; ties by key."""
    return board.agg(
        F.max_by(key, F.struct(acc, F.col(key))).alias("best"),
        F.min_by(key, F.struct(F.col(cost) / F.greatest(F.col(acc), F.lit(0.01)), F.col(key))).alias("best_value"),
    )


def leaderboard(board: DataFrame, acc: str, cost: str, tie: str) -> DataFrame:
    """O08"""
    return board.orderBy(F.desc(acc), F.asc(cost), F.asc(tie))


def with_fallback(first: DataFrame, second: DataFrame, key: list[str], fields: list[str], sums: list[str]) -> DataFrame:
    """The second read where the first one read nothing and the second did; costs of both tries add up."""
    b = second.select(*key, *[F.col(c).alias(f"_{c}") for c in [*fields, *sums]], F.lit(True).alias("_there"))
    j = first.join(b, key, "left")
    retried = ~rules.read_something(*[F.col(f) for f in fields]) & F.coalesce("_there", F.lit(False))
    use = retried & rules.read_something(*[F.col(f"_{f}") for f in fields])
    return j.select(
        *key,
        *[F.when(use, F.col(f"_{f}")).otherwise(F.col(f)).alias(f) for f in fields],
        *[(F.col(s) + F.when(retried, F.coalesce(f"_{s}", F.lit(0))).otherwise(0)).alias(s) for s in sums],
        use.alias("rescued"),
    )


#: Fixed values of I05: aspect ratio of a record, and the number of characters that scores one half.
SHAPE, HALF_CHARS = 2.1, 150


def crop_score(aspect: Column, area: Column, rectangularity: Column, ink: Column, chars: Column) -> Column:
    """Product of three fits behind five gates; 0 outside of them."""
    ok = aspect.between(1.45, 3.4) & area.between(0.02, 0.70) & (rectangularity >= 0.7) & (ink >= 0.02) & (chars >= 40)
    shape = 1 / (1 + 3 * F.abs(F.ln(aspect / SHAPE)))
    return F.when(ok, shape * rectangularity * chars / (chars + HALF_CHARS)).otherwise(F.lit(0.0))
