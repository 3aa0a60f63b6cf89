"""Shared predicates, sorting and paging of record lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.functions import text

PER_PAGE = 50


def all_of(predicates: list[Column]) -> Column:
    """Their conjunction; true for none."""
    return reduce(lambda a, b: a & b, predicates, F.lit(True))


def any_of(predicates: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, predicates, F.lit(False))


def search_box(q: str, columns: dict[str, str], digits_column: str | None = None) -> Column:
    """Q occurs in a column, in the form that column's normaliser gives it, or its digits in digits_column.

    columns: column name to the normalised text to look for; empty texts are left out.
    """
    terms = [F.col(c).ilike(text.quote_like(v)) for c, v in columns.items() if v]
    digits = "".join(ch for ch in q if ch.isdigit())
    if digits_column and digits:
        terms.append(F.col(digits_column).like(text.quote_like(digits)))
    return any_of(terms)


def build(
    *, equals: dict[str, object] | None = None, person: tuple[str, str] | None = None, superseded: bool | None = None, superseded_column: str = "superseded_by", search: Column | None = None
) -> Column:
    """Filters that are given; an empty text is none, False is one."""
    out = [F.col(k) == v for k, v in (equals or {}).items() if v is not None and v != ""]
    if person and person[1].strip():
        out.append(text.same_person(F.col(person[0]), F.lit(person[1])))
    if superseded is not None:
        out.append(F.col(superseded_column).isNotNull() if superseded else F.col(superseded_column).isNull())
    if search is not None:
        out.append(search)
    return all_of(out)


def order(sortable: list[str], key: str, descending: bool, default: str, tie: str) -> list[Column]:
    """A sort by an allowed column, nulls last, with a tie-break."""
    c = F.col(key if key in sortable else default)
    return [c.desc_nulls_last() if descending else c.asc_nulls_last(), F.col(tie).asc()]


def page(df: DataFrame, by: list[Column], number: int, per_page: int = PER_PAGE) -> DataFrame:
    """One page as a top-k, without sorting all rows."""
    return df.orderBy(*by).offset(max(0, number - 1) * per_page).limit(per_page)


def page_count(df: DataFrame, per_page: int = PER_PAGE) -> DataFrame:
    """Total and pages (1 at least), in one row."""
    total = F.count(F.lit(1))
    return df.agg(total.alias("total"), F.greatest(F.lit(1), F.ceil(total / per_page)).cast("bigint").alias("pages"))


def with_total(page_df: DataFrame, df: DataFrame) -> DataFrame:
    """The total beside every row of a page: a join with one counted row, not a window over everything."""
    return page_df.join(F.broadcast(df.agg(F.count(F.lit(1)).alias("total"))))


def clamp(c: Column, low: int | Column, high: int | Column) -> Column:
    """O11"""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.greatest(lit(low), F.least(c, lit(high)))


def pile_counts(df: DataFrame, piles: dict[str, Column]) -> DataFrame:
    """One row per pile, from one pass."""
    one = df.agg(*[F.count_if(p).alias(k) for k, p in piles.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("pile"), F.col(k).alias("n")) for k in piles])).alias("x")).select("x.*")
