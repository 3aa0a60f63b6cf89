"""Pages far into a sorted list, found by rank, so that neither all rows nor all before the page are sorted.

A list of `CUTS` sampled keys is counted against the rows in one pass: how many stand before each key is that key's rank.  The
two keys next to the page bound a narrower range, which is counted again, until it has few enough rows; only those are sorted.
No pass shuffles more than one row of counts a task.

Order: (column, descending) pairs, nulls last either way, and they should tell all rows apart; rows that are equal in all of
them are interchangeable, and as many equal ones as there are stay in one range.

Defined cases: an empty list, or a page past its end, gives no rows; page numbers below 1 count as 1.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from recordloom.operators.filters import PER_PAGE

CUTS = 32
#: Sampled keys of a cut, so that ranges are about even.
PER_CUT = 20
MOST_ROWS = 100_000


@dataclass
class Span:
    """Rows from key `low` on (None: from the first) to before key `high`; their rank and number."""

    low: Row | None
    high: Row | None
    rank: int
    rows: int


def sort_columns(order: list[tuple[str, bool]]) -> list[Column]:
    return [F.col(c).desc_nulls_last() if down else F.col(c).asc_nulls_last() for c, down in order]


def before(order: list[tuple[str, bool]], key: Row) -> Column:
    """Whether a row stands before a key."""
    out = F.lit(False)
    for name, down in reversed(order):
        c, v = F.col(name), key[name]
        if v is None:
            less, same = c.isNotNull(), c.isNull()
        else:
            less, same = F.coalesce(c > F.lit(v) if down else c < F.lit(v), F.lit(False)), F.coalesce(c == F.lit(v), F.lit(False))
        out = less | (same & out)
    return out


def within(df: DataFrame, order: list[tuple[str, bool]], span: Span) -> DataFrame:
    if span.low is not None:
        df = df.filter(~before(order, span.low))
    return df if span.high is None else df.filter(before(order, span.high))


def _cuts(df: DataFrame, order: list[tuple[str, bool]], rows: int, seed: int) -> list[Row]:
    """Sampled keys in order, at even distances; their number has a bound, whatever the rows."""
    keys = df.select(*[c for c, _ in order])
    share = CUTS * PER_CUT / max(1, rows)
    some = keys if share >= 1 else keys.sample(share, seed)
    got = some.orderBy(*sort_columns(order)).limit(4 * CUTS * PER_CUT).collect()
    step = max(1, len(got) // CUTS)
    return list(dict.fromkeys(got[step // 2 :: step]))


def locate(df: DataFrame, order: list[tuple[str, bool]], offset: int, rows: int, most: int = MOST_ROWS) -> Span:
    """The span of at most `most` rows, or that no key divides further, with the ranks offset to offset + rows - 1."""
    span, seed = Span(None, None, 0, df.count()), 1
    if offset >= span.rows:
        return Span(None, None, 0, 0)
    while span.rows > most:
        inside = within(df, order, span)
        keys = _cuts(inside, order, span.rows, seed)
        ranks = [span.rank + n for n in inside.agg(*[F.count_if(before(order, k)).alias(f"n{i}") for i, k in enumerate(keys)]).first()] if keys else []
        edges = [(span.rank, span.low), *zip(ranks, keys, strict=True), (span.rank + span.rows, span.high)]
        low = max((i for i, (r, _) in enumerate(edges[:-1]) if r <= offset), default=0)
        high = next((i for i, (r, _) in enumerate(edges) if i > low and r >= offset + rows), len(edges) - 1)
        narrow = Span(edges[low][1], edges[high][1], edges[low][0], edges[high][0] - edges[low][0])
        if narrow.rows >= span.rows and seed > 3:
            break
        span, seed = (narrow if narrow.rows < span.rows else span), seed + 1
    return span


def page_at(df: DataFrame, order: list[tuple[str, bool]], number: int, per_page: int = PER_PAGE, most: int = MOST_ROWS) -> DataFrame:
    """The page of that number, in order: the same rows as a sort with offset and limit."""
    offset = max(0, number - 1) * per_page
    span = locate(df, order, offset, per_page, most)
    if not span.rows:
        return df.limit(0)
    return within(df, order, span).orderBy(*sort_columns(order)).offset(offset - span.rank).limit(per_page)
