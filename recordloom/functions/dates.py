"""Dates of mixed calendars and layouts, as Column expressions.  The current year is a parameter."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from recordloom.functions import text
from recordloom.functions.subsequence import bound

# Names and short names of the months, January first.
MONTHS = [
    ["มกราคม", "ม.ค.", "มค"],
    ["กุมภาพันธ์", "ก.พ.", "กพ"],
    ["มีนาคม", "มี.ค.", "มีค"],
    ["เมษายน", "เม.ย.", "เมย"],
    ["พฤษภาคม", "พ.ค.", "พค"],
    ["มิถุนายน", "มิ.ย.", "มิย"],
    ["กรกฎาคม", "ก.ค.", "กค"],
    ["สิงหาคม", "ส.ค.", "สค"],
    ["กันยายน", "ก.ย.", "กย"],
    ["ตุลาคม", "ต.ค.", "ตค"],
    ["พฤศจิกายน", "พ.ย.", "พย"],
    ["ธันวาคม", "ธ.ค.", "ธค"],
]
#: Years between the Buddhist and the Gregorian calendar, and days before 1970-01-01 counted from year 1.
BUDDHIST, EPOCH_ORDINAL = 543, 719_163
#: A written date as runs of digits, of blanks and of other signs.
RUNS = r"(?U)\d+|\s+|[^\d\s]+"


def nearest_year(y: Column, as_of_year: int) -> Column:
    """the reading of a year that is closest to the given one; the first of equally close ones."""
    short = F.array(y + 2000, y + 1900, y + (2500 - BUDDHIST), y + (2600 - BUDDHIST))
    full = F.array(y, y - BUDDHIST)
    candidates = F.when(y < 100, short).otherwise(full)
    ranked = F.transform(candidates, lambda c, i: F.struct(F.abs(c - as_of_year).alias("far"), i.alias("i"), c.alias("y")))
    return F.array_min(ranked)["y"]


def calendar_date(y: Column, m: Column, d: Column, as_of_year: int) -> Column:
    """A date, or null if the day does not exist in the nearest year."""
    year = F.lpad(nearest_year(y, as_of_year).cast("string"), 4, "0")
    return F.to_date(F.try_to_timestamp(F.concat_ws("-", year, m.cast("string"), d.cast("string")), F.lit("yyyy-M-d")))


def _kind(run: Column) -> Column:
    """n for a number, / for a separator of numbers, w for a word, a blank for blanks."""
    return F.when(run.rlike(r"(?U)^\d"), "n").when(F.trim(run) == "", " ").when(run.isin("/", "-", "."), "/").otherwise("w")


def _layout(runs: Column, as_of_year: int) -> Column:
    """struct(y, m, d) of the layout that the kinds of the runs and the lengths of the numbers spell; its fields are null for none."""
    names = F.create_map(*[x for i, words in enumerate(MONTHS) for w in words for x in (F.lit(w), F.lit(i + 1))])

    def read(p: Column) -> Column:
        number = lambda i: F.get(p["numbers"], F.lit(i))
        digits = lambda i, least, most: F.coalesce(F.length(number(i)).between(least, most), F.lit(False))
        value = lambda i: number(i).try_cast("int")
        sign = F.get(p["signs"], F.lit(0))
        month = F.coalesce(F.try_element_at(names, sign), F.try_element_at(names, F.rtrim(sign, F.lit("."))))
        year_first = (p["shape"] == "n/n/n") & (sign == "-") & (F.get(p["signs"], F.lit(1)) == "-") & digits(0, 4, 4) & digits(1, 1, 2) & digits(2, 1, 2)
        day_first = (F.replace(p["shape"], F.lit(" "), F.lit("")) == "n/n/n") & digits(0, 1, 2) & digits(1, 1, 2) & digits(2, 2, 4)
        month_word = p["shape"].isin("n w", "n wn", "n w n") & digits(0, 1, 2) & ((F.size(p["numbers"]) == 1) | digits(1, 2, 4))
        layouts = [
            (year_first, value(0), value(1), value(2)),
            (day_first, value(2), value(1), value(0)),
            (month_word, F.coalesce(value(1), F.lit(as_of_year + BUDDHIST)), month, value(0)),
        ]
        return F.coalesce(*[F.when(fits, F.struct(y.alias("y"), m.alias("m"), d.alias("d"))) for fits, y, m, d in layouts])

    numbers, signs = F.filter(runs, lambda x: _kind(x) == "n"), F.filter(runs, lambda x: _kind(x).isin("/", "w"))
    return bound(F.struct(F.array_join(F.transform(runs, _kind), "").alias("shape"), numbers.alias("numbers"), signs.alias("signs")), read)


def parse(c: Column, as_of_year: int, compose: bool = True) -> Column:
    """year, month and day; day, month and year; or day and month word with or without a year.  The text is cut into runs once, and what they are decides.

    Digits that are neither ASCII nor Thai give no date.
    """
    runs = F.regexp_extract_all(text.base(c, compose), F.lit(RUNS), F.lit(0))
    dated = lambda f: calendar_date(f["y"], f["m"], f["d"], as_of_year)
    return bound(runs, lambda r: bound(_layout(r, as_of_year), lambda f: F.when(f["y"].isNotNull() & f["m"].isNotNull() & f["d"].isNotNull(), dated(f))))


def iso(c: Column, as_of_year: int, compose: bool = True) -> Column:
    """ISO text of the date, or empty."""
    return F.coalesce(F.date_format(parse(c, as_of_year, compose), "yyyy-MM-dd"), F.lit(""))


def day_stamp(d: Column, quotes: Sequence[str]) -> Column:
    """struct(weekday from Monday = 0, quote of the day); null without a date."""
    d = d.cast("date")
    n = F.unix_date(d) + EPOCH_ORDINAL
    return F.when(d.isNotNull(), F.struct(F.weekday(d).alias("weekday"), F.get(F.array(*map(F.lit, quotes)), (n % len(quotes)).cast("int")).alias("quote")))


def quote_cycle_days(quotes: Sequence[str]) -> int:
    """days until weekday and quote repeat."""
    return math.lcm(7, len(quotes)) if quotes else 0


#: The round steps of an axis.
STEPS = [1, 1.25, 1.5, 2, 2.5, 3, 4, 5, 6, 8, 10]


def axis_ticks(top: Column, divisions: int = 4) -> Column:
    """gridlines on round numbers that cover `top`."""
    step = top / divisions
    power = F.pow(F.lit(10.0), F.floor(F.log10(step)))
    fit = F.array_min(F.filter(F.transform(F.array(*[F.lit(float(m)) for m in STEPS]), lambda m: m * power), lambda v: v >= step))
    whole = F.greatest(F.lit(1), F.bround(F.coalesce(fit, step)).cast("int"))
    ticks = F.transform(F.sequence(F.lit(0), F.lit(divisions)), lambda i: i * whole)
    return F.when(top <= 0, F.array(F.lit(0), F.lit(1))).otherwise(ticks)


def hours_before(ts: Column, hours: int) -> Column:
    """interval arithmetic."""
    return ts - F.make_interval(hours=F.lit(hours))


def lease_start(as_of: Column, minutes: int) -> Column:
    return as_of - F.make_interval(mins=F.lit(minutes))
