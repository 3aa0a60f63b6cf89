"""Normalisers of human-entered text, as Column expressions.

All take a Column and give a Column that is never null (null counts as empty).  Only canonical composition (NFC) has
no built-in: values with characters beyond ASCII pass an Arrow UDF for it, all others stay in the JVM.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# They must equal those of the record system for right results.
THAI_DIGITS = "๐๑๒๓๔๕๖๗๘๙"
TITLES = ["นางสาว", "น.ส.", "นส.", "นาย", "นาง", "คุณ", "ด.ช.", "ด.ญ.", "mr.", "mrs.", "ms."]
PLATE_PROVINCES = ["กรุงเทพมหานคร", "กรุงเทพฯ", "กรุงเทพ", "กทม.", "กทม", "อยุธยา", "พระนครศรีอยุธยา", "นนทบุรี", "ปทุมธานี", "สมุทรปราการ", "ชลบุรี", "เบตง"]
PROVINCE_SPELLINGS = {
    "กรุงเทพ": ["กทม", "กรุงเทพ", "กรุงเทพฯ", "กรุงเทพมหานคร", "bangkok", "bkk"],
    "อยุธยา": ["อยุธยา", "พระนครศรีอยุธยา"],
}
BRANDS = {
    "toyota": ["toyota", "โตโยต้า", "โตโยตา", "toyata"],
    "isuzu": ["isuzu", "izuzu", "อีซูซุ", "อีซุซุ", "isuzo"],
    "honda": ["honda", "ฮอนด้า", "ฮอนดา"],
    "ford": ["ford", "ฟอร์ด"],
    "mazda": ["mazda", "มาสด้า"],
    "nissan": ["nissan", "นิสสัน"],
    "mitsubishi": ["mitsubishi", "มิตซูบิชิ", "มิตซู"],
}
OTHER_TYPE = ["อื่น", "อื่น ๆ"], "อื่นๆ"
BUILDING = "อาคารจอด", "อาคาร"
INVISIBLE = r"[\u200B-\u200F\u2028\u2029\uFEFF\u00AD]"
NEW_PERSON = "__new__"

#: White space as Python's re sees it; Java's Unicode class lacks the four separators.
SPACE = r"(?U)[\s\x1c-\x1f]+"


@F.pandas_udf(T.StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def nfc(c: Column) -> Column:
    """Canonical composition; ASCII values do not travel to Python."""
    return F.coalesce(_nfc(F.when(c.rlike(r"[^\x00-\x7F]"), c)), c)


def quote(literal: str) -> str:
    """A literal for a Java pattern."""
    return "\\Q" + literal + "\\E"


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, SPACE, " "))


def base(c: Column, compose: bool = True) -> Column:
    """composed, Thai digits as ASCII, white space squeezed."""
    c = F.coalesce(c.cast("string"), F.lit(""))
    return squeeze(F.translate(nfc(c) if compose else c, THAI_DIGITS, "0123456789"))


def name(c: Column, compose: bool = True) -> Column:
    """lower-cased without the first title that fits."""
    titles = "|".join(quote(t) for t in TITLES)
    return squeeze(F.regexp_replace(F.lower(base(c, compose)), f"^(?:{titles})", ""))


def phone(c: Column, compose: bool = True) -> Column:
    """digits; +66 and nine digits become 0 and nine digits."""
    d = F.regexp_replace(base(c, compose), r"(?U)\D", "")
    return F.when(d.startswith("66") & (F.length(d) == 11), F.concat(F.lit("0"), F.substring(d, 3, 9))).otherwise(d)


def plate_parts(c: Column, compose: bool = True) -> Column:
    """struct(plate, province): the longest province that occurs is cut out."""
    s = base(c, compose)
    ordered = sorted(PLATE_PROVINCES, key=len, reverse=True)
    province = F.coalesce(*[F.when(F.contains(s, F.lit(p)), F.lit(p)) for p in ordered])
    cut = F.btrim(F.replace(s, province, F.lit("")), F.lit(" -."))
    return F.struct(F.when(province.isNull(), s).otherwise(cut).alias("plate"), province.alias("province"))


def plate(c: Column, compose: bool = True) -> Column:
    """letters and digits of a plate, lower-cased."""
    return F.lower(F.regexp_replace(plate_parts(c, compose)["plate"], r"(?U)[\s\-.]", ""))


def province(c: Column, compose: bool = True) -> Column:
    """one spelling of each province."""
    s = F.rtrim(F.lower(base(c, compose)), F.lit("."))
    out = s
    for canonical, spellings in PROVINCE_SPELLINGS.items():
        out = F.when(s.isin(spellings), F.lit(canonical)).otherwise(out)
    return out


def first_alias(s: Column, table: dict[str, list[str]]) -> Column:
    """The first key, in order, of which an alias occurs in s; s itself otherwise."""
    found = [F.when(s.rlike("|".join(quote(a) for a in aliases)), F.lit(k)) for k, aliases in table.items()]
    return F.coalesce(*found, s)


def brand(c: Column, compose: bool = True, table: dict[str, list[str]] | None = None) -> Column:
    """canonical brand."""
    return first_alias(F.lower(base(c, compose)), table or BRANDS)


def kind(c: Column, compose: bool = True) -> Column:
    """type, with one spelling of 'other'."""
    s = F.lower(base(c, compose))
    return F.when(s.isin(OTHER_TYPE[0]), F.lit(OTHER_TYPE[1])).otherwise(s)


def location(c: Column, compose: bool = True) -> Column:
    """lower-cased slot, with one word for building."""
    return F.replace(F.lower(base(c, compose)), F.lit(BUILDING[0]), F.lit(BUILDING[1]))


def slot_key(c: Column) -> Column:
    """what two spellings of a slot are compared by."""
    return F.lower(F.btrim(F.regexp_replace(F.coalesce(c, F.lit("")), SPACE, " ")))


def person(c: Column) -> Column:
    """name of a person without invisible characters; the placeholder for a new one is empty."""
    s = squeeze_ends(F.regexp_replace(F.coalesce(c, F.lit("")), INVISIBLE, ""))
    return F.when(s == NEW_PERSON, F.lit("")).otherwise(s)


def squeeze_ends(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def same_person(a: Column, b: Column) -> Column:
    """Equal but for case and outer blanks."""
    return F.lower(F.btrim(a)) == F.lower(F.btrim(b))


def normaliser(field: str, as_of_year: int = 2026, compose: bool = True) -> Callable[[Column], Column]:
    """the normaliser of a field; F01 for those without one of their own."""
    from recordloom.functions import dates

    table = {
        "name": name,
        "tel": phone,
        "noplate": plate,
        "province": province,
        "brand": brand,
        "typecar": kind,
        "location": location,
        "date": lambda c, compose: dates.iso(c, as_of_year, compose),
    }
    f = table.get(field, base)
    return lambda c: f(c, compose)


def quote_like(q: str) -> str:
    """A LIKE pattern around user text; wildcards in it stay live, as in the record system."""
    return f"%{q}%"


def slug(s: str) -> str:
    """file-name form of a model name."""
    return s.replace("/", "__").replace(":", "_")
