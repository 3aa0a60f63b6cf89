"""Review rules, validation and extraction clean-up, as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from recordloom.functions import dates, text

# Fixed values of the review rules.
REQUIRED = ["name", "tel", "noplate"]
CONFIDENCE = 0.85
PLATE_PATTERN = r"(?U)^\d?[ก-ฮ]{1,3}\d{1,4}$"
FIELDS = ["name", "tel", "date", "noplate", "province", "brand", "typecar", "location"]
NEAR_CER, AGREE_CER, CONFLICT_CER = 0.2, 0.15, 0.5
ALIASES = {
    "tel": ["phone", "tel_no", "telephone", "phone_number", "mobile"],
    "noplate": ["license_plate", "plate", "license", "no_plate", "registration", "car_plate"],
    "name": ["full_name", "owner", "owner_name"],
    "typecar": ["car_type", "type", "vehicle_type"],
    "brand": ["car_brand", "make"],
    "location": ["parking", "parking_location", "place"],
    "date": ["date_raw"],
}


def blank(c: Column) -> Column:
    return F.coalesce(text.squeeze_ends(c), F.lit("")) == ""


def low_fields(confidence: Column, threshold: float = CONFIDENCE) -> Column:
    """F16: sorted fields whose confidence is known and below the threshold."""
    return F.array_sort(F.map_keys(F.map_filter(confidence, lambda _, v: F.coalesce(v < threshold, F.lit(False)))))


def field_problems(fields: dict[str, Column], as_of_year: int, compose: bool = True) -> Column:
    """map of field to missing, length, pattern or unreadable."""
    none = F.lit(None).cast("string")
    tel = text.phone(fields.get("tel", none), compose)
    plate = text.plate(fields.get("noplate", none), compose)
    day = fields.get("date", none)
    missing = {f: blank(fields.get(f, none)) for f in REQUIRED}
    found = {
        "name": F.when(missing["name"], F.lit("missing")),
        # A value that is there but does not fit replaces the mark of a missing one.
        "tel": F.when((tel != "") & ((F.length(tel) != 10) | ~tel.startswith("0")), F.lit("length")).when(missing["tel"], F.lit("missing")),
        "noplate": F.when((plate != "") & ~plate.rlike(PLATE_PATTERN), F.lit("pattern")).when(missing["noplate"], F.lit("missing")),
        "date": F.when((F.coalesce(day, F.lit("")) != "") & dates.parse(day, as_of_year, compose).isNull(), F.lit("unreadable")),
    }
    return F.map_filter(F.create_map(*[x for k, v in found.items() for x in (F.lit(k), v)]), lambda _, v: v.isNotNull())


def evaluate(problems: Column, low: Column, duplicates: Column) -> Column:
    """sorted reasons for a review."""
    values = F.map_values(problems)
    return F.array_sort(
        F.array_compact(
            F.array(
                F.when(F.exists(values, lambda v: v == "missing"), F.lit("missing_field")),
                F.when(F.exists(values, lambda v: v != "missing"), F.lit("format_invalid")),
                F.when(F.size(low) > 0, F.lit("low_confidence")),
                F.when(duplicates > 0, F.lit("duplicate_suspect")),
            )
        )
    )


def form_errors(checks: dict[str, Column]) -> Column:
    """Sorted names of the checks that fail (null counts as failed)."""
    return F.array_sort(F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(k)) for k, ok in checks.items()])))


def full_name(c: Column) -> Column:
    s = text.squeeze(F.coalesce(c, F.lit("")))
    return (F.length(s) >= 4) & F.contains(s, F.lit(" "))


def read_something(*fields: Column) -> Column:
    """Any of the fields is not empty."""
    return reduce(lambda a, b: a | b, [F.coalesce(c, F.lit("")) != "" for c in fields])


def lock_reason(status: Column, edits: Column) -> Column:
    """Why a record must not be processed again."""
    return F.when(status != "pending", F.lit("confirmed")).when(edits > 0, F.lit("edited")).otherwise(F.lit(""))


def cer(truth: Column, got: Column) -> Column:
    """character error rate, at most 1."""
    t, g = F.coalesce(truth, F.lit("")), F.coalesce(got, F.lit(""))
    return F.when(t == "", F.when(g == "", F.lit(0.0)).otherwise(F.lit(1.0))).otherwise(F.least(F.lit(1.0), F.levenshtein(t, g) / F.length(t)))


def near(truth: Column, got: Column) -> Column:
    """equal, or a known truth read with an error rate of 0.2 at most."""
    t, g = F.coalesce(truth, F.lit("")), F.coalesce(got, F.lit(""))
    return (t == g) | ((t != "") & (cer(t, g) <= NEAR_CER))


def conflicts(stored: dict[str, Column], reads: dict[str, Column]) -> Column:
    """fields whose reads (an array each) agree with each other but not with what is stored."""

    def bad(kept: Column, values: Column) -> Column:
        first = F.get(values, F.lit(0))
        return (kept != "") & (F.coalesce(first, F.lit("")) != "") & F.forall(values, lambda v: cer(first, v) <= AGREE_CER) & (cer(kept, first) > CONFLICT_CER)

    return F.array_compact(F.array(*[F.when(bad(stored[k], reads[k]), F.lit(k)) for k in stored]))


def _named(names: list[str]):
    return lambda e: e["key"].isin(names)


def canonical_fields(m: Column) -> Column:
    """map of canonical field to the first value, in the order of the map, that is not empty."""
    entries = F.map_entries(m)
    pairs = []
    for field in FIELDS:
        own = F.filter(entries, _named([field, *ALIASES.get(field, [])]))
        full = F.filter(own, lambda e: F.coalesce(e["value"], F.lit("")) != "")
        value = F.coalesce(F.get(full, F.lit(0))["value"], F.get(F.reverse(own), F.lit(0))["value"])
        pairs.append(F.when(F.size(own) > 0, F.struct(F.lit(field).alias("key"), value.alias("value"))))
    return F.map_from_entries(F.array_compact(F.array(*pairs)))


def json_slice(c: Column) -> Column:
    """the text as variant, or its slice from the first to the last brace; null if neither parses."""
    return F.coalesce(F.try_parse_json(c), F.try_parse_json(F.nullif(F.regexp_extract(c, r"(?s)\{.*\}", 0), F.lit(""))))


def numeric_only(v: Column) -> Column:
    """the values of a JSON object (a variant) that are numbers; true and false count as 1 and 0, texts of digits do not."""
    kinds = ["BIGINT", "DOUBLE", "FLOAT", "DECIMAL", "BOOLEAN"]
    values = F.map_filter(F.from_json(F.to_json(v), "map<string,variant>"), lambda _, x: F.regexp_extract(F.schema_of_variant(x), "^[A-Z]+", 0).isin(kinds))
    return F.transform_values(values, lambda _, x: F.try_variant_get(x, "$", "double"))


def audit_document(**parts: Column) -> Column:
    """F32: JSON of the named parts."""
    return F.to_json(F.struct(*[c.alias(k) for k, c in parts.items()]))


def relabel(c: Column, labels: dict[str, str]) -> Column:
    """Label of a code, or the code."""
    return F.coalesce(F.try_element_at(F.create_map(*[x for k, v in labels.items() for x in (F.lit(k), F.lit(v))]), c), c)


#: S09, fixed values: first bytes (hex) at an offset, by format.
MAGIC = [("jpeg", 0, "FFD8FF"), ("png", 0, "89504E470D0A1A0A"), ("webp", 8, "57454250")]
MAGIC_BRANDS = {"heic": ["heic", "heix", "hevc", "heim", "heis", "hevm", "mif1", "msf1"], "avif": ["avif", "avis"]}


def sniff(content: Column) -> Column:
    """Image format by the first bytes."""
    out = None
    for fmt, at, magic in MAGIC:
        hit = F.hex(F.substring(content, at + 1, len(magic) // 2)) == magic
        if fmt == "webp":
            hit &= F.hex(F.substring(content, 1, 4)) == "52494646"
        out = F.when(hit, F.lit(fmt)) if out is None else out.when(hit, F.lit(fmt))
    major = F.decode(F.substring(content, 9, 4), "US-ASCII")
    for fmt, names in MAGIC_BRANDS.items():
        out = out.when((F.hex(F.substring(content, 5, 4)) == "66747970") & major.isin(names), F.lit(fmt))
    return out.otherwise(F.lit("unknown"))
