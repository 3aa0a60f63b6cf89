"""Normalisation, rules and fuzzy search."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordloom.functions import dates, rules, similarity, text
from recordloom.operators import filters
from recordloom.operators.ngram_index import NgramIndex
from recordloom.operators.search import search
from recordloom.plans.registry import query
from recordloom.session import scratch_path
from recordloom.sources.readers import table


_BLANKS = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


@query(f"""
    SELECT doc_id, sha256(lower(trim(regexp_replace(t, '{_BLANKS}', ' ', 'g')))) AS h, length(trim(regexp_replace(translate(nfc_normalize(t), '๐๑๒๓๔๕๖๗๘๙', '0123456789'), '{_BLANKS}', ' ', 'g'))) AS n
    FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)""")
def normalize_text(spark, d):
    doc = table(spark, d, "documents")
    return doc.select("doc_id", F.sha2(text.slot_key(F.col("text")), 256).alias("h"), F.length(text.base(F.col("text"))).cast("bigint").alias("n"))


@query("""
    SELECT c_custkey, CASE WHEN length(t) = 11 AND starts_with(t, '66') THEN '0' || substr(t, 3) ELSE t END AS tel, lower(replace(replace(trim(replace(p, 'กรุงเทพ', ''), ' -.'), ' ', ''), '-', '')) AS plate, CASE WHEN contains(p, 'กรุงเทพ') THEN 'กรุงเทพ' END AS province
    FROM (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN '66' ELSE '0' END || lpad(CAST(c_custkey AS VARCHAR), 9, '8') AS t, CASE WHEN c_custkey % 3 = 0 THEN '1กก-' || c_custkey || ' กรุงเทพ' ELSE 'ขข ' || c_custkey END AS p FROM customer)""")
def phone_plate_normalize(spark, d):
    k = F.col("c_custkey")
    tel = F.concat(F.when(k % 2 == 0, "+66").otherwise("0"), F.lit("-"), F.lpad(k.cast("string"), 9, "8"))
    plate = F.when(k % 3 == 0, F.concat(F.lit("1กก-"), k, F.lit(" กรุงเทพ"))).otherwise(F.concat(F.lit("ขข "), k))
    c = table(spark, d, "customer").select("c_custkey", tel.alias("tel"), plate.alias("p"))
    return c.select("c_custkey", text.phone(F.col("tel")).alias("tel"), text.plate(F.col("p")).alias("plate"), text.plate_parts(F.col("p"))["province"].alias("province"))


@query("""
    SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 6 = 5 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS VARCHAR) AS day FROM orders""")
def flexible_date_parse(spark, d):
    """Dates written in six layouts; those of the current century come back as they were."""
    o = table(spark, d, "orders")
    y, m, dd = (F.date_format("o_orderdate", x).cast("int") for x in ("yyyy", "M", "d"))
    months = F.array(*[F.lit(x[1]) for x in dates.MONTHS])
    k = F.col("o_orderkey") % 6
    be = (y + dates.BUDDHIST).cast("string")
    written = (
        F.when(k == 0, F.date_format("o_orderdate", "yyyy-MM-dd"))
        .when(k == 1, F.concat_ws("/", dd, m, y))
        .when(k == 2, F.concat_ws(" - ", dd, m, be))
        .when(k == 3, F.concat_ws(" ", dd, F.get(months, m - 1), be))
        .when(k == 4, F.concat_ws(".", dd, m, be))
        .otherwise(F.lit("32/13/69"))
    )
    return o.select("o_orderkey", F.nullif(dates.iso(written, 1998), F.lit("")).alias("day"))


@query("""
    SELECT doc_id, array_to_string(list_sort(list_filter([CASE WHEN nm THEN 'missing_field' END, CASE WHEN bad THEN 'format_invalid' END, CASE WHEN low THEN 'low_confidence' END, CASE WHEN dup THEN 'duplicate_suspect' END], lambda x: x IS NOT NULL)), ',') AS reasons
    FROM (SELECT doc_id, doc_id % 5 = 0 OR doc_id % 11 = 0 AS nm, doc_id % 3 = 0 AND doc_id % 11 <> 0 OR doc_id % 13 = 0 AS bad, coalesce(quality, 1) = 0 AS low, doc_id % 17 = 0 AS dup FROM documents LEFT JOIN labels USING (doc_id))""")
def review_reasons(spark, d):
    j = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    k = F.col("doc_id")
    fields = {
        "name": F.when(k % 5 == 0, "  ").otherwise("a b"),
        "tel": F.when(k % 11 == 0, F.lit(None).cast("string")).when(k % 3 == 0, "08123").otherwise("081-234-5678"),
        "noplate": F.lit("1กก 1234"),
        "date": F.when(k % 13 == 0, "32/13/69").otherwise("26/9/69"),
    }
    conf = F.create_map(F.lit("name"), F.when(F.coalesce("quality", F.lit(1)) == 0, 0.4).otherwise(0.9), F.lit("tel"), F.lit(None).cast("double"))
    reasons = rules.evaluate(rules.field_problems(fields, 2026), rules.low_fields(conf), F.when(k % 17 == 0, 1).otherwise(0))
    return j.select("doc_id", F.array_join(reasons, ",").alias("reasons"))


@query("""
    SELECT c_custkey, lower(c_mktsegment) || ' x' AS name FROM customer""")
def name_title_strip(spark, d):
    titles = F.array(*map(F.lit, ["Mr. ", "MRS.", "ms.  ", "นาย", "น.ส. ", ""]))
    raw = F.concat(F.get(titles, (F.col("c_custkey") % 6).cast("int")), F.col("c_mktsegment"), F.lit("   X "))
    return table(spark, d, "customer").select("c_custkey", text.name(raw).alias("name"))


@query("""
    SELECT p_partkey, CASE WHEN contains(p_name, 'ring') OR contains(p_name, 'loop') THEN 'ring' WHEN contains(p_name, 'bolt') THEN 'bolt' WHEN contains(p_name, 'widget') THEN 'widget' ELSE p_name END AS family,
           CASE WHEN p_size % 4 = 0 THEN 'กรุงเทพ' WHEN p_size % 4 = 1 THEN 'อยุธยา' ELSE lower(p_type) END AS province, CASE WHEN p_size % 3 = 0 THEN 'อื่นๆ' ELSE lower(p_type) END AS kind,
           CASE WHEN p_size % 2 = 0 THEN 'toyota' ELSE lower(p_brand) END AS brand
    FROM part""")
def category_canonical(spark, d):
    p, size = table(spark, d, "part"), F.col("p_size")
    family = text.first_alias(F.lower(text.base(F.col("p_name"))), {"ring": ["ring", "loop"], "bolt": ["bolt"], "widget": ["widget"]})
    province = F.when(size % 4 == 0, "BKK.").when(size % 4 == 1, "พระนครศรีอยุธยา").otherwise(F.col("p_type"))
    kind = F.when(size % 3 == 0, "อื่น ๆ").otherwise(F.col("p_type"))
    return p.select("p_partkey", family.alias("family"), text.province(province).alias("province"), text.kind(kind).alias("kind"), text.brand(F.when(size % 2 == 0, "โตโยต้า Yaris").otherwise(F.col("p_brand"))).alias("brand"))


@query("SELECT o_orderkey, 'อาคาร ' || lower(o_orderpriority) AS location, 'a ' || lower(o_orderpriority) AS slot FROM orders")
def location_normal(spark, d):
    raw, slot = F.concat(F.lit("อาคารจอด "), F.col("o_orderpriority")), F.concat(F.lit(" A   "), F.col("o_orderpriority"), F.lit("\n"))
    return table(spark, d, "orders").select("o_orderkey", text.location(raw).alias("location"), text.slot_key(slot).alias("slot"))


_CASES = [("name", " Mr.  A  B "), ("tel", "+66 81-234-5678"), ("noplate", "1กก-1234 กรุงเทพมหานคร"), ("province", "กทม."), ("brand", "IZUZU D-max"), ("typecar", "อื่น ๆ"), ("location", "อาคารจอด  2 ชั้น ๓"), ("date", "26/9/69"), ("other", " Keep  ๕ ")]


@query("""SELECT * FROM (VALUES ('name', 'a b'), ('tel', '0812345678'), ('noplate', '1กก1234'), ('province', 'กรุงเทพ'), ('brand', 'isuzu'), ('typecar', 'อื่นๆ'), ('location', 'อาคาร 2 ชั้น 3'), ('date', '2026-09-26'), ('other', 'Keep 5')) t(field, value)""")
def normalizer_dispatch(spark, d):
    df = spark.createDataFrame(_CASES, "field string, value string")
    out = None
    for field, _ in _CASES:
        v = text.normaliser(field, 2026)(F.col("value"))
        out = F.when(F.col("field") == field, v) if out is None else out.when(F.col("field") == field, v)
    return df.select("field", out.alias("value"))


@query("""
    SELECT item_id, CASE WHEN item_id % 3 = 0 THEN 'a' ELSE '' END AS fields FROM benchmark""")
def field_conflicts(spark, d):
    """field a is stored wrong in every third record; field b's reads do not agree."""
    b = table(spark, d, "benchmark").select("item_id", F.regexp_replace("text", r"[^a-zA-Z ]", "").alias("t"))
    long = F.concat("t", F.lit("q" * 40))
    stored = {"a": F.when(F.col("item_id") % 3 == 0, F.lit("0123456789")).otherwise(long), "b": F.lit("0123456789")}
    reads = {"a": F.array(long, F.concat(long, F.lit("z"))), "b": F.array(long, F.lit("9876543210"))}
    return b.select("item_id", F.array_join(rules.conflicts(stored, reads), ",").alias("fields"))


@query("SELECT * FROM (VALUES (1, 'name=Ann;tel=081'), (2, 'noplate=7'), (3, 'tel=')) t(id, fields)")
def alias_canonicalize(spark, d):
    rows = spark.createDataFrame([(1, "phone:,full_name:Ann,tel:081,colour:red"), (2, "plate:7,license:8"), (3, "phone:,tel:")], "id int, raw string")
    entries = F.transform(F.split("raw", ","), lambda x: F.struct(F.split_part(x, F.lit(":"), F.lit(1)).alias("key"), F.split_part(x, F.lit(":"), F.lit(2)).alias("value")))
    m = rules.canonical_fields(F.map_from_entries(entries))
    return rows.select("id", F.array_join(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("fields"))


@query("SELECT * FROM (VALUES (1, 'Ann', 0.5, true), (2, 'Bob', NULL, true), (3, NULL, NULL, true), (4, 'Cy', NULL, false), (5, 'Di', 1.0, true), (6, 'Ed', 7.0, true)) t(id, name, confidence, fills)")
def json_slice_parse(spark, d):
    """F30, F31, F41"""
    rows = spark.createDataFrame(
        [(1, '{"name": "Ann", "confidence": {"name": 0.5, "tel": "x"}}'), (2, 'Here: ```json\n{"name": "Bob"}\n```'), (3, "no json"), (4, 'x {"name": "Cy", "fills": false, "confidence": {"name": "1"}} y'),
         (5, '{"name": "Di", "confidence": {"name": true}}'), (6, '{"name": "Ed", "confidence": {"name": 7, "tel": null}}')], "id int, raw string"
    )
    v = rows.withColumn("v", rules.json_slice(F.col("raw")))
    conf = rules.numeric_only(F.try_variant_get("v", "$.confidence", "variant"))
    return v.select("id", F.try_variant_get("v", "$.name", "string").alias("name"), F.try_element_at(conf, F.lit("name")).alias("confidence"), F.coalesce(F.try_variant_get("v", "$.fills", "boolean"), F.lit(True)).alias("fills"))


@query("""
    SELECT o_orderkey, isodow(o_orderdate) - 1 AS weekday, (['q0', 'q1', 'q2', 'q3', 'q4'])[CAST((date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) + 719163) % 5 + 1 AS INTEGER)] AS quote, 35 AS cycle FROM orders""")
def day_stamp(spark, d):
    quotes = ["q0", "q1", "q2", "q3", "q4"]
    s = dates.day_stamp(F.col("o_orderdate"), quotes)
    return table(spark, d, "orders").withColumn("s", s).select("o_orderkey", F.col("s")["weekday"].alias("weekday"), F.col("s")["quote"].alias("quote"), F.lit(dates.quote_cycle_days(quotes)).alias("cycle"))


@query("SELECT * FROM (VALUES (1, 'jpeg'), (2, 'png'), (3, 'webp'), (4, 'heic'), (5, 'avif'), (6, 'unknown'), (7, 'unknown'), (8, 'heic'), (9, 'unknown')) t(id, format)")
def magic_sniff(spark, d):
    """S09 over bytes of each format."""
    rows = [(1, "FFD8FFE000104A464946"), (2, "89504E470D0A1A0A0000"), (3, "524946460000000057454250"), (4, "00000018667479706D696631"), (5, "00000018667479706176696600"), (6, "00"), (7, ""), (8, "00000018667479706D736631"), (9, "000000186674797069736F6D")]
    return spark.createDataFrame(rows, "id int, h string").select("id", rules.sniff(F.unhex("h")).alias("format"))


# --- similarity and search -------------------------------------------------------------------------

_NAMES = "SELECT DISTINCT p_name AS v FROM part"


def _names(spark, d):
    return table(spark, d, "part").select(F.col("p_name").alias("value")).distinct().withColumn("id", F.col("value"))


@query(f"""
    WITH w AS (SELECT v, unnest(string_split(lower(v), ' ')) AS x FROM ({_NAMES})), p AS (SELECT v, '  ' || x || ' ' AS y FROM w),
    g AS (SELECT DISTINCT v, substr(y, i, 3) AS g FROM (SELECT v, y, unnest(generate_series(1, length(y) - 2)) AS i FROM p)), n AS (SELECT v, count(*) AS n FROM g GROUP BY 1)
    SELECT l, r, round(m / (nl.n + nr.n - m), 6) AS similarity FROM (SELECT a.v AS l, b.v AS r, CAST(count(*) AS DOUBLE) AS m FROM g a JOIN g b ON a.g = b.g AND a.v < b.v GROUP BY 1, 2) JOIN n nl ON nl.v = l JOIN n nr ON nr.v = r WHERE m / (nl.n + nr.n - m) >= 0.3""")
def trigram_pairs(spark, d):
    n = _names(spark, d)
    return similarity.trigram_pairs(n, n).filter("l < r").select("l", "r", F.round("similarity", 6).alias("similarity"))


@query(f"""SELECT a.v AS l, b.v AS r, levenshtein(a.v, b.v) AS distance FROM ({_NAMES}) a JOIN ({_NAMES}) b ON a.v < b.v AND levenshtein(a.v, b.v) <= 2""")
def levenshtein_neighbors(spark, d):
    n = _names(spark, d)
    return similarity.edit_pairs(n, n).filter("l < r").withColumn("distance", F.col("distance").cast("bigint"))


@query(f"""
    WITH p AS (SELECT v, 'blue wodget' AS q FROM ({_NAMES})),
    s AS (SELECT v, CASE WHEN length(v) = 0 THEN 0 ELSE list_reduce(list_prepend(list_transform(generate_series(0, length(v)), lambda x: CAST(0 AS BIGINT)), list_transform(generate_series(1, length(q)), lambda i: [CAST(i AS BIGINT)])),
        lambda prev, ch: list_reduce(list_prepend([CAST(0 AS BIGINT)], list_transform(generate_series(1, length(v)), lambda j: [CAST(j AS BIGINT)])),
            lambda done, j: list_append(done, CASE WHEN substr(v, j[1], 1) = substr(q, ch[1], 1) THEN prev[j[1]] + 1 ELSE greatest(prev[j[1] + 1], done[len(done)]) END)))[length(v) + 1] END AS lcs, length(v) + length(q) AS n FROM p)
    SELECT v AS name, round(200.0 * lcs / n, 4) AS ratio FROM s ORDER BY ratio DESC, name LIMIT 10""")
def ratio_ranked_names(spark, d):
    r = similarity.ratio(F.lit("blue wodget"), F.col("value"))
    return _names(spark, d).select(F.col("value").alias("name"), F.round(r, 4).alias("ratio")).orderBy(F.desc("ratio"), "name").limit(10)


def _people(customers):
    """Customers as records, with normalised columns."""
    return customers.select(
        F.col("c_custkey").alias("id"),
        text.name(F.concat_ws(" ", "c_mktsegment", "c_name"), False).alias("name_norm"),
        F.concat(F.lit("08"), F.lpad(F.col("c_custkey").cast("string"), 8, "0")).alias("tel_digits"),
        F.concat(F.lit("1กก"), F.col("c_custkey") % 10000).alias("plate_norm"),
        F.lower("c_mktsegment").alias("brand_norm"),
        (F.col("c_nationkey") % 2 == 0).alias("stored"),
        F.when(F.col("c_custkey") % 11 == 4, "pending").otherwise("approved").alias("review_status"),
        F.col("c_custkey").alias("created"),
    )


@query()
def fuzzy_search_ranked(spark, d):
    """Customers as records; every one is held against the texts, and ranked in the JVM."""
    return search(_people(table(spark, d, "customer")), ["machinery customer#000000042", "0800000042", "+66 800-000024", "0043", "1กก77", "furnitur"], top=20)


def _people_index(spark, d, files=32):
    """The records in files by range of their id, and their index; as an ingest would leave them."""
    folder = scratch_path(spark, "people")
    # Dealt out before they are normalised, as a table of one file is one task's.
    _people(table(spark, d, "customer").repartitionByRange(files, "c_custkey")).write.parquet(f"{folder}/rows")
    index = NgramIndex(spark, f"{folder}/rows", f"{folder}/index", ["name_norm", "plate_norm", "brand_norm"], ["name_norm", "plate_norm", "tel_digits"])
    index.update()
    return index


@query()
def fuzzy_search_indexed(spark, d):
    """The same search through the persisted index; texts whose grams are rare leave most files unread."""
    return _people_index(spark, d).search(["customer#000000042", "0800000042", "+66 800-000024"], top=20)


@query("""
    WITH p AS (SELECT c_custkey AS id, lower(c_mktsegment || ' ' || c_name) AS name_norm, '08' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS tel_digits FROM customer)
    SELECT id, name_norm, tel_digits FROM p WHERE name_norm ILIKE '%r#0000001_2%' OR tel_digits LIKE '%000123%'""")
def search_box_indexed(spark, d):
    """The search box through the index: a pattern with a live wildcard, and digits."""
    index = _people_index(spark, d)
    fits = {"name_norm": "r#0000001_2", "tel_digits": "000123"}
    rows = index.rows(index.box(fits))
    return rows.filter(filters.search_box("000123", {"name_norm": fits["name_norm"]}, "tel_digits")).select("id", "name_norm", "tel_digits")
