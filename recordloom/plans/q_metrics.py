"""Dashboard queries: orders stand for records (status P pending, F approved, O rejected), events for edits."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordloom.functions import dates
from recordloom.operators import metrics, scoring
from recordloom.plans.registry import query
from recordloom.sources.readers import table

UNKNOWN = metrics.UNKNOWN


@query("""
    SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'P') AS pending, count(*) FILTER (o_orderstatus = 'F') AS approved,
           count(*) FILTER (o_orderstatus = 'O') AS rejected, count(*) FILTER (o_orderpriority = '1-URGENT') AS urgent,
           round(coalesce(sum(o_totalprice), 0), 2) AS value_sum, round(coalesce(avg(CASE WHEN o_totalprice > 1000 THEN o_totalprice - 1000 END), 0), 4) AS value_mean
    FROM orders""")
def kpi_orders(spark, d):
    s = F.col("o_orderstatus")
    return metrics.kpi(
        table(spark, d, "orders"),
        {"pending": s == "P", "approved": s == "F", "rejected": s == "O", "urgent": F.col("o_orderpriority") == "1-URGENT"},
        {"value_sum": F.col("o_totalprice")},
        {"value_mean": F.col("o_totalprice") - 1000},
    )


@query("""
    SELECT * FROM (SELECT unnest(['all', 'needs', 'quick', 'dup', 'approved', 'rejected', 'stored']) AS pile, unnest([count(*), count(*) FILTER (p AND u), count(*) FILTER (p AND NOT u), count(*) FILTER (p AND s), count(*) FILTER (o_orderstatus = 'F'), count(*) FILTER (o_orderstatus = 'O'), count(*) FILTER (o_orderstatus = 'F' AND o_totalprice > 100000)]) AS n
    FROM (SELECT *, o_orderstatus = 'P' AS p, o_orderpriority IN ('1-URGENT', '2-HIGH') AS u, o_orderkey % 11 = 0 AS s FROM orders))""")
def pile_counts(spark, d):
    from recordloom.operators.filters import pile_counts as counts

    s = F.col("o_orderstatus")
    p, u, dup = s == "P", F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), F.col("o_orderkey") % 11 == 0
    return counts(
        table(spark, d, "orders"),
        {"all": F.lit(True), "needs": p & u, "quick": p & ~u, "dup": p & dup, "approved": s == "F", "rejected": s == "O", "stored": (s == "F") & (F.col("o_totalprice") > 100000)},
    )


@query("""
    SELECT pile, n FROM (SELECT 'pending' AS pile, count(*) AS n FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT 'reviewed', count(*) FROM orders WHERE o_orderstatus <> 'P' UNION ALL SELECT 'all', count(*) FROM orders)""")
def pile_tabs(spark, d):
    from recordloom.operators.filters import pile_counts as counts

    s = F.col("o_orderstatus")
    return counts(table(spark, d, "orders"), {"pending": s == "P", "reviewed": s != "P", "all": F.lit(True)})


@query(f"""
    SELECT coalesce(nullif(CASE WHEN p_size % 10 = 0 THEN '' WHEN p_size % 10 = 1 THEN NULL ELSE p_brand END, ''), '{UNKNOWN}') AS label, count(*) AS n
    FROM part GROUP BY 1 ORDER BY n DESC, label LIMIT 8""")
def topn_unknown_label(spark, d):
    label = F.when(F.col("p_size") % 10 == 0, "").when(F.col("p_size") % 10 != 1, F.col("p_brand"))
    return metrics.top_labels(table(spark, d, "part"), label, 8)


@query("""
    WITH days AS (SELECT CAST(unnest(generate_series(DATE '2023-12-27', DATE '2024-01-25', INTERVAL 1 DAY)) AS DATE) AS day),
    f AS (SELECT CAST(ts AS DATE) AS day, value FROM events WHERE event_type <> 'error')
    SELECT CAST(days.day AS VARCHAR) AS day, count(value) AS n, count(*) FILTER (value > 50) AS marked FROM days LEFT JOIN f USING (day) GROUP BY 1""")
def daily_gapfill(spark, d):
    facts = table(spark, d, "events").filter("event_type <> 'error'")
    return metrics.daily(facts, F.col("ts"), "2024-01-25", 30, F.col("value") > 50).withColumn("day", F.col("day").cast("string"))


_HEALTH = """
    SELECT count(*) FILTER (x IS NULL) AS no_date, count(*) FILTER (x < DATE '1999-06-30' - 365 OR x > DATE '1999-06-30' + 1) AS odd,
           count(*) FILTER (x BETWEEN DATE '1999-06-30' - 365 AND DATE '1999-06-30' - 30) AS older,
           count(*) FILTER (x BETWEEN DATE '1999-06-30' - 29 AND DATE '1999-06-30' + 1) AS in_window
    FROM (SELECT CASE WHEN o_orderkey % 50 <> 0 THEN CAST(o_orderdate AS DATE) END AS x FROM orders)"""


def _health(spark, d):
    return metrics.date_health(table(spark, d, "orders"), F.when(F.col("o_orderkey") % 50 != 0, F.col("o_orderdate")), "1999-06-30")


@query(_HEALTH)
def date_health(spark, d):
    return _health(spark, d)


@query(f"""
    SELECT *, no_date + odd + older AS outside, round(100.0 * in_window / nullif(no_date + odd + older + in_window, 0), 2) AS coverage_pct FROM ({_HEALTH})""")
def date_coverage(spark, d):
    return metrics.coverage(_health(spark, d))


_SPELL = "CASE WHEN doc_id % 3 = 0 THEN upper(source) WHEN doc_id % 7 = 0 THEN '  ' || source || ' ' ELSE source END"


@query(f"""
    WITH s AS (SELECT trim({_SPELL}) AS x, lang FROM documents),
    c AS (SELECT lower(x) AS k, x, count(*) AS m, row_number() OVER (PARTITION BY lower(x) ORDER BY count(*) DESC, x) AS r FROM s GROUP BY 1, 2)
    SELECT c.x AS label, g.n, g.english FROM (SELECT lower(x) AS k, count(*) AS n, count(*) FILTER (lang = 'en') AS english FROM s GROUP BY 1) g JOIN c ON c.k = g.k AND r = 1
    ORDER BY n DESC, label LIMIT 20""")
def mode_label_by_group(spark, d):
    return metrics.by_person(table(spark, d, "documents"), F.expr(_SPELL), {"english": F.col("lang") == "en"}, 20)


@query("""
    SELECT label, count(*) AS n FROM (SELECT unnest(CASE WHEN event_type = 'error' THEN ['format_invalid', 'missing_field'] WHEN value > 50 THEN ['low_confidence', event_type] ELSE [event_type] END) AS label FROM events) GROUP BY 1""")
def reasons_unnest(spark, d):
    e = F.col("event_type")
    reasons = F.when(e == "error", F.array(F.lit("format_invalid"), F.lit("missing_field"))).when(F.col("value") > 50, F.array(F.lit("low_confidence"), e)).otherwise(F.array(e))
    return metrics.unnested(table(spark, d, "events"), reasons)


@query("""
    WITH u AS (SELECT lower(trim(c_mktsegment)) AS k, count(*) AS customers FROM customer GROUP BY 1),
    o AS (SELECT lower(trim(c_mktsegment)) AS k, count(*) AS orders FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F' GROUP BY 1),
    s AS (SELECT DISTINCT c_mktsegment AS segment FROM customer UNION ALL SELECT ' furniture' UNION ALL SELECT 'nobody')
    SELECT segment, coalesce(customers, 0) AS customers, coalesce(orders, 0) AS orders FROM s LEFT JOIN u ON u.k = lower(trim(segment)) LEFT JOIN o ON o.k = lower(trim(segment))""")
def staff_two_sided_counts(spark, d):
    c = table(spark, d, "customer")
    approved = table(spark, d, "orders").filter("o_orderstatus = 'F'").join(c, F.col("o_custkey") == F.col("c_custkey"))
    staff = c.select(F.col("c_mktsegment").alias("segment")).distinct().union(spark.createDataFrame([(" furniture",), ("nobody",)], "segment string"))
    key = lambda x: F.lower(F.btrim(F.col(x)))
    return metrics.two_sided(staff, key("segment"), {"customers": (c, key("c_mktsegment")), "orders": (approved, key("c_mktsegment"))})


@query("""
    SELECT o_orderpriority AS label, count(*) AS n, round(100.0 * count(*) / (SELECT nullif(count(*), 0) FROM orders), 2) AS pct,
           round(100.0 * count(*) / (SELECT nullif(max(m), 0) FROM (SELECT count(*) AS m FROM orders GROUP BY o_orderpriority)), 2) AS width
    FROM orders GROUP BY 1""")
def kpi_ratios(spark, d):
    g = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return metrics.shares(g, "n")


@query("""
    SELECT json_extract_string(props, '$.k') AS k, count(*) AS n, round(sum(value), 4) AS v FROM events
    WHERE coalesce(CAST(json_extract_string(props, '$.k') AS INTEGER), 0) <> 5 GROUP BY 1""")
def json_field_group(spark, d):
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "int")
    e = table(spark, d, "events").select(k.alias("k"), "value").filter(F.coalesce("k", F.lit(0)) != 5)
    return e.groupBy(F.col("k").cast("string").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("v"))


@query("""
    WITH c AS (SELECT CAST(ts AS DATE) AS day, count(*) AS top FROM events GROUP BY 1),
    s AS (SELECT day, top, top / 4.0 AS step, pow(10.0, floor(log10(top / 4.0))) AS mag FROM c),
    f AS (SELECT day, top, CAST(round_even(coalesce((SELECT min(m * mag) FROM (VALUES (1.0), (1.25), (1.5), (2.0), (2.5), (3.0), (4.0), (5.0), (6.0), (8.0), (10.0)) t(m) WHERE m * mag >= step), step), 0) AS INTEGER) AS w FROM s)
    SELECT CAST(day AS VARCHAR) AS day, top, greatest(w, 1) AS tick1, 4 * greatest(w, 1) AS tick4 FROM f""")
def axis_ticks(spark, d):
    c = table(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("top"))
    return c.withColumn("t", dates.axis_ticks(F.col("top"))).select(F.col("day").cast("string").alias("day"), "top", F.get("t", F.lit(1)).alias("tick1"), F.get("t", F.lit(4)).alias("tick4"))


_READS = """
    SELECT b.item_id, m.model, v.variant, regexp_replace(b.text, '[^\\x00-\\x7F]', '?', 'g') AS truth,
           CASE WHEN (b.item_id * 7 + m.k * 3 + v.k) % 5 = 0 THEN regexp_replace(b.text, '[^\\x00-\\x7F]', '?', 'g')
                WHEN (b.item_id + m.k) % 4 = 1 THEN '' ELSE substr(regexp_replace(b.text, '[^\\x00-\\x7F]', '?', 'g'), 1 + (b.item_id + v.k) % 40) END AS got,
           CAST((b.item_id * 13 + m.k * 5 + v.k) % 17 AS DOUBLE) / 1000 AS cost, CAST((b.item_id * 5 + m.k) % 9 AS DOUBLE) AS latency
    FROM benchmark b, (VALUES ('m0', 0), ('m1', 1), ('m2', 2)) m(model, k), (VALUES ('raw', 0), ('crop', 1)) v(variant, k)"""


def _reads(spark, d):
    b = table(spark, d, "benchmark").select("item_id", F.regexp_replace("text", r"[^\x00-\x7F]", "?").alias("truth"))
    models = spark.createDataFrame([("m0", 0), ("m1", 1), ("m2", 2)], "model string, mk long")
    variants = spark.createDataFrame([("raw", 0), ("crop", 1)], "variant string, vk long")
    # The planned runs are configuration of a few rows.
    r = b.join(F.broadcast(models)).join(F.broadcast(variants))
    got = (
        F.when((F.col("item_id") * 7 + F.col("mk") * 3 + F.col("vk")) % 5 == 0, F.col("truth"))
        .when((F.col("item_id") + F.col("mk")) % 4 == 1, "")
        .otherwise(F.expr("substring(truth, cast(1 + (item_id + vk) % 40 as int))"))
    )
    return r.select(
        "item_id",
        "model",
        "variant",
        "truth",
        got.alias("got"),
        (((F.col("item_id") * 13 + F.col("mk") * 5 + F.col("vk")) % 17).cast("double") / 1000).alias("cost"),
        ((F.col("item_id") * 5 + F.col("mk")) % 9).cast("double").alias("latency"),
    )


_BOARD = f"""
    SELECT model, variant, count(*) AS items, round(avg(exact), 6) AS acc, round(avg(near), 6) AS near_acc, round(avg(cer), 6) AS cer, round(avg(exact), 6) AS whole_rate,
           round(1000 * avg(cost), 6) AS cost_1000, round(median(latency), 6) AS p50, max(latency) AS p95
    FROM (SELECT *, CAST(truth = got AS INTEGER) AS exact, CAST(truth = got OR (truth <> '' AND c <= 0.2) AS INTEGER) AS near, c AS cer
          FROM (SELECT *, CASE WHEN truth = '' THEN CASE WHEN got = '' THEN 0.0 ELSE 1.0 END ELSE least(1.0, levenshtein(truth, got) / length(truth)) END AS c FROM ({_READS})))
    GROUP BY 1, 2"""


def _board(spark, d):
    reads = _reads(spark, d)
    scores = scoring.field_scores(
        reads.select("item_id", "model", "variant", F.lit("text").alias("field"), "got"),
        reads.filter("model = 'm0' AND variant = 'raw'").select("item_id", F.lit("text").alias("field"), "truth"),
        ["item_id"],
    )
    return scoring.scoreboard(scores, ["model", "variant"], "item_id", reads)


@query(_BOARD)
def cer_scoreboard(spark, d):
    return _board(spark, d)


@query(f"SELECT variant, count(*) AS runs, round(avg(acc), 5) AS acc, round(avg(whole_rate), 5) AS whole_rate FROM ({_BOARD}) GROUP BY 1")
def variant_means(spark, d):
    return _board(spark, d).groupBy("variant").agg(F.count(F.lit(1)).alias("runs"), F.round(F.avg("acc"), 5).alias("acc"), F.round(F.avg("whole_rate"), 5).alias("whole_rate"))


@query("""
    WITH p AS (SELECT p_brand, round(avg(l_quantity), 6) AS acc, round(avg(l_extendedprice), 6) AS cost_1000 FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)
    SELECT p_brand, acc, cost_1000, rank, best, best_value FROM (SELECT *, row_number() OVER (ORDER BY acc DESC, cost_1000, p_brand) AS rank FROM p),
        (SELECT p_brand AS best FROM p ORDER BY acc DESC, p_brand DESC LIMIT 1), (SELECT p_brand AS best_value FROM p ORDER BY cost_1000 / greatest(acc, 0.01), p_brand LIMIT 1)
    WHERE rank <= 10""")
def leaderboard(spark, d):
    from pyspark.sql import Window

    li, p = table(spark, d, "lineitem").select("l_partkey", "l_quantity", "l_extendedprice"), table(spark, d, "part").select("p_partkey", "p_brand")
    # Quantities are folded by part before they meet its brand.
    per = li.groupBy("l_partkey").agg(F.sum("l_quantity").alias("q"), F.sum("l_extendedprice").alias("e"), F.count(F.lit(1)).alias("n"))
    board = per.join(p, F.col("l_partkey") == F.col("p_partkey")).groupBy("p_brand").agg(F.round(F.sum("q") / F.sum("n"), 6).alias("acc"), F.round(F.sum("e") / F.sum("n"), 6).alias("cost_1000"))
    top = scoring.leaderboard(board, "acc", "cost_1000", "p_brand").limit(10)
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("acc"), "cost_1000", "p_brand")).cast("bigint"))
    return ranked.join(F.broadcast(scoring.best(board, "p_brand"))).select("p_brand", "acc", "cost_1000", "rank", "best", "best_value")


@query(f"""
    WITH f AS (SELECT item_id, model, got AS name, '' AS tel, cost FROM ({_READS}) WHERE variant = 'crop'),
    s AS (SELECT item_id, model, got AS name, '' AS tel, cost FROM ({_READS}) WHERE variant = 'raw' AND item_id % 3 <> 0)
    SELECT f.item_id, f.model, CASE WHEN f.name = '' AND s.name <> '' THEN s.name ELSE f.name END AS name, '' AS tel, round(f.cost + CASE WHEN f.name = '' THEN coalesce(s.cost, 0) ELSE 0 END, 6) AS cost,
           coalesce(f.name = '' AND s.name <> '', false) AS rescued
    FROM f LEFT JOIN s USING (item_id, model)""")
def fallback_read(spark, d):
    r = _reads(spark, d).withColumn("tel", F.lit(""))
    first = r.filter("variant = 'crop'").select("item_id", "model", F.col("got").alias("name"), "tel", "cost")
    second = r.filter("variant = 'raw' AND item_id % 3 <> 0").select("item_id", "model", F.col("got").alias("name"), "tel", "cost")
    out = scoring.with_fallback(first, second, ["item_id", "model"], ["name", "tel"], ["cost"])
    return out.withColumn("cost", F.round("cost", 6)).withColumn("rescued", F.coalesce("rescued", F.lit(False)))


@query(f"SELECT item_id, model, variant, got <> '' AS read_any FROM ({_READS})")
def read_anything_flag(spark, d):
    from recordloom.functions import rules

    return _reads(spark, d).select("item_id", "model", "variant", rules.read_something(F.col("got"), F.lit(None).cast("string")).alias("read_any"))


@query("""
    SELECT m.model, v.variant, b.item_id FROM benchmark b, (VALUES ('m0'), ('m1')) m(model), (VALUES ('raw'), ('crop')) v(variant)
    WHERE NOT (b.item_id % 2 = 0 AND m.model = 'm0' AND b.item_id % 10 <> 0)""")
def job_antijoin(spark, d):
    from recordloom.sources.readers import missing_jobs

    models, variants = spark.createDataFrame([("m0",), ("m1",)], "model string"), spark.createDataFrame([("raw",), ("crop",)], "variant string")
    items = table(spark, d, "benchmark").select("item_id")
    done = items.filter("item_id % 2 = 0").join(F.broadcast(variants)).select(
        F.lit("m0").alias("model"), "variant", "item_id", F.when(F.col("item_id") % 10 == 0, F.lit("timeout")).alias("error")
    )
    return missing_jobs(models, variants, items, done).select("model", "variant", "item_id")


@query("""
    SELECT id, round(CASE WHEN aspect BETWEEN 1.45 AND 3.4 AND area BETWEEN 0.02 AND 0.7 AND rect >= 0.7 AND ink >= 0.02 AND chars >= 40
           THEN 1 / (1 + 3 * abs(ln(aspect / 2.1))) * rect * chars / (chars + 150) ELSE 0.0 END, 6) AS score
    FROM (SELECT p_partkey AS id, 1.0 + (p_partkey % 30) / 10.0 AS aspect, (p_size % 50) / 60.0 AS area, 0.6 + (p_partkey % 5) / 10.0 AS rect, (p_partkey % 7) / 100.0 AS ink, CAST(p_partkey % 500 AS DOUBLE) AS chars FROM part)""")
def candidate_scores(spark, d):
    p = table(spark, d, "part")
    k = F.col("p_partkey")
    s = scoring.crop_score(1.0 + (k % 30) / 10.0, (F.col("p_size") % 50) / 60.0, 0.6 + (k % 5) / 10.0, (k % 7) / 100.0, (k % 500).cast("double"))
    return p.select(k.alias("id"), F.round(s, 6).alias("score"))


@query("""SELECT item_id, variant, item_id || '/' || variant AS path FROM benchmark, (VALUES ('v0_raw'), ('v1_crop'), ('v2_enhanced')) v(variant)""")
def variant_explode(spark, d):
    variants = F.explode(F.array(*map(F.lit, ["v0_raw", "v1_crop", "v2_enhanced"])))
    return table(spark, d, "benchmark").select("item_id", variants.alias("variant")).withColumn("path", F.concat_ws("/", F.col("item_id").cast("string"), "variant"))
