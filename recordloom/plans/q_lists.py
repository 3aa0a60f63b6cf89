"""Lists, paging, visits, queues and lookups."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from recordloom.functions import dates, rules, text
from recordloom.operators import filters, paging, visits, workqueue
from recordloom.plans.registry import query
from recordloom.sources import readers
from recordloom.sources.readers import table

_DAY = "CASE WHEN o_orderkey % 40 <> 0 THEN CAST(o_orderdate AS DATE) END"
_ROUNDS = f"""
    SELECT id, entity, gkey, dense_rank() OVER (PARTITION BY entity ORDER BY gkey) AS round, count(*) OVER (PARTITION BY entity, gkey) AS dup
    FROM (SELECT o_orderkey AS id, o_custkey AS entity, coalesce(CAST({_DAY} AS VARCHAR), 'id:' || o_orderkey) AS gkey FROM orders WHERE o_orderstatus <> 'O')"""
_TOTALS = f"SELECT *, max(round) OVER (PARTITION BY entity) AS total FROM ({_ROUNDS})"


def _rounds(spark, d):
    o = table(spark, d, "orders").filter("o_orderstatus <> 'O'").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("entity"), F.expr(_DAY).alias("day"), "o_totalprice")
    out = visits.numbered(o, "entity", visits.visit_key(F.col("day"), F.col("id")))
    return out.withColumns({c: F.col(c).cast("bigint") for c in ("round", "dup", "total")})


@query(f"SELECT id, entity, gkey, round, dup, total FROM ({_TOTALS}) WHERE total > 1 OR dup > 1")
def visit_rounds(spark, d):
    return visits.repeated(_rounds(spark, d)).select("id", "entity", "gkey", "round", "dup", "total")


@query(f"SELECT id, gkey, round, dup FROM ({_TOTALS}) WHERE entity = 77 ORDER BY round, id")
def visit_history(spark, d):
    # The filter on the entity reaches the scan: it is the key of every window and group above it.
    return _rounds(spark, d).filter("entity = 77").select("id", "gkey", "round", "dup").orderBy("round", "id")


@query(f"""
    SELECT c_custkey, c_name, r.round, r.total FROM (SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'MACHINERY' ORDER BY c_acctbal DESC, c_custkey LIMIT 20)
    LEFT JOIN (SELECT entity, max(round) AS round, max(total) AS total FROM ({_TOTALS}) GROUP BY 1) r ON entity = c_custkey""")
def rounds_annotated_hits(spark, d):
    hits = table(spark, d, "customer").filter("c_mktsegment = 'MACHINERY'").orderBy(F.desc("c_acctbal"), "c_custkey").limit(20).select("c_custkey", "c_name")
    # Twenty hits at most: only their entities are numbered.
    wanted = F.broadcast(hits.select(F.col("c_custkey").alias("entity")))
    of = _rounds(spark, d).join(wanted, "entity", "left_semi").groupBy("entity").agg(F.max("round").alias("round"), F.max("total").alias("total"))
    return hits.join(of, F.col("entity") == F.col("c_custkey"), "left").select("c_custkey", "c_name", "round", "total")


_FOUND = "(c_name ILIKE '%00001%' OR c_mktsegment ILIKE '%mach%') AND c_nationkey = 3"


@query(f"""
    SELECT c_custkey, c_name, c_acctbal, (SELECT count(*) FROM customer WHERE {_FOUND}) AS total FROM customer WHERE {_FOUND} ORDER BY c_acctbal DESC NULLS LAST, c_custkey LIMIT 10 OFFSET 10""")
def page_filtered_sorted(spark, d):
    found = filters.build(equals={"c_nationkey": 3, "c_mktsegment": ""}, search=filters.search_box("mach", {"c_name": "00001", "c_mktsegment": "mach"}))
    df = table(spark, d, "customer").filter(found)
    by = filters.order(["c_acctbal", "c_name"], "c_acctbal", True, "c_custkey", "c_custkey")
    return filters.with_total(filters.page(df, by, 2, 10), df).select("c_custkey", "c_name", "c_acctbal", "total")


_LINES = "l_extendedprice DESC NULLS LAST, l_shipdate NULLS LAST, l_orderkey NULLS LAST, l_linenumber NULLS LAST, l_partkey NULLS LAST, l_suppkey NULLS LAST, l_quantity NULLS LAST, l_discount NULLS LAST, l_tax NULLS LAST"


@query(f"""
    SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, rn - 1 AS place FROM (SELECT *, row_number() OVER (ORDER BY {_LINES}) AS rn, count(*) OVER () AS n FROM lineitem)
    WHERE rn > (n * 5 // 6) // 50 * 50 AND rn <= (n * 5 // 6) // 50 * 50 + 50""")
def deep_page(spark, d):
    """A page five sixths into all lines (number 10,000 at the largest test size), found by rank."""
    lines = table(spark, d, "lineitem")
    number = lines.count() * 5 // 6 // 50 + 1
    order = [(c.split()[0], "DESC" in c) for c in _LINES.split(", ")]
    # One page: its rows may be numbered in one place.
    w = Window.orderBy(*paging.sort_columns(order))
    found = paging.page_at(lines, order, number, 50, most=20_000)
    return found.withColumn("place", (F.row_number().over(w) + (number - 1) * 50 - 1).cast("bigint")).select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "place")


@query("""
    SELECT p AS asked, least(greatest(p, 1), pages) AS page, total, pages FROM (SELECT count(*) AS total, greatest(1, CAST(ceil(count(*) / 50.0) AS BIGINT)) AS pages FROM customer WHERE c_acctbal < 0), (VALUES (-1), (1), (3), (100000)) t(p)""")
def paging_clamp(spark, d):
    pages = filters.page_count(table(spark, d, "customer").filter("c_acctbal < 0"))
    asked = pages.select("total", "pages", F.explode(F.array(*[F.lit(x).cast("bigint") for x in (-1, 1, 3, 100000)])).alias("asked"))
    return asked.select("asked", filters.clamp(F.col("asked"), 1, F.col("pages")).alias("page"), "total", "pages")


_QUEUE = "o_orderstatus = 'P' AND o_orderkey % 9 <> 0"


@query(f"""
    SELECT (SELECT o_orderkey FROM orders WHERE {_QUEUE} AND o_orderkey <> 42 ORDER BY (o_orderpriority IN ('1-URGENT', '2-HIGH')) DESC, o_orderdate, o_orderkey LIMIT 1) AS next_id,
           (SELECT count(*) FROM orders WHERE {_QUEUE} AND o_orderkey <> 42) AS remaining""")
def queue_head_and_remaining(spark, d):
    q = table(spark, d, "orders").filter(_QUEUE).filter("o_orderkey <> 42")
    return workqueue.head_and_remaining(q, "o_orderkey", F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "o_orderdate")


@query(f"""
    WITH q AS (SELECT o_orderkey, row_number() OVER (ORDER BY (o_orderpriority IN ('1-URGENT', '2-HIGH')) DESC, o_orderdate, o_orderkey) AS k FROM orders WHERE {_QUEUE}),
    w AS (SELECT user_id AS worker, row_number() OVER (ORDER BY user_id) AS k FROM (SELECT DISTINCT user_id FROM events ORDER BY 1 LIMIT 40))
    SELECT worker, o_orderkey, k FROM w JOIN q USING (k)""")
def claim_assign(spark, d):
    q = table(spark, d, "orders").filter(_QUEUE)
    workers = table(spark, d, "events").select(F.col("user_id").alias("worker")).distinct()
    order = [F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").desc(), F.col("o_orderdate").asc(), F.col("o_orderkey").asc()]
    return workqueue.assign(q, workers, "o_orderkey", order, 40).withColumn("k", F.col("k").cast("bigint"))


@query("""
    SELECT event_id, coalesce(ts >= TIMESTAMP '2024-01-20 12:00:00' - INTERVAL 10 MINUTE, false) AS live FROM (SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN ts END AS ts FROM events)""")
def live_claim_flag(spark, d):
    claimed = F.when(F.col("event_id") % 3 != 0, F.col("ts"))
    as_of = F.lit("2024-01-20 12:00:00").cast("timestamp_ntz")
    return table(spark, d, "events").select("event_id", workqueue.live_claim(claimed, dates.lease_start(as_of, 10)).alias("live"))


@query("""
    SELECT user_id, arg_max(event_id, ts) AS newest FROM events WHERE event_type <> 'purchase' AND ts > TIMESTAMP '2024-01-15 00:00:00' - INTERVAL 12 HOUR AND ts <= TIMESTAMP '2024-01-15 00:00:00' GROUP BY 1""")
def open_recent_record(spark, d):
    at = F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    e = table(spark, d, "events").filter((F.col("event_type") != "purchase") & (F.col("ts") > dates.hours_before(at, 12)) & (F.col("ts") <= at))
    return e.groupBy("user_id").agg(F.max_by("event_id", "ts").alias("newest"))


@query("""
    WITH r AS (SELECT c_custkey, count(o_orderkey) AS n, count(*) FILTER (o_orderstatus = 'P') AS stored, count(*) FILTER (o_orderstatus = 'P' AND (o_orderpriority = '5-LOW' OR o_orderpriority[1] = CAST(c_nationkey % 5 + 1 AS VARCHAR))) AS fits,
        max(CASE WHEN o_orderstatus = 'P' AND (o_orderpriority = '5-LOW' OR o_orderpriority[1] = CAST(c_nationkey % 5 + 1 AS VARCHAR)) THEN o_orderkey END) AS pick
        FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1)
    SELECT c_custkey, CASE WHEN n = 0 THEN 'not_found' WHEN stored = 0 THEN 'already_out' WHEN fits = 0 THEN 'phone_mismatch' WHEN fits = 1 THEN 'ok' ELSE 'choose' END AS decision, CASE WHEN fits = 1 THEN pick END AS chosen FROM r""")
def checkout_decision(spark, d):
    """A blank phone (here 5-LOW) passes; one fitting record is taken, several are to be chosen from."""
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    j = c.join(table(spark, d, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left")
    stored = F.col("o_orderstatus") == "P"
    fits = stored & ((F.col("o_orderpriority") == "5-LOW") | (F.substring("o_orderpriority", 1, 1) == (F.col("c_nationkey") % 5 + 1).cast("string")))
    g = j.groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"), F.count_if(stored).alias("stored"), F.count_if(fits).alias("fits"), F.max(F.when(fits, F.col("o_orderkey"))).alias("pick"))
    decision = F.when(F.col("n") == 0, "not_found").when(F.col("stored") == 0, "already_out").when(F.col("fits") == 0, "phone_mismatch").when(F.col("fits") == 1, "ok").otherwise("choose")
    return g.select("c_custkey", decision.alias("decision"), F.when(F.col("fits") == 1, F.col("pick")).alias("chosen"))


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderdate DESC, o_orderkey LIMIT 200")
def list_latest_by_status(spark, d):
    out = readers.newest_first(table(spark, d, "orders"), [F.desc("o_orderdate"), F.asc("o_orderkey")], 200, o_orderstatus="P", o_orderpriority=None)
    return out.select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_custkey = 5 AND o_orderstatus <> 'O' ORDER BY o_orderdate DESC, o_orderkey")
def records_of_entity(spark, d):
    """P10, S02"""
    return readers.lookup(table(spark, d, "orders"), "o_custkey", 5).filter("o_orderstatus <> 'O'").orderBy(F.desc("o_orderdate"), "o_orderkey").select("o_orderkey", "o_orderstatus")


@query("SELECT 'a=1;b=;quota=20' AS settings")
def settings_dict(spark, d):
    rows = spark.createDataFrame([("quota", "20"), ("a", "1"), ("b", "")], "key string, value string")
    m = F.col("settings")
    return readers.settings(rows).select(F.array_join(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("settings"))


@query("SELECT * FROM (VALUES ('blank', 'default'), ('lines', 'one|two'), ('none', 'default')) t(key, value)")
def settings_fallback(spark, d):
    """Stored lines, or the default where none is left."""
    rows = spark.createDataFrame([("lines", " one \n\n two"), ("blank", " \n "), ("none", None)], "key string, value string")
    lines = F.filter(F.transform(F.split(F.coalesce("value", F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return rows.select("key", F.when(F.size(lines) > 0, F.array_join(lines, "|")).otherwise("default").alias("value"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 0 AND c_custkey % 10 <> 3 ORDER BY c_name, c_custkey")
def active_people(spark, d):
    from recordloom.operators import mutate

    c = table(spark, d, "customer").select("c_custkey", "c_name", (F.col("c_acctbal") > 0).alias("active"))
    left = mutate.deactivate(c, c.filter("c_custkey % 10 = 3"), "c_custkey", "active")
    return left.filter("active").orderBy("c_name", "c_custkey").select("c_custkey", "c_name")


@query("SELECT doc_id, source FROM documents WHERE lower(trim(source)) = 'src3'")
def person_filter(spark, d):
    doc = table(spark, d, "documents").select("doc_id", "source")
    spelt = F.when(F.col("doc_id") % 2 == 0, F.upper("source")).otherwise(F.concat(F.lit(" "), F.col("source")))
    sup = F.when(F.lit(False), F.lit("x"))
    df = doc.select("doc_id", "source", spelt.alias("who"), sup.alias("superseded_by"))
    return df.filter(filters.build(person=("who", " SRC3 "), superseded=False)).select("doc_id", "source")


@query("""
    SELECT c_custkey, count(o_orderkey) AS open FROM customer LEFT JOIN (SELECT DISTINCT k, o_orderkey FROM (SELECT o_custkey AS k, o_orderkey FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT o_orderkey % 1000 AS k, o_orderkey FROM orders WHERE o_orderstatus = 'P')) ON k = c_custkey GROUP BY 1""")
def open_duplicates_count(spark, d):
    """Open records with the same entity or the same confirmation key: a union of two equi-joins, not an OR."""
    o = table(spark, d, "orders").filter("o_orderstatus = 'P'")
    keys = o.select(F.explode(F.array_distinct(F.array(F.col("o_custkey"), F.col("o_orderkey") % 1000))).alias("c_custkey"))
    n = keys.groupBy("c_custkey").agg(F.count(F.lit(1)).alias("open"))
    return table(spark, d, "customer").select("c_custkey").join(n, "c_custkey", "left").withColumn("open", F.coalesce("open", F.lit(0)))


@query("""
    SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS children, (SELECT min(o_orderkey) FROM orders WHERE o_custkey = c_custkey) AS first_child FROM customer""")
def child_counts_decorrelated(spark, d):
    """J08, J09"""
    g = table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("children"), F.min("o_orderkey").alias("first_child"))
    j = table(spark, d, "customer").select("c_custkey").join(g, F.col("o_custkey") == F.col("c_custkey"), "left")
    return j.select("c_custkey", F.coalesce("children", F.lit(0)).alias("children"), "first_child")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 9000) AND o_orderpriority IN ('1-URGENT', '3-MEDIUM')")
def candidate_semi_join(spark, d):
    """J10, J11"""
    ids = table(spark, d, "customer").filter("c_acctbal > 9000").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, d, "orders").filter(F.col("o_orderpriority").isin("1-URGENT", "3-MEDIUM")).join(ids, "o_custkey", "left_semi").select("o_orderkey", "o_custkey")


_LABELS = {"P": "pending review", "F": "approved"}


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'P' THEN 'pending review' WHEN 'F' THEN 'approved' ELSE o_orderstatus END AS label FROM orders")
def label_lookup(spark, d):
    return table(spark, d, "orders").select("o_orderkey", rules.relabel(F.col("o_orderstatus"), _LABELS).alias("label"))


@query("SELECT conv_id, arg_max(role, turn) AS last_role, sha256(arg_min(text, turn)) AS first_text, count(*) AS n FROM conversations GROUP BY 1")
def conversation_last_turn(spark, d):
    c = table(spark, d, "conversations")
    return c.groupBy("conv_id").agg(F.max_by("role", "turn").alias("last_role"), F.sha2(F.min_by("text", "turn"), 256).alias("first_text"), F.count(F.lit(1)).alias("n"))


@query("""
    SELECT o_orderkey AS id, o_custkey AS entity, lower(o_orderpriority) AS slot, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, CASE o_orderstatus WHEN 'P' THEN 'pending' WHEN 'F' THEN 'approved' ELSE 'rejected' END AS status, o_totalprice AS amount
    FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' AND o_orderdate < TIMESTAMP '1999-01-01' ORDER BY o_orderdate, o_orderkey""")
def export_projection(spark, d):
    """A narrow projection; filter and columns reach the scan."""
    o = table(spark, d, "orders").filter((F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp_ntz")) & (F.col("o_orderdate") < F.lit("1999-01-01").cast("timestamp_ntz")))
    status = rules.relabel(F.col("o_orderstatus"), {"P": "pending", "F": "approved", "O": "rejected"})
    return o.orderBy("o_orderdate", "o_orderkey").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("entity"), F.lower("o_orderpriority").alias("slot"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), status.alias("status"), F.col("o_totalprice").alias("amount")
    )


@query("""
    SELECT o_orderkey, lower(c_name) AS name_norm, regexp_replace(c_name, '[^0-9]', '', 'g') AS tel_digits, lower(replace(o_orderpriority, ' ', ' ')) AS location, o_orderpriority IN ('1-URGENT') AS needs_review
    FROM orders JOIN customer ON c_custkey = o_custkey""")
def record_projection(spark, d):
    """The row that is stored, with its normalised columns."""
    o, c = table(spark, d, "orders"), table(spark, d, "customer").select("c_custkey", "c_name")
    j = o.join(c, F.col("c_custkey") == F.col("o_custkey"))
    return j.select("o_orderkey", text.name(F.col("c_name"), False).alias("name_norm"), text.phone(F.col("c_name"), False).alias("tel_digits"), text.location(F.col("o_orderpriority"), False).alias("location"), (F.col("o_orderpriority") == "1-URGENT").alias("needs_review"))


@query("""
    SELECT c_custkey, array_to_string(list_sort(list_filter([CASE WHEN NOT (length(nm) >= 4 AND contains(nm, ' ')) THEN 'name' END, CASE WHEN length(tel) <> 10 THEN 'tel' END, CASE WHEN c_mktsegment NOT IN ('BUILDING', 'MACHINERY', 'FURNITURE') THEN 'type' END, CASE WHEN c_acctbal < 0 THEN 'plate' END], lambda x: x IS NOT NULL)), ',') AS errors
    FROM (SELECT *, CASE WHEN c_custkey % 4 = 0 THEN c_mktsegment || ' ' || c_name ELSE c_name END AS nm, substr('0' || regexp_replace(c_name, '[^0-9]', '', 'g'), 1, CAST(8 + c_custkey % 4 AS INTEGER)) AS tel FROM customer)""")
def form_validation(spark, d):
    c = table(spark, d, "customer")
    nm = F.when(F.col("c_custkey") % 4 == 0, F.concat_ws(" ", "c_mktsegment", "c_name")).otherwise(F.col("c_name"))
    c = c.withColumns({"nm": nm, "tel": F.expr("substring(concat('0', regexp_replace(c_name, '[^0-9]', '')), 1, cast(8 + c_custkey % 4 as int))")})
    checks = {
        "name": rules.full_name(F.col("nm")),
        "tel": F.length(text.phone(F.col("tel"), False)) == 10,
        "type": F.col("c_mktsegment").isin("BUILDING", "MACHINERY", "FURNITURE"),
        "plate": F.col("c_acctbal") >= 0,
    }
    return readers.typed_forms(c, checks).select("c_custkey", F.array_join("errors", ",").alias("errors"))


@query("""SELECT k, count(*) AS n, round(sum(value), 4) AS v FROM (SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, value FROM events) WHERE k < 50 GROUP BY 1""")
def json_results_scan(spark, d):
    """Results written as JSON folders by key and read back with a declared schema."""
    from recordloom.session import scratch_path

    path = scratch_path(spark, "json-results")
    e = table(spark, d, "events").select(F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k"), "value", "event_type")
    e.write.partitionBy("event_type").json(path)
    back = readers.json_files(spark, path, "k bigint, value double")
    return back.filter("k < 50").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("v"))
