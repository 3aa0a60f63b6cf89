"""State changes as folds of commands."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordloom.operators import mutate, workqueue
from recordloom.plans.registry import query
from recordloom.sources.readers import table


def _changed(o):
    k = F.col("o_orderkey")
    return o.select(
        "o_orderkey",
        F.when(k % 7 == 0, "X").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"),
        F.when(k % 13 == 0, F.lit("")).otherwise(F.col("o_orderpriority")).alias("o_orderpriority"),
        F.when(k % 29 == 0, F.col("o_custkey") + 1).otherwise(F.col("o_custkey")).alias("o_custkey"),
    )


_DIFF = """
    SELECT o_orderkey, 'o_orderstatus' AS field, o_orderstatus AS old_value, 'X' AS new_value FROM orders WHERE o_orderkey % 7 = 0
    UNION ALL SELECT o_orderkey, 'o_orderpriority', o_orderpriority, '' FROM orders WHERE o_orderkey % 13 = 0
    UNION ALL SELECT o_orderkey, 'o_custkey', CAST(o_custkey AS VARCHAR), CAST(o_custkey + 1 AS VARCHAR) FROM orders WHERE o_orderkey % 29 = 0"""


def _diff(spark, d):
    o = table(spark, d, "orders")
    return mutate.audit_diff(o, _changed(o), "o_orderkey", ["o_orderstatus", "o_orderpriority", "o_custkey"])


@query(_DIFF)
def audit_diff_unpivot(spark, d):
    return _diff(spark, d).select("o_orderkey", "field", "old_value", "new_value")


@query(f"SELECT field, count(*) AS n FROM ({_DIFF}) GROUP BY 1 ORDER BY n DESC, field LIMIT 8")
def field_edits_topn(spark, d):
    return _diff(spark, d).groupBy("field").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "field").limit(8)


@query("""
    SELECT user_id, arg_min(event_id, (ts, event_id)) AS winner, count(*) AS attempts FROM events WHERE event_type = 'purchase' GROUP BY 1""")
def first_writer_wins(spark, d):
    """K05, T04"""
    e = table(spark, d, "events").filter("event_type = 'purchase'")
    won = mutate.first_command(e, "user_id", ["ts", "event_id"]).select("user_id", F.col("event_id").alias("winner"))
    return won.join(e.groupBy("user_id").agg(F.count(F.lit(1)).alias("attempts")), "user_id")


@query("""
    SELECT o_orderkey, CASE WHEN hit THEN 'R' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN hit THEN 'blurred' END AS reason, hit AS applied, CASE WHEN hit THEN '2024-02-01' END AS updated_at
    FROM (SELECT *, o_orderkey % 5 = 0 AND o_orderstatus = 'P' AS hit FROM orders)""")
def reject_transform(spark, d):
    """K06, T08, K18"""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    commands = o.filter("o_orderkey % 5 = 0").select("o_orderkey", F.lit("blurred").alias("why"), F.lit(1).alias("seq"))
    commands = commands.unionByName(commands.select("o_orderkey", F.lit("late").alias("why"), F.lit(2).alias("seq")))
    out = mutate.guarded(o, commands, "o_orderkey", ["seq"], F.col("o_orderstatus") == "P", {"o_orderstatus": F.lit("R"), "reason": F.col("why")}, F.lit("2024-02-01"))
    return out.select("o_orderkey", "o_orderstatus", "reason", "applied", "updated_at")


@query("""
    SELECT event_id, array_to_string(list_sort(list_distinct(list_append(CASE WHEN event_type = 'error' THEN ['recheck', 'missing_field'] WHEN event_type = 'view' THEN CAST([] AS VARCHAR[]) ELSE [event_type, event_type] END, 'recheck'))), ',') AS reasons
    FROM events WHERE NOT (event_type = 'signup' AND event_id % 2 = 0)""")
def send_back_reasons(spark, d):
    """K13, A14, P11"""
    e = F.col("event_type")
    reasons = F.when(e == "error", F.array(F.lit("recheck"), F.lit("missing_field"))).when(e == "view", F.lit(None)).otherwise(F.array(e, e))
    df = table(spark, d, "events").withColumn("done", F.when((e == "signup") & (F.col("event_id") % 2 == 0), F.array(F.lit("x"))).otherwise(F.array(F.lit("y"))))
    return df.filter(~F.array_contains("done", "x")).select("event_id", F.array_join(mutate.send_back(reasons, "recheck"), ",").alias("reasons"))


@query("""
    SELECT event_id, CASE WHEN event_id % 4 = 0 THEN '9' ELSE json_extract_string(props, '$.k') END AS k, CASE WHEN event_id % 4 = 0 THEN '4' END AS version, CASE WHEN event_type = 'error' THEN 'confirmed' WHEN event_id % 3 = 0 THEN 'edited' ELSE '' END AS locked FROM events""")
def merge_audit_json(spark, d):
    """K14, F33, P18"""
    from recordloom.functions import rules

    e = table(spark, d, "events")
    old = F.from_json("props", "map<string,string>")
    new = F.when(F.col("event_id") % 4 == 0, F.create_map(F.lit("k"), F.lit("9"), F.lit("version"), F.lit("4"))).otherwise(F.create_map().cast("map<string,string>"))
    status = F.when(F.col("event_type") == "error", "approved").otherwise("pending")
    m = e.select("event_id", mutate.merge_json(old, new).alias("m"), rules.lock_reason(status, F.when(F.col("event_id") % 3 == 0, 1).otherwise(0)).alias("locked"))
    return m.select("event_id", F.try_element_at("m", F.lit("k")).alias("k"), F.try_element_at("m", F.lit("version")).alias("version"), "locked")


@query("SELECT * FROM (VALUES ('a', '2'), ('c', 'new'), ('keep', 'x')) t(key, value)")
def settings_upsert(spark, d):
    """K09"""
    state = spark.createDataFrame([("a", "1"), ("b", "x"), ("keep", "x")], "key string, value string")
    commands = spark.createDataFrame([("a", "0", 1), ("a", "2", 2), ("b", "  ", 1), ("c", "new", 1), ("z", "", 3)], "key string, value string, seq int")
    return mutate.upsert_settings(state, commands, "seq")


@query("""
    SELECT (SELECT count(*) FROM orders WHERE o_orderkey % 3 <> 0) AS records, (SELECT count(*) FROM lineitem WHERE l_orderkey % 3 <> 0) AS children, (SELECT count(*) FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderkey % 10 = 1 AND (o_orderkey - 1) % 3 <> 0) AS pointing""")
def delete_cascade(spark, d):
    """Children go with their record; pointers to it become null."""
    o = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 10 == 1, F.col("o_orderkey") - 1).alias("superseded_by"))
    out = mutate.delete(o, o.filter("o_orderkey % 3 = 0").select("o_orderkey"), "o_orderkey", {"lines": (table(spark, d, "lineitem").select("l_orderkey"), "l_orderkey")}, "superseded_by")
    n = out["state"].agg(F.count(F.lit(1)).alias("records"), F.count("superseded_by").alias("pointing"))
    return n.join(F.broadcast(out["lines"].agg(F.count(F.lit(1)).alias("children")))).select("records", "children", "pointing")


@query("""
    SELECT event_id, recent, CASE WHEN recent >= 5 THEN CAST(least(1800, 30 * pow(2, least(recent - 5, 20))) AS INTEGER) ELSE 0 END AS lock
    FROM (SELECT event_id, count(*) OVER (PARTITION BY user_id % 3 ORDER BY epoch(date_trunc('second', ts)) RANGE BETWEEN 14399 PRECEDING AND CURRENT ROW) AS recent FROM events WHERE event_type = 'error')""")
def throttle_window(spark, d):
    e = table(spark, d, "events").filter("event_type = 'error'").withColumn("who", F.col("user_id") % 3)
    r = workqueue.failures_in_window(e, "who", "ts", 14400)
    return r.select("event_id", "recent", workqueue.lock_seconds(F.col("recent")).alias("lock"))


@query("SELECT user_id AS worker, event_id AS record FROM events WHERE event_type = 'view' AND (user_id % 2 = 1 OR event_id % 5 = 0)")
def release_claims(spark, d):
    """Even workers give up their claims but those divisible by 5."""
    claims = table(spark, d, "events").filter("event_type = 'view'").select(F.col("user_id").alias("worker"), F.col("event_id").alias("record"))
    even = claims.filter("worker % 2 = 0")
    return workqueue.release(claims, even.select("worker").distinct(), even.filter("record % 5 = 0"))
