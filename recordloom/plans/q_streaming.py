"""Streaming queries, run over what there is."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordloom.plans.registry import query
from recordloom.session import scratch_path
from recordloom.sources.readers import table
from recordloom.streaming import ingest as ing
from recordloom.streaming import landing, queue, state


def _attempts(e):
    return e.filter("event_type IN ('error', 'signup')").select(
        F.concat(F.lit("u"), F.col("user_id") % 20).alias("key"), "event_id", F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("at_us"), (F.col("event_type") == "signup").alias("ok"),
        F.col("ts").cast("timestamp").alias("ts"),
    ).select("key", "event_id", (F.col("at_us") / 1e6).alias("at"), "ok", "ts")


#: The fold as recursive SQL: one step for each attempt of a key, in order.
_FOLD = """
    WITH RECURSIVE a AS (
        SELECT 'u' || (user_id % 20) AS key, event_id, epoch_us(ts) / 1e6 AS x, event_type = 'signup' AS ok,
               row_number() OVER (PARTITION BY user_id % 20 ORDER BY ts, event_id) AS i
        FROM events WHERE event_type IN ('error', 'signup')),
    s AS (
        SELECT key, event_id, x, i, false AS refused, 0 AS lock, 0::DOUBLE AS until, CASE WHEN ok THEN []::DOUBLE[] ELSE [x] END AS fails FROM a WHERE i = 1
        UNION ALL
        SELECT key, event_id, x, i, refused, lock, CASE WHEN refused THEN until WHEN ok THEN 0 WHEN lock > 0 THEN x + lock ELSE until END, CASE WHEN refused THEN old WHEN ok THEN []::DOUBLE[] ELSE recent END
        FROM (
            SELECT *, CASE WHEN refused OR ok OR len(recent) < 5 THEN 0 ELSE least({longest}, 30 * 2 ** least(len(recent) - 5, 20))::INT END AS lock
            FROM (
                SELECT a.key, a.event_id, a.x, a.i, a.ok, s.until > a.x AS refused, s.until, s.fails AS old, list_append(list_filter(s.fails, lambda t: a.x - t < 900), a.x) AS recent
                FROM s JOIN a ON a.key = s.key AND a.i = s.i + 1)))
    SELECT key, event_id, x AS "at", refused, lock FROM s"""


@query(_FOLD.format(longest=1800))
def throttle_exact(spark, d):
    """The ordered fold in batch form."""
    return state.throttle_batch(_attempts(table(spark, d, "events")))


@query(_FOLD.format(longest=180))
def throttle_exact_user(spark, d):
    """The same with the lower ceiling of user names."""
    return state.throttle_batch(_attempts(table(spark, d, "events")), state.LONGEST_USER)


@query(_FOLD.format(longest=1800))
def throttle_exact_stream(spark, d):
    """The same rows from a stream with state per key."""
    e = spark.readStream.schema(table(spark, d, "events").schema).parquet(_folder(spark, d, "events"))
    return state.drain(state.throttle_stream(_attempts(e).withWatermark("ts", "1 hour")), scratch_path(spark, "throttle"))


def _folder(spark, d, name):
    """A folder with the table's files: file streams read folders."""
    path = scratch_path(spark, f"landing-{name}")
    table(spark, d, name).write.parquet(path)
    return path


@query("SELECT sha256(text) AS sha, count(*) OVER () AS n FROM documents GROUP BY 1")
def hash_gate_stream(spark, d):
    """The first upload of each hash, as a stream."""
    doc = spark.readStream.schema(table(spark, d, "documents").schema).parquet(_folder(spark, d, "documents"))
    # A lost upload is no duplicate, so the gate is the exact one.
    up = doc.select(F.sha2("text", 256).alias("sha"), F.timestamp_seconds(1_600_000_000 + F.col("doc_id") % 1000).alias("ts"))
    got = state.drain(state.first_seen_stream(up, "sha", "ts", None), scratch_path(spark, "gate")).select("sha")
    return got.join(F.broadcast(got.agg(F.count(F.lit(1)).alias("n"))))


@query("SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2 HAVING min(CAST(ts AS DATE)) < (SELECT max(CAST(ts AS DATE)) FROM events)")
def daily_counts_stream(spark, d):
    """A04 over a stream: days that the watermark has closed."""
    e = spark.readStream.schema(table(spark, d, "events").schema).parquet(_folder(spark, d, "events"))
    got = state.drain(state.daily_counts_stream(e.withColumn("ts", F.col("ts").cast("timestamp")), "ts"), scratch_path(spark, "daily"))
    return got.select(F.date_format(F.col("window")["start"], "yyyy-MM-dd").alias("day"), "event_type", "n")


def _uploads(spark, d):
    """Fifty different files, each uploaded by many customers."""
    k = F.col("c_custkey") % 50
    conf = F.when(F.col("c_custkey") % 2 == 0, "0.9").otherwise("0.5")
    body = F.concat(F.lit('{"fields": {"full_name": "a b'), k, F.lit('", "tel": "08'), F.lpad(k.cast("string"), 8, "1"), F.lit('", "plate": "1กก'), k, F.lit('"}, "confidence": {"name": '), conf, F.lit("}}"))
    return table(spark, d, "customer").select(F.col("c_name").alias("path"), F.encode(body, "UTF-8").alias("content"), k.alias("k"))


@query("""
    WITH f AS (SELECT c_custkey % 50 AS k, min(c_name) AS path, '08' || lpad(CAST(c_custkey % 50 AS VARCHAR), 8, '1') AS tel FROM customer WHERE c_custkey % 50 <> 7 GROUP BY ALL)
    SELECT sha256(CAST(encode('{"fields": {"full_name": "a b' || k || '", "tel": "' || tel || '", "plate": "1กก' || k || '"}, "confidence": {"name": ' || CASE WHEN k % 2 = 0 THEN '0.9' ELSE '0.5' END || '}}') AS BLOB)) AS sha256,
           'a b' || k AS name_norm,
           concat_ws(',', CASE WHEN k % 10 IN (3, 4) OR EXISTS (SELECT 1 FROM f g WHERE g.tel = f.tel AND g.path < f.path) THEN 'duplicate_suspect' END, CASE WHEN k % 2 = 1 THEN 'low_confidence' END) AS reasons
    FROM f""")
def ingest_batch(spark, d):
    """S10, S12, U03, T06, T07, A11, K01 with the stub extractor: a batch with repeats, of which some are stored already, beside open records with a fifth of the plates."""
    files = _uploads(spark, d).withColumn("sha256", F.sha2("content", 256))
    known = files.filter("k = 7").select("sha256", F.lit("r7").alias("record"), F.lit(0).alias("created")).distinct()
    stored = files.filter("k % 10 IN (3, 4)").select(F.concat(F.lit("1กก"), "k").alias("plate_norm"), F.lit("").alias("tel_digits"))
    records, _ = ing.ingest(files, known, ing.StubExtractor(), 2026, stored=stored)
    return records.select("sha256", "name_norm", F.array_join("review_reason", ",").alias("reasons"))


def queue_commands(e):
    """Events as commands on the queues of three teams: views add items, clicks claim the next, purchases finish one, sign-ups claim a named one, errors release."""
    k = F.col("event_id")
    command = F.create_map(*[F.lit(x) for x in ("view", "add", "click", "claim_next", "purchase", "done", "signup", "claim_one", "error", "release")])
    item = F.when(F.col("event_type") == "view", k).when(F.col("event_type") == "purchase", k - 40).when(F.col("event_type") == "signup", k - 7)
    return e.select(
        F.concat(F.lit("team"), F.col("user_id") % 3).alias("queue"), k.alias("seq"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), F.try_element_at(command, "event_type").alias("command"),
        F.concat(F.lit("w"), F.col("user_id") % 7).alias("worker"), F.concat(F.lit("i"), item).alias("item"), (k % 5 == 0).alias("urgent"),
    )


@query()
def queue_claims_stream(spark, d):
    """The sharded queue over all events, landed in four spans of time; each run goes on from the state of the last."""
    e = table(spark, d, "events")
    at = F.unix_seconds(F.col("ts").cast("timestamp"))
    span = e.agg(F.min(at).alias("a"), F.max(at).alias("b")).first()
    landing, path, got = scratch_path(spark, "landing-commands"), scratch_path(spark, "queue"), None
    for i in range(4):
        part = F.least(F.floor((at - F.lit(span.a)) * 4 / F.lit(max(1, (span.b or 0) - (span.a or 0)))), F.lit(3))
        queue_commands(e.filter(part == i)).write.mode("append").parquet(landing)
        stream = spark.readStream.schema(queue_commands(e).schema).parquet(landing)
        got = queue.drain_queue(queue.queue_stream(stream), path)
    return got


@query("""
    WITH f AS (SELECT c_custkey % 50 AS k, min(c_name) AS path, '08' || lpad(CAST(c_custkey % 50 AS VARCHAR), 8, '1') AS tel FROM customer GROUP BY ALL)
    SELECT 'a b' || k AS name_norm, (SELECT count(*) FROM f g WHERE g.tel = f.tel AND g.path < f.path) AS twins,
           concat_ws(',', CASE WHEN EXISTS (SELECT 1 FROM f g WHERE g.tel = f.tel AND g.path < f.path) THEN 'duplicate_suspect' END, CASE WHEN k % 2 = 1 THEN 'low_confidence' END) AS reasons
    FROM f""")
def landing_exactly_once(spark, d):
    """Uploads that land in two spans, each ingested by a run that goes on from the last one's commits."""
    folder, store = scratch_path(spark, "landing-ingest"), None
    files, n = _uploads(spark, d).drop("k"), table(spark, d, "customer").count()
    edges = [None, f"Customer#{n // 2:09}", None]
    for low, high in zip(edges[:-1], edges[1:], strict=True):
        part = files.filter((F.col("path") >= low if low else F.lit(True)) & (F.col("path") < high if high else F.lit(True)))
        part.write.mode("append").parquet(f"{folder}/landing")
        store = landing.run(spark.readStream.schema(files.schema).parquet(f"{folder}/landing"), folder, ing.StubExtractor(), 2026)
    return store.table("records").select("name_norm", F.col("duplicates").cast("bigint").alias("twins"), F.array_join("review_reason", ",").alias("reasons"))
