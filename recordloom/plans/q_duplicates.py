"""Duplicate records: documents stand for captured items (hash of the text; lang, source and the whole text without its case and blanks as key)."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordloom.operators import duplicates, mutate
from recordloom.plans.registry import query
from recordloom.sources.readers import table

_PLAIN = "lower(trim(regexp_replace(text, '[ \\t\\r\\n]+', ' ', 'g')))"
_KEYS = f"""
    SELECT doc_id AS id, 'img' AS family, sha256(text) AS key FROM documents
    UNION ALL SELECT doc_id, 'txt', lang || '/' || source || '/' || sha256({_PLAIN}) FROM documents WHERE length({_PLAIN}) >= 8"""
_COMPONENTS = f"""
    WITH RECURSIVE keys AS MATERIALIZED ({_KEYS}), e AS MATERIALIZED (SELECT DISTINCT a.id AS x, b.id AS y FROM keys a JOIN keys b ON a.family = b.family AND a.key = b.key AND a.id <> b.id),
    r(id, label) AS (SELECT x, x FROM e UNION SELECT e.y, r.label FROM r JOIN e ON e.x = r.id) SELECT id, min(label) AS component FROM r GROUP BY id"""


def _edges(spark, d):
    doc = table(spark, d, "documents")
    text = F.lower(F.trim(F.regexp_replace("text", r"[ \t\r\n]+", " ")))
    # A missing field or a short text has no key.
    key = F.when(F.length(text) >= 8, F.concat("lang", F.lit("/"), "source", F.lit("/"), F.sha2(text, 256)))
    return duplicates.key_edges(doc, "doc_id", {"img": F.sha2("text", 256), "txt": key})


def _members(spark, d):
    doc = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "lang", "source", "n_chars")
    approved = table(spark, d, "labels").filter("quality = 1").select(F.col("doc_id").alias("id"), F.lit(True).alias("ok"))
    return duplicates.groups(_edges(spark, d)).join(doc, "id").join(approved, "id", "left").withColumn("approved", F.coalesce("ok", F.lit(False))).drop("ok")


_MEMBERS = f"SELECT c.id, component, lang, source, n_chars, EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = c.id AND quality = 1) AS approved FROM ({_COMPONENTS}) c JOIN documents ON doc_id = c.id"


@query("SELECT doc_id, count(*) OVER (PARTITION BY text ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS pos FROM documents")
def batch_first_wins(spark, d):
    """U03"""
    doc = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))
    return duplicates.first_wins(doc, "sha", [F.asc("doc_id")]).select("doc_id", F.col("pos").cast("bigint").alias("pos"))


@query("""
    SELECT i.doc_id, min(k.doc_id) AS holder FROM (SELECT * FROM documents WHERE doc_id % 2 = 1) i LEFT JOIN (SELECT * FROM documents WHERE doc_id % 2 = 0) k ON sha256(i.text) = sha256(k.text) GROUP BY 1""")
def hash_gate_first_wins(spark, d):
    """T06, J01, F34"""
    doc = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))
    out = duplicates.hash_gate(doc.filter("doc_id % 2 = 1"), doc.filter("doc_id % 2 = 0").withColumnRenamed("doc_id", "record").withColumn("created", F.col("record")), "sha", "created", "record")
    return out.select("doc_id", "holder")


@query(f"WITH keys AS ({_KEYS}) SELECT DISTINCT id FROM keys JOIN (SELECT family, key FROM keys GROUP BY 1, 2 HAVING count(DISTINCT id) > 1) USING (family, key)")
def dup_candidates_union(spark, d):
    return duplicates.candidates(_edges(spark, d))


@query(f"WITH keys AS ({_KEYS}) SELECT family, min(id) OVER w AS first, id FROM keys WINDOW w AS (PARTITION BY family, key) QUALIFY id <> min(id) OVER w")
def same_record_pairs(spark, d):
    """Every record beside the first one of each key that they share; the pairs of a key follow from it."""
    return duplicates.shared_keys(_edges(spark, d)).filter("id <> first").select("family", "first", "id")


@query(_COMPONENTS)
def dup_components(spark, d):
    return duplicates.groups(_edges(spark, d)).select("id", "component")


@query(f"""
    SELECT component, count(*) AS size, count(*) FILTER (approved) AS approved, min(id) FILTER (approved) AS keeper, count(*) - 1 AS surplus,
           CASE WHEN count(*) FILTER (approved) >= 2 THEN 'approved_dups' WHEN count(*) FILTER (approved) = 1 THEN 'clearable' ELSE 'untouched' END AS pile
    FROM ({_MEMBERS}) GROUP BY 1""")
def dup_keeper_and_surplus(spark, d):
    return duplicates.report(_members(spark, d).withColumn("created", F.col("id")), F.col("approved"), "created")


_FIELDS = {"lang": "lang", "source": "source", "n_chars": "n_chars"}


@query(f"""
    SELECT component, array_to_string(list_filter([CASE WHEN count(DISTINCT lang) > 1 THEN 'lang' END, CASE WHEN count(DISTINCT n_chars) > 1 THEN 'n_chars' END, CASE WHEN count(DISTINCT source) > 1 THEN 'source' END], lambda x: x IS NOT NULL), ',') AS clash_fields,
           count(DISTINCT lang) = 1 AND count(DISTINCT n_chars) = 1 AND count(DISTINCT source) = 1 AS identical FROM ({_MEMBERS}) GROUP BY 1""")
def dup_clash_fields(spark, d):
    out = duplicates.clashes(_members(spark, d), {k: F.col(c) for k, c in _FIELDS.items()})
    return out.withColumn("clash_fields", F.array_join("clash_fields", ","))


@query(f"""
    WITH m AS ({_MEMBERS}), g AS (SELECT component, min(id) AS keep FROM m GROUP BY 1 HAVING count(DISTINCT lang) = 1 AND count(DISTINCT n_chars) = 1 AND count(DISTINCT source) = 1)
    SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT id FROM m JOIN g USING (component) WHERE id <> keep)""")
def bulk_resolve_identical(spark, d):
    m = _members(spark, d).withColumn("created", F.col("id"))
    doc = table(spark, d, "documents").select("doc_id")
    return duplicates.resolve(doc, m, "doc_id", "created", {k: F.col(c) for k, c in _FIELDS.items()})


@query(f"""
    WITH keys AS ({_KEYS}), a AS (SELECT doc_id AS id FROM labels WHERE quality = 1), o AS (SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT id FROM a))
    SELECT x.id, min(k.id) AS superseded_by FROM keys x JOIN o ON x.id = o.id JOIN keys k ON x.family = k.family AND x.key = k.key JOIN a ON k.id = a.id GROUP BY 1""")
def mark_superseded(spark, d):
    ids = table(spark, d, "labels").filter("quality = 1").select(F.col("doc_id").alias("id"))
    open_records = table(spark, d, "documents").select(F.col("doc_id").alias("id")).join(ids, "id", "left_anti")
    return duplicates.superseded_by(_edges(spark, d), ids.withColumn("created", F.col("id")), open_records)


@query("""
    SELECT doc_id, sha256(text) AS sha, CASE WHEN doc_id % 2 = 0 THEN 'kept' ELSE 'new' END AS origin FROM documents
    WHERE doc_id % 2 = 0 OR (sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 2 = 0) AND doc_id IN (SELECT min(doc_id) FROM documents WHERE doc_id % 2 = 1 GROUP BY text))""")
def upsert_ignore_conflict(spark, d):
    """K02, J16"""
    doc = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))
    state = doc.filter("doc_id % 2 = 0").withColumn("origin", F.lit("kept"))
    return mutate.insert_ignore(state, doc.filter("doc_id % 2 = 1").withColumn("origin", F.lit("new")), ["sha"], "doc_id")
